"""Run the full cross-validated study end to end and print its result tables.

usage: python tools/run_study.py <sf_dir> [base|optimised] [threads]
Outputs go below spark.checkpoint.dir (or a private folder when unset).
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortkit.plans.retrain import pipeline_balanced_retrain, pipeline_retrain  # noqa: E402
from cohortkit.session import get_spark  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    variant = sys.argv[2] if len(sys.argv) > 2 else "optimised"
    threads = int(sys.argv[3]) if len(sys.argv) > 3 else 8
    spark = get_spark("cohortkit-study")
    t0 = time.perf_counter()
    run = pipeline_balanced_retrain if variant == "optimised" else pipeline_retrain
    res = run(spark, sf, threads=threads)
    secs = time.perf_counter() - t0
    test = res["test_results"]
    test.orderBy("set_order", "model_order").show(60, truncate=False)
    res["best_cv"].show(truncate=False)
    n_fits = test.count() * 11
    failed = test.filter("status <> 'ok'").count()
    print(f"variant={variant} fits={n_fits} failed_runs={failed} seconds={secs:.1f} "
          f"per_fit={secs / max(n_fits, 1):.2f} out={res['out_dir']}")


if __name__ == "__main__":
    main()
