"""cohortkit: cohort analytics expressed as Spark DataFrame and Spark ML operators.

Layout
------
sources/    reading raw sheets and stage tables, writing result tables
functions/  column-expression helpers (numeric coercion, formatting, hashing)
            and the small Arrow UDFs for distribution tails
operators/  DataFrame -> DataFrame operators (clean, profile, tests, split,
            features, text, reduce, balance, evaluate, models, importance)
plans/      composites: cohort report, cross-validated study, registered queries
streaming/  stateless streaming scorer
"""

from cohortkit.session import get_spark, checkpoint_dir  # noqa: F401
from cohortkit.spec import CohortSpec  # noqa: F401

__version__ = "0.1.0"

# Ship this package's functions to Python workers by value, so Arrow UDFs work
# without installing the package on every executor.
try:  # pragma: no cover - depends on the bundled cloudpickle
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
