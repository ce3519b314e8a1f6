import os
import tempfile

from pyspark.sql import functions as F

from cohortkit.plans import study as ST
from cohortkit.streaming.scoring import scoring_stream, start_scoring
from conftest import SF001


def test_stream_scores_match_batch(spark):
    base = tempfile.mkdtemp(prefix="cohortkit-stream-")
    tab = ST.document_study_table(spark, SF001, k=3).cache()
    cfg = ST.StudyConfig(variant="base", feature_sets=["a-x"], models=["LR"], n_folds=3, text_width=32)
    feats, _, _ = ST.prepare_features(tab, cfg)
    feats = feats.select("row_id", "label", *ST.STRUCTURED, "split").cache()
    model = ST.fit_pipeline(feats.filter("split = 'train'"), "a-x", "LR", cfg)
    mpath = os.path.join(base, "model")
    model.write().overwrite().save(mpath)
    src = os.path.join(base, "in")
    feats.filter("split = 'test'").drop("split").write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = scoring_stream(spark, src, schema, mpath)
    q = start_scoring(stream, os.path.join(base, "out"), os.path.join(base, "ckpt"),
                      columns=["row_id", "score", "pred"], trigger_once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(base, "out"))
    want = ST.batch_score(spark, mpath, feats.filter("split = 'test'"))
    j = got.join(want.select("row_id", F.col("score").alias("s2")), "row_id")
    assert j.count() == want.count() and j.filter(F.abs(F.col("score") - F.col("s2")) > 1e-12).count() == 0
