import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortkit.operators import reduce as RD
from cohortkit.operators import text as TX


def test_hashing_encoder_whole_text_and_null(spark):
    long_text = " ".join(f"w{i}" for i in range(500))  # far beyond 128 tokens: all are used
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, long_text)], "id int, t string")
    out = TX.embed_text(df, "t", "v", width=1024)
    rows = {r.id: r.v.toArray() for r in out.select("id", "v").collect()}
    assert all(len(v) == 1024 for v in rows.values())
    assert not rows[1].any() and not rows[2].any()
    assert np.count_nonzero(rows[4]) > 128


def test_batch_encoder_plugin(spark):
    def load():
        def enc(texts):
            return np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)
        return enc
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "id int, t string").repartition(2)
    out = {r.id: list(r.v) for r in TX.embed_with_batch_encoder(df, "t", "v", load, 2).collect()}
    assert out[1] == [5.0, 2.0] and out[2] == [0.0, 0.0]


def test_pca_shapes_centering_and_sign(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 5.0
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(200)], "id int, a array<double>") \
        .withColumn("v", array_to_vector("a"))
    model, var = RD.fit_pca(df, "v", "p", 3)
    out = np.array([r.p for r in model.transform(df).select(vector_to_array("p").alias("p")).collect()])
    assert out.shape == (200, 3) and np.allclose(out.mean(axis=0), 0.0, atol=1e-9)  # centred
    ev = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert abs(var - ev[:3].sum() / ev.sum()) < 1e-9
    pc = model.stages[1].pc.toArray() * np.array(model.stages[2].getScalingVec().toArray())
    assert all(pc[np.argmax(np.abs(pc[:, j])), j] > 0 for j in range(3))  # sign rule

