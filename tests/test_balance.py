import numpy as np
from pyspark.sql import functions as F

from cohortkit.operators import balance as BA
from cohortkit.operators import neighbours as NB


def _points(spark, n=60, d=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (np.arange(n) < n // 4).astype(int)
    rows = [(int(i), x[i].tolist(), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>, y int"), x, y


def test_knn_matches_brute_force(spark):
    df, x, _ = _points(spark)
    got = {(r.id, r.nn_rank): r.nn_id for r in BA.knn(df, "id", "v", 3, block_rows=16).collect()}
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i]))[:3]
        assert [got[(i, k + 1)] for k in range(3)] == order.tolist()


def test_knn_does_not_depend_on_blocks_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(90, 3)) * 8) / 8 + 1000.0  # many exact ties, far from the origin
    x[40:60] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, [float("nan"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = [sorted(map(tuple, BA.knn(df, "id", "v", 4, block_rows=b).collect())) for b in (8, 64, 4096, None)]
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 90 * 4
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert {(r[0], r[3]): r[1] for r in found[0]} == {
        (i, k + 1): j for i in range(90) for k, j in enumerate(np.lexsort((np.arange(90), d[i]))[:4])}


def test_cells_prune_clustered_vectors_and_lose_no_neighbour(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16)) * 10
    x = np.vstack([centres[i % 20] + rng.normal(size=16) for i in range(1500)])
    x[700:760] = x[3]  # copies of one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): j for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:3])}
    for cell_rows, block_rows in ((30, 50), (2, None), (10_000, 400)):
        got = BA.knn(df, "id", "v", 3, cell_rows=cell_rows, block_rows=block_rows).collect()
        assert {(r.id, r.nn_rank): r.nn_id for r in got} == want
    assert NB.knn_work(df, "id", "v", 3, cell_rows=30).first()["share"] < 0.3
    # queries apart from the references, also with fewer references than k
    few = BA.knn(df.filter("id < 40"), "id", "v", 3, reference=df.filter("id in (1, 50)"), cell_rows=1).collect()
    assert len(few) == 39 * 2 + 1 and BA.knn(df.limit(0), "id", "v", 3).count() == 0


def test_smote_levels_classes_and_interpolates(spark):
    df, x, y = _points(spark)
    syn = BA.smote_oversample(df, "id", "v", "y", minority=1, k=5).collect()
    assert len(syn) == int((y == 0).sum() - (y == 1).sum())
    for r in syn[:10]:
        a, b = x[r.base_id], x[r.nn_id]
        assert np.allclose(np.array(r.v), a + r.u * (b - a))
        assert y[r.nn_id] == 1 and 0 <= r.u < 1


def test_tomek_links_hand_points(spark):
    rows = [(0, [0.0], 0), (1, [0.1], 1), (2, [5.0], 0), (3, [5.05], 0), (4, [9.0], 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    links = [(r.a_id, r.b_id) for r in BA.tomek_links(df, "id", "v", "y").collect()]
    assert links == [(0, 1)]
    kept = {r.id for r in BA.remove_tomek_links(df, "id", "v", "y").collect()}
    assert kept == {2, 3, 4}


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    w = {r.y: r.weight for r in BA.class_weight_balanced(df, "y").collect()}
    assert w == {1: 2.0, 0: 4 / 6}


def test_a_row_visits_blocks_and_not_each_cell(spark):
    """Many small cells and no structure: k candidates a row and block, however many cells are visited."""
    df, x, _ = _points(spark, n=600, d=24, seed=5)
    parts = NB.knn_parts(df, "id", "v", 3, cell_rows=4)
    assert parts.count() <= 600 * 3 * 3  # three blocks of 256 rows at most
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): j for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[:3])}
    assert {(r.id, r.nn_rank): r.nn_id for r in BA.knn(df, "id", "v", 3, cell_rows=4).collect()} == want


def test_knn_work_counts_pairs_beyond_an_integer(spark):
    df = spark.range(46_400).select("id", F.array(F.col("id").cast("double")).alias("v"))
    r = NB.knn_work(df, "id", "v", 1, cell_rows=500).first()
    assert (r["rows"], r["pairs_all"]) == (46_400, 46_400**2) and 0 < r["pairs_compared"] < r["pairs_all"]
    assert r["share"] == r["pairs_compared"] / r["pairs_all"]


def _ranked(parts, k):
    best = {}
    for r in parts.collect():
        best.setdefault(r["id"], set()).add((r["dist"], r["nn_id"]))
    return {i: sorted(x, key=lambda y: (y[0], y[1] is not None, y[1]))[:k] for i, x in best.items()}


def test_blocks_of_vectors_without_structure_meet_once_for_both(spark):
    """Half of the full comparison, the blocks' own included, and the neighbours of the full comparison."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 24))
    x[500:520] = x[3]  # copies of one vector, in many blocks
    x[520:540] = x[:20] + 1e-9 * rng.normal(size=(20, 24))  # nearer than single precision tells
    n = len(x)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for shift, k in ((0.0, 1), (0.0, 4), (-1e4, 2)):
        v = x + shift
        df = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(v)], "id long, v array<double>")
        parts = NB.knn_parts(df, "id", "v", k, block_rows=50, cell_rows=20).cache()
        # every pair is counted, and once but for those of one block
        assert n * (n - 1) / 2 <= parts.agg(F.sum("work")).first()[0] < 0.6 * n * n
        got = _ranked(parts, k)
        dd = d if not shift else ((v[:, None, :] - v[None, :, :]) ** 2).sum(-1) + np.diag(np.full(n, np.inf))
        for i in range(n):
            assert [j for _, j in got[i]] == np.lexsort((np.arange(n), dd[i]))[:k].tolist()


def test_whole_blocks_give_what_visits_give_with_repeated_and_missing_ids(spark):
    rng = np.random.default_rng(13)
    x = np.round(rng.normal(size=(400, 3)), 1)  # many exact ties
    rows = [(i % 330, v.tolist()) for i, v in enumerate(x)]
    rows += rows[:30]  # with the same vector, too
    for more in ([], [(None, [0.5, 0.5, 0.5]), (None, [9.0, 9.0, 9.0])]):
        df = spark.createDataFrame(rows + more, "id long, v array<double>")
        some = {whole: _ranked(NB.knn_parts(df, "id", "v", 3, block_rows=40, cell_rows=20, whole=whole), 3)
                for whole in (0.0, np.inf)}
        assert some[0.0] == some[np.inf] and len(some[0.0]) == 330 + bool(more)


def test_whole_blocks_of_any_size_of_numbers(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(120, 5))
    for factor in (1e-30, 1e25):  # their squares do not fit single precision
        v = x * factor
        df = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(v)], "id long, v array<double>")
        got = _ranked(NB.knn_parts(df, "id", "v", 2, block_rows=20, cell_rows=10, whole=0.0), 2)
        d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(-1) + np.diag(np.full(len(v), np.inf))
        assert all([j for _, j in got[i]] == np.argsort(d[i])[:2].tolist() for i in range(len(v)))
