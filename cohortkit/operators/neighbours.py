"""Exact k nearest neighbours without all pairs: pivot cells and the triangle inequality.

Reference rows belong to the cell of their nearest pivot (rows drawn by a hash;
about ``cell_rows`` rows a cell). Neighbouring cells are packed into blocks of
bounded bytes, a large cell is cut into several. Then

1. a row is compared in the block of its own cell, which gives it k candidates and
   the distance t of the k-th;
2. it visits another block only if a cell in there can hold a row within t: its distance
   to the cell's pivot lies within t of the cell's range of pivot distances, and its
   distance to the plane between its own pivot and that pivot is at most t. In the
   block, rows of one cell are compared only with rows that pass the same bounds.
   Where the rows would make half of all visits or more, as where vectors have no structure, blocks
   meet whole instead, and a distance serves both of its rows.

Both bounds are exact, so the result is that of a full comparison. What travels is a
row once a block it visits, never once a cell; only k candidates a row and block leave a
task. In a task a matrix product finds the rows that can be among the k nearest;
only their distances are computed term by term, so results do not depend on cells
or blocks. Where blocks meet whole, the product is one of single precision, less all that
rounding can add.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.session import checkpoint_dir

#: Rows of a cell, pivots at most, bytes of a block of vectors (and of the pivots), numbers held at a time while distances
#: are computed.
CELL_ROWS, MAX_PIVOTS, BLOCK_BYTES, CHUNK = 4096, 4096, 16_000_000, 2_000_000
#: Queries that are compared together at most, and blocks that the rows are dealt to at least.
QUERIES, BLOCKS = 256, 16
#: Where blocks meet whole: share of all visits from which on they do, bytes of the vectors of a stripe of blocks at most,
#: stripes that the blocks are dealt to at least if there are as many, rows of the two sides of a tile, candidates held.
WHOLE, STRIPE_BYTES, STRIPES, TILE, HELD = 0.5, 64_000_000, 12, (512, 2048), 2_000_000


def as_double_array(df: DataFrame, vec_col: str) -> DataFrame:
    dt = df.schema[vec_col].dataType
    if dt.typeName() == "vector":
        from pyspark.ml.functions import vector_to_array
        return df.withColumn(vec_col, vector_to_array(F.col(vec_col)))
    return df.withColumn(vec_col, F.col(vec_col).cast("array<double>"))


def _pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    centre = pivots.mean(axis=0)
    v, pivots = v - centre, pivots - centre
    square = (v**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (v @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def _stack(col: pd.Series, width: int) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, width))


def _pieces(rows: int, width: int) -> Iterator[slice]:
    """Slices of the rows that hold CHUNK numbers of that width at most."""
    step = max(1, CHUNK // max(1, width))
    return (slice(s, min(s + step, rows)) for s in range(0, rows, step))


def _near_first(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order that keeps neighbours together: halved again and again along the widest column."""
    if len(pivots) < 3:
        return pivots
    order = np.argsort(pivots[:, np.ptp(pivots, axis=0).argmax()], kind="stable")
    half = len(pivots) // 2
    return np.vstack([_near_first(pivots[order[:half]]), _near_first(pivots[order[half:]])])


def _packed(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first block of each cell, the number of blocks that it is cut into, and the number of blocks."""
    first, parts, block, held = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0, 0
    for c, n in enumerate(sizes):
        if held and held + n > block_rows:
            block, held = block + 1, 0
        first[c], parts[c] = block, max(1, math.ceil(n / block_rows))
        if parts[c] > 1:
            block, held = block + parts[c], 0
        else:
            held += n
    return first, parts, int((first + parts).max())


def _reaches(away: np.ndarray, home: np.ndarray, between: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(t with room for rounding, whether the plane towards a cell's pivot lies within it), queries x cells."""
    t = t[:, None] + 1e-7 * (t[:, None] + away + home[:, None] + 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.nan_to_num((away**2 - home[:, None] ** 2) / (2 * between), nan=0.0, posinf=0.0, neginf=0.0)
    return t, plane <= t


def best_of_block(qpdf: pd.DataFrame, rpdf: pd.DataFrame, k: int, exclude_self: bool, pivots: np.ndarray) -> pd.DataFrame:
    """The k nearest of one block for each query: id, nn_id, dist, and in a query's first row the rows compared.

    Queries: id, v, cell, away (pivot distance), within (rows further from that are of no use). References: id, v, cell, away.
    """
    none = pd.DataFrame({"id": pd.Series([], dtype="int64"), "nn_id": pd.Series([], dtype="int64"),
                         "dist": pd.Series([], dtype="float64"), "work": pd.Series([], dtype="int64")})
    if qpdf.empty or rpdf.empty:
        return none
    rpdf, qpdf = (x.sort_values(["cell", "away", "id"]) for x in (rpdf, qpdf))
    qv, rv = _stack(qpdf["v"], 0), _stack(rpdf["v"], 0)
    qid, rid = qpdf["id"].to_numpy(), rpdf["id"].to_numpy()
    home, within, r_away = qpdf["away"].to_numpy(), qpdf["within"].to_numpy(), rpdf["away"].to_numpy()
    cells, at, sizes = np.unique(rpdf["cell"].to_numpy(), return_inverse=True, return_counts=True)
    centre = pivots.mean(axis=0)
    # a product with the queries and 1 gives the squared distance less the query's own square
    flat = np.column_stack([-2 * (rv - centre), ((rv - centre) ** 2).sum(axis=1)])
    kk = k + (1 if exclude_self else 0)
    step = max(1, min(QUERIES, CHUNK // len(rid)))
    qc = qpdf["cell"].to_numpy()
    runs = [*np.flatnonzero(np.r_[True, qc[1:] != qc[:-1]]), len(qc)]
    out = []
    for s, e in ((s, min(s + step, b)) for a, b in zip(runs, runs[1:]) for s in range(a, b, step)):
        q = qv[s:e] - centre
        q2 = (q**2).sum(axis=1)
        q = np.column_stack([q, np.ones(e - s)])
        error = 1e-9 * (q2 + flat[:, -1].max())  # of the matrix product, and of pivot distances
        away = _pivot_distances(qv[s:e], pivots[cells])
        between = _pivot_distances(pivots[qc[s]][None, :], pivots[cells])
        own = np.isin(rid, qid[s:e]) if exclude_self else np.zeros(len(rid), bool)

        def products(rows: np.ndarray) -> np.ndarray:
            return q @ (flat if len(rows) == len(flat) else flat[rows]).T

        def kth(near: np.ndarray) -> np.ndarray:
            if near.shape[1] < kk:
                return np.full(e - s, np.inf)
            return np.partition(near, kk - 1, axis=1)[:, kk - 1]

        t = within[s:e]
        if np.isinf(t).any():  # a first bound, from the nearest cells that hold more than k rows
            order = np.argsort(away.min(axis=0), kind="stable")
            some = np.zeros(len(cells), bool)
            some[order[:np.searchsorted(np.cumsum(sizes[order]), kk) + 1]] = True
            t = np.minimum(t, np.sqrt(np.maximum(kth(products(np.flatnonzero(some[at]))) + q2 + error, 0.0)))
        reach, can = _reaches(away, home[s:e], between, t)
        low = np.where(can, away - reach, np.inf).min(axis=0)[at]
        high = np.where(can, away + reach, -np.inf).max(axis=0)[at]
        rows = np.flatnonzero((r_away >= low) & (r_away <= high))
        if not len(rows):
            continue
        near = products(rows)
        limit = t * t * (1 + 1e-9) - q2 + error
        hit = ~(near > limit[:, None])
        if np.count_nonzero(hit) > 8 * kk * (e - s):
            hit = ~(near > np.minimum(limit, kth(near) + 2 * error)[:, None])
        if exclude_self:
            here = np.flatnonzero(own[rows])
            hit[:, here] &= qid[s:e, None] != rid[rows[here]][None, :]
        qi, ri = np.nonzero(hit)
        if not len(qi):
            out.append(none)
            continue
        ri = rows[ri]
        d = np.concatenate([np.einsum("ij,ij->i", x, x) for x in (
            qv[s + qi[p]] - rv[ri[p]] for p in _pieces(len(qi), rv.shape[1]))])
        # order by (query, distance, neighbour id) and keep the first k of each query
        order = np.lexsort((rid[ri], d, qi))
        qi, ri, d = qi[order], ri[order], d[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = place < k
        out.append(pd.DataFrame({"id": qid[s + qi[keep]], "nn_id": rid[ri[keep]], "dist": d[keep],
                                 "work": np.where(place[keep] == 0, len(rows), 0)}))
    return pd.concat(out) if out else none


class _Block:
    """Rows of one block that meets others: what is nearest to them so far, and the bound that a nearer row keeps."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, within: np.ndarray, k: int):
        self.ids, self.v, self.k, self.bound = ids, v, k, within**2 * (1 + 1e-9)
        self.found = [(np.empty(0, int), np.empty(0, np.int64), np.empty(0))]
        self.held = 0

    def shape(self, centre: np.ndarray, scale: float) -> None:
        """Factors of the product: first @ second is at most the squared distance over scale**2, however it is rounded."""
        x = (self.v - centre) / scale
        square = (x**2).sum(axis=1)
        self.slack = 3 * (x.shape[1] + 6) * 2.0**-24 * square
        one = np.ones(len(x))
        self.first = np.column_stack([-2 * x, square - self.slack, one]).astype(np.float32)
        self.second = np.ascontiguousarray(np.column_stack([x, one, square - self.slack]).astype(np.float32).T)
        self.scale = scale
        self.blur = 1e-24 * x.shape[1] * (np.sqrt((centre**2).sum()) / scale + 1.0) ** 2  # by taking the centre off
        self.limit()

    def limit(self) -> None:
        with np.errstate(all="ignore"):
            top = self.bound / self.scale**2 * (1 + 1e-6) + self.blur
            self.top = np.nextafter(top.astype(np.float32), np.float32(np.inf))

    def add(self, rows: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        keep = d <= self.bound[rows]
        self.found.append((rows[keep], ids[keep], d[keep]))
        self.held += np.count_nonzero(keep)
        if self.held > HELD:
            self.best()

    def best(self) -> None:
        """Keeps the k nearest of each row (ties by id) and lowers the bounds."""
        rows, ids, d = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, d, rows))
        rows, ids, d = rows[order], ids[order], d[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        self.bound[rows[last]] = np.minimum(self.bound[rows[last]], d[last])
        self.limit()
        keep = place < self.k
        self.found, self.held = [(rows[keep], ids[keep], d[keep])], np.count_nonzero(keep) // 2


def _meet(a: _Block, b: _Block) -> int:
    """Compares each row of one block with each of the other, once for both; the number of pairs.

    A block may meet itself if no id comes twice in it.
    """
    k, apart = a.k + (a is b), a is b or not len(np.intersect1d(a.ids, b.ids))
    tile = np.empty(TILE, np.float32)
    for s in range(0, len(a.ids), TILE[0]):
        rows = slice(s, min(s + TILE[0], len(a.ids)))
        for u in range(0, len(b.ids), TILE[1]):
            cols = slice(u, min(u + TILE[1], len(b.ids)))
            near = tile[:rows.stop - s, :cols.stop - u]
            np.matmul(a.first[rows], b.second[:, cols], out=near)
            for own, other, x, y, grid in ((a, b, rows, cols, near), (b, a, cols, rows, near.T))[:1 if a is b else 2]:
                some = np.flatnonzero(~(grid.min(axis=1) > own.top[x]))  # what is not a number is looked at as well
                if not len(some):
                    continue
                if apart and grid.shape[1] >= k and np.isinf(own.bound[x.start + some]).any():
                    # no bound yet: the k-th of this tile, with all that rounding can take
                    kth = np.partition(grid[some], k - 1, axis=1)[:, k - 1].astype(float)
                    kth += 3 * (own.slack[x.start + some] + other.slack[y].max())
                    kth = (kth * (1 + 1e-6) + own.blur) * own.scale**2
                    own.bound[x.start + some] = np.fmin(own.bound[x.start + some], kth)
                    own.limit()
                i, j = np.nonzero(~(grid[some] > own.top[x.start + some][:, None]))
                i, j = x.start + some[i], y.start + j
                if a is b or not apart:
                    other_id = own.ids[i] != other.ids[j]
                    i, j = i[other_id], j[other_id]
                for p in _pieces(len(i), own.v.shape[1]):
                    z = own.v[i[p]] - other.v[j[p]]
                    own.add(i[p], other.ids[j[p]], np.einsum("ij,ij->i", z, z))
    a.best()
    b.best()
    return len(a.ids) * len(b.ids)


def best_of_stripes(pdf: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    """The k nearest in other blocks for each row: id, nn_id, dist, and in the first row the pairs compared.

    Packed pieces of one stripe or two: stripe, block, ids, v, within. Blocks of one stripe meet only where it comes alone.
    """
    blocks = {}
    for (stripe, block), x in pdf.groupby(["stripe", "block"]):
        ids, v, within = (np.concatenate([np.frombuffer(y, t) for y in x[c]])
                          for c, t in (("ids", np.int64), ("v", np.float64), ("within", np.float64)))
        order = np.argsort(ids, kind="stable")
        blocks[stripe, block] = _Block(ids[order], v.reshape(len(ids), width)[order], within[order], k)
    alone = pdf["stripe"].nunique() == 1
    met = [(a, b) for a in blocks for b in blocks if a[1] < b[1] and (alone or a[0] != b[0])]
    centre = sum(x.v.sum(axis=0) for x in blocks.values()) / sum(len(x.ids) for x in blocks.values())
    scale = max(np.sqrt(((x.v - centre) ** 2).sum(axis=1).max()) for x in blocks.values()) or 1.0
    for x in blocks.values():
        x.shape(centre, scale)
    return _kept(blocks.values(), sum(_meet(blocks[a], blocks[b]) for a, b in met))


def best_within(pdf: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    """The k nearest of each row (id, v) among the others of one block, in which no id comes twice: id, nn_id, dist, work."""
    pdf = pdf.sort_values("id")
    ids, v = pdf["id"].to_numpy(np.int64), _stack(pdf["v"], width)
    centre = v.mean(axis=0)
    scale = np.sqrt(((v - centre) ** 2).sum(axis=1).max()) or 1.0
    parts = [_Block(ids[s:s + TILE[1]], v[s:s + TILE[1]], np.full(len(ids[s:s + TILE[1]]), np.inf), k)
             for s in range(0, len(ids), TILE[1])]
    for x in parts:
        x.shape(centre, scale)
    work = sum(_meet(x, x) for x in parts) + sum(_meet(x, y) for x, y in itertools.combinations(parts, 2))
    return _kept(parts, work)


def _kept(blocks: Iterable[_Block], work: int) -> pd.DataFrame:
    out = pd.concat([pd.DataFrame({"id": x.ids[rows], "nn_id": ids, "dist": d, "work": 0})
                     for x in blocks for rows, ids, d in x.found])
    out["work"] = np.r_[work, np.zeros(len(out), int)][:len(out)]
    return out


def _stripes(sizes: np.ndarray, width: int) -> np.ndarray:
    """The stripe of each block: blocks that follow one another, of bounded bytes."""
    rows = min(max(1, STRIPE_BYTES // (8 * max(1, width))), math.ceil(sizes.sum() / STRIPES))
    first, parts, _ = _packed(sizes, rows)
    return np.unique(first + parts - 1, return_inverse=True)[1]


def met_whole(rows: DataFrame, sizes: np.ndarray, k: int, width: int, schema: str) -> DataFrame:
    """The k nearest of every row (id, v, within, rb) in the blocks other than its own, from each pair of blocks once."""
    spark = rows.sparkSession
    stripe = _stripes(sizes, width)
    last = int(stripe.max()) + 1
    met = [(a, b) for a in range(last) for b in range(a + 1, last)]
    met += [(a, a) for a in range(last) if np.count_nonzero(stripe == a) > 1]
    # one task a pair of stripes: keys that the hash deals to partitions of their own
    keys = {x["p"]: x["key"] for x in spark.range(1000 + 20 * len(met)).groupBy(
        F.pmod(F.hash("id"), F.lit(len(met))).alias("p")).agg(F.min("id").alias("key")).collect()}
    pairs = [(x, keys.get(p, -1 - p)) for p, ab in enumerate(met) for x in sorted(set(ab))]
    pairs = F.broadcast(spark.createDataFrame(pairs, "of int, task long"))  # bounded: pairs of stripes

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(int(stripe[b]), int(b), x["id"].to_numpy(np.int64).tobytes(), _stack(x["v"], width).tobytes(),
                      x["within"].to_numpy(np.float64).tobytes()) for b, x in pdf.groupby("rb")]
            yield pd.DataFrame(found, columns=["stripe", "block", "ids", "v", "within"])

    pieces = rows.select("id", "v", "within", "rb").mapInPandas(
        packed, "stripe int, block long, ids binary, v binary, within binary")
    dealt = pieces.join(pairs, pieces["stripe"] == pairs["of"]).drop("of").repartition(len(met), "task")
    return dealt.groupBy("task").applyInPandas(lambda pdf: best_of_stripes(pdf, k, width), schema).checkpoint()


def knn_parts(df: DataFrame, id_col: str, vec_col: str, k: int, reference: DataFrame | None = None,
              block_rows: int | None = None, exclude_self: bool = True, cell_rows: int = CELL_ROWS,
              whole: float = WHOLE) -> DataFrame:
    """Candidates (id, nn_id, dist, work) that hold the k nearest of every row; work: rows compared, once a row and block.

    From a share ``whole`` of all visits on, blocks of one table meet whole; work then has a task's pairs of rows.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)

    def plain(rows: DataFrame) -> DataFrame:
        v = as_double_array(rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "v")
        # others have no distance
        return v.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    r = plain(reference if reference is not None else df)
    n, n_ids, width = r.agg(F.count(F.lit(1)), F.count("id"), F.max(F.size("v"))).first()
    schema = "id long, nn_id long, dist double, work long"
    if not n:
        return spark.createDataFrame([], schema)
    once = reference is None and exclude_self and n_ids == n and width > 0 and whole < math.inf  # a pair serves both rows
    most = max(1, BLOCK_BYTES // (8 * max(1, width)))
    if not block_rows:
        block_rows = min(most, max(256, math.ceil(n / BLOCKS)))
    count = min(MAX_PIVOTS, most, max(1, math.ceil(n / cell_rows)))
    drawn = r.orderBy(F.md5(F.col("id").cast("string")), "id").limit(count).collect()
    pivots = _near_first(np.unique(np.array([x["v"] for x in drawn]), axis=0))

    @F.pandas_udf("cell int, away double")
    def home(col: pd.Series) -> pd.DataFrame:
        v = _stack(col, width)
        cell = np.concatenate([np.empty(0, int), *(_pivot_distances(v[p], pivots).argmin(axis=1)
                                                   for p in _pieces(len(v), len(pivots)))])
        return pd.DataFrame({"cell": cell, "away": np.sqrt(((v - pivots[cell]) ** 2).sum(axis=1))})

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("at", home("v")).select("id", "v", "at.cell", "at.away")

    r = placed(r).checkpoint()
    q = r if reference is None else placed(plain(df)).checkpoint()
    low, high, held, asked = (np.zeros(len(pivots)) for _ in range(4))
    for x in r.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).collect():
        low[x["cell"]], high[x["cell"]], held[x["cell"]] = x["lo"], x["hi"], x["n"]
    if reference is None:
        asked = held
    else:
        for x in q.groupBy("cell").count().collect():
            asked[x["cell"]] = x["count"]
    first, parts, n_blocks = _packed(held, block_rows)
    q_first, q_parts, _ = _packed(asked, block_rows)
    # one row per cell: a bounded broadcast
    cells = F.broadcast(spark.createDataFrame(
        [(c, *map(int, x)) for c, x in enumerate(zip(first, parts, q_first, q_parts))],
        "cell int, first long, parts long, q_first long, q_parts long"))

    def block(of: str, cut: str) -> Column:
        return F.col(of) + F.pmod(F.xxhash64("id"), F.col(cut))

    r = r.join(cells, "cell").select("id", "v", "cell", "away", block("first", "parts").alias("rb"))
    q = q.join(cells, "cell").select("id", "v", "cell", "away", block("q_first", "q_parts").alias("qb"),
                                     block("first", "parts").alias("rb"))

    def compared(visits: DataFrame) -> DataFrame:
        met = [tuple(x) for x in visits.select("qb", "rb").distinct().collect()]  # pairs of blocks
        # bounded broadcast; both sides may come from one table: columns of their own
        pairs = F.broadcast(spark.createDataFrame(met, "to_qb long, to_rb long"))
        left = visits.select(*[F.col(c).alias(c) for c in ("id", "v", "cell", "away", "within", "qb", "rb")])
        right = r.join(pairs, r["rb"] == pairs["to_rb"]).select(
            *[F.col(c).alias(c) for c in ("id", "v", "cell", "away")], F.col("to_qb").alias("qb"), F.col("to_rb").alias("rb"))
        return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(
            lambda a, b: best_of_block(a, b, k, exclude_self, pivots), schema)

    def own_block(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["id"].is_unique:
            return best_within(rows, k, width)
        rows = rows.assign(within=np.inf)
        return best_of_block(rows, rows, k, exclude_self, pivots)

    if once:
        near = r.groupBy("rb").applyInPandas(own_block, schema)
    else:
        near = compared(q.withColumn("within", F.lit(float("inf"))))
    if n_blocks == 1:
        return near
    near = near.checkpoint()
    kth = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("dist")), 1, k).alias("d"))  # k a row
    kth = kth.select("id", F.when(F.size("d") == k, F.sqrt(F.element_at("d", -1))).otherwise(float("inf")).alias("within"))
    inside = np.zeros((len(pivots), n_blocks), np.float32)
    for c in range(len(pivots)):
        inside[c, first[c]:first[c] + parts[c]] = 1

    @F.pandas_udf("array<long>")
    def others(col: pd.Series, cell: pd.Series, home: pd.Series, within: pd.Series, seen: pd.Series) -> pd.Series:
        v, out = _stack(col, width), []
        cell, home, within, seen = (x.to_numpy() for x in (cell, home, within, seen))
        for p in _pieces(len(v), len(pivots)):
            away = _pivot_distances(v[p], pivots)
            t, can = _reaches(away, home[p], _pivot_distances(pivots[cell[p]], pivots), within[p])
            can &= (held > 0) & (away - high <= t) & (low - away <= t)
            visit = can.astype(np.float32) @ inside > 0
            visit[np.arange(len(visit)), seen[p]] = False
            out += [np.flatnonzero(x).tolist() for x in visit]
        return pd.Series(out, dtype=object)

    rest = q.join(kth, "id", "left").withColumn("within", F.coalesce("within", F.lit(float("inf"))))
    rest = rest.withColumn("to", others("v", "cell", "away", "within", "rb")).checkpoint()
    if once:
        sizes, visits = np.zeros(n_blocks), 0
        for x in rest.groupBy("rb").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("to")).alias("to")).collect():
            sizes[x["rb"]], visits = x["n"], visits + x["to"]
        if visits >= whole * (n_blocks - 1) * sizes.sum():
            return near.unionByName(met_whole(rest, sizes, k, width, schema))
    rest = rest.drop("rb")
    return near.unionByName(compared(rest.withColumn("rb", F.explode("to"))))


def knn(df: DataFrame, id_col: str, vec_col: str, k: int, reference: DataFrame | None = None,
        block_rows: int | None = None, exclude_self: bool = True, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Exact k nearest neighbours (squared Euclidean) of every row of ``df`` among ``reference`` (default: ``df``).

    Schema: id, nn_id, dist, nn_rank (1..k; ties by neighbour id). Vectors that are null or hold a null, NaN or
    infinite number have no neighbours and are none.
    """
    parts = knn_parts(df, id_col, vec_col, k, reference, block_rows, exclude_self, cell_rows).drop("work")
    w = Window.partitionBy("id").orderBy("dist", "nn_id")  # at most k rows a visited block
    return parts.withColumn("nn_rank", F.row_number().over(w)).filter(F.col("nn_rank") <= k)


def knn_work(df: DataFrame, id_col: str, vec_col: str, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(rows, pairs_all, pairs_compared, share): how much of the full comparison the cells leave where no block meets whole."""
    n = df.count()
    done = knn_parts(df, id_col, vec_col, k, cell_rows=cell_rows, whole=math.inf)
    done = done.agg(F.coalesce(F.sum("work"), F.lit(0)).alias("pairs_compared"))
    many = F.lit(n).cast("long")  # the square of 46,341 rows does not fit an integer
    return done.select(F.lit(n).alias("rows"), (many * many).alias("pairs_all"), "pairs_compared",
                       F.try_divide(F.col("pairs_compared").cast("double"), F.lit(float(n) * n)).alias("share"))
