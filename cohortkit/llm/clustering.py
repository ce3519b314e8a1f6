"""Centroid clustering of integer vectors by bit planes and popcounts.

Every component x becomes floor(scale * x); all are shifted by the smallest one,
which changes no distance and leaves non-negative numbers of B bits. Bit b of a
vector's 64 components is one uint64, its plane b. For planes V of a vector and
C of a centroid

    dot = sum over a, b of 2^(a+b) * popcount(V_a & C_b)

is exact, and so is |v|^2 - 2 dot + |c|^2. Vectors are packed once into a staged
table; a round is one scan that returns at most `k` partial sums a task, and only
k x 64 sums reach the driver.

Kept are vectors of exactly 64 components, none null, NaN or infinite; others
(also a null vector) give no row. Repeated ids are rows of their own; a null id
hashes like an empty one, and equal hashes are ordered by their components. With
fewer than k vectors there are as many centroids; no vectors give no rows. A
centroid that no vector is nearest to stays, and has no rows. A vector with a
component outside +-131072 (an integer beyond 2^27, where a squared distance can
leave a long) takes no part and is returned with nulls. `inertia` and
`cluster_inertia` are null where the sum leaves a long. Only the two named columns
are read, whatever the table's other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from cohortkit.llm.common import stage

DIMS = 64
#: Vectors whose planes are combined at a time, so that the intermediate arrays stay in the cache.
CHUNK = 4096
#: Largest absolute integer for which every squared distance fits in a long.
LARGEST = 2**27


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Rows of a binary column that all hold `width` numbers."""
    n = len(column)
    if not n:
        return np.empty((0, width), dtype)
    size = width * np.dtype(dtype).itemsize
    begin = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)[0]
    return np.frombuffer(column.buffers()[2], np.uint8, n * size, begin).view(dtype).reshape(n, width)


def pack_planes(u: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits) uint64: plane b holds bit b of the 64 non-negative components of each row."""
    out = np.empty((len(u), bits), np.uint64)
    for b in range(bits):
        row = np.packbits(((u >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b] = np.ascontiguousarray(row).view("<u8")[:, 0]
    return out


def plane_dots(planes: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact dot products of packed rows with one packed centroid."""
    bits = len(centre)
    by_weight = np.zeros((2 * bits - 1, len(planes)), np.uint16)  # at most bits * 64 each
    for a in range(bits):
        plane = np.ascontiguousarray(planes[:, a])
        for b in np.flatnonzero(centre):
            by_weight[a + b] += np.bitwise_count(plane & centre[b])
    dots = np.zeros(len(planes), np.int64)
    for weight, count in enumerate(by_weight):
        dots += count.astype(np.int64) << weight
    return dots


def nearest(planes: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest packed centroid (ties: the smaller) and the squared distance."""
    cluster, distance = np.empty(len(planes), np.int32), np.empty(len(planes), np.int64)
    centre_norms = [plane_dots(c[None, :], c)[0] for c in centres]
    for i in range(0, len(planes), CHUNK):
        part = slice(i, i + CHUNK)
        table = np.stack([norms[part] + n - 2 * plane_dots(planes[part], c) for c, n in zip(centres, centre_norms)])
        cluster[part] = table.argmin(axis=0)
        distance[part] = table.min(axis=0)
    return cluster, distance


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3",
                    id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) and the final centroids."""
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    whole = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = whole.filter((F.coalesce(F.size("x"), F.lit(-1)) == DIMS) & finite)
    in_range = F.forall("x", lambda v: F.abs(v) <= LARGEST / scale)
    kept = whole.filter(in_range).select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("v"))

    low, high = kept.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    none = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint",
            "centroid_sha256": "string"}
    apart = whole.filter(~in_range).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    if low is None:
        return apart, []
    bits = max(1, int(high - low).bit_length())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMS)
            planes = pack_planes(v - low, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in planes], pa.binary()),
                 pa.array([r.tobytes() for r in v.astype(np.int32)], pa.binary())], names=["vec_id", "planes", "v"])

    packed_type = StructType().add("vec_id", id_type).add("planes", BinaryType()).add("v", BinaryType())
    packed = stage(kept.mapInArrow(pack, packed_type), "planes")

    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centres = [list(r["v"]) for r in kept.orderBy(key, "v").limit(k).collect()]

    def assigned(batch: pa.RecordBatch, packed_centres: np.ndarray):
        planes = _matrix(batch.column("planes"), np.uint64, bits)
        v = _matrix(batch.column("v"), np.int32, DIMS).astype(np.int64)
        return v, *nearest(planes, ((v - low) ** 2).sum(axis=1), packed_centres)

    for _ in range(rounds):
        now = pack_planes(np.array(centres, np.int64) - low, bits)

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(now), DIMS), np.int64), np.zeros(len(now), np.int64)
            for batch in batches:
                v, cluster, _ = assigned(batch, now)
                for c in np.unique(cluster):
                    mine = cluster == c
                    total[c] += v[mine].sum(axis=0)
                    count[c] += mine.sum()
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen, pa.int32()), pa.array(count[seen], pa.int64()),
                 pa.array(list(total[seen]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

        parts = packed.mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
        rows = (parts.select("cluster", "n", F.posexplode("total").alias("at", "value"))
                .groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"),
                                              F.sum("n").alias("n")).collect())
        for r in rows:
            centres[r["cluster"]][r["at"]] = int(r["value"]) // r["n"]

    final = pack_planes(np.array(centres, np.int64) - low, bits)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = assigned(batch, final)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)],
                                             names=["vec_id", "cluster", "distance"])

    out_type = StructType().add("vec_id", id_type).add("cluster", IntegerType()).add("distance", LongType())
    found = stage(packed.mapInArrow(assign, out_type), "clusters")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def as_long(number: int) -> int | None:
        return number if number < 2**63 else None

    totals = spark.createDataFrame(
        [(c, as_long(s), as_long(sum(inertia.values())),
          hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for c, s in inertia.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(totals), "cluster").select(*apart.columns).unionByName(apart), centres
