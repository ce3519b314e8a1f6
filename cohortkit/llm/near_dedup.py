"""MinHash near-duplicates with sequential Bayesian verification.

1. Signatures: each text's set of k-word shingles (64-bit hashes) gives
   `n_hashes` MinHash values. Texts with the same set fall into one class,
   kept by its smallest id, so exact copies never meet in a bucket.
2. Banding: `rows` values of a signature make a band; classes that share a band
   are candidates. With 32 bands of 5, a pair at similarity 0.8 is missed with
   probability (1 - 0.8^5)^32, about 3 in a million, and less above.
3. Leaders: in every bucket each member is compared with the smallest member
   only, which is linear in the bucket. Links found are joined into components.
4. Rest: where a bucket still holds several components, its members are dealt
   into blocks and the block pairs are compared in tasks of bounded size; pairs
   inside one component need no comparison, since they change no component.
   Nothing is capped, and no pair is written out before it is confirmed.
5. Verification of a candidate compares the signatures batch by batch and drops
   the pair once the posterior probability (uniform prior) that its similarity
   reaches the threshold falls below `miss`. Survivors are checked exactly on
   their full shingle sets.
6. Components: large-star / small-star rounds over the links.

Words are runs without white space, A-Z lower-cased. A text with fewer than k
words is one shingle. Null, empty or blank texts have no shingles, are linked
with nothing and are their own component. Rows that repeat an id are merged
with the texts they equal; an id keeps one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import sized, stage

N_HASHES, ROWS = 160, 5
BATCH = 32
#: Members, and shingles in all, of one block of a bucket; a task compares two blocks at a time.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles, sorted."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.full(n, np.uint64(min(k, len(words))))
    for i in range(min(k, len(words))):
        out = (out ^ h[i:i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _permutations(n_hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return (rng.integers(1, 2**63, n_hashes, np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2**63, n_hashes, np.uint64))


def _signature(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values (upper 32 bits of multiply-add), over pieces of bounded size."""
    best = np.full(len(a), np.uint64(2**64 - 1))
    for i in range(0, len(h), 2048):
        best = np.minimum(best, (h[None, i:i + 2048] * a[:, None] + b[:, None]).min(axis=1))
    return (best >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, k: int, n_hashes: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, set_hash, bands, sig): sig holds 16 bits of each value, bands a hash of each band."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(n_hashes)
        for batch in batches:
            out = []
            for text in batch.column(1):
                h = _shingles(text.as_py(), k)
                if not len(h):
                    out.append((0, None, None, None))
                    continue
                sig = _signature(h, a, b)
                bands = [xxhash.xxh3_64_intdigest(sig[i:i + rows].tobytes(), seed=i) for i in range(0, n_hashes, rows)]
                out.append((len(h), xxhash.xxh3_128_digest(h.tobytes()), np.array(bands, np.uint64).view(np.int64),
                            (sig & np.uint32(0xFFFF)).astype(np.uint16).tobytes()))
            n, s, bands, sig = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["id", "n_shingles", "set_hash", "bands", "sig"])

    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType
    schema = (StructType().add("id", id_type).add("n_shingles", LongType()).add("set_hash", BinaryType())
              .add("bands", ArrayType(LongType())).add("sig", BinaryType()))
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def least_matches(n_hashes: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """For each batch end n, the fewest matches m with P(similarity >= threshold | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail at
    the threshold is a binomial sum.
    """
    out = []
    for n in range(BATCH, n_hashes + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _alive(x: np.ndarray, y: np.ndarray, needs: list[tuple[int, int]]) -> np.ndarray:
    """Rows of x and y (uint16 signatures) that survive every batch."""
    left = np.arange(len(x))
    matches = np.zeros(len(x), np.int64)
    begin = 0
    for n, need in needs:
        matches += (x[left, begin:n] == y[left, begin:n]).sum(axis=1)
        keep = matches >= need
        left, matches, begin = left[keep], matches[keep], n
    return left


def _survivors(pairs: DataFrame, needs: list[tuple[int, int]]) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) whose signatures pass; returns (a, b)."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                       for c in (2, 3)]
                yield batch.take(pa.array(_alive(*sig, needs))).select([0, 1])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, pairs.select("a", "b").schema)


def _settle_tile(pdf, needs: list[tuple[int, int]], percent: int):
    """Links between the components of one tile (one block of a bucket, or two).

    A pair is looked at in the first band it shares, only while its components
    are apart, and is confirmed here on its full sets; so a tile returns fewer
    links than it has components.
    """
    import pandas as pd
    n = len(pdf)
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(n, -1)
    bands = np.stack(pdf["bands"].to_numpy())[:, :int(pdf["band"].iloc[0])]
    sets = pdf["set"].to_numpy()
    sizes = np.array([len(x) for x in sets])
    ids, comp = pdf["id"].to_numpy(), pdf["comp"].to_numpy().copy()
    side, lo, hi = pdf["block"].to_numpy(), pdf["lo"].iloc[0], pdf["hi"].iloc[0]
    left = np.arange(n) if lo == hi else np.flatnonzero(side == lo)
    right = left if lo == hi else np.flatnonzero(side == hi)
    found = []
    for i in left:
        j = right[right > i] if lo == hi else right
        j = j[(comp[j] != comp[i])
              & (100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i]))]
        j = j[~(bands[j] == bands[i]).any(axis=1)]
        j = j[_alive(np.broadcast_to(sig[i], (len(j), sig.shape[1])), sig[j], needs)]
        for m in j:
            if comp[m] != comp[i]:
                shared = len(np.intersect1d(sets[i], sets[m], assume_unique=True))
                if 100 * shared >= percent * (sizes[i] + sizes[m] - shared):
                    found.append((min(ids[i], ids[m]), max(ids[i], ids[m])))
                    comp[comp == comp[m]] = comp[i]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _sets(ids: DataFrame, docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set) of the given ids, staged."""
    ids = stage(ids.distinct(), "near-ids")

    def run(batches):
        for batch in batches:
            sets = [_shingles(t.as_py(), k).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).join(sized(ids), "id", "left_semi")
    return stage(texts.mapInArrow(run, "id long, set array<long>").dropDuplicates(["id"]), "near-sets")


def _confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 |a and b| >= percent |a or b|."""
    pairs = stage(pairs.distinct(), "near-pairs")
    sets = _sets(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), docs, k, id_col, text_col)
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in links (a, b).

    Large-star and small-star rounds until the links are stars. Every round is
    a grouped minimum and a join on the node, written to the shared folder.
    """
    def star(edges: DataFrame, small: bool) -> DataFrame:
        rows = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rows = rows.select(F.col("a").alias("u"), F.col("b").alias("v"))  # small: u > v
        least = rows.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        least = sized(stage(least, "star-least"))
        hung = rows.join(least, "u")
        if small:
            hung = hung.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                least.filter("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
        else:
            hung = hung.filter("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return stage(hung.distinct(), "star")

    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges = stage(edges, "star")
    mark = None
    while True:
        edges = star(star(edges, False), True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return (edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .union(edges.select(F.col("b"), F.col("b"))).distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, n_hashes: int = N_HASHES,
                    rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept. Ids are integers; null ids stay alone."""
    needs = least_matches(n_hashes, percent / 100, miss)
    sig = stage(signatures(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), k, n_hashes, rows,
                           id_col, text_col), "near-signatures")
    usable = sig.filter("n_shingles > 0 and id is not null")
    classes = usable.groupBy("set_hash").agg(F.min("id").alias("rep"), F.count("*").alias("members"))
    copies = sized(stage(classes.filter("members > 1").select("set_hash", "rep"), "near-copies"))
    # class representatives: rows alone in their set, and the smallest of the others
    rep = usable.join(copies, "set_hash", "left").withColumn("rep", F.coalesce("rep", "id"))
    first = rep.filter("id = rep")
    slim = first.select("id", "sig")

    members = first.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
    buckets = stage(buckets.filter("leader != last").select("band", "key", "leader"), "near-buckets")
    shared = stage(members.join(sized(buckets), ["band", "key"]), "near-members")
    led = shared.filter("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    sig_of = lambda c: slim.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    pairs = led.join(sig_of("b"), "b").join(sig_of("a"), "a")
    links = _confirm(_survivors(pairs, needs), docs, k, percent, id_col, text_col)
    links = stage(links, "near-links")
    comp = sized(stage(components(links), "near-comp"))

    # buckets that still hold several components; of buckets with the same members, the one of the first band
    placed = stage(shared.join(comp, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("comp")),
                   "near-placed")
    mixed = (placed.groupBy("band", "key")
             .agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("n"),
                  F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"), F.bit_xor(F.hash("id")).alias("mark2"))
             .filter("least != most and n > 2")  # a bucket of two was settled by its leader
             .groupBy("mark", "mark2", "n").agg(F.min(F.struct("band", "key")).alias("of")).select("of.*"))
    mixed = sized(stage(mixed, "near-mixed"))
    rest = stage(placed.join(mixed, ["band", "key"]), "near-rest")
    facts = stage(rest.select("id").distinct().join(first.select("id", "sig", "bands", "n_shingles"), "id"), "near-facts")
    weight = (rest.join(facts.select("id", "n_shingles"), "id").groupBy("band", "key")
              .agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
                   .cast("int").alias("blocks")))
    weight = sized(stage(weight, "near-blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = (rest.join(weight, ["band", "key"])
             .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .select("band", "key", "id", "comp", "block", other)
             .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other"))
    sets = _sets(rest.select("id"), docs, k, id_col, text_col)
    tiles = tiles.join(facts.drop("n_shingles").join(sets, "id"), "id")
    more = stage(tiles.groupBy("band", "key", "lo", "hi").applyInPandas(
        lambda pdf: _settle_tile(pdf, needs, percent), "a long, b long").distinct(), "near-more")

    merged = links.union(more)
    final = components(merged).select(F.col("id").alias("rep"), "component")
    final = sized(stage(final, "near-final"))
    placed = rep.select("id", "rep").distinct().join(final, "rep", "left").select(
        F.col("id").alias("_member"), F.coalesce("component", "rep").alias("_component"))
    out = sig.join(placed, sig["id"] == placed["_member"], "left")
    component = F.coalesce("_component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      component.eqNullSafe(F.col("id")).alias("kept"))
