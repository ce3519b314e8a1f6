"""How the sources of a language differ from one another and from the language.

Terms are counted by sorting pointers. A shard is a slice of an Arrow batch; its
texts lie in one byte buffer, and every word start is a pointer into it. A
multikey quicksort orders the pointers by the words they point at: a large slice
is parted at a pivot of eight bytes into less, equal and greater, and only the
equal part moves on to the next eight bytes; a small one is ordered by its eight
bytes at once and its runs are refined. Documents are laid out by (lang, source)
and the sort is stable, so a run of equal words is a run of groups, and in it of
documents: run lengths are counts, changes of document are document frequencies.
Spark adds the shards' counts up, combining them ahead of the shuffle.

Each language keeps the V terms that at least `min_docs` of its documents hold. A
group with `count` occurrences of a term and N of all kept terms has the share
p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), zero counts included; q is the
other's share and f = floor((p - q)^2 / (p + q)). All of it is integer arithmetic
(decimals ahead of the division).

`pair` rows sum f over all kept terms for two sources of a language. Terms are
dealt into blocks by hash, and so are the sources of a language with more than
SOURCES of them; a task holds two blocks of sources against one block of terms,
and terms that neither holds are added by their number. `term` rows are the
`top` terms that a source has more often than its language.

Null texts, languages and sources count as empty. A source without kept terms
still pairs; a language without kept terms gives pairs of value 0 and no terms; a
language with one source gives no pairs. Equal values rank by the item's UTF-8
bytes. An empty table gives no rows. Repeated rows are documents of their own (no
id is read). Words have no length limit: runs that agree on 64 bytes are ordered
by the rest at once. Other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import sized, stage

#: Bytes of text in a shard; one longer text is a shard of its own.
SHARD = 16 * 2**20
#: Pointers of a slice that is ordered without a pivot.
LEAF = 1 << 16
#: Bytes after which the rest of a word is compared whole.
DEEP = 64
#: Terms and sources of a block of the pair table.
TERMS, SOURCES = 4096, 128

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x61:0x7B] = True
_IN_WORD[0x80:] = True
#: Masks that leave the first r of eight bytes.
_FIRST = np.array([(2**64 - 1) ^ (2 ** (64 - 8 * r) - 1) for r in range(9)], np.uint64)


def word_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in folded bytes; texts begin at offsets[:-1] and words do not cross them."""
    inside = _IN_WORD[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[offsets < len(data)]
    before[cuts] = False
    after[offsets[offsets > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def sort_pointers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by the words' bytes (equal words in their given order), and where runs begin."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(data) + 1,), (1,))

    def key(at: np.ndarray, depth: int) -> np.ndarray:
        begin = start[at] + depth
        left = np.clip(end[at] - begin, 0, 8)
        return eight[np.minimum(begin, len(data))].astype(np.uint64) & _FIRST[left]

    orders, heads = [], []
    todo = [(np.arange(len(start)), 0)]
    while todo:
        at, depth = todo.pop()
        if len(at) > LEAF and 0 <= depth < DEEP:
            now = key(at, depth)
            pivot = np.sort(now[:: len(at) // 255])[127]
            same = at[now == pivot]
            todo.append((at[now > pivot], depth))
            if int(pivot) & 0xFF:
                todo.append((same, depth + 8))
            else:  # the words end within these eight bytes
                todo.append((same, -1))
            todo.append((at[now < pivot], depth))
            continue
        if not len(at):
            continue
        head = np.zeros(len(at), bool)
        head[0] = True
        if depth >= 0:
            at, head = _refine(data, start, end, key, at, head, depth)
        orders.append(at)
        heads.append(head)
    if not orders:
        return np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate(orders), np.concatenate(heads)


def _refine(data, start, end, key, at, head, depth):
    """Order one slice by eight bytes at a time; runs that are single or whose words have ended are left alone."""
    open_ = np.arange(len(at))
    while len(open_) and depth < DEEP:
        run, mine = np.cumsum(head)[open_], at[open_]
        now = key(mine, depth)
        order = np.lexsort((now, run))
        at[open_], now, run = mine[order], now[order], run[order]
        new = np.ones(len(open_), bool)
        new[1:] = (now[1:] != now[:-1]) | (run[1:] != run[:-1])
        head[open_] = new
        last = np.append(new[1:], True)
        open_ = open_[((now & np.uint64(0xFF)) != 0) & ~(new & last)]
        depth += 8
    if len(open_):  # words that agree on DEEP bytes
        run = np.cumsum(head)[open_]
        for part in np.split(open_, np.flatnonzero(np.diff(run)) + 1):
            rest = [data[start[i] + depth:end[i]].tobytes() for i in at[part]]
            order = sorted(range(len(rest)), key=rest.__getitem__)
            at[part] = at[part][order]
            head[part] = [j == 0 or rest[order[j]] != rest[order[j - 1]] for j in range(len(order))]
    return at, head


def count_shard(lang: list[str], source: list[str], texts: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, df) of one shard; a row without term for every group, n its documents."""
    groups = sorted(set(zip(lang, source)))
    number = {g: i for i, g in enumerate(groups)}
    group = np.array([number[g] for g in zip(lang, source)], np.int64)
    by_group = np.argsort(group, kind="stable")
    texts = texts.cast(pa.large_binary()).take(pa.array(by_group))
    group = group[by_group]
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    data = _FOLD[data]

    start, end = word_pointers(data, offsets)
    order, head = sort_pointers(data, start, end)
    doc = (np.searchsorted(offsets, start, "right") - 1)[order]
    its = group[doc] if len(doc) else np.empty(0, np.int64)
    cell = head.copy()
    cell[1:] |= its[1:] != its[:-1]
    fresh = cell.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    cells, runs = np.flatnonzero(cell), np.flatnonzero(head)
    n = np.diff(np.append(cells, len(order)))
    df = np.add.reduceat(fresh.astype(np.int64), cells) if len(cells) else np.empty(0, np.int64)
    words = pa.array([data[s:e].tobytes() for s, e in zip(start[order[runs]], end[order[runs]])], pa.binary())
    term = words.take(pa.array((np.cumsum(head) - 1)[cells], pa.int64()))

    docs = np.bincount(group, minlength=len(groups))
    who = np.concatenate([np.arange(len(groups)), its[cells]])
    names = [pa.array([g[i] for g in groups], pa.string()).take(pa.array(who)) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(
        [*names, pa.concat_arrays([pa.nulls(len(groups), pa.binary()), term]),
         pa.array(np.concatenate([docs, n])), pa.array(np.concatenate([np.zeros(len(groups), np.int64), df]))],
        names=["lang", "source", "term", "n", "df"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(batch):
            upto = (size[begin - 1] if begin else 0) + SHARD
            stop = max(begin + 1, int(np.searchsorted(size, upto, "right")))
            part = batch.slice(begin, stop - begin)
            yield count_shard(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2))
            begin = stop


def _share(n: str, total: str, kept: str) -> F.Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)); null without kept terms."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0)))"
                  f" DIV CAST({total} + 2 * {kept} AS DECIMAL(20,0)) END")


def _pair_sums(block: pd.DataFrame) -> pd.DataFrame:
    """Sums of f over one block of terms for the sources of one tile, both directions."""
    lang, lo, hi = block["lang"].iloc[0], block["lo"].iloc[0], block["hi"].iloc[0]
    heads, cells = block[block["term"].isna()], block[block["term"].notna()]
    names, side = heads["source"].to_numpy(), heads["sb"].to_numpy()
    zero = heads["p"].to_numpy(np.int64)
    row = pd.Index(names).get_indexer(cells["source"])
    column, terms = pd.factorize(cells["term"])
    p = np.repeat(zero[:, None], len(terms), axis=1)
    p[row, column] = cells["p"].to_numpy(np.int64)
    unseen = int(heads["n_block"].iloc[0]) - len(terms)
    out = []
    for a in np.flatnonzero(side == lo):
        b = np.flatnonzero((side == hi) & ((np.arange(len(names)) > a) | (lo != hi)))
        value = ((p[a] - p[b]) ** 2 // (p[a] + p[b])).sum(axis=1)
        value += (zero[a] - zero[b]) ** 2 // (zero[a] + zero[b]) * unseen
        out += [(lang, x, y, v) for o, v in zip(names[b], value) for x, y in ((names[a], o), (o, names[a]))]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def audit_sources(docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang",
                  source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in
                          ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = plain.mapInArrow(_shards, "lang string, source string, term binary, n bigint, df bigint")
    counted = stage(counted.groupBy("lang", "source", F.col("term").cast("string").alias("term"))
                    .agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "term-counts")
    cells, groups = counted.filter("term IS NOT NULL"), counted.filter("term IS NULL").select("lang", "source")

    kept = cells.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df"))
    kept = stage(kept.filter(F.col("df") >= min_docs).select("lang", "term", "n_lang"), "kept-terms")
    langs = (groups.groupBy("lang").agg(F.count("*").alias("n_sources"))
             .join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("all_lang")), "lang", "left")
             .na.fill(0, ["v", "all_lang"])
             .withColumn("t_blocks", F.ceil(F.greatest(F.col("v"), F.lit(1)) / TERMS))
             .withColumn("s_blocks", F.ceil(F.col("n_sources") / SOURCES)))
    langs = sized(stage(langs, "languages"))  # one row a language
    mine = cells.select("lang", "source", "term", "n").join(kept, ["lang", "term"])
    mine = stage(mine, "kept-counts")
    totals = mine.groupBy("lang", "source").agg(F.sum("n").alias("all_source"))
    groups = (groups.join(langs, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["all_source"])
              .withColumn("sb", F.expr("pmod(xxhash64(source), s_blocks)")))
    groups = stage(groups, "source-totals")
    shares = (mine.join(groups, ["lang", "source"])
              .withColumn("p", _share("n", "all_source", "v"))
              .withColumn("q", _share("n_lang", "all_lang", "v"))
              .withColumn("tb", F.expr("pmod(xxhash64(term), t_blocks)")))
    f = F.expr("((p - q) * (p - q)) DIV (p + q)")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                           f.alias("value"))
             .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top))

    per_block = (kept.join(langs.select("lang", "t_blocks"), "lang")
                 .groupBy("lang", F.expr("pmod(xxhash64(term), t_blocks)").alias("tb")).agg(F.count("*").alias("n_block")))
    heads = (groups.withColumn("tb", F.explode(F.expr("sequence(0L, t_blocks - 1)")))
             .join(per_block, ["lang", "tb"], "left")
             .select("lang", "source", "sb", "s_blocks", "tb", F.lit(None).cast("string").alias("term"),
                     F.coalesce(_share("0L", "all_source", "v"), F.lit(1)).alias("p"),
                     F.coalesce("n_block", F.lit(0)).cast("bigint").alias("n_block")))
    tiles = (heads.unionByName(shares.select("lang", "source", "sb", "s_blocks", "tb", "term", "p",
                                             F.lit(None).cast("bigint").alias("n_block")))
             .withColumn("other", F.explode(F.expr("sequence(0L, s_blocks - 1)")))
             .select("lang", "source", "sb", "tb", "term", "p", "n_block",
                     F.least("sb", "other").alias("lo"), F.greatest("sb", "other").alias("hi")))
    pairs = (tiles.groupBy("lang", "tb", "lo", "hi")
             .applyInPandas(_pair_sums, "lang string, source string, item string, value bigint")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
             .withColumn("rank", F.row_number().over(best)))
    return pairs.unionByName(terms)
