"""Word passages that an earlier document already holds, by fixed-block anchors.

A window is `window` consecutive words. It goes if its word sequence also starts
in a document with a smaller id; every word that a going window covers is removed.

1. Index and probes. Every document's non-overlapping blocks of window / 2 words
   are the reference index; every rolling window of that length is a probe. Any
   full window holds a whole block, so equal windows always meet. Hashes of one
   slice (256 neighbouring rows of the table) are sorted, made distinct and sent
   as packed arrays to buckets by their leading bits; the rest of a hash takes 32
   bits, as a false meeting only costs a later check.
2. Match. In a bucket, a hash that is a block somewhere and stands in two
   documents is a hit, and its slices are told so. A passage that a third of all
   documents share is one entry a slice, whatever its number of copies.
3. Extension. Each slice marks its hits in the texts; only full windows around a
   hit can repeat. Their 96-bit fingerprints, distinct within the slice and with
   the slice's smallest id, go to buckets again, which tell a slice the ones that a
   smaller id outside it holds. Neighbouring going windows overlap, so together
   they cover exactly the maximal repeats of `window` words or more. A chance
   collision of fingerprints is below 10^-3 for 10^13 windows that reach step 3.

Slices are only addresses: buckets and slices hold a bounded share of the words,
and no pair of documents is ever written. A slice is named by file and row
number; a table that is not read from files is staged first. Words are runs
without ASCII white space, unchanged. Null and empty texts have no words. A row
without id keeps all its words and takes none from others; rows that share an id
are not smaller than one another and keep what only they repeat. Texts of any
length are read whole; a slice holds its documents in one task. Other columns of
the table are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import stage

#: Neighbouring rows of a slice, bytes of text hashed at a time, and bytes of text that a bucket's share comes from.
SLICE_ROWS, PIECE, BUCKET = 256, 4 * 2**20, 8 * 2**20
_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of some texts as two 64-bit hashes each, with rolling hashes of runs of words."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, bounds = split.flatten(), split.offsets.to_numpy()
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        upto = np.append(0, np.cumsum(real))
        self.bounds = upto[bounds - bounds[0]]
        self.sizes = np.diff(self.bounds)
        coded = flat.filter(pa.array(real)).dictionary_encode()
        raw = b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist())
        table = np.frombuffer(raw, "<u8").reshape(-1, 2)
        self.hashes = table[coded.indices.to_numpy()] if len(table) else np.empty((0, 2), np.uint64)
        self.place = np.arange(len(self.hashes)) - np.repeat(self.bounds[:-1], self.sizes)  # within its text

    def fits(self, length: int) -> np.ndarray:
        """Whether a run of that length starts at each word and ends within its text."""
        return self.place + length <= np.repeat(self.sizes, self.sizes)

    def rolling(self, length: int, which: int) -> np.ndarray:
        """Hash of the run that starts at each word (of no meaning where it does not fit)."""
        n = len(self.hashes)
        if n < length:
            return np.zeros(n, np.uint64)
        step = _STEP[which]
        power = np.cumprod(np.append(np.uint64(1), np.full(n - 1, step)), dtype=np.uint64)
        back = np.cumprod(np.append(np.uint64(1), np.full(n - 1, np.uint64(pow(int(step), -1, 2**64)))), dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(self.hashes[:, which] * power, dtype=np.uint64))
        out = np.zeros(n, np.uint64)
        out[:n - length + 1] = (sums[length:] - sums[:n - length + 1]) * back[:n - length + 1]
        return _mixed(out)


def _pieces(table: pa.Table | pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about PIECE bytes of text; a longer text is a run of its own."""
    batches = table.combine_chunks().to_batches() if isinstance(table, pa.Table) else [table]
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(batch):
            upto = (size[begin - 1] if begin else 0) + PIECE
            stop = max(begin + 1, int(np.searchsorted(size, upto, "right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One binary value for the numbers between each two cuts."""
    data = np.ascontiguousarray(values)
    offsets = (cuts * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()),
                                                              pa.py_buffer(data.tobytes())])


def _unpacked(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column and the row of each."""
    blobs = [np.frombuffer(b.as_buffer(), dtype) for b in column]
    sizes = [len(b) for b in blobs]
    return (np.concatenate(blobs) if blobs else np.empty(0, dtype)), np.repeat(np.arange(len(blobs)), sizes)


def _cuts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of sorted bucket numbers begin (and the end), and their numbers."""
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    return np.append(begin, len(bucket)), bucket[begin]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(slice, doc_id, text): slice names SLICE_ROWS neighbouring rows of a file, the same in every read."""
    def cut(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / SLICE_ROWS))
        return df.select(place.alias("slice"), F.col(id_col).cast("bigint").alias("doc_id"),
                         F.col(text_col).cast("string").alias("text"))

    try:
        return cut(docs, id_col, text_col)
    except AnalysisException:  # not a file scan
        plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return cut(stage(plain, "texts"), "doc_id", "text")


def remove_repeats(docs: DataFrame, window: int = 50, output: str = "text", id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text): removed spans in words, end exclusive; kept words joined by a space.

    With output='sha256' the last column is kept_sha256, the hash of that text, and no text is written.
    """
    block = window // 2
    docs = _located(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, int(-(-size // BUCKET) - 1).bit_length())

    def short_hash(words: Words) -> np.ndarray:
        return words.rolling(block, 0) >> np.uint64(32 - bits)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = batch.column("slice").to_numpy(zero_copy_only=False)
            edges = np.append(_heads(home), len(home))
            for a, b in zip(edges[:-1], edges[1:]):
                for piece in _pieces(batch.slice(a, b - a), "text"):
                    words = Words(piece.column("text"))
                    use = words.fits(block) & np.repeat(words.sizes >= window, words.sizes)
                    whole = (words.place % block == 0).astype(np.uint64)
                    entry = np.sort((short_hash(words)[use] << np.uint64(1)) | whole[use])
                    at = _heads(entry >> np.uint64(1))
                    if not len(at):
                        continue
                    last = np.append(at[1:], len(entry)) - 1
                    flags = ((entry[last] & np.uint64(1)) | ((last > at).astype(np.uint64) << np.uint64(1))).astype(np.uint8)
                    h = entry[at] >> np.uint64(1)
                    cuts, bucket = _cuts((h >> np.uint64(32)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(bucket), home[a])), pa.array(bucket), _packed(h.astype(np.uint32), cuts),
                         _packed(flags, cuts)], names=["slice", "bucket", "h", "flags"])

    def match(table: pa.Table) -> pa.Table:
        h, row = _unpacked(table.column("h"), np.uint32)
        flags, _ = _unpacked(table.column("flags"), np.uint8)
        order = np.argsort(h, kind="stable")
        at = _heads(h[order])
        flag = np.bitwise_or.reduceat(flags[order], at)
        entries = np.diff(np.append(at, len(h)))
        hit = ((flag & 1) == 1) & ((entries > 1) | (flag >= 2))
        chosen = np.sort(order[np.repeat(hit, entries)])  # again by row, and by hash within it
        cuts, rows = _cuts(row[chosen])
        return pa.table({"slice": table.column("slice").take(pa.array(rows)),
                         "bucket": table.column("bucket").take(pa.array(rows)), "h": _packed(h[chosen], cuts)})

    packed = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(
        probes, "slice bigint, bucket int, h binary, flags binary")
    hits = packed.groupBy("bucket").applyInArrow(match, "slice bigint, bucket int, h binary")

    def finished(doc_id, raw: list[bytes], gone: np.ndarray | None) -> tuple:
        spans = []
        if gone is not None and gone.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
            left = b" ".join(w for w, g in zip(raw, gone.tolist()) if not g)
        else:
            left = b" ".join(raw)
        kept = hashlib.sha256(left).hexdigest() if output == "sha256" else left.decode("utf-8", "replace")
        return doc_id, len(raw), sum(s["end"] - s["start"] for s in spans), spans, kept

    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    done_type = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span_type),
                 ("kept", pa.string())]
    step_type = pa.schema([*done_type, ("slice", pa.int64()), ("text", pa.string()), ("starts", pa.binary()),
                           ("bucket", pa.int32()), ("lo", pa.binary()), ("hi", pa.binary()), ("least", pa.binary())])
    done_sql = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        short, row = _unpacked(right.column("h"), np.uint32)
        prefix = right.column("bucket").to_numpy().astype(np.uint64)
        known = np.unique((prefix[row] << np.uint64(32)) | short)
        out, found = [], []
        for piece in _pieces(left, "text"):
            words = Words(piece.column("text"))
            h = short_hash(words)
            near = np.zeros(len(h), bool)
            if len(known) and len(h):
                near = (known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) & words.fits(block)
            upto = np.append(0, np.cumsum(near))
            fit = np.flatnonzero(words.fits(window))
            starts = fit[upto[fit + window - block + 1] > upto[fit]]
            ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist()
            lo, hi = words.rolling(window, 0)[starts], (words.rolling(window, 1)[starts] >> np.uint64(32)).astype(np.uint32)
            owner = np.searchsorted(words.bounds, starts, "right") - 1
            cut = np.searchsorted(owner, np.arange(len(ids) + 1))
            for i, (doc_id, text) in enumerate(zip(ids, texts)):
                a, b = cut[i], cut[i + 1]
                if a == b or doc_id is None:
                    out.append(dict(zip(("doc_id", "n_words", "n_removed", "spans", "kept"),
                                        finished(doc_id, (text or b"").split(), None))))
                    continue
                out.append({"doc_id": doc_id, "slice": left.column("slice")[0].as_py(),
                            "text": text.decode("utf-8", "replace"),
                            "starts": (starts[a:b] - words.bounds[i]).astype(np.uint32).tobytes()})
                found.append((lo[a:b], hi[a:b], np.full(b - a, doc_id)))
        result = pa.Table.from_pylist(out, step_type)
        if not found:
            return result
        lo, hi, owner = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((owner, hi, lo))
        at = order[_heads(lo[order], hi[order])]
        lo, hi, owner = lo[at], hi[at], owner[at]
        cuts, bucket = _cuts((lo >> np.uint64(64 - bits)).astype(np.int32))
        blobs = {"slice": pa.array(np.full(len(bucket), left.column("slice")[0].as_py())), "bucket": pa.array(bucket),
                 "lo": _packed(lo, cuts), "hi": _packed(hi, cuts), "least": _packed(owner, cuts)}
        return pa.concat_tables([result, pa.table([blobs.get(f.name, pa.nulls(len(bucket), f.type)) for f in step_type],
                                                  schema=step_type)])

    steps = stage(docs.groupBy("slice").cogroup(hits.groupBy("slice")).applyInArrow(
        extend, f"{done_sql}, slice bigint, text string, starts binary, bucket int, lo binary, hi binary, least binary"),
        "extended")

    def earlier(table: pa.Table) -> pa.Table:
        lo, row = _unpacked(table.column("lo"), np.uint64)
        hi, _ = _unpacked(table.column("hi"), np.uint32)
        owner, _ = _unpacked(table.column("least"), np.int64)
        order = np.lexsort((hi, lo))
        at = _heads(lo[order], hi[order])
        first = np.empty(len(lo), np.int64)
        first[order] = np.repeat(np.minimum.reduceat(owner[order], at), np.diff(np.append(at, len(lo))))
        chosen = np.flatnonzero(first < owner)
        cuts, rows = _cuts(row[chosen])
        return pa.table({"slice": table.column("slice").take(pa.array(rows)),
                         "lo": _packed(lo[chosen], cuts), "hi": _packed(hi[chosen], cuts)})

    elsewhere = (steps.filter("bucket IS NOT NULL").select("slice", "bucket", "lo", "hi", "least")
                 .groupBy("bucket").applyInArrow(earlier, "slice bigint, lo binary, hi binary"))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = []
        for piece in _pieces(left, "text"):
            words = Words(piece.column("text"))
            local = [np.frombuffer(s, np.uint32) for s in piece.column("starts").to_pylist()]
            starts = np.concatenate([s + b for s, b in zip(local, words.bounds)])
            asked.append((words.rolling(window, 0)[starts],
                          (words.rolling(window, 1)[starts] >> np.uint64(32)).astype(np.uint32),
                          np.repeat(piece.column("doc_id").to_numpy(), [len(s) for s in local])))
        lo, hi, owner = (np.concatenate(c) for c in zip(*asked)) if asked else (np.empty(0, t) for t in ("u8", "u4", "i8"))
        far_lo, far_hi = _unpacked(right.column("lo"), np.uint64)[0], _unpacked(right.column("hi"), np.uint32)[0]
        all_lo, all_hi = np.concatenate([lo, far_lo]), np.concatenate([hi, far_hi])
        least = np.concatenate([owner, np.full(len(far_lo), np.iinfo(np.int64).min)])
        order = np.lexsort((all_hi, all_lo))
        at = _heads(all_lo[order], all_hi[order])
        first = np.empty(len(order), np.int64)
        if len(order):
            first[order] = np.repeat(np.minimum.reduceat(least[order], at), np.diff(np.append(at, len(order))))
        goes = first[:len(lo)] < owner
        out, done = [], 0
        for row in left.select(["doc_id", "text", "starts"]).to_pylist():
            raw, starts = row["text"].encode().split(), np.frombuffer(row["starts"], np.uint32)
            mine = starts[goes[done:done + len(starts)]].astype(np.int64)
            done += len(starts)
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, mine, 1)
            np.add.at(cover, mine + window, -1)
            out.append(finished(row["doc_id"], raw, np.cumsum(cover)[:-1] > 0))
        return pa.Table.from_pylist([dict(zip((n for n, _ in done_type), r)) for r in out], pa.schema(done_type))

    checked = (steps.filter("text IS NOT NULL").select("slice", "doc_id", "text", "starts").groupBy("slice")
               .cogroup(elsewhere.groupBy("slice")).applyInArrow(remove, done_sql))
    plain = steps.filter("n_words IS NOT NULL").select("doc_id", "n_words", "n_removed", "spans", "kept")
    return plain.unionByName(checked).withColumnRenamed("kept", "kept_sha256" if output == "sha256" else "kept_text")
