"""Operator 7: removal of repeated byte strings by a sampled suffix array.

A byte goes if a string of ``LENGTH`` = 100 bytes over it also starts earlier: in a
document of smaller id, or earlier in the same document. To find these strings:

1. Anchors. Of the ``GRAM``-byte grams in each 100-byte window the one of least hash
   (leftmost on ties) is the window's anchor. That choice depends on the window's bytes
   alone, so equal windows have equal anchors at equal places, and consecutive windows
   mostly share one: about one anchor for 35 bytes. All windows of an anchor make its
   segment, named by hashes of its gram and of all its bytes.
2. Grams found once have nothing to match. Equal segments match as wholes: all but the
   first are repeats, without a look at their windows. Where segments share a gram but
   differ (a passage's edge, an edit), one of each kind becomes a candidate.
3. Suffixes. The candidates' windows, as suffixes of 100 bytes with their place, are
   range-partitioned by sampled splitters on their leading bytes, then place. Each bucket
   sorts its suffixes by multikey quicksort over 8-byte keys and compares neighbours; a
   run that goes on over a boundary is found by comparing the last suffix of each bucket
   with the first of the next. All of a run but its first are repeats.
4. Repeated spans are merged by document and cut out of its bytes.

Copies are met as whole segments: repeats within a slice of a task's rows travel with
their first, so a text with thousands of copies is a few rows by gram. Strings are judged
on the input; a span is cut even where its source is cut too, but never the first one.

Null and empty texts have no bytes. Texts under 100 bytes lose nothing. Rows of one doc_id
are ordered by a hash of the text and count as documents of their own; equal rows get
equal results and do not shorten one another. Null doc_ids come first. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialize
from folioscope.llm.prefix import prefix_sums

LENGTH, GRAM = 100, 32
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20
_random = np.random.default_rng(7)
_GRAM_BYTE, _SEGMENT_BYTE = _random.integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_FOLD = (_random.integers(1, 2**63, 6, dtype=np.uint64) | np.uint64(1)).tolist()
_BASE = int(_random.integers(1, 2**62)) * 2 + 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 2**64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_POWERS: list[np.ndarray] = []


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes in a row, by folding halves."""
    x, width, fold = _GRAM_BYTE[raw], 1, 0
    while width < GRAM:
        x = x[:-width] * np.uint64(_FOLD[fold]) + x[width:]
        width, fold = 2 * width, fold + 1
    x ^= x >> np.uint64(29)
    x *= np.uint64(_FOLD[5])
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def segments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of documents laid end to end: gram hash, segment hash, document number, anchor, first and last window.

    ends: where each document ends in raw. Places are in raw.
    """
    empty = np.zeros(0, dtype=np.int64)
    if len(raw) < LENGTH:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty, empty
    grams = gram_hashes(raw)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(keys, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    marks = np.zeros(len(anchor) + 1, dtype=np.int32)  # windows that lie within one document
    fit = ends - starts >= LENGTH
    np.add.at(marks, starts[fit], 1)
    np.add.at(marks, ends[fit] - LENGTH + 1, -1)
    inside = np.cumsum(marks[:-1]) > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    begins[starts[fit]] = True
    lo = np.flatnonzero(begins)
    lasts = inside.copy()
    lasts[:-1] &= begins[1:] | ~inside[1:]
    hi = np.flatnonzero(lasts)
    if not _POWERS or len(_POWERS[0]) < len(raw):
        _POWERS[:] = _powers(max(len(raw), 2 * SLICE))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_SEGMENT_BYTE[raw] * _POWERS[0][: len(raw)])])
    whole = (sums[hi + LENGTH] - sums[lo]) * _POWERS[1][lo]
    whole ^= (hi - lo).astype(np.uint64) * np.uint64(_FOLD[0])
    a = anchor[lo]
    return grams[a], whole, np.searchsorted(ends, lo, side="right"), a, lo, hi


def _table(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _texts(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and UTF-8 bytes of rows, about ``size`` bytes at a time."""
    for batch in batches:
        keys, raw = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        i = 0
        while i < len(raw):
            j = held = 0
            for j in range(i, len(raw)):
                held += len(raw[j] or b"")
                if held >= size:
                    break
            yield keys[i : j + 1], [x or b"" for x in raw[i : j + 1]]
            i = j + 1


_ANCHORS = "h bigint, g bigint, key bigint, loc bigint, more binary"


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments by gram. loc packs anchor, windows before it and windows in all; more: places of equal segments in the slice."""
    for keys, texts in _texts(batches):
        ends = np.cumsum([len(x) for x in texts])
        h, g, doc, a, lo, hi = segments(np.frombuffer(b"".join(texts), dtype=np.uint8), ends)
        if not len(h):
            continue
        start = np.concatenate([[0], ends[:-1]])[doc]
        key = np.array(keys, dtype=np.int64)[doc]
        loc = (a - start) << 16 | (a - lo) << 8 | (hi - lo)
        order = np.lexsort((loc, key, g, h))
        h, g, key, loc = h[order].view(np.int64), g[order].view(np.int64), key[order], loc[order]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        at = np.flatnonzero(first)
        counts = np.diff(np.concatenate([at, [len(h)]]))
        more: list[bytes | None] = [None] * len(at)
        for i in np.flatnonzero(counts > 1).tolist():
            rest = slice(at[i] + 1, at[i] + counts[i])
            more[i] = np.stack([key[rest], loc[rest]], axis=1).astype("<i8").tobytes()
        yield _table(_ANCHORS, [h[at], g[at], key[at], loc[at], more])


def _classed(rows: DataFrame, group: str) -> DataFrame:
    """rows with again (an equal g comes before it in its group) and mixed (its group has more than one g)."""
    ordered = Window.partitionBy(group).orderBy("g", "key", "loc")
    whole = Window.partitionBy(group)
    again = F.coalesce(F.lag("g").over(ordered) == F.col("g"), F.lit(False))
    return rows.withColumn("again", again).withColumn("mixed", F.min("g").over(whole) != F.max("g").over(whole))


_SPANS = "key bigint, lo bigint, hi bigint"


def _segment_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte spans of repeated segments: a row itself if again, and all that travel with it."""
    for batch in batches:
        again = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        pairs = [np.stack([batch.column(0).to_numpy()[again], batch.column(1).to_numpy()[again]], axis=1)]
        pairs += [np.frombuffer(m, dtype="<i8").reshape(-1, 2) for m in batch.column(3).to_pylist() if m]
        found = np.concatenate(pairs)
        lo = (found[:, 1] >> 16) - (found[:, 1] >> 8 & 255)
        yield _table(_SPANS, [found[:, 0], lo, lo + (found[:, 1] & 255) + LENGTH])


#: Windows of a cell: candidates' segments are cut into cells by the distance of a window to its anchor.
CELL = 8
_CELLS = "core bigint, g bigint, key bigint, loc bigint, body binary"


def _find_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of candidate segments. A cell's core lies in each of its windows, so cells of different cores share none."""
    for batch in batches:
        out: list[tuple] = []
        for key, text, locs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = text.encode()
            for loc in locs:
                a, lo = loc >> 16, (loc >> 16) - (loc >> 8 & 255)
                hi = lo + (loc & 255)
                for s in range((a - hi) // CELL, (a - lo) // CELL + 1):
                    first, last = max(lo, a - CELL * s - CELL + 1), min(hi, a - CELL * s)
                    core = raw[a - CELL * s : a - CELL * s - CELL + 1 + LENGTH]
                    body = raw[first : last + LENGTH]
                    out.append((xxhash.xxh3_64_intdigest(core, s), xxhash.xxh3_64_intdigest(body, last - a + 128), key, first, body))
        if out:
            core, g, key, first, body = zip(*out, strict=True)
            signed = [np.array(x, dtype=np.uint64).view(np.int64) for x in (core, g)]
            yield _table(_CELLS, [*signed, key, first, body])


_SUFFIXES = "suffix binary, key bigint, at bigint"


def _find_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        suffix, keys, at = [], [], []
        for key, first, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n = len(body) - LENGTH + 1
            suffix += [body[i : i + LENGTH] for i in range(n)]
            keys += [key] * n
            at += range(first, first + n)
        yield _table(_SUFFIXES, [suffix, keys, at])


#: Runs of rows under this size are sorted by all keys at once.
SMALL = 64


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The stable order of rows of 8-byte keys by multikey quicksort: rows part in three by a pivot of their key, and those equal to it go on with the next key."""
    out, at = np.empty(len(words), dtype=np.int64), 0
    todo = [(np.arange(len(words)), 0)]
    while todo:
        rows, k = todo.pop()
        if k == words.shape[1] or len(rows) <= 1:
            order = rows
        elif len(rows) <= SMALL:
            order = rows[np.lexsort(words[rows, k:].T[::-1])]
        else:
            keys = words[rows, k]
            pivot = np.sort(keys[:: max(1, len(keys) // 9)])[4]  # the median of nine
            less, more = keys < pivot, keys > pivot
            todo += [(rows[more], k), (rows[~(less | more)], k + 1), (rows[less], k)]
            continue
        out[at : at + len(order)] = order
        at += len(order)
    return out


_SORTED = "bucket int, key bigint, at bigint, again boolean, leads boolean, first binary, last binary"


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats within a bucket, its leading run (it may go on from the bucket before), and a row with its first and last suffix."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    bucket = TaskContext.get().partitionId()
    all_rows = pa.Table.from_batches(held)
    raw = b"".join(all_rows.column(0).to_pylist())
    n = all_rows.num_rows
    padded = np.zeros((n, -(-LENGTH // 8) * 8), dtype=np.uint8)
    padded[:, :LENGTH] = np.frombuffer(raw, dtype=np.uint8).reshape(n, LENGTH)
    key, at = all_rows.column(1).to_numpy(), all_rows.column(2).to_numpy()
    place = np.lexsort((at, key))
    words, key, at = padded[place].view(">u8").astype(np.uint64), key[place], at[place]
    order = multikey_order(words)
    words, key, at = words[order], key[order], at[order]
    again = np.concatenate([[False], (words[1:] == words[:-1]).all(axis=1)])
    leads = np.cumsum(~again) == 1
    told = again | leads
    first, last = (words[i].astype(">u8").tobytes() for i in (0, -1))
    m = int(told.sum())
    yield _table(_SORTED, [np.full(m, bucket), key[told], at[told], again[told], leads[told], [None] * m, [None] * m])
    yield _table(_SORTED, [[bucket], [None], [None], [False], [False], [first], [last]])


def _suffix_spans(cells: DataFrame) -> DataFrame:
    """Spans of repeated windows, by the suffix array of all windows of cells (key, loc, body)."""
    suffixes = cells.mapInArrow(_find_suffixes, _SUFFIXES).repartitionByRange("suffix", "key", "at")
    ordered = materialize(suffixes.mapInArrow(_sort_bucket, _SORTED), "suffix-buckets")
    before = F.lag("last").over(Window.orderBy("bucket"))  # one row a bucket
    goes_on = ordered.filter("first is not null").select("bucket", (before == F.col("first")).alias("goes_on"))
    told = ordered.filter("first is null").join(F.broadcast(goes_on), "bucket")
    repeats = told.filter("again or (leads and coalesce(goes_on, false))")
    return repeats.select("key", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs (key: a different long for each row, ordered; text) to spans of bytes that repeat earlier ones: key, lo, hi."""
    anchors = docs.select("key", "text").mapInArrow(_find_anchors, _ANCHORS)
    told = _classed(anchors, "h").filter("again or mixed or more is not null").select("key", "loc", "again", "mixed", "more")
    told = materialize(told, "suffix-segments")
    spans = told.filter("again or more is not null").select("key", "loc", "again", "more").mapInArrow(_segment_spans, _SPANS)
    wanted = told.filter("mixed and not again").groupBy("key").agg(F.collect_list("loc").alias("locs"))
    cells = docs.select("key", "text").join(wanted, "key").select("key", "text", "locs").mapInArrow(_find_cells, _CELLS)
    told_cells = materialize(_classed(cells, "core").filter("again or mixed").select("key", "loc", "again", F.octet_length("body").alias("size"), F.when(~F.col("again"), F.col("body")).alias("body")), "suffix-cells")
    spans = spans.unionByName(told_cells.filter("again").select("key", F.col("loc").alias("lo"), (F.col("loc") + F.col("size")).cast("long").alias("hi")))
    return spans.unionByName(_suffix_spans(told_cells.filter("not again").select("key", "loc", "body")))


_CUT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def merged(spans: list) -> list[list[int]]:
    """Maximal runs of bytes under (lo, hi) spans."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _cutter(stay: list[str], as_text: bool):
    schema = _CUT.replace("binary", "string") if as_text else _CUT

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            rows = []
            for text, spans in zip(column["text"].to_pylist(), column["_spans"].to_pylist(), strict=True):
                raw, runs = (text or "").encode(), merged(spans or [])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(runs), kept.decode("utf-8", "ignore") if as_text else kept))
            cut = _table(schema, list(zip(*rows, strict=True)) if rows else [[]] * 4)
            yield pa.RecordBatch.from_arrays([*(column[c] for c in stay), *cut.columns], [*stay, *cut.schema.names])

    return cut_out


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with _key, and the (key, text) of its different documents.

    The key is doc_id itself where that tells all rows apart, else the rank of (doc_id, hash of the text).
    """
    doc_id = F.col("doc_id").cast("long")
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        keyed = docs.withColumn("_key", doc_id)
        return keyed, keyed.select(F.col("_key").alias("key"), "text")
    named = docs.withColumn("_th", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).withColumn("_d", F.coalesce(doc_id.cast("string"), F.lit("null")))
    pairs = named.select(doc_id.alias("_id"), "_d", "_th", F.lit(1).alias("_one")).distinct()
    ranks = prefix_sums(pairs, [F.col("_id").asc_nulls_first(), F.col("_th")], "_one", "suffix-keys").select("_d", "_th", F.col("_rank").alias("_key"))
    keyed = materialize(named.join(ranks, ["_d", "_th"]).drop("_d", "_th"), "suffix-keyed")
    return keyed, keyed.select(F.col("_key").alias("key"), "text").dropDuplicates(["key"])


def remove_repeats(docs: DataFrame, with_text: bool = True, as_text: bool = False) -> DataFrame:
    """docs (doc_id, text, …) with n_bytes, n_removed, n_spans and kept (the bytes that are left); one row for each of docs.

    These replace columns of the same names; the original text goes along only with_text.
    as_text: kept is a string, without the parts of characters that a span's ends cut in two.
    """
    plain = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "_key", "_spans")
    keyed, distinct = _keyed(plain)
    spans = repeated_spans(distinct).groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    stay = [f for f in plain.schema if with_text or f.name != "text"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in stay) + (_CUT.replace("binary", "string") if as_text else _CUT)
    return keyed.join(spans, "_key", "left").drop("_key").mapInArrow(_cutter([f.name for f in stay], as_text), schema)
