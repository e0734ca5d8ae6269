"""Operator 13: passages of benchmark items within documents, by Wu and Manber's search for many strings.

Texts are lower-cased (A-Z) and reduced to words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``)
with one space between and around them. A test string is a window of ``n`` consecutive
words of an item; an item of fewer words, but not none, is one window.

Strings of alike length share a table. With ``m`` the length that all of them have at
least, a block of up to 8 bytes at the end of the m bytes under inspection tells by the
``shift`` table how far the next place may be at which any of them can begin; no shift
means that the block ends the first m bytes of some strings. Those are the bucket of its
hash, and where the place passes a table of first blocks too, the text's own words from
there on are looked up in the sorted bucket by direct comparison. Many stretches of the
texts (lanes) are walked side by side.

Test strings are ordered by Spark and cut into blocks of ``BLOCK`` bytes, so whatever the
items, and however many share a string, a table is of bounded size: each block is broadcast
alone and the documents are read once a block (items of about 1.5 MB are one block, and then
nothing is shuffled). With several blocks, the documents that a block meets are merged by row.

Null texts have no words, null items no windows. An item of null id marks words but is not
counted or named; of equal ids one is named. Repeated rows, null doc_ids and extra columns
pass through. One very long text is held by one task. Without items nothing is hit; empty
documents give an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, new_path
from folioscope.llm.prefix import prefix_sums
from folioscope.llm.tokens import slices

WINDOW = 10
#: Bytes of test strings in one table, their items' ids included.
BLOCK = 16 << 20
#: Bytes of a lane; longest inspected start of a string.
LANE, LONGEST = 512, 128
_FOLD = bytes(x if x >= 128 or chr(x) in "0123456789abcdefghijklmnopqrstuvwxyz" else x + 32 if chr(x) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for x in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def windows(own: list[bytes], n: int) -> set[bytes]:
    """The test strings of an item's words."""
    return {b" " + b" ".join(own[i : i + n]) + b" " for i in range(max(1, len(own) - n + 1))} if own else set()


def _wide(raw: bytes) -> np.ndarray:
    """The 8 bytes from each place of raw on, as one number."""
    return np.ndarray((len(raw),), "<u8", raw + bytes(8), strides=(1,))


class ShiftTable:
    """Strings of alike length: shifts by block, buckets by the last block of their first m bytes."""

    def __init__(self, strings: list[bytes], numbers: np.ndarray):
        lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        starts, wide = np.cumsum(lengths) - lengths, _wide(b"".join(strings))
        self.m = min(int(lengths.min()), LONGEST)
        self.b = min(8, self.m)
        self.mask = np.uint64((1 << 8 * self.b) - 1)
        self.down = np.uint64(64 - min(22, max(12, (8 * len(strings) * self.m).bit_length())))
        size, far = 1 << (64 - int(self.down)), self.m - self.b
        self.shift = np.full(size, far + 1, dtype=np.uint8)
        for at in range(far + 1):  # later blocks leave less to shift
            ends = self.hash(wide[starts + at])
            self.shift[ends] = far - at
        self.first = np.zeros(size, dtype=bool)
        self.first[self.hash(wide[starts])] = True
        order = sorted(range(len(strings)), key=lambda i: (ends[i], strings[i]))
        self.strings, self.numbers, self.ends = [strings[i] for i in order], numbers[order].tolist(), ends[order]
        self.counts = sorted({s.count(b" ") - 1 for s in strings})

    def hash(self, blocks: np.ndarray) -> np.ndarray:
        return (((blocks & self.mask) * _MIX) >> self.down).astype(np.int64)

    def places(self, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a string may begin, and the hash of its bucket."""
        last = len(wide) - self.m + 1
        at = np.arange(0, max(0, last), LANE)
        stop, found = np.minimum(at + LANE, last), [(at[:0], at[:0])]
        while len(at):
            ends = self.hash(wide[at + (self.m - self.b)])
            step = self.shift[ends]
            if not step.all():
                here = np.flatnonzero(step == 0)
                here = here[self.first[self.hash(wide[at[here]])]]
                found.append((at[here], ends[here]))
            at = at + np.maximum(step, 1)
            inside = at < stop
            at, stop = at[inside], stop[inside]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def occurrences(self, text: bytes, wide: np.ndarray, spaces: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """First word, number of words and number of each string that occurs."""
        at, ends = self.places(wide)
        lo, hi, nth = np.searchsorted(self.ends, ends), np.searchsorted(self.ends, ends, side="right"), np.searchsorted(spaces, at)
        for place, a, b, first in zip(at.tolist(), lo.tolist(), hi.tolist(), nth.tolist(), strict=True):
            for k in self.counts:
                if first + k >= len(spaces):
                    break
                own = text[place : int(spaces[first + k]) + 1]
                i = bisect_left(self.strings, own, a, b)
                if i < b and self.strings[i] == own:
                    yield first, k, self.numbers[i]


class Searcher:
    """All tables of one block of test strings (sorted, equal ones side by side), with the items of each string."""

    def __init__(self, strings: list[bytes], items: list[str | None]):
        self.items: list[list[str]] = []
        distinct: list[bytes] = []
        for s, item in zip(strings, items, strict=True):
            if not distinct or distinct[-1] != s:
                distinct.append(s)
                self.items.append([])
            if item is not None:
                self.items[-1].append(item)
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(distinct):
            by_length.setdefault(min(len(s), LONGEST).bit_length(), []).append(i)
        self.tables = [ShiftTable([distinct[i] for i in of], np.array(of)) for _, of in sorted(by_length.items())]

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, list[tuple[int, int]], list[str]]]:
        """For each text: words, hit words, spans of hit words (first, last), names of items in order."""
        raw = np.frombuffer(b" " + b"".join(t.translate(_FOLD) + b" \0 " for t in texts), dtype=np.uint8)  # no word holds a zero
        space = raw == 32
        space[1:] &= raw[:-1] == 32
        space[0] = False
        raw = raw[~space]
        text, spaces = raw.tobytes(), np.flatnonzero(raw == 32)
        wide, closed = _wide(text), np.searchsorted(spaces, np.flatnonzero(raw == 0)) - 1  # the zeros' places among the words
        edge, found = np.zeros(len(spaces) + 1, dtype=np.int32), [set() for _ in texts]
        for table in self.tables:
            for first, k, number in table.occurrences(text, wide, spaces):
                edge[first] += 1
                edge[first + k] -= 1
                found[int(np.searchsorted(closed, first))].add(number)
        hit = np.cumsum(edge) > 0
        before = np.concatenate([[0], np.cumsum(hit)])
        turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        spans = [(a, b - 1) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist())]
        begin, nth = 0, 0
        for end, numbers in zip(closed.tolist(), found, strict=True):
            own = []
            while nth < len(spans) and spans[nth][0] < end:
                own.append((spans[nth][0] - begin, spans[nth][1] - begin))
                nth += 1
            yield end - begin, int(before[end] - before[begin]), own, sorted({x for i in numbers for x in self.items[i]})
            begin = end + 1


_FIELDS = "n_words bigint, n_hit bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"
_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]
#: The tables that a worker built last.
_BUILT: dict[str, Searcher] = {}


def search_strings(items: DataFrame, key: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """A row (window, item, block) for each test string of each item; a block's rows hold about BLOCK bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "text"):
            found = [(w, k) for k, t in zip(rows.column(0).to_pylist(), texts, strict=True) for w in windows(words(t or b""), n)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([k for _, k in found], pa.string())], ["window", "item"])

    made = items.select(F.col(f"`{key}`").cast("string").alias("item"), F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(run, "window binary, item string")
    sized = made.withColumn("_size", F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)
    placed = prefix_sums(sized, [F.col("window"), F.col("item").asc_nulls_first()], "_size", "test-strings")
    return materialize(placed.select("window", "item", F.expr(f"_start div {BLOCK}").cast("int").alias("block")), "test-string-blocks")


def _searched(docs: DataFrame, strings: DataFrame, block: int, text: str, stay: list, hits_only: bool) -> DataFrame:
    own = strings.filter(F.col("block") == block).select("window", "item").toArrow().sort_by([("window", "ascending"), ("item", "ascending")])  # BLOCK bytes
    sent, name = docs.sparkSession.sparkContext.broadcast((own.column(0).to_pylist(), own.column(1).to_pylist())), new_path(docs.sparkSession, "searcher")
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Searcher(*sent.value)
        for rows, texts in slices(batches, text):
            found = list(_BUILT[name].search([t or b"" for t in texts]))
            arrays = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), _KINDS, strict=True)]
            out = pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(f.name)) for f in stay] + arrays, [f.name for f in stay] + names)
            yield out.filter(pa.array([f[1] > 0 for f in found], pa.bool_())) if hits_only else out

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in stay) + _FIELDS
    return docs.withColumn(text, F.col(f"`{text}`").cast("binary")).mapInArrow(run, schema)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items that several blocks found in a row, as one block would have found them."""
    for batch in batches:
        hits, spans = [], []
        for own in batch.column(1).to_pylist():
            joined: list[list[int]] = []
            for first, last in sorted((x["first"], x["last"]) for x in own):
                if joined and first <= joined[-1][1] + 1:
                    joined[-1][1] = max(last, joined[-1][1])
                else:
                    joined.append([first, last])
            spans.append([tuple(x) for x in joined])
            hits.append(sum(b - a + 1 for a, b in joined))
        items = [sorted(set(x)) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, kind in zip((hits, spans, items), _KINDS[1:], strict=True))], ["_row", "n_hit", "spans", "items"])


def find(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "item_id", item_text: str = "text", n: int = WINDOW) -> DataFrame:
    """docs, without the text, with n_words, n_hit, spans (hit words, first to last, from 0) and items (names, sorted as strings).

    Fields replace columns of the same names.
    """
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    docs = docs.drop(*[c for c in names if c != text])
    strings = search_strings(items, key, item_text, n)
    blocks = [r.block for r in strings.groupBy("block").count().orderBy("block").collect()] or [0]  # a row for 16 MB
    if len(blocks) == 1:
        return _searched(docs, strings, blocks[0], text, [f for f in docs.schema if f.name != text], False)
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "searched-rows")
    met = [_searched(rows.select("_row", text), strings, b, text, [rows.schema["_row"]], True) for b in blocks]
    every = met[0]
    for other in met[1:]:
        every = every.unionByName(other)
    merged = every.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    merged = merged.mapInArrow(_united, "_row bigint, n_hit bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>")
    none = {"n_hit": F.lit(0), "spans": F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"), "items": F.expr("cast(array() as array<string>)")}
    counted = _searched(rows, strings.limit(0), blocks[0], text, [f for f in rows.schema if f.name != text], False).drop(*none)
    stay = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return counted.join(merged, "_row", "left").select(*stay, "n_words", *(F.coalesce(c, x).alias(c) for c, x in none.items()))
