"""Operator 10: byte-level BPE encoding and decoding of our own.

A text is cut at the added tokens, then into words by the byte-level pattern.
Each distinct word is encoded once: its parts and the ranks of adjacent parts lie
in contiguous arrays, the least rank is found by a scan (leftmost on ties), the
boundary there is deleted and the two neighbouring ranks are looked up again,
until no rank is left. Words are scanned side by side, a matrix row each; words
too long for that keep their candidate ranks in a heap instead of scanning.

Null texts count as empty and give no ids. Decoding joins the bytes of the
tokens and reads them as UTF-8, with the replacement character for what is not.
Unknown ids decode to nothing, as in the library.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioscope.llm.tokens import ChunkCache, slices

#: The pattern of byte-level pre-tokenizers: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
#: Words of more bytes than this use the heap.
SHORT = 48


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.bytes_of: dict[int, bytes] = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.first = np.array([vocab[symbols[b]] for b in range(256)], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.span = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.span + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.pattern = regex.compile(PATTERN)
        self.cache = ChunkCache(self.encode_words)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.span + b
        if not len(self.keys):
            return np.full(key.shape, NONE)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_of_key[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, none empty, by scanning contiguous rank arrays side by side."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        for lo in range(0, len(order), 8192):
            rows = order[lo : lo + 8192]
            width = int(sizes[rows[-1]])
            flat = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), dtype=np.uint8).reshape(len(rows), width)
            parts = np.where(np.arange(width) < sizes[rows][:, None], self.first[flat], -1)
            rank = np.full((len(rows), width), NONE)
            rank[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
            places = np.arange(width)
            while len(rows):
                least = rank.argmin(axis=1)
                each = np.arange(len(rows))
                value = rank[each, least]
                done = value == NONE
                if done.any():
                    ended = parts[done].astype("<u4")
                    ends = ((ended != 0xFFFFFFFF).sum(axis=1) * 4).tolist()
                    flat, stride = ended.tobytes(), 4 * ended.shape[1]
                    for k, i in enumerate(rows[done].tolist()):
                        out[i] = flat[k * stride : k * stride + ends[k]]
                    live = ~done
                    rows, parts, rank, least, value = rows[live], parts[live], rank[live], least[live], value[live]
                    each = np.arange(len(rows))
                    if not len(rows):
                        break
                    width = int((parts >= 0).sum(axis=1).max())
                    parts, rank, places = parts[:, :width].copy(), rank[:, :width].copy(), np.arange(width)
                take = np.minimum(places + (places > least[:, None]), width - 1)
                parts[each, least] = self.merged[value]
                parts = np.take_along_axis(parts, take, axis=1)
                parts[:, -1] = -1
                take = np.minimum(places + (places >= least[:, None]), width - 1)
                rank = np.take_along_axis(rank, take, axis=1)
                rank[:, -1] = NONE
                left = np.maximum(least - 1, 0)
                rank[each, left] = np.where(least > 0, self.ranks(parts[each, left], parts[each, least]), rank[each, left])
                right = np.minimum(least + 1, width - 1)
                rank[each, least] = np.where(least + 1 < width, self.ranks(parts[each, least], parts[each, right]), NONE)
        return out

    def merge_long(self, word: bytes) -> bytes:
        """The same merges with linked parts and a heap of (rank, place)."""
        parts = self.first[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        first = self.ranks(np.array(parts[:-1]), np.array(parts[1:]))
        heap = [(int(r), i, parts[i], parts[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    r2 = int(self.ranks(np.array([parts[x]]), np.array([parts[y]]))[0])
                    if r2 != NONE:
                        heapq.heappush(heap, (r2, x, parts[x], parts[y]))
        return np.array([p for p in parts if p >= 0], dtype="<u4").tobytes()

    def encode_words(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of texts without added tokens, each distinct word once."""
        words = list(map(self.pattern.findall, texts))
        distinct = [*set().union(*words)] if words else []
        raw = [w.encode() for w in distinct]
        short = [i for i, b in enumerate(raw) if len(b) <= SHORT]
        ids = dict(zip([distinct[i] for i in short], self.merge_short([raw[i] for i in short]), strict=True))
        ids |= {distinct[i]: self.merge_long(b) for i, b in enumerate(raw) if len(b) > SHORT}
        return [ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws)) for ws in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.added or not any(t in text for text in texts for t in self.added):
            return self.cache.encode(texts)
        pieces = [self.split_added.split(text) for text in texts]
        plain = [[p for p in ps if p not in self.added] for ps in pieces]
        ids = iter(self.cache.encode([p for ps in plain for p in ps]))
        of_added = {t: np.array([i], dtype="<u4").tobytes() for t, i in self.added.items()}
        return [b"".join(of_added[p] if p in self.added else next(ids) for p in ps) for ps in pieces]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.get, np.frombuffer(ids, dtype="<u4").tolist(), repeat(b""))).decode("utf-8", "replace")


_MODELS: dict[str, BPE] = {}


def model(path: str) -> BPE:
    if path not in _MODELS:
        _MODELS[path] = BPE(path)
    return _MODELS[path]


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids: the ids of each text as little-endian unsigned 32-bit integers (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, text):
            ids = pa.array(model(tokenizer).encode(texts), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids binary")


def decode(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """df with its column of ids and ``decoded``, their text (in place of a column of that name)."""
    df = df.drop("decoded") if ids != "decoded" else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 8_000_000 * len(batch) // max(1, batch.nbytes))
            for i in range(0, len(batch), step):
                rows = batch.slice(i, step)
                column = rows.column(rows.schema.get_field_index(ids)).to_pylist()
                texts = pa.array([model(tokenizer).decode(x or b"") for x in column], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, texts], [*rows.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, decoded string")
