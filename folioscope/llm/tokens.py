"""Token ids by the tokenizers library, with a bounded cache for each Python worker."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Chunks a worker keeps at most, about 40 bytes each; beyond, those met least often go. Bounds memory, never results.
CACHE_ENTRIES = 500_000
#: Chunks that a line feed on either side leaves as they are: one space at most, and that in front.
_LINE = re.compile(r" ?\S+")
_random = np.random.default_rng(3)
_BYTE = _random.integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = [int(x) * 2 + 1 for x in _random.integers(1, 2**62, 2)]
#: Bytes before which a text is not cut: ASCII white space and controls, and what may lead a space beyond ASCII.
_JOINED = np.zeros(256, dtype=bool)
_JOINED[[*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class _Powers:
    """Powers of two bases and their inverses, modulo 2**64, as many as asked for."""

    def __init__(self):
        self.n, self.rows = 0, []

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if n > self.n:
            self.n, self.rows = n + n // 8, []
            for base in _BASE:
                pair = []
                for b in (base, pow(base, -1, 2**64)):
                    p = np.full(self.n, b, dtype=np.uint64)
                    p[0] = 1
                    pair.append(np.multiply.accumulate(p))
                self.rows.append(tuple(pair))
        return self.rows


_POWERS = _Powers()


def _bytes_in(letters: str, marks: str) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((2, 256), dtype=bool)
    for row, chars in zip(out, (letters, marks), strict=True):
        row[list(chars.encode())] = True
    return out[0], out[1]


_LETTER, _MARK = _bytes_in("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?\n")


class ChunkCache:
    """Encodes texts by asking once for each distinct chunk.

    ``ask`` encodes a list of texts to ids (little-endian unsigned 32-bit). It must be a
    byte-level BPE without normalizer or prefix space: that always begins a word at a space
    that text follows, and ends one between a letter and a mark, so a text may be cut there.
    Chunks are told apart by two hashes of 64 bits; should the first alone ever confuse two,
    the texts are asked for whole. Chunks are sorted by their first hash.
    """

    def __init__(self, ask: Callable[[list[str]], list[bytes]]):
        self.ask = ask
        self.clear()

    def clear(self) -> None:
        self.first, self.second = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.start, self.length, self.seen = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
        self.ids, self.used = np.zeros(4096, dtype="<u4"), 0

    def _shrink(self) -> None:
        """Let go of the half of chunks that fewest slices held."""
        stay = np.flatnonzero(self.seen > np.median(self.seen)) if len(self.seen) else np.zeros(0, dtype=np.int64)
        lengths = self.length[stay]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        self.ids = self.ids[np.repeat(self.start[stay] - (ends - lengths), lengths) + np.arange(total)]
        self.first, self.second, self.length = self.first[stay], self.second[stay], lengths
        self.start, self.seen, self.used = ends - lengths, np.ones(len(stay), dtype=np.int32), total

    def _keep(self, at: np.ndarray, first: np.ndarray, second: np.ndarray, found: list[bytes]) -> None:
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        total = self.used + int(lengths.sum())
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(total + total // 4 - self.used, dtype="<u4")])
        self.ids[self.used : total] = np.frombuffer(b"".join(found), dtype="<u4")
        self.first, self.second = np.insert(self.first, at, first), np.insert(self.second, at, second)
        self.start = np.insert(self.start, at, self.used + np.cumsum(lengths) - lengths)
        self.length, self.seen = np.insert(self.length, at, lengths), np.insert(self.seen, at, 0)
        self.used = total

    def encode(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        whole = b"".join(raw)
        if not whole:
            return [b""] * len(texts)
        buf, ends = np.frombuffer(whole, dtype=np.uint8), np.cumsum(sizes)
        cut = np.zeros(len(buf) + 1, dtype=bool)
        cut[:-2] = (buf[:-1] == 0x20) & ~_JOINED[buf[1:]]
        cut[1:-1] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
        cut[(ends - 1)[sizes > 0]] &= (sizes[sizes > 0] == 1) | (buf[(ends - 1)[sizes > 0]] != 0x20)  # a space that ends a text is led by what is before it
        cut[ends - sizes] = True
        cut[-1] = True
        edges = np.flatnonzero(cut)
        lo, hi = edges[:-1], edges[1:]
        hashes = []
        for byte, (power, inverse) in zip(_BYTE, _POWERS.upto(len(buf)), strict=True):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(byte[buf] * power[: len(buf)])])
            x = (sums[hi] - sums[lo]) * inverse[lo]
            hashes.append(x ^ (x >> np.uint64(31)))
        one, two = hashes[0], hashes[1] ^ (hi - lo).astype(np.uint64)
        first, at, which = np.unique(one, return_index=True, return_inverse=True)
        if len(self.first) + len(first) > CACHE_ENTRIES:
            self._shrink()
        place = np.searchsorted(self.first, first)
        known = np.zeros(len(first), dtype=bool)
        if len(self.first):
            known = self.first[np.minimum(place, len(self.first) - 1)] == first
        new = np.flatnonzero(~known)
        if len(new):
            chunks = [whole[a:b].decode() for a, b in zip(lo[at[new]].tolist(), hi[at[new]].tolist(), strict=True)]
            self._keep(place[new], first[new], two[at[new]], self.ask(chunks))
            place += np.cumsum(~known) - ~known
        self.seen[place] += 1
        mine = place[which]
        if (self.second[mine] != two).any():
            return self.ask(texts)
        counts = self.length[mine].astype(np.int64)
        after = np.cumsum(counts)
        ids = self.ids[np.repeat(self.start[mine] - (after - counts), counts) + np.arange(int(after[-1]))]
        last = np.concatenate([[0], after])[np.searchsorted(lo, ends)]  # ids before each text's end
        return [ids[a:b].tobytes() for a, b in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]


class LibraryEncoder:
    """What the tokenizers library gives for add_special_tokens=False, without truncation or padding."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre = repr(self.tokenizer.pre_tokenizer)
        cuttable = self.tokenizer.normalizer is None and pre.startswith("ByteLevel") and "add_prefix_space=False" in pre and "use_regex=True" in pre
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if cuttable and len(feed) == 1 else None
        self.encode = ChunkCache(self.ask_chunks if self.feed is not None else self.ask).encode if cuttable else self.ask

    def ask(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ask_chunks(self, chunks: list[str]) -> list[bytes]:
        """ask(), with all chunks that a line feed may part in one text: the library takes about as long to return a text as to encode a word."""
        apart = [_LINE.fullmatch(x) is not None for x in chunks]
        lines = [x for x, alone in zip(chunks, apart, strict=True) if alone]
        others = iter(self.ask([x for x, alone in zip(chunks, apart, strict=True) if not alone]))
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, dtype="<u4")
        feeds = np.flatnonzero(ids == self.feed)
        if len(feeds) != max(0, len(lines) - 1):
            return self.ask(chunks)
        edges, raw = np.concatenate([[-1], feeds, [len(ids)]]).tolist(), ids.tobytes()
        found = iter([raw[4 * a + 4 : 4 * b] for a, b in zip(edges, edges[1:])])
        return [next(found if alone else others) for alone in apart]


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of Arrow batches of about ``most`` bytes of text, with their texts (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        step = max(1, min(2000, most * max(1, len(batch)) // max(1, column.nbytes)))
        for i in range(0, len(batch), step):
            part = batch.slice(i, step)
            yield part, [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
