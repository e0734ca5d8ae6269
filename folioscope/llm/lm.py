"""Operator 6: scoring by a hierarchical Pitman-Yor language model.

The word before is the context: each has a restaurant of its own, and all of them share
one parent, the restaurant of all words, over a uniform base of the words met in training
and one more, any unknown word. Probabilities sum to one in every context; one never met
in training answers as its parent. A restaurant's tables are the parent's customers.

Seating is sampled by Gibbs sweeps. In a sweep ``MOVES`` customers of each dish, drawn at
random, get up one after the other and sit down again given everybody else: at a new table
with weight (strength + discount * tables) * parent's probability, at an old one with its
customers less the discount (a random scan, the same at every size of dish). Dishes of one
customer have one table whatever is drawn. Dishes move at once: what one of them knows of
the tables of others is their last move within its bucket, and the last sweep's elsewhere;
the parent is that of the sweep before. The parent is seated anew for each sweep, from a
start in lumps, and moved likewise. ``BURN_IN`` sweeps are thrown away; the predictive
probabilities under the others are averaged (not their parts) and score every text.

How it runs: texts are read once, into chunks of about ``CHUNK_BYTES`` of numbered tokens;
each chunk gives its distinct words with their counts to the words' buckets (by hash) and
gets their numbers back, then gives its distinct pairs with their counts to the pairs'
buckets: by the context, which after each ``SPLIT`` occurrences takes one more bucket, so
that no context, however common, fills one. A sweep is two shuffles of sums: tables by word
and by context to the words' buckets, probabilities and totals back. For scoring, chunks
get the figures of their own words and pairs, in the order in which they asked. All of this
is rows of packed arrays (``ROW``), one for each chunk and bucket that meet; the driver
holds a dozen totals. What is gathered grows with the corpus and nothing is cut off or
hashed together.

Words are runs of anything but ASCII white space, A-Z in lower case; each text ends in an
end token, the empty word, which also is the context of a text's first word. Null and empty
texts are that token alone. Null doc_ids count as the empty string for the fold. Repeated
rows are texts of their own. An empty table gives an empty result; without training texts
the model is its base. One document is held by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import discard, materialize

CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
SPLIT = 1 << 20
MOVES, BURN_IN, SAMPLES = 8, 2, 2
STRENGTH = 1.0
#: Buckets are dealt to so many tasks at most.
TASKS = 20_000
#: Word numbers have so many bits, so that two and a flag fit into 63.
BITS = 31
_LOW = (1 << BITS) - 1

ROW = "kind int, at bigint, peer bigint, a binary, b binary, c binary, d binary, e binary, f binary, x bigint, y bigint, p bigint, q bigint"
CHUNK, WORDS, NUMBERS, VOCABULARY, PAIRS, SEATS, CONTEXTS, ONES, TOLD, REPLY, SAMPLE, ASKED, OF_WORDS, OF_PAIRS = range(14)
_KINDS = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6, *[pa.int64()] * 4]
_NAMES = [x.split()[0] for x in ROW.split(", ")]
_PRESS, _UNPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1


class Rows:
    """Rows of ROW as they are made."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in _NAMES]

    def add(self, kind: int, at: int, peer: int, *blobs: bytes, sums: tuple = ()) -> None:
        for column, value in zip(self.columns, (kind, at, peer, *blobs, *[None] * (6 - len(blobs)), *map(int, sums), *[0] * (4 - len(sums))), strict=True):
            column.append(value)

    def table(self) -> pa.Table:
        return pa.table([pa.array(c, k) for c, k in zip(self.columns, _KINDS, strict=True)], _NAMES)


def by_kind(rows: pa.Table) -> dict[int, list[dict]]:
    """Rows of a group by kind, ordered by peer."""
    out: dict[int, list[dict]] = {}
    for r in sorted(rows.to_pylist(), key=lambda r: r["peer"]):
        out.setdefault(r["kind"], []).append(r)
    return out


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from zero on: as few bytes each as the largest needs, by planes of bytes, compressed."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + _PRESS.compress(x.astype(f"<u{width}").view(np.uint8).reshape(len(x), width).T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(_UNPRESS.decompress(raw[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def deal(at: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Parts of columns by their value of at, ascending, each in its old order."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield int(at[a]), [c[order[a:b]] for c in columns]


# Reading and numbering

class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunk(place: int, index: _Numbers, tokens: list[np.ndarray], facts: list[tuple], buckets: int) -> pa.RecordBatch:
    """A chunk's texts in numbers of its own, by bucket of the word, and its words for each bucket."""
    rows, words = Rows(), list(index)
    at = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), dtype=np.int64, count=len(words))
    order = np.argsort(at, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    flat = rank[np.concatenate(tokens)]
    ids, held, sizes = zip(*facts, strict=True)
    lengths, held = np.array(sizes), np.array(held, dtype=np.int64)
    counts = np.bincount(flat[np.repeat(held, lengths) == 0], minlength=len(words))
    null = np.array([i is None for i in ids], dtype=np.int64)
    rows.add(CHUNK, place, 0, pack(flat), pack(lengths), pack(held), np.array([i or 0 for i in ids], dtype="<i8").tobytes(), pack(null))
    for bucket, (mine, n) in deal(at[order], order, counts):
        rows.add(WORDS, bucket, place, _PRESS.compress(b"\n".join([words[i] for i in mine.tolist()])), pack(n))
    return rows.table().combine_chunks().to_batches()[0]


def _reader(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        index, tokens, facts, size = _Numbers(), [], [], 0
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                for doc_id, text, held in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = (text or "").encode()
                    words = [*raw.lower().split(), b""]
                    tokens.append(np.fromiter(map(index.__getitem__, words), dtype=np.int32, count=len(words)))
                    facts.append((doc_id, held, len(words)))
                    size += len(raw)
                    if size >= CHUNK_BYTES:
                        yield _chunk(place, index, tokens, facts, buckets)
                        place, index, tokens, facts, size = place + 1, _Numbers(), [], [], 0
        if facts:
            yield _chunk(place, index, tokens, facts, buckets)

    return read


def _number_words(rows: pa.Table, buckets: int) -> pa.Table:
    """Numbers and counts of a bucket's words for each chunk that has them."""
    index, asked, out = _Numbers(), [], Rows()
    bucket = rows.column("at")[0].as_py()
    for r in by_kind(rows)[WORDS]:
        words = _UNPRESS.decompress(r["a"]).split(b"\n")
        asked.append((r["peer"], np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)), unpack(r["b"])))
    if len(index) * buckets > _LOW:
        raise ValueError(f"more words than {BITS} bits number")
    totals = np.zeros(len(index), dtype=np.int64)
    for _, numbers, n in asked:
        totals[numbers] += n
    for chunk, numbers, _ in asked:
        out.add(NUMBERS, chunk, bucket, pack(numbers * buckets + bucket), pack(totals[numbers]))
    out.add(VOCABULARY, bucket, 0, pack(totals), sums=((totals > 0).sum(), totals.sum()))
    return out.table()


# Pairs

@dataclass
class Pairs:
    """The distinct pairs of a chunk, by bucket and pair, and where its tokens' pairs are among them."""

    u: np.ndarray
    w: np.ndarray
    n: np.ndarray  # occurrences in training texts
    bucket: np.ndarray
    of_token: np.ndarray


def _pairs(local: np.ndarray, before: np.ndarray, train: np.ndarray, numbers: np.ndarray, counts: np.ndarray, buckets: int) -> Pairs:
    key = numbers[before] << BITS | numbers[local]
    order = np.argsort(key)
    ranked = key[order]
    begins = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.flatnonzero(begins)
    n = np.add.reduceat(train[order].astype(np.int64), at)
    u, w = ranked[at] >> BITS, ranked[at] & _LOW
    splits = 1 + counts[before[order[at]]] // SPLIT
    bucket = (u % buckets + w // buckets % splits) % buckets
    by_bucket = np.argsort(bucket, kind="stable")
    rank = np.empty_like(by_bucket)
    rank[by_bucket] = np.arange(len(by_bucket))
    of_token = np.empty_like(order)
    of_token[order] = rank[np.cumsum(begins) - 1]
    return Pairs(u[by_bucket], w[by_bucket], n[by_bucket], bucket[by_bucket], of_token)


class Chunk:
    """A chunk's rows, with the numbers of its words."""

    def __init__(self, kinds: dict[int, list[dict]]):
        row = kinds[CHUNK][0]
        self.place, self.local, self.lengths, self.held = row["at"], unpack(row["a"]), unpack(row["b"]), unpack(row["c"]) == 1
        self.ids = [None if none else i for i, none in zip(np.frombuffer(row["d"], dtype="<i8").tolist(), unpack(row["e"]).tolist(), strict=True)]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.before = np.concatenate([self.local[-1:], self.local[:-1]])  # every text ends in the end token, the context of the next one's first
        self.numbers, self.counts = (np.concatenate([unpack(r[x]) for r in kinds[NUMBERS]]) for x in "ab")

    def pairs(self, buckets: int) -> Pairs:
        return _pairs(self.local, self.before, np.repeat(~self.held, self.lengths), self.numbers, self.counts, buckets)


def _give_pairs(rows: pa.Table, buckets: int) -> pa.Table:
    chunk, out = Chunk(by_kind(rows)), Rows()
    pairs = chunk.pairs(buckets)
    for bucket, (u, w, n) in deal(pairs.bucket, pairs.u, pairs.w, pairs.n):
        out.add(PAIRS, bucket, chunk.place, pack_sorted(u), pack(w), pack(n))
    return out.table()


def _merged(given: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct pairs of a bucket, their occurrences, and where each chunk's pairs are among them."""
    keys = [unpack_sorted(r["a"]) << BITS | unpack(r["b"]) for r in given]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([unpack(r["c"]) for r in given]), minlength=len(found)).astype(np.int64)
    return found, n, np.split(at, np.cumsum([len(k) for k in keys])[:-1])


# Seating

def estimate(ones: float, twos: float) -> float:
    """A discount from the numbers of dishes with one and two customers."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


def start(rng: np.random.Generator, n: np.ndarray, others, discount: float, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A seating to begin with: tables of n customers that come in lumps of a sixteenth, and customers by table (others: tables of other dishes)."""
    t = (n > 0).astype(np.int64)
    order = np.argsort(-n, kind="stable")
    sizes, seated = n[order], 1
    others, parent, tables = np.broadcast_to(np.asarray(others, dtype=np.float64), n.shape)[order], parent[order], t[order]
    while (m := int(np.searchsorted(-sizes, -seated, side="left"))) > 0:
        step = max(1, seated // 16)
        new = (STRENGTH + discount * (others[:m] + tables[:m])) * parent[:m]
        tables[:m] += rng.binomial(np.minimum(step, sizes[:m] - seated), new / (new + np.maximum(seated - discount * tables[:m], 1e-9)))
        seated += step
    t[order] = tables
    customers = np.ones(int(t.sum()), dtype=np.int64)
    customers[(np.cumsum(t) - t)[t > 0]] = (n - t + 1)[t > 0]
    return t, customers


def reseat(rng: np.random.Generator, n: np.ndarray, t: np.ndarray, customers: np.ndarray, at: np.ndarray, tables: np.ndarray, parent: np.ndarray, discount: float, moves: int = MOVES) -> tuple[np.ndarray, np.ndarray]:
    """Gibbs moves of dishes of n > 0 customers at t tables; customers: by table, dish after dish.

    at: a dish's restaurant; tables: of each restaurant in all, kept up to date. Each move takes a random customer of each dish out and
    seats it again given all others.
    """
    if not len(n):
        return t, customers
    ends = np.cumsum(t + moves)
    first = ends - t - moves
    seats = np.zeros(int(ends[-1]), dtype=np.int64)
    seats[np.arange(len(customers)) + np.repeat(first - (np.cumsum(t) - t), t)] = customers
    free, t = first + t, t.copy()
    for _ in range(moves):
        sums = np.cumsum(seats)
        slot = np.searchsorted(sums, sums[first] - seats[first] + rng.integers(0, n), side="right")
        seats[slot] -= 1
        closed = seats[slot] == 0
        t -= closed
        tables -= np.bincount(at[closed], minlength=len(tables))
        new = (STRENGTH + discount * tables[at]) * parent
        x = rng.random(len(n)) * (new + n - 1 - discount * t)
        opens = (x < new) | (t == 0)
        weights = np.where(seats > 0, seats - discount, 0.0)
        sums = np.cumsum(weights)
        slot = np.searchsorted(sums, sums[first] - weights[first] + x - new, side="right")
        slot = np.where(opens, free, np.clip(slot, first, ends - 1))
        fresh = seats[slot] == 0
        seats[slot] += 1
        free += opens
        t += fresh
        tables += np.bincount(at[fresh], minlength=len(tables))
    return np.add.reduceat((seats > 0).astype(np.int64), first), seats[seats > 0]


@dataclass
class Totals:
    """What the driver knows: buckets, known words and training tokens, discounts, and the parent's customers and tables."""

    buckets: int
    types: int
    tokens: int
    own: float = 0.5
    root: float = 0.5
    customers: int = 0
    tables: int = 0

    def parent(self, customers: np.ndarray, tables: np.ndarray, of=None) -> np.ndarray:
        """The parent's probabilities of words with so many customers and tables there."""
        all_customers, all_tables = of or (self.customers, self.tables)
        return (np.maximum(customers - self.root * tables, 0) + (STRENGTH + self.root * all_tables) / (self.types + 1)) / (STRENGTH + all_customers)


def _tell(out: Rows, bucket: int, buckets: int, w: np.ndarray, t: np.ndarray, contexts: np.ndarray, tables: np.ndarray, n: np.ndarray) -> None:
    """A bucket's tables by word and by context, to the buckets of these words."""
    words, at = np.unique(w, return_inverse=True)
    sums = np.bincount(at, weights=t, minlength=len(words)).astype(np.int64)
    of_words, of_contexts = dict(deal(words % buckets, words, sums)), dict(deal(contexts % buckets, contexts, tables, n))
    none = np.zeros(0, dtype=np.int64)
    for to in sorted(of_words.keys() | of_contexts.keys()):
        mine, s = of_words.get(to, (none, none))
        u, tu, nu = of_contexts.get(to, (none, none, none))
        out.add(TOLD, to, bucket, pack_sorted(mine), pack(s), pack_sorted(u), pack(tu), pack(nu))


def _count_pairs(rows: pa.Table, buckets: int) -> pa.Table:
    """A bucket's pairs of training texts: those met once as sums, the others as dishes at one table."""
    out, bucket = Rows(), rows.column("at")[0].as_py()
    keys, n, _ = _merged(by_kind(rows)[PAIRS])
    keys, n = keys[n > 0], n[n > 0]
    u, w, once = keys >> BITS, keys & _LOW, n == 1
    contexts, at = np.unique(u, return_inverse=True)
    of, ones = np.bincount(at, weights=n, minlength=len(contexts)).astype(np.int64), np.bincount(at[once], minlength=len(contexts))
    many, one = n[~once], np.ones(int((~once).sum()), dtype=np.int64)
    out.add(SEATS, bucket, 0, pack_sorted(u[~once]), pack(w[~once]), pack(many), pack(one), pack(many), pack(0 * one), sums=(len(keys), once.sum(), (n == 2).sum()))
    out.add(CONTEXTS, bucket, 0, pack_sorted(contexts), pack(of), pack(ones))
    single, m = np.unique(w[once], return_counts=True)
    for to, (mine, count) in deal(single % buckets, single, m):
        out.add(ONES, to, bucket, pack_sorted(mine), pack(count))
    _tell(out, bucket, buckets, w[~once], one, contexts, np.bincount(at, minlength=len(contexts)), of)
    return out.table()


def _seat_words(rows: pa.Table, totals: Totals, sweep: int, sample: int | None) -> pa.Table:
    """The parent's restaurant in a bucket of words: its customers are the tables that it is told of."""
    kinds, out, bucket = by_kind(rows), Rows(), rows.column("at")[0].as_py()
    fixed = unpack(kinds[VOCABULARY][0]["a"])
    if ONES in kinds or sweep == 0:  # the vocabulary's counts have served; from here on it holds the tables of pairs met once
        fixed = np.zeros_like(fixed)
        for r in kinds.get(ONES, []):
            fixed[unpack_sorted(r["a"]) // totals.buckets] += unpack(r["b"])
    customers, tables, n = fixed.copy(), np.zeros_like(fixed), np.zeros_like(fixed)
    told = [(r["peer"], unpack_sorted(r["a"]) // totals.buckets, unpack(r["b"]), unpack_sorted(r["c"]) // totals.buckets, unpack(r["d"]), unpack(r["e"])) for r in kinds.get(TOLD, [])]
    for _, w, t, u, tu, nu in told:
        customers[w] += t
        tables[u] += tu
        n[u] += nu
    rng, base = np.random.default_rng([1, sweep, bucket]), np.full(len(fixed), 1 / (totals.types + 1))
    seated, by_table = start(rng, customers, float(totals.tables), totals.root, base)
    many = customers > 1
    moved, _ = reseat(rng, customers[many], seated[many], by_table[np.repeat(many, seated)], np.zeros(int(many.sum()), dtype=np.int64), np.array([totals.tables]), base[many], totals.root)
    seated[many] = moved
    answer = totals.parent(customers, seated)
    for peer, w, _, u, _, _ in told:
        out.add(REPLY, peer, bucket, answer[w].astype("<f8").tobytes(), pack(tables[u]))
    out.add(VOCABULARY, bucket, 0, pack(fixed), sums=(customers.sum(), seated.sum(), (customers == 1).sum(), (customers == 2).sum()))
    if sample is not None:
        out.add(SAMPLE, bucket, sample, pack(customers), pack(seated), pack(tables), pack(n))
    return out.table()


def _seat_pairs(rows: pa.Table, totals: Totals, sweep: int, keep: bool) -> pa.Table:
    """A sweep over a bucket's pairs."""
    kinds, out, bucket = by_kind(rows), Rows(), rows.column("at")[0].as_py()
    seats, of = kinds[SEATS][0], kinds[CONTEXTS][0]
    u, w, n, t, customers, sampled = unpack_sorted(seats["a"]), *(unpack(seats[x]) for x in "bcdef")
    contexts, total, ones = unpack_sorted(of["a"]), unpack(of["b"]), unpack(of["c"])
    words, word = np.unique(w, return_inverse=True)
    parent, tables = np.zeros(len(words)), np.zeros(len(contexts), dtype=np.int64)
    for r in kinds.get(REPLY, []):
        parent[words % totals.buckets == r["peer"]] = np.frombuffer(r["a"], dtype="<f8")
        tables[contexts % totals.buckets == r["peer"]] = unpack(r["b"])
    rng, at = np.random.default_rng([2, sweep, bucket]), np.searchsorted(contexts, u)
    if sweep == 0:
        before = t
        t, customers = start(rng, n, tables[at] - t, totals.own, parent[word])
        tables += np.bincount(at, weights=t - before, minlength=len(contexts)).astype(np.int64)
    t, customers = reseat(rng, n, t, customers, at, tables, parent[word], totals.own)
    mine = ones + np.bincount(at, weights=t, minlength=len(contexts)).astype(np.int64)
    out.add(SEATS, bucket, 0, seats["a"], seats["b"], seats["c"], pack(t), pack(customers), pack(sampled + t * keep), sums=(mine.sum(),))
    out.add(CONTEXTS, bucket, 0, of["a"], of["b"], of["c"])
    _tell(out, bucket, totals.buckets, w, t, contexts, mine, total)
    return out.table()


# Scoring

def _answer_pairs(rows: pa.Table) -> pa.Table:
    """Occurrences and sampled tables of the pairs that chunks gave, in their order."""
    kinds, out, bucket = by_kind(rows), Rows(), rows.column("at")[0].as_py()
    keys, n, asked = _merged(kinds[PAIRS])
    seats, tables = kinds[SEATS][0], np.where(n == 1, SAMPLES, 0)
    tables[np.searchsorted(keys, unpack_sorted(seats["a"]) << BITS | unpack(seats["b"]))] = unpack(seats["f"])
    for r, at in zip(kinds[PAIRS], asked, strict=True):
        out.add(OF_PAIRS, r["peer"], bucket, pack(n[at]), pack(tables[at]))
    return out.table()


def _answer_words(rows: pa.Table, buckets: int) -> pa.Table:
    """What the samples say of the words of chunks: customers of their own restaurant, its tables, and their customers and tables at the parent."""
    kinds, out, bucket = by_kind(rows), Rows(), rows.column("at")[0].as_py()
    customers, seated, tables = (np.stack([unpack(r[x]) for r in kinds[SAMPLE]]) for x in "abc")
    own = unpack(kinds[SAMPLE][0]["d"])
    for r in kinds.get(ASKED, []):
        at = unpack(r["a"]) // buckets
        out.add(OF_WORDS, r["peer"], bucket, pack(own[at]), *(pack(x[:, at].ravel()) for x in (tables, customers, seated)))
    return out.table()


_SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def predict(n: np.ndarray, sampled: np.ndarray, of: np.ndarray, tables: np.ndarray, parents: np.ndarray, own: float) -> np.ndarray:
    """Averaged predictive probabilities of words after contexts.

    n, sampled: the pair's occurrences and its tables over all samples; of: customers of the context; tables, parents: its tables and the
    word's probability at the parent, by sample.
    """
    return (n - own * sampled / len(tables) + ((STRENGTH + own * tables) * parents).mean(axis=0)) / (STRENGTH + of)


def _score_chunk(rows: pa.Table, totals: Totals, samples: list[tuple[int, int]]) -> pa.Table:
    kinds = by_kind(rows)
    chunk = Chunk(kinds)
    pairs = chunk.pairs(totals.buckets)
    of = np.concatenate([unpack(r["a"]) for r in kinds[OF_WORDS]])
    tables, customers, seated = (np.concatenate([unpack(r[x]).reshape(SAMPLES, -1) for r in kinds[OF_WORDS]], axis=1) for x in "bcd")
    parents = np.stack([totals.parent(c, t, s) for c, t, s in zip(customers, seated, samples, strict=True)])
    n, sampled = (np.concatenate([unpack(r[x]) for r in kinds[OF_PAIRS]])[pairs.of_token] for x in "ab")
    before, word = chunk.before, chunk.local
    scores = np.log10(predict(n, sampled, of[before], tables[:, before], parents[:, word], totals.own))
    base = np.log10((chunk.counts + 0.5) / (totals.tokens + 0.5 * (totals.types + 1)))[word]
    added = [np.add.reduceat(x, chunk.starts) for x in ((chunk.counts > 0)[word].astype(np.int64), base, scores)]
    columns = [pa.array(chunk.ids, pa.int64()), pa.array(chunk.held), pa.array(chunk.lengths), pa.array(added[0]), pa.array(np.full(len(chunk.ids), totals.tokens)), pa.array(added[1]), pa.array(added[2])]
    return pa.table(columns, [x.split()[0] for x in _SCORED.split(", ")])


def _of(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.filter(F.col("kind").isin(*kinds))


@dataclass
class Model:
    """A fitted model: chunks and numbers of the texts, given pairs, seats after the last sweep, samples, and totals."""

    chunks: DataFrame
    numbers: DataFrame
    given: DataFrame
    seats: DataFrame
    samples: DataFrame
    totals: Totals
    of_samples: list[tuple[int, int]]
    groups: int


def _apply(rows: DataFrame, groups: int, step: Callable[..., pa.Table], *facts, schema: str = ROW) -> DataFrame:
    """step(rows, *facts) for all rows of each ``at``."""
    return rows.repartition(min(groups, TASKS), "at").groupBy("at").applyInArrow(lambda group: step(group, *facts), schema)


def fit(docs: DataFrame) -> Model:
    """Number the words of docs (doc_id, text), count their pairs and sample the seating."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held", held_out())
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()[0]
    buckets, groups = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // CHUNK_BYTES))
    read = materialize(texts.mapInArrow(_reader(buckets), ROW), "lm-read")
    numbered = materialize(_apply(_of(read, WORDS), buckets, _number_words, buckets), "lm-numbers")
    facts = _of(numbered, VOCABULARY).agg(F.sum("x").alias("types"), F.sum("y").alias("tokens")).first()
    totals = Totals(buckets, facts.types or 0, facts.tokens or 0)
    chunks, numbers = _of(read, CHUNK), _of(numbered, NUMBERS)
    given = materialize(_apply(chunks.unionByName(numbers), groups, _give_pairs, buckets), "lm-pairs")
    pairs = materialize(_apply(given, buckets, _count_pairs, buckets), "lm-seats")
    facts = _of(pairs, SEATS).agg(F.sum("x").alias("tables"), F.sum("y").alias("ones"), F.sum("p").alias("twos")).first()
    totals.own, totals.customers, totals.tables = estimate(facts.ones or 0, facts.twos or 0), facts.tables or 0, totals.types
    words, samples, of_samples = numbered, [], []
    for sweep in range(BURN_IN + SAMPLES + 1):  # the words' last turn takes up the last sample
        sample = sweep - 1 - BURN_IN if sweep > BURN_IN else None
        told = _of(words, VOCABULARY).unionByName(_of(pairs, ONES, TOLD))
        seated = materialize(_apply(told, buckets, _seat_words, Totals(**vars(totals)), sweep, sample), "lm-words")
        facts = _of(seated, VOCABULARY).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "xypq")).first()
        totals.tables = facts.y
        if sweep == 0:
            totals.root = estimate(facts.p, facts.q)
        if sample is not None:
            samples.append(_of(seated, SAMPLE))
            of_samples.append((facts.x, facts.y))
        if sweep < BURN_IN + SAMPLES:
            moved = materialize(_apply(_of(pairs, SEATS, CONTEXTS).unionByName(_of(seated, REPLY)), buckets, _seat_pairs, Totals(**vars(totals)), sweep, sweep >= BURN_IN), "lm-seats")
            discard(pairs)
            pairs = moved
            totals.customers = _of(pairs, SEATS).agg(F.coalesce(F.sum("x"), F.lit(0))).first()[0]
        if words is not numbered and sample is None:
            discard(words)
        words = seated
    every = samples[0]
    for s in samples[1:]:
        every = every.unionByName(s)
    return Model(chunks, numbers, given, _of(pairs, SEATS), every, totals, of_samples, groups)


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    model = fit(docs)
    totals, buckets, samples = model.totals, model.totals.buckets, model.of_samples
    of_pairs = materialize(_apply(model.given.unionByName(model.seats), buckets, _answer_pairs), "lm-of-pairs")
    discard(model.given)
    asked = model.numbers.select(F.lit(ASKED).alias("kind"), F.col("peer").alias("at"), F.col("at").alias("peer"), *_NAMES[3:])
    of_words = materialize(_apply(asked.unionByName(model.samples), buckets, _answer_words, buckets), "lm-of-words")
    rows = model.chunks.unionByName(model.numbers).unionByName(of_pairs).unionByName(of_words)
    return _apply(rows, model.groups, _score_chunk, totals, samples, schema=_SCORED)
