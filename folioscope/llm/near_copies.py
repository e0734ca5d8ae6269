"""What SimHash leaves in the corpus pipeline: all pairs of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash alone cannot find these: at that similarity five-word fingerprints differ in about
ten of 64 bits, often in 17, a radius that no table of segments serves. So op2's links of
fingerprints come in as they are (``fingerprints=True``), and a prefix-filtered join, which
loses no pair, adds the others. Shingles have one
order for all texts; two similar texts share one among their first n - ceil(0.8 n) + 1
(n: distinct shingles), at a place that leaves enough for the overlap. So a text gives
that prefix as rows (key, node, size, pos) and rows of a key meet. Candidates first compare
parities: bit h mod 2 ** k of a text is flipped for each shingle hash h, so two texts differ
in no more bits than they have shingles apart. What that cannot rule out is verified over
all shingles. The order puts shingles that a sample finds common last; it
steers the cost, never the result.

A node is a distinct sequence of words (its 64-bit hash), so copies make no pairs. Where
more than ``CROWDED`` nodes share a key, they first meet a few pivots; what that connects
is one component, and only nodes of different components are then paired, where their parities
(folded to 256 bytes) leave it possible.

Words and shingles are those of op2: ASCII white space, A-Z in lower case; fewer words
than a shingle make one shingle; texts without words are copies of each other, null and
empty ones among them. Columns beside doc_id and text pass through, whatever their names; an
empty table stays empty. One very long text is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import simhash
from folioscope.llm.common import materialize
from folioscope.llm.components import components
from folioscope.llm.tokens import slices

SHINGLE = 5
#: Similarity as a fraction: 4 / 5.
OVER, UNDER = 4, 5
CROWDED, PIVOTS = 32, 4
#: Texts sampled for the order of shingles, and common shingles kept of them at most.
SAMPLE, COMMON = 20_000, 300_000
_ROWS = "doc_id bigint, key bigint, node bigint, size int, pos int, parity binary, fp bigint"
_MET = "a bigint, b bigint, key bigint, node bigint, size int, pos int"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _node(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 7) - 2**63


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    grams = {b" ".join(words)} if len(words) < SHINGLE else set(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))
    digest = xxhash.xxh64_intdigest
    return np.sort(np.fromiter((digest(g, 42) for g in grams), dtype=np.uint64, count=len(grams)).view(np.int64))


def parity(s: np.ndarray) -> np.ndarray:
    """How often each place modulo a power of two (at least twice the shingles) is hit, odd or even, as packed bits."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits).astype(np.uint8) & 1)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Differing bits of two parities; the longer one is folded."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in several texts of a sample, sorted, and in how many."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, "text"):
            for t in texts:
                yield pa.RecordBatch.from_arrays([pa.array(shingles(_words(t)))], ["key"])

    found = docs.sample(share, 5).select("doc_id", "text").mapInArrow(run, "key bigint").groupBy("key").count().filter("count > 1")
    rows = found.orderBy(F.desc("count"), "key").limit(COMMON).toPandas().sort_values("key")
    return rows["key"].to_numpy(dtype=np.int64), rows["count"].to_numpy(dtype=np.int64)


def _prefixes(docs: DataFrame, fingerprints: bool) -> DataFrame:
    """A row (doc_id, node) for each text, and the rows (key, node, size, pos) of its prefix, its parity and perhaps fingerprint once a task for each node."""
    common, times = _common(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, texts in slices(batches, "text"):
            nodes, sizes_of, parities, fps, keys, owner, sizes, places = [], [], [], [], [], [], [], []
            for t in texts:
                words = _words(t)
                nodes.append(node := _node(words))
                fps.append(simhash.fingerprint(t) if fingerprints and node not in seen else None)
                if node in seen or not words:
                    sizes_of.append(None)
                    parities.append(None)
                    continue
                seen.add(node)
                s = shingles(words)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    s = s[np.argsort(np.where(common[at] == s, times[at], 0), kind="stable")]
                n = len(s)
                sizes_of.append(n)
                parities.append(parity(s).tobytes())
                first = n + (-OVER * n // UNDER) + 1
                keys.append(s[:first])
                owner.append(np.full(first, node, dtype=np.int64))
                sizes.append(np.full(first, n, dtype=np.int32))
                places.append(np.arange(first, dtype=np.int32))
            none, names = pa.nulls, ["doc_id", "key", "node", "size", "pos", "parity", "fp"]
            yield pa.RecordBatch.from_arrays([rows.column(0), none(len(nodes), pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes_of, pa.int32()), none(len(nodes), pa.int32()), pa.array(parities, pa.binary()), pa.array(fps, pa.int64())], names)
            if keys:
                parts = [pa.array(np.concatenate(x)) for x in (keys, owner, sizes, places)]
                yield pa.RecordBatch.from_arrays([none(len(parts[0]), pa.int64()), *parts, none(len(parts[0]), pa.binary()), none(len(parts[0]), pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROWS)


def _can(size: np.ndarray, pos: np.ndarray, other_size, other_pos) -> np.ndarray:
    """Whether texts that meet first at these places of their prefixes may be similar."""
    both = size + other_size
    rest = np.minimum(size - pos, other_size - other_pos)
    return (UNDER * np.minimum(size, other_size) >= OVER * np.maximum(size, other_size)) & ((OVER + UNDER) * rest >= OVER * both)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by key, in pieces that end where a key ends."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        now = {x: batch.column(i).to_numpy(zero_copy_only=False) for i, x in enumerate(batch.schema.names)}
        last = int(np.searchsorted(now["key"], now["key"][-1]))
        if last or (held and held[-1]["key"][-1] != now["key"][0]):
            yield {x: np.concatenate([*(h[x] for h in held), now[x][:last]]) for x in now}
            held = []
        held.append({x: v[last:] for x, v in now.items()})
    if held:
        yield {x: np.concatenate([h[x] for h in held]) for x in held[0]}


def _keys(piece: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each key that more than one node has, each node once."""
    key, node = piece["key"], piece["node"]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    piece = {x: v[new] for x, v in piece.items()}
    key = piece["key"]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(key))
    several = ends - starts > 1
    for s, e in zip(starts[several].tolist(), ends[several].tolist()):
        yield {x: v[s:e] for x, v in piece.items()}


def _meet(crowded: int):
    """Pairs (a, b) of nodes under a key; of crowded keys, pairs with the pivots and the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "key", "node", "size", "pos"]
        for piece in _runs(batches):
            a, b = [], []
            for x in _keys(piece):
                n, node, size, pos = len(x["node"]), x["node"], x["size"].astype(np.int64), x["pos"].astype(np.int64)
                for i in range(n - 1) if n <= crowded else np.linspace(0, n - 1, PIVOTS).astype(int).tolist():
                    near = _can(size, pos, size[i], pos[i])
                    near[: i + 1 if n <= crowded else 0] = False
                    near[i] = False
                    near = node[near]
                    a.append(np.minimum(near, node[i]))
                    b.append(np.maximum(near, node[i]))
                if n > crowded:
                    rows = [pa.nulls(n, pa.int64())] * 2 + [pa.array(x[c]) for c in names[2:]]
                    yield pa.RecordBatch.from_arrays(rows, names)
            if a:
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
                n = len(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *([pa.nulls(n, pa.int64())] * 2), *([pa.nulls(n, pa.int32())] * 2)], names)

    return run


def folded(x: bytes, most: int = 256) -> np.ndarray:
    """A parity folded to ``most`` bytes at most: two texts still differ in no more bits than they have shingles apart."""
    out = np.frombuffer(x, dtype=np.uint8)
    while len(out) > most:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes under a crowded key that are in different components and whose parities do not rule them out."""
    for piece in _runs(batches):
        for x in _keys(piece):
            node, size, pos = x["node"], x["size"].astype(np.int64), x["pos"].astype(np.int64)
            kinds, of, count = np.unique(x["component"], return_inverse=True, return_counts=True)
            if len(kinds) == 1:
                continue
            largest, done = int(count.argmax()), np.zeros(len(node), dtype=bool)
            for i in np.flatnonzero(of != largest).tolist():
                done[i] = True
                near = np.flatnonzero((of != of[i]) & ~done & _can(size, pos, size[i], pos[i]))
                own = folded(x["parity"][i])
                near = node[[j for j in near.tolist() if (OVER + UNDER) * apart(own, folded(x["parity"][j])) <= (UNDER - OVER) * (size[i] + size[j])]]
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(near, node[i])), pa.array(np.maximum(near, node[i]))], ["a", "b"])


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "node")


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            keep.append((OVER + UNDER) * apart(np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)) <= (UNDER - OVER) * (n + m))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that are similar over all their shingles."""
    named = rows.filter("doc_id is not null").select("doc_id", "node")
    parities = rows.filter("parity is not null").groupBy("node").agg(F.first("size").alias("n"), F.first("parity").alias("x"))  # equal for a node
    others = parities.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("x").alias("y"))
    met = pairs.distinct().join(parities.withColumnRenamed("node", "a"), "a").join(others, "b").select("a", "b", "n", "m", "x", "y")
    pairs = materialize(met.mapInArrow(_likely, "a bigint, b bigint"), "near-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = named.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "text"):
            found = [(n, shingles(w).tobytes()) for n, t in zip(rows.column(0).to_pylist(), texts) if _node(w := _words(t)) == n]  # of rows that repeat an id, those of this text
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["node", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(first, "doc_id").select("node", "text")
    sets = materialize(texts.mapInArrow(whole, "node bigint, s binary"), "near-sets")
    one = sets.select(F.col("node").alias("a"), F.col("s").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("s").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)
                keep.append((OVER + UNDER) * len(np.intersect1d(x, y, assume_unique=True)) >= OVER * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return materialize(met.mapInArrow(compare, "a bigint, b bigint"), "near-links")


def _near_fingerprints(rows: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that connect all whose fingerprints are linked: each to the least of its fingerprint, those to each other."""
    of = rows.filter("fp is not null").select("fp", "node").distinct()
    least = materialize(of.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    equal = of.join(least, "fp").select(F.col("node").alias("a"), F.col("first").alias("b")).filter("a != b")
    near = simhash.links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return equal.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def keep_one(docs: DataFrame, fingerprints: bool = False) -> DataFrame:
    """docs without near-duplicates: of each group that similar pairs connect, the row of least doc_id stays (rows of null id stay).

    fingerprints: op2's links connect, too. Rows of one doc_id count as one document: they stay or go together, equal
    texts among them once.
    """
    known = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    rows = materialize(_prefixes(known, fingerprints), "near-prefixes")
    named = rows.filter("doc_id is not null").select("doc_id", "node")
    met = materialize(_by_key(rows.filter("key is not null").select("key", "node", "size", "pos")).mapInArrow(_meet(CROWDED), _MET), "near-met")
    links = _verified(known, rows, met.filter("a is not null").select("a", "b"))
    if fingerprints:
        links = materialize(links.unionByName(_near_fingerprints(rows)), "near-all-links")
    found = components(links)
    crowded = met.filter("key is not null").select("key", "node", "size", "pos")
    if not crowded.isEmpty():
        placed = crowded.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).filter("key is not null")
        parities = rows.filter("parity is not null").groupBy("node").agg(F.first("parity").alias("parity"))  # equal for a node
        told = placed.join(parities, "node").select("key", "node", "size", "pos", "component", "parity")
        across = _by_key(told).mapInArrow(_across, "a bigint, b bigint")
        found = components(links.unionByName(_verified(known, rows, across)))
    joined = named.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = joined.groupBy("component").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    if not named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # so that no column clashes with the hash
        hashed = kept.select(whole, F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
        kept = hashed.dropDuplicates(["id", "hash"]).select("row.*")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
