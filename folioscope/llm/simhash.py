"""Operator 2: SimHash near-duplicates by multi-index hashing.

A document's shingles (word n-grams, repeats included) are hashed by XXH64; a
fingerprint bit is set if more than half of the hashes have it. Fingerprints are
linked at ``RADIUS`` = 3 or fewer differing bits: of two halves of 32 bits one then
differs in one bit at most. So every distinct fingerprint enters a table under each
of its halves and probes that table with the half itself and its ball of radius
one; matches are verified over all 64 bits. Of two halves that differ in a bit,
one has it unset, so only unset bits are flipped.

Equal fingerprints are one row from the start, so copies make no links at all. A
half that many fingerprints share (near copies) would make a square of pairs: such
crowded halves are dealt into blocks by hash, pairs of blocks are compared within
tasks, and only links that connect something new in their block pair come out.

Null and empty texts, and texts of white space, have no shingle: fingerprint zero,
linked like any other. Fewer words than a shingle make one shingle of all words.
Documents of null id have a fingerprint but cannot name a component: null. Repeated
doc_ids each keep their row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialize
from folioscope.llm.components import components
from folioscope.llm.tokens import slices

RADIUS = 3
#: A half that more fingerprints share is crowded; blocks of a crowded half have about so many.
CROWDED, BLOCK = 64, 4096
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text, as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, 42) for g in grams], dtype="<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, text):
            fps = pa.array([fingerprint(t, shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), fps], [key, "fp"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"`{key}` bigint, fp bigint")


def _halves(fps: DataFrame) -> DataFrame:
    """fp under each of its halves: half, value (32 bits)."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    both = F.array(*(F.struct(F.lit(h).alias("half"), v.alias("value")) for h, v in ((0, low), (1, high))))
    return fps.select("fp", F.explode(both).alias("h")).select("fp", "h.half", "h.value")


def _spanning(fps: np.ndarray, others: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links at ``radius`` or less between two blocks that connect what was not connected: fewer than there are rows."""
    every = np.unique(np.concatenate([fps, others]))
    root = np.arange(len(every))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    right = np.searchsorted(every, others)
    for f, i in zip(fps, np.searchsorted(every, fps)):
        near = right[np.bitwise_count(others ^ f) <= radius]
        if len(near):
            here = find(int(i))
            for j in np.unique(root[near]):
                there = find(int(j))
                if there != here:
                    root[there] = here
                    yield int(every[i]), int(every[j])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to connect all that lie within radius of each other."""
    if radius != RADIUS:
        raise ValueError("two halves and balls of radius one are for a radius of 3")
    entries = materialize(_halves(fps), "simhash-table")
    ball = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    unset = F.filter(ball, lambda b: F.col("value").bitwiseAND(b) == 0)
    keys = F.concat(F.array(F.col("value")), F.transform(unset, lambda b: F.col("value") + b))
    probes = entries.select("fp", "half", F.explode(keys).alias("value"), F.col("value").alias("own"))
    crowded = entries.groupBy("half", "value").count().filter(F.col("count") > CROWDED).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    crowded = materialize(crowded, "simhash-crowded")
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp"))) <= radius
    once = (F.col("p.own") != F.col("p.value")) | (F.col("p.fp") < F.col("t.fp"))
    calm = entries.join(crowded, ["half", "value"], "left_anti")
    found = probes.alias("p").join(calm.alias("t"), (F.col("p.half") == F.col("t.half")) & (F.col("p.value") == F.col("t.value")) & near & once)
    pairs = found.select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
    if crowded.isEmpty():
        return pairs
    # Crowded halves: the table's block i meets the probes' block j in the group (half, value, i, j).
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    columns = ["half", "value", "i", "j", "fp", "probe"]
    table = entries.join(crowded, ["half", "value"]).withColumn("i", block).withColumn("j", F.explode(every)).withColumn("probe", F.lit(False))
    asked = probes.join(crowded, ["half", "value"]).withColumn("j", block).withColumn("i", F.explode(every)).withColumn("probe", F.lit(True))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, probe = group["fp"].to_numpy(), group["probe"].to_numpy()
        out = list(_spanning(fp[~probe], fp[probe], radius))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    met = table.select(columns).unionByName(asked.select(columns)).groupBy("half", "value", "i", "j").applyInPandas(compare, "a long, b long")
    return pairs.unionByName(met)


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs (doc_id, text) to doc_id, fp, component_id: one row for each row of docs."""
    rows = materialize(fingerprints(docs, shingle), "simhash")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    found = components(links(classes.select("fp")))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_class = named.select("fp", "component").join(firsts, "component").select("fp", "component_id")
    joined = rows.join(of_class, "fp")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
