"""Operator 12: a Merkle manifest of a table, with a proof for each row, by lag and lead windows.

A leaf is the hash of a row's values. In each group the leaves ascend by key; every ``ARITY``
consecutive nodes have their hash, inputs concatenated, as parent, until one node is left, the
group's subroot. Subroots in order of group (null first) are the leaves of one more such tree.

At each level a node's place gives its slot in its run and the run's length; lag and lead
columns at the fixed offsets 1 to ``ARITY`` - 1, masked by slot and run length, are its left
and right siblings, and the first node of each run hashes itself and its leads to the parent.
Windows are partitioned by group and run, so that a group with a third of all rows is as many
partitions as it has runs. Places in a group come from range partitions: rows before a
partition by a sum over one row a partition and group, the rest by a row number inside it.

Levels above the leaves are a sixteenth each; all are written. From the root down every node
then takes its parent's path (left and right siblings of each level), so a leaf reads one
row of the level above it for each run. All is DataFrame expressions.

Null values are "-" in the leaf's input. Rows of null key come first in their group and are
never tampered with; equal keys are ordered by leaf, so equal rows are interchangeable. A
table of one row is its own root with an empty proof; an empty table gives no rows. Other
columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import discard, materialize

ARITY = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def value(column: Column) -> Column:
    """A value in a leaf's input: "-", or its UTF-8 length, a colon and itself."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_az(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def _placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with place (from 0) and size of their group ``g``, written; and the sizes."""
    parts = materialize(rows.repartitionByRange("g", *(F.col(c).asc_nulls_first() for c in order)).withColumn("_part", F.spark_partition_id()), "merkle-parts")
    counts = parts.groupBy("g", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = counts.select("g", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy("g")).alias("size"))
    inside = Window.partitionBy("g", "_part").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    found = parts.withColumn("_nth", F.row_number().over(inside)).join(bases, ["g", "_part"])
    out = materialize(found.select(*rows.columns, (F.col("_base") + F.col("_nth") - 1).alias("place"), "size"), "merkle-leaves")
    discard(parts)
    return out, out.groupBy("g").agg(F.first("size").alias("size"))


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes (g, place, size, hash, ...) with run, slot, left, right and, in slot 0, parent."""
    run = nodes.withColumn("run", F.expr(f"place div {ARITY}")).withColumn("slot", (F.col("place") % ARITY).cast("int"))
    run = run.withColumn("length", F.least(F.lit(ARITY), F.col("size") - F.col("run") * ARITY))
    along = Window.partitionBy("g", "run").orderBy("place")
    before = [F.when(F.col("slot") >= i, F.lag("hash", i).over(along)) for i in range(ARITY - 1, 0, -1)]
    after = [F.when(F.col("slot") + i < F.col("length"), F.lead("hash", i).over(along)) for i in range(1, ARITY)]
    known = run.select("*", F.concat_ws("", *before).alias("left"), F.concat_ws("", *after).alias("right"))
    return known.withColumn("parent", F.when(F.col("slot") == 0, digest("hash", "right"))).drop("length")


def _levels(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """The levels above the leaves, each written, with the siblings of its nodes; the last has one node in each group."""
    levels, below, left_over = [], _with_siblings(leaves), largest
    while left_over > 1:
        parents = below.filter("parent is not null and size > 1").select("g", F.col("run").alias("place"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"), F.col("parent").alias("hash"))
        below = materialize(_with_siblings(parents), "merkle-level")
        levels.append(below)
        left_over = -(-left_over // ARITY)
    return levels


_NO_PATH = "cast(array() as array<struct<left:string,right:string>>)"


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes (with siblings) below ``above`` (g, place, path, ...): each with its parent's columns, and its own siblings before the parent's path."""
    joined = nodes.join(above.withColumnRenamed("place", "run"), ["g", "run"])
    return joined.withColumn("path", F.concat(F.array(F.struct("left", "right")), "path"))


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(g, place, path, ...) of the nodes of the lowest of the levels; tops: (g, path, ...) of each group's last node."""
    known, names = None, ["g", "place", *(c for c in tops.columns if c != "g")]
    for level in reversed(levels):
        found = level.filter("size = 1").join(tops, "g").select(names)
        if known is not None:
            found = found.unionByName(_down(level.filter("size > 1"), known).select(names))
        known = materialize(found, "merkle-paths")
    return known


def tree(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, list[DataFrame], int]:
    """Leaves (g, hash and what rows has besides) with place and size, subroots (g, hash), the levels and the size of the largest group."""
    leaves, sizes = _placed(rows, order)
    largest = sizes.agg(F.max("size")).first()[0] or 0
    levels = _levels(leaves.select("g", "place", "size", "hash"), largest)
    tops = leaves.select("g", "size", "hash")
    for level in levels:
        tops = tops.unionByName(level.select("g", "size", "hash"))
    return leaves, tops.filter("size = 1").select("g", "hash"), levels, largest


def _fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda now, x: F.sha2(F.concat(x["left"], now, x["right"]).cast("binary"), 256))


def manifest(df: DataFrame, columns: list[str], key: str, group: str, tampered: dict[str, Column], tampering: Column) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, and the root folded from the row as it is where ``tampering``: folded_root, verified.

    columns: those that a leaf hashes, in order; tampered: what some of them become where tampering holds.
    """
    column = {c: F.col(f"`{c}`") for c in columns}
    own = digest(*(value(column[c]) for c in columns))
    changed = digest(*(value(tampered.get(c, column[c])) for c in columns))
    source = F.col(f"`{group}`").cast("string")
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.when(source.isNull(), "").otherwise(F.concat(F.lit("+"), source)).alias("g"), own.alias("hash"),
        F.when(F.coalesce(tampering, F.lit(False)), changed).alias("changed"),
    )
    hashed = materialize(rows, "merkle-hashes")  # texts are read once
    leaves, subroots, levels, _ = tree(hashed, ["key", "hash", "changed"])
    upper = subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "hash")
    subs, roots, upper_levels, _ = tree(upper, ["of"])
    start = roots.select("g", F.expr(_NO_PATH).alias("path"), F.col("hash").alias("root"))
    tops = subs.filter("size = 1").join(start, "g")
    if upper_levels:
        tops = _down(_with_siblings(subs.filter("size > 1")), _paths(upper_levels, start))
    tops = materialize(tops.select(F.col("of").alias("g"), F.col("hash").alias("subroot"), "path", "root"), "merkle-subroots")
    names = ["key", "hash", "changed", "subroot", "path", "root"]
    whole = leaves.filter("size = 1").join(tops, "g").select(names)
    if levels:  # a level's row holds all the path above it, so no row is joined by group alone
        whole = whole.unionByName(_down(_with_siblings(leaves.filter("size > 1")), _paths(levels, tops)).select(names))
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    found = whole.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"), _fold(F.coalesce("changed", "hash"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
