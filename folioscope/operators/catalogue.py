"""Catalogue upkeep and the chat store (J6, J16, J17, W9, W14, U2, U4, A28, DB1, DB3, DB4, DB22-DB24, DB26)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.texts import character


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the first in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def merge_new(store: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """store with the rows of more whose key it lacks: idempotent."""
    return store.unionByName(more.join(store.select(key), key, "left_anti"))


def name_penalty(name: Column) -> Column:
    """How far a file's name is from a plain Author_Year.pdf: copy markers, supplements, other forms, letters behind the year. Fixed values."""
    canonical = r"^[A-Za-z][A-Za-z'-]*(_[A-Za-z][A-Za-z'-]*)?_[0-9]{4}[a-z]?\.pdf$"
    faults = ((r"(__\d+|_\d{1,2})\.pdf$", 40, True), (r"(?i)_suppl\.pdf$", 30, True), (rf"{canonical}|^.+_Supplementary\.pdf$", 20, False), (r"\d{4}[a-z](_Supplementary)?\.pdf$", 5, True))
    return reduce(add, [F.when(F.rlike(name, F.lit(p)) == found, n).otherwise(0) for p, n, found in faults])


def duplicate_groups(files: DataFrame, content: str, key: str, name: str, rank: Column | None = None) -> DataFrame:
    """Files of equal content: key, group (least key), n, keep: the one of the best folder (rank, 0 first) and name, then the longest name.

    Lengths are compared before hashes, so only texts of equal length are hashed.
    """
    sized = files.withColumn("_n", F.octet_length(content)).withColumn("_p", 100 * (F.lit(0) if rank is None else rank) + name_penalty(F.col(name)))
    several = sized.groupBy("_n").agg(F.count("*").alias("_m")).filter("_m > 1").select("_n")
    hashed = sized.join(several, "_n", "left_semi").select(key, name, "_p", F.sha2(F.col(content).cast("binary"), 256).alias("_h"))
    best = F.min(F.struct(F.col("_p"), -F.length(name), F.col(name), F.col(key)))
    groups = hashed.groupBy("_h").agg(F.min(key).alias("group"), F.count("*").alias("n"), best.alias("_b")).filter("n > 1")
    return hashed.join(groups, "_h").select(key, "group", "n", (F.col("_b")[key] == F.col(key)).alias("keep"))


def canonical_spelling(values: DataFrame, value: str) -> DataFrame:
    """For each value but for case, the spelling with most votes (with a capital where there is one; then most capitals): key, spelling, votes."""
    votes = values.groupBy(F.lower(value).alias("key"), F.col(value).alias("spelling")).agg(F.count("*").alias("votes"))
    capitals = F.length("spelling") - F.length(F.regexp_replace("spelling", "[A-Z]", ""))
    return first_by(votes.withColumn("_c", capitals), ["key"], (F.col("_c") > 0).desc(), F.desc("votes"), F.desc("_c"), "spelling").drop("_c")


def upsert(events: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The last write of each key."""
    return first_by(events, keys, F.desc(ts), F.desc(tie))


def delete_cascade(parents: DataFrame, children: DataFrame, key: str, gone) -> tuple[DataFrame, DataFrame]:
    """Parents without those for which ``gone`` holds, and the children of parents that stay."""
    dead = parents.filter(gone).select(key)
    return parents.join(dead, key, "left_anti"), children.join(dead, key, "left_anti")


def keyset_page(rows: DataFrame, ts: str, key: str, before, limit: int) -> DataFrame:
    """A page of rows before a cursor, newest first, with one row more if there are more."""
    page = rows if before is None else rows.filter(F.col(ts) < F.lit(before))
    return page.orderBy(F.desc(ts), F.desc(key)).limit(limit + 1)


def rename_chain(papers: DataFrame, renames: DataFrame, hops: int = 50) -> DataFrame:
    """name, current: what each name is called after following renames (old, new; one row an old name) to their end.

    Links are doubled: after round k a rename spans 2**k of them, so a chain of ``hops`` takes log2 of it in joins of one plan.
    A chain that never ends (a cycle, or more than hops renames) leaves its names as they are, with current null.
    """
    spans = renames.select("old", "new")
    for _ in range(max(1, hops.bit_length())):
        ahead = spans.select(F.col("old").alias("new"), F.col("new").alias("_next"))
        spans = spans.join(ahead, "new", "left").select("old", F.coalesce("_next", "new").alias("new"))
    ends = spans.join(renames.select(F.col("old").alias("new"), F.lit(True).alias("_goes_on")), "new", "left")
    found = ends.select(F.col("old").alias("name"), F.when(F.col("_goes_on").isNull(), F.col("new")).alias("_end"), F.lit(True).alias("_renamed"))
    return papers.join(found, "name", "left").select("name", F.when(F.col("_renamed"), F.col("_end")).otherwise(F.col("name")).alias("current"))


def missing(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return expected.join(stored.select(key).distinct(), key, "left_anti")


def coverage(chunks: DataFrame, stored: DataFrame, doc: str, key: str) -> DataFrame:
    """Which documents are stored wholly, partly or not at all: doc, n, n_stored, state."""
    hit = chunks.join(stored.select(key).distinct().withColumn("_s", F.lit(1)), key, "left")
    counts = hit.groupBy(doc).agg(F.count("*").alias("n"), F.count("_s").alias("n_stored"))
    return counts.withColumn("state", F.when(F.col("n_stored") == 0, "none").when(F.col("n_stored") == F.col("n"), "all").otherwise("partial"))


def activity(events: DataFrame, chat: str, user: str, ts: str) -> DataFrame:
    """For each chat its number of messages, the latest and who wrote it."""
    return events.groupBy(chat).agg(F.count("*").alias("n_messages"), F.max(ts).alias("latest"), F.max_by(user, F.struct(ts, user)).alias("latest_by"))


def renumbered(files: DataFrame, stem: str, name: str) -> DataFrame:
    """name, letter: files of one stem lettered a, b, … by name without gaps, behind z the code points that follow; a file alone has none."""
    own = Window.partitionBy(stem)
    rank = F.row_number().over(own.orderBy(name))
    return files.select(stem, name, F.when(F.count("*").over(own) > 1, character(96 + rank)).otherwise(F.lit("")).alias("letter"))


def intake(incoming: DataFrame, store: DataFrame, *keep: str) -> DataFrame:
    """name, ``keep``, decision of incoming files (name, size, hash, stem, doi) against a store: the first that holds of
    dup-identical (name and hash), collision (name), dup-content (size and hash), dup-samepaper (stem and doi), needs-naming (no stem), promote."""
    names = store.filter("name is not null").select("name").distinct().withColumn("_name", F.lit(True))
    files = store.select("name", "hash").distinct().withColumn("_file", F.lit(True))
    contents = store.select("size", "hash").distinct().withColumn("_same", F.lit(True))
    works = store.filter("doi != ''").select("stem", "doi").distinct().withColumn("_work", F.lit(True))
    joined = incoming.join(names, "name", "left").join(files, ["name", "hash"], "left").join(contents, ["size", "hash"], "left").join(works, ["stem", "doi"], "left")
    decision = (
        F.when(F.col("_file"), "dup-identical").when(F.col("_name"), "collision").when(F.col("_same"), "dup-content").when(F.col("_work"), "dup-samepaper").when(F.coalesce("stem", F.lit("")) == "", "needs-naming").otherwise("promote")
    )
    return joined.select("name", *keep, decision.alias("decision"))


def merge_pinned(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best passages of each pinned file, files numbered by first appearance: file_path, reference_id, chunk_id, score."""
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("_r") <= k)
    numbered = best.groupBy("file_path").agg(F.min("chunk_id").alias("_c")).withColumn("reference_id", F.row_number().over(Window.orderBy("_c")))  # 2 to 8 pinned files
    return best.join(F.broadcast(numbered.drop("_c")), "file_path").select("file_path", "reference_id", "chunk_id", "score")
