"""Passages of uploaded papers for a question (L2), and the lens over the map (DB17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.filters import lower
from folioscope.operators.ranks import kept, running

#: Tokens for a question, and what it gets at least; passages that each paper gives before others compete: fixed values.
BUDGET, LEAST, FLOOR = 30_000, 6_000, 2


def select_passages(passages: DataFrame, budget: int = BUDGET, least: int = LEAST, floor: int = FLOOR) -> DataFrame:
    """paper, idx, tokens, strategy of the passages (paper, idx, tokens, score) that go with a question.

    All of them where they fit the budget (``full``). Else each paper's best first, then the best of all, as long as what
    is spent is below the budget; where nothing matches, papers' beginnings count as their best. If less than ``least``
    is spent, the beginnings of the papers fill it up. Ranks go by range partitions, not by one window.
    """
    rows = kept(passages.select("paper", "idx", F.col("tokens").cast("long").alias("tokens"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    facts = F.broadcast(rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_all"), F.coalesce(F.max("score") > 0, F.lit(False)).alias("_any")))  # one row
    known = rows.crossJoin(facts)
    full = known.filter(F.col("_all") <= budget).select("paper", "idx", "tokens", F.lit("full").alias("strategy"))
    ranked = known.filter(F.col("_all") > budget).withColumn("_key", F.when(F.col("_any"), -F.col("score")).otherwise(0.0))
    nth = F.row_number().over(Window.partitionBy("paper").orderBy("_key", "idx"))
    heads = ranked.withColumn("_nth", nth).filter(F.col("_nth") <= floor)
    first = kept(running(heads, [F.col("paper"), F.col("_nth")], _before=F.col("tokens")).filter(F.col("_before") < budget).select("paper", "idx", "tokens"))
    spent = lambda d, name: F.broadcast(d.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias(name)))  # noqa: E731  one row
    rest = ranked.filter(~F.col("_any") | (F.col("score") > 0)).join(first.select("paper", "idx"), ["paper", "idx"], "left_anti")
    pooled = running(rest.select("paper", "idx", "tokens", "_key"), [F.col("_key"), F.col("idx"), F.col("paper")], _before=F.col("tokens"))
    second = pooled.crossJoin(spent(first, "_first")).filter(F.col("_before") + F.col("_first") < budget).select("paper", "idx", "tokens")
    taken = kept(first.unionByName(second))
    left = ranked.join(taken.select("paper", "idx"), ["paper", "idx"], "left_anti").select("paper", "idx", "tokens")
    more = running(left, [F.col("paper"), F.col("idx")], _before=F.col("tokens")).crossJoin(spent(taken, "_spent")).filter(F.col("_before") + F.col("_spent") < least)
    chosen = taken.unionByName(more.select("paper", "idx", "tokens")).withColumn("strategy", F.lit("ranked"))
    return full.unionByName(chosen)


def lens(papers: DataFrame, own: DataFrame | None = None, journal: str = "", keyword: str = "") -> DataFrame:
    """papers with ``seen``: in the lens are those of an author (``own``: filename), whose journal holds a text, and whose title,
    abstract, keywords or subjects hold one of the alternatives that bars part. Without any of the three all are null."""
    terms = [t.strip() for t in keyword.lower().split("|") if t.strip()]
    if own is None and not journal and not keyword:
        return papers.withColumn("seen", F.lit(None).cast("boolean"))
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.expr("cast(array() as array<string>)")), " | ")
    abstract = F.col("abstract") if "abstract" in papers.columns else F.lit("")
    hay = F.lower(F.concat_ws(" | ", F.coalesce("title", F.lit("")), F.coalesce(abstract, F.lit("")), F.when(F.size("keywords") > 0, listed("keywords")), F.when(F.size("subjects") > 0, listed("subjects"))))
    seen: Column = F.lit(True)
    if journal:
        seen = seen & F.contains(lower("container_title"), F.lit(journal.lower()))
    if terms:
        seen = seen & F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("_hay"), t))
    marked = papers.withColumn("_hay", hay)
    if own is not None:
        marked = marked.join(own.select("filename").distinct().withColumn("_own", F.lit(True)), "filename", "left")
        seen = seen & F.coalesce("_own", F.lit(False))
    return marked.withColumn("seen", seen).select(*papers.columns, "seen")


def seen_chunks(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """chunks (file_path) with what lens() says of their paper; chunks of unknown papers are not seen."""
    return chunks.join(papers.select(F.col("filename").alias("file_path"), "seen"), "file_path", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
