"""Point lookups, suggestions, samples, authors and maps of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.catalogue import first_by
from folioscope.operators.ranks import running


def in_order(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows of the keys asked for, with their place in the request (a short list); unknown keys give none."""
    asked = rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(wanted))], f"`{key}` {rows.schema[key].dataType.simpleString()}, place int")
    return rows.join(F.broadcast(asked), key)


def suggestions(values: DataFrame, value: str, q: str, limit: int) -> DataFrame:
    """Distinct values that hold q, those that begin with it first, then the shortest."""
    low = F.lower(value)
    found = values.select(value).distinct().filter(F.contains(low, F.lit(q.lower())))
    return found.orderBy(~F.startswith(low, F.lit(q.lower())), F.length(value), low, value).limit(limit)


def find_author(authors: DataFrame, q: str) -> DataFrame:
    """authors (author_id, name, family, n_papers): the one that a name means best, at most: the whole name, the surname, a beginning, a part; then the larger work."""
    n = q.strip().lower()
    name, family = F.lower("name"), F.lower("family")
    tier = F.when(name == n, 400).when(family == n, 300).when(F.startswith(name, F.lit(n)) | F.startswith(family, F.lit(n)), 200).when(F.contains(name, F.lit(n)), 100)
    return authors.withColumn("score", tier + F.least(F.lit(60), "n_papers")).filter("score is not null").orderBy(F.desc("score"), "author_id").limit(1 if n else 0)


def spread_sample(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """Up to k rows of each group, evenly over its order: those at floor(i * n / k)."""
    own = Window.partitionBy(group)
    placed = rows.withColumn("_i", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(own))
    chosen = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * F.col("_n") / k) == F.col("_i"))
    return placed.filter((F.col("_n") <= k) | chosen).drop("_i", "_n")


def author_stats(papers: DataFrame) -> DataFrame:
    """papers (byline, n_chunks, year) to author (the first of a byline), n_papers, n_chunks, year_min, year_max (0 without years)."""
    author = F.trim(F.element_at(F.split(F.regexp_replace(F.coalesce("byline", F.lit("")), r"(?i)\s+et al\.?$", ""), r"\s*&\s*"), 1))
    dated = F.when(F.col("year") > 0, F.col("year"))
    some = lambda c: F.coalesce(c, F.lit(0))
    return papers.withColumn("author", author).filter("author != ''").groupBy("author").agg(F.count("*").alias("n_papers"), F.sum(some("n_chunks")).alias("n_chunks"), some(F.min(dated)).alias("year_min"), some(F.max(dated)).alias("year_max"))


def baseline_terms(papers: DataFrame, top: int = 90, least: int = 10) -> DataFrame:
    """The terms that most keywords and subjects have, but for case: term, n; of equals those seen first."""
    each = papers.select("seq", F.posexplode(F.concat("keywords", "subjects")).alias("pos", "t")).select(F.lower(F.trim("t")).alias("term"), F.struct("seq", "pos").alias("at"))
    counts = each.groupBy("term").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return counts.orderBy(F.desc("n"), "at").limit(top).filter((F.col("term") != "") & (F.col("n") >= least)).select("term", "n")


def summary_candidates(cards: DataFrame, sep: str = "<SEP>", fragments: int = 8, tokens: int = 1200) -> DataFrame:
    """cards (name, description) that need a summary: of two fragments or more, many of them or much text; n_fragments, n_tokens (four characters each)."""
    n = F.size(F.split("description", sep))
    sized = cards.select("name", n.alias("n_fragments"), F.ceil(F.length("description") / 4).alias("n_tokens"))
    return sized.filter((F.col("n_fragments") >= 2) & ((F.col("n_fragments") >= fragments) | (F.col("n_tokens") >= tokens)))


def nearest_rank(values: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """One row: p<percent> is the value at place min(n - 1, floor(percent / 100 * n)) of all in order, and greatest.

    Equal values are counted first, so what is ordered is distinct values.
    """
    counts = values.groupBy(value).agg(F.count("*").alias("_c"))
    up_to = running(counts, [F.col(value)], _to=F.col("_c")).withColumn("_to", F.col("_to") + F.col("_c")).crossJoin(F.broadcast(counts.agg(F.sum("_c").alias("_n"))))
    place = lambda p: F.least(F.col("_n") - 1, F.floor(F.col("_n") * p / 100))
    return up_to.agg(*(F.min(F.when(F.col("_to") > place(p), F.col(value))).alias(f"p{p}") for p in percents), F.max(value).alias("greatest"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys both have, and either alone."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def shard(rows: DataFrame, place: str, n: int, k: int) -> DataFrame:
    return rows.filter(F.pmod(F.col(place), F.lit(n)) == k)


def cluster_summaries(chunks: DataFrame, titles: int = 8) -> DataFrame:
    """chunks (chunk_id, cluster, paper, title, x, y) to cluster, size, n_papers, x, y (means), titles of the papers with most chunks there."""
    sums = chunks.groupBy("cluster").agg(F.count("*").alias("size"), F.countDistinct("paper").alias("n_papers"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))
    per = chunks.groupBy("cluster", "paper").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"), F.first("title").alias("title"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "first"))).filter(F.col("r") <= titles)
    listed = ranked.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", F.substring("title", 1, 110).alias("t")))).alias("x"))
    return sums.join(listed.select("cluster", F.col("x.t").alias("titles")), "cluster")


def paper_places(chunks: DataFrame) -> DataFrame:
    """paper, n_chunks, x, y: where a paper's chunks are on average."""
    return chunks.groupBy("paper").agg(F.count("*").alias("n_chunks"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


def chunk_id_parts(ids: DataFrame, column: str = "chunk_id") -> DataFrame:
    """doc_hash, number of ids like doc-<32 hex>-chunk-007, and whether the parts make the id again (three digits at least)."""
    m = lambda i: F.regexp_extract(column, r"^doc-([0-9a-f]{32})-chunk-(\d+)$", i)
    number = F.nullif(m(2), F.lit("")).cast("int")
    again = F.concat(F.lit("doc-"), m(1), F.lit("-chunk-"), F.when(F.length(number.cast("string")) < 3, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))
    return ids.select(column, m(1).alias("doc_hash"), number.alias("number"), F.coalesce(again == F.col(column), F.lit(False)).alias("round_trip"))


def canonical_name(index: DataFrame, name: str) -> DataFrame:
    """An entity's own name for one in any case: of several that of greatest degree."""
    return index.filter(F.lower("name") == name.strip().lower()).orderBy(F.desc("degree"), F.lower("name"), "name").limit(1).select("name")


def constellations(members: DataFrame, places: DataFrame, index: DataFrame, top: int, most: int = 12) -> DataFrame:
    """The ``top`` entities of greatest degree that have a known chunk: name, degree, n_chunks, x, y (means), first chunks.

    members: name, chunk_id; places: chunk_id, x, y.
    """
    held = members.distinct().join(places, "chunk_id").groupBy("name").agg(F.count("*").alias("n_chunks"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.collect_set("chunk_id").alias("c"))
    kept = held.join(index.select("name", "degree"), "name").orderBy(F.desc("degree"), "name").limit(top)
    return kept.select("name", "degree", "n_chunks", "x", "y", F.slice(F.sort_array("c"), 1, most).alias("chunks"))


def graph_retrieve(entities: DataFrame, relations: DataFrame, index: DataFrame, of_entity: DataFrame, of_relation: DataFrame, top: int = 20, least: float = 0.2) -> DataFrame:
    """Hybrid retrieval over the graph: chunk_id, rank, side.

    entities (name, score) met by specific keywords and relations (src, dst, weight, score) met by broad ones, both at cosine
    ``least`` or more: entities in order of score, relations of weight times the degrees of their ends; their chunks
    (name, chunk_id; src, dst, chunk_id) are taken in turn, entity side first, each chunk once.
    """
    degree = index.select("name", "degree")
    local = entities.filter(F.col("score") >= least).orderBy(F.desc("score"), "name").limit(top).join(of_entity, "name").groupBy("chunk_id").agg(F.max(F.struct("score", F.col("name").alias("n"))).alias("best"))
    ends = relations.filter(F.col("score") >= least).join(degree.withColumnsRenamed({"name": "src", "degree": "a"}), "src").join(degree.withColumnsRenamed({"name": "dst", "degree": "b"}), "dst")
    strong = ends.withColumn("strength", F.col("weight") * (F.col("a") + F.col("b"))).orderBy(F.desc("strength"), "src", "dst").limit(top)
    broad = strong.join(of_relation, ["src", "dst"]).groupBy("chunk_id").agg(F.max(F.struct("strength", "src", "dst")).alias("best"))
    sided = [d.orderBy(F.desc("best"), "chunk_id").limit(10 * top).withColumn("turn", F.row_number().over(Window.orderBy(F.desc("best"), "chunk_id"))).select("chunk_id", "turn", F.lit(s).alias("side")) for s, d in ((0, local), (1, broad))]
    once = first_by(sided[0].unionByName(sided[1]), ["chunk_id"], "turn", "side")
    kept = once.orderBy("turn", "side").limit(top)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy("turn", "side"))).select("chunk_id", "rank", "side")  # ``top`` rows
