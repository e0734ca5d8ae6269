"""The entity graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranks import numbered

SEP, TRUNCATED = "<SEP>", "...truncated..."


def both_ways(edges: DataFrame) -> DataFrame:
    """name, other, weight, description: each undirected edge from both of its ends."""
    back = edges.select(F.col("dst").alias("name"), F.col("src").alias("other"), "weight", "description")
    return edges.select(F.col("src").alias("name"), F.col("dst").alias("other"), "weight", "description").unionByName(back)


def clean_type(kind: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(kind, F.lit(""))), '^"+|"+$', ""))


def node_files(file_path: Column) -> Column:
    """The files of a node in order: no repeats, no unknown source, no marker of a list cut short."""
    parts = F.transform(F.split(F.coalesce(file_path, F.lit("")), SEP), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != "unknown_source") & ~F.contains(x, F.lit(TRUNCATED))))


def snippet(text: Column, limit: int = 240) -> Column:
    """White space collapsed; beyond limit cut, with an ellipsis."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, limit - 1)), F.lit("…")))


def entity_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, type, degree, n_papers, files of every node."""
    degrees = both_ways(edges).groupBy("name").agg(F.count("*").alias("degree"))
    files = nodes.select("name", clean_type(F.col("entity_type")).alias("type"), node_files(F.col("file_path")).alias("files"))
    return files.join(degrees, "name", "left").select("name", "type", F.coalesce("degree", F.lit(0)).alias("degree"), F.size("files").cast("long").alias("n_papers"), "files")


def kind(c: str = "type") -> Column:
    return F.coalesce(F.nullif(F.lower(c), F.lit("")), F.lit("unknown"))


def overview(index: DataFrame, top: int = 5) -> DataFrame:
    """type, n, top_names (of greatest degree)."""
    ranked = index.withColumn("kind", kind()).withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("degree"), F.lower("name"), "name")))
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "name")))), lambda x: x["name"])
    return ranked.groupBy(F.col("kind").alias("type")).agg(F.count("*").alias("n"), names.alias("top_names"))


def search(index: DataFrame, q: str = "", etype: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the index by degree: a part of the name, an exact type (blank: unknown)."""
    found = index.filter(F.contains(F.lower("name"), F.lit(q.strip().lower())))
    if etype.strip():
        found = found.filter(kind() == etype.strip().lower())
    return found.orderBy(F.desc("degree"), F.lower("name"), "name").offset(max(0, offset)).limit(max(1, limit))


def ranked(index: DataFrame, q: str) -> DataFrame:
    """Exact names before prefixes before other matches, then by degree and name; tier and rank of every match."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    needle = " ".join(q.lower().split())
    name = flat("name")
    tier = F.lit(3) if not needle else F.when(name == needle, 0).when(F.startswith(name, F.lit(needle)), 1).otherwise(2)
    hits = index.filter(F.contains(name, F.lit(needle))).withColumn("tier", tier)
    return numbered(hits, [F.col("tier"), F.desc("degree"), F.lower("name"), F.col("name")])


def by_file(index: DataFrame, top: int = 8) -> DataFrame:
    """file, rank, name: each file's entities of greatest degree."""
    each = index.select("name", "degree", F.explode("files").alias("f")).withColumn("file", F.lower("f"))
    order = Window.partitionBy("file").orderBy(F.desc("degree"), F.lower("name"), "name")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("file", "rank", "name")


def detail(index: DataFrame, edges: DataFrame, name: str, limit: int = 60) -> DataFrame:
    """An entity's relations, strongest first: rank, entity, entity_type, degree, weight."""
    mine = both_ways(edges).filter(F.col("name") == name).select(F.col("other").alias("entity"), "weight")
    known = mine.join(index.select(F.col("name").alias("entity"), kind().alias("entity_type"), "degree"), "entity")
    order = [F.desc("weight"), F.desc("degree"), F.lower("entity")]
    first = known.orderBy(*order).limit(limit)  # so the window below has ``limit`` rows
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def entity_card(nodes: DataFrame, edges: DataFrame, name: str, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """What an entity's page shows: one row (name, type, description, degree, n_relations, n_papers, files), and its relations, strongest first.

    nodes: name, entity_type, file_path, description; edges: src, dst, weight, description, keywords. Relations carry their own description (320 characters)
    and keywords (120); of ends only those met are looked up.
    """
    ways = [edges.filter(F.col(a) == name).select(F.col(b).alias("entity"), "weight", "description", "keywords") for a, b in (("src", "dst"), ("dst", "src"))]
    mine = ways[0].unionByName(ways[1])
    met = nodes.join(mine.select(F.col("entity").alias("name")).distinct(), "name", "left_semi")
    ends = both_ways(edges).join(met.select("name"), "name", "left_semi").groupBy(F.col("name").alias("entity")).agg(F.count("*").alias("degree"))
    kinds = met.select(F.col("name").alias("entity"), F.coalesce(F.nullif(clean_type(F.col("entity_type")), F.lit("")), F.lit("unknown")).alias("entity_type"))
    order = [F.desc("weight"), F.desc("degree"), F.lower("entity"), F.col("entity")]
    told = mine.join(ends, "entity").join(kinds, "entity", "left").select("entity", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), "degree", snippet(F.col("description"), 320).alias("description"), snippet(F.col("keywords"), 120).alias("keywords"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    first = told.orderBy(*order).limit(most)
    own = nodes.filter(F.col("name") == name).limit(1).withColumn("_files", node_files(F.col("file_path")))
    plain = F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"\s+", " "))
    kind_of = F.coalesce(F.nullif(clean_type(F.col("entity_type")), F.lit("")), F.lit("unknown"))
    card = own.crossJoin(F.broadcast(mine.agg(F.count("*").alias("degree")))).select("name", kind_of.alias("type"), plain.alias("description"), "degree", F.col("degree").alias("n_relations"), F.size("_files").cast("long").alias("n_papers"), F.slice("_files", 1, most).alias("files"))
    return card, first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_subgraph(index: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """Edges between the ``top`` entities of greatest degree, each pair once."""
    kept = F.broadcast(index.orderBy(F.desc("degree"), "name").limit(top).select("name"))  # ``top`` rows
    inner = edges.join(kept, edges["src"] == kept["name"], "left_semi").join(kept, edges["dst"] == kept["name"], "left_semi")
    return inner.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def centrality(members: DataFrame, index: DataFrame) -> DataFrame:
    """item, centrality: log1p of its members' degrees over the greatest such log. members: item, name."""
    sums = members.distinct().join(index.select("name", "degree"), "name").groupBy("item").agg(F.sum("degree").alias("s"))
    return sums.crossJoin(F.broadcast(sums.agg(F.max("s").alias("m")))).select("item", F.when(F.col("m") > 0, F.log1p("s") / F.log1p("m")).otherwise(0.0).alias("centrality"))


def merged_descriptions(fragments: DataFrame, most: int = 300) -> DataFrame:
    """Distinct fragments of an entity joined in order, the number of times it was found, its first chunks: name, description, weight, chunks."""
    each = fragments.groupBy("name", "description").agg(F.count("*").alias("n"), F.min("chunk").alias("c"), F.slice(F.sort_array(F.collect_set("chunk")), 1, most).alias("chunks"))
    listed = F.sort_array(F.collect_list(F.struct("c", "description")))
    return each.groupBy("name").agg(F.array_join(F.transform(listed, lambda x: x["description"]), SEP).alias("description"), F.sum("n").alias("weight"), F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("chunks")))), 1, most).alias("chunks"))
