"""The library's tables as DataFrames, read from a folder of Parquet tables.

The bibliographic manifest is seen through orders (a paper), customers (its author),
and the parts of its lines (keywords and subjects); chunks are documents, vectors are
embeddings, and the knowledge graph links suppliers and parts by their shared lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a paper: seq, filename, type, family, given, year, date, title, container_title, affiliation, n_pages, keywords, subjects."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    terms = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_name")).alias("keywords"), F.sort_array(F.collect_set("p_type")).alias("subjects"), F.max("l_quantity").cast("int").alias("n_pages"))
    bare = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(terms, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return bare.select(
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("Paper_"), "o_orderkey", F.lit(".pdf")).alias("filename"),
        F.col("o_orderstatus").alias("type"),
        F.col("c_mktsegment").alias("family"),
        F.concat(F.lit("C"), F.col("c_nationkey")).alias("given"),
        F.when(F.col("o_orderkey") % 50 != 7, F.year("o_orderdate").cast("string")).alias("year"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.concat_ws(" ", F.coalesce(F.element_at("keywords", 1), F.lit("Untitled")), "o_orderpriority").alias("title"),
        F.col("o_orderpriority").alias("container_title"),
        F.concat(F.lit("Nation "), F.col("c_nationkey")).alias("affiliation"),
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"),
    )


#: papers() as a DuckDB common table expression.
PAPERS_SQL = """terms as (
    select l_orderkey, list_sort(list(distinct p_name)) as keywords, list_sort(list(distinct p_type)) as subjects, cast(max(l_quantity) as int) as n_pages
    from lineitem join part on l_partkey = p_partkey group by 1),
papers as (
    select o_orderkey as seq, 'Paper_' || o_orderkey || '.pdf' as filename, o_orderstatus as type, c_mktsegment as family, 'C' || c_nationkey as given,
        case when o_orderkey % 50 <> 7 then cast(year(o_orderdate) as varchar) end as year,
        case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m') when 1 then strftime(o_orderdate, '%Y-%m-%d') end as date,
        coalesce(keywords[1], 'Untitled') || ' ' || o_orderpriority as title, o_orderpriority as container_title, 'Nation ' || c_nationkey as affiliation,
        coalesce(n_pages, 0) as n_pages, coalesce(keywords, []) as keywords, coalesce(subjects, []) as subjects
    from orders join customer on o_custkey = c_custkey left join terms on o_orderkey = l_orderkey)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """papers() as full records: lists of authors, editors and affiliations, years as they are written, issued years, and what a listing shows."""
    k = F.col("seq")
    person = lambda family, given: F.struct(family.alias("family"), given.alias("given"))
    own = F.array(person(F.col("family"), F.col("given")))
    second = F.array(person(F.concat(F.lit("Hale "), k % 5), F.lit("J. P.")))
    none = F.expr("cast(array() as array<struct<family:string,given:string>>)")
    return papers(spark, sf_dir).withColumns({
        "authors": F.when(k % 3 == 1, F.concat(own, second)).when(k % 41 == 0, none).otherwise(own),
        "editors": F.when(k % 4 == 0, F.array(person(F.concat(F.lit("Reed "), k % 6), F.lit("E.")))).otherwise(none),
        "affiliations": F.when(k % 5 == 0, F.array(F.concat(F.col("affiliation"), F.lit(" ")), F.lit("Nation 3"))).otherwise(F.array("affiliation")),
        "issued_year": F.when(k % 100 == 7, F.lit("1994-05")).when(k % 100 == 57, F.lit("soon")),
        "year": F.when(k % 50 == 8, F.lit("n.d.")).when(k % 50 == 9, F.lit("")).otherwise(F.col("year")),
        "doi": F.when(k % 2 == 0, F.concat(F.lit("10.1/"), k)), "source": F.lit("crossref"),
    })


#: records() as a common table expression after PAPERS_SQL.
RECORDS_SQL = """records as (select * replace (case seq % 50 when 8 then 'n.d.' when 9 then '' else year end as year),
    case when seq % 3 = 1 then [{'family': family, 'given': given}, {'family': 'Hale ' || (seq % 5), 'given': 'J. P.'}] when seq % 41 = 0 then [] else [{'family': family, 'given': given}] end as authors,
    case when seq % 4 = 0 then [{'family': 'Reed ' || (seq % 6), 'given': 'E.'}] else [] end as editors,
    case when seq % 5 = 0 then [affiliation || ' ', 'Nation 3'] else [affiliation] end as affiliations,
    case seq % 100 when 7 then '1994-05' when 57 then 'soon' end as issued_year, case when seq % 2 = 0 then '10.1/' || seq end as doi from papers),
dated as (select *, coalesce(case when try_cast(left(year, 4) as int) between 1800 and 2100 then try_cast(left(year, 4) as int) end, case when try_cast(left(issued_year, 4) as int) between 1800 and 2100 then try_cast(left(issued_year, 4) as int) end,
    case when regexp_matches(date, '^[0-9]{4}') and cast(left(date, 4) as int) between 1800 and 2100 then cast(left(date, 4) as int) end) as y from records)"""


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges supplier - part brand and type: src, dst, weight (lines that link them), description."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    ends = lines.select(F.col("s_name").alias("src"), F.explode(F.array("p_brand", "p_type")).alias("dst"))
    return ends.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).withColumn("description", F.concat("src", F.lit("  supplies "), "dst"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph: name, entity_type (quoted, or blank, as extraction leaves it), file_path (joined by <SEP>)."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 10 == 0, F.lit("")).otherwise(F.lit('"Supplier"')).alias("entity_type"), F.concat(F.lit("f"), F.col("s_nationkey"), F.lit(".pdf<SEP>unknown_source<SEP>f"), F.col("s_suppkey") % 7, F.lit(".pdf")).alias("file_path"))
    part = table(spark, sf_dir, "part")
    kinds = part.select(F.explode(F.array(F.struct(F.col("p_brand").alias("name"), F.lit("Brand").alias("entity_type")), F.struct(F.col("p_type").alias("name"), F.lit("Type").alias("entity_type")))).alias("x")).select("x.*").distinct()
    return suppliers.unionByName(kinds.withColumn("file_path", F.lit("f0.pdf<SEP>...truncated...(KEEP Old)")))


GRAPH_SQL = """edges as (
    select s_name as src, x as dst, cast(count(*) as double) as weight from (
        select s_name, unnest([p_brand, p_type]) as x from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey) group by 1, 2),
nodes as (
    select s_name as name, case when s_suppkey % 10 = 0 then '' else 'Supplier' end as entity_type,
        list_distinct(['f' || s_nationkey || '.pdf', 'f' || (s_suppkey % 7) || '.pdf']) as files from supplier
    union all select distinct p_brand, 'Brand', ['f0.pdf'] from part
    union all select distinct p_type, 'Type', ['f0.pdf'] from part),
pairs_by_end as (select src as name, dst as other, weight from edges union all select dst, src, weight from edges),
idx as (select n.name, entity_type, coalesce(d.degree, 0) as degree, len(files) as n_papers, files
    from nodes n left join (select name, count(*) as degree from pairs_by_end group by 1) d on n.name = d.name)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors: chunk_id, file_path, pos, embedding (doubles)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("file_"), "label", F.lit(".pdf")).alias("file_path"), F.col("embedding").cast("array<double>").alias("embedding"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text chunks: lines of documents with a word, as (doc_id, source, chunk, content)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("chunk", "content")).filter(F.trim("content") != "")
