"""Entity graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import graph
from folioscope.plans.base import query
from folioscope.sources.views import GRAPH_SQL, graph_edges, graph_nodes, table

_WITH = f"with {GRAPH_SQL} "


def _index(spark, sf_dir):
    return graph.entity_index(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))


@query(_WITH + "select name, entity_type as type, degree, n_papers from idx")
def entity_index(spark, sf_dir):
    return _index(spark, sf_dir).drop("files")


@query(_WITH + """, r as (select *, coalesce(nullif(lower(entity_type), ''), 'unknown') as kind, row_number() over (partition by coalesce(nullif(lower(entity_type), ''), 'unknown') order by degree desc, lower(name), name) as r from idx)
select kind as type, count(*) as n, string_agg(name, ', ' order by r) filter (r <= 5) as top_names from r group by 1""")
def graph_overview(spark, sf_dir):
    return graph.overview(_index(spark, sf_dir)).withColumn("top_names", F.array_join("top_names", ", "))


@query(_WITH + "select name, degree from idx where contains(lower(name), 'supplier#') and lower(entity_type) = 'supplier' order by degree desc, lower(name), name limit 50 offset 5")
def entity_search(spark, sf_dir):
    return graph.search(_index(spark, sf_dir), "Supplier#", "SUPPLIER", 50, 5).select("name", "degree")


@query(_WITH + """, t as (select *, case when lower(name) = 'brand#1' then 0 when starts_with(lower(name), 'brand#1') then 1 else 2 end as tier from idx where contains(lower(name), 'brand#1'))
select name, tier, row_number() over (order by tier, degree desc, lower(name), name) as rank from t""")
def entity_ranked_search(spark, sf_dir):
    return graph.ranked(_index(spark, sf_dir), " BRAND#1 ").select("name", "tier", F.col("rank").cast("long").alias("rank"))


@query(_WITH + """, f as (select name, degree, lower(unnest(files)) as file from idx)
select * from (select file, row_number() over (partition by file order by degree desc, lower(name), name) as rank, name from f) where rank <= 8""")
def entities_by_file(spark, sf_dir):
    return graph.by_file(_index(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(_WITH + """select row_number() over (order by weight desc, degree desc, lower(other)) as rank, other as entity, coalesce(nullif(lower(entity_type), ''), 'unknown') as entity_type, degree, weight
from pairs_by_end b join idx i on b.other = i.name where b.name = 'Brand#3' order by rank limit 60""")
def entity_detail(spark, sf_dir):
    d = graph.detail(_index(spark, sf_dir), graph_edges(spark, sf_dir), "Brand#3")
    return d.select(F.col("rank").cast("long").alias("rank"), "entity", "entity_type", "degree", "weight")


@query(_WITH + """, t as (select name from idx order by degree desc, name limit 60) select least(src, dst) as a, greatest(src, dst) as b, sum(weight) as weight from edges where src in (from t) and dst in (from t) group by 1, 2""")
def top_subgraph(spark, sf_dir):
    return graph.top_subgraph(_index(spark, sf_dir), graph_edges(spark, sf_dir), 60)


@query(_WITH + """, m as (select distinct l_orderkey as item, s_name as name from lineitem join supplier on l_suppkey = s_suppkey), s as (select item, sum(degree) as s from m join idx using (name) group by 1)
select item, round(ln(1 + s) / ln(1 + (select max(s) from s)), 6) as centrality from s""")
def graph_centrality(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("item"), F.col("s_name").alias("name"))
    return graph.centrality(members, _index(spark, sf_dir)).withColumn("centrality", F.round("centrality", 6))


@query("""with f as (select p_brand as name, p_name as description, p_partkey as chunk from part), d as (select name, description, min(chunk) as c, count(*) as n from f group by 1, 2)
select name, string_agg(description, '<SEP>' order by c, description) as description, cast(sum(n) as bigint) as weight from d group by 1""")
def merged_descriptions(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_name").alias("description"), F.col("p_partkey").alias("chunk"))
    return graph.merged_descriptions(f).drop("chunks")
