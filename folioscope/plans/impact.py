"""Citation impact, profiles, and catalogue decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import catalogue, impact, trends
from folioscope.operators.search import cosine, dot
from folioscope.plans.base import query
from folioscope.sources.views import PAPERS_SQL, papers, table, vectors

_CITED = "cited as (select l_partkey as work, count(*) as cited, cast(min(year(l_shipdate)) as int) as year from lineitem group by 1)"


def _works(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.count("*").alias("cited"), F.min(F.year("l_shipdate")).alias("year"))


@query(f"with {_CITED}, d as (select *, cast(floor(year / 10) * 10 as int) as decade from cited), f as (select decade from d group by 1 having count(*) >= 8) select decade, rank, work, cited from (select *, row_number() over (partition by decade order by cited desc, work) as rank from d semi join f using (decade)) where rank <= 5")
def top_cited_by_decade(spark, sf_dir):
    return impact.top_by_decade(_works(spark, sf_dir), "year", "cited", "work").withColumn("rank", F.col("rank").cast("long"))


@query(f"""with {PAPERS_SQL}, o as (select seq, keywords, cast(year as int) as y, cast(round(o_totalprice) as bigint) as c from papers join orders on seq = o_orderkey where year is not null),
p as (select *, case when count(*) over (partition by y) = 1 then 50.0 else round(100.0 * (row_number() over (partition by y order by c, seq) - 1) / greatest(count(*) over (partition by y) - 1, 1), 1) end as p from o),
e as (select seq, unnest(list_distinct(keywords)) as term, p, c from p), r as (select *, row_number() over (partition by term order by c) as i, count(*) over (partition by term) as n from e)
select term, count(*) as n, round(avg(p), 4) as mean_percentile, max(case when i = n // 2 + 1 then c end) as median_cited from r group by 1 having count(*) >= 8 order by 3 desc, 2 desc, 1 limit 40""")
def topic_impact(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.expr("cast(round(o_totalprice) as bigint)").alias("cited"))
    works = papers(spark, sf_dir).filter("year is not null").join(o, "seq")
    return impact.topic_impact(trends.citation_percentile(works, "year", "cited", "seq"), "keywords", "percentile", "cited")


@query("select cast(year(l_shipdate) as int) as year, count(*) as n from lineitem group by 1")
def citation_arrivals(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    return impact.arrivals(by)


@query(f"""with {PAPERS_SQL}, m as (select * from papers where family = 'BUILDING'), e as (select 'keywords' as dimension, unnest(keywords) as value from m union all select 'subjects', unnest(subjects) from m union all select 'journals', container_title from m), c as (select dimension, value, count(*) as n from e group by 1, 2)
select dimension, rank, value, n from (select *, row_number() over (partition by dimension order by n desc, value) as rank from c) where rank <= 14""")
def author_profile(spark, sf_dir):
    return impact.profile(papers(spark, sf_dir), "Building").withColumn("rank", F.col("rank").cast("long"))


@query("""with s as (select vec_id, label, round(list_dot_product(embedding::double[], q), 9) as sim from embeddings, (select embedding::double[] as q from embeddings where vec_id = 0)) select vec_id as chunk_id, round(pow(1 - (rank() over (order by sim desc) - 1) / count(*) over (), 2.2) * 990) / 10 as temperature from s""")
def guess_temperatures(spark, sf_dir):
    """By inner products, as the vectors are: their lengths are 1 only to seven places."""
    v = vectors(spark, sf_dir)
    q = v.filter("chunk_id = 0").select(F.col("embedding").alias("q"), F.lit(0).alias("target"))
    return impact.temperature(v.crossJoin(F.broadcast(q)).withColumn("sim", F.round(dot("embedding", "q"), 9)), "target", "sim").select("chunk_id", "temperature")


@query("select c_mktsegment || '_' || c_nationkey as stem, c_name as name, case when count(*) over w > 1 then chr(cast(96 + row_number() over (partition by c_mktsegment, c_nationkey order by c_name) as int)) else '' end as letter from customer window w as (partition by c_mktsegment, c_nationkey)")
def renumbered_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat_ws("_", "c_mktsegment", "c_nationkey").alias("stem"), F.col("c_name").alias("name"))
    return catalogue.renumbered(c, "stem", "name")


@query("""with d as (select doc_id, 'n' || (doc_id % 97) as name, strlen(text) as size, sha256(text) as hash, case when doc_id % 11 = 0 then '' else source end as stem, case when doc_id % 5 = 0 then lang else '' end as doi from documents), s as (select * from d where doc_id % 2 = 0), i as (select * from d where doc_id % 2 = 1)
select i.doc_id, case when exists (select 1 from s where s.name = i.name and s.hash = i.hash) then 'dup-identical' when exists (select 1 from s where s.name = i.name) then 'collision' when exists (select 1 from s where s.size = i.size and s.hash = i.hash) then 'dup-content' when i.doi <> '' and exists (select 1 from s where s.doi <> '' and s.stem = i.stem and s.doi = i.doi) then 'dup-samepaper' when i.stem = '' then 'needs-naming' else 'promote' end as decision from i""")
def intake_decisions(spark, sf_dir):
    """Odd documents arrive in a store of the even ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("n"), F.col("doc_id") % 97).alias("name"), F.octet_length("text").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("source")).alias("stem"), F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise("").alias("doi"))
    store, fresh = d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1")
    return catalogue.intake(fresh, store, "doc_id").select("doc_id", "decision")


@query("""with v as (select vec_id as chunk_id, 'file_' || label || '.pdf' as file_path, round(list_dot_product(embedding::double[], q), 9) as score from embeddings, (select embedding::double[] as q from embeddings where vec_id = 0) where label in (1, 2, 3)), b as (select *, row_number() over (partition by file_path order by score desc, chunk_id) as r from v), k as (select * from b where r <= 8), n as (select file_path, row_number() over (order by min(chunk_id)) as reference_id from k group by 1)
select file_path, reference_id, chunk_id, round(score, 6) as score from k join n using (file_path)""")
def pinned_passages(spark, sf_dir):
    """Three pinned papers: eight passages of each."""
    v = vectors(spark, sf_dir)
    q = v.filter("chunk_id = 0").select(F.col("embedding").alias("q"))
    hits = v.filter(F.col("file_path").isin("file_1.pdf", "file_2.pdf", "file_3.pdf")).crossJoin(F.broadcast(q)).withColumn("score", F.round(cosine("embedding", "q"), 9))
    return catalogue.merge_pinned(hits, 8).withColumns({"reference_id": F.col("reference_id").cast("long"), "score": F.round("score", 6)})
