"""Vector search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import filters, search
from folioscope.operators.filters import Filters
from folioscope.plans.base import query
from folioscope.sources.views import vectors

_WITH = """with v as (select vec_id as chunk_id, 'file_' || label || '.pdf' as file_path, embedding::double[] as e from embeddings), q as (select e as q from v where chunk_id = 0),
s as (select chunk_id, file_path, list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)) as score from v, q) """


def _query(chunks):
    return chunks.filter("chunk_id = 0").select(F.col("embedding").alias("q"))


def _ranked_sql(pool: str) -> str:
    return _WITH + f""", h as (select * from s where {pool} order by score desc, chunk_id limit 40)
select file_path, round(max(score), 4) as score, count(*) as n_chunks, row_number() over (order by round(max(score), 4) desc, min(chunk_id)) as rank from h group by 1"""


@query(_WITH + "select chunk_id, file_path, round(score, 6) as score from s order by score desc, chunk_id limit 40")
def vector_top_k(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.vector_search(v, _query(v), 40).withColumn("score", F.round("score", 6))


def _folded(hits):
    ranked = search.rank_papers(hits.withColumn("content", F.lit("")).withColumn("pos", F.col("chunk_id")))
    return ranked.select("file_path", "score", "n_chunks", F.col("rank").cast("long").alias("rank"))


@query(_ranked_sql("file_path in ('file_1.pdf', 'file_3.pdf', 'file_5.pdf', 'file_7.pdf')"))
def search_ranked_papers(spark, sf_dir):
    """The flagship: a metadata filter resolved to files, restricting the vector search, folded to papers."""
    v = vectors(spark, sf_dir)
    records = v.select("file_path").distinct().withColumn("filename", F.col("file_path")).withColumn("year", F.regexp_replace(F.regexp_extract("file_path", r"\d+", 0), "^", "200")).withColumn("type", F.when(F.col("year").cast("int") % 2 == 1, "article").otherwise("book"))
    within = filters.resolve(records, Filters(types=["article"], year_from=2001, year_to=2008))
    return _folded(search.vector_search(v, _query(v), 40, within))


@query(_WITH + """, h as (select * from s order by score desc, chunk_id limit 40) select file_path, count(*) as n, row_number() over (order by count(*) desc, min(chunk_id)) as reference_id from h group by 1""")
def reference_ids(spark, sf_dir):
    v = vectors(spark, sf_dir)
    r = search.reference_ids(search.vector_search(v, _query(v), 40).withColumn("pos", F.col("chunk_id")))
    return r.withColumn("reference_id", F.col("reference_id").cast("long"))


@query("""with p as (select label, unnest(generate_series(1, 64)) as i, unnest(embedding::double[]) as x from embeddings), m as (select label, i, avg(x) as m from p group by 1, 2), n as (select label, sqrt(sum(m * m)) + 1e-9 as n from m group by 1)
select 'file_' || label || '.pdf' as file_path, i - 1 as i, round(m / n, 6) as x from m join n using (label)""")
def paper_centroids(spark, sf_dir):
    c = search.centroids(vectors(spark, sf_dir))
    return c.select("file_path", F.posexplode("centroid").alias("i", "x")).select("file_path", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("""with c as (select label, list(m order by i) as c from (select label, i, avg(x) as m from (select label, unnest(generate_series(1, 64)) as i, unnest(embedding::double[]) as x from embeddings) group by 1, 2) group by 1)
select 'file_' || a.label || '.pdf' as a, 'file_' || b.label || '.pdf' as b, round(list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c) * list_dot_product(b.c, b.c)), 3) as cosine from c a join c b on 'file_' || a.label < 'file_' || b.label""")
def oeuvre_similarity(spark, sf_dir):
    return search.oeuvre_similarity(vectors(spark, sf_dir))


@query("""with c as (select list(m order by i) as q from (select i, avg(x) as m from (select unnest(generate_series(1, 64)) as i, unnest(embedding::double[]) as x from embeddings where label = 2) group by 1)),
s as (select vec_id as chunk_id, label, list_dot_product(embedding::double[], q) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(q, q)) as score from embeddings, c where label <> 2), h as (select * from s order by score desc, chunk_id limit 60)
select * from (select 'file_' || label || '.pdf' as file_path, round(max(score), 4) as score, count(*) as n_chunks, row_number() over (order by round(max(score), 4) desc, min(chunk_id)) as rank from h group by label) where rank <= 12""")
def similar_papers(spark, sf_dir):
    s = search.similar_papers(vectors(spark, sf_dir), "file_2.pdf", 60, 12)
    return s.select("file_path", "score", "n_chunks", F.col("rank").cast("long").alias("rank"))


@query("""with p as (select a.vec_id as i, b.vec_id as j, greatest(0, list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[]))) as sim from embeddings a join embeddings b on a.vec_id <> b.vec_id)
select * from (select i, row_number() over (partition by i order by sim desc, j) as rank, j, round(sim, 6) as sim from p) where rank <= 8""")
def knn_graph(spark, sf_dir):
    g = search.knn_graph(vectors(spark, sf_dir), 8)
    return g.select("i", F.col("rank").cast("long").alias("rank"), "j", F.round("sim", 6).alias("sim"))


@query("select 'file_' || label || '.pdf' as file_path, string_agg(p, ',' order by p) as pages from (select distinct label, vec_id % 7 as p from embeddings) group by 1")
def pages_by_file(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("page", F.col("chunk_id") % 7)
    return search.pages_by_file(v).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


_RANKED = "select a.id as i, b.id as j, row_number() over (partition by a.id order by list_cosine_similarity(a.e, b.e) desc, b.id) as r from {0} a join {0} b on a.id <> b.id qualify r <= 8"


@query(f"""with v as (select vec_id as id, cast(embedding as double[]) as e from embeddings), w as (select id, list_transform(e, lambda x: floor(x * 16) / 16) as e from v),
t as ({_RANKED.format('v')}), f as ({_RANKED.format('w')}) select t.i, round(count(f.j) / 8.0, 6) as recall from t left join f on t.i = f.i and t.j = f.j group by 1""")
def nearest_recall(spark, sf_dir):
    """How much of each chunk's eight neighbours a store of rounded vectors finds."""
    v = vectors(spark, sf_dir)
    coarse = v.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * 16) / 16))
    truth, found = (search.knn_graph(x, 8).select("i", "j") for x in (v, coarse))
    return search.recall(found, truth, "i", "j").withColumn("recall", F.round("recall", 6))
