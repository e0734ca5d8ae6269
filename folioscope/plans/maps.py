"""Cluster, map, author and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import atlas, similarity
from folioscope.plans.base import query
from folioscope.sources.views import PAPERS_SQL, papers, table, vectors

_POINTS = "pts as (select vec_id, (embedding[1]::double + 1) / 2 as x, (embedding[2]::double + 1) / 2 as y from embeddings)"


def _points(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("chunk_id", ((F.col("embedding")[0] + 1) / 2).alias("x"), ((F.col("embedding")[1] + 1) / 2).alias("y"))


@query(f"""with {_POINTS}, c as (select least(31, greatest(0, floor(x * 32)))::int as gx, least(31, greatest(0, floor(y * 32)))::int as gy, count(*)::double as v from pts group by 1, 2), k as (select unnest([-1, 0, 1]) as d, unnest([0.25, 0.5, 0.25]) as w),
a as (select gx + d as gx, gy, sum(v * w) as v from c, k where gx + d between 0 and 31 group by 1, 2), b as (select gx, gy + d as gy, sum(v * w) as v from a, k where gy + d between 0 and 31 group by 1, 2) select gx, gy, round(ln(1 + v), 6) as v from b""")
def heightmap(spark, sf_dir):
    """Points of the first two axes of the vectors, in a grid, blurred."""
    return atlas.heightmap(_points(spark, sf_dir), "x", "y", 32).withColumn("v", F.round("v", 6))


@query(f"""with {_POINTS}, f as (select x * 16 - 0.5 as fx, y * 16 - 0.5 as fy from pts), o as (select unnest([0, 0, 1, 1]) as i, unnest([0, 1, 0, 1]) as j),
e as (select (floor(fx) + i)::int as gx, (floor(fy) + j)::int as gy, (case when i = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) * (case when j = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end) as w from f, o)
select gx, gy, round(sum(w), 6) as v from e where gx between 0 and 15 and gy between 0 and 15 group by 1, 2""")
def bilinear_splat(spark, sf_dir):
    return atlas.splat(_points(spark, sf_dir), "x", "y", 16).withColumn("v", F.round("v", 6))


@query("""with c as (select user_id as paper, event_type as cluster, count(*) as n from events group by 1, 2) select paper, cluster, n from (select *, row_number() over (partition by paper order by n desc, cluster) as r from c) where r = 1""")
def modal_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper"), F.col("event_type").alias("cluster"))
    return atlas.modal(e.filter("cluster is not null"), "paper", "cluster")


@query(r"""with t as (select lang as cluster, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 1) as w from documents), e as (select cluster, unnest(w) as term from t union all select cluster, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) from t where len(w) > 1),
tf as (select cluster, term, count(*) as tf from e group by 1, 2), df as (select term, count(*) as df from tf group by 1 having count(*) >= 2), n as (select count(distinct cluster) as n from t), x as (select cluster, term, tf * (ln((1 + n) / (1 + df)) + 1) as x from tf join df using (term), n),
w as (select cluster, term, x / sqrt(sum(x * x) over (partition by cluster)) as weight from x) select cluster, row_number() over (partition by cluster order by round(weight, 9) desc, term) as rank, term, round(weight, 6) as weight from w qualify rank <= 15""")
def cluster_terms(spark, sf_dir):
    """The languages as clusters of documents, and what sets their words apart."""
    t = table(spark, sf_dir, "documents").select(F.col("lang").alias("cluster"), F.col("text").alias("content"))
    return atlas.cluster_terms(t).withColumns({"rank": F.col("rank").cast("long"), "weight": F.round("weight", 6)})


@query(f"""with {PAPERS_SQL}, k as (select regexp_replace(lower(family), '[^\\p{{L}}]', '', 'g') || '/' || lower(left(regexp_replace(given, '[^\\p{{L}}]', '', 'g'), 1)) as key, * from papers)
select key, min(family) as family, arg_max(given, (length(given), given)) as given, count(distinct filename) as n_papers, coalesce(min(cast(year as int)), 0) as first_year, coalesce(max(cast(year as int)), 0) as last_year from k group by 1""")
def author_table(spark, sf_dir):
    return atlas.authors(papers(spark, sf_dir))


@query(f"""with {PAPERS_SQL} select coalesce(case length(date) when 7 then 'month' when 10 then 'day' end, 'none') as a, year as b, count(*) as n from papers group by 1, 2""")
def date_precision(spark, sf_dir):
    n = F.length("date")
    return atlas.crosstab(papers(spark, sf_dir), F.when(n == 7, "month").when(n == 10, "day").otherwise("none"), F.col("year"))


@query(f"""with {PAPERS_SQL}, p as (select seq, (seq * 37 % 100) / 100.0 as px, (seq * 61 % 100) / 100.0 as py, cast(year as int) as year from papers where year is not null), h as (select max(year) as hi from p), m as (select *, least(5, floor(px * 6))::int as gx, least(5, floor(py * 6))::int as gy, case when year > hi - 2 then 1 else 0 end as new from p, h),
r as (select sum(new) / count(*) as rate from m), c as (select gx, gy, count(*) as n, sum(new) as recent_n from m group by 1, 2 having count(*) >= 6) select gx, gy, n, cast(recent_n as bigint) as recent_n, round((recent_n - n * rate) / sqrt(n * rate), 6) as z from c, r where (recent_n - n * rate) / sqrt(n * rate) >= 0.5 order by z desc, gx, gy limit 14""")
def frontier_cells(spark, sf_dir):
    p = papers(spark, sf_dir).select("seq", ((F.col("seq") * 37 % 100) / 100).alias("px"), ((F.col("seq") * 61 % 100) / 100).alias("py"), F.expr("cast(year as int)").alias("year"))
    return atlas.frontier(p, side=6, span=2, z_least=0.5)


@query()
def vector_layout(spark, sf_dir):
    """Two principal components and ten k-means clusters: stand-ins for a neighbour embedding and density clusters."""
    return atlas.clusters(atlas.layout(vectors(spark, sf_dir)), 10).select("chunk_id", "cluster", F.round(F.col("pos")[0], 6).alias("x"), F.round(F.col("pos")[1], 6).alias("y"))


@query("""with v as (select vec_id, label, embedding::double[] as e from embeddings), s as (select i, sum(case when vec_id = 2 then -x else x end) as x from (select vec_id, unnest(generate_series(1, 64)) as i, unnest(e) as x from v where vec_id in (0, 1, 2)) group by 1), q as (select list(x order by i) as q from s),
h as (select label, list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)) as score, vec_id from v, q where label not in (select label from v where vec_id in (0, 1, 2)) order by score desc, vec_id limit 32) select 'file_' || label || '.pdf' as file_path, round(max(score), 6) as score from h group by 1 order by 2 desc, 1 limit 8""")
def vector_arithmetic(spark, sf_dir):
    return atlas.arithmetic(vectors(spark, sf_dir), [0, 1], [2]).withColumn("score", F.round("score", 6))


@query("""with l as (select l_orderkey as k, cast(l_linenumber as double) as s, l_returnflag = 'R' as p from lineitem), b as (select s, sum(p::int) as p, count(*) as n from l group by 1), w as (select p * (coalesce(sum(n - p) over (order by s rows between unbounded preceding and 1 preceding), 0) + (n - p) / 2) as w, p, n from b)
select round(sum(w) / (sum(p) * sum(n - p)), 9) as auc from w""")
def rank_auc(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("s"), (F.col("l_returnflag") == "R").alias("p"))
    return similarity.auc(rows, "s", "p").withColumn("auc", F.round("auc", 9))


@query("""with b as (select item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) as w from benchmark), p as (select a.item_id as l, b.item_id as r, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) as overlap from b a, b)
select l as item_id, r as other_id, round(overlap, 6) as overlap from (select *, row_number() over (partition by l order by overlap desc, r) as k from p where overlap >= 0.2) where k <= 3""")
def similar_titles(spark, sf_dir):
    """Passages whose distinct words agree by a fifth or more, found by their rarest words."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("title"))
    return similarity.title_matches(b, b.withColumnRenamed("item_id", "other_id"), "item_id", "other_id", 0.2).withColumn("overlap", F.round("overlap", 6))


@query()
def reading_orders(spark, sf_dir):
    """A document's text against its own lines, as a second extraction would give them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"), F.array_join(F.reverse(F.split("text", "\n")), "\n").alias("b"))
    return similarity.reading_order(d, "doc_id", "a", "b").withColumn("rho", F.round("rho", 6))
