"""Trend queries over papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import trends
from folioscope.plans.base import query
from folioscope.sources.views import PAPERS_SQL, papers, table

_WITH = f"""with {PAPERS_SQL},
dated as (select *, cast(left(year, 4) as int) as y from papers where year is not null),
each as (select seq, y, 'journals' as dim, container_title as term from dated union all select seq, y, 'authors', family from dated union all select seq, y, 'affiliations', affiliation from dated
    union all select seq, y, 'types', type from dated union all select seq, y, 'keywords', unnest(keywords) from dated union all select seq, y, 'subjects', unnest(subjects) from dated),
ty as (select dim, lower(term) as key, y as year, count(*) as n from each where trim(term) <> '' group by 1, 2, 3),
corpus as (select y as year, count(*) as n from dated group by 1) """


@query(_WITH + "select year, n from corpus")
def papers_per_year(spark, sf_dir):
    return trends.corpus_years(papers(spark, sf_dir))


@query(_WITH + """, t as (select dim, key, sum(n) as total from ty group by 1, 2), f as (select dim, lower(term) as key, min(seq) as fs from each group by 1, 2),
r as (select t.*, row_number() over (partition by dim order by total desc, fs, key) as rank from t join f using (dim, key))
select dim, key, year, n, cast(total as bigint) as total, rank from ty join r using (dim, key) where rank <= case dim when 'types' then 20 when 'keywords' then 300 when 'authors' then 300 else 200 end""")
def term_year_counts(spark, sf_dir):
    return trends.capped(trends.term_years(papers(spark, sf_dir))).select("dim", "key", "year", "n", "total", F.col("rank").cast("long").alias("rank"))


@query(_WITH + """, r as (select *, sum(n) over (partition by dim, key order by year) as run, sum(n) over (partition by dim, key) as total from ty)
select dim, key, min(year) as first_year, max(year) as last_year, arg_max(year, n * 10000 + year) as peak_year, max(n) as peak_n, min(case when 2 * run >= total then year end) as median_year from r group by 1, 2""")
def term_stats(spark, sf_dir):
    return trends.term_stats(trends.term_years(papers(spark, sf_dir)))


@query(_WITH + """, w as (select max(year) as hi from corpus), a as (select greatest(1, sum(case when year between hi - 1 and hi then n else 0 end)) as r, greatest(1, sum(case when year between hi - 3 and hi - 2 then n else 0 end)) as b from corpus, w),
s as (select dim, key, sum(n) as total, sum(case when year between hi - 3 and hi - 2 then n else 0 end) as base_n, sum(case when year between hi - 1 and hi then n else 0 end) as recent_n from ty, w group by 1, 2)
select dim, key, cast(total as bigint) as total, cast(base_n as bigint) as base_n, cast(recent_n as bigint) as recent_n, round(100 * (recent_n / r - base_n / b), 3) as delta from s, a""")
def share_deltas(spark, sf_dir):
    """Then and now: the last two years against the two before (the tables span seven years)."""
    p = papers(spark, sf_dir)
    return trends.deltas(trends.term_years(p), trends.corpus_years(p), span=2)


@query()
def newcomers(spark, sf_dir):
    p = papers(spark, sf_dir)
    return trends.newcomers(trends.term_years(p), trends.corpus_years(p))


@query(_WITH + """, s as (select year as start, sum(n) over (order by year range between current row and 2 following) as papers, sum(n) over () as all_n, max(year) over () as hi from corpus),
t as (select dim, key, sum(n) as total from ty group by 1, 2),
o as (select t.dim, t.key, t.total, s.start, s.papers, s.all_n, sum(ty.n) as observed from t cross join s join ty on ty.dim = t.dim and ty.key = t.key and ty.year between s.start and s.start + 2 where s.start + 2 <= s.hi group by all)
select dim, key, cast(total as bigint) as total, start, cast(observed as bigint) as observed, round(total * papers / all_n, 6) as expected, round((observed - total * papers / all_n) / sqrt(total * papers / all_n), 6) as z from o""")
def burst_windows(spark, sf_dir):
    p = papers(spark, sf_dir)
    w = trends.windows(trends.term_years(p), trends.corpus_years(p))
    return w.withColumns({"expected": F.round("expected", 6), "z": F.round("z", 6)})


@query()
def bursts(spark, sf_dir):
    p = papers(spark, sf_dir)
    return trends.bursts(trends.term_years(p), trends.corpus_years(p))


@query(_WITH + """, g as (select dim, key, unnest(generate_series(min(year), max(year))) as year from ty group by 1, 2), f as (select g.dim, g.key, cast(g.year as int) as year, coalesce(n, 0) as n from g left join ty on g.dim = ty.dim and g.key = ty.key and g.year = ty.year)
select dim, key, year, n, round(avg(n) over (partition by dim, key order by year rows between 1 preceding and 1 following), 6) as smooth from f""")
def smoothed_series(spark, sf_dir):
    """Zeros in the gaps, then a centred mean of three."""
    s = trends.smoothed(trends.filled(trends.term_years(papers(spark, sf_dir))))
    return s.withColumn("smooth", F.round("smooth", 6))


@query(_WITH + "select dim, key, year, round(100.0 * ty.n / corpus.n, 1) as share from ty join corpus using (year)")
def yearly_shares(spark, sf_dir):
    p = papers(spark, sf_dir)
    return trends.shares(trends.term_years(p), trends.corpus_years(p))


@query()
def lead_lag_pairs(spark, sf_dir):
    """Over months in place of years, which the tables have enough of."""
    p = papers(spark, sf_dir).filter("length(date) >= 7").withColumn("year", F.expr("1800 + (cast(substring(date, 1, 4) as int) - 1995) * 12 + cast(substring(date, 6, 2) as int)").cast("string"))
    return trends.lead_lag(trends.term_years(p), trends.corpus_years(p), from_year=1800)


@query(_WITH + """, m as (select distinct seq from each where dim = 'subjects' and lower(term) = 'economy'), c as (select dim, lower(term) as key, count(*) as n from each semi join m using (seq) where dim <> 'types' and not (dim = 'subjects' and lower(term) = 'economy') group by 1, 2)
select * from (select dim, key, n, row_number() over (partition by dim order by n desc, key) as rank from c) where rank <= 8""")
def trend_detail(spark, sf_dir):
    d = trends.trend_detail(papers(spark, sf_dir), "subjects", "ECONOMY")
    return d.withColumn("rank", F.col("rank").cast("long"))


def whole(price):
    """A price in whole numbers, halves to the even one."""
    return F.rint(price).cast("long")


@query("""select o_orderkey, case when count(*) over w = 1 then 50.0 else round(100.0 * (row_number() over (partition by year(o_orderdate) order by cast(o_totalprice as bigint), o_orderkey) - 1) / greatest(count(*) over w - 1, 1), 1) end as percentile
from orders window w as (partition by year(o_orderdate))""")
def citation_percentile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), whole(F.col("o_totalprice")).alias("cited"))
    return trends.citation_percentile(o, "year", "cited", "o_orderkey").select("o_orderkey", "percentile")


@query("""with r as (select l_orderkey as src, l_partkey as dst from lineitem), e as (select src, dst from r where src <> dst) select dst as work, count(*) as cited_by, count(distinct src) as from_works from e group by 1 order by cited_by desc, work limit 25""")
def internal_citations(spark, sf_dir):
    """References joined to works by id, self-references dropped; the 25 most cited."""
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"))
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("work")).filter("src != work")
    return refs.join(works, "work").groupBy("work").agg(F.count("*").alias("cited_by"), F.countDistinct("src").alias("from_works")).orderBy(F.desc("cited_by"), "work").limit(25)


@query("""with c as (select l_partkey as work, year(l_shipdate) as y, count(*) as n from lineitem group by 1, 2), s as (select work, sum(n) as cited, sum(case when y >= 1999 then n else 0 end) as late from c group by 1)
select work, cast(cited as bigint) as cited, round(late / cited, 6) as share, round(late / cited * log10(cited), 6) as score from s where cited >= 10 and late / cited >= 0.35""")
def sleeping_beauties(spark, sf_dir):
    """Works whose citations come late: share of the last years times the logarithm of all."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.count("*").alias("cited"), F.sum((F.year("l_shipdate") >= 1999).cast("long")).alias("late"))
    share = F.col("late") / F.col("cited")
    return c.filter((F.col("cited") >= 10) & (share >= 0.35)).select("work", "cited", F.round(share, 6).alias("share"), F.round(share * F.log10("cited"), 6).alias("score"))
