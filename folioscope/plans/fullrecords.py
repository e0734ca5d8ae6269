"""Listings, facets and trends over full records."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import search, trends
from folioscope.plans.base import query
from folioscope.sources.views import PAPERS_SQL, RECORDS_SQL, records, table

_WITH = f"with {PAPERS_SQL}, {RECORDS_SQL} "


@query(_WITH + """, x as (select seq, 'authors' as dimension, unnest(list_transform(list_concat(authors, editors), lambda p: p.family)) as value from records union all select seq, 'journals', container_title from records union all select seq, 'types', type from records
    union all select seq, 'affiliations', unnest(affiliations) from records union all select seq, 'keywords', unnest(keywords) from records union all select seq, 'subjects', unnest(subjects) from records)
select dimension, trim(value) as value, count(distinct seq) as n from x where trim(value) <> '' group by all""")
def record_facets(spark, sf_dir):
    """Values of every dimension, editors among the authors, all affiliations."""
    return search.facets(records(spark, sf_dir))


@query(_WITH + """, k as (select *, case when date is not null then cast(replace(left(date || '-01', 10), '-', '') as int) when try_cast(year as int) is not null then cast(year as int) * 10000 + 101 end as key from records where type = 'F'),
r as (select *, row_number() over (order by key desc nulls last, case when key is not null then filename end desc, filename) as place from k)
select (select count(*) from k) as total, place, filename, title, coalesce(year, '') as year, coalesce(date, '') as date, container_title, coalesce(doi, '') as doi, type, '' as volume, 'crossref' as source,
    array_to_string(list_transform(authors, lambda p: p.family), '; ') as authors, array_to_string(keywords, '; ') as keywords, array_to_string(affiliations, '; ') as affiliations from r where place between 41 and 90""")
def papers_page(spark, sf_dir):
    """A page of slim rows by date, their places, and how many papers the filter leaves."""
    total, page = search.paper_page(records(spark, sf_dir).filter("type = 'F'"), "date", True, 40, 50)
    joined = lambda c: F.array_join(c, "; ")
    shown = page.select(F.col("place").cast("long").alias("place"), "filename", "title", "year", "date", "container_title", "doi", "type", "volume", "source", joined(F.transform("authors", lambda p: p["family"])).alias("authors"), joined("keywords").alias("keywords"), joined("affiliations").alias("affiliations"))
    return shown.crossJoin(F.broadcast(total))


@query(_WITH + "select seq, cast(y as varchar) as year from dated")
def publication_years(spark, sf_dir):
    """Years from what records have: year, issued year, date."""
    r = records(spark, sf_dir)
    return r.select("seq", trends.year_of(r).cast("string").alias("year"))


_TERMS = """t as (select seq, y, 'keywords' as dim, unnest(keywords) as term, unnest(range(len(keywords))) as pos from dated union all select seq, y, 'subjects', unnest(subjects), unnest(range(len(subjects))) from dated union all select seq, y, 'journals', container_title, 0 from dated
    union all select seq, y, 'authors', unnest(list_transform(authors, lambda p: p.family)), unnest(range(len(authors))) from dated union all select seq, y, 'affiliations', trim(a), i from (select seq, y, unnest(list_sort(list_distinct(affiliations))) as a, unnest(range(len(list_distinct(affiliations)))) as i from dated)),
h as (select distinct seq from t where dim = 'subjects' and lower(term) = 'economy'), e as (select t.* from t semi join h using (seq)), l as (select max(y) as hi from dated),
w as (select e.*, case when y between hi - 19 and hi - 10 then 'base' when y between hi - 9 and hi then 'recent' end as win from e, l),
x as (select 'company' as part, unnest(['all', win]) as name, term, seq, pos, 12 as most from w where dim = 'subjects' and lower(term) <> 'economy' union all select 'cross', dim, term, seq, pos, 8 from w where dim <> 'subjects'
    union all select dim, win, term, seq, pos, 8 from w where dim in ('authors', 'journals')),
c as (select part, name, term, most, count(*) as n, min({'seq': seq, 'pos': pos}) as first from x where name is not null group by all)"""


@query(_WITH + f""", {_TERMS} select part, name, cast(rank as int) as rank, term, n from (select *, row_number() over (partition by part, name order by n desc, first, term) as rank from c) where rank <= most""")
def term_context(spark, sf_dir):
    """What a subject stands beside, all years and by window, and whose and where it is."""
    return trends.term_context(records(spark, sf_dir), "subjects", " Economy ")


@query(_WITH + """, p as (select *, list_filter(subjects, lambda s: lower(s) = 'economy')[1] as hit from dated), q as (select * from p where hit is not null)
select (select arg_max(hit, seq) from q) as term, (select count(*) from q) as total, seq, filename, title, y as year, container_title as journal, array_to_string(list_transform(authors[:3], lambda a: a.family), '; ') as authors from q order by coalesce(y, 0) desc, title, seq limit 60""")
def term_papers(spark, sf_dir):
    """A subject's latest papers."""
    told, rows = trends.term_papers(records(spark, sf_dir), "subjects", "ECONOMY")
    return rows.withColumn("authors", F.array_join("authors", "; ")).crossJoin(F.broadcast(told))


@query("""with h as (select 'f' || user_id as file_path, case when event_id % 3 = 0 then '  ' else ' ' || event_type || ' ' || event_id || chr(10) end as content, floor(value / 20) as score, event_id as pos from events),
best as (select file_path, max(score) as score, arg_max(pos, score * 1000000000 + pos) as b, count(*) as n_chunks, min(pos) as first_pos from h group by 1),
own as (select b.file_path, coalesce((select trim(h.content, ' ' || chr(10)) from h where h.file_path = b.file_path and h.pos >= b.b and trim(h.content) <> '' order by h.pos limit 1), '') as snippet from best b)
select file_path, score, n_chunks, snippet, row_number() over (order by score desc, first_pos) as rank from best join own using (file_path)""")
def paper_snippets(spark, sf_dir):
    """Hits folded to papers: where the best chunk is blank, the next that is not gives the snippet."""
    hits = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), "user_id").alias("file_path"), F.when(F.col("event_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "), "event_id", F.lit("\n"))).alias("content"), F.floor(F.col("value") / 20).cast("double").alias("score"), F.col("event_id").alias("pos"))
    return search.rank_papers(hits).withColumn("rank", F.col("rank").cast("long"))
