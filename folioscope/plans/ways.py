"""Names and identifiers, ways over the map, checks and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import names
from folioscope.operators import atlas, repair, walks
from folioscope.operators.search import cosine, vector_search
from folioscope.plans.base import query
from folioscope.plans.maps import _POINTS, _points
from folioscope.plans.passages import _CHUNKS
from folioscope.sources.views import table, text_chunks, vectors

#: Names as printed, from a customer's key and segment; reads the same in both dialects.
_NAME = """case c_custkey % 11 when 0 then concat('MCKAY ', c_mktsegment) when 1 then concat('MACLEAN-', c_mktsegment) when 2 then concat('DE LA ', c_mktsegment) when 3 then concat(' VAN DEN ', c_mktsegment, '-REED ')
    when 4 then concat('O''', c_mktsegment) when 5 then concat('Mixed ', c_mktsegment) when 6 then concat('GPT-5 ', c_mktsegment) when 7 then lower(c_mktsegment) when 8 then 'MC MAC' when 9 then '' else c_mktsegment end"""
_PARTICLES = ", ".join(f"'{p}'" for p in names.PARTICLES)
_UP = "upper(left({0}, 1)) || lower(substr({0}, 2))"
_PIECE_SQL = f"""case when starts_with(lower(x), 'mc') and length(x) > 2 then 'Mc' || {_UP.format('substr(x, 3)')} when starts_with(lower(x), 'mac') and length(x) > 3 then 'Mac' || {_UP.format('substr(x, 4)')}
    when contains(x, '''') then array_to_string(list_transform(string_split(x, ''''), lambda y: {_UP.format('y')}), '''') else {_UP.format('x')} end"""


@query(f"""with n as (select c_custkey as id, trim({_NAME}) as t from customer)
select id, case when t <> upper(t) or t = lower(t) or regexp_matches(t, '[^A-Za-z .''\\-]') then t else array_to_string(list_transform(regexp_split_to_array(t, '\\s+'), lambda w, i: case when i > 1 and lower(w) in ({_PARTICLES}) then lower(w)
    else array_to_string(list_transform(string_split(w, '-'), lambda x: {_PIECE_SQL}), '-') end), ' ') end as name from n""")
def name_cases(spark, sf_dir):
    """Surnames printed in capitals alone as they are written."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), names.name_case(F.expr(_NAME)).alias("name"))


_FILE = """case l_orderkey % 7 when 0 then concat('Moss_Etal_', 1990 + l_orderkey % 30, 'b.pdf') when 1 then concat('Reed_', 1990 + l_orderkey % 30, '.pdf') when 2 then concat('O''Hale-Moss_', 1990 + l_orderkey % 30, '_', l_linenumber, '.pdf')
    when 3 then concat('Reed_', 1990 + l_orderkey % 30, ' (', l_linenumber, ').pdf') when 4 then concat('Reed_2001-Supplement.pdf') when 5 then concat('odd name ', l_orderkey, '.pdf') else concat('Reed_Moss_', l_orderkey % 900, '.pdf') end"""


@query(f"""with f as (select distinct {_FILE} as name from lineitem)
select name, regexp_extract(name, '{names.FILE_NAME.replace("'", "''")}', 1) as first, regexp_extract(name, '{names.FILE_NAME.replace("'", "''")}', 2) as second, regexp_extract(name, '{names.FILE_NAME.replace("'", "''")}', 3) as year,
    regexp_extract(name, '{names.FILE_NAME.replace("'", "''")}', 4) as letter, regexp_matches(name, '(?i){names.COPY_NAME}') as is_copy from f""")
def file_names(spark, sf_dir):
    """What names of files say, and which of them look like copies or supplements."""
    f = table(spark, sf_dir, "lineitem").select(F.expr(_FILE).alias("name")).distinct()
    return f.select("name", *(c.alias(n) for n, c in names.file_parts(F.col("name")).items()))


_CITING = """concat(text, case doc_id % 4 when 0 then concat(' (doi: 10.', 1000 + doc_id, '/AB-', doc_id, '.)., see 1', doc_id % 9, '99') when 1 then concat(' arXiv: 2101.0', 1000 + doc_id % 9000, 'v2, 1999 and 2004 and 1999') when 2 then ' 10.12/short 1799 20011' else '' end)"""


@query(f"""with t as (select doc_id, {_CITING} as x from documents)
select doc_id, regexp_replace(regexp_extract(x, '(?i){names.DOI.replace("'", "''")}'), '[.,;)]+$', '') as doi, regexp_extract(x, '(?i){names.ARXIV}', 1) as arxiv, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '{names.YEAR}'))), ',') as years from t""")
def text_identifiers(spark, sf_dir):
    """DOI, arXiv id and years in whole texts that cite."""
    found = names.identifiers(F.expr(_CITING))
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in (found | {"years": F.array_join(found["years"], ",")}).items()))


_SURNAME = "case doc_id % 6 when 0 then w[3] when 1 then 'Al' when 2 then 'Zzyzx-Quorth' when 3 then concat(w[1], w[2], w[3]) when 4 then concat('Quorth-', w[2]) else concat(w[1], '''') end"
_FOLD_SQL = "regexp_replace(lower(strip_accents({0})), '[^a-z]', '', 'g')"


@query(f"""with d as (select doc_id, text, regexp_split_to_array(text, '\\s+') as w from documents), n as (select doc_id, text, {_SURNAME} as surname from d),
f as (select *, list_filter(list_distinct(list_transform(list_prepend(surname, string_split(surname, '-')), lambda s: {_FOLD_SQL.format('s')})), lambda s: s <> '') as forms, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*'), lambda s: regexp_replace(lower(s), '[^a-z]', '', 'g')) as words, {_FOLD_SQL.format('text')} as letters from n)
select doc_id, case when len(forms) = 0 or len(list_filter(forms, lambda s: length(s) <= 2)) > 0 then null when list_has_any(forms, words) or len(list_filter(forms, lambda s: length(s) >= 7 and contains(letters, s))) > 0 then 'yes' else 'no' end as found from f""")
def surname_checks(spark, sf_dir):
    """Whether a name stands in a text, as a word or run together."""
    at = lambda i: f"try_element_at(w, {i})"
    surname = _SURNAME
    for i in (1, 2, 3):
        surname = surname.replace(f"w[{i}]", f"coalesce({at(i)}, '')")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", r"\s+").alias("w")).select("doc_id", "text", F.expr(surname).alias("surname"))
    return d.select("doc_id", names.surname_in_text(F.col("surname"), F.col("text")).alias("found"))


_REPLY = "case event_id % 4 when 0 then props when 1 then concat('Here it is: ', props, ' as asked.') when 2 then 'nothing of the kind' else concat(props, ' }') end"


@query("select event_id, case when event_id % 4 < 2 then cast(json_extract(props, '$.k') as double) end as k from events")
def json_replies(spark, sf_dir):
    """JSON taken out of replies that may have prose around it."""
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(names.json_within(F.expr(_REPLY)), "$.k", "double").alias("k"))


_V = f"""with {_POINTS}, v as (select p.vec_id as chunk_id, 'file_' || label || '.pdf' as file_path, embedding::double[] as e, x, y from embeddings e join pts p on p.vec_id = e.vec_id)"""


def _placed(spark, sf_dir):
    return vectors(spark, sf_dir).join(_points(spark, sf_dir), "chunk_id")


@query(f"""{_V}, ends as (select a.e as a, b.e as b, acos(list_cosine_similarity(a.e, b.e)) as w, sqrt(list_dot_product(a.e, a.e)) as na, sqrt(list_dot_product(b.e, b.e)) as nb from v a, v b where a.chunk_id = 0 and b.chunk_id = 7),
q as (select step, list_transform(list_zip(a, b), lambda z: sin((1 - step / 10.0) * w) / sin(w) * z[1] / na + sin(step / 10.0 * w) / sin(w) * z[2] / nb) as q from ends, (select unnest(generate_series(0, 10)) as step)),
s as (select step, chunk_id, file_path, round(list_cosine_similarity(e, q), 9) as score, x, y from v, q), n as (select * from s qualify row_number() over (partition by step order by score desc, chunk_id) <= 12),
f as (select * from n qualify row_number() over (partition by step, file_path order by score desc, chunk_id) = 1), h as (select *, row_number() over (partition by step order by score desc, chunk_id) as rank from f qualify rank <= 5),
c as (select step, sum(x * pow(greatest(score, 0.01), 4)) / sum(pow(greatest(score, 0.01), 4)) as cx, sum(y * pow(greatest(score, 0.01), 4)) / sum(pow(greatest(score, 0.01), 4)) as cy from h group by 1)
select step, rank, chunk_id, file_path, round(score, 5) as score, round(cx, 5) as cx, round(cy, 5) as cy from h join c using (step)""")
def geodesic(spark, sf_dir):
    """Eleven steps from one vector to another, five papers each, and each step's centre on the map."""
    v = _placed(spark, sf_dir)
    end = lambda i, n: v.filter(F.col("chunk_id") == i).select(F.col("embedding").alias(n))  # noqa: E731  one row each
    hits = walks.geodesic(v, end(0, "a").crossJoin(end(7, "b")))
    centres = walks.step_centres(hits).select("step", F.round("x", 5).alias("cx"), F.round("y", 5).alias("cy"))
    return hits.join(centres, "step").select("step", F.col("rank").cast("long").alias("rank"), "chunk_id", "file_path", F.round("score", 5).alias("score"), "cx", "cy")


@query(f"""{_V}, s as (select v.*, list_cosine_similarity(e, q) as score from v, (select e as q from v where chunk_id = 0)), h as (select * from s order by score desc, chunk_id limit 40),
w as (select *, 0.3 + 0.7 * (score - min(score) over ()) / (max(score) over () - min(score) over ()) as w from h), c as (select sum(x * w * w) / sum(w * w) as cx, sum(y * w * w) / sum(w * w) as cy from w)
select v.chunk_id, round(least(1, 0.62 * exp(-(pow(v.x - cx, 2) + pow(v.y - cy, 2)) / (0.16 * 0.16)) + 0.5 * coalesce(w.w, 0)), 6) as signal from v cross join c left join w on w.chunk_id = v.chunk_id""")
def station_signal(spark, sf_dir):
    """How strongly each point of the map hears the station of a query."""
    v = vectors(spark, sf_dir)
    hits = vector_search(v, v.filter("chunk_id = 0").select(F.col("embedding").alias("q")), 40)
    points = _points(spark, sf_dir)
    return walks.signals(points, *walks.station(hits, points)).withColumn("signal", F.round("signal", 6))


_SPREAD = "pts as (select (embedding[1]::double * 3 + 1) / 2 as x, (embedding[2]::double * 3 + 1) / 2 as y from embeddings)"


@query(f"""with {_SPREAD}, c as (select least(31, greatest(0, floor(x * 32)))::int as gx, least(31, greatest(0, floor(y * 32)))::int as gy, count(*)::double as v from pts group by 1, 2), k as (select unnest([-1, 0, 1]) as d, unnest([0.25, 0.5, 0.25]) as w),
a as (select gx + d as gx, gy, sum(v * w) as v from c, k where gx + d between 0 and 31 group by 1, 2), b as (select gx, gy + d as gy, sum(v * w) as v from a, k where gy + d between 0 and 31 group by 1, 2), h as (select gx, gy, round(ln(1 + v), 6) as v from b),
m as (select gx, gy, v from h where v >= 0.12 and gx between 1 and 30 and gy between 1 and 30 and not exists (select 1 from h o where o.gx between h.gx - 1 and h.gx + 1 and o.gy between h.gy - 1 and h.gy + 1 and o.v > h.v)),
l as (select list([{{'gx': gx, 'gy': gy, 'v': v}}] order by v desc, gy, gx) as l from m), r as (select list_reduce(l, lambda acc, p: case when len(acc) < 22 and len(list_filter(acc, lambda q: sqrt(pow((q.gx - p[1].gx) / 31, 2) + pow((q.gy - p[1].gy) / 31, 2)) <= 0.105)) = 0 then list_concat(acc, p) else acc end) as r from l)
select i as rank, r[i].gx as gx, r[i].gy as gy, r[i].v as v from (select r, unnest(generate_series(1, len(r))) as i from r)""")
def map_peaks(spark, sf_dir):
    """Summits of the map of the vectors that keep their distance."""
    spread = vectors(spark, sf_dir).select(*(((F.col("embedding")[i] * 3 + 1) / 2).alias(n) for i, n in enumerate("xy")))
    heights = atlas.heightmap(spread, "x", "y", 32).withColumn("v", F.round("v", 6))
    return walks.peaks(heights, 32).withColumn("rank", F.col("rank").cast("long"))


@query("""with s as (select list_dot_product(embedding::double[], q) as sim from embeddings, (select embedding::double[] as q from embeddings where vec_id = 0)), t as (select (sim + 1) * 50 as t from s)
select case when t < 20 then 'freezing' when t < 40 then 'cold' when t < 55 then 'cool' when t < 70 then 'warm' when t < 85 then 'hot' else 'scorching' end as band, count(*) as n from t group by 1""")
def temperature_bands(spark, sf_dir):
    v = vectors(spark, sf_dir)
    t = v.crossJoin(F.broadcast(v.filter("chunk_id = 0").select(F.col("embedding").alias("q")))).select(((cosine("embedding", "q") + 1) * 50).alias("t"))
    return t.groupBy(walks.temperature_band(F.col("t")).alias("band")).agg(F.count("*").alias("n"))


@query("""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as word from benchmark), t as (select doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '-\\s+', '', 'g'), '[a-z]{3,}')) as word from documents),
s as (select doc_id, count(*) as n, sum(case when word in (from w) then 1 else 0 end) as v from t group by 1)
select doc_id, coalesce(n, 0) as n_words, case when coalesce(n, 0) < 40 then -1 else round(v / n, 3) end as validity from documents left join s using (doc_id)""")
def word_validity(spark, sf_dir):
    """The share of each document's words that the benchmark's vocabulary holds."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("word"))
    return repair.word_validity(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", words)


@query()
def chunk_spans(spark, sf_dir):
    """Where each line of a document lies in its text, met in capitals and with wide spaces."""
    d = table(spark, sf_dir, "documents")
    pieces = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("piece_id", "piece")).withColumn("piece", F.regexp_replace(F.upper("piece"), r"\s", "  "))
    return repair.located(pieces, d)


@query("""with f as (select p_brand as name, p_name as description, p_partkey % 97 as doc, p_partkey as chunk from part), held as (select * from f where doc not in (5, 17, 40) and not (doc = 3 and chunk > 500)), a as (select name, description, chunk from held union all select name, description, chunk from f where doc not in (select doc from held)),
d as (select name, description, min(chunk) as c, count(*) as n from a group by 1, 2) select name, string_agg(description, '<SEP>' order by c, description) as description, cast(sum(n) as bigint) as weight from d group by 1""")
def graph_repair(spark, sf_dir):
    """The graph after three documents that it lost are merged anew; one that it holds in part stays so."""
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_name").alias("description"), (F.col("p_partkey") % 97).alias("doc"), F.col("p_partkey").alias("chunk"))
    return repair.repaired(f.filter("doc not in (5, 17, 40) and not (doc = 3 and chunk > 500)"), f).drop("chunks")


@query(f"""with {_CHUNKS}, c as (select doc_id, chunk, cast(ceil(length(content) / 4) as bigint) as tokens, content from chunks), p as (select doc_id, chunk, tokens from c where contains(lower(content), 'edithon') order by doc_id, chunk limit 5),
r as (select *, coalesce(sum(tokens) over (order by doc_id, chunk rows between unbounded preceding and 1 preceding), 0) as before from (select doc_id, chunk, tokens from c anti join p using (doc_id, chunk)))
select doc_id, cast(chunk as int) as chunk, tokens from p union all select doc_id, cast(chunk as int), tokens from r where before + (select coalesce(sum(tokens), 0) from p) < 6000""")
def passages_topped_up(spark, sf_dir):
    """A question that few passages answer gets the front of the papers beside them."""
    chunks = text_chunks(spark, sf_dir).select("doc_id", "chunk", F.ceil(F.length("content") / 4).alias("tokens"), "content")
    picked = chunks.filter(F.contains(F.lower("content"), F.lit("edithon"))).orderBy("doc_id", "chunk").limit(5)
    return repair.topped_up(picked, chunks, "doc_id", "chunk", "tokens")
