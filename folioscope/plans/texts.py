"""Text measures, markup and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import headers, texts
from folioscope.operators import chunking
from folioscope.plans.base import query
from folioscope.sources.views import table


@query(r"""with f as (select doc_id, length(text) as n_chars, round((length(text) - length(replace(text, ' ', ''))) / greatest(length(text), 1), 6) as space_share,
    round(length(regexp_replace(text, '[\p{L}\p{N}\s.,;:!?''"()-]', '', 'g')) / greatest(length(text), 1), 6) as symbol_share, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as n_words from documents)
select doc_id, n_chars, space_share, symbol_share, n_words, case when n_chars = 0 then 'no_text' when symbol_share > 0.3 then 'undecodable' when n_words < 20 then 'low_text' when space_share < 0.08 then 'glued_text' else 'ok' end as status from f""")
def text_quality(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in texts.quality_features(F.coalesce("text", F.lit(""))).items()])
    return f.withColumn("status", texts.quality_status(f))


@query(r"""with a as (select page_id, html from pages), b as (select page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') as h from a), c as (select page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') as h from b),
d as (select page_id, replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as h from c) select page_id, md5(trim(regexp_replace(h, '[ \t\r\n]+', ' ', 'g'))) as text_md5, length(trim(regexp_replace(h, '[ \t\r\n]+', ' ', 'g'))) as n from d""")
def page_text(spark, sf_dir):
    plain = table(spark, sf_dir, "pages").select("page_id", texts.plain_text(F.col("html")).alias("t"))
    return plain.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n"))


@query("select doc_id, 'doc-' || md5(text) as content_id, cast(ceil(length(text) / 4) as bigint) as tokens from documents")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.content_id(F.col("text")).alias("content_id"), texts.estimate_tokens(F.col("text")).alias("tokens"))


@query("""with d as (select o_orderkey, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y') when 1 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y-%m-%d') end as date, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as dd from orders)
select o_orderkey, date, round(case length(date) when 4 then y + 0.5 when 7 then y + (m - 0.5) / 12 else y + (m - 1 + (dd - 0.5) / [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]) / 12 end, 6) as x from d""")
def fractional_years(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return o.withColumn("x", F.round(texts.fraction_of_year(F.col("date")), 6))


@query("""with w as (select doc_id, regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+') as w from documents), x as (select doc_id, list_filter(w, lambda t: t <> '') as w from w), s as (select doc_id, w, unnest(generate_series(0, greatest(len(w) - 1, 0), 205)) as start from x where len(w) > 0)
select doc_id, start // 205 as chunk, least(256, len(w) - start) as n_words, md5(array_to_string(w[start + 1 : start + 256], ' ')) as content_md5 from s where start = 0 or start + 51 < len(w)""")
def fixed_chunks(spark, sf_dir):
    """Chunks of 256 words, 51 of them shared with the one before; a tail that only repeats is left out."""
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda t: t != "")
    w = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    each = w.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(205))).alias("start")).filter((F.col("start") == 0) | (F.col("start") + 51 < F.size("w")))
    return each.select("doc_id", F.expr("cast(start div 205 as bigint)").alias("chunk"), F.least(F.lit(256), F.size("w") - F.col("start")).cast("long").alias("n_words"), F.md5(F.array_join(F.slice("w", F.col("start") + 1, 256), " ").cast("binary")).alias("content_md5"))


@query("""select case when n_chars < 400 then '<100' when n_chars < 1200 then '100-299' when n_chars < 2400 then '300-599' when n_chars < 4000 then '600-999' else '1000+' end as bucket, count(*) as n, cast(min(n_chars) as bigint) as least, cast(max(n_chars) as bigint) as most from documents group by 1""")
def token_histogram(spark, sf_dir):
    n = F.col("n_chars")
    bucket = F.when(n < 400, "<100").when(n < 1200, "100-299").when(n < 2400, "300-599").when(n < 4000, "600-999").otherwise("1000+")
    return table(spark, sf_dir, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


_PAGED = "case when doc_id % 2 = 0 then replace(text, chr(10), chr(12)) else text end"


@query()
def paper_chunks(spark, sf_dir):
    """Chunks of every document, without page furniture (every other document's lines are pages)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PAGED.replace("chr(10)", "'\\n'").replace("chr(12)", "'\\f'")).alias("text"))
    chunks = chunking.chunk_documents(chunking.strip_furniture(docs), sizes=chunking.Sizes(256, 64, 24))
    return chunking.page_starts(chunks, docs).select("doc_id", "chunk_order_index", "section_title", "tokens", "raw_tokens", "overlap_prev_tokens", "page_start", F.md5(F.col("content").cast("binary")).alias("content_md5"))


_HEAD = """case doc_id % 12 when 0 then concat('  ', 1 + doc_id % 9, '. Introduction:') when 1 then 'RESULTS' when 2 then 'Data Analysis' when 3 then 'data analysis' when 4 then concat(doc_id, ' Author Name') when 5 then concat('2.', doc_id % 7, '. Word Norms of Use') when 6 then concat('2.1.', doc_id % 7, '. Word Norms')
    when 7 then concat('1.1. Word Decoding   ', doc_id) when 8 then concat('3. Related Work ', text, text, '.') when 9 then concat('Chapter ', doc_id, '. Of Words') when 10 then concat('so ', text) else concat('IX. Word norms are ', lang, '.') end"""


@query(f"""with h as (select doc_id, {_HEAD} as line from documents), s as (select doc_id, doc_id % 12 as k, trim(line, ' ' || chr(10) || chr(9) || chr(13)) as s from h)
select doc_id, case k when 0 then 'hard' when 1 then 'hard' when 2 then 'soft' when 5 then 'hard' when 6 then 'soft' when 8 then case when length(s) > 120 then 'hard' when regexp_matches(s, '\\.$') then 'none' else 'hard' end when 9 then 'hard' else 'none' end as kind,
    case k when 8 then case when length(s) > 120 then '3. Related Work' when regexp_matches(s, '\\.$') then '' else s end when 0 then s when 1 then s when 2 then s when 5 then s when 6 then s when 9 then s else '' end as title from s""")
def section_headers(spark, sf_dir):
    """Which lines are headers of sections, or of parts of one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_HEAD).alias("line"))
    return d.select("doc_id", headers.header(F.col("line"), chunking.SECTIONS).alias("h")).select("doc_id", "h.kind", "h.title")


@query()
def chunk_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.evaluate(chunking.chunk_documents(docs, sizes=chunking.Sizes(256, 64, 24)), chunking.Sizes(256, 64, 24))


_KIND = """case doc_id % 8 when 0 then text when 1 then concat('Contents{n}One 1{n}', text) when 2 then concat('Chapter 1{n}x{n}CHAPTER two{n}y{n}Part III{n}', text) when 3 then concat('Abstract{n}a{n}1. Introduction{n}b{n}2. METHODS:{n}', text) when 4 then concat('Chapter 1{n}Chapter 1{n}Chapter 2{n}x')
    when 5 then concat(' Table of Contents {n}Abstract{n}Methods{n}Results{n}', text) when 6 then concat('II. Results{n}III. Discussion{n}x') else '  ' end"""


@query(f"""with d as (select doc_id, replace({_KIND.format(n="' || chr(10) || '")}, chr(10), case when doc_id % 2 = 0 then chr(12) else chr(10) end) as t from documents), l as (select doc_id, t, list_transform(regexp_split_to_array(t, '[\n\f]'), lambda x: trim(lower(x))) as l, len(string_split(t, chr(12))) as pages from d),
c as (select *, len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '^(chapter|part) +([0-9]+|[ivx]+|two)($|[^a-z0-9_])')))) as chapters,
    len(list_intersect(list_distinct(list_transform(l, lambda x: regexp_replace(regexp_replace(x, '^([0-9]+\\.?|[ivx]+\\.) +', ''), '[.:]+$', ''))), ['abstract', 'introduction', 'background', 'methods', 'method', 'results', 'discussion', 'conclusion', 'conclusions', 'references'])) as core,
    list_has_any(l, ['contents', 'table of contents']) as contents from l)
select doc_id, case when trim(t, ' ' || chr(10) || chr(12)) = '' then 'paper' when contents or chapters >= 3 then 'book' when core >= 3 then 'paper' when pages >= 50 then 'book' else 'paper' end as kind from c""")
def document_kinds(spark, sf_dir):
    """The router by a contents page, chapters, sections of a paper, pages, and nothing of these; every other document's lines are pages."""
    made = F.expr(_KIND.format(n="\\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.replace(made, F.lit("\n"), F.lit("\f"))).otherwise(made).alias("t"))
    return d.select("doc_id", chunking.route(F.col("t")).alias("kind"))
