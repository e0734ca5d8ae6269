"""Answers and contexts as texts; filters merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import answers
from folioscope.operators import filters
from folioscope.plans.base import query
from folioscope.sources.views import table

_SAID = """concat('Claim ', c_custkey, '. [1][2] See (see [2]). Again [1]. [1] Also e.g. [3] works! [2, 3] A "quote." [1] Unknown [1, 9]. Twice [2]. ([2]) End {0} of it.', case when c_custkey % 2 = 0 then concat({1}, '## References', {1}, '1. not this') else '' end)"""
_DONE = """'Claim ' || c_custkey || ' (adams, 2001; Smith et al., 2019). See (adams, 2001). Again (Smith et al., 2019). Also e.g. (Reed ' || (c_custkey % 7) || ', 2010) works (adams, 2001; Reed ' || (c_custkey % 7) || ', 2010)! A "quote." (Smith et al., 2019) Unknown [1, 9]. Twice (adams, 2001) End ' || c_mktsegment || ' of it.'"""


@query(f"""select c_custkey as answer_id, {_DONE} || chr(10) || chr(10) || '### References' || chr(10) || chr(10) || '- Adams, A. (2001). *One*. (p. 4)' || chr(10) || '- Reed, R. (2010). *Two*. — https://x/3' || chr(10) || '- Smith, S. (2019). *Three*. (pp. 1, 9) — https://x/1' as text from customer""")
def rendered_answers(spark, sf_dir):
    """Numbers to names: moved into their sentences, unwrapped, said once, and listed with pages and places."""
    said = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("answer_id"), F.expr(_SAID.format("', c_mktsegment, '", r"'\n'")).alias("answer"), (F.col("c_custkey") % 7).alias("k"))
    one = lambda n, intext, apa, pages, locator: F.struct(F.lit(n).alias("n"), intext.alias("intext"), F.lit(apa).alias("apa"), F.lit(pages).alias("pages"), F.lit(locator).alias("locator"))
    listed = F.array(
        one(1, F.lit("Smith et al., 2019"), "Smith, S. (2019). *Three*.", "pp. 1, 9", "https://x/1"), one(2, F.lit("adams, 2001"), "Adams, A. (2001). *One*.", "p. 4", ""),
        one(3, F.concat(F.lit("Reed "), "k", F.lit(", 2010")), "Reed, R. (2010). *Two*.", "", "https://x/3"), one(4, F.lit("Uncited, 1900"), "Uncited.", "", ""),
    )
    references = said.select("answer_id", F.explode(listed).alias("r")).select("answer_id", "r.*")
    return answers.with_references(said.select("answer_id", "answer"), references)


@query("""with p as (select conv_id, turn, case when role = 'system' then null else role end as source, text from conversations), f as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as n from p where source is not null and coalesce(text, '') <> '')
select c.conv_id, '-----Sources (cite each supporting passage by its bracketed number)-----' || chr(10) || coalesce(string_agg('[' || n || '] ' || text, chr(10) || chr(10) order by n), '(no sources retrieved)') as context from (select distinct conv_id from conversations) c left join f using (conv_id) group by c.conv_id""")
def numbered_contexts(spark, sf_dir):
    """Each conversation's turns as the numbered passages of a question."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.when(F.col("role") != "system", F.col("role")).alias("source"), F.col("text").alias("content"))
    return answers.numbered_context(c, "conv_id")


@query("""with r as (select distinct conv_id, case role when 'user' then 1 when 'assistant' then 2 else 3 end as id, role || '.pdf' as file from conversations),
l as (select conv_id, string_agg('[' || id || '] ' || file, chr(10) order by id) as files from r group by 1), t as (select conv_id, string_agg('[' || case role when 'user' then 1 when 'assistant' then 2 else 3 end || '] ' || text, chr(10) || chr(10) order by turn) as texts from conversations where text <> '' group by 1)
select conv_id, '-----Reference Document List-----' || chr(10) || files || chr(10) || chr(10) || '-----Document Chunks-----' || chr(10) || coalesce(texts, '') as context from l left join t using (conv_id)""")
def referenced_contexts(spark, sf_dir):
    """The same with a list of what the passages are from."""
    n = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    c = table(spark, sf_dir, "conversations").select("conv_id", n.alias("reference_id"), F.concat("role", F.lit(".pdf")).alias("file_path"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    return answers.referenced_context(c.select("conv_id", "reference_id", "file_path").distinct(), c, "conv_id")


_A = "o_orderkey, [c_mktsegment, ' ' || c_mktsegment || ', C' || (o_orderkey % 3), '', 'Reed'] as a, ['Urgent', o_orderpriority] as j, [1990 + o_orderkey % 5, 1995] as ys, case when o_orderkey % 2 = 0 then 1996 end as y"
_B = "[lower(c_mktsegment), 'REED', 'Reed, J.'] as b, [o_orderpriority || ' ', 'High'] as k, case when o_orderkey % 3 = 0 then [1995, 1991] end as zs, case when o_orderkey % 4 = 0 then 1997 end as z"


@query(f"""with s as (select {_A}, {_B} from orders join customer on o_custkey = c_custkey),
u as (select o_orderkey, list_distinct(list_filter(list_transform(list_concat(a, b), lambda x: trim(x)), lambda x: x <> '')) as au, list_distinct(list_transform(list_concat(j, k), lambda x: trim(x))) as ju, list_sort(list_distinct(list_concat(ys, coalesce(zs, [])))) as yu, coalesce(z, y) as y from s),
n as (select *, list_transform(list_filter(au, lambda x: contains(x, ',') and trim(split_part(x, ',', 2)) <> ''), lambda x: lower(trim(split_part(x, ',', 1)))) as special from u)
select o_orderkey, array_to_string(list_sort(list_filter(au, lambda x: contains(x, ',') and trim(split_part(x, ',', 2)) <> '' or not list_contains(special, lower(trim(split_part(x, ',', 1)))))), '; ') as authors, array_to_string(list_sort(ju), '; ') as journals, array_to_string(yu, ',') as years, cast(y as varchar) as year,
    array_to_string(list_sort(list_filter(ju, lambda x: lower(x) <> 'urgent')), '; ') as journals_left from n""")
def merged_filters(spark, sf_dir):
    """Filters typed and filters found as one, people narrowing their family's bare name, and what a user dismissed dropped."""
    k, segment = F.col("o_orderkey"), F.col("c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = {"authors": F.array(segment, F.concat(F.lit(" "), segment, F.lit(", C"), k % 3), F.lit(""), F.lit("Reed")), "journals": F.array(F.lit("Urgent"), F.col("o_orderpriority")), "years": F.array((1990 + k % 5).cast("int"), F.lit(1995)), "year": F.when(k % 2 == 0, 1996)}
    b = {"authors": F.array(F.lower(segment), F.lit("REED"), F.lit("Reed, J.")), "journals": F.array(F.concat("o_orderpriority", F.lit(" ")), F.lit("High")), "years": F.when(k % 3 == 0, F.array(F.lit(1995), F.lit(1991))), "year": F.when(k % 4 == 0, 1997)}
    both = filters.merged(a, b)
    listed = lambda c: F.array_join(F.array_sort(c), "; ")
    left = filters.without_dismissed(both, ["journals:urgent"])
    return rows.select("o_orderkey", listed(both["authors"]).alias("authors"), listed(both["journals"]).alias("journals"), F.array_join(both["years"].cast("array<string>"), ",").alias("years"), both["year"].cast("string").alias("year"), listed(left["journals"]).alias("journals_left"))
