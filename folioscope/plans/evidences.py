"""File names and records held against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import texts
from folioscope.operators import evidence
from folioscope.plans.base import query
from folioscope.sources.views import table

#: What is known of a file for an order: reads the same in both dialects.
_NAME = "concat(upper(left(c_mktsegment, 1)), lower(substr(c_mktsegment, 2)))"
_FACTS = f"""o_orderkey as seq, case when o_orderkey % 13 = 0 then null when o_orderkey % 11 = 0 then c_mktsegment else {_NAME} end as author, case o_orderkey % 4 when 0 then 'Etal' when 1 then 'ETAL' when 2 then '' else 'Moss' end as author2, 1990 + cast(o_orderkey % 10 as int) as year,
    o_orderkey % 7 <> 0 as has_text, case o_orderkey % 3 when 0 then 'yes' when 1 then 'no' else 'short' end as found,
    case o_orderkey % 5 when 0 then null when 1 then {_NAME} when 2 then concat({_NAME}, 'ü') when 3 then concat('Quorth-', {_NAME}) else 'Ångström' end as record_family, case o_orderkey % 6 when 0 then null when 1 then 1993 + cast(o_orderkey % 10 as int) else 1990 + cast(o_orderkey % 10 as int) end as record_year"""
_FILENAME = "case when author is null then concat('odd ', seq) else concat(author, case when author2 <> '' then concat('_', author2) else '' end, '_', year, '.pdf') end"


@query(f"""with f as (select *, {_FILENAME} as filename from (select {_FACTS} from orders join customer on o_custkey = c_custkey)), g as (select *, lower(author) as own, regexp_replace(lower(strip_accents(coalesce(record_family, ''))), '[^a-z]', '', 'g') as fam, has_text and found = 'yes' as on_page, coalesce(abs(record_year - year) <= 1, true) as dated from f),
m as (select *, own = fam or starts_with(fam, 'quorth') as hit from g),
v as (select *, case when author is null then 'FORMAT' when fam <> '' and hit and dated then 'OK' when fam <> '' and (hit or not on_page) then 'MISMATCH' when not has_text or found = 'short' then 'UNVERIFIABLE' when found = 'no' then 'SUSPECT' else 'OK' end as verdict from m),
t as (select *, case when verdict = 'MISMATCH' and hit then case when record_year is not null then 'year' end when verdict = 'MISMATCH' and fam <> '' then case when levenshtein(own, fam) <= 3 then 'slip' else 'other' end when verdict = 'OK' and (author = upper(author) or author2 = 'ETAL') then 'style' end as tier,
    regexp_replace(strip_accents(coalesce(record_family, '')), '[^A-Za-z''-]', '', 'g') as clean, case when author2 <> '' then '_' || author2 else '' end as mid from v),
p as (select seq, filename, verdict, tier, case tier when 'year' then author || mid || '_' || record_year || '.pdf' when 'slip' then clean || mid || '_' || year || '.pdf' when 'other' then clean || mid || '_' || coalesce(record_year, year) || '.pdf'
    when 'style' then case when author = 'MACHINERY' then 'MacHinery' else left(author, 1) || lower(substr(author, 2)) end || replace(mid, 'ETAL', 'Etal') || '_' || year || '.pdf' end as proposal from t)
select seq, filename, verdict, case when proposal <> filename then tier end as tier, case when proposal <> filename then proposal end as proposal from p""")
def name_verdicts(spark, sf_dir):
    """What the first page and a record say of a file's name, and how it should be called."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    facts = joined.select(F.expr(f"inline(array(named_struct({_named(_FACTS)})))")).withColumn("filename", F.expr(_FILENAME))
    return evidence.verdicts(facts).select("seq", "filename", "verdict", "tier", "proposal")


def _named(listed: str) -> str:
    """A select list as the arguments of named_struct: commas outside brackets part them."""
    out, depth = [""], 0
    for c in listed:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return ", ".join(f"'{name}', {expr}" for expr, _, name in (x.strip().rpartition(" as ") for x in out))


_FAMILY = "case c_custkey % 8 when 0 then {n} when 1 then concat('von ', {n}) when 2 then concat('Mo', chr(195), chr(188), 'ller') when 3 then 'Strøm' when 4 then 'Moss Research Group' when 5 then concat('Ha', chr(195), 'x') when 6 then 'Quorth' else concat('Str', chr(195), chr(184), 'm') end"
_FILE = "concat(case c_custkey % 8 when 2 then 'Mouller' when 3 then 'Strom' when 7 then 'Strom' else {n} end, '_', 1990 + c_custkey % 9, '_', c_custkey, '.pdf')"


@query(f"""with f as (select c_custkey % 8 as k, {_FILE.format(n=_NAME)} as filename, {_FAMILY.format(n=_NAME)} as family from customer)
select filename, ['', '', 'GARBLED_NAME', 'FALSE_POSITIVE', 'CORPORATE', 'GARBLED_NAME', 'WRONG_UNRESOLVED', 'GARBLED_NAME'][k + 1] as category, k in (2, 7) as repaired, case k when 2 then 'Moüller' when 7 then 'Strøm' else family end as families from f where k > 1""")
def name_mismatches(spark, sf_dir):
    """Records whose authors are not those of the file's name, by kind, with bytes decoded anew where that settles it."""
    c = table(spark, sf_dir, "customer").select(F.expr(_FILE.format(n=_NAME)).alias("filename"), F.array(F.expr(_FAMILY.format(n=_NAME)), F.lit(None).cast("string")).alias("families"))
    return evidence.name_mismatches(c).withColumn("families", F.array_join("families", "; "))


@query(f"""with f as (select c_custkey, {_NAME} as n, c_custkey % 5 as k from customer), x as (select *, case when k >= 3 then 'etal' when k = 2 and c_custkey % 2 = 0 then 'two' when k = 2 then 'two-noname' else 'one' end as t, c_custkey % 7 <> 0 and c_custkey % 11 <> 0 as fine from f)
select c_custkey, case when fine then n || case t when 'etal' then '_Etal' when 'two-noname' then '_Etal' when 'two' then '_ONeil-Sa' else '' end || '_' || (1990 + c_custkey % 9) || '.pdf' end as name, case when fine then t end as tier from x""")
def proposed_names(spark, sf_dir):
    """Names for files from what was read of their first pages."""
    k = F.col("c_custkey")
    fields = table(spark, sf_dir, "customer").select(k, F.concat(F.expr(_NAME), F.lit(" .")).alias("first"), F.when(k % 2 == 0, "ONeil-Sá").alias("second"), F.concat(F.lit("c. "), 1990 + k % 9, F.lit("?")).alias("year"), (k % 5).alias("n_authors"), (k % 7 != 0).alias("citable"), F.when(k % 11 == 0, "low").otherwise("high").alias("confidence"))
    return evidence.proposed_name(fields).select("c_custkey", "name", "tier")


@query("select name, url from (select 'Paper_' || l_partkey || case when l_partkey % 3 = 0 then '.PDF' when l_partkey % 3 = 1 then '.pdf' else '.txt' end as name, 'https://x/' || l_orderkey || '/' || l_linenumber as url, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as r from lineitem where l_partkey % 3 < 2) where r = 1")
def first_links(spark, sf_dir):
    """The first link of each file's name."""
    part = F.col("l_partkey") % 3
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Paper_"), "l_partkey", F.when(part == 0, ".PDF").when(part == 1, ".pdf").otherwise(".txt")).alias("name"), F.concat_ws("/", F.lit("https://x"), "l_orderkey", "l_linenumber").alias("url"), F.struct("l_orderkey", "l_linenumber").alias("seq"))
    return evidence.first_wins(pairs).select("name", "url")


@query("""with s as (select doc_id, 'doc-' || md5(case when doc_id % 3 = 0 then text || '!' else text end) as content_id from documents), c as (select distinct 'doc-' || md5(left(trim(text), 4000)) as content_id from documents where trim(text) <> '') select doc_id, content_id from s semi join c using (content_id)""")
def canonical_store(spark, sf_dir):
    """A store's rows whose text, cut to a thousand tokens, is still there."""
    d = table(spark, sf_dir, "documents")
    store = d.select("doc_id", texts.content_id(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_id"))
    return evidence.only_canonical(store, evidence.canonical_ids(d, "text", 1000)).select("doc_id", "content_id")
