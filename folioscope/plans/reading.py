"""What is read and shown: passages of uploads, lenses, entity cards, plain texts, free names."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import plaintext
from folioscope.operators import graph, store, uploads
from folioscope.operators.ranks import dealt
from folioscope.plans.base import query
from folioscope.plans.passages import _CHUNKS
from folioscope.sources.views import GRAPH_SQL, PAPERS_SQL, graph_edges, graph_nodes, papers, table, text_chunks

#: A word of many passages, and one of few: the first fills the budget, the second leaves the papers' beginnings to fill up.
_COMMON, _RARE = "the ", "edithon"


def _uploads_sql(word: str) -> str:
    return f"""with {_CHUNKS}, r as (select source as paper, doc_id * 1000 + chunk as idx, cast(ceil(length(content) / 4) as bigint) as tokens, cast(len(string_split(lower(content), '{word}')) - 1 as double) as score from chunks), a as (select max(score) > 0 as any_match from r),
h as (select *, row_number() over (partition by paper order by case when any_match then -score else 0 end, idx) as nth from r, a), f as (select * from (select *, coalesce(sum(tokens) over (order by paper, nth rows between unbounded preceding and 1 preceding), 0) as before from h where nth <= 2) where before < 30000),
p as (select *, coalesce(sum(tokens) over (order by case when any_match then -score else 0 end, idx, paper rows between unbounded preceding and 1 preceding), 0) as before from r, a where (score > 0 or not any_match) and (paper, idx) not in (select paper, idx from f)),
t as (select paper, idx, tokens from f union all select paper, idx, tokens from p where before + (select sum(tokens) from f) < 30000),
m as (select *, coalesce(sum(tokens) over (order by paper, idx rows between unbounded preceding and 1 preceding), 0) as before from r where (paper, idx) not in (select paper, idx from t))
select paper, idx, tokens, 'ranked' as strategy from t union all select paper, idx, tokens, 'ranked' from m where before + (select sum(tokens) from t) < 6000"""


def _selected(spark, sf_dir, word: str):
    c = text_chunks(spark, sf_dir)
    score = F.size(F.split(F.lower("content"), word, -1)) - 1
    return uploads.select_passages(c.select(F.col("source").alias("paper"), (F.col("doc_id") * 1000 + F.col("chunk")).alias("idx"), F.ceil(F.length("content") / 4).alias("tokens"), score.alias("score")))


@query(_uploads_sql(_COMMON))
def upload_passages(spark, sf_dir):
    """Two passages of each source, then the best of all within the budget."""
    return _selected(spark, sf_dir, _COMMON)


@query(_uploads_sql(_RARE))
def upload_beginnings(spark, sf_dir):
    """The same for a word that few passages hold: the sources' beginnings fill up."""
    return _selected(spark, sf_dir, _RARE)


@query(f"""with {PAPERS_SQL}, s as (select filename, family = 'BUILDING' and contains(lower(container_title), 'e') and (contains(lower(concat_ws(' | ', title, '', array_to_string(keywords, ' | '), array_to_string(subjects, ' | '))), 'economy') or contains(lower(concat_ws(' | ', title, '', array_to_string(keywords, ' | '), array_to_string(subjects, ' | '))), 'blue')) as seen from papers)
select 'Paper_' || l_orderkey || '.pdf' as file_path, l_linenumber, seen from lineitem join s on filename = 'Paper_' || l_orderkey || '.pdf'""")
def lens_chunks(spark, sf_dir):
    """Which chunks (lines) the lens of an author, a journal and two words shows."""
    p = papers(spark, sf_dir)
    seen = uploads.lens(p, p.filter("family = 'BUILDING'"), "E", " economy |Blue| ")
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Paper_"), "l_orderkey", F.lit(".pdf")).alias("file_path"), "l_linenumber")
    return uploads.seen_chunks(lines, seen)


_LEAD = "with " + GRAPH_SQL + ", lead as (select src as name from edges group by 1 order by sum(weight) desc, src limit 1), "


@query(_LEAD + """t as (select r.other as entity, case when coalesce(i.entity_type, '') = '' then 'unknown' else i.entity_type end as entity_type, i.degree, weight from pairs_by_end r join idx i on i.name = r.other where r.name = (select name from lead))
select (select name from lead) as name, entity, entity_type, degree, weight, (select name from lead) || ' supplies ' || entity as description, 'supply, ' || entity as keywords, row_number() over (order by weight desc, degree desc, lower(entity), entity) as rank from t qualify rank <= 60""")
def entity_relations(spark, sf_dir):
    """The strongest supplier's relations with what each says."""
    edges = graph_edges(spark, sf_dir).withColumn("keywords", F.concat(F.lit("supply,\n "), "dst"))
    name = _lead(edges)
    _, relations = graph.entity_card(graph_nodes(spark, sf_dir).withColumn("description", F.col("name")), edges, name)
    return relations.select(F.lit(name).alias("name"), "entity", "entity_type", "degree", "weight", "description", "keywords", F.col("rank").cast("long").alias("rank"))


def _lead(edges) -> str:
    return edges.groupBy("src").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "src").first().src


@query(_LEAD + """n as (select * from idx where name = (select name from lead)) select name, case when coalesce(entity_type, '') = '' then 'unknown' else entity_type end as type, name || ' makes things of many kinds.' as description, degree, degree as n_relations, n_papers, array_to_string(list_sort(files), ',') as files from n""")
def entity_cards(spark, sf_dir):
    """The strongest supplier's card."""
    edges = graph_edges(spark, sf_dir).withColumn("keywords", F.lit(""))
    nodes = graph_nodes(spark, sf_dir).withColumn("description", F.concat(F.lit("  "), "name", F.lit(" makes things\n\n of   many kinds. ")))
    card, _ = graph.entity_card(nodes, edges, _lead(edges))
    return card.withColumn("files", F.array_join(F.array_sort("files"), ","))


_MARKED = """concat('# ', c_name, '{n}{n}{n}{n}> **bold *and _both_* here** of [a link](http://x/', c_custkey, ') ![pic](u){n}---{n}  * one `code` two{n}```sql{n}x_1{n}```{n}***', c_mktsegment, '***{n}1\\\\*2 \\\\[end\\\\]  ')"""


@query("""select c_custkey, c_name || chr(10) || chr(10) || 'bold and both here of a link pic' || chr(10) || chr(10) || '  • one code two' || chr(10) || 'x_1' || chr(10) || c_mktsegment || chr(10) || '1*2 [end]' as text,
'References' || chr(10) || chr(10) || '[1] ' || c_name || '. Title.' || chr(10) || chr(10) || '[2] f' || c_custkey || '.pdf' as listed from customer""")
def plain_markdown(spark, sf_dir):
    """Formatted texts as they read."""
    c = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    refs = plaintext.numbered_references(F.array(F.concat("c_name", F.lit(". *Title*.")), F.lit("")), F.array(F.lit("x.pdf"), F.concat(F.lit("f"), "c_custkey", F.lit(".pdf"))))
    return c.select("c_custkey", plaintext.plain_markdown(F.expr(_MARKED.format(n="\\n"))).alias("text"), refs.alias("listed"))


@query("""select p_partkey, 'It is 5% of $$' || p_size || '\\%$$ and $' || p_name || ' 7\\%$, 3% off; ' || chr(10) || '$$a \\% b$$' || chr(10) || ' and $x \\% ' || p_size || '$ at $5' as text from part""")
def formulas(spark, sf_dir):
    """Formulas between dollars, per cent signs escaped within them alone."""
    text = F.concat(F.lit("It is 5% of $$"), "p_size", F.lit("%$$ and $"), "p_name", F.lit(r" 7\%$, 3% off; \[a % b\] and \(x % "), "p_size", F.lit(r"\) at $5"))
    return table(spark, sf_dir, "part").select("p_partkey", plaintext.plain_math(text).alias("text"))


_ENTITY = "case p_partkey % 6 when 0 then concat('Table ', p_size) when 1 then 'participants' when 2 then concat('fig. ', p_size, 'b') when 3 then p_name when 4 then concat('study of ', p_name) else concat(' Model', p_size, ' ') end"


@query(f"select p_partkey, {_ENTITY} as name, p_partkey % 6 in (0, 1, 2, 5) as generic from part")
def generic_names(spark, sf_dir):
    """Which names of entities are a paper's furniture."""
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_ENTITY).alias("name")).withColumn("generic", plaintext.is_generic(F.col("name")))


@query("""with t as (select l_suppkey as k, list_sort(list_distinct(list('moss_' || (1990 + l_linenumber) || case when l_partkey % 2 = 0 then 'a' else 'b' end || '.pdf'))) as taken from lineitem group by 1),
n as (select k, taken, 'Moss_' || (1990 + k % 9) || '.pdf' as dated, 'odd name.pdf' as plain from t)
select k, replace(dated, '.pdf', '') || chr(cast(97 + list_position(list_transform(['a', 'b', 'c'], lambda x: list_contains(taken, lower(replace(dated, '.pdf', '') || x || '.pdf'))), false) - 1 as int)) || '.pdf' as lettered, 'odd name_2.pdf' as counted from n""")
def free_names(spark, sf_dir):
    """The next free name of a paper beside those that its folder holds."""
    name = F.concat(F.lit("moss_"), 1990 + F.col("l_linenumber"), F.when(F.col("l_partkey") % 2 == 0, "a").otherwise("b"), F.lit(".pdf"))
    taken = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set(name).alias("taken"))
    dated = F.concat(F.lit("Moss_"), 1990 + F.col("k") % 9, F.lit(".pdf"))
    return taken.select("k", store.free_name(dated, F.col("taken")).alias("lettered"), store.free_name(F.lit("odd name.pdf"), F.col("taken")).alias("counted"))
