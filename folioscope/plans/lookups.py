"""Lookups, suggestions, samples, authors, clusters and graph retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import citing, normalise
from folioscope.operators import graph, lookups
from folioscope.plans.base import query
from folioscope.sources.views import GRAPH_SQL, PAPERS_SQL, graph_edges, graph_nodes, papers, table, vectors

_WITH = f"with {PAPERS_SQL} "
_BYLINE = "case seq % 4 when 0 then family when 1 then concat(family, ' & Other') when 2 then concat(family, ' et al.') else concat(family, '  & Third &  Fourth') end"


@query(_WITH + "select filename, title, family as first_family, coalesce(cast(year as int), 0) as year from papers order by lower(filename), filename")
def papers_index(spark, sf_dir):
    """Every paper in short, in order of its file's name."""
    short = papers(spark, sf_dir).select("filename", "title", F.col("family").alias("first_family"), F.coalesce(F.expr("try_cast(year as int)"), F.lit(0)).alias("year"))
    return short.orderBy(F.lower("filename"), "filename")


@query(_WITH + "select filename, type, family, given, coalesce(year, '') as year, title, container_title, array_to_string(keywords, '; ') as keywords, family || ', ' || coalesce(year, 'n.d.') as intext from papers where filename = 'Paper_7.pdf'")
def paper_record(spark, sf_dir):
    """One paper's whole record with its citation."""
    p = papers(spark, sf_dir).filter(F.col("filename") == "Paper_7.pdf")
    none = F.lit("")
    r = F.struct(F.array(F.struct("family", "given")).alias("authors"), F.array().cast("array<struct<family:string,given:string>>").alias("editors"), "year", none.alias("disambig"), F.lit(False).alias("etal"), "title", "container_title")
    return p.select("filename", "type", "family", "given", F.coalesce("year", none).alias("year"), "title", "container_title", F.array_join("keywords", "; ").alias("keywords"), citing.intext(r).alias("intext"))


@query("select cast(i - 1 as int) as place, vec_id as chunk_id, round(embedding[1]::double, 5) as first from (select unnest([11, 3, 999999999, 42, 7]) as want, unnest(range(1, 6)) as i) join embeddings on vec_id = want")
def vector_lookup(spark, sf_dir):
    """Vectors of some chunks, in the order asked for."""
    found = lookups.in_order(vectors(spark, sf_dir), "chunk_id", [11, 3, 999_999_999, 42, 7])
    return found.select("place", "chunk_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("select cast(i - 1 as int) as place, doc_id, source as file, left(text, 6000) as text from (select unnest([12, 5, -4, 130]) as want, unnest(range(1, 5)) as i) join documents on doc_id = want")
def chunk_texts(spark, sf_dir):
    """Texts of some chunks, 6000 characters at most as the interface has it, in the order asked for."""
    found = lookups.in_order(table(spark, sf_dir, "documents"), "doc_id", [12, 5, -4, 130])
    return found.select("place", "doc_id", F.col("source").alias("file"), F.substring("text", 1, 6000).alias("text"))


@query("select p_name from (select distinct p_name from part) where contains(lower(p_name), 'd') order by not starts_with(lower(p_name), 'd'), length(p_name), lower(p_name), p_name limit 8")
def facet_suggestions(spark, sf_dir):
    return lookups.suggestions(table(spark, sf_dir, "part"), "p_name", "D", 8)


@query("""with a as (select s_suppkey as author_id, lower(s_name) as name, lower('Nation ' || s_nationkey) as family, count(l_orderkey) as n_papers from supplier left join lineitem on l_suppkey = s_suppkey group by 1, 2, 3),
s as (select author_id, case when name = 'nation 1' then 400 when family = 'nation 1' then 300 when starts_with(name, 'nation 1') or starts_with(family, 'nation 1') then 200 when contains(name, 'nation 1') then 100 end + least(60, n_papers) as score from a) select author_id, score from s where score is not null order by score desc, author_id limit 1""")
def author_lookup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    authors = table(spark, sf_dir, "supplier").join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"), F.concat(F.lit("Nation "), "s_nationkey").alias("family"), F.coalesce("n", F.lit(0)).alias("n_papers"))
    return lookups.find_author(authors, " NATION 1").select("author_id", "score")


@query("""with p as (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) - 1 as i, count(*) over (partition by source) as n from documents)
select source, doc_id from p where n <= 7 or i in (0, n * 1 // 7, n * 2 // 7, n * 3 // 7, n * 4 // 7, n * 5 // 7, n * 6 // 7)""")
def spread_sample(spark, sf_dir):
    """Seven documents of each source, spread over their lengths."""
    return lookups.spread_sample(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 7).select("source", "doc_id")


@query(_WITH + """select family as author, count(*) as n_papers, cast(sum(n_pages) as bigint) as n_chunks, coalesce(min(cast(year as int)), 0) as year_min, coalesce(max(cast(year as int)), 0) as year_max from papers group by 1""")
def author_stats(spark, sf_dir):
    """Papers, chunks and years of first authors, read from bylines."""
    return lookups.author_stats(papers(spark, sf_dir).select(F.expr(_BYLINE).alias("byline"), F.col("n_pages").alias("n_chunks"), F.expr("try_cast(year as int)").alias("year")))


@query(_WITH + """, e as (select seq, 0 as side, unnest(keywords) as t, unnest(range(len(keywords))) as pos from papers union all select seq, 1, unnest(subjects), unnest(range(len(subjects))) from papers),
c as (select lower(trim(t)) as term, count(*) as n, min({'a': seq, 'b': side, 'c': pos}) as first_at from e group by 1) select term, n from (select * from c order by n desc, first_at limit 90) where term <> '' and n >= 10""")
def baseline_terms(spark, sf_dir):
    return lookups.baseline_terms(papers(spark, sf_dir))


@query("""with f as (select distinct p_brand as name, p_name as d from part), c as (select name, count(*) as n_fragments, cast(ceil((sum(length(d)) + 5 * (count(*) - 1)) / 4) as bigint) as n_tokens from f group by 1)
select * from c where n_fragments >= 2 and (n_fragments >= 8 or n_tokens >= 1200)""")
def summary_candidates(spark, sf_dir):
    """Entities whose merged description is long enough to be written anew."""
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_name").alias("description"), F.col("p_partkey").alias("chunk"))
    return lookups.summary_candidates(graph.merged_descriptions(f)).select("name", F.col("n_fragments").cast("long").alias("n_fragments"), "n_tokens")


@query("""with n as (select cast(ceil(length(text) / 4) as bigint) as t from documents where text is not null), l as (select list_sort(list(t)) as l, count(*) as n from n)
select l[least(n - 1, n * 50 // 100) + 1] as p50, l[least(n - 1, n * 90 // 100) + 1] as p90, l[least(n - 1, n * 99 // 100) + 1] as p99, l[n] as greatest from l""")
def token_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of the documents' estimated tokens."""
    return lookups.nearest_rank(table(spark, sf_dir, "documents").filter("text is not null").select(F.ceil(F.length("text") / 4).alias("t")), "t", [50, 90, 99])


@query("select (select count(*) from (select vec_id from embeddings intersect select doc_id + 100 from documents)) as both, (select count(*) from (select vec_id from embeddings except select doc_id + 100 from documents)) as only_a, (select count(*) from (select doc_id + 100 from documents except select vec_id from embeddings)) as only_b")
def corpus_overlap(spark, sf_dir):
    """How the files of two stores meet."""
    return lookups.overlap(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k")), table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("k")), "k")


@query("select k, count(*) as n, cast(sum(length(text)) as bigint) as chars from (select doc_id % 4 as k, text from documents) group by 1")
def interleaved_shards(spark, sf_dir):
    """What each of four interleaved shards holds."""
    d = table(spark, sf_dir, "documents")
    parts = [lookups.shard(d, "doc_id", 4, k).agg(F.lit(k).cast("long").alias("k"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")) for k in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")


_PLACED = "with p as (select vec_id as chunk_id, label as cluster, vec_id % 37 as paper, 'Title of paper ' || (vec_id % 37) as title, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y from embeddings)"


def _placed(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("cluster"), (F.col("vec_id") % 37).alias("paper"), F.concat(F.lit("Title of paper "), F.col("vec_id") % 37).alias("title"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(_PLACED + """, s as (select cluster, count(*) as size, count(distinct paper) as n_papers, round(avg(x), 6) as x, round(avg(y), 6) as y from p group by 1),
r as (select cluster, any_value(title) as title, row_number() over (partition by cluster order by count(*) desc, min(chunk_id)) as r from p group by cluster, paper)
select s.*, (select string_agg(title, '; ' order by r) from r where r.cluster = s.cluster and r.r <= 8) as titles from s""")
def cluster_summaries(spark, sf_dir):
    return lookups.cluster_summaries(_placed(spark, sf_dir)).withColumn("titles", F.array_join("titles", "; "))


@query(_PLACED + "select paper, count(*) as n_chunks, round(avg(x), 6) as x, round(avg(y), 6) as y from p group by 1")
def paper_places(spark, sf_dir):
    """Where each paper lies on the map."""
    return lookups.paper_places(_placed(spark, sf_dir))


_ID = "concat('doc-', md5(cast(doc_id as varchar(20))), '-chunk-', case doc_id % 4 when 0 then '007' when 1 then cast(doc_id as varchar(20)) when 2 then '0012' else 'x' end)"


@query(f"""with i as (select {_ID} as chunk_id from documents), m as (select chunk_id, regexp_extract(chunk_id, '^doc-([0-9a-f]{{32}})-chunk-([0-9]+)$', ['h', 'n']) as m from i)
select chunk_id, m.h as doc_hash, coalesce(try_cast(nullif(m.n, '') as int), -1) as number, m.n <> '' and 'doc-' || m.h || '-chunk-' || lpad(cast(cast(nullif(m.n, '') as int) as varchar), cast(greatest(3, length(cast(cast(nullif(m.n, '') as int) as varchar))) as int), '0') = chunk_id as round_trip from m""")
def chunk_id_parts(spark, sf_dir):
    return lookups.chunk_id_parts(table(spark, sf_dir, "documents").select(F.expr(_ID).alias("chunk_id"))).withColumn("number", F.coalesce("number", F.lit(-1)))


def _index(spark, sf_dir):
    return graph.entity_index(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir))


@query(f"with {GRAPH_SQL} select name from idx where lower(name) = 'brand#3' order by degree desc, lower(name), name limit 1")
def canonical_entity(spark, sf_dir):
    return lookups.canonical_name(_index(spark, sf_dir), " BRAND#3 ")


@query(f"""with {GRAPH_SQL}, m as (select distinct s_name as name, l_orderkey as chunk_id from lineitem join supplier on l_suppkey = s_suppkey), h as (select name, count(*) as n_chunks, round(avg(embedding[1]::double), 6) as x, round(avg(embedding[2]::double), 6) as y, array_to_string(list_sort(list(chunk_id))[:12], ', ') as chunks from m join embeddings on vec_id = chunk_id group by 1)
select name, degree, n_chunks, x, y, chunks from h join idx using (name) order by degree desc, name limit 15""")
def constellations(spark, sf_dir):
    """Entities of greatest degree with their place among the chunks they were found in."""
    members = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("name"), F.col("l_orderkey").alias("chunk_id"))
    return lookups.constellations(members, _placed(spark, sf_dir).select("chunk_id", "x", "y"), _index(spark, sf_dir), 15).withColumn("chunks", F.array_join(F.col("chunks").cast("array<string>"), ", "))


@query(f"""with {GRAPH_SQL}, e as (select s_name as name, round((s_acctbal + 1000) / 11000, 6) as score from supplier), rel as (select src, dst, weight, round((ascii(substr(dst, length(dst))) % 10) / 10.0, 6) as score from edges),
le as (select * from e where score >= 0.2 order by score desc, name limit 20), oe as (select distinct s_name as name, l_orderkey as chunk_id from lineitem join supplier on l_suppkey = s_suppkey),
lc as (select chunk_id, row_number() over (order by s desc, n desc, chunk_id) as turn, 0 as side from (select chunk_id, max((score, name))[1] as s, max((score, name))[2] as n from le join oe using (name) group by 1) qualify turn <= 200),
re as (select src, dst, weight * (a.degree + b.degree) as strength from rel join idx a on a.name = src join idx b on b.name = dst where score >= 0.2 order by strength desc, src, dst limit 20),
orel as (select distinct s_name as src, unnest([p_brand, p_type]) as dst, l_orderkey as chunk_id from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey),
rc as (select chunk_id, row_number() over (order by m desc, chunk_id) as turn, 1 as side from (select chunk_id, max({{'strength': strength, 'src': src, 'dst': dst}}) as m from re join orel using (src, dst) group by 1) qualify turn <= 200),
u as (select *, row_number() over (partition by chunk_id order by turn, side) as k from (from lc union all from rc))
select chunk_id, row_number() over (order by turn, side) as rank, side from u where k = 1 order by rank limit 20""".replace("max((score, name))[1] as s, max((score, name))[2] as n", "max({'s': score, 'n': name}) as b").replace("order by s desc, n desc, chunk_id", "order by b desc, chunk_id"))
def graph_retrieval(spark, sf_dir):
    """Hybrid retrieval: chunks of the entities and of the relations that keywords met, in turn."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    entities = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.round((F.col("s_acctbal") + 1000) / 11000, 6).alias("score"))
    relations = graph_edges(spark, sf_dir).withColumn("score", F.round((F.ascii(F.substring("dst", -1, 1)) % 10) / 10.0, 6)).select("src", "dst", "weight", "score")
    of_entity = lines.select(F.col("s_name").alias("name"), F.col("l_orderkey").alias("chunk_id")).distinct()
    of_relation = lines.select(F.col("s_name").alias("src"), F.explode(F.array("p_brand", "p_type")).alias("dst"), F.col("l_orderkey").alias("chunk_id")).distinct()
    return lookups.graph_retrieve(entities, relations, _index(spark, sf_dir), of_entity, of_relation).withColumn("rank", F.col("rank").cast("long"))


_CITES = "case l_linenumber % 5 when 0 then concat(p_brand, ' & Other, 2001') when 1 then concat(p_brand, ' et al., 1999') when 2 then concat('Other & ', p_brand, ', 2001') when 3 then concat(p_brand, '-Hyphen, 2005') else concat(p_brand, '2, 2005') end"


@query(f"select l_orderkey, l_linenumber, case when l_linenumber % 5 in (0, 1, 3) then 'led' else 'contributed' end as tag from lineitem join part on l_partkey = p_partkey")
def persona_tags(spark, sf_dir):
    """Whether an author led the work that a passage comes from, by its citation."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    led = normalise.is_first_author(F.expr(_CITES), F.col("p_brand"))
    return lines.select("l_orderkey", "l_linenumber", F.when(led, "led").otherwise("contributed").alias("tag"))


_LIST = "array(concat(' ', lower(p_type), '  x'), concat(p_type, ' x'), p_name, upper(p_name), concat(p_name, ' '), '', lower(p_brand))"
_LIST_SQL = "[' ' || lower(p_type) || '  x', p_type || ' x', p_name, upper(p_name), p_name || ' ', '', lower(p_brand)]"


@query(f"""with v as (select p_partkey, list_filter(list_transform({_LIST_SQL}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') as l from part), e as (select p_partkey, unnest(l) as x, unnest(range(len(l))) as i from v),
k as (select p_partkey, lower(x) as k, min(i) as i, coalesce(arg_min(x, i) filter (x <> lower(x)), arg_min(x, i)) as x from e group by 1, 2)
select p_partkey, string_agg(x, '|' order by i) as subjects, string_agg(k, '|' order by i) as keywords, 'Brown ' || p_brand as affiliations, p_name || ' in short.' as abstract from k join part using (p_partkey) group by p_partkey, p_brand, p_name""")
def clean_fields(spark, sf_dir):
    """Subjects, keywords, affiliations and abstracts cleaned as a record is built."""
    p = table(spark, sf_dir, "part")
    affiliations = F.array(F.concat(F.lit("2Brown  "), "p_brand", F.lit(",; ")), F.concat(F.lit("12 Brown "), "p_brand"), F.concat(F.lit("brown "), F.lower("p_brand")))
    abstract = F.concat(F.lit("<jats:title>Abstract</jats:title>: <p>"), "p_name", F.lit("\n in <i>short</i>.</p>"))
    joined = lambda c: F.array_join(c, "|")
    return p.select("p_partkey", joined(normalise.without_case_repeats(F.expr(_LIST))).alias("subjects"), joined(normalise.clean_keywords(F.expr(_LIST))).alias("keywords"), joined(normalise.clean_affiliations(affiliations)).alias("affiliations"), F.replace(normalise.abstract_text(abstract), F.lit(" ."), F.lit(".")).alias("abstract"))
