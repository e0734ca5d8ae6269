"""Passage ranking, digests and retrieval evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import passages
from folioscope.operators.ranks import numbered
from folioscope.plans.base import query
from folioscope.sources.views import table, text_chunks

_Q = "The edithon of therein and thingon"
_CHUNKS = "chunks as (select doc_id, source, i - 1 as chunk, content from (select doc_id, source, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where trim(content) <> '')"
_STOP = ", ".join(f"'{w}'" for w in passages.STOPWORDS)
_BM25 = f"""with {_CHUNKS}, t as (select doc_id, chunk, source, list_filter(regexp_extract_all(lower(content), '[a-z0-9][a-z0-9''-]*'), lambda x: length(x) > 1 and x not in ({_STOP})) as t from chunks),
facts as (select count(*) as n, avg(len(t)) as avg_len from t), terms as (select unnest({passages.query_terms(_Q)!r}) as term),
hits as (select doc_id, chunk, source, len(t) as len, term, len(list_filter(t, lambda x: x = term)) as tf from t, terms where list_contains(t, term)), df as (select term, count(*) as df from hits group by 1),
scored as (select doc_id, chunk, source, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) as score from hits join df using (term), facts group by 1, 2, 3) """


#: Chunks of retrieval_scores: characters, distance of their starts, and how many are retrieved for an item.
CHUNK_CHARS, CHUNK_STEP, TOP_CHUNKS = 1000, 800, 10


@query(_BM25 + "select doc_id, cast(chunk as int) as chunk, round(score, 6) as score from scored")
def bm25(spark, sf_dir):
    return passages.bm25(text_chunks(spark, sf_dir), _Q, ["doc_id", "chunk"]).withColumn("score", F.round("score", 6))


@query(_BM25 + """, top as (select *, row_number() over (order by round(score, 6) desc, doc_id, chunk) as rank from scored), s as (select r.*, cast(ceil(length(content) / 4) as bigint) as tokens from top r join chunks c on c.doc_id = r.doc_id and c.chunk = r.chunk),
b as (select *, coalesce(sum(tokens) over (order by rank rows between unbounded preceding and 1 preceding), 0) as before, row_number() over (partition by source order by rank) as nth from s)
select doc_id, cast(chunk as int) as chunk, rank, tokens from b where before < 3000 or nth <= 2""")
def passages_within_budget(spark, sf_dir):
    """The best passages of a query, as far as 3000 tokens go, and two of each source."""
    chunks = text_chunks(spark, sf_dir)
    scored = passages.bm25(chunks, _Q, ["doc_id", "chunk"]).withColumn("score", F.round("score", 6))
    ranked = numbered(scored, [F.desc("score"), F.col("doc_id"), F.col("chunk")])
    sized = ranked.join(chunks.select("doc_id", "chunk", "source", F.ceil(F.length("content") / 4).alias("tokens")), ["doc_id", "chunk"])
    return passages.select_within_budget(sized, "source", "tokens", 3000).select("doc_id", "chunk", "rank", "tokens")


@query("""with b as (select unnest([1, 2, 3, 4]) as k), m as (select strftime(d, '%Y-%m') as label, d as lo, last_day(d) as hi from (select unnest(generate_series(timestamp '1996-11-01', timestamp '1997-04-01', interval 1 month))::date as d))
select label, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders join m on cast(o_orderdate as date) + 20 >= lo and cast(o_orderdate as date) <= hi group by 1""")
def digest_buckets(spark, sf_dir):
    """Papers whose interval (here 20 days) meets a digest's months."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("lo"), F.date_add(F.to_date("o_orderdate"), 20).alias("hi"))
    return passages.assign_buckets(o, "lo", "hi", "1996-11", "1997-04").groupBy("label").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""with h as (select l_partkey as file_path, l_linenumber as bucket, max(l_extendedprice) as score from lineitem group by 1, 2), f as (select *, row_number() over (partition by file_path order by score desc, bucket) as r from h)
select file_path, bucket, score, row_number() over (order by bucket, score desc, file_path) as reference_id from f where r = 1""")
def digest_merge(spark, sf_dir):
    """Each file in the bucket of its best score, then numbered anew."""
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_path"), F.col("l_linenumber").alias("bucket"), F.col("l_extendedprice").alias("score"))
    return passages.merge_buckets(hits).withColumn("reference_id", F.col("reference_id").cast("long"))


@query()
def retrieval_scores(spark, sf_dir):
    """How well chunks of 1000 characters, ranked for each benchmark item by the runs of four words that they share with it, cover all its occurrences in whole texts."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    held = located_quotes(spark, sf_dir).join(docs, "doc_id").join(items, "item_id")
    between = F.transform(F.expr("split(text, concat('\\\\Q', t, '\\\\E'), -1)"), lambda x: F.length(x))  # lengths of what lies around the occurrences
    starts = F.transform(F.sequence(F.lit(1), F.size(between) - 1), lambda i: F.aggregate(F.slice(between, F.lit(1), i), F.lit(0), lambda n, x: n + x) + (i - 1) * F.length("t"))
    gold = held.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("doc"), F.length("t").alias("n"), F.explode(starts).alias("s")).select("qid", "doc", "s", (F.col("s") + F.col("n")).alias("e"))
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - 3), lambda i: F.array_join(F.slice(c, i, 4), " ")))
    asked = items.withColumn("w", F.split("t", " ")).filter("size(w) > 3").select("item_id", F.explode(runs(F.col("w"))).alias("k"))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(CHUNK_STEP))).alias("s")
    chunks = docs.filter("text is not null").select("doc_id", at, "text").withColumn("w", F.split(F.expr(f"substring(text, s + 1, {CHUNK_CHARS})"), " ")).filter("size(w) > 3")
    shared = chunks.select("doc_id", "s", F.explode(runs(F.col("w"))).alias("k")).join(asked, "k").groupBy("item_id", "doc_id", "s").agg(F.count("*").alias("score"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "s")
    got = shared.withColumn("r", F.row_number().over(best)).filter(f"r <= {TOP_CHUNKS}").select(F.col("item_id").alias("qid"), F.col("doc_id").alias("doc"), "s", (F.col("s") + CHUNK_CHARS).alias("e"))
    return passages.retrieval_scores(gold, got)


@query("select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)")
def located_quotes(spark, sf_dir):
    """Quotes held word for word by a document, met by their first inner words, then verified; quotes of five words and fewer meet every text."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    key = lambda c: F.array_join(F.slice(F.split(c, " "), 2, 4), " ")  # noqa: E731  the first and last word may be part of a longer one in the text
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 4), " "))
    quotes = items.select("item_id", F.col("text").alias("quote"), F.size(F.split("text", " ")).alias("n"))
    asked = quotes.filter("n > 5").select("item_id", "quote", key("quote").alias("k"))
    short = docs.select("doc_id", "text").join(quotes.filter("n <= 5"), F.contains("text", F.col("quote"))).select("doc_id", "item_id")
    each = docs.select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.explode(F.array_distinct(grams)).alias("k"))
    likely = each.join(asked, "k").select("doc_id", "item_id", "quote").distinct()  # texts join only after this
    return docs.select("doc_id", "text").join(likely, "doc_id").filter(F.contains("text", F.col("quote"))).select("doc_id", "item_id").unionByName(short).distinct()
