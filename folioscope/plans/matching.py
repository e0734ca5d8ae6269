"""Quotes with misses, fuzzy titles, close matches and resumed ingests."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import fuzzy, quotes
from folioscope.plans.base import query
from folioscope.sources.views import table
from folioscope.streaming import state

PAGE_WORDS, QUOTE_FROM, QUOTE_WORDS = 200, 170, 60


@query()
def damaged_quotes(spark, sf_dir):
    """A quote from each document, over a page's end where it is long enough, every ninth word lost and every thirteenth changed, found again on its pages."""
    texts = table(spark, sf_dir, "documents").filter("text is not null")
    words = texts.select("doc_id", F.explode(F.array(quotes.plain_words(F.col("text")))).alias("w")).filter(F.size("w") > 0)  # exploded, so that no filter makes the words again
    n_pages = F.ceil(F.size("w") / PAGE_WORDS).cast("int")
    cut = F.transform(F.sequence(F.lit(1), n_pages), lambda p: F.slice("w", (p - 1) * PAGE_WORDS + 1, PAGE_WORDS))  # cut first: a row holds its page alone
    pages = words.select(F.col("doc_id").alias("doc"), F.posexplode(cut).alias("page", "words")).withColumn("page", F.col("page") + 1)
    start = F.greatest(F.lit(1), F.least(F.lit(QUOTE_FROM), F.size("w") - QUOTE_WORDS + 1))
    own = words.select("doc_id", F.slice("w", start, QUOTE_WORDS).alias("q"))
    said = F.transform("q", lambda x, i: F.when(i % 9 == 8, F.lit("")).when(i % 13 == 12, F.concat(F.lit("un"), x)).otherwise(x))
    asked = own.select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("doc"), F.array_join(said, " ").alias("quote"))
    found = quotes.locate_roughly(asked, pages)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["page"], s["first"], s["last"])), ",")
    return found.select("quote_id", "page", spans.alias("spans"), "matched")


@query()
def title_set_matches(spark, sf_dir):
    """Titles (names of parts, half of them with their type as subtitle or a letter changed) that agree by their sets of words."""
    part = table(spark, sf_dir, "part")
    one = part.select("p_partkey", F.col("p_name").alias("title"))
    k = F.col("p_partkey") % 3
    other = part.select(F.col("p_partkey").alias("other_key"), F.when(k == 0, F.concat_ws(" ", "p_name", F.lower("p_type"))).when(k == 1, F.regexp_replace("p_name", "a", "e")).otherwise(F.col("p_name")).alias("title"))
    names = other.groupBy("title").agg(F.min("other_key").alias("other_key"))
    firsts = one.groupBy("title").agg(F.min("p_partkey").alias("p_partkey"))
    return fuzzy.title_set_matches(firsts, names, "p_partkey", "other_key").withColumn("ratio", F.round("ratio", 6))


@query()
def close_matches(spark, sf_dir):
    """What the types of parts offer in place of words that users mistype."""
    pool = table(spark, sf_dir, "part").select(F.col("p_type").alias("match")).unionByName(table(spark, sf_dir, "part").select(F.col("p_brand").alias("match")))
    typed = table(spark, sf_dir, "region").select(F.explode(F.array(F.concat(F.lit("ECONOM "), "r_name"), F.concat(F.lit("Brand#"), "r_regionkey"), F.lit("steel"), F.lit("PROMO BURNISH"))).alias("value"))
    return fuzzy.close_matches(typed, pool).withColumn("ratio", F.round("ratio", 6))


_EVENT = "case event_type when 'click' then 'seen' when 'view' then 'parsing' when 'purchase' then 'processed' when 'error' then 'failed' else 'processing' end"


@query(f"""with e as (select cast(user_id as varchar) as content_id, cast(day(ts) // 4 as bigint) as run, event_id as seq, {_EVENT} as event from events),
p as (select *, lag(run) over w as last_run, last_value(case when event <> 'seen' then event end ignore nulls) over (partition by content_id order by run, seq rows between unbounded preceding and 1 preceding) as before,
    last_value(case when event <> 'seen' then run end ignore nulls) over (partition by content_id order by run, seq rows between unbounded preceding and 1 preceding) as before_run from e window w as (partition by content_id order by run, seq)),
x as (select content_id, run, 'pending' as status, 'stranded' as reason from p where before in ('processing', 'analyzing', 'parsing') and run > before_run and last_run = before_run
    union all select content_id, run, 'pending', 'new' from p where event = 'seen' and last_run is null union all select content_id, run, event, 'reported' from p where event <> 'seen')
select content_id, run, status, reason, count(*) as n from x group by all""")
def resumed_statuses(spark, sf_dir):
    """What becomes of documents over the runs of an ingest, those stranded in flight taken back to pending."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKSDB)
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("content_id"), F.expr("cast(day(ts) div 4 as bigint)").alias("run"), F.col("event_id").alias("seq"), F.expr(_EVENT).alias("event"))
    return state.statuses(e).groupBy("content_id", "run", "status", "reason").agg(F.count("*").alias("n"))
