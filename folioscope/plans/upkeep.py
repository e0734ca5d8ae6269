"""Catalogue upkeep, chat store and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import catalogue
from folioscope.plans.base import query
from folioscope.sources.views import table
from folioscope.streaming import ingest


@query("""with f as (select doc_id, sha256(text) as h, case doc_id % 5 when 0 then 'Paper_' || (1990 + doc_id % 30) || '.pdf' when 1 then 'Longer_Paper_' || (1990 + doc_id % 30) || '.pdf' when 2 then 'Paper_' || (1990 + doc_id % 30) || '_2.pdf' when 3 then 'Paper_' || (1990 + doc_id % 30) || 'b.pdf' else 'paper ' || doc_id || '.pdf' end as name from documents where text is not null),
p as (select *, case when regexp_matches(name, '(__[0-9]+|_[0-9]{1,2})[.]pdf$') then 40 else 0 end + case when regexp_matches(name, '_[Ss]uppl[.]pdf$') then 30 else 0 end
    + case when regexp_matches(name, '^[A-Za-z][A-Za-z''-]*(_[A-Za-z][A-Za-z''-]*)?_[0-9]{4}[a-z]?[.]pdf$') or regexp_matches(name, '^.+_Supplementary[.]pdf$') then 0 else 20 end + case when regexp_matches(name, '[0-9]{4}[a-z](_Supplementary)?[.]pdf$') then 5 else 0 end as pen from f),
g as (select doc_id, count(*) over (partition by h) as n, min(doc_id) over (partition by h) as "group", row_number() over (partition by h order by pen, length(name) desc, name, doc_id) = 1 as keep from p) select doc_id, "group", n, keep from g where n > 1""")
def duplicate_groups(spark, sf_dir):
    year = F.concat(F.lit("_"), 1990 + F.col("doc_id") % 30)
    kind = F.col("doc_id") % 5
    name = F.when(kind == 0, F.concat(F.lit("Paper"), year, F.lit(".pdf"))).when(kind == 1, F.concat(F.lit("Longer_Paper"), year, F.lit(".pdf"))).when(kind == 2, F.concat(F.lit("Paper"), year, F.lit("_2.pdf"))).when(kind == 3, F.concat(F.lit("Paper"), year, F.lit("b.pdf"))).otherwise(F.concat(F.lit("paper "), "doc_id", F.lit(".pdf")))
    return catalogue.duplicate_groups(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", name.alias("name")), "text", "doc_id", "name")


@query("""with v as (select case when event_id % 3 = 0 then event_type else upper(left(event_type, 1)) || substr(event_type, 2) end as spelling from events), c as (select lower(spelling) as key, spelling, count(*) as votes, length(spelling) - length(regexp_replace(spelling, '[A-Z]', '', 'g')) as caps from v group by 1, 2)
select key, spelling, votes from (select *, row_number() over (partition by key order by caps > 0 desc, votes desc, caps desc, spelling) as r from c) where r = 1""")
def canonical_spelling(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.upper(F.substring("event_type", 1, 1)), F.expr("substring(event_type, 2)"))).alias("s"))
    return catalogue.canonical_spelling(e, "s")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def last_writes(spark, sf_dir):
    return catalogue.upsert(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("select user_id, count(*) as n_messages, max(ts) as latest, arg_max(event_id, (ts, event_id)) as latest_by from events group by 1")
def chat_activity(spark, sf_dir):
    return catalogue.activity(table(spark, sf_dir, "events"), "user_id", "event_id", "ts")


@query("select event_id, ts from events where ts < timestamp '2024-01-15 00:00:00' order by ts desc, event_id desc limit 21")
def keyset_page(spark, sf_dir):
    cursor = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    return catalogue.keyset_page(table(spark, sf_dir, "events"), "ts", "event_id", cursor, 20).select("event_id", "ts")


@query("select p_partkey from part anti join (select l_partkey as p_partkey from lineitem where l_returnflag = 'R') using (p_partkey) union all select 1000000 + c_custkey from customer anti join (select o_custkey as c_custkey from orders where o_orderstatus = 'P') using (c_custkey)")
def missing_rows(spark, sf_dir):
    """Parts never returned, and customers without a pending order."""
    parts = catalogue.missing(table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").withColumnRenamed("l_partkey", "p_partkey"), "p_partkey")
    customers = catalogue.missing(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")
    return parts.unionByName(customers.select((F.col("c_custkey") + 1_000_000).alias("p_partkey")))


@query("select conv_id, turn, role from conversations anti join (select distinct conv_id from conversations where role = 'system') using (conv_id)")
def delete_cascade(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    chats = c.groupBy("conv_id").agg(F.max((F.col("role") == "system").cast("int")).alias("gone"))
    return catalogue.delete_cascade(chats, c, "conv_id", F.col("gone") == 1)[1].select("conv_id", "turn", "role")


@query("""with a as (select doc_id as id, lang as label from documents), b as (select vec_id + 5 as id, cast(label as varchar) as label from embeddings) select * from a union all select * from b anti join a using (id)""")
def merge_stores(spark, sf_dir):
    more = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 5).alias("id"), F.col("label").cast("string").alias("label"))
    return catalogue.merge_new(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label")), more, "id")


@query("""select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def events_by_day(spark, sf_dir):
    return ingest.tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w > interval '6 hours' or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts)), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*) as n from s group by user_id, s""")
def user_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.sessions(e, "6 hours", "user_id").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
