"""Chat store, catalogue maintenance and dates of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import store
from folioscope.operators.ranks import dealt
from folioscope.plans.base import query
from folioscope.sources.views import table


def _chats(spark, sf_dir):
    """Chats are orders (their customer the owner), members the suppliers of lines by number, messages their lines."""
    chats = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chat_id"), (F.col("o_custkey") % 40).alias("user_id"), F.col("o_orderdate").alias("created"))
    lines = table(spark, sf_dir, "lineitem")
    return chats, lines.select(F.col("l_orderkey").alias("chat_id"), (F.col("l_suppkey") % 40).alias("user_id")), lines.select(F.col("l_orderkey").alias("chat_id"), (F.col("l_partkey") % 50).alias("user_id"))


@query("""with m as (select distinct l_orderkey as chat_id from lineitem where l_suppkey % 40 = 7)
select o_orderkey as chat_id, o_orderdate as created, o_custkey % 40 = 7 as is_owner from orders left join m on chat_id = o_orderkey where (o_custkey % 40 = 7 or chat_id is not null) and o_orderdate < timestamp '1998-01-01' order by o_orderdate desc, o_orderkey desc limit 31""")
def chat_list(spark, sf_dir):
    """A user's own chats and those shared with them, before a cursor."""
    chats, members, _ = _chats(spark, sf_dir)
    return store.chats_of(chats, members, 7, F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), 30)


@query("""with p as (select o_orderkey as chat_id, o_custkey % 40 as user_id, 1 as own from orders union all select l_orderkey, l_suppkey % 40, 0 from lineitem union all select l_orderkey, l_partkey % 50, 0 from lineitem)
select chat_id, user_id, max(own) = 1 as is_owner from p semi join (select c_custkey as user_id from customer where c_custkey < 45) using (user_id) group by 1, 2""")
def chat_participants(spark, sf_dir):
    """Owner, members and authors of each chat who are users."""
    users = table(spark, sf_dir, "customer").filter("c_custkey < 45").select(F.col("c_custkey").alias("user_id"))
    return store.participants(*_chats(spark, sf_dir), users)


@query("select doc_id as name, n_chars as size from documents anti join (select vec_id as doc_id, case when vec_id % 3 = 0 then n_chars else n_chars + 1 end as n_chars from embeddings join documents on vec_id = doc_id) using (doc_id, n_chars)")
def untried_files(spark, sf_dir):
    """Documents that a ledger of tries does not hold at their present size."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    ledger = e.join(d, F.col("vec_id") == F.col("doc_id")).select(F.col("doc_id").alias("name"), F.when(F.col("vec_id") % 3 == 0, F.col("n_chars")).otherwise(F.col("n_chars") + 1).alias("size"))
    return store.untried(d.select(F.col("doc_id").alias("name"), F.col("n_chars").alias("size")), ledger)


@query("""with t as (select o_custkey, list(distinct substr('abcdefghijklmnopqrstuvwxyz', cast(1 + o_orderkey % 26 as int), 1)) as taken from orders group by 1)
select o_custkey, list_filter(string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z', ','), lambda x: not list_contains(taken, x))[1] as letter from t""")
def free_letters(spark, sf_dir):
    """The next letter for each name, beside those that its files have."""
    letter = F.upper(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (1 + F.col("o_orderkey") % 26).cast("int"), F.lit(1)))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(letter).alias("taken")).select("o_custkey", store.free_letter(F.col("taken")).alias("letter"))


@query("""with c as (select doc_id as name from documents where doc_id % 4 <> 1), a as (select vec_id as name from embeddings where vec_id % 3 <> 2), r as (select doc_id as old, doc_id + 3 as new from documents where doc_id % 5 = 0),
m as (select old as name, new from r semi join (select name as new from c) using (new) anti join (select name as new from a) using (new)),
t as (select a.name, case when c.name is null then coalesce(m.new, a.name) else a.name end as current, case when c.name is not null then 'kept' when m.new is not null then 'renamed' else 'atlas_only' end as state from a left join c on a.name = c.name left join m on a.name = m.name)
select * from t union all select name, name, 'pending' from c where name not in (select current from t)""")
def table_refresh(spark, sf_dir):
    """Rows of a derived table against the canonical names, renames followed."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    renames = d.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("old"), (F.col("doc_id") + 3).alias("new"))
    return store.refresh(d.filter("doc_id % 4 != 1").select(F.col("doc_id").alias("name")), e.filter("vec_id % 3 != 2").select(F.col("vec_id").alias("name")), renames)


@query("select case when doc_id % 10 = 3 then doc_id + 1 when doc_id % 10 = 4 then doc_id + 100000 else doc_id end as doc_id, lang from documents where doc_id % 10 <> 7")
def rekeyed(spark, sf_dir):
    """Rows under new keys: 3 takes the place of 4, which moves on; 7 is gone."""
    d = table(spark, sf_dir, "documents")
    tail = F.col("doc_id") % 10
    renames = d.filter(tail.isin(3, 4)).select(F.col("doc_id").alias("old"), F.when(tail == 3, F.col("doc_id") + 1).otherwise(F.col("doc_id") + 100_000).alias("new"))
    return store.rekey(d.select("doc_id", "lang"), "doc_id", renames, d.filter(tail == 7).select("doc_id"))


@query("""select 'graph' as target, count(*) filter (l_quantity <= 10) as pending, count(*) filter (l_quantity > 10) as done from lineitem union all select 'vectors', count(*) filter (l_returnflag <> 'A'), count(*) filter (l_returnflag = 'A') from lineitem""")
def pending_counts(spark, sf_dir):
    ledger = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 10).alias("graph"), F.when(F.col("l_returnflag") == "A", True).alias("vectors"))
    return store.pending_counts(ledger, ["graph", "vectors"])


_FOUND = "case o_orderkey % 5 when 0 then date_text when 1 then substr(date_text, 1, 7) when 2 then substr(date_text, 1, 4) when 3 then concat(year_before, '-02-03') else 'soon' end"
_OLD = "case o_custkey % 4 when 0 then substr(date_text, 1, 4) when 1 then substr(date_text, 1, 7) when 2 then '' else date_text end"
_LABEL = "case o_orderkey % 7 when 0 then 'Posted' when 1 then 'received' when 2 then 'published-online' when 3 then 'issue-date' else 'published' end"


@query(f"""with b as (select o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') as date_text, cast(year(o_orderdate) - 1 as varchar) as year_before from orders),
d as (select o_orderkey, {_FOUND} as f, {_OLD} as e, lower({_LABEL}) as label from b), x as (select *, label in ('posted', 'published-online', 'published', 'issue-date') as shown, label in ('posted', 'published-online') as online from d)
select o_orderkey, case when shown and length(f) >= 7 and f <> 'soon' then case when e = '' then f when length(e) = 4 then case when left(f, 4) = e or (left(f, 4) < e and online) then f end
    when length(f) = 10 and (left(f, 7) = left(e, 7) or (left(f, 7) < left(e, 7) and online)) then f end end as date from x""")
def date_decisions(spark, sf_dir):
    """Dates found on pages against those of records."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"), (F.year("o_orderdate") - 1).cast("string").alias("year_before"))
    return d.select("o_orderkey", store.decide_date(F.expr(_FOUND), F.expr(_LABEL), F.expr(_OLD), ("posted", "published-online", "published", "issue-date")).alias("date"))


@query("""with b as (select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d from orders),
c as (select o_orderkey, unnest([case when o_orderkey % 3 > 0 then printf('%04d-%02d', y, m) end, case when o_orderkey % 4 > 1 then printf('%04d', y) end, case when o_orderkey % 5 > 2 then printf('%04d-%02d-%02d', y, m, d) end]) as iso from b),
r as (select o_orderkey, iso, case length(iso) when 4 then iso || '-99-99' when 7 then iso || '-99' else iso end as k from c)
select o_orderkey, coalesce(arg_min(iso, k), '') as iso, coalesce(case length(arg_min(iso, k)) when 4 then 'year' when 7 then 'month' else case when arg_min(iso, k) is not null then 'day' end end, '') as precision from r group by 1""")
def earliest_dates(spark, sf_dir):
    """The earliest of a record's partial dates."""
    o = table(spark, sf_dir, "orders")
    y, m, d = (f("o_orderdate") for f in (F.year, F.month, F.dayofmonth))
    none = F.array().cast("array<int>")
    dates = F.array(F.when(F.col("o_orderkey") % 3 > 0, F.array(y, m)).otherwise(none), F.when(F.col("o_orderkey") % 4 > 1, F.array(y)).otherwise(none), F.when(F.col("o_orderkey") % 5 > 2, F.array(y, m, d)).otherwise(none))
    return o.select("o_orderkey", store.earliest_date(dates).alias("x")).select("o_orderkey", "x.*")


@query("""with s as (select doc_id, chr(cast(65 + doc_id % 26 as int)) || 'oss' as a, 1990 + doc_id % 30 as y from documents), p as (select distinct case when doc_id % 3 = 0 then a || '_Etal_' || y else a || '_Reeder_' || y end as paper, lower(a) || case when doc_id % 3 = 0 then 'etal' else 'reed' end || y as code from s),
f as (select code, min(paper) as paper from p group by 1), x as (select a || case when doc_id % 2 = 0 then 'Etal' else 'Reed' end || y || '_suppl' || doc_id || '.pdf' as name, lower(a) || case when doc_id % 2 = 0 then 'etal' else 'reed' end || y as code from s where doc_id % 7 < 3)
select name, paper, paper || '_Supplementary' || case when row_number() over w > 1 then '_' || row_number() over w else '' end || '.pdf' as target from x join f using (code) window w as (partition by paper order by name)""")
def supplement_links(spark, sf_dir):
    """Supplements beside the papers whose code they carry."""
    d = table(spark, sf_dir, "documents")
    a, y = F.concat(F.char(65 + F.col("doc_id") % 26), F.lit("oss")), 1990 + F.col("doc_id") % 30
    names = d.select(F.concat(a, F.when(F.col("doc_id") % 3 == 0, F.lit("_Etal_")).otherwise(F.lit("_Reeder_")), y, F.lit(".pdf")).alias("name")).distinct()
    supplements = d.filter("doc_id % 7 < 3").select(F.concat(a, F.when(F.col("doc_id") % 2 == 0, F.lit("Etal")).otherwise(F.lit("Reed")), y, F.lit("_suppl"), "doc_id", F.lit(".pdf")).alias("name"))
    return store.supplement_links(names, supplements)


@query("""with c as (select doc_id as chunk_id, coalesce(text, '') as content, 'about ' || source as prompt from documents), k as (select distinct 'about ' || source as prompt, case when source like '%1%' then '' else 'From ' || source || '.' end as v from documents where source not like '%2%')
select chunk_id, md5(case when coalesce(v, '') <> '' then v || chr(10) || chr(10) || content else content end) as content_md5, coalesce(v, '') <> '' as contextual from c left join k using (prompt)""")
def contextual_chunks(spark, sf_dir):
    """Chunks led by what a cache knows of their context."""
    d = table(spark, sf_dir, "documents")
    prompt = F.concat(F.lit("about "), "source")
    cache = d.filter("source not like '%2%'").select("source").distinct().select(F.md5(F.concat(F.lit("salt\x00"), prompt).cast("binary")).alias("k"), F.when(F.col("source").like("%1%"), "").otherwise(F.concat(F.lit("From "), "source", F.lit("."))).alias("v"))
    found = store.contextual(d.select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"), prompt.alias("prompt")), cache, "salt")
    return found.select("chunk_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), "contextual")


@query("""with p as (select l_orderkey as doc_id, l_linenumber as page, 'Journal of ' || (l_orderkey % 5) || ' Things ' || l_linenumber as a, case when l_linenumber % 2 = 0 then 'Left  Head' else 'Right Head' end as b, max(l_returnflag || l_linestatus) || ' body' as c from lineitem group by l_orderkey, l_linenumber),
n as (select doc_id, count(*) as n from p group by 1 having count(*) >= 4), e as (select distinct doc_id, page, unnest(['journal of ' || (doc_id % 5) || ' things', lower(replace(b, '  ', ' ')), lower(c)]) as line from p)
select doc_id, line, count(*) as n_pages from e join n using (doc_id) group by doc_id, line, n having count(*) >= greatest(3, floor(n * 0.4))""")
def repeated_edges(spark, sf_dir):
    """Running heads and feet of documents of several pages."""
    head = F.when(F.col("l_linenumber") % 2 == 0, "Left  Head").otherwise("Right Head")
    text = F.concat(F.lit("Journal of "), F.col("l_orderkey") % 5, F.lit(" Things "), "l_linenumber", F.lit("\n"), head, F.lit("\n"), "body", F.lit(" body"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    pages = dealt(lines, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("body"))
    return store.repeated_edges(pages.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), text.alias("text")))


@query("""with y as (select p_type as term, year(o_orderdate) as year, count(*) as n from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey where p_brand = 'Brand#3' group by 1, 2),
t as (select term, coalesce(sum(n) filter (year >= 1996), 0) as recent, coalesce(sum(n) filter (year between 1993 and 1995), 0) as base from y group by 1)
select term, cast(recent as bigint) as n from (select * from t where recent > 0 order by recent desc, term limit 4) where term not in (select term from t where base > 0 order by base desc, term limit 2)""")
def new_neighbours(spark, sf_dir):
    """Terms that a brand keeps company with lately and did not before."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").filter("p_brand = 'Brand#3'"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    year = F.year("o_orderdate")
    t = lines.groupBy(F.col("p_type").alias("term")).agg(F.count_if(year >= 1996).alias("recent"), F.count_if(year.between(1993, 1995)).alias("base"))
    recent = t.filter("recent > 0").orderBy(F.desc("recent"), "term").limit(4).select("term", F.col("recent").alias("n"))
    return store.new_neighbours(recent, t.filter("base > 0").orderBy(F.desc("base"), "term").limit(2))
