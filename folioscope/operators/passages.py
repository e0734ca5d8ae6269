"""Passage ranking, selection, digests and retrieval evaluation (L1, L2 without the top-up, B2-B5, E1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranks import numbered, running

#: Words that do not count in queries and passages: fixed values.
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be",
    "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "did", "do", "does", "doing",
    "down", "during", "each", "few", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here",
    "hers", "him", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no",
    "nor", "not", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "out", "over", "own", "paper",
    "papers", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "then",
    "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we",
    "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "you", "your", "yours",
)
TOKEN = "[a-z0-9][a-z0-9'-]*"


def query_terms(q: str) -> list[str]:
    import re

    return sorted({t for t in re.findall(TOKEN, q.lower()) if len(t) > 1 and t not in STOPWORDS})


def tokens(content: Column) -> Column:
    found = F.regexp_extract_all(F.lower(content), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def bm25(passages: DataFrame, q: str, keys: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """keys, score (> 0) of the passages (content) that hold a term of q; none for a q of stop words alone. Only q's terms are shuffled."""
    terms = query_terms(q)
    if not terms:
        return passages.select(*keys, F.lit(0.0).alias("score")).limit(0)
    sized = passages.select(*keys, tokens(F.col("content")).alias("t")).withColumn("len", F.size("t"))
    count = lambda t: F.size(F.filter("t", lambda x: x == t))
    tf = F.array(*[F.struct(F.lit(t).alias("term"), count(t).alias("tf")) for t in terms])
    facts = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    hits = sized.select(*keys, "len", F.explode(tf).alias("h")).select(*keys, "len", "h.term", "h.tf").filter("tf > 0")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row a term of q
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(facts))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return scored.groupBy(*keys).agg(F.sum(weight).alias("score"))


def select_within_budget(ranked: DataFrame, group: str, tokens_column: str, budget: int, floor: int = 2) -> DataFrame:
    """Passages by rank while the tokens before them are under budget, and each group's first ``floor``.

    ranked: rank, group, tokens.
    """
    summed = running(ranked, [F.col("rank")], before=F.col(tokens_column))
    firsts = F.row_number().over(Window.partitionBy(group).orderBy("rank"))
    heads = summed.withColumn("nth", firsts).filter(F.col("nth") <= floor).drop("nth")  # a group limit: hot groups are cut before the shuffle
    return summed.filter(F.col("before") < budget).unionByName(heads.filter(F.col("before") >= budget))


def buckets(frm: str, to: str) -> list[tuple[str, str, str]]:
    """(label, first, last day) of a digest: months while they are 18 or fewer, else years, the latest 24."""
    import calendar

    (y, m), (y2, m2) = (tuple(map(int, d.split("-")[:2])) for d in (frm, to))
    months = [(k // 12, k % 12 + 1) for k in range(12 * y + m - 1, 12 * y2 + m2)]
    if len(months) <= 18:
        return [(f"{a}-{b:02d}", f"{a}-{b:02d}-01", f"{a}-{b:02d}-{calendar.monthrange(a, b)[1]}") for a, b in months]
    return [(str(a), f"{a}-01-01", f"{a}-12-31") for a in range(y, y2 + 1)][-24:]


def bucket_top_k(n: int) -> int:
    return 10 if n <= 6 else 8 if n <= 12 else 6


def assign_buckets(papers: DataFrame, starts: str, ends: str, frm: str, to: str) -> DataFrame:
    """Papers whose interval [starts, ends] (dates) meets a bucket's: an interval join with at most 24 buckets."""
    spark = papers.sparkSession
    rows = spark.createDataFrame([(i, *b) for i, b in enumerate(buckets(frm, to))], "bucket int, label string, b_from string, b_to string")
    cast = F.broadcast(rows.withColumns({c: F.to_date(c) for c in ("b_from", "b_to")}))
    return papers.join(cast, (F.col(starts) <= F.col("b_to")) & (F.col(ends) >= F.col("b_from"))).drop("b_from", "b_to")


def merge_buckets(hits: DataFrame) -> DataFrame:
    """Each file in the bucket of its best score (the earliest of equals); files numbered by bucket, then score: file_path, bucket, score, reference_id."""
    best = hits.groupBy("file_path", "bucket").agg(F.max("score").alias("score"))
    first = best.withColumn("r", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "bucket"))).filter("r = 1").drop("r")
    return numbered(first, [F.col("bucket"), F.desc("score"), F.col("file_path")], "reference_id")


def union_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s, e: spans [s, e) that meet are one."""
    own = Window.partitionBy(*keys).orderBy("s", "e")
    far = F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(far.isNull() | (F.col("s") > far), 1).otherwise(0)).over(own)
    return spans.filter("e > s").withColumn("far", far).withColumn("island", island).groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def retrieval_scores(golden: DataFrame, found: DataFrame) -> DataFrame:
    """qid, doc and span tables to recall, precision and intersection over union by qid."""
    g, f = union_spans(golden, ["qid", "doc"]), union_spans(found, ["qid", "doc"])
    size = lambda d, name: d.groupBy("qid").agg(F.sum(F.col("e") - F.col("s")).alias(name))
    meet = g.alias("g").join(f.alias("f"), (F.col("g.qid") == F.col("f.qid")) & (F.col("g.doc") == F.col("f.doc")) & (F.col("g.s") < F.col("f.e")) & (F.col("f.s") < F.col("g.e")))
    common = meet.groupBy(F.col("g.qid").alias("qid")).agg(F.sum(F.least("g.e", "f.e") - F.greatest("g.s", "f.s")).alias("both"))
    joined = size(g, "gold").join(size(f, "got"), "qid", "left").join(common, "qid", "left").fillna(0, ["got", "both"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return joined.select("qid", ratio(F.col("both"), F.col("gold")).alias("recall"), ratio(F.col("both"), F.col("got")).alias("precision"), ratio(F.col("both"), F.col("gold") + F.col("got") - F.col("both")).alias("iou"))
