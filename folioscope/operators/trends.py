"""Publication trends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import normalise
from folioscope.operators.filters import record_year

#: Most terms of each dimension in an overview: fixed values.
CAPS = {"keywords": 300, "subjects": 200, "journals": 200, "authors": 300, "affiliations": 200, "types": 20}


#: Years that count, and spans of the windows of a term's detail: fixed values.
FIRST_YEAR, LAST_YEAR, SPAN = 1800, 2100, 10


def trend_year(year: Column, issued: Column | None = None, date: Column | None = None) -> Column:
    """The first of year, issued year and date whose first four characters are a year from 1800 to 2100."""

    def of(c: Column) -> Column:
        y = F.substring(c.cast("string"), 1, 4).try_cast("int")
        return F.when(y.between(FIRST_YEAR, LAST_YEAR), y)

    dated = None if date is None else F.when(date.rlike("^[0-9]{4}"), date)
    return F.coalesce(*(of(c) for c in (year, issued, dated) if c is not None))


def year_of(papers: DataFrame) -> Column:
    """trend_year() of what a table of papers has; a date counts where there is an issued year beside it, as in records."""
    whole = "issued_year" in papers.columns
    return trend_year(F.col("year"), F.col("issued_year") if whole else None, F.col("date") if whole else None)


def _terms(papers: DataFrame) -> dict[str, Column]:
    """Each dimension's terms of a row, in order; of records, authors are a list of people and affiliations a list."""
    have, listed = set(papers.columns), lambda c: F.coalesce(F.col(c), F.expr("cast(array() as array<string>)"))
    authors = F.transform(F.coalesce("authors", F.expr("cast(array() as array<struct<family:string,given:string>>)")), lambda p: p["family"]) if "authors" in have else F.array("family")
    affiliations = F.array_sort(F.array_distinct(listed("affiliations"))) if "affiliations" in have else F.array("affiliation")
    dims = {"keywords": listed("keywords"), "subjects": listed("subjects"), "journals": F.array("container_title"), "authors": authors, "affiliations": affiliations, "types": F.array("type")}
    return {d: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "") for d, c in dims.items()}


def record_terms(papers: DataFrame) -> DataFrame:
    """seq, year, dim, term: each dated paper's terms in six dimensions."""
    named = [F.transform(c, (lambda d: lambda x: F.struct(F.lit(d).alias("dim"), x.alias("term")))(d)) for d, c in _terms(papers).items()]
    dated = papers.withColumn("year", year_of(papers)).filter("year is not null")
    return dated.select("seq", "year", F.explode(F.concat(*named)).alias("x")).select("seq", "year", "x.dim", "x.term")


def corpus_years(papers: DataFrame) -> DataFrame:
    """year, n of dated papers."""
    return papers.select(year_of(papers).alias("year")).filter("year is not null").groupBy("year").agg(F.count("*").alias("n"))


def term_years(papers: DataFrame) -> DataFrame:
    """dim, key (lower-cased term), term (as first seen), first_seq, year, n."""
    counts = record_terms(papers).groupBy("dim", F.lower("term").alias("key"), "year").agg(F.count("*").alias("n"), F.min_by("term", "seq").alias("t"), F.min("seq").alias("s"))
    own = Window.partitionBy("dim", "key")
    return counts.select("dim", "key", F.first("t").over(own.orderBy("s", "t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("term"), F.min("s").over(own).alias("first_seq"), "year", "n")


def capped(counts: DataFrame) -> DataFrame:
    """term_years() with total, of the first CAPS terms of each dimension (by total, then as first seen)."""
    totals = counts.groupBy("dim", "key").agg(F.sum("n").alias("total"), F.min("first_seq").alias("fs"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("total"), "fs", "key")))
    cap = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    top = ranked.filter(F.col("rank") <= max(CAPS.values())).filter(F.col("rank") <= cap[F.col("dim")]).drop("fs")  # at most the sum of CAPS rows
    return counts.join(F.broadcast(top), ["dim", "key"])


def term_stats(counts: DataFrame) -> DataFrame:
    """dim, key, first_year, last_year, peak_year (the latest of equals), peak_n, median_year."""
    running = Window.partitionBy("dim", "key").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("dim", "key")
    run = counts.withColumn("run", F.sum("n").over(running)).withColumn("total_n", F.sum("n").over(own))
    return run.groupBy("dim", "key").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.max_by("year", F.struct("n", "year")).alias("peak_year"), F.max("n").alias("peak_n"), F.min(F.when(2 * F.col("run") >= F.col("total_n"), F.col("year"))).alias("median_year"))


def deltas(counts: DataFrame, corpus: DataFrame, span: int = 10) -> DataFrame:
    """dim, key, total, base_n, recent_n, delta (points of the corpus's share, of the last ``span`` years over the ``span`` before)."""
    last = corpus.agg(F.max("year").alias("hi"))
    inside = lambda lo, hi: F.col("year").between(F.col("hi") - lo, F.col("hi") - hi)
    recent, base = inside(span - 1, 0), inside(2 * span - 1, span)
    sums = corpus.crossJoin(last).agg(F.max("hi").alias("hi"), F.greatest(F.lit(1), F.sum(F.when(recent, F.col("n")).otherwise(0))).alias("r_all"), F.greatest(F.lit(1), F.sum(F.when(base, F.col("n")).otherwise(0))).alias("b_all"))
    by = counts.crossJoin(F.broadcast(sums)).groupBy("dim", "key").agg(F.sum("n").alias("total"), F.sum(F.when(base, F.col("n")).otherwise(0)).alias("base_n"), F.sum(F.when(recent, F.col("n")).otherwise(0)).alias("recent_n"), F.max("r_all").alias("r_all"), F.max("b_all").alias("b_all"))
    return by.select("dim", "key", "total", "base_n", "recent_n", F.round(100 * (F.col("recent_n") / F.col("r_all") - F.col("base_n") / F.col("b_all")), 3).alias("delta"))


def newcomers(counts: DataFrame, corpus: DataFrame, age: int = 15, least: int = 4, top: int = 12) -> DataFrame:
    """Per dimension the ``top`` terms first seen within ``age`` years of the last, with ``least`` papers or more."""
    stats, change = term_stats(counts), deltas(counts, corpus)
    last = F.broadcast(corpus.agg(F.max("year").alias("hi")))
    young = stats.join(change, ["dim", "key"]).crossJoin(last).filter((F.col("first_year") >= F.col("hi") - age) & (F.col("total") >= least))
    ranked = young.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("recent_n"), F.desc("total"), "key")))
    return ranked.filter(F.col("rank") <= top).select("dim", "rank", "key", "first_year", "total", "recent_n")


def windows(counts: DataFrame, corpus: DataFrame, width: int = 3) -> DataFrame:
    """Every term over every window of ``width`` years that starts in a corpus year and ends by the last: dim, key, start, observed, expected, z."""
    frame = Window.orderBy("year").rangeBetween(0, width - 1)  # one row a year
    totals = corpus.agg(F.sum("n").alias("all_n"), F.max("year").alias("hi"))
    spans = corpus.select("year", F.sum("n").over(frame).alias("papers")).crossJoin(totals).filter(F.col("year") + width - 1 <= F.col("hi"))
    starts = spans.select(F.col("year").alias("start"), "papers", "all_n")
    # A count belongs to the windows that start in its year or up to width - 1 years before.
    near = counts.select("dim", "key", "n", F.explode(F.sequence(F.col("year") - width + 1, F.col("year"))).alias("start"))
    seen = near.groupBy("dim", "key", "start").agg(F.sum("n").alias("observed"))
    totals_by = counts.groupBy("dim", "key").agg(F.sum("n").alias("total"))
    joined = seen.join(F.broadcast(starts), "start").join(totals_by, ["dim", "key"])
    expected = F.col("total") * F.col("papers") / F.col("all_n")
    return joined.withColumn("expected", expected).withColumn("z", (F.col("observed") - expected) / F.sqrt(expected)).select("dim", "key", "total", "start", "observed", "expected", "z")


def bursts(counts: DataFrame, corpus: DataFrame, least: int = 8, width: int = 3, top: int = 12) -> DataFrame:
    """Each dimension's strongest bursts. A term's burst is the first window that beats the best before it, whose score is rounded by then."""
    rising = windows(counts, corpus, width).filter((F.col("total") >= least) & (F.col("expected") >= 1) & (F.col("observed") > F.col("expected")))
    listed = rising.groupBy("dim", "key").agg(F.sort_array(F.collect_list(F.struct("start", "observed", "expected", "z"))).alias("w"))
    nothing = F.expr("cast(null as struct<start:int,observed:bigint,expected:double,z:double>)")
    better = lambda best, x: F.when(best.isNull() | (x["z"] > best["z"]), F.struct(x["start"].alias("start"), x["observed"].alias("observed"), F.round(x["expected"], 1).alias("expected"), F.round(x["z"], 2).alias("z"))).otherwise(best)
    best = listed.select("dim", "key", F.aggregate("w", nothing, better).alias("b")).select("dim", "key", "b.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("z"), "key")))
    return ranked.filter(F.col("rank") <= top).select("dim", "rank", "key", F.col("start").alias("from_year"), (F.col("start") + width - 1).alias("to_year"), "observed", "expected", "z")


def filled(counts: DataFrame) -> DataFrame:
    """Every year from a term's first to its last, with zero where it has none: dim, key, year, n."""
    years = counts.groupBy("dim", "key").agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return years.join(counts.select("dim", "key", "year", "n"), ["dim", "key", "year"], "left").fillna(0, ["n"])


def smoothed(series: DataFrame, value: str = "n") -> DataFrame:
    """A centred mean of three, cut short at the ends."""
    return series.withColumn("smooth", F.avg(value).over(Window.partitionBy("dim", "key").orderBy("year").rowsBetween(-1, 1)))


def shares(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    """A term's percentage of each year's papers, to one place."""
    return counts.join(F.broadcast(corpus.withColumnRenamed("n", "papers")), "year").select("dim", "key", "year", F.round(100 * F.col("n") / F.col("papers"), 1).alias("share"))


def lead_lag(counts: DataFrame, corpus: DataFrame, from_year: int = 1985, least_years: int = 15, terms: int = 120, least: int = 15, overlap: int = 12, longest: int = 8, r_least: float = 0.55, gain: float = 0.08, top: int = 20) -> DataFrame:
    """Pairs of keyword or subject terms whose share curves fit best at a lag of two years or more: lead, follow, lag, r, gain.

    The pairs are of ``terms`` leading terms, a fixed number, so the theta join is bounded.
    """
    years = corpus.filter(F.col("year") >= from_year).withColumn("pos", F.row_number().over(Window.orderBy("year")) - 1).withColumn("n_years", F.count("*").over(Window.partitionBy()))
    years = years.filter(F.col("n_years") >= least_years).withColumnRenamed("n", "papers")
    totals = counts.filter(F.col("dim").isin("keywords", "subjects")).groupBy("dim", "key").agg(F.sum("n").alias("total"), F.min("first_seq").alias("fs"))
    chosen = totals.orderBy(F.desc("total"), "fs", "dim", "key").limit(terms).filter(F.col("total") >= least)
    chosen = chosen.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("total"), "fs", "dim", "key"))).withColumn("last", F.max("dim").over(Window.partitionBy("key"))).filter("dim = last")
    grid = chosen.crossJoin(F.broadcast(years)).join(counts.select("dim", "key", "year", "n"), ["dim", "key", "year"], "left")
    share = grid.withColumn("share", F.coalesce("n", F.lit(0)) / F.col("papers")).withColumn("live", F.sum(F.expr("cast(n > 0 as int)")).over(Window.partitionBy("dim", "key"))).filter("live >= 10")
    curve = share.withColumn("v", F.avg("share").over(Window.partitionBy("dim", "key").orderBy("pos").rowsBetween(-1, 1))).select("key", "ord", "pos", "v", "n_years")
    names = curve.select("key", "ord").distinct()
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0))
    lexical = F.contains(F.lower("a"), F.lower("b")) | F.contains(F.lower("b"), F.lower("a")) | F.arrays_overlap(words("a"), words("b"))
    pairs = names.select(F.col("key").alias("a"), F.col("ord").alias("oa")).join(names.select(F.col("key").alias("b"), F.col("ord").alias("ob")), F.col("oa") != F.col("ob")).filter(~lexical)
    lags = pairs.withColumn("lag", F.explode(F.array(F.lit(0), *[F.lit(i) for i in range(2, longest + 1)])))
    first = curve.select(F.col("key").alias("a"), "pos", F.col("v").alias("x"), "n_years")
    second = curve.select(F.col("key").alias("b"), F.col("pos").alias("pos_b"), F.col("v").alias("y"))
    met = lags.join(first, "a").withColumn("pos_b", F.col("pos") + F.col("lag")).join(second, ["b", "pos_b"])
    fits = met.groupBy("a", "b", "lag", "oa", "ob").agg(F.count("*").alias("m"), F.corr("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    r = F.when((F.col("m") < 8) | (F.col("vx") * F.col("m") <= 1e-12) | (F.col("vy") * F.col("m") <= 1e-12), 0.0).otherwise(F.col("c"))
    fits = fits.withColumn("r", r)
    zero = fits.filter("lag = 0").select("a", "b", F.col("r").alias("r0"))
    best = fits.filter((F.col("lag") > 0) & (F.col("m") >= overlap) & (F.col("r") > 0)).groupBy("a", "b", "oa", "ob").agg(F.max_by(F.struct("r", "lag"), F.struct("r", (-F.col("lag")).alias("l"))).alias("z"))
    good = best.join(zero, ["a", "b"]).filter((F.col("z.r") >= r_least) & (F.col("z.r") > F.col("r0") + gain)).select("a", "b", "oa", "ob", F.col("z.lag").alias("lag"), F.round("z.r", 2).alias("r"), F.round(F.col("z.r") - F.col("r0"), 2).alias("gain"))
    leader = good.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("r"), F.desc("gain"), "oa", "ob"))).filter("k = 1")
    return leader.orderBy(F.desc("r"), F.desc("gain"), "oa", "ob").limit(top).select(F.col("a").alias("lead"), F.col("b").alias("follow"), "lag", "r", "gain")


def trend_detail(papers: DataFrame, dim: str, term: str, top: int = 8) -> DataFrame:
    """What stands beside a term in the papers that have it: dim, key, n, the ``top`` of each other dimension but types."""
    terms = record_terms(papers)
    mine = terms.filter((F.col("dim") == dim) & (F.lower("term") == term.strip().lower())).select("seq").distinct()
    beside = terms.join(mine, "seq", "left_semi").filter((F.col("dim") != "types") & ~((F.col("dim") == dim) & (F.lower("term") == term.strip().lower())))
    counts = beside.groupBy("dim", F.lower("term").alias("key")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "key"))).filter(F.col("rank") <= top)


def term_context(papers: DataFrame, dim: str, term: str, top: int = 12, few: int = 8) -> DataFrame:
    """One term in full: part, name, rank, term, n.

    Parts: ``company`` (other terms of its dimension: all, base, recent; ``top`` each), ``cross`` (other dimensions but
    types), ``authors`` and ``journals`` (base, recent; ``few`` each). The recent window is the last ten years of all
    papers, the base the ten before. Equal counts go by first appearance. Undated papers count, but in no window.
    """
    needle, terms = term.strip().lower(), _terms(papers)
    last = F.broadcast(papers.agg(F.max(year_of(papers)).alias("_last")))  # one row
    held = papers.withColumn("_y", year_of(papers)).withColumns({f"_{d}": c for d, c in terms.items()}).filter(F.exists(f"_{dim}", lambda t: F.lower(t) == needle)).crossJoin(last)
    window = F.when(F.col("_y").between(F.col("_last") - 2 * SPAN + 1, F.col("_last") - SPAN), "base").when(F.col("_y").between(F.col("_last") - SPAN + 1, F.col("_last")), "recent")
    tagged = [F.transform(c, (lambda d: lambda x, i: F.struct(F.lit(d).alias("dim"), x.alias("term"), i.alias("at")))(d)) for d, c in terms.items() if d != "types" or d == dim]
    each = held.select("seq", window.alias("w"), F.explode(F.concat(*tagged)).alias("x")).select("seq", "w", "x.*")
    counted = lambda part, name, most: F.struct(F.lit(part).alias("part"), name.alias("name"), F.lit(most).alias("most"))
    none = F.array().cast("array<struct<part:string,name:string,most:int>>")
    own, windowed = F.col("dim") == dim, F.col("dim").isin("authors", "journals")
    company = F.when(F.lower("term") != needle, F.array(counted("company", F.lit("all"), top), counted("company", F.col("w"), top)))
    parts = F.concat(
        F.coalesce(F.when(own, company), none),
        F.when(~own, F.array(counted("cross", F.col("dim"), few))).otherwise(none),
        F.when(windowed, F.array(F.struct(F.col("dim").alias("part"), F.col("w").alias("name"), F.lit(few).alias("most")))).otherwise(none),
    )
    out = each.select("seq", "term", "at", F.explode(F.filter(parts, lambda p: p["name"].isNotNull())).alias("p")).select("p.*", "term", "seq", "at")
    counts = out.groupBy("part", "name", "term", "most").agg(F.count("*").alias("n"), F.min(F.struct("seq", "at")).alias("first"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("part", "name").orderBy(F.desc("n"), "first", "term")))
    return ranked.filter(F.col("rank") <= F.col("most")).select("part", "name", "rank", "term", "n")


def term_papers(papers: DataFrame, dim: str, term: str, most: int = 60) -> tuple[DataFrame, DataFrame]:
    """A term's spelling (that of its last paper) and number of papers (one row), and its latest ``most`` papers: seq, filename, title, year, journal, authors (three).

    Papers without a year come last; those of a year by title, then as listed.
    """
    needle, terms = term.strip().lower(), _terms(papers)
    held = papers.withColumn("_y", year_of(papers)).withColumn("_hit", F.try_element_at(F.filter(terms[dim], lambda t: F.lower(t) == needle), F.lit(1))).filter("_hit is not null")
    told = held.agg(F.max_by("_hit", "seq").alias("term"), F.count("*").alias("total"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = held.select("seq", "filename", blank("title").alias("title"), F.col("_y").alias("year"), blank("container_title").alias("journal"), F.slice(terms["authors"], 1, 3).alias("authors"))
    return told, rows.orderBy(F.desc(F.coalesce("year", F.lit(0))), "title", "seq").limit(most)


def citation_percentile(works: DataFrame, year: str, cited: str, key: str) -> DataFrame:
    """100 * rank / (n - 1) of each work's citations within its year, to one place; alone: 50. Ties by key, not averaged."""
    own = Window.partitionBy(year)
    rank, n = F.row_number().over(own.orderBy(cited, key)) - 1, F.count("*").over(own)
    return works.withColumn("percentile", F.when(n == 1, 50.0).otherwise(F.round(100 * rank / F.greatest(n - 1, F.lit(1)), 1)))


__all__ = ["bursts", "capped", "citation_percentile", "corpus_years", "deltas", "filled", "lead_lag", "newcomers", "record_terms", "record_year", "shares", "smoothed", "term_stats", "term_years", "trend_detail", "windows"]


def in_one_form(values: Column | str, form: Callable[[Column], Column]) -> Column:
    """Values as printed in one form, each once."""
    return F.array_distinct(F.transform(values, form))


def term_totals(terms: DataFrame) -> DataFrame:
    """dim, key, term, first_year, n of terms (seq, year, dim, term; a record's repeats dropped): those equal but for case are one, written as its first record has it."""
    each = terms.filter("term != ''").groupBy("dim", "term").agg(F.min("seq").alias("seq"), F.min("year").alias("year"), F.count("*").alias("n"))  # no texts in the sums, so rows are hashed, not sorted
    return each.groupBy("dim", F.lower("term").alias("key")).agg(F.min_by("term", F.struct("seq", "term")).alias("term"), F.min("year").alias("first_year"), F.sum("n").alias("n"))


def normalised_terms(records: DataFrame) -> DataFrame:
    """seq, year, dim, term of records (seq, year, affiliations, subjects, type) as printed: institutions, subjects and types in one form each,
    a record's repeats dropped after that."""
    dims = {"affiliations": in_one_form("affiliations", normalise.affiliation), "subjects": in_one_form("subjects", normalise.subject), "types": F.array(normalise.kind(F.col("type")))}
    named = lambda d: lambda x: F.struct(F.lit(d).alias("dim"), x.alias("term"))
    listed = F.concat(*(F.transform(c, named(d)) for d, c in dims.items()))
    return records.select("seq", "year", F.explode(listed).alias("x")).select("seq", "year", "x.*").filter("term != ''")
