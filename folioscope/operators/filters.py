"""Metadata filters over papers: AND across dimensions, OR within a list."""

from __future__ import annotations

from dataclasses import dataclass, fields, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    papers: list[str] = field(default_factory=list)
    authors: list[str] = field(default_factory=list)
    year: int | None = None
    years: list[int] = field(default_factory=list)
    year_from: int | None = None
    year_to: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    journals: list[str] = field(default_factory=list)
    subjects: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    affiliations: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)

    def active(self) -> bool:
        return any(getattr(self, f.name) not in (None, "", [], ()) for f in fields(self))


def clean(values: list[str]) -> list[str]:
    return [v.strip().lower() for v in values if v and v.strip()]


def lower(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))


def stem(filename: Column) -> Column:
    return F.regexp_replace(lower(filename), r"\.pdf$", "")


def record_year(year: Column) -> Column:
    """The first four digits anywhere, as a number."""
    return F.expr("cast(null as int)") if year is None else F.try_to_number(F.nullif(F.regexp_extract(F.coalesce(year.cast("string"), F.lit("")), r"\d{4}", 0), F.lit("")), F.lit("9999")).cast("int")


_PARTIAL = r"^\s*(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?"


def date_end(date: Column, end: bool) -> Column:
    """A partial date's first or last day as yyyymmdd; a month always ends on day 31."""
    part = lambda i, missing: F.coalesce(F.nullif(F.regexp_extract(date, _PARTIAL, i), F.lit("")), F.lit(missing)).cast("int")
    whole = part(1, "0") * 10000 + part(2, "12" if end else "1") * 100 + part(3, "31" if end else "1")
    return F.when(date.rlike(_PARTIAL), whole)


def date_end_of(value: str, end: bool) -> int | None:
    import re

    m = re.match(_PARTIAL, value or "")
    return int(m[1]) * 10000 + int(m[2] or (12 if end else 1)) * 100 + int(m[3] or (31 if end else 1)) if m else None


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _contains(needles: list[str], text: Column) -> Column:
    return any_of([F.contains(text, F.lit(n)) for n in needles])


def _any_contains(needles: list[str], values: str) -> Column:
    return F.exists(values, lambda x: _contains(needles, lower(x)))


def _initials(given: Column) -> Column:
    parts = F.filter(F.split(F.trim(given), r"[\s.]+"), lambda t: t != "")
    return F.lower(F.array_join(F.transform(parts, lambda t: F.substring(t, 1, 1)), ""))


def _only_initials(given: Column) -> Column:
    parts = F.filter(F.split(F.trim(given), r"[\s.]+"), lambda t: t != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda t: t.rlike(r"^\p{L}$"))


def given_matches(a: Column, b: Column) -> Column:
    """Could two given names be one person's: a prefix of the other, or of its initials where either is initials only."""
    plain = lambda g: F.regexp_replace(F.lower(F.coalesce(g, F.lit(""))), "[^a-z0-9]", "")
    x, y, i, j = plain(a), plain(b), _initials(a), _initials(b)
    either = lambda p, q: F.startswith(p, q) | F.startswith(q, p)
    return (x != "") & (y != "") & (either(x, y) | ((_only_initials(a) | _only_initials(b)) & either(i, j)))


def people(papers: DataFrame) -> Column:
    """array<struct<family, given>> of a papers row: authors and editors, or the family and given columns."""
    found = [F.coalesce(F.col(c), F.expr("cast(array() as array<struct<family:string,given:string>>)")) for c in ("authors", "editors") if c in papers.columns]
    return F.concat(*found) if found else F.array(F.struct("family", "given"))


def author_matches(term: str, everyone: Column, loose: bool = False) -> Column:
    family, _, given = (x.strip() for x in term.lower().partition(","))
    if not family:
        return F.lit(False)
    same = lambda p: lower(p["family"]) == family
    if given:
        return F.exists(everyone, lambda p: same(p) & given_matches(F.lit(given), p["given"]))
    return F.exists(everyone, (lambda p: F.contains(lower(p["family"]), F.lit(family))) if loose else same)


def loose_terms(papers: DataFrame, filters: Filters) -> set[str]:
    """Bare surnames that no record of the whole table has exactly: only these match as substrings.

    One pass over the table; what comes back is at most the filter's own terms.
    """
    terms = [t for t in clean(filters.authors) if not t.partition(",")[2].strip()]
    if not terms:
        return set()
    families = papers.select(F.explode(people(papers)).alias("p")).select(lower(F.col("p.family")).alias("f")).filter(F.col("f").isin(terms)).distinct()
    return set(terms) - {r.f for r in families.collect()}


def condition(papers: DataFrame, filters: Filters) -> Column | None:
    """The filter as one predicate, or None when no dimension is active."""
    if not filters.active():
        return None
    out: list[Column] = []
    have = set(papers.columns)
    if names := clean(filters.papers):
        out.append(stem(F.col("filename")).isin([n.removesuffix(".pdf") for n in names]))
    if terms := clean(filters.authors):
        loose = loose_terms(papers, filters)
        out.append(any_of([author_matches(t, people(papers), t in loose) for t in terms]))
    year = record_year(F.col("year"))
    if filters.year is not None:
        out.append(year == filters.year)
    if filters.years:
        out.append(year.isin(filters.years))
    if filters.year_from is not None:
        out.append(year >= filters.year_from)
    if filters.year_to is not None:
        out.append(year <= filters.year_to)
    if filters.date_from is not None or filters.date_to is not None:
        date = F.nullif(F.col("date"), F.lit("")) if "date" in have else F.lit(None).cast("string")
        starts = F.when(date.isNotNull(), date_end(date, False)).otherwise(year * 10000 + 101)
        ends = F.when(date.isNotNull(), date_end(date, True)).otherwise(year * 10000 + 1231)
        out.append(starts.isNotNull())
        if (lo := date_end_of(filters.date_from or "", False)) is not None:
            out.append(ends >= lo)
        if (hi := date_end_of(filters.date_to or "", True)) is not None:
            out.append(starts <= hi)
    if needles := clean(filters.journals):
        out.append(_contains(needles, F.lower(F.coalesce("container_title", F.lit("")))))
    for name in ("subjects", "keywords"):
        if needles := clean(getattr(filters, name)):
            out.append(_any_contains(needles, name))
    if needles := clean(filters.affiliations):
        out.append(_any_contains(needles, "affiliations") if "affiliations" in have else _contains(needles, lower("affiliation")))
    if kinds := clean(filters.types):
        out.append(lower("type").isin(kinds))
    return F.coalesce(all_of(out), F.lit(False))


def resolve(papers: DataFrame, filters: Filters) -> DataFrame | None:
    """Papers that satisfy the filter; None when it is inactive (keep the unfiltered path), not the same as no rows."""
    found = condition(papers, filters)
    return None if found is None else papers.filter(found)


def validate(papers: DataFrame, filters: Filters) -> DataFrame:
    """How many papers each single value matches, and their conjunction, in one pass: dimension, value, n."""
    probes: list[tuple[str, str, Column]] = []
    for f in fields(filters):
        value = getattr(filters, f.name)
        for v in value if isinstance(value, list) else [value] if value is not None else []:
            one = Filters(**{f.name: [v] if isinstance(value, list) else v})
            probes.append((f.name, str(v), condition(papers, one)))
    probes.append(("all", "", condition(papers, filters) if filters.active() else F.lit(True)))
    counts = papers.agg(*[F.sum(c.cast("long")).alias(f"n{i}") for i, (_, _, c) in enumerate(probes)])
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("n")) for i, (d, v, _) in enumerate(probes)])
    return counts.select(F.explode(rows).alias("x")).select("x.*")


def quick_match(q: str, haystack: list[Column]) -> Column:
    """Every word of q lies in some field."""
    hay = F.array(*[F.lower(F.coalesce(h, F.lit(""))) for h in haystack])
    holds = lambda t: F.exists(hay, lambda h: F.contains(h, F.lit(t)))
    return all_of([holds(t) for t in q.strip().lower().split()])


#: Dimensions of a filter that hold one year: of two filters the second's counts.
_ONE_YEAR = ("year", "year_from", "year_to")


def _family(author: Column) -> Column:
    return F.lower(F.trim(F.split_part(author, F.lit(","), F.lit(1))))


def narrowed(authors: Column) -> Column:
    """Authors without the bare family names of those who are named in person: ``Zhang`` goes beside ``Zhang, Kechen``."""
    special = lambda a: F.contains(a, F.lit(",")) & (F.trim(F.split_part(a, F.lit(","), F.lit(2))) != "")
    people_named = F.transform(F.filter(authors, special), _family)
    return F.filter(authors, lambda a: special(a) | ~F.array_contains(people_named, _family(a)))


def merged(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Two filters of a row (columns by dimension) as one: lists united, trimmed, blanks dropped, authors narrowed; years in order; of single years the second's."""
    out: dict[str, Column] = {}
    for name in dict.fromkeys([*a, *b]):
        sides = [side[name] for side in (a, b) if name in side]
        if name in _ONE_YEAR:
            out[name] = F.coalesce(*reversed(sides))
        elif name == "years":
            out[name] = F.array_sort(F.array_distinct(F.concat(*(F.coalesce(s, F.array().cast("array<int>")) for s in sides))))
        else:
            united = F.array_distinct(F.filter(F.transform(F.concat(*(F.coalesce(s, F.array().cast("array<string>")) for s in sides)), lambda x: F.trim(x)), lambda x: x != ""))
            out[name] = narrowed(united) if name == "authors" else united
    return out


def without_dismissed(found: dict[str, Column], dismissed: list[str]) -> dict[str, Column]:
    """A filter without the values whose key (``authors:caplan``, ``year_from:2020``) a user dismissed."""
    keys = F.array(*(F.lit(d) for d in dismissed)) if dismissed else F.array().cast("array<string>")
    key = lambda name, x: F.concat(F.lit(name + ":"), F.lower(x.cast("string")))
    kept = {n: F.when(~F.array_contains(keys, key(n, c)), c) if n in _ONE_YEAR else F.filter(c, (lambda n: lambda x: ~F.array_contains(keys, key(n, x)))(n)) for n, c in found.items()}
    return kept
