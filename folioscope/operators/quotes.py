"""Quotes found on pages although words were changed, lost or added, over up to three more pages.

Pages and quotes are dealt by document once and read in order, a document's pages before its quotes; nothing is written
between the first page and the next ones. Seeds are places of a quote's first word, those where the second word follows if
there are any. From each seed a walk extends along the page; the place of most matching words wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranks import dealt

#: Words of an opening phrase, longest first; misses allowed at least, and as a share of the words tried.
TIERS, MISSES, MISS_SHARE = (14, 10, 7, 5), 4, 0.34
#: Pages after the first; the least that a quote after a blank line, or what is left for the next page, may have.
MORE_PAGES, LEAST_WORDS = 3, 5


def plain_words(c: Column) -> Column:
    """Words as their ASCII letters and digits in lower case; what has none is no word."""
    return F.filter(F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]+", "")), lambda w: w != "")


def seeds_of(page: list[str], quote: list[str]) -> list[int]:
    """Where a walk may start on one page."""
    first = [i for i, w in enumerate(page) if w == quote[0]]
    both = [i for i in first if page[i + 1 : i + 2] == quote[1:2]] if len(quote) > 1 else first
    return both or first


def extend(page: list[str], quote: list[str], seed: int) -> tuple[int, int, int]:
    """(words matched, place of the last match, words of the quote used) of a walk from a seed.

    Where page and quote differ, one word is left out of the side whose next word fits the other's, the quote's first;
    otherwise both go on and the difference is a miss. Too many misses end the walk.
    """
    place, used, hits, misses, last = seed, 0, 0, 0, seed
    here, wanted = len(page), len(quote)
    while place < here and used < wanted and misses <= max(MISSES, int(MISS_SHARE * (hits + misses))):
        word = page[place]
        if word == quote[used]:
            hits, last, place, used = hits + 1, place, place + 1, used + 1
        elif quote[used + 1 : used + 2] == [word]:
            used += 1
        elif page[place + 1 : place + 2] == [quote[used]]:
            place += 1
        else:
            misses, place, used = misses + 1, place + 1, used + 1
    return hits, last, used


def aligned(page: list[str], quote: list[str], seeds: list[int]) -> tuple[int, int, int, int]:
    """(words matched, first place, last place, words used) from the best of the seeds, the earliest of equals; no match: zeros."""
    best = (0, 0, -1, 0)
    for seed in seeds:
        hits, last, used = extend(page, quote, seed)
        if hits > best[0]:
            best = (hits, seed, last, used)
    return best


def _attempts(quotes: DataFrame) -> DataFrame:
    """(quote_id, doc, hint, attempt, q): a quote's words, and those after each blank line in it (what is before may be a blurb)."""
    hint = F.col("hint_page") if "hint_page" in quotes.columns else F.lit(None)
    own = quotes.select("quote_id", "doc", hint.cast("int").alias("hint"), "quote").filter(F.size(F.filter(F.split("quote", r"\s+"), lambda w: w != "")) >= 3)
    parts = own.select("quote_id", "doc", "hint", F.posexplode(F.split("quote", "\n\n")).alias("attempt", "part"), "quote")
    words = parts.withColumn("q", plain_words(F.when(F.col("attempt") == 0, F.col("quote")).otherwise(F.col("part"))))
    return words.filter((F.size("q") > 0) & ((F.col("attempt") == 0) | (F.size("q") >= LEAST_WORDS))).select("quote_id", "doc", "hint", "attempt", "q")


def opening(page: list[str], quote: list[str]) -> int | None:
    """How much of a quote's opening phrase stands on a page: the longest tier that does (a short quote is one itself), none for under three words."""
    if len(quote) < 3:
        return None
    places = [i for i, w in enumerate(page) if w == quote[0] and page[i : i + 3] == quote[:3]]
    return max((n for n in (min(t, len(quote)) for t in TIERS) if any(page[i : i + n] == quote[:n] for i in places)), default=None)


def _first_pages(attempts: DataFrame, pages: DataFrame) -> DataFrame:
    """attempts with the page of most matched words; where an opening phrase stands on a page, only that page counts: of several the longest phrase's, the hinted, the first.

    first_page() by joins, to check it against: locate_roughly() does not use it, as each of its joins shuffles the pages.
    """
    first = attempts.select("quote_id", "attempt", "doc", "hint", F.array_join("q", " ").alias("q"), F.col("q")[0].alias("w"))
    wanted = first.groupBy("doc").agg(F.collect_set("w").alias("wanted"))
    hit = pages.join(wanted, "doc").withColumn("found", F.array_intersect("words", "wanted")).filter(F.size("found") > 0)  # only pages that hold a first word go on
    places = hit.select("doc", "page", F.array_join("words", " ").alias("words"), F.explode("found").alias("w"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hits, phrases = [], []
            for w, x, attempt in zip(b["words"], b["q"], b["attempt"], strict=True):
                page, quote = w.split(" "), x.split(" ")
                hits.append(aligned(page, quote, seeds_of(page, quote))[0])
                phrases.append(opening(page, quote) if attempt == 0 else None)
            yield b[["quote_id", "attempt", "page", "hint"]].assign(hits=hits, phrase=pd.array(phrases, dtype="Int32")).astype({"hint": "Int32"})

    kind = attempts.schema["quote_id"].dataType.simpleString()
    met = places.join(first, ["doc", "w"]).select("quote_id", "attempt", "page", "hint", "words", "q")
    scored = met.mapInPandas(run, f"quote_id {kind}, attempt int, page int, hint int, hits int, phrase int")
    order = [F.desc_nulls_last("phrase"), F.desc(F.when(F.col("phrase").isNull(), F.col("hits"))), F.when(F.col("page") == F.col("hint"), 0).otherwise(1), "page"]
    best = scored.filter("hits > 0").withColumn("_r", F.row_number().over(Window.partitionBy("quote_id", "attempt").orderBy(*order))).filter("_r = 1")
    return attempts.join(best.select("quote_id", "attempt", "page"), ["quote_id", "attempt"])


def first_page(pages: dict[int, list[str]], quote: list[str], attempt: int, hint: int | None) -> int | None:
    """The page of most matched words; where an opening phrase stands on a page, only that page counts: of several the longest phrase's, the hinted, the first."""
    best = None
    for page, words in pages.items():
        hits = aligned(words, quote, seeds_of(words, quote))[0] if quote[0] in words else 0
        if hits:
            phrase = opening(words, quote) if attempt == 0 else None
            key = (-(phrase or 0), -hits if phrase is None else 0, page != hint, page)
            best = key if best is None else min(best, key)
    return None if best is None else best[-1]


def placed(pages: dict[int, list[str]], quote: list[str], attempt: int, hint: int | None) -> tuple[list[tuple[int, int, int]], int] | None:
    """(spans, words matched) of a quote on the pages of its document, from its first page over the next ones; None if too few words match."""
    page, left, spans, matched, off = first_page(pages, quote, attempt, hint), quote, [], 0, True
    while page in pages and len(spans) <= MORE_PAGES and (not spans or len(left) >= LEAST_WORDS):
        words = pages[page]
        hits, first, last, used = aligned(words, left, seeds_of(words, left))
        if hits < (3 if off else max(LEAST_WORDS, min(20, len(left) // 2))):
            break
        spans.append((page, first, last))
        matched, left, off, page = matched + hits, left[used:], last >= len(words) - 3, page + 1
    n = len(quote)
    least = min(n, max(3, min(floor((0.6 if n < 12 else 0.25) * n), 20)))
    return (spans, matched) if spans and matched >= least else None


def locate_roughly(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes (quote_id, doc, quote, perhaps hint_page) on pages (doc, page: int, words: plain_words): quote_id, page, spans, matched.

    spans: (page, first word, last word), the first page's first. A quote that does not end on its page goes on at the
    next; a page that does not take up the quote ends it. Found is what matches 25 percent of its words (60 under twelve
    words), 20 at most and 3 at least; of a quote and its parts after blank lines, the first found. Others have no row.
    A task holds the pages of one document at a time.
    """
    kind = quotes.schema["quote_id"].dataType.simpleString()
    held = pages.select("doc", "page", F.array_join("words", " ").alias("words")).filter("doc is not null and page is not null")
    asked = _attempts(quotes).filter("doc is not null").select("quote_id", "doc", "hint", "attempt", F.array_join("q", " ").alias("words"))
    both = dealt(held.unionByName(asked, allowMissingColumns=True), "doc").sortWithinPartitions("doc", F.col("page").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held = None, {}
        for b in batches:
            ids, found, at = b.column("quote_id"), [], []
            for i, (own, page, words, attempt, hint) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc", "page", "words", "attempt", "hint")), strict=True)):
                if own != doc:
                    doc, held = own, {}
                if page is not None:
                    held[page] = (words or "").split()
                elif (place := placed(held, words.split(), attempt, hint)) is not None:
                    at.append(i)
                    found.append((attempt, *place))
            spans = pa.array([[dict(zip(("page", "first", "last"), x)) for x in spans] for _, spans, _ in found], pa.list_(pa.struct([(c, pa.int32()) for c in ("page", "first", "last")])))
            columns = [ids.take(pa.array(at, pa.int64())), pa.array([a for a, _, _ in found], pa.int32()), spans, pa.array([m for _, _, m in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["quote_id", "attempt", "spans", "matched"])

    found = both.mapInArrow(run, f"quote_id {kind}, attempt int, spans array<struct<page:int,first:int,last:int>>, matched long")
    sure = found.withColumn("_r", F.row_number().over(Window.partitionBy("quote_id").orderBy("attempt"))).filter("_r = 1")
    return sure.select("quote_id", F.col("spans")[0]["page"].alias("page"), "spans", "matched")
