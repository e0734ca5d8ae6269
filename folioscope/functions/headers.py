"""Section headers of papers: lines that are one, as a column (C5), and headings at the start of a paragraph."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Titles of parts within a section, which begin none; words that stay small within a title: fixed values.
SOFT = ("data", "dataset", "datasets", "data collection", "participants", "subjects", "sample", "procedure", "measures", "instruments", "materials", "stimuli", "apparatus", "analysis", "data analysis", "statistical analysis")
SMALL = ("a", "an", "and", "for", "in", "of", "on", "the", "to", "with")
#: Characters of a long line, words of a numbered title, dots of its number; what may part a title from its text.
LONG, MOST_WORDS, DEPTH, PARTING = 120, 15, 2, " \t:.-–—"
_NUMBER, _DOTTED = r"^(\d+(?:\.\d+)*\.?\s+)", r"^(\d+(?:\.\d+)*\.\s+|[IVX]+\.\s+)"
_CHAPTER = r"(?i)^(chapter\s+(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|[ivx]+)[.:]?)"
#: A numbered header behind the end of a sentence.
EMBEDDED = r"(?<=[.!?])\s{1,5}(?=\d+(?:\.\d+)*\.\s+[A-Z])"


def longest_first(titles) -> list[str]:
    return sorted(titles, key=lambda t: (-len(t.split()), -len(t), t))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def header(line: Column, hard: frozenset[str]) -> Column:
    """struct(kind, title) of a line: ``hard`` begins a section, ``soft`` names a part of one, ``none`` is text; hard: the titles of sections."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[.:]+$", "")
    told = lambda kind, title: F.struct(F.lit(kind).alias("kind"), title.alias("title"))
    kind_of = lambda c: F.when(c.isin(*sorted(hard)), "hard").otherwise("soft")
    known = lambda c: c.isin(*sorted(hard), *SOFT)
    none = told("none", F.lit(""))
    after = lambda s, pattern: F.regexp_replace(s, pattern, "")
    rest = lambda s: F.regexp_replace(after(s, _DOTTED), r"^\s+", "")
    named = rf"(?i)^({'|'.join(longest_first([*hard, *SOFT]))})(?=[ \t\n:]|$)"

    def by_chapter(s: Column, whole: bool) -> Column:
        return let(F.regexp_extract(s, _CHAPTER, 1), lambda chapter: F.when(chapter != "", told("hard", s if whole else chapter)).otherwise(none))

    def long_line(s: Column, dotted: Column) -> Column:
        first = F.when(dotted != "", F.regexp_extract(rest(s), named, 1)).otherwise("")
        return let(first, lambda first: F.when(first != "", F.struct(kind_of(F.lower(first)).alias("kind"), F.concat(dotted, first).alias("title"))).otherwise(by_chapter(s, False)))

    def with_number(s: Column, dotted: Column, title: Column) -> Column:
        depth, n_words = F.length(dotted) - F.length(F.replace(dotted, F.lit("."), F.lit(""))), F.size(F.split(title, r"\s+"))
        numbered = title.rlike(r"^\p{Lu}") & ~title.endswith(".") & (n_words <= MOST_WORDS)
        return let(bare(title), lambda own: F.when(known(own), F.struct(kind_of(own).alias("kind"), s.alias("title"))).when(numbered, F.struct(F.when(depth <= DEPTH, "hard").otherwise("soft").alias("kind"), s.alias("title"))).otherwise(by_chapter(s, True)))

    def short(s: Column, dotted: Column) -> Column:
        own = F.when(s.rlike(r"^[\p{Lu}0-9]"), bare(after(s, _NUMBER))).otherwise("")
        others = F.when(dotted != "", let(rest(s), lambda title: with_number(s, dotted, title))).otherwise(by_chapter(s, True))
        found = let(own, lambda own: F.when(known(own), F.struct(kind_of(own).alias("kind"), s.alias("title"))).otherwise(others))
        return F.when(s.rlike(r"\s+\d+$"), none).otherwise(found)  # not a line of a contents page

    def of(s: Column) -> Column:
        return F.when(s == "", none).otherwise(let(F.regexp_extract(s, _DOTTED, 1), lambda dotted: F.when(F.length(s) > LONG, long_line(s, dotted)).otherwise(short(s, dotted))))

    return let(F.coalesce(F.regexp_replace(line, r"^\s+|\s+$", ""), F.lit("")), of)


def opening_title(block: str, titles: list[str]) -> tuple[str, str] | None:
    """(title with its number, the text after it) where a paragraph opens with a title in capitals or capital letters; titles: longest first."""
    flat = " ".join(block.split())
    number = re.match(_NUMBER, flat)
    lead = number[0] if number else ""
    rest = flat[len(lead) :]
    for title in titles:
        said, text = rest[: len(title)], rest[len(title) :]
        if said.lower() != title or text.startswith("."):
            continue
        words, text = re.findall(r"[A-Za-z]+", said), text.lstrip(" :.-–—")
        capital = said.isupper() or all(w[0].isupper() or w.lower() in SMALL for w in words)
        if capital and text and (text[0].isupper() or text[0].isdigit() or text[0] == "("):
            return (lead + said).strip(), text
    return None
