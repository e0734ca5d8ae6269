"""Names of people and files, identifiers in texts, and JSON inside prose (T10, T15, T16, T48, the surname test of T18)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of surnames that stay small after the first word: fixed values.
PARTICLES = ("van", "von", "de", "der", "den", "del", "della", "di", "da", "la", "le", "du", "dos", "das", "ten", "ter", "zur", "zum")
# Patterns of identifiers: fixed values.
DOI = r"10\.\d{4,9}/[^\s\"'<>)\]]+"
ARXIV = r"arxiv:\s*(\d{4}\.\d{4,5})(v\d+)?"
YEAR = r"\b(?:18|19|20)\d{2}\b"
FILE_NAME = r"^([A-Za-z][A-Za-z'-]*)(?:_([A-Za-z][A-Za-z'-]*))?_([0-9]{4})([a-z]?)\.pdf$"
COPY_NAME = r"(_\d{4}[a-z]?_\d+|\s*\(\d+\)|[_-](?:suppl|supplementary|supplement|appendix|online))\.pdf$"


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def _piece(c: Column) -> Column:
    small = F.lower(c)
    led = lambda by: F.concat(F.lit(by), _capital(F.substr(c, F.lit(len(by) + 1))))
    quoted = F.array_join(F.transform(F.split(c, "'"), _capital), "'")
    return F.when(small.startswith("mc") & (F.length(c) > 2), led("Mc")).when(small.startswith("mac") & (F.length(c) > 3), led("Mac")).when(F.contains(c, F.lit("'")), quoted).otherwise(_capital(c))


def name_case(name: Column) -> Column:
    """A name printed in capitals alone as it is written; others, and what has digits or signs, as they are (null: empty)."""
    text = F.trim(F.coalesce(name, F.lit("")))
    whole = lambda word: F.array_join(F.transform(F.split(word, "-"), _piece), "-")
    words = F.transform(F.split(text, r"\s+"), lambda w, i: F.when((i > 0) & F.lower(w).isin(*PARTICLES), F.lower(w)).otherwise(whole(w)))
    plain = (text != F.upper(text)) | (text == F.lower(text)) | text.rlike(r"[^A-Za-z .'\-]")
    return F.when(plain, text).otherwise(F.array_join(words, " "))


def file_parts(name: Column) -> dict[str, Column]:
    """first, second, year, letter of ``First_Second_1999a.pdf`` (empty where a name is another), and whether it looks like a copy or supplement."""
    part = {n: F.regexp_extract(name, FILE_NAME, i) for i, n in enumerate(("first", "second", "year", "letter"), 1)}
    return part | {"is_copy": name.rlike("(?i)" + COPY_NAME)}


def identifiers(text: Column) -> dict[str, Column]:
    """The first DOI of a text (without closing punctuation), its first arXiv id, and its distinct years in order."""
    doi = F.regexp_replace(F.regexp_extract(text, "(?i)" + DOI, 0), r"[.,;)]+$", "")
    return {"doi": doi, "arxiv": F.regexp_extract(text, "(?i)" + ARXIV, 1), "years": F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({YEAR})"), 1)))}


def _fold(text: str | None) -> str:
    plain = unicodedata.normalize("NFKD", text or "").lower()
    return "".join(x for x in plain if "a" <= x <= "z")


def _forms(names: pd.Series) -> pd.Series:
    return pd.Series([sorted({_fold(x) for x in [n or "", *(n or "").split("-")]} - {""}) for n in names])


def _run_together(forms: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([any(len(f) >= 7 and f in letters for f in of) for of, letters in zip(forms, map(_fold, texts))])


def surname_in_text(surname: Column, text: Column) -> Column:
    """yes or no: whether a surname, or a part of a hyphenated one, is a word of a text, or seven letters and more of it stand
    anywhere in its letters (a-z, without accents); null where a form is too short (two letters) to tell."""
    forms = F.pandas_udf(_forms, "array<string>")(surname)
    words = F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z][A-Za-z'-]*)"), 1), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    short = (F.size(forms) == 0) | F.exists(forms, lambda f: F.length(f) <= 2)
    found = F.arrays_overlap(forms, words) | F.pandas_udf(_run_together, "boolean")(forms, text)
    return F.when(short, F.lit(None)).when(found, "yes").otherwise("no")


def json_within(text: Column) -> Column:
    """The JSON of a text (a variant): all of it, else from its first brace to its last; null where neither is JSON."""

    def strict(c: Column) -> Column:  # in a list, since what follows a value is not looked at otherwise
        listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
        return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))

    return F.coalesce(strict(text), strict(F.regexp_extract(text, r"(?s)\{.*\}", 0)))
