"""Text measures and normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_features(text: Column) -> dict[str, Column]:
    """Shares of a text's characters, and words: what the audit decides on."""
    n = F.greatest(F.length(text), F.lit(1))
    return {
        "n_chars": F.length(text).cast("long"),
        "space_share": F.round((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / n, 6),
        "symbol_share": F.round(F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:!?'\"()-]", "")) / n, 6),
        "n_words": F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long"),
    }


def quality_status(features: DataFrame) -> Column:
    """The worst fault that applies: no_text, undecodable, low_text, glued_text, else ok."""
    return (
        F.when(F.col("n_chars") == 0, "no_text").when(F.col("symbol_share") > 0.3, "undecodable").when(F.col("n_words") < 20, "low_text").when(F.col("space_share") < 0.08, "glued_text").otherwise("ok")
    )


def character(code: Column) -> Column:
    """The character of a code point: unlike Spark's own, beyond 255 too. Surrogates are left out (55296 is U+E000); blank behind the last one."""
    real = F.when(code < 0xD800, code).otherwise(code + 0x800)
    return F.when(real <= 0x10FFFF, F.decode(F.unhex(F.lpad(F.hex(real), 8, "0")), "UTF-32")).otherwise(F.lit(""))


def plain_text(html: Column) -> Column:
    """Markup to text: scripts, styles, comments and tags go, entities of the five kinds are read, white space collapses."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def distinctive_coverage(words: Column, text: Column) -> Column:
    """The share of a title's distinct words of five letters or more that a text holds."""
    own = F.array_distinct(F.filter(words, lambda w: F.length(w) > 4))
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda w: F.contains(text, w))) / F.size(own)).otherwise(0.0)


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def content_id(text: Column) -> Column:
    return F.concat(F.lit("doc-"), F.md5(text.cast("binary")))


def clean_list(values: Column, cap: int) -> Column:
    """White space collapsed, 80 characters at most, no repeats but for case, ``cap`` at most."""
    plain = F.filter(F.transform(values, lambda v: F.substring(F.trim(F.regexp_replace(v, r"\s+", " ")), 1, 80)), lambda v: v != "")
    kept = F.aggregate(plain, F.array().cast("array<string>"), lambda a, v: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(v)), a).otherwise(F.array_append(a, v)))
    return F.slice(kept, 1, cap)


def fraction_of_year(date: Column) -> Column:
    """YYYY to the middle of the year, YYYY-MM to the middle of the month, YYYY-MM-DD to the day."""
    y, m, d = (F.nullif(F.regexp_extract(date, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", i), F.lit("")).cast("double") for i in (1, 2, 3))
    days = F.element_at(F.array(*[F.lit(x) for x in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), F.coalesce(m, F.lit(1)).cast("int"))
    return F.when(m.isNull(), y + 0.5).when(d.isNull(), y + (m - 0.5) / 12).otherwise(y + (m - 1 + (d - 0.5) / days) / 12)
