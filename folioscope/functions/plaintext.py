"""Markdown as plain text (DB19), formulas as the page's renderer wants them (T49), names that say nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of a paper's furniture, perhaps with a number: fixed values.
_FURNITURE = "table|figure|fig|study|experiment|exp|appendix|equation|section|chapter|participants?|stimuli|procedure|methods?|results?|discussion|introduction|abstract|model|step|phase|task|item|block"
#: What goes, or stays without its marks, one after the other: fixed values.
_MARKS = (
    (r"(?m)^```[^\n]*\n?|```$", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"(?m)^>[ \t]?", ""),
    (r"(?m)^[ \t]*(?:[-*_][ \t]*){3,}$", ""), (r"(?m)^([ \t]*)[*+-][ \t]+", "$1• "), (r"`([^`]+)`", "$1"),
)
_EMPHASIS = r"(?s)(\*\*\*|\*\*|\*|___|__|_)(?=\S)(.*?\S)\1"
#: How deep emphasis within emphasis is unwrapped.
DEPTH = 8


def is_generic(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike(rf"(?i)^({_FURNITURE})\.?\s*\d*[a-z]?$"), F.lit(False))


def plain_markdown(c: Column) -> Column:
    """What a page shows of a text, without the marks that format it."""
    for pattern, rest in _MARKS:
        c = F.regexp_replace(c, pattern, rest)
    for _ in range(DEPTH):
        c = F.regexp_replace(c, _EMPHASIS, "$2")
    c = F.regexp_replace(c, r"\\([\\`*_{}\[\]()#+\-.!>])", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def numbered_references(apa: Column, filename: Column) -> Column:
    """A list of references (arrays of what each says, and of their files) as plain text, blank for none."""
    said = F.zip_with(apa, filename, lambda a, f: plain_markdown(F.coalesce(F.nullif(a, F.lit("")), f)))
    lines = F.transform(said, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    return F.when(F.size(apa) > 0, F.concat(F.lit("References\n\n"), F.array_join(lines, "\n\n"))).otherwise("")


def plain_math(c: Column) -> Column:
    r"""Formulas in ``\[…\]`` and ``\(…\)`` between dollars; per cent signs within formulas escaped, those in prose not."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)\\\[(.*?)\\\]", "\n\\$\\$$1\\$\\$\n"), r"(?s)\\\((.*?)\\\)", r"\$$1\$")
    # the parts between formulas and the formulas themselves take turns, as the pattern splits the text
    formula = r"(?s)\$\$.*?\$\$|(?<!\$)\$(?!\$)[^\n$]+?\$(?!\$)"
    spans, between = F.regexp_extract_all(c, F.lit(f"({formula})"), F.lit(1)), F.split(c, formula, -1)
    escaped = F.transform(spans, lambda s: F.regexp_replace(s, r"(?<!\\)%", r"\\%"))
    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(escaped, i), F.lit("")))), "")
