"""Citations in answers, and quotes found on pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BRACKETS = r"\[\s*\d+(?:\s*[,;]\s*\d+)*\s*\]"
#: Bracketed numbers, those side by side as one, with round brackets around them or without.
_CLUSTER = re.compile(rf"\(\s*{_BRACKETS}(?:\s*[,;]?\s*{_BRACKETS})*\s*\)|{_BRACKETS}(?:[ \t]*[,;]?[ \t]*{_BRACKETS})*")
_HEADING = r"^[ \t]{0,3}(?:#{1,6}[ \t]*|\*\*[ \t]*)?references[ \t]*:?[ \t]*\**[ \t]*$"


def without_references(answer: Column) -> Column:
    """An answer up to its own list of references: the last such heading."""
    held = rf"(?ims)\A(.*){_HEADING}.*\z"
    return F.regexp_replace(F.when(F.rlike(answer, F.lit(held)), F.regexp_extract(answer, held, 1)).otherwise(answer), r"\s+\z", "")


def cited_ids(answer: Column) -> Column:
    """The numbers that an answer cites in brackets, in order, each once."""
    clusters = F.regexp_extract_all(answer, F.lit(r"\[(\d+(?:\s*[,;]\s*\d+)*)\]"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(clusters, lambda c: F.transform(F.split(c, r"\s*[,;]\s*"), lambda x: x.cast("int")))))


def rewrite(text: str, labels: dict[str, str], drop_unknown: bool = False) -> str:
    """Bracketed numbers to in-text citations, a cluster as one, its labels in alphabetical order; marks stay behind the citation.

    A cluster with a number that has no label stays as it is, or loses that number with drop_unknown.
    """

    def one(m: re.Match) -> str:
        numbers = dict.fromkeys(re.findall(r"\d+", m[0]))
        known = [labels[x].strip("()") for x in numbers if x in labels]
        if len(known) < len(numbers) and not drop_unknown:
            return m[0]
        return f"({'; '.join(sorted(known, key=str.lower))})" if known else ""

    out = re.sub(rf"([.!?])[ \t]*({_CLUSTER.pattern})(\s|$)", r" \2\1\3", text)
    return re.sub(r" +([.,;!?])", r"\1", re.sub(r"[ \t]{2,}", " ", _CLUSTER.sub(one, out))).strip()


def render(answers: DataFrame, references: DataFrame) -> DataFrame:
    """answers (answer_id, answer) and references (answer_id, n, intext, apa) to answer_id, text, references_list.

    Only cited references are listed, in alphabetical order.
    """
    bare = answers.select("answer_id", without_references(F.col("answer")).alias("body")).withColumn("cited", cited_ids(F.col("body")))
    used = bare.select("answer_id", F.explode("cited").alias("n")).join(references, ["answer_id", "n"])
    listed = used.groupBy("answer_id").agg(F.map_from_entries(F.collect_set(F.struct(F.col("n").cast("string"), "intext"))).alias("labels"), F.array_sort(F.collect_set("apa")).alias("references_list"))
    joined = bare.join(listed, "answer_id", "left").select("answer_id", "body", "labels", "references_list")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [rewrite(t or "", dict(m or {})) for t, m in zip(b["body"], b["labels"], strict=True)]
            yield pd.DataFrame({"answer_id": b["answer_id"], "text": texts, "references_list": b["references_list"]})

    kind = answers.schema["answer_id"].dataType.simpleString()
    return joined.mapInPandas(run, f"answer_id {kind}, text string, references_list array<string>")


def norm_words(c: Column) -> Column:
    """Lower-cased words with letters and digits only; what has none is no word."""
    return F.filter(F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")


def locate(quotes: DataFrame, pages: DataFrame, tiers: tuple[int, ...] = (14, 10, 7, 5, 3)) -> DataFrame:
    """quotes (quote_id, doc, quote) on pages (doc, page, words: normalised): quote_id, page, at, n_words.

    A quote's first words, as many as the longest tier that matches, are looked up among the pages' runs of as many
    words; of equals the hinted page (a column hint_page), then the first page and place. Quotes of fewer than three words are not sought.
    """
    hint = F.col("hint_page") if "hint_page" in quotes.columns else F.lit(None)
    asked = quotes.select("quote_id", "doc", hint.alias("_hint"), norm_words(F.col("quote")).alias("q")).filter(F.size("q") >= min(tiers))
    out = None
    for n in tiers:
        want = asked.filter(F.size("q") >= n).select("quote_id", "doc", "_hint", F.array_join(F.slice("q", 1, n), " ").alias("k"))
        at = F.sequence(F.lit(1), F.size("words") - n + 1)
        runs = pages.filter(F.size("words") >= n).select("doc", "page", F.posexplode(F.transform(at, _run_of(n))).alias("at", "k"))
        hits = want.join(runs, ["doc", "k"]).select("quote_id", "page", "at", F.lit(n).alias("n_words"), F.when(F.col("page") == F.col("_hint"), 0).otherwise(1).alias("_far"))
        out = hits if out is None else out.unionByName(hits)
    best = Window.partitionBy("quote_id").orderBy(F.desc("n_words"), "_far", "page", "at")
    return out.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r", "_far")


def _run_of(n: int):
    return lambda i: F.array_join(F.slice("words", i, n), " ")


def line_boxes(words: DataFrame) -> DataFrame:
    """The box of each line of words: doc, page, block, line, x0, y0, x1, y1."""
    return words.groupBy("doc", "page", "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def valid_excerpt(excerpt: Column, text: Column, least: int = 5, most: int = 120) -> Column:
    """Is an excerpt held word for word, white space aside, and of a fair length?"""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    n = F.size(F.split(flat(excerpt), " "))
    return F.contains(flat(text), flat(excerpt)) & n.between(least, most)



#: What ends in a full stop without ending a sentence, and what may stand before a citation in its brackets.
_SHORT = ("al", "e.g", "i.e", "cf", "vs", "etc", "fig", "eq", "ref", "no", "p", "pp", "ch", "dr", "prof", "mr", "mrs", "ms", "st", "jr", "sr", "approx", "ca")
_LEADS = r"see|cf\.?|e\.g\.?,?|supported by|sources?:?"
_RUN = rf"{_BRACKETS}(?:[ \t]*[,;]?[ \t]*{_BRACKETS})*"
_TRAILING = re.compile(rf"(?P<mark>[.!?])(?P<closed>[)\"'”’\]]*)[ \t]*(?P<run>{_RUN})")
_LAST_WORD = re.compile(r"(?:^|[\s(])([A-Za-z.]+)$")
_CITED = r"\([^()]*\b\d{4}[a-z]?\b[^()]*\)"
_WRAPPED = re.compile(rf"\(\s*(?:{_LEADS})?\s*({_CITED})\s*\)", re.IGNORECASE)
_TWICE = re.compile(rf"({_CITED})\s*\.?\s*\1")


def cited_inside(text: str) -> str:
    """Citations that follow a sentence's mark go before it, but not into a quotation nor behind an abbreviation."""

    def moved(m: re.Match) -> str:
        word = _LAST_WORD.search(text[: m.start()])
        if m["closed"] or (m["mark"] == "." and word and word[1].lower() in _SHORT):
            return m[0]
        gap = " " if m.start() and not text[m.start() - 1].isspace() else ""
        return gap + m["run"] + m["mark"]

    return _TRAILING.sub(moved, text)


def plainly_cited(text: str) -> str:
    """Citations without a second pair of brackets and what leads into it, and once where one stands twice in a row."""
    before = None
    while before != text:
        before, text = text, _WRAPPED.sub(r"\1", text)
    return _TWICE.sub(r"\1", text)


def in_text_citations(text: str, labels: dict[str, str]) -> str:
    """rewrite() without its tidying of spaces: a cluster with a number that has no label stays as it is."""

    def one(m: re.Match) -> str:
        numbers = list(dict.fromkeys(re.findall(r"\d+", m[0])))
        return f"({'; '.join(sorted((labels[x] for x in numbers), key=str.lower))})" if all(x in labels for x in numbers) else m[0]

    return _CLUSTER.sub(one, text)


def with_references(answers: DataFrame, references: DataFrame) -> DataFrame:
    """answers (answer_id, answer) in APA style: answer_id, text, a list of references after it where it cites any.

    references: answer_id, n, intext (without brackets), apa, pages (a label or blank), locator (or blank). Only those
    cited are listed, by in-text label; each with the pages its passages are on, and where to find it.
    """
    line = F.concat(F.lit("- "), "apa", F.when(F.coalesce("pages", F.lit("")) != "", F.concat(F.lit(" ("), "pages", F.lit(")"))).otherwise(""), F.when(F.coalesce("locator", F.lit("")) != "", F.concat(F.lit(" — "), "locator")).otherwise(""))
    bare = answers.select("answer_id", without_references(F.col("answer")).alias("body")).withColumn("cited", cited_ids(F.col("body")))
    used = bare.select("answer_id", F.explode("cited").alias("n")).join(references, ["answer_id", "n"]).select("answer_id", "n", "intext", line.alias("line"))
    entry = F.struct(F.lower("intext").alias("by"), "n", "intext", "line")
    listed = used.groupBy("answer_id").agg(F.sort_array(F.collect_list(entry)).alias("refs"))  # as many as one answer cites
    block = F.concat(F.lit("\n\n### References\n\n"), F.array_join(F.transform("refs", lambda r: r["line"]), "\n"))
    labels = F.map_from_entries(F.transform("refs", lambda r: F.struct(r["n"].cast("string"), r["intext"])))
    joined = bare.join(listed, "answer_id", "left").select("answer_id", "body", labels.alias("labels"), F.coalesce(block, F.lit("")).alias("block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [plainly_cited(in_text_citations(cited_inside(t or ""), dict(m if m is not None else {}))) for t, m in zip(b["body"], b["labels"], strict=True)]
            yield pd.DataFrame({"answer_id": b["answer_id"], "text": [t.rstrip() + block if block else t for t, block in zip(texts, b["block"], strict=True)]})

    kind = answers.schema["answer_id"].dataType.simpleString()
    return joined.mapInPandas(run, f"answer_id {kind}, text string")


def numbered_context(passages: DataFrame, by: str) -> DataFrame:
    """by, context: each question's passages (by, pos, content; blank ones and those of null source left out) as one text, numbered one by one."""
    fit = passages.filter((F.coalesce("content", F.lit("")) != "") & F.col("source").isNotNull())
    listed = F.sort_array(F.collect_list(F.struct("pos", "content")))
    lines = F.transform(listed, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["content"]))
    head = "-----Sources (cite each supporting passage by its bracketed number)-----\n"
    found = fit.groupBy(by).agg(F.array_join(lines, "\n\n").alias("body"))
    return passages.select(by).distinct().join(found, by, "left").select(by, F.concat(F.lit(head), F.coalesce("body", F.lit("(no sources retrieved)"))).alias("context"))


def referenced_context(references: DataFrame, passages: DataFrame, by: str) -> DataFrame:
    """by, context: a list of each question's references (by, reference_id, file_path), then its passages (by, pos, reference_id, content), tagged with their reference."""
    files = F.sort_array(F.collect_list(F.struct("reference_id", "file_path")))
    listed = references.groupBy(by).agg(F.array_join(F.transform(files, lambda r: F.concat(F.lit("["), r["reference_id"].cast("string"), F.lit("] "), r["file_path"])), "\n").alias("files"))
    own = F.sort_array(F.collect_list(F.struct("pos", "reference_id", "content")))
    told = passages.filter(F.coalesce("content", F.lit("")) != "").groupBy(by).agg(F.array_join(F.transform(own, lambda x: F.concat(F.lit("["), F.coalesce(x["reference_id"].cast("string"), F.lit("")), F.lit("] "), x["content"])), "\n\n").alias("texts"))
    whole = F.concat(F.lit("-----Reference Document List-----\n"), "files", F.lit("\n\n-----Document Chunks-----\n"), F.coalesce("texts", F.lit("")))
    return listed.join(told, by, "left").select(by, whole.alias("context"))
