"""Structure-aware chunking (C1, C3, C5-C10, C12-C14, C16, fixed chunks of C18, A26).

Page furniture is found and cut by joins over exploded lines; what remains of each
document is sectioned and packed by a small sequential fold, a document a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.headers import EMBEDDED, PARTING, SOFT, header, let, longest_first, opening_title
from folioscope.functions.sentences import sentences

#: Titles of sections; those in EXCLUDED are left out of the chunks. Fixed values.
SECTIONS = frozenset([
    "abstract", "introduction", "background", "related work", "literature review", "theoretical framework", "theory",
    "methods", "method", "methodology", "materials and methods", "experimental setup", "experimental design",
    "research methods", "experiment", "experiments", "results", "findings", "discussion", "general discussion",
    "conclusion", "conclusions", "concluding remarks", "summary", "summary and conclusions", "limitations",
    "future work", "future directions", "implications", "practical implications", "theoretical implications",
    "acknowledgements", "acknowledgments", "acknowledgement", "acknowledgment", "references", "bibliography",
    "works cited", "literature cited", "appendix", "appendices", "supplementary", "supplementary materials",
    "supplementary material", "supporting information",
])
EXCLUDED = frozenset(["references", "bibliography", "works cited", "literature cited", "acknowledgements", "acknowledgments", "acknowledgement", "acknowledgment"])
CORE = frozenset(["abstract", "introduction", "background", "methods", "method", "results", "discussion", "conclusion", "conclusions", "references"])
_NUMBERED = re.compile(r"^(?:\d+(?:\.\d+)*\.?|[IVX]+\.)\s+")
_CAPTION = re.compile(r"^(?:figure|fig\.|table|plate|chart|scheme)\s+\d", re.IGNORECASE)
#: Names of months, and words of running heads.
_MONTHS = "jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december"
_HEAD_WORDS = r"journal|vol\.?|volume|issue|copyright|permissions|sagepub|science direct|sciencedirect|language and speech|cognition|omega|omego"
_PAGE_NUMBER = r"(?i)^(\d+|[ivxlcdm]+)\.?\s*$"


def strip_furniture(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text without running heads and feet: lines at the edges of pages that look like furniture and recur in the document.

    Texts without form feeds stay as they are. A page's lines are cut down to those from the first to the last that is neither
    blank, a page number, nor such a line.
    """
    plain = docs.filter(~F.contains(F.coalesce(text, F.lit("")), F.lit("\f"))).select(key, text)
    pages = docs.filter(F.contains(text, F.lit("\f"))).select(key, F.posexplode(F.split(text, r"\s*\f\s*")).alias("page", "body")).filter(F.trim("body") != "")
    lines = pages.select(key, "page", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    flat = F.trim(F.regexp_replace("line", r"\s+", " "))
    norm = F.lower(F.regexp_replace(F.regexp_replace(flat, r"(?i)^(\d+|[ivxlcdm]+)\.?\s+", ""), r"\s+\d+\s*$", ""))
    words = F.regexp_count(flat, F.lit("[A-Za-z]+"))
    shouted = F.size(F.filter(F.regexp_extract_all(flat, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: w == F.upper(w)))
    like = flat.rlike(_PAGE_NUMBER) | (~norm.isin(*sorted(SECTIONS)) & (flat.rlike(rf"(?i)\b({_MONTHS})\b") | flat.rlike(r"(?i)\b(doi:|https?://|www\.)") | flat.rlike(rf"(?i)\b({_HEAD_WORDS})\b") | (flat.rlike(r"^\d") & (words <= 12)) | ((words > 0) & (shouted >= 0.6 * words))))
    seen = lines.withColumns({"norm": norm, "number": flat.rlike(_PAGE_NUMBER), "blank": flat == "", "like": like & (norm != "")})
    own = Window.partitionBy(key, "page")
    edge = seen.filter("not blank").withColumn("top", F.row_number().over(own.orderBy("pos"))).withColumn("foot", F.row_number().over(own.orderBy(F.desc("pos"))))
    times = F.sum((F.col("top") <= 3).cast("int") + (F.col("foot") <= 3).cast("int"))
    removable = edge.filter("like").groupBy(key, "norm").agg(times.alias("n")).filter("n >= 2").select(key, "norm", F.lit(True).alias("runs"))
    marked = seen.join(removable, [key, "norm"], "left").withColumn("goes", F.col("blank") | F.col("number") | F.coalesce("runs", F.lit(False)))
    ranged = marked.withColumn("lo", F.min(F.when(~F.col("goes"), F.col("pos"))).over(own)).withColumn("hi", F.max(F.when(~F.col("goes"), F.col("pos"))).over(own))
    kept = ranged.filter(F.col("pos").between(F.col("lo"), F.col("hi")))
    joined = kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "pos", "line"))), lambda x: x["line"]), "\n").alias(text))
    return plain.unionByName(pages.select(key).distinct().join(joined, key, "left").select(key, F.coalesce(text, F.lit("")).alias(text)))


@dataclass(frozen=True)
class Sizes:
    longest: int = 640
    least: int = 192
    overlap: int = 51


_TITLES = longest_first([*SECTIONS, *SOFT])


def is_excluded(title: str) -> bool:
    return _NUMBERED.sub("", title).lower().rstrip(".:").strip() in EXCLUDED


def keeps_excluded(parts: list[tuple[int, str, str]], count: Callable[[str], int]) -> bool:
    """Whether leaving out excluded sections would drop most of a long text: false headers (a contents page, running heads)."""
    tokens, sections = {True: 0, False: 0}, {True: set(), False: set()}
    for section, title, body in parts:
        out = is_excluded(title)
        tokens[out] += count(body)
        sections[out].add(section)
    kept, out = tokens[False], tokens[True]
    if not out:
        return False
    share = out / (kept + out)
    return (kept == 0 and out >= 1000) or (share >= 0.8 and kept <= 2000 and out >= 10000) or (share >= 0.95 and out >= 5000) or (len(sections[False]) <= 1 and len(sections[True]) >= 2 and share >= 0.7 and out >= 5000)


Line = tuple[str, str, str]


def paragraphs(lines: list[Line], count: Callable[[str], int]) -> Iterator[tuple[int, str, str]]:
    """(section, its title, paragraph) of a text's lines, excluded sections left out unless they are most of it."""
    parts = list(_sections(_paragraphs(lines)))
    yield from parts if keeps_excluded(parts, count) else (p for p in parts if not is_excluded(p[1]))


def _paragraphs(lines: list[Line]) -> Iterator[tuple[int, str, str]]:
    """(section, its title, paragraph) of lines (line, kind, title as ``header`` tells them); blank lines and hard headers part paragraphs."""
    section, title, held = 0, "", []

    def flush() -> Iterator[tuple[int, str, str]]:
        if held:
            yield section, title, " ".join(held)
        held.clear()

    for line, kind, name in lines:
        line = line.strip()
        if kind == "hard":
            yield from flush()
            section, title = section + 1, name
            line = line[len(name) :].strip(PARTING)
        elif not line:
            yield from flush()
        if line:
            held.append(line)
    yield from flush()


def _sections(parts: Iterator[tuple[int, str, str]]) -> Iterator[tuple[int, str, str]]:
    """parts with sections begun by titles at the start of paragraphs, too; titles of parts of a section stay, on a line of their own."""
    more, under, title = 0, 0, ""
    for section, name, body in parts:
        if section != under:
            under, title = section, name
        found = opening_title(body, _TITLES)
        if found and _NUMBERED.sub("", found[0]).rstrip(".:").lower() in SECTIONS:
            more, title, body = more + 1, found[0], found[1]
        elif found:
            body = "\n".join(found)
        yield section + more, title, body


def pack(lines: list[Line], count: Callable[[str], int], sizes: Sizes) -> list[dict]:
    """Chunks of one text, given as its lines: paragraphs of a section together up to the longest size, long ones by sentence, then by word; captions alone; small tails joined; whole sentences of the chunk before as overlap."""
    out: list[dict] = []

    def emit(section: int, title: str, body: str, hard: bool = False, caption: bool = False) -> None:
        before = out[-1] if out else None
        n = count(body)
        joins = before and not caption and not hard and not before["caption"] and not before["hard"] and before["section"] == section and (n < sizes.least or before["n"] < sizes.least)
        if joins and count(before["body"] + "\n\n" + body) <= sizes.longest:
            before["body"] += "\n\n" + body
            before["n"] = count(before["body"])
        else:
            out.append({"section": section, "title": title, "body": body, "n": n, "hard": hard, "caption": caption})

    def split(section: int, title: str, body: str) -> None:
        held = ""
        for s in sentences(body):
            if count(s) > sizes.longest:
                if held:
                    emit(section, title, held)
                held, words = "", s.split()
                for i in range(0, len(words), sizes.longest):
                    emit(section, title, " ".join(words[i : i + sizes.longest]), hard=True)
            elif held and count(held + " " + s) > sizes.longest:
                emit(section, title, held)
                held = s
            else:
                held = f"{held} {s}".strip()
        if held:
            emit(section, title, held)

    held: tuple[int, str, str] | None = None
    for section, title, body in paragraphs(lines, count):
        caption = bool(_CAPTION.match(body))
        if held and not caption and held[0] == section and count(body) <= sizes.longest and count(held[2] + "\n\n" + body) <= sizes.longest:
            held = (section, title, held[2] + "\n\n" + body)
            continue
        if held:
            emit(*held)
        held = None
        if caption and count(body) <= sizes.longest:
            emit(section, title, body, caption=True)
        elif count(body) > sizes.longest:
            split(section, title, body)
        else:
            held = (section, title, body)
    if held:
        emit(*held)
    whole = "\n".join(line for line, _, _ in lines)
    if not out and whole.strip():
        split(0, "", whole)
    return out


def overlap_before(chunk: dict, before: dict | None, count: Callable[[str], int], sizes: Sizes) -> str:
    if not before or before["section"] != chunk["section"] or sizes.overlap <= 0:
        return ""
    taken: list[str] = []
    for s in reversed(sentences(before["body"])):
        if count(" ".join([s, *taken])) > sizes.overlap:
            break
        taken.insert(0, s)
    lead = " ".join(taken) or " ".join(before["body"].split()[-sizes.overlap :])
    return lead if count(f"{lead} {chunk['body']}") <= sizes.longest + sizes.overlap else ""


def lines_of(text: Column) -> Column:
    """A text's lines as array<struct<line, kind, title>>; page breaks are blank lines, numbered headers behind a sentence begin lines of their own."""
    whole = F.replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), EMBEDDED, "\n"), F.lit("\f"), F.lit("\n\n"))

    def told(line: Column) -> Column:
        return let(header(line, SECTIONS), lambda h: F.struct(line.alias("line"), h["kind"].alias("kind"), h["title"].alias("title")))

    return F.transform(F.split(whole, "\n"), told)


def words(text: str) -> int:
    return len(text.split())


_CHUNKS = "chunk_order_index int, section_title string, section_index int, content string, raw_text string, tokens int, raw_tokens int, overlap_prev_tokens int, is_hard_split boolean"


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes: Sizes = Sizes(), count: Callable[[str], int] = words) -> DataFrame:
    """Chunks of every document: key and the fields of a chunk, one row each. Null and blank texts have none."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *(f.split()[0] for f in _CHUNKS.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["_key"], batch["_lines"], strict=True):
                chunks = pack([(x["line"], x["kind"], x["title"]) for x in t], count, sizes)
                for i, c in enumerate(chunks):
                    lead = overlap_before(c, chunks[i - 1] if i else None, count, sizes)
                    whole = f"{lead} {c['body']}" if lead else c["body"]
                    rows.append((k, i, c["title"], c["section"], whole, c["body"], count(whole), c["n"], count(lead), c["hard"]))
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(key).alias("_key"), lines_of(F.col(text)).alias("_lines")).mapInPandas(run, f"`{key}` {kind}, {_CHUNKS}")


def page_starts(chunks: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """chunks with page_start: the first page that holds the chunk's first 90, else 45, characters; null without form feeds."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    pages = docs.filter(F.contains(text, F.lit("\f"))).select(key, F.transform(F.split(text, "\f"), flat).alias("_pages"))
    at = lambda n: F.array_position(F.transform("_pages", lambda p: F.contains(p, F.trim(F.substring(flat(F.col("raw_text")), 1, n)))), True)
    return chunks.join(pages, key, "left").withColumn("page_start", F.coalesce(F.nullif(at(90), F.lit(0)), F.nullif(at(45), F.lit(0)))).drop("_pages")


def route(text: Column, min_chapters: int = 3, min_imrad: int = 3, page_threshold: int = 50) -> Column:
    """``book`` or ``paper``: a contents page or chapters, then the sections of a paper, then the number of pages decide."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n\f]"), lambda x: F.trim(x))
    chapters = F.size(F.array_distinct(F.filter(F.transform(lines, lambda x: F.lower(x)), lambda x: x.rlike(r"^(chapter|part)\s+(\d+|[ivx]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\b"))))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.lower(F.regexp_replace(x, r"^(\d+(\.\d+)*\.?|[IVX]+\.)\s+", "")), r"[.:]+$", ""))
    core = F.size(F.array_intersect(F.array_distinct(bare), F.array(*[F.lit(x) for x in sorted(CORE)])))
    contents = F.exists(lines, lambda x: F.lower(x).isin("contents", "table of contents"))
    n_pages = F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit(""))) + 1
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "paper").when(contents | (chapters >= min_chapters), "book").when(core >= min_imrad, "paper").when(n_pages >= page_threshold, "book").otherwise("paper")


def evaluate(chunks: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """One row of measures over chunks: number, mean, upper median, least and most tokens, shares out of range, hard splits, sections."""
    n = F.col("raw_tokens")
    part = lambda c: F.round(100 * F.avg(c.cast("int")), 2)
    return chunks.agg(F.count("*").alias("n"), F.round(F.avg(n), 2).alias("mean"), F.expr("percentile_disc(0.5) within group (order by raw_tokens desc)").alias("median"), F.min(n).alias("least"), F.max(n).alias("most"), part(n < sizes.least).alias("pct_below"), part(n > sizes.longest).alias("pct_above"), F.sum(F.col("is_hard_split").cast("long")).alias("hard_splits"), F.countDistinct("section_title").alias("sections"))
