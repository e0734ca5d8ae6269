"""Sentences, furniture, chunks and the router on literal texts."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import headers
from folioscope.functions.sentences import sentences
from folioscope.operators import chunking
from folioscope.operators.chunking import Sizes

SMALL = Sizes(15, 4, 3)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One here. Two there! Three?", ["One here.", "Two there!", "Three?"]), ("See Fig. 3 and Smith et al. (2014) for more. Done.", ["See Fig. 3 and Smith et al. (2014) for more.", "Done."]),
        ("By J. Smith, e.g. This one.", ["By J. Smith, e.g. This one."]), ("", []), (None, []), ("no mark at all", ["no mark at all"]), ("It was 3. 14 came. Next.", ["It was 3. 14 came.", "Next."]),
    ],
)
def test_sentences(text, want):
    assert sentences(text) == want


def body(n, tag="w"):
    return " ".join(f"{tag}{i}" for i in range(n))


def rows(spark, text, sizes=SMALL):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return chunking.chunk_documents(docs, sizes=sizes).orderBy("chunk_order_index").collect()


def test_sections_and_exclusion(spark):
    text = f"Abstract\n{body(8)}\n\n1. Introduction\n{body(9, 'i')}\n\n2.1 Participants\n{body(5, 'p')}\n\nReferences\n{body(30, 'r')}"
    got = rows(spark, text)
    assert [r.section_title for r in got] == ["Abstract", "1. Introduction", "1. Introduction"]  # 2.1 is no section of its own
    assert all("r0" not in r.content for r in got) and "p4" in got[2].raw_text


def test_sizes_and_overlap(spark):
    text = "\n\n".join(" ".join(f"Word{i}a word word end." for i in range(k, k + 6)) for k in range(0, 24, 6))
    got = rows(spark, text)
    assert all(r.raw_tokens <= 15 and r.tokens <= 18 for r in got)
    assert " ".join(r.raw_text for r in got).split() == text.split()
    assert any(r.overlap_prev_tokens for r in got[1:])
    long = rows(spark, body(40))
    assert [r.raw_tokens for r in long] == [15, 15, 10] and all(r.is_hard_split for r in long)


def test_captions_alone_and_blank(spark):
    got = rows(spark, f"{body(5)}\n\nFigure 1 shows it.\n\n{body(5, 'v')}")
    assert [r.raw_text.split()[0] for r in got] == ["w0", "Figure", "v0"]
    assert rows(spark, None) == [] and rows(spark, " \n ") == []


def test_furniture_and_pages(spark):
    pages = "\f".join(f"JOURNAL OF TESTS {n}\nText of page {n} begins here with words that are its own p{n}.\n{n}" for n in (1, 2, 3))
    docs = spark.createDataFrame([(1, pages), (2, "no pages"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in chunking.strip_furniture(docs).collect()}
    assert got == {1: "\n".join(f"Text of page {n} begins here with words that are its own p{n}." for n in (1, 2, 3)), 2: "no pages", 3: None}
    chunks = chunking.chunk_documents(docs, sizes=Sizes(14, 1, 0))
    assert sorted({r.page_start for r in chunking.page_starts(chunks, docs).filter("doc_id = 1").collect()} - {None}) == [1, 2, 3]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Abstract\nx\nIntroduction\nx\nMethods\nx\nResults\nx", "paper"), ("Contents\nOne 1\nTwo 9", "book"), ("Chapter 1\nx\nChapter 2\nx\nChapter 3\nx\nChapter 4", "book"),
        ("\f".join(["x"] * 60), "book"), ("Abstract\nIntroduction\nMethods\n" + "\f".join(["x"] * 60), "paper"), ("I. Introduction\nII. Methods\nIII. Results\nIV. Discussion", "paper"), ("", "paper"), (None, "paper"),
    ],
)
def test_router(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string")
    assert d.select(chunking.route(F.col("t")).alias("k")).first().k == want


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("1. Introduction", ("hard", "1. Introduction")), ("METHODS", ("hard", "METHODS")), ("Participants", ("soft", "Participants")), ("participants.", ("none", "")), ("72 Author Name", ("none", "")), ("v. August", ("none", "")),
        ("3.2. Feature Extraction", ("hard", "3.2. Feature Extraction")), ("3.2.1. Feature Extraction", ("soft", "3.2.1. Feature Extraction")), ("2.1 Participants", ("soft", "2.1 Participants")), ("1.1. Word Decoding    3", ("none", "")),
        ("IV. Results and more", ("hard", "IV. Results and more")), ("2. A sentence that is one.", ("none", "")), ("Chapter 3: A Title", ("hard", "Chapter 3: A Title")), ("1. Introduction " + "word " * 40, ("hard", "1. Introduction")),
        ("2. Participants " + "word " * 40, ("soft", "2. Participants")), ("chapter two. " + "word " * 40, ("hard", "chapter two.")), ("Results " + "word " * 40, ("none", "")), ("", ("none", "")), (None, ("none", "")), ("References:", ("hard", "References:")),
    ],
)
def test_header_kinds(spark, line, want):
    d = spark.createDataFrame([(line,)], "t string").select(headers.header(F.col("t"), chunking.SECTIONS).alias("h")).first().h
    assert (d.kind, d.title) == want


def test_headings_within_paragraphs_and_sentences(spark):
    text = f"Abstract It sums up the study.\n\nResearch Methods We did {body(6)}\n\nParticipants\nTen people {body(4, 'p')}\n\n3.1.1 Participants 750 people did {body(5, 'q')}.  2. Results The rest follows {body(40, 'r')}"
    got = rows(spark, text, Sizes(60, 2, 0))
    assert [r.section_title for r in got] == ["Abstract", "Research Methods", "2. Results"]
    assert "3.1.1 Participants" in got[1].raw_text and "Ten people" in got[1].raw_text and got[0].raw_text == "It sums up the study."
    assert headers.opening_title("RESULTS These are", ["results"]) == ("RESULTS", "These are") and headers.opening_title("Results. These", ["results"]) is None and headers.opening_title("Results show it", ["results"]) is None


def test_running_heads_of_publishers(spark):
    pages = "\f".join(f"Language and Speech 56 {n}\nText of page {n} is here with its own p{n}." for n in (1, 2, 3))
    got = chunking.strip_furniture(spark.createDataFrame([(1, pages)], "doc_id long, text string")).first().text
    assert "Language" not in got and "p3." in got


def test_marks_alone_ask_for_the_next_sentence(monkeypatch):
    """Words without a mark at their end cost no match."""
    from folioscope.functions import sentences as module

    asked = []
    monkeypatch.setattr(module.re, "match", lambda *a: asked.append(a))
    assert sentences("word " * 500 + "end. Next") == ["word " * 500 + "end. Next"] and len(asked) == 1
