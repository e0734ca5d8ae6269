"""Passages of uploads, texts without marks, names and verdicts on literal rows."""

from pyspark.sql import functions as F

from folioscope.functions import answers, plaintext
from folioscope.operators import evidence, filters, search, trends, uploads


def chosen(spark, rows, *limits):
    d = spark.createDataFrame(rows, "paper string, idx int, tokens int, score double")
    got = uploads.select_passages(d, *limits).collect()
    return sorted((r.paper, r.idx) for r in got), {r.strategy for r in got}


def test_passages_whole_ranked_and_topped_up(spark):
    rows = [("a", i, 10, float(i % 3)) for i in range(6)] + [("b", i, 10, 0.0) for i in range(4)]
    assert chosen(spark, rows, 100) == (sorted((p, i) for p, i, _, _ in rows), {"full"})
    # floors: a 2 and 5 (best), b 0 and 1; then a 1 and 4 by score; budget spent before each below 55
    assert chosen(spark, rows, 55, 0) == ([("a", 1), ("a", 2), ("a", 4), ("a", 5), ("b", 0), ("b", 1)], {"ranked"})
    assert chosen(spark, rows, 15, 0) == ([("a", 2), ("a", 5)], {"ranked"})  # what is spent is looked at before each
    none = [(p, i, t, 0.0) for p, i, t, _ in rows]
    assert chosen(spark, none, 55, 0)[0] == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]
    few = [(p, i, t, 1.0 if (p, i) == ("b", 3) else 0.0) for p, i, t, _ in rows]
    assert chosen(spark, few, 99, 80)[0] == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 5), ("b", 0), ("b", 3)]
    assert chosen(spark, []) == ([], set())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_marks_and_formulas(spark):
    text = lambda t: one(spark, plaintext.plain_markdown(F.lit(t)))
    assert text("***a*** __b__ _c_ `d` \\*e") == "a b c d *e" and text("# H\n\n\n\nx") == "H\n\nx" and text("[a](b) ![c](d)") == "a c"
    assert text("- one\n- two\n***\nend") == "• one\n• two\n\nend"
    assert one(spark, plaintext.plain_math(F.lit("5% \\(x%\\) and $a%$"))) == "5% $x\\%$ and $a\\%$"
    assert one(spark, plaintext.plain_math(F.lit("no formula, 5%"))) == "no formula, 5%" and one(spark, plaintext.plain_math(F.lit(None).cast("string"))) is None


def test_decoding_and_folding(spark):
    assert one(spark, evidence.decoded(F.lit("SpÃ¼ler"))) == "Spüler" and one(spark, evidence.decoded(F.lit("Spüler"))) is None and one(spark, evidence.decoded(F.lit("日本"))) is None
    assert one(spark, evidence.folded(F.lit("Strøm-Ößle"))) == "stromosle" and one(spark, evidence.ascii_name(F.lit("Ünal O'Hara-Sá 3"))) == "UnalO'Hara-Sa"


def test_citations_move_but_not_into_quotations():
    assert answers.cited_inside("It is local. [2][3] Its end") == "It is local [2][3]. Its end"
    assert answers.cited_inside('He said "so." [1] Then') == 'He said "so." [1] Then' and answers.cited_inside("By Moss et al. [2] and on") == "By Moss et al. [2] and on"
    assert answers.plainly_cited("x ((see (A, 2020))) y (B, 2019). (B, 2019) z") == "x (A, 2020) y (B, 2019) z"


def test_snippet_of_the_next_chunk_with_text(spark):
    rows = [("f", "early", 0.5, 1), ("f", " ", 0.9, 2), ("f", "", 0.3, 3), ("f", " later ", 0.1, 4), ("f", "last", 0.2, 5), ("g", " ", 0.8, 6), ("", "x", 1.0, 7)]
    got = {r.file_path: (r.score, r.n_chunks, r.snippet, r["rank"]) for r in search.rank_papers(spark.createDataFrame(rows, "file_path string, content string, score double, pos int")).collect()}
    assert got == {"f": (0.9, 5, "later", 1), "g": (0.8, 1, "", 2)}


def test_years_of_records(spark):
    rows = [("2019", None, None), ("n.d.", "2003-04", None), (None, "x", "1999-12-01"), ("", None, "99"), ("1700", None, "2101")]
    d = spark.createDataFrame(rows, "year string, issued_year string, date string")
    assert [r.y for r in d.select(trends.year_of(d).alias("y")).collect()] == [2019, 2003, 1999, None, None]


def test_merged_filters_and_lens(spark):
    row = spark.range(1).select(*(c.alias(n) for n, c in filters.merged({"authors": F.array(F.lit("Zhang"), F.lit("Moss"))}, {"authors": F.array(F.lit("zhang, Kai"), F.lit("Reed,")), "year": F.lit(3)}).items())).first()
    assert row.authors == ["Moss", "zhang, Kai", "Reed,"] and row.year == 3
    papers = spark.createDataFrame([("a.pdf", "A Title", "J", ["Humor"], None)], "filename string, title string, container_title string, keywords array<string>, subjects array<string>")
    assert uploads.lens(papers, keyword="x| HUMOR").first().seen and uploads.lens(papers).first().seen is None and not uploads.lens(papers, journal="q").first().seen
