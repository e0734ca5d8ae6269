"""Sources, sinks, citations in answers, and quotes on pages."""

import json

from pyspark.sql import functions as F

from folioscope.functions import answers
from folioscope.sources import files


def test_manifest_and_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a.pdf": {"title": "A", "year": "2019", "authors": [{"family": "X", "given": "Y"}]}, "b.pdf": None}))
    got = files.manifest(spark, str(tmp_path / "m.json")).collect()
    assert [(r.filename, r.title, r.authors[0].family) for r in got] == [("a.pdf", "A", "X")]
    (tmp_path / "bad.json").write_text("{oops")
    assert files.manifest(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "log.jsonl").write_text('{"f": "a", "size": 1}\n{"f": "b", "si')
    assert [(r.f, r.size) for r in files.json_lines(spark, str(tmp_path / "log.jsonl"), "f string, size long").collect()] == [("a", 1)]


def test_graphml(spark, tmp_path):
    xml = '<graphml><graph><node id="n1"><data key="d0">Concept</data></node><node id="n2"/><edge source="n1" target="n2"><data key="w">2.5</data></edge><edge source="n2" target="n1"><data key="w">x</data></edge></graph></graphml>'
    (tmp_path / "g.xml").write_text(xml)
    assert {(r.id, r.kind) for r in files.graphml(spark, str(tmp_path / "g.xml"), "node", {"d0": "kind"}).collect()} == {("n1", "Concept"), ("n2", None)}
    assert {(r.src, r.dst, r.weight) for r in files.graphml(spark, str(tmp_path / "g.xml"), "edge", {"w": "weight:double"}).collect()} == {("n1", "n2", 2.5), ("n2", "n1", 1.0)}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("A_2019.pdf", "article", "T & U", "2019", ["x", "y"])], "filename string, type string, title string, year string, keywords array<string>")
    files.write_listing(d, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().keywords == "x; y"
    assert files.bibtex(d).first().value == "@article{A_2019,\n  title = {T \\& U},\n  year = {2019}\n}\n"
    assert files.copy_verified(d, str(tmp_path / "copy"), "type") == 1


def test_render(spark):
    a = spark.createDataFrame([(1, "Humor helps. [1][2] Others disagree [9].\n\n### References\n* [1] x"), (2, "None.")], "answer_id int, answer string")
    r = spark.createDataFrame([(1, 1, "(West, 2019)", "West"), (1, 2, "(Abel, 2001)", "Abel"), (1, 3, "(No, 1)", "No")], "answer_id int, n int, intext string, apa string")
    got = {x.answer_id: (x.text, x.references_list) for x in answers.render(a, r).collect()}
    assert got[1] == ("Humor helps (Abel, 2001; West, 2019). Others disagree [9].", ["Abel", "West"])
    assert got[2] == ("None.", None)


def test_locate(spark):
    pages = spark.createDataFrame([("d", 1, "nothing to see here at all"), ("d", 2, "The quick brown-fox, jumps over the lazy dog again"), ("d", 3, "quick brownfox jumps")], "doc string, page int, t string").select("doc", "page", answers.norm_words(F.col("t")).alias("words"))
    quotes = spark.createDataFrame([(1, "d", "quick  brown-fox jumps OVER the"), (2, "d", "lazy dog"), (3, "d", "quite absent words")], "quote_id int, doc string, quote string")
    assert [(r.quote_id, r.page, r.at, r.n_words) for r in answers.locate(quotes, pages).collect()] == [(1, 2, 1, 5)]
    text = spark.range(1).select(answers.valid_excerpt(F.lit("a  b c d e"), F.lit("x a b\nc d e y")).alias("v"), answers.cited_ids(F.lit("a [1, 2] b [2;3]")).alias("c")).first()
    assert text.v and text.c == [1, 2, 3]


def test_rewrite_sorts_and_keeps_unknown():
    labels = {"1": "Smith, 2020", "2": "adams, 2019", "3": "Brown et al., 2018"}
    assert answers.rewrite("So it is [1, 2].", labels) == "So it is (adams, 2019; Smith, 2020)."
    assert answers.rewrite("So ([1], [3]) and [1][2]", labels) == "So (Brown et al., 2018; Smith, 2020) and (adams, 2019; Smith, 2020)"
    assert answers.rewrite("Held [1, 9] here", labels) == "Held [1, 9] here"
    assert answers.rewrite("Held [1, 9] here", labels, drop_unknown=True) == "Held (Smith, 2020) here"


def test_the_last_list_of_references_goes(spark):
    a = spark.createDataFrame([("One.\n## References\nTwo.\n**References**\n[1] x",), ("No list.  ",)], "a string")
    assert [r[0] for r in a.select(answers.without_references(F.col("a"))).collect()] == ["One.\n## References\nTwo.", "No list."]


def test_rename_chains_end_or_are_null(spark):
    from folioscope.operators import catalogue

    renames = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), *((f"n{i}", f"n{i + 1}") for i in range(40))], "old string, new string")
    papers = spark.createDataFrame([("a",), ("c",), ("x",), ("n0",), ("n39",)], "name string")
    assert {r.name: r.current for r in catalogue.rename_chain(papers, renames).collect()} == {"a": "c", "c": "c", "x": None, "n0": "n40", "n39": "n40"}


def test_median_and_empty_query(spark):
    from folioscope.operators import chunking, passages

    chunks = spark.createDataFrame([(n, False, "s") for n in (1, 2, 3, 4)], "raw_tokens int, is_hard_split boolean, section_title string")
    assert chunking.evaluate(chunks).first().median == 3
    assert passages.bm25(spark.createDataFrame([(1, "a text")], "id int, content string"), "what is the", ["id"]).count() == 0
