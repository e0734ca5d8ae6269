"""Readers and writers of the library's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PERSON = "struct<family:string,given:string>"
RECORD = (
    f"type string, authors array<{PERSON}>, editors array<{PERSON}>, year string, title string, container_title string, volume string, issue string, pages string, publisher string, doi string, "
    "abstract string, keywords array<string>, subjects array<string>, affiliations array<string>, source string, disambig string, year_flag string, date string, date_precision string, date_source string, date_flag string"
)


_MANIFEST = "map<string,struct<" + ",".join(":".join(f.split(" ", 1)) for f in RECORD.split(", ")) + ">>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of file name to record as rows; values that are no records are left out, a bad file has no rows."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", _MANIFEST)).alias("filename", "r"))
    return entries.filter("r is not null").select("filename", "r.*")


def url_map(spark: SparkSession, path: str) -> DataFrame:
    """filename, url of a JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("filename", "url"))


def corpus_files(status: DataFrame, states: tuple[str, ...] = ("processed", "preprocessed")) -> DataFrame:
    """Base names of the files whose status is one of states."""
    return status.filter(F.lower("status").isin(*states)).select(F.element_at(F.split("file_path", r"[\\/]"), -1).alias("filename")).distinct()


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a log of JSON lines; torn lines are dropped, and only newlines end a line."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("lineSep", "\n").json(path)


_GRAPHML = "_id string, _source string, _target string, data array<struct<_VALUE:string,_key:string>>"


def graphml(spark: SparkSession, path: str, tag: str, keys: dict[str, str]) -> DataFrame:
    """Nodes or edges of a GraphML file: ids and the attributes in keys (key id to name, with ``:double`` or ``:long`` for numbers; bad ones are 1.0 and 0)."""
    rows = spark.read.format("xml").option("rowTag", tag).schema(_GRAPHML).load(path)
    out: list[Column] = []
    for key, spec in keys.items():
        name, _, kind = spec.partition(":")
        found = F.try_element_at(F.transform(F.filter("data", _is(key)), lambda d: d["_VALUE"]), F.lit(1))
        out.append((F.coalesce(found.try_cast("double"), F.lit(1.0)) if kind == "double" else F.coalesce(found.try_cast("long"), F.lit(0)) if kind == "long" else found).alias(name))
    ends = [F.col("_id").alias("id")] if tag == "node" else [F.col("_source").alias("src"), F.col("_target").alias("dst")]
    return rows.select(*ends, *out)


def _is(key: str):
    return lambda d: d["_key"] == key


def write_listing(papers: DataFrame, path: str) -> None:
    """A listing as CSV with a header, lists joined by ``; ``."""
    flat = [F.array_join(f.name, "; ").alias(f.name) if f.dataType.simpleString() == "array<string>" else F.col(f.name) for f in papers.schema]
    papers.select(*flat).write.option("header", True).csv(path)


#: Entry types of BibTeX: fixed values.
BIBTEX = {"article": "article", "book": "book", "chapter": "incollection", "report": "techreport", "thesis": "phdthesis"}


def bibtex(papers: DataFrame) -> DataFrame:
    """Each paper as a BibTeX entry in column value; empty fields are left out, special characters escaped."""
    kinds = F.create_map(*[F.lit(x) for pair in BIBTEX.items() for x in pair])
    escape = lambda c: F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
    named = [("author", "author"), ("title", "title"), ("journal", "container_title"), ("year", "year"), ("doi", "doi")]
    fields = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), escape(F.col(c)), F.lit("}"))) for n, c in named if c in papers.columns]
    key = F.regexp_replace(F.regexp_replace("filename", r"\.pdf$", ""), "[^A-Za-z0-9_-]", "")
    head = F.concat(F.lit("@"), F.coalesce(F.try_element_at(kinds, F.lower("type")), F.lit("misc")), F.lit("{"), key, F.lit(",\n"))
    return papers.select(F.concat(head, F.concat_ws(",\n", *fields), F.lit("\n}\n")).alias("value"))


def copy_verified(df: DataFrame, path: str, *partition_by: str) -> int:
    """Write a table and count what can be read back; raises if a row is missing."""
    df.write.partitionBy(*partition_by).parquet(path)
    written, wanted = df.sparkSession.read.parquet(path).count(), df.count()
    if written != wanted:
        raise OSError(f"{written} of {wanted} rows at {path}")
    return written
