"""Citation strings as column expressions (T20, T30-T35, T39, P3, T14), and reference models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.normalise import clean_title
from folioscope.functions.texts import character


def initials(given: Column) -> Column:
    """``Jean-Paul M.`` to ``J.-P. M.``."""
    words = F.filter(F.split(F.trim(F.coalesce(given, F.lit(""))), r"\s+"), lambda w: w != "")
    lettered = lambda p: F.rlike(p, F.lit(r"^\p{L}"))
    one = lambda w: F.array_join(F.transform(F.filter(F.split(w, "-"), lettered), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), "-")
    return F.array_join(F.filter(F.transform(words, one), lambda i: i != ""), " ")


def person(p: Column) -> Column:
    i = initials(p["given"])
    return F.when(i == "", p["family"]).otherwise(F.concat(p["family"], F.lit(", "), i))


def author_list(authors: Column) -> Column:
    """Up to 20 names joined with an ampersand before the last; from 21 on the first 19, an ellipsis and the last."""
    names = F.transform(authors, person)
    n = F.size(names)
    few = F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.when(n > 1, F.concat(F.lit(", & "), F.element_at(names, -1))).otherwise(F.lit("")))
    many = F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", … "), F.element_at(names, -1))
    return F.when(n == 0, F.lit("")).when(n <= 20, few).otherwise(many)


def in_text(authors: Column, year: Column, title: Column) -> Column:
    """``(Family & Family, year)``: one, two, or the first and et al.; without authors the title's first four words; without year n.d."""
    family = F.transform(authors, lambda a: a["family"])
    n = F.size(family)
    lead = F.array_join(F.slice(F.split(F.trim(title), r"\s+"), 1, 4), " ")
    who = F.when(n == 0, lead).when(n == 1, family[0]).when(n == 2, F.concat(family[0], F.lit(" & "), family[1])).otherwise(F.concat(family[0], F.lit(" et al.")))
    return F.concat(F.lit("("), who, F.lit(", "), F.coalesce(F.nullif(year, F.lit("")), F.lit("n.d.")), F.lit(")"))


def apa_article(authors: Column, year: Column, title: Column, journal: Column, volume: Column, issue: Column, pages: Column, doi: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    source = F.concat_ws(", ", F.nullif(F.when(blank(journal) != "", F.concat(F.lit("*"), journal, F.lit("*"))), F.lit("**")), F.when(blank(volume) != "", F.concat(F.lit("*"), volume, F.lit("*"), F.when(blank(issue) != "", F.concat(F.lit("("), issue, F.lit(")"))).otherwise(F.lit("")))), F.nullif(blank(pages), F.lit("")))
    parts = [F.nullif(author_list(authors), F.lit("")), F.concat(F.lit("("), F.coalesce(F.nullif(year, F.lit("")), F.lit("n.d.")), F.lit(").")), F.concat(F.regexp_replace(blank(title), r"\.+$", ""), F.lit(".")), F.nullif(F.concat(source, F.when(source != "", F.lit(".")).otherwise(F.lit(""))), F.lit("")), F.when(blank(doi) != "", F.concat(F.lit("https://doi.org/"), normalize_doi(doi)))]
    return F.concat_ws(" ", *parts)


def normalize_doi(doi: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(doi), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""), r"[ .,;)]+$", "")


def pages_label(pages: Column) -> Column:
    """``p. 3`` or ``pp. 3, 12``, distinct and in order; nothing for none."""
    own = F.sort_array(F.array_distinct(pages))
    return F.when(F.size(own) == 0, F.lit("")).otherwise(F.concat(F.when(F.size(own) == 1, F.lit("p. ")).otherwise(F.lit("pp. ")), F.array_join(own.cast("array<string>"), ", ")))


def letters(records: DataFrame, label: str, title: str, name: str, stored: str | None = None, most: int | None = 26) -> DataFrame:
    """letter of records of equal label: the stored ones where all are there and differ, else a, b, … by title and name; blank where a label is alone, and behind the first ``most`` letters if that is given."""
    own = Window.partitionBy(F.lower(label))
    rank = F.row_number().over(own.orderBy(F.lower(title), F.lower(name)))
    several = F.count("*").over(own) > 1
    held = F.coalesce(F.col(stored), F.lit("")) if stored else F.lit("")
    told_apart = F.size(F.collect_set(F.nullif(held, F.lit(""))).over(own)) == F.count("*").over(own)
    return records.withColumn("letter", F.when(~several, F.lit("")).when(told_apart, held).when(F.lit(True) if most is None else rank <= most, character(96 + rank)).otherwise(F.lit("")))


def editor_list(editors: Column) -> Column:
    """Editors, initials first: one, two with an ampersand, more with commas too."""
    names = F.transform(editors, lambda e: F.trim(F.concat_ws(" ", initials(e["given"]), e["family"])))
    n = F.size(names)
    first = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, names[0]).when(n == 2, F.concat(names[0], F.lit(" & "), names[1])).otherwise(F.concat(first, F.lit(", & "), F.element_at(names, -1)))


def tidy(c: Column) -> Column:
    """Runs of spaces and of full stops made one, no space before a full stop."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s+\.", "."), r"\.{2,}", "."))


#: What a citation needs of a record.
RECORD = "type string, authors array<struct<family:string,given:string>>, editors array<struct<family:string,given:string>>, year string, disambig string, etal boolean, title string, container_title string, volume string, issue string, pages string, publisher string, doi string"


def intext(r: Column) -> Column:
    """``Family & Family, 2019a`` of a RECORD: authors, else editors, else four words of the title."""
    year = F.concat(F.trim(_or(r["year"], "n.d.")), _or(r["disambig"], ""))
    families = lambda people: F.filter(F.transform(_people(people), lambda a: F.trim(F.coalesce(a["family"], F.lit("")))), lambda f: f != "")
    who = F.when(F.size(families(r["authors"])) > 0, families(r["authors"])).otherwise(families(r["editors"]))
    words = F.array_join(F.slice(F.split(F.trim(_or(r["title"], _or(r["container_title"], ""))), r"\s+"), 1, 4), " ")
    n = F.size(who)
    head = F.when(n == 0, words).when((n >= 3) | F.coalesce(r["etal"], F.lit(False)), F.concat(who[0], F.lit(" et al."))).when(n == 2, F.concat(who[0], F.lit(" & "), who[1])).otherwise(who[0])
    return F.when(head == "", year).otherwise(F.concat(head, F.lit(", "), year))


def _or(c: Column, other) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other) if isinstance(other, str) else other)


def _people(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<struct<family:string,given:string>>"))


def apa_parts(r: Column) -> dict[str, Column]:
    """What apa() puts together of a RECORD; select these first where there are many records, so that each is worked out once."""
    field = lambda name: F.trim(_or(r[name], ""))
    names = author_list(_people(r["authors"]))
    names = F.when((names != "") & F.coalesce(r["etal"], F.lit(False)), F.concat(names, F.lit(" et al. "))).when(names != "", F.concat(names, F.lit(" "))).otherwise("")
    editors = editor_list(_people(r["editors"]))
    label = F.when(F.size(_people(r["editors"])) == 1, " (Ed.), ").otherwise(" (Eds.), ")
    return {
        "lead": F.concat(names, F.lit("("), F.trim(_or(r["year"], "n.d.")), _or(r["disambig"], ""), F.lit(").")), "edited": F.when(editors != "", F.concat(editors, label)).otherwise(""),
        "title": F.regexp_replace(clean_title(r["title"]), r"\.+$", ""), "container": clean_title(r["container_title"]), "doi": normalize_doi(_or(r["doi"], "")),
        "style": F.lower(field("type")), **{name: field(name) for name in ("publisher", "pages", "volume", "issue")},
    }


def apa(p: dict[str, Column]) -> Column:
    """A reference in APA style of apa_parts(), italics in asterisks: a book, a chapter, or anything else as an article."""
    said = lambda before, c, after="": F.when(c != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    book = F.concat(said(" *", p["title"], "*."), said(" ", p["publisher"], "."))
    chapter = F.concat(said(" ", p["title"], "."), F.lit(" In "), p["edited"], said("*", p["container"], "*"), said(" (pp. ", p["pages"], ")"), F.lit("."), said(" ", p["publisher"], "."))
    inside = F.concat(said(" *", p["container"], "*"), said(", *", p["volume"], "*"), said("(", p["issue"], ")"), said(", ", p["pages"]), F.lit("."))
    article = F.concat(said(" ", p["title"], "."), F.when(p["container"] != "", inside).otherwise(said(" ", p["pages"], ".")))
    rest = F.when(p["style"] == "book", book).when(p["style"].isin("chapter", "book-chapter"), chapter).otherwise(article)
    return tidy(F.concat(F.rtrim(F.concat(p["lead"], rest)), said(" https://doi.org/", p["doi"])))


_NAMED = r"(?i)^([A-Za-z][A-Za-z'-]*)(?:_([A-Za-z][A-Za-z'-]*))?_(\d{4})([a-z])?\.pdf$"


def fallback(filename: Column) -> Column:
    """A RECORD read from a name like ``Moss_Etal_2011b.pdf`` or ``Reed_Hale_1999.pdf``; any other name is its title."""
    part = lambda i: F.regexp_extract(filename, _NAMED, i)
    named, second = part(3) != "", part(2)
    etal = named & (F.lower(second) == "etal")
    person_of = lambda c: F.struct(c.alias("family"), F.lit("").alias("given"))
    people = F.when(~named, _people(F.lit(None))).when((second != "") & ~etal, F.array(person_of(part(1)), person_of(second))).otherwise(F.array(person_of(part(1))))
    title = F.when(named, "").otherwise(F.trim(F.replace(F.regexp_replace(filename, r"(?i)\.pdf$", ""), F.lit("_"), F.lit(" "))))
    blank = {c: F.lit("") for c in ("container_title", "volume", "issue", "pages", "publisher", "doi")}
    fields = {"type": F.lit("other"), "authors": people, "editors": _people(F.lit(None)), "year": part(3), "disambig": part(4), "etal": etal, "title": title, **blank}
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def reference_models(hits: DataFrame, manifest: DataFrame, links: DataFrame) -> DataFrame:
    """hits (file_path, page) as references: filename, known (has a record), apa, intext, drive_url, pages ("pp. 3, 12").

    manifest: filename and the columns of RECORD; links: filename, drive_url. Both are joined by the file's name; of hits only a row a file is.
    """
    files = hits.withColumn("filename", basename(F.trim("file_path"))).groupBy("filename").agg(F.collect_set("page").alias("_pages"))
    names = [x.split()[0] for x in RECORD.split(", ")]
    records = manifest.select("filename", F.struct(*names).alias("_r"))
    joined = files.join(records, "filename", "left").join(links.select("filename", "drive_url"), "filename", "left")
    told = joined.select("filename", F.col("_r").isNotNull().alias("known"), F.coalesce(F.col("_r"), fallback(F.col("filename"))).alias("_x"), F.coalesce("drive_url", F.lit("")).alias("drive_url"), pages_label(F.col("_pages")).alias("pages"))
    parts = apa_parts(F.col("_x"))
    ready = told.select("filename", "known", "drive_url", "pages", intext(F.col("_x")).alias("intext"), *(c.alias(f"_{n}") for n, c in parts.items()))
    return ready.select("filename", "known", apa({n: F.col(f"_{n}") for n in parts}).alias("apa"), "intext", "drive_url", "pages")


def locator(local: Column, drive: Column, path: Column, filename: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (local, drive, path, filename)])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)
