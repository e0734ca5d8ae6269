"""Do files' names and records belong together: mismatches and their kinds (DB10), distances of names (T17), verdicts and proposals from evidence (T18), names from extracted fields (DB9), first names win (DB14), canonical texts (DB15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.names import name_case

#: Accented Latin letters and what they are without accents; letters that are no accented ones; two letters that count as one: fixed values.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīįńňōőřśşšťţūůűźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeegiinnoorsssttuuuzzz"
_OTHER = (("ł", "l"), ("ı", "i"), ("ø", "o"), ("đ", "d"), ("ð", "d"), ("þ", "th"), ("œ", "oe"), ("æ", "ae"), ("ß", "ss"))
_TWO = (("oe", "o"), ("ue", "u"), ("ae", "a"), ("ss", "s"))
#: What marks an author that is a body, and a decoding gone wrong or a misread letter: fixed values.
_BODY = r"(?i)\b(inc|association|team|group|society|university|committee|department|laborator|institute|corp|company|press)\b"
_GONE_WRONG, _MISREAD = "[ÃÂ]", "[ÃÂ].|[0-9~?]|β"


def letters(c: Column) -> Column:
    """Letters a to z of a name in lower case, accents gone; others, such as ø, are left out."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), _ACCENTED, _PLAIN), "[^a-z]", "")


def _replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def strict(c: Column) -> Column:
    """letters() with two letters as one where they stand for an umlaut or a sharp s."""
    return _replaced(letters(c), _TWO)


def folded(c: Column) -> Column:
    """strict() with letters such as ø and ß as their plain ones."""
    return strict(_replaced(F.lower(F.coalesce(c, F.lit(""))), _OTHER))


def same_name(a: Column, b: Column) -> Column:
    """Are two folded names equal, or is one within the other?"""
    return (a == b) | F.contains(a, b) | F.contains(b, a)


def decoded(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 read anew; null where it was not, or is no text then."""
    latin = F.when(c.rlike(r"^[\x{0}-\x{FF}]*$"), F.encode(c, "ISO-8859-1"))
    found = F.when(F.is_valid_utf8(latin.cast("string")), latin.cast("string"))
    return F.when((found != c) & ~found.rlike(_MISREAD), found)


def name_mismatches(records: DataFrame) -> DataFrame:
    """filename, category, families of records (filename, families: list) none of whose families agrees with the file's first name.

    FALSE_POSITIVE: one agrees by its folded letters; MOJIBAKE: so does one, yet its decoding went wrong; CORPORATE: a body;
    GARBLED_NAME: a wrong decoding and another name; WRONG_UNRESOLVED: another name. Where one agrees once its bytes are
    decoded anew, families are given so, with ``repaired``.
    """
    first = F.split_part(F.regexp_replace("filename", r"(?i)\.pdf$", ""), F.lit("_"), F.lit(1))
    known = records.withColumn("_f", F.filter("families", lambda f: F.coalesce(f, F.lit("")) != "")).filter(F.size("_f") > 0)
    named = known.withColumns({"_s": strict(first), "_n": folded(first)}).filter(~F.exists("_f", lambda f: same_name(F.col("_s"), strict(f))))
    agrees = (F.col("_n") != "") & F.exists("_f", lambda f: same_name(F.col("_n"), folded(f)))
    garbled = F.exists("_f", lambda f: f.rlike(_GONE_WRONG))
    anew = F.exists("_f", lambda f: decoded(f).isNotNull() & same_name(F.col("_n"), folded(decoded(f))))
    category = F.when(agrees, F.when(garbled, "MOJIBAKE").otherwise("FALSE_POSITIVE")).when(F.exists("_f", lambda f: f.rlike(_BODY)), "CORPORATE").when(garbled, "GARBLED_NAME").otherwise("WRONG_UNRESOLVED")
    return named.select("filename", category.alias("category"), anew.alias("repaired"), F.when(anew, F.transform("_f", lambda f: F.coalesce(decoded(f), f))).otherwise(F.col("_f")).alias("families"))


def ascii_name(c: Column) -> Column:
    """A surname as file names have it: letters, hyphens and apostrophes without accents, letter case kept."""
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _ACCENTED + _ACCENTED.upper(), _PLAIN + _PLAIN.upper()), "[^A-Za-z'-]", "")


def proposed_name(fields: DataFrame) -> DataFrame:
    """fields (first, second, year, n_authors, citable, confidence) with name and tier: how a file should be called, null where nothing sure is known.

    One author, two, or a first and Etal; of two without a second name, Etal as well.
    """
    a, b = ascii_name(F.col("first")), ascii_name(F.col("second"))
    year = F.regexp_extract(F.coalesce(F.col("year").cast("string"), F.lit("")), r"(1[5-9]\d{2}|20\d{2})", 1)
    n = F.coalesce("n_authors", F.lit(0))
    tier = F.when(n >= 3, "etal").when((n == 2) & (b != ""), "two").when(n == 2, "two-noname").otherwise("one")
    fine = F.coalesce("citable", F.lit(False)) & (F.coalesce("confidence", F.lit("")) != "low") & (a != "") & (year != "")
    middle = F.when(tier.isin("etal", "two-noname"), "_Etal").when(tier == "two", F.concat(F.lit("_"), b)).otherwise("")
    return fields.withColumns({"name": F.when(fine, F.concat(a, middle, F.lit("_"), year, F.lit(".pdf"))), "tier": F.when(fine, tier)})


def first_wins(pairs: DataFrame, name: str = "name", order: str = "seq") -> DataFrame:
    """Of pairs the first of each name that ends in .pdf."""
    fit = pairs.filter(F.lower(name).endswith(".pdf"))
    return fit.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(order))).filter("_r = 1").drop("_r")


def truncated(text: Column, tokens: int) -> Column:
    """A text's first tokens, four characters each."""
    return F.substring(text, 1, 4 * tokens)


def canonical_ids(texts: DataFrame, text: str = "text", tokens: int = 120_000) -> DataFrame:
    """content_id of the texts that are not blank, cut to so many tokens: the names under which a store may hold them."""
    fit = texts.filter(F.coalesce(F.trim(text), F.lit("")) != "")
    return fit.select(F.concat(F.lit("doc-"), F.md5(truncated(F.trim(text), tokens).cast("binary"))).alias("content_id")).distinct()


def only_canonical(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a store (content_id) whose text is still there."""
    return store.join(ids, "content_id", "left_semi")


#: Letters apart that still are a slip of the pen; years apart that still agree: fixed values.
SLIP, NEAR = 3, 1


def canonical_name(first: Column, second: Column, year: Column) -> Column:
    middle = F.when(F.coalesce(second, F.lit("")) != "", F.concat(F.lit("_"), second)).otherwise("")
    return F.concat(first, middle, F.lit("_"), year.cast("string"), F.lit(".pdf"))


def verdicts(files: DataFrame) -> DataFrame:
    """files with verdict, proposal and tier, from what is known of each.

    filename; author, author2, year: read from it (null: it has not the form); has_text, found: whether its first page has
    text and the author in it (yes, no, short); record_family, record_year: of the record of a DOI on that page, if any.
    The page comes first: a record of another author is a stray one where the page has the author, else it decides.
    Proposals: ``year`` and ``slip`` by the record, ``other`` for review, ``style`` for how a right name is written.
    """
    own, family = letters(F.col("author")), F.coalesce("record_family", F.lit(""))
    tokens = F.filter(F.transform(F.split(family, r"[\s'-]+"), lambda t: letters(t)), lambda t: t != "")
    match = (own == letters(family)) | F.array_contains(tokens, own)
    dated = F.coalesce(F.abs(F.col("record_year") - F.col("year")) <= NEAR, F.lit(True))
    on_page = F.coalesce(F.col("found") == "yes", F.lit(False)) & F.col("has_text")
    by_record = F.when(match & dated, "OK").when(match | ~on_page, "MISMATCH")
    by_page = F.when(~F.col("has_text") | (F.col("found") == "short"), "UNVERIFIABLE").when(F.col("found") == "no", "SUSPECT").otherwise("OK")
    verdict = F.when(F.col("author").isNull(), "FORMAT").otherwise(F.coalesce(F.when(letters(family) != "", by_record), by_page))
    told = files.withColumns({"verdict": verdict, "_match": match, "_family": ascii_name(F.col("record_family"))})
    apart = F.levenshtein(own, letters(family))
    tier = F.when(F.col("verdict") == "MISMATCH", F.when(F.col("_match"), F.when(F.col("record_year").isNotNull(), "year")).when(F.col("_family") != "", F.when(apart <= SLIP, "slip").otherwise("other")))
    shouted = (F.col("author") == F.upper("author")) & (F.length("author") > 1)
    style = {"author": F.when(shouted, name_case(F.col("author"))).otherwise(F.col("author")), "author2": F.when(F.lower("author2") == "etal", "Etal").otherwise(F.col("author2"))}
    styled = canonical_name(style["author"], style["author2"], F.col("year"))
    tier = F.coalesce(tier, F.when((F.col("verdict") == "OK") & (styled != F.col("filename")) & (shouted | (style["author2"] != F.coalesce("author2", F.lit("")))), "style"))
    names = F.when(F.col("tier") == "year", canonical_name(F.col("author"), F.col("author2"), F.col("record_year"))).when(F.col("tier") == "slip", canonical_name(F.col("_family"), F.col("author2"), F.col("year")))
    names = names.when(F.col("tier") == "other", canonical_name(F.col("_family"), F.col("author2"), F.coalesce("record_year", "year"))).when(F.col("tier") == "style", styled)
    proposed = told.withColumn("tier", tier).withColumn("proposal", names)
    changed = F.col("proposal") != F.col("filename")
    return proposed.withColumns({"proposal": F.when(changed, F.col("proposal")), "tier": F.when(changed, F.col("tier"))}).drop("_match", "_family")
