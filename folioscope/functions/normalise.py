"""Fields of records as printed, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the normalisation of affiliations, subjects and types.
INSTITUTIONS = (
    "universit", "college", "institute", "institut", "school", "hospital", "academy", "laborator", "laboratoire",
    "center", "centre", "max planck", "cnrs", "mrc ", "nih", "museum", "foundation", "polytechnic", "ecole", "école",
    "faculty",
)
UNITS = (
    "department", "dept", "division", "program", "programme", "unit", "section", "group", "chair", "school of",
    "faculty of", "centre for", "center for", "laboratory", "laboratoire", "graduate school", "research group",
    "institute of psychology",
)
COUNTRIES = (
    "usa", "u.s.a.", "united states", "uk", "u.k.", "united kingdom", "canada", "germany", "france", "italy", "spain",
    "netherlands", "belgium", "australia", "japan", "china", "israel", "sweden", "norway", "denmark", "finland",
    "switzerland", "austria", "poland", "brazil", "india", "new zealand", "scotland", "england", "wales", "ireland",
    "portugal", "greece", "czech republic", "hungary", "russia", "south korea", "korea", "singapore", "mexico",
    "argentina", "chile", "turkey", "south africa",
)
ABBREVIATED = ((r"\bUniv\.?\b", "University"), (r"\bInst\.?\b", "Institute"), (r"\bDept\.?\b", "Department"), (r"\bU\.\s*of\b", "University of"))
MULTI_CAMPUS = (
    "university of california", "state university of new york", "university of texas", "university of illinois",
    "university of wisconsin", "university of massachusetts", "university of colorado", "university of missouri",
    "university of nebraska", "university of maryland", "university of washington", "university of north carolina",
    "university of south florida", "indiana university", "purdue university", "rutgers university",
    "texas a&m university", "pennsylvania state university", "city university of new york",
)
NO_CAMPUS = r"^([A-Z]{2}|\d{4,}|[A-Z]?\d[\w\s-]*)$"
SUBJECTS = {
    "cs": "Computer Science", "cs.ai": "Artificial Intelligence", "cs.cl": "Computation and Language",
    "cs.lg": "Machine Learning", "cs.hc": "Human-Computer Interaction", "cs.cv": "Computer Vision",
    "cs.ne": "Neural and Evolutionary Computing", "cs.cy": "Computers and Society", "cs.cr": "Cryptography and Security",
    "cs.si": "Social and Information Networks", "cs.ir": "Information Retrieval", "cs.gt": "Game Theory",
    "cs.ma": "Multiagent Systems", "stat": "Statistics", "stat.ml": "Machine Learning",
    "stat.me": "Statistical Methodology", "stat.ap": "Applied Statistics", "math": "Mathematics",
    "math.dg": "Differential Geometry", "q-bio": "Quantitative Biology", "q-bio.nc": "Neurons and Cognition",
}
TYPES = {
    "article": "Journal article", "article-journal": "Journal article", "preprint": "Preprint",
    "posted-content": "Preprint", "chapter": "Book chapter", "book": "Book", "report": "Report", "thesis": "Thesis",
    "paper-conference": "Conference paper", "other": "Other",
}


def one_of(words: tuple[str, ...]) -> str:
    """A pattern of words as they are."""
    return "|".join(w.replace(".", r"\.") for w in words)


def plain(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ .,;]+|[ .,;]+$", "")


def affiliation(raw: Column) -> Column:
    """The institution of an affiliation: its first part that names one and is no unit of one, with the campus where that is told
    apart by it; else its longest part, blank if that is short or a unit."""
    text = plain(raw)
    for pattern, word in ABBREVIATED:
        text = F.regexp_replace(text, f"(?i){pattern}", word)
    text = _bare(F.regexp_replace(text, rf"(?i),\s*({one_of(COUNTRIES)})\.?\s*$", ""))
    parts = F.filter(F.transform(F.split(text, ","), _bare), lambda x: x != "")
    named = lambda x: F.rlike(F.lower(x), F.lit(one_of(INSTITUTIONS)))
    unit = lambda x: F.rlike(F.lower(x), F.lit(f"^({one_of(UNITS)})"))
    found = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: named(s["x"]) & ~unit(s["x"]))
    first = F.try_element_at(found, F.lit(1))
    name = F.regexp_replace(collapsed(first["x"]), r"(?i)^the\s+", "")
    campus = collapsed(F.try_element_at(parts, first["i"] + 2))
    told_apart = F.lower(name).isin(*MULTI_CAMPUS) & (campus != "") & (F.size(F.split(campus, " ")) <= 3) & ~F.rlike(campus, F.lit(NO_CAMPUS)) & ~named(campus)
    longest = F.array_max(F.transform(parts, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    other = F.when((F.length(longest) < 4) | unit(longest), "").otherwise(collapsed(longest))
    return F.when(F.size(parts) == 0, "").when(F.coalesce(told_apart, F.lit(False)), F.concat(name, F.lit(", "), campus)).otherwise(F.coalesce(name, other))


def _labelled(c: Column, labels: dict[str, str], otherwise: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(c)), otherwise)


def subject(raw: Column) -> Column:
    """A preprint server's subject codes in words; other subjects as printed."""
    return _labelled(plain(raw), SUBJECTS, plain(raw))


def kind(raw: Column) -> Column:
    """The label of a record's type; unknown types with spaces for hyphens and one capital."""
    key = F.replace(F.lower(plain(raw)), F.lit("-"), F.lit(" "))
    return _labelled(plain(raw), TYPES, F.concat(F.upper(F.substring(key, 1, 1)), F.substring(key, 2, 1_000_000)))


def without_case_repeats(values: Column) -> Column:
    """Values in order, repeats but for case dropped; one in small letters gives way to a later one with a capital."""
    clean = F.filter(F.transform(values, collapsed), lambda x: x != "")
    keys = F.array_distinct(F.transform(clean, lambda x: F.lower(x)))
    mine = lambda k: F.filter(clean, lambda x: F.lower(x) == k)
    return F.transform(keys, lambda k: F.coalesce(F.try_element_at(F.filter(mine(k), lambda x: x != F.lower(x)), F.lit(1)), mine(k)[0]))


def clean_affiliations(values: Column) -> Column:
    """Marker digits before a name and marks around it dropped, then repeats but for case."""
    bare = F.transform(values, lambda x: _edge(collapsed(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s*\d{1,2}\s*(?=[A-Z][a-z])", ""))))
    kept = F.filter(bare, lambda x: x != "")
    keys = F.array_distinct(F.transform(kept, lambda x: F.lower(x)))
    return F.transform(keys, lambda k: F.filter(kept, lambda x: F.lower(x) == k)[0])


def _edge(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^[,;]+|[,;]+$", ""))


def clean_keywords(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda x: collapsed(F.lower(F.coalesce(x, F.lit(""))))), lambda x: x != ""))


def abstract_text(raw: Column) -> Column:
    """An abstract without its tags and its own heading."""
    flat = collapsed(F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]+>", " "))
    return F.trim(F.regexp_replace(flat, r"(?i)^abstract[:\s]*", ""))


def clean_title(raw: Column) -> Column:
    return collapsed(F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]+>", ""))


def is_first_author(intext: Column, author: Column) -> Column:
    """Does an in-text citation lead with this author, a first part of a longer surname included?"""
    lead = F.lower(F.trim(F.element_at(F.split(F.coalesce(intext, F.lit("")), r"(?i),| & | and | et al\.?"), 1)))
    name = F.lower(F.trim(F.coalesce(author, F.lit(""))))
    return (lead != "") & (name != "") & ((lead == name) | F.startswith(lead, F.concat(name, F.lit(" "))) | F.startswith(lead, F.concat(name, F.lit("-"))))
