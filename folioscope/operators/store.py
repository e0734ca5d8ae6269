"""Chat store, catalogue maintenance and dates of records (C4, C19, J19, T7, DB2, DB5-DB8, DB13, DB18, DB21, DB25, ST3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.catalogue import first_by


def chats_of(chats: DataFrame, members: DataFrame, user, before=None, limit: int = 20) -> DataFrame:
    """A user's chats (chat_id, user_id, created), own and shared (members: chat_id, user_id), newest first, with is_owner; one row more than limit if there are more."""
    mine = members.filter(F.col("user_id") == user).select("chat_id", F.lit(True).alias("_member")).distinct()
    seen = chats.join(mine, "chat_id", "left").filter((F.col("user_id") == user) | F.col("_member").isNotNull())
    page = seen if before is None else seen.filter(F.col("created") < before)
    return page.select("chat_id", "created", (F.col("user_id") == user).alias("is_owner")).orderBy(F.desc("created"), F.desc("chat_id")).limit(limit + 1)


def participants(chats: DataFrame, members: DataFrame, messages: DataFrame, users: DataFrame) -> DataFrame:
    """chat_id, user_id, is_owner: owner, members and authors of messages who are known users, each once."""
    owners = chats.select("chat_id", "user_id", F.lit(True).alias("is_owner"))
    others = members.select("chat_id", "user_id").unionByName(messages.select("chat_id", "user_id")).withColumn("is_owner", F.lit(False))
    return owners.unionByName(others).groupBy("chat_id", "user_id").agg(F.max("is_owner").alias("is_owner")).join(users.select("user_id").distinct(), "user_id", "left_semi")


def untried(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (name, size) that the ledger does not hold at this size: a changed file is tried again."""
    return files.join(ledger.select("name", "size").distinct(), ["name", "size"], "left_anti")


def free_name(name: Column, taken: Column) -> Column:
    """A file's name with the first free letter after its year, else, or if it has no year, with _2 and on; taken: names in lower case."""
    parts = F.regexp_extract(name, r"^(.*_\d{4})[a-z]?\.pdf$", 1)
    lettered = F.filter(F.transform(F.sequence(F.lit(97), F.lit(122)), lambda i: F.concat(parts, F.char(i), F.lit(".pdf"))), lambda x: (parts != "") & ~F.array_contains(taken, F.lower(x)))
    base = F.regexp_replace(name, r"\.pdf$", "")
    counted = F.filter(F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda i: F.concat(base, F.lit("_"), i.cast("string"), F.lit(".pdf"))), lambda x: ~F.array_contains(taken, F.lower(x)))
    return F.coalesce(F.try_element_at(lettered, F.lit(1)), F.try_element_at(counted, F.lit(1)))


def free_letter(taken: Column) -> Column:
    """The first of a to z that is not taken, in any case; null if all are."""
    every = F.array(*[F.lit(chr(97 + i)) for i in range(26)])
    return F.try_element_at(F.array_except(every, F.transform(taken, lambda x: F.lower(x))), F.lit(1))


def refresh(canonical: DataFrame, atlas: DataFrame, renames: DataFrame) -> DataFrame:
    """atlas names against canonical ones (name): name, current, state: kept, renamed (old gone, new there and not in the atlas yet), or atlas_only; and pending: canonical names that no row took."""
    known = canonical.select("name").distinct().withColumn("_known", F.lit(True))
    used = atlas.select(F.col("name").alias("new")).distinct().withColumn("_used", F.lit(True))
    moved = renames.join(known.withColumnsRenamed({"name": "new", "_known": "_there"}), "new").join(used, "new", "left").filter("_used is null").select(F.col("old").alias("name"), "new")
    once = first_by(first_by(moved, ["name"], "new"), ["new"], "name")
    rows = atlas.join(known, "name", "left").join(once, "name", "left")
    state = F.when(F.col("_known").isNotNull(), "kept").when(F.col("new").isNotNull(), "renamed").otherwise("atlas_only")
    told = rows.select("name", F.when(F.col("_known").isNull(), F.coalesce("new", "name")).otherwise(F.col("name")).alias("current"), state.alias("state"))
    pending = canonical.select("name").distinct().join(told.select(F.col("current").alias("name")), "name", "left_anti")
    return told.unionByName(pending.select("name", F.col("name").alias("current"), F.lit("pending").alias("state")))


def rekey(rows: DataFrame, key: str, renames: DataFrame, gone: DataFrame) -> DataFrame:
    """rows under new keys (renames: old, new), all at once so that chains are safe; deleted keys (gone) dropped first."""
    left = rows.join(gone.select(key).distinct(), key, "left_anti")
    return left.join(renames.select(F.col("old").alias(key), "new"), key, "left").withColumn(key, F.coalesce("new", key)).drop("new")


def pending_counts(ledger: DataFrame, targets: list[str]) -> DataFrame:
    """target, pending, done of a ledger with one boolean column a target."""
    sums = ledger.agg(*(F.count_if(~F.coalesce(F.col(t), F.lit(False))).alias(t) for t in targets), F.count("*").alias("_n"))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).alias("pending"), (F.col("_n") - F.col(t)).alias("done")) for t in targets))).alias("x")).select("x.*")


#: Labels of dates that say when a work appeared, and those of them that are of its first appearance online. Fixed values.
ONLINE = ("published-online", "available-online", "posted", "preprint-stamp", "first-published")


def decide_date(found: Column, label: Column, existing: Column, appearance: tuple[str, ...]) -> Column:
    """The date to take from a page, or null to keep the record's: more precise within the same year or month, or an earlier appearance online."""
    pattern = r"^\s*(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?\s*$"
    part = lambda c, i: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, i), F.lit(""))
    (y, m, d), (ey, em, ed) = ([part(c, i) for i in (1, 2, 3)] for c in (found, existing))
    name = F.lower(F.coalesce(F.nullif(label, F.lit("")), F.lit("none")))
    first = name.isin(*ONLINE)
    iso = F.concat_ws("-", y, m, d)
    by_year = F.when((y == ey) | ((y < ey) & first), iso)
    by_month = F.when(d.isNotNull() & ((F.concat(y, m) == F.concat(ey, em)) | ((F.concat(y, m) < F.concat(ey, em)) & first)), iso)
    return F.when(name.isin(*appearance) & m.isNotNull(), F.when(ey.isNull(), iso).when(em.isNull(), by_year).otherwise(by_month))


def earliest_date(dates: Column) -> Column:
    """The earliest of partial dates (array of arrays of year, month, day), missing parts after all others: iso and precision; blank without one."""
    known = F.filter(dates, lambda p: F.coalesce(F.try_element_at(p, F.lit(1)), F.lit(0)) > 0)
    at = lambda p, i: F.coalesce(F.try_element_at(p, F.lit(i)), F.lit(99))
    two = lambda p, i: F.lpad(F.try_element_at(p, F.lit(i)).cast("string"), 2, "0")
    made = F.transform(known, lambda p: F.struct(at(p, 1).alias("y"), at(p, 2).alias("m"), at(p, 3).alias("d"), F.concat_ws("-", F.lpad(p[0].cast("string"), 4, "0"), two(p, 2), two(p, 3)).alias("iso"), F.element_at(F.array(F.lit("year"), F.lit("month"), F.lit("day")), F.least(F.size(p), F.lit(3))).alias("precision")))
    best = F.array_min(made)
    return F.struct(F.coalesce(best["iso"], F.lit("")).alias("iso"), F.coalesce(best["precision"], F.lit("")).alias("precision"))


def supplement_links(papers: DataFrame, supplements: DataFrame) -> DataFrame:
    """supplements (name, like MossEtal2011_suppl.pdf) to the paper (name, like Moss_Etal_2011.pdf) of equal code: four letters of the
    first name, ``etal`` or four of the second, the year; the first paper of a code counts. target numbers further supplements of a paper."""
    parts = F.split(F.regexp_replace("name", r"(?i)\.pdf$", ""), "_")
    year = F.regexp_extract(F.element_at(parts, -1), r"^(\d{4})[a-z]?$", 1)
    second = F.when(F.size(parts) >= 3, F.when(parts[1] == "Etal", "Etal").otherwise(F.substring(parts[1], 1, 4))).otherwise("")
    coded = papers.filter((F.size(parts) >= 2) & (year != "")).select(F.lower(F.concat(F.substring(parts[0], 1, 4), second, year)).alias("code"), F.regexp_replace("name", r"(?i)\.pdf$", "").alias("paper"))
    bare = F.regexp_replace(F.regexp_replace("name", r"(?i)\.pdf$", ""), r"(?i)[_-]?suppl.*$", "")
    own = supplements.select("name", F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([A-Za-z.]+?\d{4}[a-z]?)", 1), "[^A-Za-z0-9]", "")).alias("code"))
    met = own.join(first_by(coded, ["code"], "paper"), "code")
    nth = F.row_number().over(Window.partitionBy("paper").orderBy("name"))
    return met.select("name", "paper", F.concat("paper", F.lit("_Supplementary"), F.when(nth > 1, F.concat(F.lit("_"), nth)).otherwise(""), F.lit(".pdf")).alias("target"))


def contextual(chunks: DataFrame, cache: DataFrame, salt: str) -> DataFrame:
    """chunks (chunk_id, content, prompt) with the cached context of their prompt before the content; without one as they are. cache: k, v; k hashes salt and prompt."""
    keyed = chunks.withColumn("k", F.md5(F.concat(F.lit(salt), F.lit("\x00"), F.col("prompt")).cast("binary")))
    joined = keyed.join(cache.select("k", "v"), "k", "left")
    given = F.trim(F.coalesce("v", F.lit(""))) != ""
    return joined.select("chunk_id", F.when(given, F.concat("v", F.lit("\n\n"), "content")).otherwise(F.col("content")).alias("content"), given.alias("contextual"))


def repeated_edges(pages: DataFrame, edge: int = 3) -> DataFrame:
    """doc_id, line of lines that recur at the edges of pages (doc_id, page, text), numbers at their ends aside: of documents of four pages
    and more, on three and 40 % of them."""
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x))
    edges = F.concat(F.slice(lines, 1, edge), F.slice(lines, F.greatest(F.size(lines) - edge + 1, F.lit(1)), edge))
    key = lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*\d{1,4}\s+|\s+\d{1,4}\s*$", ""), r"\s+", " ")))
    found = F.filter(F.array_distinct(F.transform(edges, key)), lambda x: F.length(x).between(4, 120))
    page = F.array(F.lit(None).cast("string"))  # counts the page itself
    each = pages.filter("doc_id is not null").select("doc_id", F.explode(F.concat(F.coalesce(found, F.array().cast("array<string>")), page)).alias("line"))
    counts = each.groupBy("doc_id", "line").agg(F.count("*").alias("_n"))
    sized = counts.withColumn("_pages", F.max(F.when(F.col("line").isNull(), F.col("_n"))).over(Window.partitionBy("doc_id")))
    kept = sized.filter(F.col("line").isNotNull() & (F.col("_pages") >= 4) & (F.col("_n") >= F.greatest(F.lit(3), F.floor(F.col("_pages") * 0.4))))
    return kept.select("doc_id", "line", F.col("_n").alias("n_pages"))


def new_neighbours(recent: DataFrame, base: DataFrame, term: str = "term") -> DataFrame:
    return recent.join(base.select(term), term, "left_anti")
