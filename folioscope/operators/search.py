"""Vector search and what is folded from it."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.filters import date_end, lower, people, record_year, stem


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def vector_search(chunks: DataFrame, query: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
    """The k chunks nearest to one query vector (a row ``q``) by cosine, ties by chunk_id; ``within``: files to search in.

    The filter is a semi-join below the top-k, so it restricts the search, not its result.
    """
    pool = chunks if within is None else chunks.join(within.select("file_path").distinct(), "file_path", "left_semi")
    scored = pool.crossJoin(F.broadcast(query.select("q").limit(1))).withColumn("score", cosine("embedding", "q")).drop("q", "embedding")
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def rank_papers(hits: DataFrame) -> DataFrame:
    """Hits (file_path, content, score, pos) folded to papers: best score, number of chunks, snippet.

    The snippet is of the last chunk that set or met the best score; where that is blank, of the first after it that is not.
    """
    own = Window.partitionBy("file_path")
    said = F.substring(F.btrim(F.coalesce("content", F.lit("")), F.lit(" \t\n\r\f\x0b")), 1, 300)
    known = hits.filter(F.coalesce("file_path", F.lit("")) != "").withColumn("_said", said).withColumn("_best", F.max(F.struct("score", "pos")).over(own))
    later = F.min(F.when((F.col("pos") >= F.col("_best.pos")) & (F.col("_said") != ""), F.struct("pos", "_said")))["_said"]
    folded = known.groupBy("file_path").agg(F.round(F.max("score"), 4).alias("score"), F.count("*").alias("n_chunks"), F.coalesce(later, F.lit("")).alias("snippet"), F.min("pos").alias("first_pos"))
    return folded.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "first_pos"))).drop("first_pos")


def reference_ids(hits: DataFrame) -> DataFrame:
    """file_path, reference_id: 1.. by number of chunks, then first appearance; no blank or unknown source."""
    known = hits.filter(~F.coalesce("file_path", F.lit("")).isin("", "unknown_source"))
    counts = known.groupBy("file_path").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return counts.select("file_path", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first_pos")).alias("reference_id"))


def centroids(chunks: DataFrame, group: str = "file_path") -> DataFrame:
    """The mean of each group's vectors over its length (+ 1e-9): group, centroid."""
    means = chunks.groupBy(group).agg(vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("mean"))  # partial sums where rows are read
    return means.select(group, F.transform("mean", lambda x: x / (norm("mean") + 1e-9)).alias("centroid"))


def similar_papers(chunks: DataFrame, file_path: str, k_chunks: int, k_papers: int) -> DataFrame:
    """Papers like one: chunks nearest to its centroid, its own left out, folded."""
    own = centroids(chunks.filter(F.col("file_path") == file_path)).select(F.col("centroid").alias("q"))
    hits = vector_search(chunks.filter(F.col("file_path") != file_path), own, k_chunks)
    return rank_papers(hits.withColumn("content", F.lit("")).withColumn("pos", F.col("chunk_id"))).filter(F.col("rank") <= k_papers).drop("snippet")


def oeuvre_similarity(chunks: DataFrame) -> DataFrame:
    """Cosine of each two files' centroids, to 3 places: a, b, cosine. As many rows as pairs of files: for bounded sets of files."""
    c = centroids(chunks)
    a, b = c.select(F.col("file_path").alias("a"), F.col("centroid").alias("x")), c.select(F.col("file_path").alias("b"), F.col("centroid").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cosine("x", "y"), 3).alias("cosine"))


#: Rows of a block of the neighbour graph, rows of it multiplied at once, and pairs scored again at once.
BLOCK, SLICE, PAIRS = 16_384, 128, 1 << 17


def _nearest(x, y, i, j, k: int):
    """(i, j, sim) of the k rows of y nearest to each of x by cosine, ties by j, never one of equal id.

    The k-th best of the maxima of runs of columns is a bound from below for the k-th best of all, so what reaches it
    is little more than k. The bound comes from products in single precision, less what they may be wrong by; what reaches
    it is scored in double precision, pair by pair and to twelve places, so that equal angles tie.
    """
    import numpy as np

    order = np.argsort(j, kind="stable")
    y, j = y[order], j[order]
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    ends = (y / np.maximum(np.sqrt(yy), 1e-12)[:, None]).T.astype(np.float32)
    starts = (x / np.maximum(np.sqrt(xx), 1e-12)[:, None]).astype(np.float32)
    slack = 2.0**-21 * (x.shape[1] + 8)
    run = max(1, min(128, len(j) // (4 * k)))
    full = len(j) // run
    found = []
    for at in range(0, len(i), SLICE):
        own, who, square = x[at : at + SLICE], i[at : at + SLICE], xx[at : at + SLICE]
        sims = starts[at : at + SLICE] @ ends
        low, high = np.searchsorted(j, who, "left"), np.searchsorted(j, who, "right")
        for r in np.flatnonzero(high > low).tolist():
            sims[r, low[r] : high[r]] = -3
        bound = np.full(len(who), -2, dtype=np.float32)
        if full > k:
            bound = np.partition(sims[:, : full * run].reshape(len(who), full, run).max(axis=2), full - k, axis=1)[:, full - k]
        bound = np.where(bound > slack, bound - np.float32(slack), np.float32(-2))  # at 0 all angles from a right one up are equal
        a, b = np.nonzero(sims >= bound[:, None])
        parts = (slice(s, s + PAIRS) for s in range(0, len(a), PAIRS))
        dots = [np.zeros(0)] + [(own[a[s]] * y[b[s]]).sum(axis=1) for s in parts]
        both = square[a] * yy[b]
        score = np.round(np.where(both > 0, np.maximum(0, np.concatenate(dots) / np.sqrt(np.where(both > 0, both, 1))), 0.0), 12)
        best = np.lexsort((b, -score, a))
        a, b, score = a[best], b[best], score[best]
        first = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
        found.append((who[a[first]], j[b[first]], score[first]))
    return [np.concatenate(c) for c in zip(*found)]


def knn_graph(chunks: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Exact kNN graph in blocks: i, rank, j, sim. Each pair of blocks is matrix products in a task; vectors with a component that is no finite number take no part.

    All pairs are compared, so the work is quadratic; what a task holds is two blocks and the products of SLICE rows.
    """
    import numpy as np
    import pandas as pd

    count = chunks.count()
    n = max(1, -(-count // block), min(4, -(-count // 1024)))  # a small table still makes tasks
    cell = F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = chunks.select("chunk_id", "embedding", cell.alias("p"), every.alias("q"))
    cols = chunks.select("chunk_id", "embedding", every.alias("p"), cell.alias("q"))

    def finite(g: pd.DataFrame):
        x, ids = np.array(g["embedding"].tolist()), g["chunk_id"].to_numpy()
        good = np.isfinite(x).all(axis=1)
        return x[good], ids[good]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) and len(right):
            (x, i), (y, j) = finite(left), finite(right)
            if len(i) and len(j):
                return pd.DataFrame(dict(zip(("i", "j", "sim"), _nearest(x, y, i, j, k))))
        return pd.DataFrame({"i": [], "j": [], "sim": []}).astype({"i": "int64", "j": "int64", "sim": "float64"})

    met = rows.groupBy("p", "q").cogroup(cols.groupBy("p", "q")).applyInPandas(meet, "i bigint, j bigint, sim double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim"), "j")))
    return ranked.filter(F.col("rank") <= k).select("i", "rank", "j", "sim")


def recall(found: DataFrame, truth: DataFrame, by: str, item: str) -> DataFrame:
    """Of truth's rows, the share that found holds: by group."""
    hit = truth.join(found.select(by, item).distinct().withColumn("hit", F.lit(1)), [by, item], "left")
    return hit.groupBy(by).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


#: Fields of a listed paper: texts, and lists of them; a paper that lacks one has a blank or an empty list. Fixed values.
SLIM_TEXTS = ("title", "year", "date", "date_precision", "container_title", "volume", "issue", "pages", "doi", "type", "publisher", "source")
SLIM_LISTS = ("authors", "keywords", "subjects", "affiliations")


def sort_key(papers: DataFrame, sort: str) -> Column:
    """What papers are sorted by, null where a paper has no such thing; an unknown key is the year."""
    first = F.try_element_at("authors", F.lit(1))["family"] if "authors" in papers.columns else F.col("family")
    year = record_year(F.col("year"))
    starts = F.when(F.coalesce("date", F.lit("")) != "", date_end(F.col("date"), False)).otherwise(year * 10000 + 101) if "date" in papers.columns else year
    keys = {"title": F.nullif(lower("title"), F.lit("")), "first_author": F.nullif(lower(first), F.lit("")), "journal": F.nullif(lower("container_title"), F.lit("")), "date": starts}
    return keys.get(sort, year)


def list_papers(papers: DataFrame, sort: str = "year", descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in order of a key, ties by filename in the key's direction; papers without the key last, by filename."""
    named = papers.withColumn("_key", sort_key(papers, sort))
    name = F.when(F.col("_key").isNotNull(), F.col("filename"))
    order = [F.col("_key").desc_nulls_last(), name.desc()] if descending else [F.col("_key").asc_nulls_last(), name.asc()]
    return named.orderBy(*order, "filename").offset(max(0, offset)).limit(max(1, limit)).drop("_key")


def slim(papers: DataFrame) -> DataFrame:
    """filename and the slim fields of papers."""
    have = set(papers.columns)
    texts = [F.coalesce(F.col(c).cast("string") if c in have else F.lit(None).cast("string"), F.lit("")).alias(c) for c in SLIM_TEXTS]
    lists = [F.coalesce(c, F.array().cast(papers.schema[c].dataType)).alias(c) if c in have else F.array().cast("array<string>").alias(c) for c in SLIM_LISTS]
    return papers.select("filename", *texts, *lists)


def paper_page(papers: DataFrame, sort: str = "year", descending: bool = True, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """How many papers there are to list (one row, total), and the slim rows of one page with their place in the whole list."""
    listed = list_papers(papers, sort, descending, offset, limit)
    key = sort_key(listed, sort)
    name = F.when(key.isNotNull(), F.col("filename"))
    order = [key.desc_nulls_last(), name.desc()] if descending else [key.asc_nulls_last(), name.asc()]
    places = listed.select("filename", (F.row_number().over(Window.orderBy(*order, "filename")) + max(0, offset)).alias("place"))  # one page
    return papers.agg(F.count("*").alias("total")), slim(listed).join(F.broadcast(places), "filename")


def facets(papers: DataFrame) -> DataFrame:
    """Distinct non-blank values by dimension, letter case kept: dimension, value, n (papers that have it).

    Authors are the families of ``people`` (authors and editors where there are such columns), affiliations a list or a single one.
    """
    single = {"journals": "container_title", "types": "type"}
    lists = {"keywords": F.col("keywords"), "subjects": F.col("subjects"), "authors": F.transform(people(papers), lambda p: p["family"])}
    lists["affiliations"] = F.col("affiliations") if "affiliations" in papers.columns else F.array("affiliation")
    lists |= {d: F.array(c) for d, c in single.items()}
    trimmed = {d: F.array_distinct(F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda x: F.trim(x))) for d, c in lists.items()}
    named = [F.transform(c, (lambda d: lambda x: F.struct(F.lit(d).alias("dimension"), x.alias("value")))(d)) for d, c in trimmed.items()]
    each = papers.select(F.explode(F.concat(*named)).alias("x")).select("x.*").filter("value != ''")
    return each.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def minimal_record(filename: Column) -> Column:
    """What a file's name says: struct(title, year), year being its last word of four digits."""
    words = F.split(F.regexp_replace(filename, r"\.pdf$", ""), "_")
    years = F.filter(words, lambda w: w.rlike(r"^\d{4}$"))
    return F.struct(F.array_join(words, " ").alias("title"), F.when(F.size(years) > 0, F.element_at(years, -1)).alias("year"))


def scoped(papers: DataFrame, files: DataFrame) -> DataFrame:
    """filename, title, year, known: the corpus's files that have a record, and minimal rows for those that have none."""
    kept = papers.join(files, "filename", "left_semi").select("filename", "title", "year", F.lit(True).alias("known"))
    rest = files.join(papers.select("filename"), "filename", "left_anti").withColumn("m", minimal_record(F.col("filename")))
    return kept.unionByName(rest.select("filename", "m.title", "m.year", F.lit(False).alias("known")))


def pages_by_file(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file_path").agg(F.sort_array(F.collect_set("page")).alias("pages"))


__all__ = ["centroids", "cosine", "facets", "knn_graph", "list_papers", "oeuvre_similarity", "pages_by_file", "rank_papers", "recall", "reference_ids", "scoped", "similar_papers", "stem", "vector_search"]
