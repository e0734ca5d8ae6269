"""Hard negatives, the Merkle manifest and benchmark passages against plain versions, on small hostile tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, manifest, negatives, queries

# 11: hard negatives


def clustered(n=700, d=6):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((5, d)) * 3
    out = [(i, int(rng.integers(0, 3)), (centres[i % 5] + rng.standard_normal(d) * 0.3).round(2).tolist()) for i in range(n)]
    out += [(n + i, i % 2, out[7][2]) for i in range(30)]  # ties
    bad = [(None, 1, [1.0] * d), (2000, None, [1.0] * d), (2001, 1, None), (2002, 1, [None] + [1.0] * (d - 1)), (2003, 1, [math.nan] * d), (2004, 1, [math.inf] * d), (2005, 1, [1.0]), (2100, 1, [])]
    return out + bad + [(2200, 9, [0.0] * d), (2300, 8, [-9.0] * d), (2301, 8, [9.0] * d), (60, 9, [5.0] * d), (60, 9, [5.0] * d)]


def plain_negatives(rows, anchor, positives=5, negatives_=10):
    known = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or len(v) != 6 or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (str(label), [math.floor(256 * float(np.float32(x))) for x in v])
        known[i] = min(known.get(i, one), one)
    out = []
    for a in filter(anchor, known):
        score = {i: sum(x * y for x, y in zip(known[a][1], v)) for i, (_, v) in known.items() if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if known[i][0] == known[a][0]][:positives]:
            fit = [i for i in ranked if known[i][0] != known[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:negatives_]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows_of_bucket", [256, 1 << 18])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, rows_of_bucket):
    monkeypatch.setattr(negatives, "BUCKET", rows_of_bucket)
    rows = clustered()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit(1) for c in ("rank", "id", "v", "i", "j", "bucket", "score")})
    found = negatives.mine(df, F.col("id") % 20 == 0)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_hard_negatives_of_empty_and_small_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert negatives.mine(spark.createDataFrame([], schema), F.col("id") == 1).collect() == []
    assert negatives.mine(spark.createDataFrame([(1, 1, None)], schema), F.col("id") == 1).collect() == []
    assert negatives.mine(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], schema), F.col("id") == 1).collect() == []
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(1, 1, [1e30])], schema), F.col("id") == 1)


def test_ranges_prune_and_lose_nothing():
    rows = [r for r in clustered() if r[0] is not None and r[0] < 700 and r[0] != 60]
    x = np.floor(256 * np.array([v for _, _, v in rows])).astype(np.int64)
    bucket = negatives.Bucket(np.arange(len(x)), np.array(["a"] * len(x), dtype=object), x)
    kept = {}
    for a in x[::7]:
        length = float(np.sqrt((a.astype(float) ** 2).sum()))
        focus = np.argsort(-np.abs(a))[: negatives.FOCUS]
        for share in (1e-6, 0.5, 0.95, 3):
            found = bucket.candidates(a, length, focus, share * length * bucket.longest)
            found = np.arange(len(x)) if found is None else found
            kept[share] = kept.get(share, 0) + len(found)
            assert set(np.flatnonzero(x @ a >= share * length * bucket.longest)) <= set(found.tolist())
    assert kept[0.5] < 0.7 * kept[1e-6] and kept[0.95] < 0.25 * kept[1e-6] and not kept[3]  # an anchor's own cluster, a fifth of the rows, stays


# 12: manifest


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars), as tuples of manifest()."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, t, g, s, n: h(*map(value, (d, s, g, n, t)))
    lower = lambda t: t if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def climb(nodes):
        """The last node, and for each node its (left, right) siblings from level to level."""
        paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            above, above_owners = [], []
            for at in range(0, len(nodes), 16):
                run = nodes[at : at + 16]
                for i in range(len(run)):
                    for o in owners[at + i]:
                        paths[o].append(("".join(run[:i]), "".join(run[i + 1 :])))
                above.append(h(*run))
                above_owners.append([o for i in range(len(run)) for o in owners[at + i]])
            nodes, owners = above, above_owners
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, own = [], {}
    for s in order:
        ranked = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        top, paths = climb([leaf(*r) for r in ranked])
        subs.append(top)
        own[s] = list(zip(ranked, paths))
    root, upper = climb(subs)
    out = []
    for s, sub, over in zip(order, subs, upper):
        for r, path in own[s]:
            path = path + over
            now = leaf(r[0], lower(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(*r)
            for a, b in path:
                now = h(a, now, b)
            out.append((r[0], leaf(*r), sub, root, h(*(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def manifest_of(df):
    tampering = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", {"text": manifest.lower_az(F.col("text"))}, tampering)


@pytest.mark.parametrize("kind", ["hostile", "many sources", "one row", "sixteen"])
def test_manifest_equals_plain_tree(spark, kind):
    texts = [None, "", "Ünïcode Ä Z", "plain", "UPPER\nand lower", "x" * 50_000 + "A"]
    rows = [(i, texts[i % 6], None if i % 4 else "en", "hot" if i % 3 else f"s{i % 7}", i % 11 or None) for i in range(620)]
    rows += [(i, "again", "en", "hot", 1) for i in (5, 5, 5)] + [(None, "No Id", None, None, None), (None, "No Id", None, None, None), (900, "A", "b", None, 3), (901, "q", "b", "", 3)]
    if kind == "many sources":
        rows = [(i, f"Text {i}", "en", f"source {i % 300}", i) for i in range(330)]
    if kind in ("one row", "sixteen"):
        rows = [(i, f"Text {i}", "en", "s", i) for i in range(1 if kind == "one row" else 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("g", "key", "hash", "place", "size", "run", "path", "root")})
    found = manifest_of(df)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_manifest(rows)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())


def test_manifest_of_nothing(spark):
    assert manifest_of(spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")).collect() == []


# 13: benchmark passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def own_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_passages(docs, items):
    strings = {}
    for key, text in items:
        w = own_words(text)
        for i in range(max(1, len(w) - 9)) if w else []:
            strings.setdefault(tuple(w[i : i + 10]), set()).add(key)
    out = []
    for d, text in docs:
        w, hit, names = own_words(text), set(), set()
        for n in {len(s) for s in strings}:
            for i in range(len(w) - n + 1):
                if (s := tuple(w[i : i + n])) in strings:
                    hit |= set(range(i, i + n))
                    names |= {str(k) for k in strings[s] if k is not None}
        spans = [(i, next(j for j in range(i, len(w)) if j + 1 not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((d, len(w), len(hit), spans, sorted(names)))
    return sorted(out, key=str)


def passages():
    rng = random.Random(9)
    vocabulary = ["a", "the", "é", "naïve", "x1", "日本", "word", "another", "long" * 9, "of"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(10, 30))) for i in range(30)]
    items += [(100, "Short one"), (101, "é"), (102, None), (103, "?!"), (104, ""), (None, "nameless " + say(12)), (105, items[0][1]), (105, "Short one"), (106, " ".join(["the"] * 14)), (107, "z" * 3000 + " " + say(15))]
    docs = [(i, say(25)) for i in range(20)]
    for i, (_, t) in enumerate(items):
        docs.append((50 + i, f"{say(8)}, {(t or '').title()}… {say(3)}"))
        docs.append((200 + i, "".join(w + rng.choice([" ", "-", "\n", "'s "]) for w in (t or "").split())))
    docs += [(300, None), (301, ""), (302, "the " * 5000), (303, (say(300) + " " + items[3][1] + " ") * 40), (304, "\x00the\x00 short\tONE"), (301, ""), (None, "short one"), (305, "shortone short ones")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 24, 4000])
def test_passages_equal_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs, items = passages()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("window", "item", "block", "n_hit", "spans")})
    found = decontaminate.find(df, spark.createDataFrame(items, "item_id long, text string"))
    rows = [(r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], r["items"]) for r in found.select("doc_id", "n_words", "n_hit", "spans", "items").collect()]
    assert sorted(rows, key=str) == plain_passages(docs, items)
    assert found.columns == ["doc_id", "window", "item", "block", "n_words", "n_hit", "spans", "items"]


def test_passages_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs, spark.createDataFrame([(1, "a")], items.schema)).collect() == []
    [row] = decontaminate.find(spark.createDataFrame([(1, "some text")], docs.schema), items).collect()
    assert (row.n_words, row.n_hit, row.spans, row["items"]) == (2, 0, [], [])


@pytest.mark.parametrize("name", ["op11_negatives", "op12_manifest", "op13_decontaminate"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        duck.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    theirs = duck.execute(queries.oracle_sql()[name]).df()
    mine = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas()[list(theirs.columns)]
    order = list(theirs.columns)
    assert mine.sort_values(order).astype(str).values.tolist() == theirs.sort_values(order).astype(str).values.tolist()
