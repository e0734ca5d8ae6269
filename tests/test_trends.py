"""Bursts, newcomers, lead and lag, kNN recall and spans against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from folioscope.operators import search, trends
from folioscope.plans import trends as queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    """Counts of 30 terms over 40 years with a planted burst and a planted lag of three years."""
    rng, rows = random.Random(4), []
    wave = [3 + round(3 * math.sin(y / 2.5)) + rng.randint(0, 1) for y in range(60)]
    for t in range(30):
        for y in range(1980, 2020):
            n = wave[y - 1980 + 10] if t == 0 else wave[y - 1980 + 7] if t == 1 else 30 if t == 2 and 2001 <= y <= 2003 else rng.randint(0, 3) if t < 25 or y > 2010 else 0
            if n:
                rows.append(("keywords", f"term {chr(97 + t)}", f"term {chr(97 + t)}", t, y, n))
    counts = spark.createDataFrame(rows, "dim string, key string, term string, first_seq long, year int, n long")
    corpus = Counter()
    for r in rows:
        corpus[r[4]] += r[5]
    return counts.cache(), spark.createDataFrame(sorted(corpus.items()), "year int, n long").cache(), rows, dict(corpus)


def series(rows):
    by = defaultdict(dict)
    for _, key, _, _, y, n in rows:
        by[key][y] = n
    return by


def test_bursts(made):
    counts, corpus, rows, years = made
    total_n, want = sum(years.values()), {}
    for key, own in series(rows).items():
        total, best = sum(own.values()), None
        for start in sorted(years):
            if start + 2 > max(years) or total < 8:
                break
            papers, seen = (sum(d.get(y, 0) for y in range(start, start + 3)) for d in (years, own))
            expected = total * papers / total_n
            if expected >= 1 and seen > expected and (best is None or (seen - expected) / math.sqrt(expected) > best[1]):
                best = (start, round((seen - expected) / math.sqrt(expected), 2), seen)
        if best:
            want[key] = best
    got = {r.key: (r.from_year, r.z, r.observed) for r in trends.bursts(counts, corpus, top=99).collect()}
    assert got == want and got["term c"][0] == 2001


def test_newcomers(made):
    counts, corpus, rows, years = made
    last = max(years)
    want = [(-sum(n for y, n in own.items() if y > last - 10), -sum(own.values()), k) for k, own in series(rows).items() if min(own) >= last - 15 and sum(own.values()) >= 4]
    got = [r.key for r in trends.newcomers(counts, corpus).orderBy("rank").collect()]
    assert got == [k for *_, k in sorted(want)][:12] and got


def pearson(a, b):
    n = len(a)
    ma, mb = sum(a) / n, sum(b) / n
    va, vb = sum((x - ma) ** 2 for x in a), sum((x - mb) ** 2 for x in b)
    return 0.0 if n < 8 or va <= 1e-12 or vb <= 1e-12 else sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(va * vb)


def test_lead_lag(made, spark):
    counts, corpus, rows, years = made
    words = {f"term {chr(97 + t)}": w for t, w in enumerate(["humor", "memory", "vision", "sleep", "reading"])}
    few = counts.filter("first_seq < 5").replace(words, subset=["key"])
    ys = [y for y in sorted(years) if y >= 1985]
    curves = {}
    for key, own in series(rows).items():
        if key in words:
            share = [own.get(y, 0) / years[y] for y in ys]
            curves[words[key]] = [sum(share[max(0, i - 1) : i + 2]) / len(share[max(0, i - 1) : i + 2]) for i in range(len(share))]
    best = {}
    for a in curves:
        for b in curves:
            if a != b:
                zero = pearson(curves[a], curves[b])
                r, lag = max((pearson(curves[a][: len(ys) - k], curves[b][k:]), -k) for k in range(2, 9))
                if r >= 0.55 and r > zero + 0.08 and (a not in best or (round(r, 2), round(r - zero, 2)) > best[a][2:]):
                    best[a] = (b, -lag, round(r, 2), round(r - zero, 2))
    got = {r.lead: (r.follow, r.lag, r.r, r.gain) for r in trends.lead_lag(few, corpus).collect()}
    assert got == best and got["humor"][:2] == ("memory", 3)


def test_knn_recall(spark):
    v = spark.createDataFrame([(i, f"f{i % 3}", [math.cos(i), math.sin(i)]) for i in range(40)], "chunk_id long, file_path string, embedding array<double>")
    want = {(i, j) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: (-max(0.0, round(math.cos(i - j), 12)), j))[:4]}
    got = {(r.i, r.j) for r in search.knn_graph(v, 4, block=16).collect()}
    assert got == want
    truth, half = search.knn_graph(v, 4).select("i", "j"), search.knn_graph(v, 2).select("i", "j")
    assert {r.recall for r in search.recall(half, truth, "i", "j").collect()} == {0.5}


def test_queries_without_sql_run(spark):
    assert queries.bursts(spark, SF).count() > 0 and queries.newcomers(spark, SF).count() > 0
