"""Names, spans, peaks and repair on literal values and against plain Python."""

import random

from pyspark.sql import functions as F

from folioscope.functions import names
from folioscope.operators import repair, walks


def test_names_as_written(spark):
    cases = {"WESTON": "Weston", "MCADAM": "McAdam", "MACKAY-HALE": "MacKay-Hale", "O'NEAL": "O'Neal", "VAN DER MOSS": "Van der Moss", "Hale": "Hale", "GPT-5.4": "GPT-5.4", "MC": "Mc", " ": "", "ÉMILE": "ÉMILE"}
    d = spark.createDataFrame(list(cases.items()) + [(None, "")], "a string, b string")
    assert d.filter(names.name_case(F.col("a")) != F.col("b")).count() == 0


def test_surnames(spark):
    text = "By Anna Quorth and Rémy Rodríguez Domínguez, in Tuckerberg"
    cases = {"Quorth": "yes", "Berg": "no", "RodriguezDominguez": "yes", "Al": None, "Hale-Quorth": "yes", "": None, "Zed-Al": None}
    d = spark.createDataFrame([(k, v, text) for k, v in cases.items()] + [(None, None, text), ("Quorth", "no", None)], "a string, b string, t string")
    rows = d.select("a", "b", names.surname_in_text(F.col("a"), F.col("t")).alias("c")).collect()
    assert all(r["b"] == r["c"] for r in rows), rows


def test_json_within(spark):
    d = spark.createDataFrame([(1, 'sure: {"k": 3} ok'), (2, '{"k": 4}'), (3, "{"), (4, None)], "i int, t string")
    assert [r[0] for r in d.orderBy("i").select(F.try_variant_get(names.json_within(F.col("t")), "$.k", "int")).collect()] == [3, 4, None, None]


def test_spans_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Eps"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t \n"]) for _ in range(80)) for _ in range(6)]
    pieces, truth = [], {}
    for i, t in enumerate(texts):
        for j in range(5):
            s = rng.randrange(0, len(t) - 60)
            piece = " ".join(t[s : s + 50].split())
            if piece:
                pieces.append((i, j, piece.upper()))
                places = [(a, b) for a in range(len(t)) for b in range(a + 1, min(len(t), a + 120) + 1) if not t[a].isspace() and not t[b - 1].isspace() and " ".join(t[a:b].split()).lower() == piece.lower()]
                truth[(i, j)] = places[0]
    pieces += [(0, 7, "nowhere at all"), (0, 8, " "), (0, 9, None), (1, 9, texts[1][:70].strip() + " torn out " + texts[1][-70:].strip())]
    found = {(r["doc_id"], r["piece_id"]): (r["s"], r["e"]) for r in repair.located(spark.createDataFrame(pieces, "doc_id int, piece_id int, piece string"), spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert {k: found[k] for k in truth} == truth
    assert found[(0, 7)] == found[(0, 8)] == found[(0, 9)] == (None, None)
    assert found[(1, 9)] == (len(texts[1]) - len(texts[1].lstrip()), len(texts[1].rstrip()))


def test_peaks_keep_their_distance(spark):
    rng = random.Random(5)
    v = {(x, y): round(rng.random(), 3) for x in range(12) for y in range(12)}
    maxima = [(-h, y, x) for (x, y), h in v.items() if h >= 0.12 and 0 < x < 11 and 0 < y < 11 and all(v[x + i, y + j] <= h for i in (-1, 0, 1) for j in (-1, 0, 1))]
    kept = []
    for h, y, x in sorted(maxima):
        if all((((x - a) / 11) ** 2 + ((y - b) / 11) ** 2) ** 0.5 > 0.3 for _, b, a in kept):
            kept.append((h, y, x))
    d = spark.createDataFrame([(x, y, h) for (x, y), h in v.items()], "gx int, gy int, v double")
    assert [(-r["v"], r["gy"], r["gx"]) for r in walks.peaks(d, 12, radius=0.3).orderBy("rank").collect()] == kept
    assert walks.peaks(d.filter("v > 2"), 12).count() == 0


def test_no_station_below_three_hits(spark):
    points = spark.createDataFrame([(1, 0.1, 0.1), (2, 0.2, 0.2)], "chunk_id int, x double, y double")
    hits = spark.createDataFrame([(1, 0.9), (2, 0.8)], "chunk_id int, score double")
    centre, weights = walks.station(hits, points)
    assert centre.count() == 0
    assert [r["signal"] for r in walks.signals(points, centre, weights).collect()] == [0.0, 0.0]


def test_topping_up(spark):
    chunks = spark.createDataFrame([(d, c, 100) for d in range(3) for c in range(5)], "doc int, chunk int, n int")
    few = chunks.filter("doc = 2 and chunk = 4")
    assert sorted((r["doc"], r["chunk"]) for r in repair.topped_up(few, chunks, "doc", "chunk", "n", 450).collect()) == [(0, 0), (0, 1), (0, 2), (0, 3), (2, 4)]
    assert repair.topped_up(chunks, chunks, "doc", "chunk", "n", 450).count() == 15
