"""Near-duplicates of the pipeline against brute force, and recall on planted near copies."""

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import near_copies, simhash

SF = "/root/testdata/sf0.001"


def brute_shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}


def brute_kept(rows):
    sets, root = {i: brute_shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for x, b in enumerate(ids):
        for a in ids[:x]:
            if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return {i for i in ids if find(i) == i}


def planted(seed):
    """Texts of 20 to 200 words with near copies of few and many edits, one large group, chains, copies and short texts."""
    rng = np.random.default_rng(seed)
    bases = [rng.integers(0, 3000, n).tolist() for n in rng.integers(20, 200, 25)]
    texts = [list(b) for b in bases]
    for base in [*bases, *[bases[0]] * 60]:
        now = list(base)
        for _ in range(int(rng.integers(1, 5))):
            now = list(now)
            for at in rng.integers(0, len(now), int(rng.integers(1, 4))):
                now[at] = int(rng.integers(0, 3000))
            texts.append(now)
    out = [" ".join(f"w{x}" for x in t) for t in texts] + ["", "", "w1 w2", "W1  w2", "w1 w2 w3"]
    return {int(i): t for i, t in zip(rng.permutation(len(out)), out)}


@pytest.mark.parametrize("crowded", [32, 2])
def test_all_similar_pairs_meet(spark, crowded, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWDED", crowded)
    rows = planted(crowded)
    docs = spark.createDataFrame([(i, t) for i, t in rows.items()] + [(None, rows[0])], "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in near_copies.keep_one(docs).collect()]
    assert kept.count(None) == 1 and sorted(i for i in kept if i is not None) == sorted(brute_kept(rows))


def test_a_changed_word_in_a_short_text(spark):
    """One word of 100: five of 96 shingles, a similarity of 0.9."""
    words = [f"w{i * i % 997}" for i in range(100)]
    rows = {i: " ".join([*words[: 10 + i], "other", *words[11 + i :]]) for i in range(0, 80, 20)} | {100: " ".join(words)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, SF).collect()] == [0]


def test_repeated_ids_nulls_clashing_columns_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, "another text of id one, of some words"), (2, text), (3, None), (4, ""), (None, text), (5, None)]
    names = ("_text", "id", "hash", "row", "node", "key", "component", "parity")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, text), (1, rows[2][1]), (3, None), (None, text)], key=str)
    assert all(r[c] == c for r in kept.collect() for c in names)
    assert near_copies.keep_one(docs.limit(0)).collect() == []


def test_simhash_stage_links_fingerprints(spark):
    """Texts of near fingerprints are near-duplicates in the pipeline, whatever their shingles' similarity; a text of its own under a repeated id stays."""
    same = " ".join(f"often{i % 7}" for i in range(80))
    texts = [(1, f"{same} {' '.join(f'x{i}' for i in range(20))}"), (2, f"{same} {' '.join(f'y{i}' for i in range(20))}"), (2, "quite another text of that id"), (3, "a third text")]
    one, two = (simhash.fingerprint(t) for _, t in texts[:2])
    assert one != two and bin((one ^ two) & (2**64 - 1)).count("1") <= simhash.RADIUS
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [1, 2, 2, 3]
    alone = docs.filter("doc_id != 2 or text like 'often%'")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, alone, SF).collect()) == [1, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, SF).collect()) == [1, 2, 2, 3]
