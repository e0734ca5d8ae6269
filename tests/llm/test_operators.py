"""The ten operators against brute force, round trips and held-out accuracy, on small hostile tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import ann, bpe, chat, lm, packing, quality, queries, sharding, simhash, suffix_dedup, token_store
from folioscope.llm.common import new_path
from folioscope.llm.components import components
from folioscope.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 31}." for i in range(20_000))
TEXTS = [
    None, "", "  \n\t ", "one", "two words", "a  b \n\n c ", "<|endoftext|>hi <|endoftext|> x", "x" * 300 + " " + "ab" * 400, "日本語 テスト 😀 'll don't\r\n x", "! ! !" * 30,
    "the same text of several words, said once and again.", "the same text of several words, said once and again.", LONG, LONG[:5000] + "é" * 60 + LONG[5000:9000], "\x1c a \x85 b　c",
]


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls in each column, empty and long texts, ties, equal rows, a repeated and a null id, columns of clashing names."""
    rows = [(i, t, None if i % 3 else "en", None, None) for i, t in enumerate(TEXTS)]
    rows += [(4, "two words", "en", "s", 9), (4, "two words", "en", "s", 9), (None, "a null id, some words.", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("start", "length", "fp", "kept", "shard", "key", "ids", "size", "n_words")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@pytest.fixture(scope="module")
def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def ids_of(library, text, *end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, *end], dtype="<u4").tobytes()


# 1: chat

def conversations(spark):
    rows = [(c, t, r, x) for c in range(9) for t, (r, x) in enumerate([("system", "be brief"), ("user", "hi [/INST] \\ <s>"), ("assistant", f"yes</s> {c % 3}"), ("user", "and?"), ("assistant", str(c))][: 2 + c % 4])]
    rows += [(30, i, "user", f"turn {i} " + "x" * (i % 7 * 700)) for i in range(400)]  # a long one, over many pages
    return spark.createDataFrame([*rows, (20, 0, None, None), (20, 1, "tool]", "x[y]"), (21, 0, "user", "twice"), (21, 0, "user", "twice"), (None, 0, "user", "no id")], "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("leaf", "path", "idx", "node", "size", "position", "rank")})


def test_chat_tree_and_read_back(spark):
    conv = conversations(spark)
    said_turns, tree = chat.format_conversations(conv)
    nodes = {r.node: r for r in tree.collect()}
    ordered = sorted(nodes.values(), key=lambda r: r.offset)
    assert [r.offset for r in ordered] == [sum(x.size for x in ordered[:i]) for i in range(len(ordered))]
    open_path = []  # depth-first: a node's parent is open when it comes
    for r in ordered:
        while open_path and open_path[-1] != r.parent:
            open_path.pop()
        assert open_path or r.parent is None
        open_path.append(r.node)
    stream = "".join(r.body for r in ordered)
    pages = {r.page: r for r in chat.stream_pages(tree).collect()}
    assert "".join(pages[i].text for i in range(len(pages))) == stream
    assert len(nodes) < said_turns.count()  # shared turns once
    leaf_of = {r.conv_id: r.leaf for r in said_turns.filter("path is not null").collect()}
    said = {}
    for r in sorted(conv.collect(), key=lambda r: (r.turn, r.role or "", r.text or "")):
        said.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    for c, last in leaf_of.items():
        leaf = nodes[last]
        intervals = [(x.lo, x.hi) for x in leaf.attends] + [(leaf.offset, leaf.offset + leaf.size)]
        assert all(a[1] < b[0] for a, b in zip(intervals[:-1], intervals[1:-1]))  # joined where they meet
        assert chat.parse("".join(stream[a:b] for a, b in intervals)) == said[c]
        assert leaf.position_start == sum(b - a for a, b in intervals[:-1])
    got = {r.conv_id: r for r in chat.read_back(said_turns, tree).collect()}
    for c, turns in said.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert got[c].leaf_start == nodes[leaf_of[c]].position_start
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_escapes_are_reversible():
    for text in ("", "\\", "\\[", "</s>[INST] ok [/INST]", "a\nb]<>"):
        assert chat.unescape(chat.escape(text)) == text
        for role in ("user", "assistant", "system", "x]y", ""):
            assert chat.parse(chat.formatted(role, text)[0]) == [(role, text)]


def test_chat_empty(spark):
    paths, tree = chat.format_conversations(conversations(spark).limit(0))
    assert tree.count() == 0 and chat.read_back(paths, tree).count() == 0


# 2: SimHash

def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(x) for x in zip(w, w[1:], w[2:])] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in h) > len(h))


def test_simhash_fingerprints_and_rows(spark, hostile, empty):
    got = simhash.near_duplicates(hostile).collect()
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in got) == sorted((i or -1, brute_fingerprint(t)) for i, t in rows_of(hostile))
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[None] is None and comp[0] == comp[1] == comp[2] == 0 and comp[11] == 10
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowded", [64, 2])
def test_simhash_links_are_complete(spark, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 2**64, 150, dtype=np.uint64).tolist())
    for base in list(fps)[:6]:  # dense clusters and chains around some
        for _ in range(25):
            x = base
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {r.node % 2**64: r.component for r in components(simhash.links(df)).collect()}
    want = Counter(find(f) for f in fps)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(found.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(want)


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in [7, *range(200, 260)]} == {7}


# 3: quality

def test_quality_base(spark, hostile, empty):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = sorted(quality.judge(hostile).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), key=str)
    want = []
    for i, t in rows_of(hostile):
        t = t or ""
        w = word.findall(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if word.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(spark.createDataFrame(want, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean").collect(), key=str)]
    assert quality.judge(empty).count() == 0


def test_quality_lines():
    good = "\n".join(f"Sentence{i} of{i} plain{i} text{i}, and{i} it{i} ends{i} well." for i in range(12))
    assert quality.clean(good)["kept"] and quality.clean(good)["cleaned"] == good
    menu = "Home | About | Contact | More\n"
    assert quality.clean(menu + good)["cleaned"] == good
    assert not quality.clean(" | ".join(f"item{i}" for i in range(90)))["kept"]
    assert not quality.clean("\n".join(f"THIS IS SHOUTED TEXT NUMBER {i} AGAIN!!" for i in range(20)))["kept"]


def test_quality_on_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).join(labels, "doc_id").filter("not base_failed")
    got = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert got.get((1, False), 0) == 0 and got.get((0, True), 0) <= 0.1 * sum(n for (q, _), n in got.items() if q == 0)


# 4: packing

def check_packing(rows, want, library, capacity):
    ids = {}
    for r in rows:
        ids.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert at <= capacity and {r.padded_tokens for r in s} == {at if at & (at - 1) == 0 else capacity}
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    expected = Counter()
    for i, t in want:
        x = ids_of(library, t, 1)
        for a in range(0, len(x) // 4, capacity):
            n = min(capacity, len(x) // 4 - a)
            expected[i, a, n, zlib.crc32(x[4 * a : 4 * (a + n)])] += 1
    assert pieces == expected


def test_packing(spark, hostile, empty, path, library):
    rows = packing.pack(hostile, path, capacity=2048).collect()
    check_packing(rows, rows_of(hostile), library, 2048)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    check_packing(packing.pack(hostile, path, capacity=64).collect(), rows_of(hostile), library, 64)
    assert packing.pack(empty, path).count() == 0


def test_packing_wastes_little(spark):
    rows = queries.op4_packing(spark, SF).collect()
    taken = sum({r.sequence_id: r.padded_tokens for r in rows}.values())
    assert sum(r.length for r in rows) >= 0.97 * taken


def test_plan_covers_exactly():
    rng = np.random.default_rng(3)
    histogram = Counter(np.minimum(256, rng.geometric(0.02, 3000)).tolist())
    made = packing.plan(dict(histogram), 256)
    assert all(sum(s * n for s, n in p.items()) <= 256 for p, _ in made)
    total = Counter()
    for p, times in made:
        for s, n in p.items():
            total[s] += n * times
    assert total == histogram
    assert sum(t for _, t in made) <= 1.01 * sum(s * n for s, n in histogram.items()) / 256 + 2


# 5: nearest neighbours

def test_ann_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table.collect()}
    got = {}
    for r in queries.op5_ann(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in x if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(abs(f[2] - float(x[q] @ x[f[1]])) < 1e-12 for f in found)
        true = sorted((i for i in x if i != q), key=lambda i: (-float(x[q] @ x[i]), i))[:20]
        hits += len(set(true) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)


def test_ann_exact_is_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 12)) * rng.uniform(0.2, 3, (600, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in ann.search(table, F.col("id") % 20 == 0, k=20, exact=True).orderBy("query_id", "rank").collect()]
    want = [(q, k + 1, i) for q in range(0, 600, 20) for k, i in enumerate(sorted((i for i in range(600) if i != q), key=lambda i: (-float((x[q] * x[i]).sum()), i))[:20])]
    assert got == want


def test_ann_in_large_blocks():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((8000, 24)) * rng.uniform(0.5, 2, (8000, 1))
    scale = float(np.linalg.norm(base, axis=1).max())
    rotation = ann.learn_rotation(base[:2000], scale)
    index, codes = ann.BlockIndex(ann.encode(base, scale, rotation, False)), ann.encode(base[:40], scale, rotation, True)
    wide = codes.view(np.uint64)
    hits = 0
    for i in range(40):
        near = index.near(codes[i], 640)
        distance = np.bitwise_count(index.wide ^ wide[i]).sum(axis=1)
        assert set(near) == set(np.flatnonzero(distance <= np.sort(distance)[639]))  # every code within the radius
        hits += len(set(near.tolist()) & set(np.argsort(-(base @ base[i]))[:20].tolist()))
    assert hits >= 0.9 * 20 * 40


def test_ann_odd_rows(spark, empty):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (20, [-1.0, 0.2]), (20, [-1.0, 0.2]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted(map(tuple, ann.search(table, F.col("id") % 20 == 0, k=20).collect()))
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 2), (20, 2, 0), (20, 3, 1)]
    assert ann.search(table.limit(0), F.col("id") % 20 == 0).count() == 0


# 6: language model

def brute_base(rows):
    tokens = [((i, t), (t or "").encode().lower().split() + [b""]) for i, t in rows]
    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1
    c = Counter(w for (i, _), ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (i, _), ws in tokens)


def test_lm_base_and_rows(spark, hostile, empty):
    got = lm.score(hostile).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute_base(rows_of(hostile))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(empty).count() == 0


def test_lm_held_out_and_groups(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for name in ("CHUNK_BYTES", "BUCKET_BYTES"):
        monkeypatch.setattr(lm, name, 50_000)
    rows = [r for r in lm.score(docs).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.2


LITTLE = ["the cat sat on the mat", "the cat sat on the hat", "the dog ate the cat", "a dog sat", "the cat sat", "", "a cat and a dog and a mat"] * 3


def test_lm_is_the_plain_model(spark, monkeypatch):
    """Scores from the seating that was sampled, by a plain loop; probabilities sum to one in every context."""
    monkeypatch.setattr(lm, "CHUNK_BYTES", 60)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 100)
    monkeypatch.setattr(lm, "SPLIT", 4)
    docs = spark.createDataFrame([(i, t + (" unseen" if i == 0 else "")) for i, t in enumerate(LITTLE)], "doc_id long, text string")
    model = lm.fit(docs)
    t, names = model.totals, {}
    for r in model.chunks.collect():  # numbers back to words, by the texts themselves
        numbers = np.concatenate([lm.unpack(x.a) for x in sorted(model.numbers.filter(F.col("at") == r["at"]).collect(), key=lambda x: x.peer)])
        said = [w for i in np.frombuffer(r.d, dtype="<i8").tolist() for w in [*(LITTLE[i] + (" unseen" if i == 0 else "")).split(), ""]]
        names |= dict(zip(numbers[lm.unpack(r.a)].tolist(), said, strict=True))
    held = {i for i in range(len(LITTLE)) if zlib.crc32(str(i).encode()) % 5 == 1}
    n = Counter((a, b) for i, x in enumerate(LITTLE) if i not in held for w in [x.split() + (["unseen"] if i == 0 else [])] for a, b in zip(["", *w], [*w, ""]))
    sampled = Counter({p: lm.SAMPLES for p, c in n.items() if c == 1})
    for r in model.seats.collect():
        for u, w, count, tables in zip(lm.unpack_sorted(r.a).tolist(), *(lm.unpack(r[x]).tolist() for x in "bcf")):
            assert n[names[u], names[w]] == count and lm.SAMPLES <= tables <= count * lm.SAMPLES
            sampled[names[u], names[w]] = tables
    at_root, of, by_context = {}, {}, {}
    for r in model.samples.collect():
        for i, (c, s, tables, m) in enumerate(zip(*(lm.unpack(r[x]).tolist() for x in "abcd"))):
            word = names[i * t.buckets + r["at"]]
            at_root[r.peer, word], by_context[r.peer, word], of[word] = (c, s), tables, m
    words = {w for _, w in n}
    assert of == {w: sum(c for (a, _), c in n.items() if a == w) for w in of}
    for u in of:
        assert sum(by_context[k, u] for k in range(lm.SAMPLES)) == sum(s for (a, _), s in sampled.items() if a == u)

    def p(u, w):
        total = 0
        for k, (customers, tables) in enumerate(model.of_samples):
            c, s = at_root.get((k, w), (0, 0))
            root = (c - t.root * s + (1 + t.root * tables) / (len(words) + 1)) / (1 + customers)
            total += (1 + t.own * by_context.get((k, u), 0)) * root / lm.SAMPLES
        return (n[u, w] - t.own * sampled[u, w] / lm.SAMPLES + total) / (1 + of.get(u, 0))

    for u in [*words, "never"]:
        assert abs(sum(p(u, w) for w in words) + p(u, "another") - 1) < 1e-12
    for r in lm.score(docs).collect():
        w = LITTLE[r.doc_id].split() + (["unseen"] if r.doc_id == 0 else [])
        assert abs(r.score - sum(math.log10(p(a, b)) for a, b in zip(["", *w], [*w, ""]))) < 1e-9


def test_lm_gibbs_moves_follow_the_posterior():
    """Tables of one dish of five customers, over many moves, against their exact distribution."""
    d, parent, others, n = 0.6, 0.3, 2, 5
    stirling = {(1, 1): 1.0}
    for m in range(1, n):
        for k in range(1, m + 2):
            stirling[m + 1, k] = stirling.get((m, k - 1), 0) + (m - d * k) * stirling.get((m, k), 0)
    weight = [stirling[n, k] * math.prod((lm.STRENGTH + d * (others + j)) * parent for j in range(k)) for k in range(1, n + 1)]
    rng, copies = np.random.default_rng(4), 20_000
    size, at, tables = np.full(copies, n), np.arange(copies), np.full(copies, others + 1)
    t, _ = lm.reseat(rng, size, np.ones(copies, dtype=np.int64), size.copy(), at, tables, np.full(copies, parent), d, moves=60)
    assert (tables == t + others).all()
    got = np.bincount(t, minlength=n + 1)[1:] / copies
    assert np.abs(got - np.array(weight) / sum(weight)).max() < 0.015


# 7: suffixes

def brute_cut(rows):
    seen, out = set(), []
    docs = sorted({(i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    for known, i, _, t in docs:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((str(i) if known else "None", t, len(raw), sum(gone), sum(gone[p] and not (p and gone[p - 1]) for p in range(len(raw))), kept))
    return out


def test_suffixes_against_brute_force(spark, hostile, empty):
    for df in (hostile, spark.read.parquet(f"{SF}/documents.parquet").limit(80)):
        got = {(str(r.doc_id), r.text or ""): (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept").collect()}
        assert got == {(i, t): rest for i, t, *rest in ((a, b, *c) for a, b, *c in brute_cut(rows_of(df))) for rest in [tuple(rest)]}
    assert suffix_dedup.remove_repeats(hostile).count() == hostile.count() and suffix_dedup.remove_repeats(empty).count() == 0


def test_suffixes_planted(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    shared = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(30)) + f" {shared if i % 3 else shared[:150] + 'X' + shared[150:]} " + " ".join(word() for _ in range(30)) for i in range(40)]
    texts += ["aaaa" * 200, "aaaa" * 100, "ab" * 150, shared[:99], shared[:100]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {int(i): (removed, spans, kept) for i, _, _, removed, spans, kept in brute_cut(rows_of(df))}


def test_multikey_order():
    for top in (3, 40, 2**63):
        words = np.random.default_rng(1).integers(0, top, (1500, 4)).astype(np.uint64)
        assert multikey(words) == sorted(range(1500), key=lambda i: (*words[i].tolist(), i))


def multikey(words):
    return suffix_dedup.multikey_order(words).tolist()


# 8: sharding

def test_sharding(spark, hostile, empty):
    sized = hostile.withColumns({c: F.lit("clash") for c in ("_part", "_start", "_rank", "_nth", "slot", "_shard")}).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 16)
    rows = sharding.assign_shards(sized, 5, "doc_id", "size", ties=("text",)).collect()
    assert len(rows) == hostile.count() and rows[0].asDict().keys() == {*sized.columns} and len(rows[0]) == len(sized.columns)
    order = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in order] == [sum(x["size"] for x in order[:i]) for i in range(len(order))]
    assert [r.shard for r in order] == sorted(r.shard for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.assign_shards(empty.withColumn("size", F.lit(1)), 5).count() == 0


def test_shards_are_balanced(spark):
    rows = queries.op8_sharding(spark, SF).collect()
    sizes, total, largest = Counter(), sum(r.size for r in rows), max(r.size for r in rows)
    for r in rows:
        sizes[r.shard] += r.size
    assert all(abs(n - total / 40) <= largest for n in sizes.values())


# 9 and 10: tokens

def test_token_store(spark, hostile, empty, path, library):
    at = new_path(spark, "store-test")
    token_store.write_store(hostile, at, path, end_id=2)
    got = token_store.read_store(spark, at).join(token_store.starts(spark, at), ["part", "block", "nth"]).orderBy("start").collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, ids_of(library, t, 2)) for i, t in rows_of(hostile))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    assert {(r.doc_id, bytes(r.ids)) for r in token_store.fetch(spark, at, [8, 12]).collect()} == {(i, ids_of(library, TEXTS[i], 2)) for i in (8, 12)}
    block = spark.read.parquet(f"{at}/blocks").first()
    raw = spark.read.parquet(f"{at}/dictionary").first()
    assert hashlib.sha256(bytes(raw.dictionary)).hexdigest() == raw.dict_hash == block.dict_hash
    frame = bytes(block.payload[block.offsets[0] : block.offsets[1]])
    assert len(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(raw.dictionary))).decompress(frame)) == 4 * block.n_tokens[0]
    bare = new_path(spark, "store-test")
    token_store.write_store(empty, bare, path)
    assert token_store.read_store(spark, bare).count() == 0 and token_store.starts(spark, bare).count() == 0


def test_bpe_is_the_library(spark, hostile, empty, path, library):
    got = bpe.decode(bpe.encode(hostile, path).withColumn("decoded", F.lit(1)), path).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, ids_of(library, t)) for i, t in rows_of(hostile))
    assert all(r.decoded == library.decode(np.frombuffer(r.ids, dtype="<u4").tolist(), skip_special_tokens=False) for r in got)
    assert bpe.encode(empty, path).count() == 0


def test_encoders_agree_on_documents(spark, path, library):
    texts = [t for _, t in rows_of(spark.read.parquet(f"{SF}/documents.parquet"))]
    want = [ids_of(library, t) for t in texts]
    assert encoder(path).encode(texts) == want and bpe.model(path).encode(texts) == want
    model = bpe.model(path)
    for word in (b"antidisestablishmentarianism" * 3, "naïve😀".encode() * 5, b"\xff\xfe\x00"):
        assert model.merge_long(word) == model.merge_short([word])[0]
