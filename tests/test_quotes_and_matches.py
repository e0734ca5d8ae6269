"""Quotes with misses, fuzzy titles and close matches against plain versions."""

import difflib
import random

from folioscope.functions.answers import norm_words
from folioscope.operators import fuzzy, quotes
from pyspark.sql import functions as F


def page_words(text):
    return [w for w in ("".join(c for c in x if c.isascii() and c.isalnum()) for x in text.lower().split()) if w]


def damaged(rng, words):
    out = []
    for w in words:
        turn = rng.random()
        out += [] if turn < 0.06 else ["zz" + w] if turn < 0.12 else [w, "added"] if turn < 0.18 else [w]
    return out


def test_quotes_with_changed_lost_and_added_words(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)] + ["the", "of", "and"] * 20
    docs = {d: [[rng.choice(vocabulary) for _ in range(120)] for _ in range(6)] for d in range(4)}
    asked, want = [], {}
    for n in range(60):
        d, page, at = rng.randrange(4), rng.randrange(5), rng.randrange(0, 60)
        long = n % 3 == 0
        own = docs[d][page][at:] + docs[d][page + 1][:50] if long else docs[d][page][at : at + 40]
        quote = own[:3] + damaged(rng, own[3:])
        asked.append((n, d, " ".join(quote), None))
        want[n] = (page + 1, at, [page + 1, page + 2] if long else [page + 1])
    asked += [(100, 0, "not here at all in any page of it", None), (101, 0, "word1 word2", None), (102, 1, "A blurb that a model wrote.\n\n" + " ".join(docs[1][2][10:40]), 3), (103, 0, None, None), (104, 9, "of a document unknown", None)]
    want[102] = (3, 10, [3])
    pages = spark.createDataFrame([(d, i, " ".join(p)) for d, ps in docs.items() for i, p in enumerate(ps, 1)], "doc int, page int, text string").select("doc", "page", quotes.plain_words(F.col("text")).alias("words"))
    got = {r.quote_id: (r.page, [tuple(x) for x in r.spans], r.matched) for r in quotes.locate_roughly(spark.createDataFrame(asked, "quote_id int, doc int, quote string, hint_page int"), pages).collect()}
    texts = {d: [page_words(" ".join(p)) for p in ps] for d, ps in docs.items()}
    assert got == {n: f for n, d, q, hint in asked if (f := plain_place(texts.get(d, []), q, hint))}
    right = [n for n, (page, at, over) in want.items() if n in got and got[n][0] == page and got[n][1][0][1] == at and [x[0] for x in got[n][1]] == over]
    assert len(right) >= 0.85 * len(want) and not set(got) - set(want)


def plain_place(pages, quote, hint):
    """One quote on the pages of its document, page after page."""
    if len((quote or "").split()) < 3:
        return None
    order = sorted(range(len(pages)), key=lambda i: (i + 1 != hint, i))
    for attempt, part in enumerate([quote, *[p for p in quote.split("\n\n")[1:] if len(page_words(p)) >= 5]]):
        target, tried = page_words(part), order
        if attempt == 0:
            for n in (14, 10, 7, 5):
                held = [i for i in order if any(pages[i][at : at + len(target[:n])] == target[:n] for at in range(len(pages[i])))]
                if held and len(target[:n]) >= 3:
                    tried = held[:1]
                    break
        scores = {i: max([quotes.extend(pages[i], target, at)[0] for at in quotes.seeds_of(pages[i], target)], default=0) for i in tried}
        page = max(tried, key=lambda i: scores[i], default=None)
        if page is None or not scores[page]:
            continue
        left, spans, total, off = target, [], 0, True
        for hop in range(4):
            if page >= len(pages) or len(left) < (1 if hop == 0 else 5):
                break
            runs = [(quotes.extend(pages[page], left, at), at) for at in quotes.seeds_of(pages[page], left)]
            (hits, last, used), at = max(runs, key=lambda r: r[0][0], default=((0, 0, 0), 0))
            if hits < (3 if off else max(5, min(20, len(left) // 2))):
                break
            spans.append((page + 1, at, last))
            total, left, off, page = total + hits, left[used:], last >= len(pages[page]) - 3, page + 1
        share = 0.6 if len(target) < 12 else 0.25
        if spans and total >= min(len(target), max(3, min(int(share * len(target)), 20))):
            return spans[0][0], spans, total
    return None


def test_walk_steps_over_one_word_on_either_side():
    page = page_words("The effect was reliable (z = -0.30, P = 0.767, d < 0.01) across all temporal conditions")
    assert quotes.aligned(page, page_words("effect was quite reliable z 030 P 0767 d 001 across temporal conditions"), [1]) == (12, 1, 13, 13)
    assert quotes.aligned(page, ["effect", "a", "b", "c", "d", "e", "f", "g"], [1])[0] == 1
    assert quotes.aligned([], ["x"], []) == (0, 0, -1, 0)
    assert quotes.seeds_of(["a", "b", "a", "c"], ["a", "c"]) == [2] and quotes.seeds_of(["a", "b", "a"], ["a", "x"]) == [0, 2]


def test_set_ratio_of_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = ["humor", "humour", "and", "the", "word", "frequency", "effects", "effect", "of", "semantics", "a", "study", "in", "lexical", "decision", "behavioural", "behavioral", "science"]
    titles = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 7))) for _ in range(120)]
    titles += [t + ": " + " ".join(rng.choice(vocabulary) for _ in range(4)) for t in titles[:30]] + ["", None, "Colour", "color", "Colours of the world and its many parts", "colour of the world and its many parts"]
    left = spark.createDataFrame(list(enumerate(titles)), "a long, title string")
    right = spark.createDataFrame(list(enumerate(reversed(titles))), "b long, title string")
    got = {(r.a, r.b) for r in fuzzy.title_set_matches(left, right, "a", "b", top=10_000).collect()}

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y):
                last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j + 1], row[j])
        return row[-1]

    def plain(x, y):
        x, y = set((x or "").lower().split()), set((y or "").lower().split())
        if not x or not y:
            return 0
        s, p, q = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
        if s and (not p or not q):
            return 100
        sp, sq = f"{s} {p}".strip(), f"{s} {q}".strip()
        d = len(p) + len(q) - 2 * lcs(p, q)
        out = [100 - 100 * d / (len(sp) + len(sq))]
        if s:
            out += [200 * lcs(s, v) / (len(s) + len(v)) for v in (sp, sq)]
        return max(out)

    want = {(i, j) for i, x in enumerate(titles) for j, y in enumerate(reversed(titles)) if plain(x, y) >= 90}
    assert got == want and len(want) > len(titles)
    top = fuzzy.title_set_matches(left, right, "a", "b").groupBy("a").count().agg(F.max("count")).first()[0]
    assert top <= 3


def test_close_matches_as_difflib_gives_them(spark):
    rng = random.Random(2)
    pool = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(1, 9))) for _ in range(300)} | {"Psychology", "Psychological Science", "Cognition", "Cognitive Science", "x" * 250})
    asked = ["Psycology", "cognitiv", "abcd", "zzz", "science", "", "cogni", "x" * 230]
    found = fuzzy.close_matches(spark.createDataFrame([(a,) for a in asked] + [(None,)], "value string"), spark.createDataFrame([(p,) for p in pool] * 2 + [(None,)], "match string"))
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.value, []).append(r.match)
    for a in asked:
        want = difflib.get_close_matches(a, pool, 5, 0.6) or [p for p in pool if a.lower() in p.lower()][:5]
        assert got.get(a, []) == want


def test_words_of_both_kinds_agree_on_ascii(spark):
    d = spark.createDataFrame([("A b-c, (D) ... 1.5 =",)], "t string")
    assert d.select(quotes.plain_words(F.col("t")).alias("w")).first().w == d.select(norm_words(F.col("t")).alias("w")).first().w == ["a", "bc", "d", "15"]
