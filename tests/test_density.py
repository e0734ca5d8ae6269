"""Density clusters against a plain version on 300 points, with one block of merges and with many."""

import math
import random

import pytest

from folioscope.operators import density, terrain


def points():
    rng = random.Random(5)
    centres = [(0, 0), (4, 0), (0, 4), (5, 5), (9, 1)]
    out = [(x + rng.gauss(0, 0.4 + 0.1 * i), y + rng.gauss(0, 0.4)) for i, (x, y) in enumerate(centres) for _ in range(45)]
    return out + [(rng.uniform(-3, 12), rng.uniform(-3, 8)) for _ in range(75)]


def neighbours(pts, k):
    rows = []
    for i, p in enumerate(pts):
        near = sorted((round(math.dist(p, q), 9), j) for j, q in enumerate(pts) if j != i)[:k]
        rows += [(i, r, j, d) for r, (d, j) in enumerate(near, 1)]
    return rows


def plain(pts, rows, min_size, min_samples):
    """Labels by least member, -1 for noise, by sequential merging and recursion over the tree."""
    core = dict.fromkeys(range(len(pts)), 0.0)
    for i, r, _, d in rows:
        if r <= min_samples - 1:
            core[i] = max(core[i], d)
    edges = sorted({(max(d, core[i], core[j]), min(i, j), max(i, j)) for i, _, j, d in rows})
    tree = {i: (None, [i]) for i in range(len(pts))}  # root: (node, members)
    where = list(range(len(pts)))
    for w, a, b in edges:
        x, y = where[a], where[b]
        if x == y:
            continue
        members = tree[x][1] + tree[y][1]
        tree[x] = ((w, tree[x], tree[y]), members)
        for m in tree[y][1]:
            where[m] = x
        del tree[y]
    roots = [t for t in tree.values() if len(t[1]) >= min_size]
    lam = lambda w: 1 / max(w, 1e-9)

    def best(node, birth, may):
        """(worth, chosen member lists) of the cluster that begins with node."""
        worth, top = 0.0, node
        while True:
            w, left, right = node[0]
            heavy = [c for c in (left, right) if len(c[1]) >= min_size]
            worth += sum(len(c[1]) for c in (left, right) if c not in heavy or len(heavy) != 1) * (lam(w) - birth)
            if len(heavy) != 1:
                break
            node = heavy[0]
        below, chosen = 0.0, []
        if len(heavy) == 2:
            for c in heavy:
                v, sets = best(c, lam(w), True)
                below, chosen = below + v, chosen + sets
        return (worth, [top[1]]) if may and worth >= below else (below, chosen)

    sets = [s for r in roots for s in best(r, 0.0, len(roots) > 1)[1]]
    labels = [-1] * len(pts)
    for n, s in enumerate(sorted(sets, key=min)):
        for m in s:
            labels[m] = n
    return labels


@pytest.mark.parametrize(("k", "block"), [(15, 1 << 20), (15, 40), (4, 1 << 20)])
def test_density_clusters_equal_plain(spark, monkeypatch, k, block):
    monkeypatch.setattr(density, "BLOCK", block)
    pts = points()
    rows = neighbours(pts, k)
    want = plain(pts, rows, 12, 5 if k > 4 else 3)
    assert len(set(want)) > 3 and -1 in want
    chunks = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(pts)], "chunk_id long, embedding array<double>")
    found = {r.chunk_id: r for r in density.density_clusters(chunks, spark.createDataFrame(rows, "i long, rank int, j long, dist double"), 12, 5 if k > 4 else 3).collect()}
    assert [-1 if found[i].noise else found[i].cluster for i in range(len(pts))] == want
    means = {c: [sum(pts[i][a] for i in range(len(pts)) if want[i] == c) / want.count(c) for a in (0, 1)] for c in set(want) - {-1}}
    for i, c in enumerate(want):
        if c == -1:
            assert found[i].cluster == min(means, key=lambda m: (math.dist(pts[i], means[m]), m))


def test_nothing_dense(spark):
    chunks = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "chunk_id long, embedding array<double>")
    graph = spark.createDataFrame([(0, 1, 1, 1.0), (1, 1, 0, 1.0)], "i long, rank int, j long, dist double")
    assert {(r.cluster, r.noise) for r in density.density_clusters(chunks, graph, 3, 2).collect()} == {(-1, True)}
    assert {(r.cluster, r.noise) for r in density.density_clusters(chunks, graph.limit(0), 3, 2).collect()} == {(-1, True)}


@pytest.mark.parametrize(("depth", "block"), [(40, 1 << 20), (25, 20)])
def test_choice_of_clusters_takes_no_round_for_each_level(spark, monkeypatch, depth, block):
    monkeypatch.setattr(density, "BLOCK", block)
    rng, rows = random.Random(8), []
    for level in range(depth):  # the last merge, -2 * depth, is the root; each holds a leaf and the rest
        node, parent = -2 * (depth - level), None if level == 0 else -2 * (depth - level + 1)
        rows += [(node, parent, rng.random() * (level + 1)), (node + 1, node, rng.random())]
    want, under = {}, {}
    for node, parent, stability in sorted(rows, reverse=True):
        below = under.get(node, 0.0)
        takes = stability >= below and parent is not None
        under[parent] = under.get(parent, 0.0) + (stability if takes else below)
        want[node] = takes
    parents = {node: parent for node, parent, _ in rows}

    def top(node):
        return parents[node] and top(parents[node]) or (node if want[node] else None)

    calls, settled = [], density.settled
    monkeypatch.setattr(density, "settled", lambda d: calls.append(1) or settled(d))
    got = density.selected(spark.createDataFrame(rows, "cluster long, parent long, stability double")).collect()
    assert {r.cluster: r.chosen for r in got} == {node: top(node) for node in want} and len({top(n) for n in want}) > 3
    assert len(calls) < 15


def test_neighbours_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    pts = points()[:20]
    graph = spark.createDataFrame(neighbours(pts, 3), "i long, rank int, j long, dist double").mapInPandas(run, "i long, rank int, j long, dist double")
    assert density.reachability(graph, 3).count() > 20 and made.value == 60


def test_blur_mirrors_the_map(spark):
    grid = spark.createDataFrame([(0, 3, 1.0), (5, 5, 2.0)], "gx int, gy int, v double")
    got = {(r.gx, r.gy): r.v for r in terrain.blurred(grid, 6, 1.0).collect()}
    assert abs(sum(got.values()) - 3.0) < 1e-9  # nothing is lost over the borders
    w = terrain.gaussian_weights(1.0)
    fold = lambda i: (i % 12) if i % 12 < 6 else 11 - i % 12
    value = {(0, 3): 1.0, (5, 5): 2.0}
    for x in range(6):
        for y in range(6):
            want = sum(value.get((fold(x + i), fold(y + j)), 0) * w[i + 4] * w[j + 4] for i in range(-4, 5) for j in range(-4, 5))
            assert abs(got.get((x, y), 0.0) - want) < 1e-9
