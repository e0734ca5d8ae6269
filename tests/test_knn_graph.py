"""The neighbour graph against brute force: copies, vectors of zero, and vectors without a finite number."""

import numpy as np

from folioscope.operators import search


def test_copies_tie_by_id_whatever_block_they_are_in(spark):
    """Each vector three times, not of length 1: equal vectors score equal, so the lesser id goes first."""
    base = np.random.default_rng(3).normal(size=(40, 64))
    x = np.concatenate([base, base * 2, base, np.zeros((1, 64)), np.full((1, 64), np.nan)])
    v = spark.createDataFrame([(n, e) for n, e in enumerate(x.tolist())], "chunk_id long, embedding array<double>")
    whole = x[:121]
    length = np.maximum(np.linalg.norm(whole, axis=1), 1e-12)
    sims = np.round(np.clip(whole @ whole.T / np.outer(length, length), 0, None), 12)
    np.fill_diagonal(sims, -1)
    want = {(i, r + 1, j) for i in range(121) for r, j in enumerate(sorted(range(121), key=lambda j: (-sims[i, j], j))[:5])}
    for block in (7, 4096):
        got = {(r.i, r["rank"], r.j) for r in search.knn_graph(v, 5, block).collect()}
        assert got == want


def test_what_reaches_the_bound_is_little_more_than_k():
    """No sort of whole rows: of 4,096 columns in runs, few are scored again, and the result is that of a sort."""
    g = np.random.default_rng(4)
    x, y = g.normal(size=(600, 16)), g.normal(size=(4096, 16))
    i, j, sim = search._nearest(x, y, np.arange(600) + 10_000, np.arange(4096), 8)
    dots = x @ y.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert (j.reshape(600, 8) == np.argsort(-dots, axis=1)[:, :8]).all() and np.allclose(sim.reshape(600, 8), -np.sort(-dots, axis=1)[:, :8])
