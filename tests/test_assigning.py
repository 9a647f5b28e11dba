from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from bomlens.operators import assigning as A
from bomlens.operators.matching import FORBIDDEN, assign


def proven(i, j, c, n, m, at, u, v):
    """Prices prove that no matching of as many edges costs less."""
    assert np.all(c - u[i] - v[j] > -1e-6)
    least = {}
    for x, y, z in zip(i.tolist(), j.tolist(), c.tolist()):
        least[x, y] = min(z, least.get((x, y), np.inf))
    taken = [(x, y) for x, y in enumerate(at.tolist()) if y >= 0]
    assert len({y for _, y in taken}) == len(taken)
    assert all(abs(least[x, y] - u[x] - v[y]) < 1e-6 for x, y in taken)
    return sum(least[e] for e in taken), len(taken)


@pytest.mark.parametrize("share", [0.05, 0.3, 1.0])
def test_matchings_are_those_of_the_dense_solver(share):
    r = np.random.default_rng(int(share * 100))
    for _ in range(60):
        n, m = r.integers(1, 14, 2)
        there = r.random((n, m)) < share
        i, j = np.nonzero(there)
        c = r.random(len(i)) * 30
        size = max(n, m)
        dense = np.full((size, size), FORBIDDEN)
        dense[i, j] = c
        want = assign(dense)[:n]
        real = [(x, y) for x, y in enumerate(want) if y < m and dense[x, y] < FORBIDDEN]
        at, u, v = A.match_edges(i, j, c, n, m)
        got = [(x, y) for x, y in enumerate(at.tolist()) if y >= 0]
        assert len(got) == len(real)
        assert sum(dense[e] for e in got) == pytest.approx(sum(dense[e] for e in real))
        if share == 1.0:  # costs are distinct, and so is the best matching
            assert got == real
            proven(i, j, c, n, m, at, u, v)


def test_whole_numbers_and_ties():
    r = np.random.default_rng(4)
    for _ in range(40):
        n, m = r.integers(2, 9, 2)
        c = r.integers(0, 4, (n, m)).astype(float)
        i, j = (x.ravel() for x in np.indices((n, m)))
        size = max(n, m)
        dense = np.full((size, size), FORBIDDEN)
        dense[:n, :m] = c
        want = sum(c[x, y] for x, y in enumerate(assign(dense)[:n]) if y < m)
        at, u, v = A.match_edges(i, j, c.ravel(), n, m)
        assert proven(i, j, c.ravel(), n, m, at, u, v) == (want, min(n, m))


def test_twenty_thousand_components_of_two_documents():
    """Candidates alone, 20 for each component; the prices prove the matching, where a matrix would take 3.2 GB."""
    r = np.random.default_rng(7)
    n = 20_000
    i, near = np.repeat(np.arange(n), 20), r.normal(0, 40, 20 * n).astype(np.int64)
    j = (i + near) % n
    c = np.abs(near) * 0.01 + r.random(len(i))
    began = time.monotonic()
    at, u, v = A.match_edges(i, j, c, n, n)
    assert time.monotonic() - began < 120
    total, size = proven(i, j, c, n, n, at, u, v)
    assert size > 0.99 * n and total > 0


def test_documents_and_their_parts(spark):
    r = np.random.default_rng(3)
    rows = [(p, a, int(x), b, int(y), float(np.round(r.random() * 40, 6))) for p in ("p", "q") for a, b in ((0, 1), (1, 0), (0, 2)) for x, y in r.integers(0, 9, (25, 2))]
    rows += [("p", 5, 1, 6, 2, None), ("p", 5, 3, 6, 4, 30.0), ("p", 5, 3, 6, 5, 31.0)]
    pairs = spark.createDataFrame(rows, "project string, file_a int, component_a long, file_b int, component_b long, cost double").repartition(5)
    one = A.assignment(pairs, ["project"]).collect()
    two = A.assignment(pairs, ["project"], split=True).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    want = {}
    for p, a, x, b, y, c in rows:
        if c is not None:
            g = want.setdefault((p, a, b), {})
            g[x, y] = min(c, g.get((x, y), np.inf))
    for key, g in want.items():
        xs, ys = (sorted({e[k] for e in g}) for k in (0, 1))
        size = max(len(xs), len(ys))
        dense = np.full((size, size), FORBIDDEN)
        for (x, y), c in g.items():
            dense[xs.index(x), ys.index(y)] = c
        at = assign(dense)
        real = {(xs[k], ys[at[k]]): dense[k, at[k]] for k in range(len(xs)) if at[k] < len(ys) and dense[k, at[k]] <= 25}
        assert {(r["component_a"], r["component_b"]): r["cost"] for r in one if (r["project"], r["file_a"], r["file_b"]) == key} == real
    assert A.assignment(pairs.limit(0), ["project"]).count() == 0
    assert A.assignment(pairs.filter(F.lit(False)), ["project"], split=True).count() == 0
