from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bomlens.llm import ngram_join as J
from bomlens.llm.components import components


def brute(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_odd_rows(odd, nothing):
    got = J.join(odd).collect()
    assert len(got) == 11
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by.pop(None) == (1, None)
    assert by == {1: (6, 1), 2: (6, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 7), 8: (2, 8), 9: (5, 9)}
    assert J.join(nothing).count() == 0


@pytest.mark.parametrize(("seed", "cell"), [(0, None), (1, None), (1, 4), (2, 3)])
def test_same_components_as_brute_force(spark, monkeypatch, seed, cell):
    if cell:  # nearly all lists are split
        monkeypatch.setattr(J, "CELL", cell)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 30, 120]))]
        for _ in range(rng.choice([1, 2, 25])):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w[at:at] = passage
            docs.append(" ".join(w))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    rows = J.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(docs)


def test_cells_hold_every_pair_of_different_components(spark):
    rng = random.Random(5)
    small = [(9, d, 100, 0, rng.randrange(5)) for d in range(60)]
    want = {(x[1], y[1]) for x in small for y in small if x[1] < y[1] and x[4] != y[4]}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(J, "CELL", 7)
        cut = J._cells(spark.createDataFrame(small, "list long, doc long, n long, pos long, component long"))
        got = {(r["a"], r["b"]) for r in J._across(cut, None).collect()}
        assert len(cut.collect()) > 20
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)))
def test_filters_lose_nothing(a, b):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    both = len(a & b)
    assert J.suffix_bound(x, y, 3) >= both
    assert J.linked(x, y) == bool(both and 100 * both >= 75 * len(a | b))
    if both and 100 * both >= 75 * len(a | b):
        order = sorted(a | b)
        pa, pb = [v for v in order if v in a], [v for v in order if v in b]
        shared = set(pa[: J.prefix_size(len(a))]) & set(pb[: J.prefix_size(len(b))])
        assert shared
        first = min(shared)
        assert J._may_link(len(a), pa.index(first), len(b), pb.index(first))


def test_components(spark):
    n = 40
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (102, 101), (103, 103), (None, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100, 102: 100, 103: 103}
