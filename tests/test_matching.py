from __future__ import annotations

import itertools
import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from bomlens.operators import matching as M
from bomlens.operators.trees import parse


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_assignment_is_optimal(n):
    rng = np.random.default_rng(n)
    for _ in range(5):
        c = rng.random((n, n))
        at = M.assign(c)
        assert sorted(at) == list(range(n))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(c[np.arange(n), at].sum() - best) < 1e-9


def test_bracket_notation():
    assert M.bracket(json.loads('{"type":"a b","n":[1,true,null]}')) == '{\\{\\}{"type":{"ab"}}{"n":{[]{1}{True}{null}}}}'
    assert M.bracket({"a{": [[], {}, "x\\"]}) == '{\\{\\}{"a\\{":{[]{[]}{\\{\\}}{"x\\\\"}}}}'
    assert M.bracket(parse("[" * 5000 + "]" * 5000)) == "{[]" * 5000 + "}" * 5000


def test_chains(spark):
    e = spark.createDataFrame([("0:0", "1:3"), ("0:0", "2:1"), ("0:1", "1:0")], "a string, b string")
    assert {tuple(r) for r in M.chains(e, "a", "b").collect()} == {("0:0", "0:0"), ("1:3", "0:0"), ("2:1", "0:0"), ("0:1", "0:1"), ("1:0", "0:1")}
    assert M.chains(e.limit(0), "a", "b").count() == 0


def test_groups_hold_one_component_of_a_document(spark):
    e = spark.createDataFrame([("p", f, c, [f"n{c}", "t"]) for f in range(3) for c in range(4)], "project string, file long, component long, attributes array<string>")
    pairs = spark.createDataFrame([("p", a, c, b, c) for a, b in ((0, 1), (1, 2), (0, 2)) for c in range(4)], "project string, file_a long, component_a long, file_b long, component_b long")
    got = M.n_way(e, pairs, ["project"]).collect()
    groups: dict = {}
    for r in got:
        groups.setdefault(r["match"], []).append((r["file"], r["component"]))
    assert len(groups) == 4
    for g in groups.values():
        assert len({f for f, _ in g}) == len(g) == 3 and len({c for _, c in g}) == 1


def best_pairs(left, right, cost):
    """The least-cost one-to-one matching by trying all, as pairs."""
    short, long, flip = (left, right, False) if len(left) <= len(right) else (right, left, True)
    best = min(itertools.permutations(long, len(short)), key=lambda p: sum(cost(y, x) if flip else cost(x, y) for x, y in zip(short, p)))
    return [(y, x) if flip else (x, y) for x, y in zip(short, best)]


@pytest.mark.parametrize("pivot", [True, False])
def test_match_groups_are_those_of_all_assignments(spark, pivot):
    rng = np.random.default_rng(8)
    rows = [(p, f, 10 * f + c, float(rng.random())) for p in ("p", "q") for f in range(3) for c in range(2 + (f + (p == "q")) % 3)]
    e = spark.createDataFrame(rows, "project string, file long, component long, x double")
    got = M.match_groups(e, ["project"], F.pow(F.col("x_a") - F.col("x_b"), F.lit(2)), pivot=pivot, threshold=0.2).collect()
    x, label, least = {(p, f, c): v for p, f, c, v in rows}, {}, {}
    for p in ("p", "q"):
        files = {f: [k for k in x if k[:2] == (p, f)] for f in range(3)}
        first = min(files, key=lambda f: (-len(files[f]), f))
        for a, b in itertools.permutations(files, 2):
            if pivot and a != first:
                continue
            for s, t in best_pairs(files[a], files[b], lambda s, t: (x[s] - x[t]) ** 2):
                d = (x[s] - x[t]) ** 2
                if d <= 0.2:
                    old = {label.get(s, s), label.get(t, t)}
                    label |= {n: min(old, key=lambda n: "/".join(map(str, n))) for n in [*label, s, t] if label.get(n, n) in old or n in (s, t)}
                    for n in (s, t):
                        least[n] = min(d, least.get(n, d))
    name = lambda n: "/".join(map(str, n))
    assert {r["node"]: (r["chain"], round(r["cost"], 9)) for r in got} == {name(n): (name(label[n]), round(least[n], 9)) for n in label}


def test_neighbours_and_groups_are_those_of_a_plain_search(spark):
    rng = np.random.default_rng(9)
    rows = [(p, f, 10 * f + c, [f"t{i}" for i in rng.integers(0, 6, 3)], rng.integers(0, 4, 5).tolist()) for p in range(3) for f in range(3) for c in range(4)]
    e = spark.createDataFrame(rows, "project long, file long, component long, attributes array<string>, vector array<int>").repartition(4)
    near = M.nearest(e, ["project"])
    want = set()
    for p, f, c, _, v in rows:
        others = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), g, d) for q, g, d, _, w in rows if q == p and g != f)
        want |= {(p, f, c, g, d, r + 1, float(s)) for r, (s, g, d) in enumerate(others[:3])}
    assert {(r["project"], r["file_a"], r["component_a"], r["file_b"], r["component_b"], r["rank"], r["distance"]) for r in near.collect()} == want
    groups = set()
    for p in range(3):
        sets = {(f, c): set(a) for q, f, c, a, _ in rows if q == p}

        def weight(g):
            every = set().union(*(sets[x] for x in g))
            counts = [sum(a in sets[x] for x in g) for a in every]
            return sum(n * n for n in counts if n > 1) / (9 * len(every))

        parts = [frozenset([x]) for x in sets]
        pairs = {tuple(sorted([(f, c), (g, d)])) for q, f, c, g, d, *_ in want if q == p}
        for x, y in sorted(pairs, key=lambda z: (-weight(z), z)):
            s, t = (next(g for g in parts if z in g) for z in (x, y))
            if s != t and not {f for f, _ in s} & {f for f, _ in t} and weight(s | t) > 0 and weight(s | t) >= weight(s) + weight(t):
                parts = [g for g in parts if g not in (s, t)] + [s | t]
        groups |= {(p, g) for g in parts if len(g) > 1}
    got: dict = {}
    for r in M.n_way(e, near, ["project"]).collect():
        got.setdefault((r["project"], r["match"]), set()).add((r["file"], r["component"]))
    assert {(p, frozenset(g)) for (p, _), g in got.items()} == groups
    late = M.n_way(e, near, ["project"], 0.0).collect()
    assert {(r["project"], r["match"], r["file"]) for r in late} == {(p, -1, -1) for p in range(3)}


def test_chains_of_a_long_path_and_many_links(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(300, 400)] + [tuple(map(int, rng.integers(0, 200, 2))) for _ in range(120)]
    label: dict = {}
    for a, b in edges:
        old = {label.setdefault(a, a), label.setdefault(b, b)}
        label |= {n: min(old) for n, m in label.items() if m in old}
    got = M.chains(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["label"] for r in got} == label


def test_a_slow_project_is_stopped_and_fast_ones_are_not(spark):
    """One project's properties are so many that its pairs take far longer than its limit."""
    slow = [("slow", f, c, [f"t{k}" for k in range(3000)]) for f in range(2) for c in range(150)]
    fast = [(f"fast{p}", f, c, [f"n{c}", "t"]) for p in range(5) for f in range(2) for c in range(3)]
    e = spark.createDataFrame(slow + fast, "project string, file long, component long, attributes array<string>")
    pairs = [("slow", 0, c, 1, d) for c in range(150) for d in range(150)] + [(f"fast{p}", 0, c, 1, c) for p in range(5) for c in range(3)]
    c = spark.createDataFrame(pairs, "project string, file_a long, component_a long, file_b long, component_b long")
    limits = e.select("project").distinct().withColumn("limit_s", F.lit(0.5))
    got = M.n_way(e, c, ["project"], limits=limits).collect()
    assert [(r["match"], r["file"]) for r in got if r["project"] == "slow"] == [(-1, -1)]
    assert sorted((r["project"], r["match"], r["file"]) for r in got if r["project"] != "slow") == [(f"fast{p}", m, f) for p in range(5) for m in range(3) for f in range(2)]
