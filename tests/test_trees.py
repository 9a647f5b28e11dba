from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bomlens.operators import trees as T
from bomlens.operators.matching import assign

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=2), c, max_size=3), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_parse_is_that_of_the_standard_library(value):
    for text in (json.dumps(value), json.dumps(value, indent=2, ensure_ascii=False)):
        assert T.parse(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a":}', '{"a" 1}', "{} x", "[1 2]", "nul", '{"a":1,}', '{,}', "]", "01", '{"a":1 "b":2}', "[", '"a', "[}", '{"a":[}'])
def test_parse_refuses(text):
    with pytest.raises(ValueError):
        T.parse(text)
    assert T.Tree.read(text) is None and T.Tree.read(None) is None


def small(r: random.Random, room: int):
    """A random document of at most ``room`` nodes."""
    kind = r.choice("oavv") if room > 2 else "v"
    if kind == "v":
        return r.choice(["a", "ab", "b", 1, None])
    out: list = []
    room -= 1
    while room > 0 and r.random() < 0.8:
        least = 2 if kind == "o" else 1
        if room < least:
            break
        share = r.randint(1, room - least + 1)
        child = small(r, share)
        size = len(T.Tree.of(child).kind)
        out.append(child)
        room -= size + (kind == "o")
    return {f"{'kx'[i % 2]}{i}": c for i, c in enumerate(out)} if kind == "o" else out


def every_mapping(a: T.Tree, b: T.Tree) -> float:
    """The least cost of all mappings that keep kinds, ancestors, disjoint subtrees and the order of items of arrays."""

    def above(t):
        parent = {c: i for i, cs in enumerate(t.children) for c in cs}
        paths = []
        for i in range(len(t.kind)):
            path, at = [i], i
            while at in parent:
                at = parent[at]
                path.append(at)
            paths.append(path)
        lca = [[next(x for x in paths[i] if x in paths[j]) for j in range(len(paths))] for i in range(len(paths))]
        return paths, lca

    up_a, low_a = above(a)
    up_b, low_b = above(b)
    proper = lambda up, x, y: x != y and x in up[y]  # noqa: E731  x is above y

    def fits(m):
        i, j = m[-1]
        for p, q in m[:-1]:
            if proper(up_a, p, i) != proper(up_b, q, j) or proper(up_a, i, p) != proper(up_b, j, q):
                return False
            x, y = low_a[p][i], low_b[q][j]
            if x not in (p, i) and a.kind[x] == b.kind[y] == T.ARRAY and (p < i) != (q < j):
                return False
        for (p, q), (r, s) in itertools.combinations(m, 2):
            for u, v in m:
                if proper(up_a, low_a[p][r], u) != proper(up_b, low_b[q][s], v):
                    return False
        return True

    best = len(a.kind) + len(b.kind)

    def go(i, m, cost):
        nonlocal best
        if i == len(a.kind):
            best = min(best, cost + len(a.kind) + len(b.kind) - 2 * len(m))
            return
        go(i + 1, m, cost)
        used = {q for _, q in m}
        for j in range(len(b.kind)):
            if j not in used and a.kind[i] == b.kind[j]:
                m.append((i, j))
                if fits(m):
                    go(i + 1, m, cost + T.rename(a.kind[i], a.label[i], b.label[j]))
                m.pop()

    go(0, [], 0.0)
    return best


def test_distances_are_those_of_all_mappings():
    r = random.Random(5)
    seen = 0
    for _ in range(400):
        a, b = (T.Tree.of(small(r, 7)) for _ in range(2))
        got = T.tree_distance(a, b)
        assert got == pytest.approx(every_mapping(a, b)), (a, b)
        assert got == pytest.approx(T.tree_distance(b, a))
        seen += len(a.kind) >= 5 and len(b.kind) >= 5
    assert seen > 40
    # Nodes with several children go, and their children move up.
    of = lambda x: T.Tree.of(x)
    assert T.tree_distance(of([[1, 2, 3]]), of([1, 2, 3])) == 1
    assert T.tree_distance(of({"a": 1, "b": 2}), of([1, 2])) == 4
    assert T.tree_distance(of({"a": 1, "b": 2}), of({"b": 2, "a": 1})) == 0
    assert T.tree_distance(of([1, 2]), of([1, 2, 3])) == 1
    assert T.tree_distance(of({"a": 1}), of({"a": 1, "b": 2})) == 2
    assert T.tree_distance(of("kitten"), of("sitting")) == pytest.approx(0.5 + 3 / 9)  # labels of strings hold their quotes


def algorithm(name, oid):
    return {"type": "cryptographic-asset", "name": name, "cryptoProperties": {"assetType": "algorithm", "oid": oid}}


def secret(part):
    return {"type": "cryptographic-asset", "name": f"secret-key@{part}", "cryptoProperties": {"assetType": "related-crypto-material", "relatedCryptoMaterialProperties": {"type": "secret-key"}}}


#: Two documents' components and their known costs (fixed values).
LEFT = [algorithm("hmacsha", "1.3.6.1.5.5.8.1.2"), algorithm("sha-256", "2.16.840.1.101.3.4.2.1"), algorithm("des", "1.3.36.3.1.1"), algorithm("aes", "2.16.840.1.101.3.4.1"), algorithm("blowfishecb", "1.3.6.1.4.1.3029.1.1.1")]
RIGHT = [secret(p) for p in ("5c9d2f9f-cefc-4fbd-8849-8f9038da256c", "c5796023-de63-44bb-9dd4-e24811bd555e", "614ff692-7b48-4614-9030-f03f969d66d7", "63b2009d-a74a-4d6f-ba09-9447ee77ce43", "15ed5e21-a2df-48d9-999e-b896ce127066")]
KNOWN = {(3, 0): 7.179294990723562, (2, 1): 7.106938775510204, (4, 2): 7.166462585034013, (0, 3): 7.14453276047261, (1, 4): 7.105238095238095}


def test_known_costs():
    """All five costs agree. Which partners are chosen differs by less than one in all: the known ones are best for costs cut to whole numbers,
    ours for exact ones."""
    cost = np.array([[T.tree_distance(T.Tree.of(x), T.Tree.of(y)) for y in RIGHT] for x in LEFT])
    for at, c in KNOWN.items():
        assert cost[at] == pytest.approx(c, abs=1e-12)
    ours = assign(cost)
    assert cost[range(5), ours].sum() <= sum(KNOWN.values()) < cost[range(5), ours].sum() + 1
    whole = np.floor(cost)
    assert whole[range(5), assign(whole)].sum() == sum(int(c) for c in KNOWN.values())


def test_documents_five_thousand_levels_deep():
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    t = T.Tree.read(deep)
    assert len(t.kind) == 10_001
    assert T.tree_distance(t, T.Tree.of({"a": 1})) == 2 * 4999
    assert T.tree_distance(T.Tree.of([1, {"a": 2}]), T.Tree.read("[" * 5000 + "1" + "]" * 5000)) == 4999 + 3


def test_other_costs():
    costs = T.Costs(delete=2.0, insert=3.0, rename=lambda kind, a, b: 0.25 * (a != b), least=0.25)
    of = T.Tree.of
    assert T.tree_distance(of([1, 2]), of([1, 3, 4]), costs) == 3.25
    assert T.tree_distance(of([1, 2, 3]), of([]), costs) == 6


def test_lower_bounds_and_pairs_in_reach(spark):
    r = random.Random(6)
    texts = [json.dumps(small(r, 9)) for _ in range(40)] + ["{bad", None, json.dumps({"a": ["x", "x", "y"]}), json.dumps({"a": ["x", "y", "y"]})]
    e = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("profile", T.tree_profile("text"))
    pairs = e.select(F.col("id").alias("i"), F.col("text").alias("x"), F.col("profile").alias("x_profile")).join(e.select(F.col("id").alias("j"), F.col("text").alias("y"), F.col("profile").alias("y_profile")), F.col("i") < F.col("j"))
    bound = {(r["i"], r["j"]): r["b"] for r in pairs.select("i", "j", T.lower_bound(F.col("x_profile"), F.col("y_profile")).alias("b")).collect()}
    exact = {(i, j): T.tree_distance(T.Tree.read(texts[i]), T.Tree.read(texts[j])) for i in range(len(texts)) for j in range(i + 1, len(texts)) if T.Tree.read(texts[i]) and T.Tree.read(texts[j])}
    assert all(bound[k] <= c + 1e-9 for k, c in exact.items())
    assert bound[42, 43] == 0.5
    got = {(r["i"], r["j"]): r["cost"] for r in T.tree_pairs(pairs, "x", "y", 3.0).collect()}
    assert got == pytest.approx({k: c for k, c in exact.items() if c <= 3.0})
    assert sum(b > 3.0 for b in bound.values() if b is not None) > 100


def test_pairs_that_differ_in_one_label_need_no_distance(spark, monkeypatch):
    """Their costs are those of the exact distance, which is only computed for the others, with either cost model."""
    import json

    r = random.Random(11)
    base = {"components": [{"type": "library", "name": "n1", "v": [1, 1, 2]}, {"type": "library", "name": "n1"}]}
    texts = []
    for _ in range(60):
        doc = json.loads(json.dumps(base))
        for _ in range(r.randint(0, 2)):
            doc["components"][r.randint(0, 1)][r.choice(["type", "name"])] = r.choice(["library", "n1", "n2", "a much longer name", "x\0"])
        if r.random() < 0.3:
            doc["components"][0]["v"][r.randint(0, 2)] = r.randint(1, 3)
        texts.append(json.dumps(doc))
    e = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("profile", T.tree_profile("text"))
    side = lambda i, x: e.select(F.col("id").alias(i), F.col("text").alias(x), F.col("profile").alias(f"{x}_profile"))
    pairs = side("i", "x").crossJoin(side("j", "y")).filter("i < j")
    trees = [T.Tree.read(t) for t in texts]
    other = T.Costs(delete=0.4, insert=0.3, rename=lambda kind, a, b: 0.0 if a == b else 0.25 + 0.1 * abs(len(a) - len(b)), least=0.25)
    for costs, threshold in ((T.JSON_COSTS, 0.99), (T.JSON_COSTS, 1.6), (other, 0.6)):
        want = {(i, j): T.tree_distance(trees[i], trees[j], costs) for i in range(60) for j in range(i + 1, 60)}
        got = {(r["i"], r["j"]): r["cost"] for r in T.tree_pairs(pairs, "x", "y", threshold, costs).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items() if v <= threshold + 1e-12} and len(got) > 100
    # Where all pairs differ in one label, none of them is handed to the exact distance.
    monkeypatch.setattr(T, "tree_cost", lambda costs=None: F.udf(lambda x, y: 1 / 0, "double"))
    names = spark.createDataFrame([(k, f'{{"name": "n{k}"}}') for k in range(20)], "id long, text string").withColumn("profile", T.tree_profile("text"))
    side = lambda i, x: names.select(F.col("id").alias(i), F.col("text").alias(x), F.col("profile").alias(f"{x}_profile"))
    assert T.tree_pairs(side("i", "x").crossJoin(side("j", "y")).filter("i < j"), "x", "y", 0.99).count() == 190
