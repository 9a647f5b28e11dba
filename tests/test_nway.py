from __future__ import annotations

import numpy as np
import pytest

from bomlens.operators import matching as M
from bomlens.operators import nway


def groups(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault((r["project"], r["match"]), []).append((r["file"], r["component"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("few", [0, 10**6])
def test_rounds_give_the_groups_of_pairs_taken_one_by_one(spark, few):
    r = np.random.default_rng(21)
    rows, pairs = [], []
    for p in range(2):
        sizes = r.integers(3, 9, 4)
        here = [(f, c) for f in range(4) for c in range(sizes[f])]
        rows += [(p, f, c, [f"t{k}" for k in r.integers(0, 7, r.integers(0, 5))]) for f, c in here]
        for _ in range(40):
            (f, c), (g, d) = (here[k] for k in r.integers(0, len(here), 2))
            if f != g:
                pairs.append((p, f, c, g, d))
    e = spark.createDataFrame([(p, int(f), int(c), a) for p, f, c, a in rows], "project long, file long, component long, attributes array<string>").repartition(3)
    c = spark.createDataFrame([tuple(map(int, x)) for x in pairs], "project long, file_a long, component_a long, file_b long, component_b long").repartition(3)
    want = groups(M.n_way(e, c, ["project"]))
    got = groups(nway.n_way_rounds(e, c, ["project"], few))
    assert got == want and len(want) > 4


def test_a_chain_of_dependencies_and_no_pairs(spark):
    """Each pair waits for the one before it; the tail of such a chain is left to single tasks."""
    e = spark.createDataFrame([("p", f, c, [f"n{c}", "t"]) for f in range(3) for c in range(6)], "project string, file long, component long, attributes array<string>")
    pairs = [("p", a, c, b, c + k) for a, b in ((0, 1), (1, 2), (0, 2)) for c in range(6) for k in (0, 1) if c + k < 6]
    c = spark.createDataFrame(pairs, "project string, file_a long, component_a long, file_b long, component_b long")
    got = groups(nway.n_way_rounds(e, c, ["project"], 4))
    assert got == groups(M.n_way(e, c, ["project"])) and len(got) == 6 and all(len(g) == 3 for g in got.values())
    assert nway.n_way_rounds(e, c.limit(0), ["project"], 0).count() == 0
    odd = spark.createDataFrame([("p", 0, 0, None), ("p", 1, 0, [None, "x"]), ("p", 2, 0, [])], "project string, file long, component long, attributes array<string>")
    far = spark.createDataFrame([("p", 0, 0, 1, 0), ("p", 1, 0, 2, 0), ("p", 9, 9, 0, 0)], "project string, file_a long, component_a long, file_b long, component_b long")
    assert nway.n_way_rounds(odd, far, ["project"], 0).count() == 0
