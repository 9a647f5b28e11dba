from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from bomlens.operators import matching as M
from bomlens.operators import neighbours as N


def rows_of(df):
    return sorted((r["project"], r["file_a"], r["component_a"], r["file_b"], r["component_b"], r["rank"], r["distance"]) for r in df.collect())


@pytest.mark.parametrize("clustered", [True, False])
def test_large_blocks_give_the_neighbours_of_one_group(spark, clustered):
    r = np.random.default_rng(4)
    rows = []
    for p, n in (("big", 330), ("bigger", 500), ("small", 30), ("alone", 1)):
        centre = r.normal(0, 20, (6, 5))
        for c in range(n):
            x = centre[c % 6] + r.normal(0, 0.5, 5) if clustered else r.normal(0, 1, 5)
            rows.append((p, int(c % 4), c, [float(v) for v in np.round(x, 1)]))
    rows += [("big", 3, 1000 + c, [1.0] * 5) for c in range(40)] + [("big", 0, 2000, [1.0] * 5), ("big", 0, 2001, None)]  # many equal vectors, of one file nearly
    e = spark.createDataFrame(rows, "project string, file long, component long, vector array<double>").repartition(3)
    want = rows_of(M.nearest(e, ["project"]))
    assert rows_of(N.nearest_in_chunks(e, ["project"], chunk=40, pivots=7)) == want
    assert rows_of(N.nearest_in_chunks(e, ["project"])) == want
    assert N.nearest_in_chunks(e.limit(0), ["project"]).count() == 0


def _bytes(spark) -> int:
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return sum(f.stat().st_size for f in folder.glob("knn-*/*"))


def test_small_chunks_write_no_more_than_the_vectors_a_few_times(spark):
    """Vectors without structure visit all chunks; what is written doesn't grow with their number."""
    r = np.random.default_rng(8)
    rows = [("p", int(c % 3), c, r.normal(0, 1, 16).tolist()) for c in range(2000)]
    e = spark.createDataFrame(rows, "project string, file long, component long, vector array<double>").repartition(2)
    before = _bytes(spark)
    got = rows_of(N.nearest_in_chunks(e, ["project"], chunk=16))
    assert _bytes(spark) - before < 12 * 2000 * 16 * 8  # 188 chunks to visit
    assert got == rows_of(M.nearest(e, ["project"]))


def test_equal_vectors_are_searched_once(spark):
    """Many copies of few vectors, in several files, some with the same component's number."""
    r = np.random.default_rng(9)
    some = np.round(r.normal(0, 1, (12, 4)), 1)
    rows = [("p", int(f), int(c), some[i].tolist()) for i, f, c in zip(r.integers(0, 12, 600), r.integers(0, 3, 600), r.permutation(600))]
    e = spark.createDataFrame(rows, "project string, file long, component long, vector array<double>").repartition(3)
    got = rows_of(N.nearest_in_chunks(e, ["project"], chunk=50))
    assert got == rows_of(M.nearest(e, ["project"])) and len(got) == 1800


def test_clusters_visit_few_chunks():
    """The bounds spare clustered vectors the other cells: counted with the geometry that routes them."""
    r = np.random.default_rng(5)
    centre = r.normal(0, 50, (8, 6))
    x = np.concatenate([c + r.normal(0, 0.3, (50, 6)) for c in centre])
    far = np.sqrt(((x[:, None] - centre[None]) ** 2).sum(axis=2))
    own = far.argmin(axis=1)
    radius = np.array([far[own == j, j].max() for j in range(8)])
    found = N.top(x, np.arange(400) % 3, x, np.arange(400) % 3, np.arange(400), 3)
    reach = np.array([f[-1]["distance"] ** 0.5 for f in found])
    visits = (np.maximum(far - radius, (far - far.min(axis=1, keepdims=True)) / 2) <= reach[:, None]).sum(axis=1)
    assert visits.mean() < 1.1
