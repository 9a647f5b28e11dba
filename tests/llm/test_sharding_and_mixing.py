from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from bomlens.llm import mixing, sharding
from bomlens.llm.shared import written


def test_matrix_has_the_sums():
    m = sharding.communication_matrix([5, 0, 17, 100], [40, 41, 41], 3)
    assert m.sum(1).tolist() == [5, 0, 17, 100] and m.sum(0).tolist() == [40, 41, 41] and (m >= 0).all()


def test_every_matrix_comes_as_often_as_a_uniform_shuffle_makes_it():
    """All matrices with these sums, by the number of shuffles that give them."""
    rows, shards, draws = [2, 3, 1], [3, 3], 12_000
    law = {}
    for cells in itertools.product(*(range(n + 1) for n in rows)):
        m = [(c, n - c) for c, n in zip(cells, rows)]
        if [sum(x) for x in zip(*m)] == shards:
            law[tuple(m)] = math.prod(map(math.factorial, [*rows, *shards])) / math.factorial(sum(rows)) / math.prod(math.factorial(x) for r in m for x in r)
    assert abs(sum(law.values()) - 1) < 1e-12 and len(law) == 6
    seen = Counter(tuple(map(tuple, sharding.communication_matrix(rows, shards, seed).tolist())) for seed in range(draws))
    assert set(seen) == set(law)
    assert sum((seen[m] - draws * p) ** 2 / (draws * p) for m, p in law.items()) < 20.5  # a chance of one in a thousand with five degrees of freedom


def test_large_populations_follow_the_same_law():
    rng = np.random.default_rng(1)
    big = [sharding.hypergeometric(rng, 10**10, 3 * 10**10, 40_000) for _ in range(400)]
    assert abs(np.mean(big) - 10_000) < 20 and 70 < np.std(big) < 105


def test_shards(odd, nothing):
    rows = sharding.deal(odd, 4).collect()
    assert len(rows) == 11
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, by.values())) == [2, 3, 3, 3]
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.deal(nothing, 4).count() == 0


def test_shards_are_uniform_and_repeat(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = ({r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.deal(rows, 8).collect()} for _ in range(2))
    assert a == b
    first = np.bincount([s for d, (s, _) in a.items() if d < 1000], minlength=8)
    assert (abs(first - 125) < 50).all()


def _mixed(docs, **more):
    rows = written(docs.select(F.monotonically_increasing_id().alias("row_id"), "source", mixing.word_count(F.col("text")).alias("size")), "test-mix")
    sources, pieces = mixing.mix(rows, **more)
    return rows, sources, pieces


def test_mix_of_odd_rows(odd):
    rows, sources, pieces = _mixed(odd, block=4)
    size = {r["row_id"]: r["size"] for r in rows.collect()}
    want = {r["source"]: (r["source_size"], r["target"]) for r in sources.collect()}
    assert set(want) == {None, "", "a", "b"}
    total = sum(s for s, _ in want.values())
    assert abs(sum(t for _, t in want.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in want.values())
    taken = {r["row_id"]: r["n"] for r in pieces.groupBy("row_id").agg(F.sum("n_words").alias("n")).collect()}
    of = {r["row_id"]: r["source"] for r in rows.collect()}
    by: dict = {}
    for row, n in taken.items():
        assert 0 < n <= 2 * size[row]
        by[of[row]] = by.get(of[row], 0) + n
    assert all(by.get(s, 0) == int(t) for s, (_, t) in want.items())


def test_mix_of_nothing(nothing):
    _, sources, pieces = _mixed(nothing)
    assert sources.count() == 0 and pieces.count() == 0


def test_pieces_tile_each_pass(spark):
    docs = spark.range(300).select((F.col("id") % 3).cast("string").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 17).cast("int")).alias("text"))
    rows, _, pieces = _mixed(docs, block=8, shard_blocks=16)
    size = {r["row_id"]: r["size"] for r in rows.collect()}
    first: dict = {}
    for r in pieces.filter("epoch = 0").collect():
        first.setdefault(r["row_id"], []).append((r["word_start"], r["n_words"]))
    for row, parts in first.items():
        at = 0
        for s, n in sorted(parts):
            assert s >= at
            at = s + n
        assert at <= size[row]


def test_the_mix_does_not_depend_on_the_split(spark, tmp_path):
    rows = [(i % 50 if i % 7 else None, "w " * (i % 23), "ab"[i % 2] if i % 5 else None) for i in range(400)] + [(3, "x y", "a")] * 40
    got = []
    for k in (1, 9):
        folder = str(tmp_path / str(k))
        spark.createDataFrame(rows, "doc_id long, text string, source string").orderBy(F.rand(k)).repartition(k).write.parquet(f"{folder}/documents.parquet")
        got.append(sorted(map(str, mixing.op8_mixing(spark, folder).collect())))
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_numbered_rows(spark):
    df = spark.createDataFrame([("a", 1), (None, 25), ("b", 10)], "x string, n long")
    got = sorted((str(r["x"]), r["copy"]) for r in mixing.numbered(df, 10).collect())
    assert got == sorted([("a", 0), *((str(None), i) for i in range(25)), *(("b", i) for i in range(10))])


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(100))
