from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from bomlens.functions import registry, subwords
from bomlens.operators import matching as M


def renamed(r, words):
    """The words in another order, other signs between them, a version, and a letter less in the longest."""
    out = r.sample(words, len(words))
    k = max(range(len(out)), key=lambda i: len(out[i]))
    out[k] = out[k][:2] + out[k][3:]
    return r.choice("-_./").join(out) + f"@{r.randint(1, 9)}.{r.randint(0, 9)}"


def hits(spark, rows, vectorizer):
    e = registry.vectorized(spark.createDataFrame(rows, "block int, file long, component long, text string"), "text", vectorizer)
    near = M.nearest(e, ["block"]).filter("rank = 1 AND file_a = 0").collect()
    return sum(r["component_a"] == r["component_b"] for r in near)


def test_renamed_components_are_found(spark):
    """Other components hold the same letters in another order: learnt vectors find the renamed ones all the same, letters alone don't."""
    r = random.Random(8)
    vocabulary = ["".join(r.choice("aeinrst") for _ in range(r.randint(4, 8))) for _ in range(120)]
    texts = [r.sample(vocabulary, 3) for _ in range(300)]
    rows = [(0, 0, i, " ".join(t)) for i, t in enumerate(texts)] + [(0, 1, i, renamed(r, t)) for i, t in enumerate(texts)]
    rows += [(0, 1, 1000 + i, " ".join("".join(r.sample(w, len(w))) for w in t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "block int, file long, component long, text string")
    model = subwords.register(df.repartition(3), "text")
    learnt, letters = hits(spark, rows, "subwords"), hits(spark, rows, "letters")
    assert learnt > 270 and letters < 150
    again = subwords.learn(df.repartition(5), "text")
    assert np.allclose(model.vectors, again.vectors, atol=1e-6)
    del registry.VECTORIZERS["subwords"]


def test_columns_and_products_are_plain_ones(spark):
    texts = ["AES-128 cbc", "aes", "a", "", None, "sha sha", "ünï-12"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {r["text"]: sorted(r["b"]) if r["b"] is not None else None for r in df.select("text", subwords.buckets(F.col("text")).alias("b")).collect()}
    gram = lambda g: spark.range(1).select(F.pmod(F.xxhash64(F.lit(g)), F.lit(subwords.BUCKETS)).cast("int")).first()[0]
    assert got["aes"] == sorted(map(gram, ["<ae", "aes", "es>", "<aes", "aes>"]))
    assert got["a"] == [gram("<a>")] and got[""] == [] and got[None] is None
    assert got["sha sha"] == sorted(2 * list(map(gram, ["<sh", "sha", "ha>", "<sha", "sha>"])))
    x = np.zeros((len(texts), subwords.BUCKETS))
    for i, t in enumerate(texts):
        for b in got[t] or []:
            x[i, b] += 1
    weight, thin = np.linspace(0.5, 2, subwords.BUCKETS), np.random.default_rng(0).normal(size=(subwords.BUCKETS, 4))
    rows = df.select(subwords.buckets(F.col("text")).alias("columns")).filter(F.size("columns") > 0)
    assert np.allclose(subwords._product(rows, weight, thin), (x * weight).T @ ((x * weight) @ thin))
    model = subwords.Subwords(thin)
    vectors = {r["text"]: r["vector"] for r in model.frame(df, "text").collect()}
    assert vectors[None] is None and vectors[""] is None
    want = x[0] @ thin
    assert np.allclose(vectors["AES-128 cbc"], want / np.linalg.norm(want))


def test_equal_texts_have_equal_vectors(spark):
    """To the last bit, wherever they lie in a batch; else copies of a text are at a distance from each other."""
    rows = spark.createDataFrame([(k, f"large bolt {k % 7} ring") for k in range(400)], "id long, text string").repartition(3)
    vectors = subwords.learn(rows, "text", dimensions=8).frame(rows, "text").collect()
    assert len({(r["text"], tuple(r["vector"])) for r in vectors}) == 7
