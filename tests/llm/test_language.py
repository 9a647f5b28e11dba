from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bomlens.llm import language as lg


def plain(net, body):
    """Probabilities of one text, place by place."""
    total, out = max(1, len(body)), np.zeros(len(net.names))
    for s in range(0, len(body), lg.WINDOW):
        pooled = np.full(len(net.bias), -np.inf)
        for t in range(s, s + lg.WINDOW):
            seen = [net.embedding[body[t + o]] if t + o < len(body) else np.zeros(lg.DEPTH) for o in range(lg.WIDEST)]
            pooled = np.maximum(pooled, np.concatenate(seen) @ net.filters + net.bias)
        z = np.maximum(pooled, 0) @ net.weights + net.offset
        z = np.exp(z - z.max())
        out += z / z.sum() * min(lg.WINDOW, len(body) - s) / total
    return out


def test_texts_agree_with_a_plain_network(spark):
    net = lg.Network.start(["de", "en", "fr"], 3)
    texts = ["a", "Straße und Wege", "word " * 200, "é" * 128 + "x", "x" * 256, "x" * 257, None, "", "123 !?", "日本語"]
    got = lg.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), net).collect()
    for r in got:
        t = texts[r["doc_id"]]
        if t is None or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            p = plain(net, t.encode())
            assert r["lang_pred"] == net.names[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-5
    assert len(got) == len(texts)


def test_filters_see_their_width_alone():
    net = lg.Network.start(["a", "b"])
    shape = net.filters.reshape(lg.WIDEST, lg.DEPTH, -1)
    for k, w in enumerate(np.repeat(lg.WIDTHS, lg.FILTERS)):
        assert np.all(shape[:w, :, k] != 0) and np.all(shape[w:, :, k] == 0)


def test_gradients_are_slopes():
    r = np.random.default_rng(1)
    net = lg.Network.start(["a", "b", "c"], 5)
    for a in ("embedding", "filters", "bias", "weights", "offset"):
        setattr(net, a, getattr(net, a).astype(np.float64))
    net.bias += 0.3
    symbols = r.integers(97, 110, (6, lg.WINDOW + lg.WIDEST - 1))
    y = np.array([0, 1, 2, 0, 1, 2])
    _, grads = net.gradients(symbols, y)
    for array, g in zip(net.arrays(), grads):
        some = np.argwhere(np.abs(g) > 1e-4)[:: max(1, (np.abs(g) > 1e-4).sum() // 5)]
        for at in map(tuple, some):
            was, e = array[at], 1e-6
            array[at] = was + e
            up = net.gradients(symbols, y)[0]
            array[at] = was - e
            down = net.gradients(symbols, y)[0]
            array[at] = was
            assert (up - down) / (2 * e) == pytest.approx(g[at], rel=2e-2, abs=1e-5)


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = lg.learn(docs.select("doc_id", "text", "lang"))
    assert net.names == ["de", "en", "es", "fr"]
    got = lg.predict(docs.select("doc_id", "text", "lang"), net).filter(lg.held_out(F.col("doc_id"))).filter("lang_pred <> 'und'")
    n, right = got.count(), got.filter("lang = lang_pred").count()
    assert n > 200 and right / n > 0.95
    # Languages of held-out rows are never learnt from.
    other = docs.select("doc_id", "text", F.when(lg.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")).alias("lang"))
    again = lg.learn(other)
    assert again.names == net.names and all(np.array_equal(x, y) for x, y in zip(net.arrays(), again.arrays()))


def test_odd_and_no_rows(odd, nothing):
    net = lg.learn(odd)
    got = lg.predict(odd, net)
    assert got.count() == odd.count()
    assert set(got.columns) == {*odd.columns, "lang_pred"} - {"text"}
    assert {r["lang_pred"] for r in got.collect()} <= {"en", "fr", "und"}
    empty = lg.learn(nothing)
    assert empty.names == [] and lg.predict(nothing, empty).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in lg.predict(odd, empty).collect()} == {("und", 0.0)}


def test_the_end_of_a_long_text_counts(spark):
    net = lg.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang"))
    start, rest = "the house and the garden of the man " * 40, "les maisons et les jardins de la ville où nous étions hier soir " * 400
    got = lg.predict(spark.createDataFrame([(1, start), (2, start + rest)], "doc_id long, text string"), net).collect()
    scores = {r["doc_id"]: r for r in got}
    assert scores[2]["lang_pred"] != scores[1]["lang_pred"] or abs(scores[2]["score"] - scores[1]["score"]) > 1e-6
