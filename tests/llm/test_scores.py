from __future__ import annotations

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bomlens.llm import context_tree as C
from bomlens.llm import toxicity as X

from ..conftest import SMALL


def brute_ctw(train, texts):
    """Context-tree weighting by recursion over a tree of dictionaries, one binary choice at a time."""
    D = C.DEPTH
    coded = lambda t: [(bytes(D) + t + b"\xff")[i : i + D + 1] for i in range(len(t) + 1)]
    seen = collections.Counter(g for t in train for g in coded(t))

    def count(context, bits):
        """Zeros and ones after the choices ``bits`` in ``context`` (its nearest byte last)."""
        n = [0, 0]
        for g, c in seen.items():
            x = f"{g[-1]:08b}"
            if g[:-1].endswith(context) and x.startswith(bits):
                n[int(x[len(bits)])] += c
        return n

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(context, bits):
        if (context, bits) not in memo:
            own = kt(*count(context, bits))
            below = {g[-2 - len(context) : -1] for g in seen if g[:-1].endswith(context)} if len(context) < D else None
            split = sum(weighted(c, bits)[0] for c in below) if below is not None else None
            pw = own if split is None else math.log((math.exp(own) + math.exp(split)) / 2)
            memo[context, bits] = pw, 1.0 if split is None else math.exp(own - math.log(2) - pw)
        return memo[context, bits]

    def score(text):
        total = 0.0
        for g in coded(text):
            x = f"{g[-1]:08b}"
            for i in range(8):
                p, left = 0.0, 1.0
                for d in range(D + 1):
                    context = g[D - d : D]
                    a, b = count(context, x[:i])
                    w = weighted(context, x[:i])[1] if a + b else (1.0 if d == D else 0.5)
                    p += left * w * (b + 0.5) / (a + b + 1)
                    left *= 1 - w
                total += math.log10(p if x[i] == "1" else 1 - p)
        return total

    return [score(t) for t in texts]


def test_scores_are_those_of_context_tree_weighting(spark):
    docs = [(0, "abracadabra"), (1, "Abra cad"), (2, "cadé"), (3, ""), (4, "zz  q"), (5, "abracad")]
    rows = C.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), F.col("doc_id") >= 4).collect()
    low = {i: t.encode().lower() for i, t in docs}
    want = brute_ctw([low[i] for i in range(4)], [low[i] for i in range(6)])
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["score"] for i in range(6)] == pytest.approx(want, rel=1e-5)
    assert by[5]["bits_per_byte"] == pytest.approx(-want[5] / math.log10(2) / 8, rel=1e-5)


def test_chances_of_all_next_bytes_sum_to_one():
    texts = [b"abracadabra", b"abrasive", b"cadabra"]
    keys, counts = C.counted(C.strings(texts)[0])
    asked = np.concatenate([(keys[i] >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64) for i in (0, 7, 11)])
    keys, counts = C.summed(np.concatenate([keys, asked]), np.concatenate([counts, np.zeros(len(asked), np.int64)]))
    tree = C.Subtree(keys, counts, 0)
    logs = np.zeros(len(keys))
    for bit in range(8):
        tree.weigh(bit)
        logs += tree.chances(bit, np.zeros(1 << bit), np.ones(1 << bit))
    assert (10 ** logs[np.searchsorted(keys, asked)]).reshape(3, 256).sum(1) == pytest.approx([1, 1, 1])


def test_kt_estimate():
    assert C.log_kt(np.array([0.0]), np.array([0.0]))[0] == pytest.approx(0, abs=1e-9)
    # One zero then one one: 1/2 * 1/4.
    assert math.exp(C.log_kt(np.array([1.0]), np.array([1.0]))[0]) == pytest.approx(0.125)
    assert C.log_gamma(np.array([0.5, 3.0, 100.0])) == pytest.approx([math.lgamma(0.5), math.lgamma(3), math.lgamma(100)])


def test_base_scores(spark, odd, nothing):
    held = F.col("doc_id") % 3 == 0
    got = C.score(odd, held).collect()
    docs = [(r["doc_id"], C.words(r["text"])) for r in odd.collect()]
    train = [w for i, w in docs if i is None or i % 3]
    counts = collections.Counter(itertools.chain(*train))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    want = collections.Counter()
    for i, w in docs:
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        want[i, i is not None and i % 3 == 0, len(w) + 1, 1 + sum(x in counts for x in w), n, round(base, 3)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert C.score(nothing, held).count() == 0


def test_kernel_is_the_explicit_one():
    def brute(a, b):
        a, b = f"\0{a}\0", f"\0{b}\0"

        def phi(s):
            out = collections.Counter()
            for i, j, k in itertools.combinations(range(len(s)), 3):
                out[s[i], s[j], s[k]] += X.DECAY ** (k - i + 1)
            return out

        x, y = phi(a), phi(b)
        norm = lambda p: math.sqrt(sum(v * v for v in p.values()))
        return sum(v * y[t] for t, v in x.items()) / norm(x) / norm(y)

    ws = ["idiot", "idxiot", "banana", "ana", "bandana"]
    k = X.Words(ws).kernel(X.Words(ws))
    for i, j in itertools.product(range(5), repeat=2):
        assert k[i, j] == pytest.approx(brute(ws[i], ws[j]))


def test_normal_words():
    assert X.plain("1d10t!") == "idiot" and X.plain("I.D.I.O.T") == "idiot" and X.plain("§") == "" and X.plain("") == ""
    assert "idiot" in X.words("you i d i o t now") and X.words("") == set()
    assert max(map(len, X.parts("x" * 1000))) <= X.PART


def test_toxicity_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(50)] + [(None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = X.learn(odd, labels)
    got = X.score(odd, model)
    assert got.columns.count("score") == 1 and got.count() == 11
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert X.score(nothing, X.learn(nothing, labels.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    folder = SMALL.replace("0.001", "0.01")
    scored = X.op10_string_kernel_toxicity(spark, folder)
    truth = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IS NOT NULL")
    rows = scored.filter("held_out").join(truth, "doc_id").collect()
    caught = sum(r["predicted"] for r in rows if r["toxic"])
    wrong = sum(r["predicted"] for r in rows if not r["toxic"])
    assert caught >= 0.7 * sum(r["toxic"] for r in rows) and wrong <= 0.02 * len(rows)


def test_words_of_a_shared_passage_are_no_evidence():
    passage = [(f"p{i}", 8, 0, 1, 2, 3, 4) for i in range(40)]
    insults = [(f"i{i}", 90, 0, 1, 100 + i % 9, 200 + i, 300 + i) for i in range(30)]
    assert [w for w, *_ in X.without_passages(passage + insults)] == [f"i{i}" for i in range(30)]


def test_only_near_copies_count_once():
    rng = np.random.default_rng(4)
    text = [f"w{i}" for i in rng.integers(0, 300, 200)]
    edited = [*text[:100], "insult", *text[100:]]
    common = [" ".join(f"w{i}" for i in rng.integers(0, 300, 200)) for _ in range(50)]
    half = " ".join(text[:100]) + " " + " ".join(f"v{i}" for i in range(100))
    texts = [" ".join(text), " ".join(edited), half, *common, "", "a b", "a b"]
    of = X.copy_groups([0] * len(texts), np.array([X.signature(t) for t in texts]))
    assert of == [0, 0, *range(2, 55), 54]
    assert X.copy_groups([0, 1], np.array([X.signature(t) for t in texts[:2]])) == [0, 1]
    assert X.copy_groups([], np.zeros((0, X.BANDS * X.BAND))) == []


def test_texts_of_common_words_are_all_learnt_from(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(300)]
    insults = ["zuxqop", "vyrtun", "wozzyp", "quspyt", "nonzov", "ruwwux", "tysnoq", "pyxxor"]
    prose = lambda: " ".join(rng.choice(vocabulary, 60))
    ids = [r[0] for r in spark.range(400).filter(~X.held_out(F.col("id"))).collect()]
    docs = [(i, f"{prose()} {prose()}" if k % 3 else f"{prose()} {insults[k // 3 % 8]} {prose()}", int(k % 3 == 0)) for k, i in enumerate(ids)]
    model = X.learn(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, toxic int"))
    assert all(model.margins(insults) > 0.3) and all(model.margins(vocabulary) < 0.2)
