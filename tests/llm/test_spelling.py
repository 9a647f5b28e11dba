from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bomlens.llm import spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(docs):
    """Counts of words, one occurrence after another."""
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    """By comparing the two, without making neighbours."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n):
    out = {}
    for w, c in n.items():
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * c else None
        out[w] = [form, None, c, len(near), n[form] if form else None]
    for w, row in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        row[1] = at
    return {(w, *row) for w, row in out.items()}


def test_words_and_groups_agree_with_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, "ÀÉÎÕÜß×÷ÿ ÀÉÎÕÜß×÷ÿ ÀÉÎÕÜß×÷ÿx"), (-5, None), (7, ""), (8, "aaaaa aaaaaa aaaaaa aaaaaa aaaaa aaaaa baaaa " * 3), (9, "x" * 300 + " " + "Ünder" * 40)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = spelling.vocabulary(df)
    n = plain_words(docs)
    assert {tuple(r) for r in found.collect()} == set(n.items())
    assert len(n) > 1000
    rows = [tuple(r) for r in spelling.group_variants(found).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(n) and set(rows) == plain_groups(n)
    assert sum(r[1] is not None for r in rows) > 20


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abß", min_size=1, max_size=7))
def test_neighbourhoods_are_distinct_and_whole(word):
    codes = np.array([[ord(c) for c in word]])
    alphabet = np.array([97, 98, 223])
    of = lambda w: int(spelling.word_hashes(np.array([[ord(c) for c in w]], np.int64))[0]) if w else 0
    got = [int(h) for _, hs, fresh in spelling.neighbourhood(codes, alphabet) for h in hs[fresh]]
    want = {word[:i] + word[i + 1 :] for i in range(len(word))}
    want |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abß"} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abß"}
    want.discard(word)
    assert sorted(got) == sorted(of(w) for w in want)


def test_a_run_of_many_letters_and_long_ways(spark):
    """A word of 20,000 letters, and forms that lead over many words."""
    long = "ab" * 10_000
    rows = [("a" * (5 + k), 3 * 2**k) for k in range(12)] + [(long, 3), (long[:-1], 6), ("zzzzz", 3)]
    got = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert len(got) == len(rows)
    assert all(got["a" * (5 + k)]["root"] == "a" * 16 for k in range(12))
    assert got[long]["form"] == long[:-1] and got[long]["n_near"] == 1 and got["zzzzz"]["root"] == "zzzzz"


def test_odd_and_no_rows(odd, nothing):
    got = {r["word"]: r["n"] for r in spelling.vocabulary(odd).collect()}
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got == plain_words(docs)
    assert spelling.group_variants(spelling.vocabulary(nothing)).count() == 0


@pytest.mark.parametrize("size", [2**16, 2**20])
def test_the_filter_holds_every_word(spark, size):
    words = [f"w{'abcde'[i % 5]}{'fghij'[i // 5 % 5]}{'klmno'[i // 25 % 5]}" for i in range(125)]
    seen = spelling.word_filter(spark.createDataFrame([(w,) for w in words], "word string"), size // 32)
    assert len(seen) * 8 == size
    h = np.array([int(spelling.word_hashes(np.array([[ord(c) for c in w]]))[0]) for w in words], np.uint64)
    assert len(spelling._passing(h, seen)) == len(words)
