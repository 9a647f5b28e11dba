from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bomlens.llm import token_alignment as ta
from bomlens.llm.shared import shared_path, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "\n", "a", " a ", "a  b\n\n c\t\td", "naïve café — 日本語テキスト 한국어 <|endoftext|> x\x00y", "a ▁ b", "▁", "<s> </s> <unk> <0x0A> [INST]", "x  y　 z  w\u0085 v", "😀👩‍👩‍👧 ok", "é 가", "don't we'll  I'M\r\n\x1c q", "ab " * 3000, "x" * 5000]


class Plain:
    """Whole texts, one at a time, with dictionaries."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)

    def groups(self, text):
        if not text:
            return []
        ids_a = self.a.encode(" " + text, add_special_tokens=False).ids
        ids_b = self.b.encode(text)
        bytes_a = [bytes(ta.BYTE_OF[c] for c in self.a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return []
        out, i, j, x, y, at_i, at_j = [], 0, 0, 0, 0, 0, 0
        while i < len(ids_a):
            x, i = x + len(bytes_a[i]), i + 1
            while y < x:
                y, j = y + len(bytes_b[j]), j + 1
            if x == y:
                out.append((ids_a[at_i:i], ids_b[at_j:j]))
                at_i, at_j = i, j
        return out


def expected(texts):
    plain = Plain()
    groups = [plain.groups(t) for t in texts]
    n = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    best = Counter()
    for (_, b), c in n.items():
        best[b] = max(best[b], c)
    rows = []
    for g in groups:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        links = [(a[-1], b[-1]) for a, b in g]
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(n[x] == best[x[1]] for x in links), sum(n[x] for x in links), text))
    return rows, n


def test_whole_texts_agree_with_brute_force(spark):
    texts = TEXTS + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    files = ta.link_counts(df, A, B)
    rows, n = expected(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in ta.align(df, A, B, files).collect()}
    assert got == dict(enumerate(rows))
    assert {(r["a_id"], r["b_id"]): r["n"] for r in files.pairs(spark).collect()} == dict(n)
    zero = {t for t, r in zip(texts, rows) if not r[0]}
    assert zero == {None, "", "a ▁ b", "▁"}
    sha = spark.createDataFrame([(rows[4][-1],)], "groups string").select(F.sha2("groups", 256)).first()[0]
    assert sha == hashlib.sha256(rows[4][-1].encode()).hexdigest()


@pytest.fixture(scope="module")
def both():
    return ta.Aligner(A, B), Plain()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t\r\x00\x1c \u0085 　'sabcABC01.,é日😀▁́<|endoftext>s/")), max_size=30), min_size=1, max_size=4))
def test_pieces_in_a_row_are_whole_texts(both, texts):
    al, plain = both
    texts = [t for t in texts if t]
    if not texts:
        return
    raw = [(" " + t).encode() for t in texts]
    slot, first = al.batch(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    spelt = al.have.text.take(ta.pa.array(slot)).to_pylist()
    for k, t in enumerate(texts):
        want = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain.groups(t))
        assert "".join(spelt[first[k] : first[k + 1]]).removesuffix(";") == want


def test_files_of_counts(spark):
    """A key of every second row, keys of one B id over several ranges, and keys that no file holds."""
    rows = [(7 << 32 | 5, 3)] * 500 + [(7 << 32 | k, 1) for k in range(300)] + [(k << 32 | 1, k) for k in range(1, 40)]
    partial = spark.createDataFrame(rows, "key long, n long").repartition(7)
    files = ta.write_counts(partial, shared_path(spark, "links"))
    want = Counter()
    for k, n in rows:
        want[k] += n
    keys = np.array([*want, 9 << 40, 0], np.int64)
    assert files.counts(keys).tolist() == [*want.values(), 0, 0]
    assert len(files.shards) > 1 and sum(s[1] for s in files.shards) == len(want)
    assert files.best[7] == 1501 and files.best[39] == 39
    assert sorted((r["b_id"] << 32 | r["a_id"], r["n"]) for r in files.pairs(spark).collect()) == sorted(want.items())


def test_odd_and_no_rows(odd, nothing):
    rows, _ = expected([r["text"] for r in odd.collect()])
    got = ta.align(odd, A, B, ta.link_counts(odd, A, B))
    assert got.count() == odd.count()
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(rows)
    assert ta.align(nothing, A, B, ta.link_counts(nothing, A, B)).count() == 0
