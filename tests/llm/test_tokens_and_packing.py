from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from bomlens.llm import packing, token_files, tokens
from bomlens.llm.shared import shared_path, tokenizer_path
from bomlens.llm.tokens import Encoder

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
_enc = {False: Encoder(WORD, False), True: Encoder(BYTE, True)}
#: The files as they are, without any flag.
_plain = {False: Tokenizer.from_file(WORD), True: Tokenizer.from_file(BYTE)}
ODD = ["a", "b", "'", "s", "Z", "é", "e\u0301", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x00", "1", ".", "İ", "Σ", "ß", "ﬁ", "日", "—", "\u00a0", "\u2003", "\u3000", "😀", "'S", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " <|endoftext|> "]


@pytest.mark.parametrize("spaces", [False, True])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=30).map("".join), max_size=5))
def test_ids_are_those_of_whole_texts(spaces, texts):
    got = [x.tolist() for ids, n in _enc[spaces].all(pa.array(texts, pa.string())) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [_plain[spaces].encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("spaces", [False, True])
def test_small_batches_and_caches_change_nothing(spaces, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["foo", "Bar", "é,", "<|endoftext|>", "x" * 300, "qu'on", "\n"], int(rng.integers(0, 60)))) for _ in range(200)]
    monkeypatch.setattr(tokens, "BATCH_BYTES", 500)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    got = [x.tolist() for ids, n in Encoder(WORD if not spaces else BYTE, spaces).ended(pa.array(texts)[3:]) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [[*_plain[spaces].encode(t, add_special_tokens=False).ids, 2] for t in texts[3:]]


def whole(text, spaces):
    return np.array([*_plain[spaces].encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_packing_covers_every_id_once(spark, odd):
    rows = packing.pack(odd, WORD).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    want = {r["doc_id"]: whole(r["text"], False) for r in odd.collect()}
    assert set(by_doc) == set(want)
    for doc, parts in by_doc.items():
        copies = 2 if doc == 1 else 1
        assert sum(p["length"] for p in parts) == copies * len(want[doc])
        for p in parts:
            cut = want[doc][p["start"] : p["start"] + p["length"]]
            assert len(cut) == p["length"] > 0 and p["doc_tokens"] == len(want[doc])
            assert p["ids_crc32"] == zlib.crc32(cut.tobytes()) and bytes(p["ids"]) == cut.astype("<u2").tobytes()
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, WORD).count() == 0


def test_windows_hold_related_documents():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 + 1000 * t, 1000 + 1000 * t, 400) for t in range(4)]
    docs = [rng.choice(topics[i % 4], 400).astype(np.uint16) for i in range(80)]
    p = packing.Packer(0)
    done = p.shard(list(range(80)), docs) + p.end()
    seen: dict = {}
    for doc, _, length, _, seq, _ in done:
        seen.setdefault(seq, []).append((doc % 4, length))
    share = sum(max(sum(n for t, n in parts if t == k) for k in range(4)) for parts in seen.values()) / sum(n for parts in seen.values() for _, n in parts)
    assert share > 0.9


def test_bm25_order():
    docs = [np.array(x, np.uint16) for x in ([1, 2, 3, 9], [1, 2, 3, 4], [9, 5, 6, 7], [1, 8, 8, 8], [2, 3, 1, 1])]
    got = list(packing.Index(docs).neighbours(0, np.array([1, 0, 0, 0, 0], bool)))
    # Three shared terms outweigh one rare one, and that a common one.
    assert set(got[:2]) == {1, 4} and got[2:] == [2, 3]


@pytest.mark.parametrize("n,high", [(0, 5), (1, 1), (1000, 7), (600_000, 50_000)])
def test_wavelet_round_trip(n, high):
    a = np.random.default_rng(n).integers(0, high, n).astype(np.uint16)
    f = token_files.WaveletFile(token_files.build(a, [5, None], [n // 2, n - n // 2]))
    assert (f.all() == a).all() and f.doc_ids == [5, None] and list(f.lengths) == [n // 2, n - n // 2]
    for i in range(0, n, max(1, n // 7)):
        v = int(a[i])
        assert f.access(i) == v
        assert f.rank(v, i) == (a[:i] == v).sum() and f.count(v) == (a == v).sum()
        assert f.select(v, f.rank(v, i)) == i
    if n == 1000:
        assert list(f.occurrences(3)) == np.flatnonzero(a == 3).tolist()
    assert f.count(60_000) == 0


def test_token_files(spark, odd, nothing):
    folder = shared_path(spark, "test-files")
    rows = token_files.read_files(spark, folder, token_files.write_files(odd, folder, BYTE)).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    want, at = {r["doc_id"]: whole(r["text"], True) for r in odd.collect()}, 0
    for r in rows:
        assert r["start"] == at and bytes(r["ids"]) == want[r["doc_id"]].tobytes()
        at += len(want[r["doc_id"]])
    folder = shared_path(spark, "test-none")
    assert token_files.read_files(spark, folder, token_files.write_files(nothing, folder, BYTE)).count() == 0
