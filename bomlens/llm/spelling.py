"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct strings that one deletion, replacement or insertion over the observed
alphabet makes of it, and these are hash-joined to the vocabulary as strings: what joins is near, and no distance is ever
computed. Candidates stay numbers (a polynomial hash of each follows from the word's prefix sums) until a bit filter of the
vocabulary lets them pass, so only strings that are nearly always words reach the shuffle. The filter changes no result: it
holds every word, and what it lets through by chance finds no partner in the join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buffers import pieces, slices
from .shared import discard, shuffle_partitions, written

LEAST_LENGTH, LEAST_COUNT, MISSPELT = 5, 3, 97
#: Distinct words that a task counts before it hands them on.
HELD = 500_000
#: Bits of the filter for a word, and the most bits it ever has (64 MB); with more words than that it lets more strings pass.
BITS_A_WORD, MOST_BITS, BLOCK_BITS = 32, 2**29, 2**16
#: Candidates that are made at once, and bytes of those handed on at once.
TOGETHER, OUT_BYTES = 1_000_000, 8_000_000

#: The bytes that runs consist of: ASCII letters, and C3 with the byte after it (U+00C0 to U+00FF).
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
#: A random odd number for each byte's worth of code points, the base of the polynomial and its inverse modulo 2 ** 64.
_VALUE = np.random.default_rng(11).integers(1, 2**64, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PROBES = [(np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)), (np.uint64(0xFF51AFD7ED558CCD), np.uint64(32)), (np.uint64(0x165667B19E3779F9), np.uint64(31)), (np.uint64(0xD6E8FEB86659FD93), np.uint64(33))]


def hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The CRC-32 of each run of bytes, going on from the CRC-32 of what stands before it."""
    order = np.argsort(-size, kind="stable")
    at, n = start[order], size[order]
    state = ~before[order]
    long = int(np.searchsorted(-n, -64))  # longer ones are few, and taken one by one
    for i in range(long):
        state[i] = ~np.uint32(zlib.crc32(raw[at[i] : at[i] + n[i]].tobytes(), int(~state[i])))
    left = np.searchsorted(-n, -np.arange(64))  # how many are longer than 0, 1, ...
    for k in range(64):
        some = slice(long, left[k])
        if some.start >= some.stop:
            break
        state[some] = _CRC[(state[some] ^ raw[at[some] + k]) & 255] ^ (state[some] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs of letters of texts in a row begin and end."""
    inside = _LETTER[raw]
    inside[1:] |= raw[:-1] == 0xC3
    begins = offsets[:-1][np.diff(offsets) > 0]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    last[:-1] &= ~inside[1:]
    last[begins[1:] - 1] = inside[begins[1:] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def count_words(ids: list, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Words of at least LEAST_LENGTH code points and how often they come, about BATCH_BYTES of text at a time."""
    for i, j, raw, offsets in slices(texts):
        start, end = runs(raw, offsets)
        if not len(start):
            continue
        low = _LOWER[raw]
        twos = np.concatenate([[0], np.cumsum(raw == 0xC3)])
        points = end - start - (twos[end] - twos[start])
        a_text = np.diff(np.searchsorted(start, offsets))
        before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids[i:j]], np.uint32)
        h = hashes(low, start, end - start, np.repeat(before, a_text))
        hit = h % MISSPELT == 0
        keep = np.flatnonzero(~hit & (points >= LEAST_LENGTH))
        edges = np.append(np.stack([start, end], axis=1).ravel(), len(low))
        found = pc.value_counts(pieces(low, edges).take(pa.array(keep * 2)))
        yield found.field("values"), found.field("counts")
        odd = []
        for k in np.flatnonzero(hit & (points > LEAST_LENGTH)):
            word = low[start[k] : end[k]].tobytes().decode()
            at = int(h[k]) % len(word)
            odd.append(word[:at] + word[at + 1 :])
        yield pa.array(odd, pa.large_string()), pa.array(np.ones(len(odd), np.int64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    total = 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for b in batches:
        for words, n in count_words(b.column(0).to_pylist(), b.column(1)):
            held.append(pa.table({"word": words, "n": n.cast(pa.int64())}))
            total += len(words)
            if total > 2 * HELD:
                held = [merged()]
                total = len(held[0])
                if total > HELD:
                    yield from held[0].cast(pa.schema({"word": pa.string(), "n": pa.int64()})).combine_chunks().to_batches()
                    held, total = [], 0
    if held:
        yield from merged().cast(pa.schema({"word": pa.string(), "n": pa.int64()})).combine_chunks().to_batches()


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: the words of all texts that come at least LEAST_COUNT times. Tasks count their own words first. A null id is
    an empty text where it is hashed; null and empty texts hold no words; repeated rows count as often as they come."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length each: their rows, and their code points (all below 256) as a matrix."""
    raw = np.frombuffer(b"".join(w.encode("latin-1") for w in words.to_pylist()), np.uint8)
    n = pc.utf8_length(words).to_numpy().astype(np.int64)
    first = np.cumsum(n) - n
    for length in np.unique(n):
        rows = np.flatnonzero(n == length)
        yield rows, raw[first[rows, None] + np.arange(length)]


def _powers(length: int) -> np.ndarray:
    out = np.full(length, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    return (_VALUE[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def bits(h: np.ndarray, probe: int, size: int) -> np.ndarray:
    """The place that a probe looks at, of ``size`` (a power of two)."""
    factor, shift = _PROBES[probe]
    return (((h ^ (h >> shift)) * factor) >> np.uint64(20)) & np.uint64(size - 1)


def _set_bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bits(word_hashes(codes), p, size) for _, codes in _by_length(b.column(0)) for p in range(len(_PROBES))]
            if at:
                at = np.unique(np.concatenate(at)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK_BITS), pa.array(at % BLOCK_BITS)], names=["block", "bit"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a block are in this partition."""
    found: dict[int, np.ndarray] = {}
    for b in batches:
        block, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
        order = np.argsort(block, kind="stable")
        block, bit = block[order], bit[order]
        for k, some in zip(block[np.flatnonzero(np.diff(block, prepend=-1))], np.split(bit, np.flatnonzero(np.diff(block)) + 1)):
            found.setdefault(int(k), np.zeros(BLOCK_BITS, bool))[some] = True
    for k, v in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(v, bitorder="little").tobytes()])], names=["block", "body"])


def word_filter(words: DataFrame, n: int) -> np.ndarray:
    """A bit array that holds every word; it is made block by block, and MOST_BITS bounds what comes to the driver."""
    size = BLOCK_BITS
    while size < min(MOST_BITS, n * BITS_A_WORD):
        size *= 2
    rows = words.select("word").mapInArrow(_set_bits(size), "block long, bit long")
    rows = rows.repartition(shuffle_partitions(words.sparkSession), "block").mapInArrow(_blocks, "block long, body binary")
    out = np.zeros(size // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["block"] * (BLOCK_BITS // 8) : (r["block"] + 1) * (BLOCK_BITS // 8)] = np.frombuffer(r["body"], np.uint8)
    return out


def _passing(h: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The places of ``h`` that all probes of the filter find."""
    at = np.arange(len(h))
    for p in range(len(_PROBES)):
        bit = bits(h[at], p, len(seen) * 8)
        at = at[(seen[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def neighbourhood(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """All distinct strings one edit away from words of one length: the kind of edit, the hashes (word, place, letter), and which of them
    are distinct. Of equal strings by deletion or insertion only the one at the first place is."""
    n, length = codes.shape
    power = _powers(length + 1)
    term = _VALUE[codes] * power[:length]
    upto = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(term, axis=1, dtype=np.uint64)], axis=1)
    total, value = upto[:, -1:], _VALUE[alphabet]
    yield "delete", (upto[:, :-1] + (total - upto[:, 1:]) * np.uint64(_INVERSE))[:, :, None], np.concatenate([np.ones((n, 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1)[:, :, None]
    yield "replace", (total - term)[:, :, None] + power[None, :length, None] * value, codes[:, :, None] != alphabet
    fresh = np.ones((n, length + 1, len(alphabet)), bool)
    fresh[:, 1:] = codes[:, :, None] != alphabet
    yield "insert", (upto + (total - upto) * np.uint64(_BASE))[:, :, None] + power[None, :, None] * value, fresh


def _candidates(seen, alphabet: np.ndarray):
    letters = [chr(c) for c in alphabet]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, of, held = [], [], 0

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(near, pa.string()), pa.array(of, pa.string())], names=["near", "word"])

        for b in batches:
            words = b.column(0).to_pylist()
            for rows, codes in _by_length(b.column(0)):
                step = max(1, TOGETHER // ((codes.shape[1] + 1) * len(alphabet)))
                for s in range(0, len(rows), step):
                    for kind, h, fresh in neighbourhood(codes[s : s + step], alphabet):
                        flat = np.flatnonzero(fresh)
                        flat = flat[_passing(h.ravel()[flat], seen.value)]
                        which, place, letter = np.unravel_index(flat, h.shape)
                        for r, i, c in zip(rows[s + which].tolist(), place.tolist(), letter.tolist()):
                            w = words[r]
                            near.append(w[:i] + w[i + 1 :] if kind == "delete" else w[:i] + letters[c] + w[i + (kind == "replace") :])
                            of.append(w)
                            held += 2 * len(w)
                            if held > OUT_BYTES:
                                yield handed()
                                near, of, held = [], [], 0
        if near:
            yield handed()

    return run


def near_words(words: DataFrame) -> DataFrame:
    """``words``: word, n, each word once, code points below 256. Returns word, near, near_n: every ordered pair of words that differ by one inserted,
    deleted or replaced code point. No words, no pairs."""
    spark = words.sparkSession
    n = words.count()
    alphabet = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().collect() if r[0]), np.int64)  # at most 90 letters
    seen = spark.sparkContext.broadcast(word_filter(words, n))  # at most MOST_BITS / 8 bytes
    made = words.select("word").repartition(shuffle_partitions(spark)).mapInArrow(_candidates(seen, alphabet), "near string, word string")
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return made.join(known.hint("shuffle_hash"), "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``forms``: word, form (not null; each word once, no circles). Returns word, root: the last word on the way of forms. A round doubles the length of the
    way behind each word, so there are about as many as the logarithm of the longest."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = new.filter("moved").limit(1).count()
        discard(at)
        at = new.drop("moved")
        if not moved:
            return at


def group_variants(words: DataFrame) -> DataFrame:
    """``words``: word, n. For each word its form (the near word of largest n, ties to the smallest in code-point order, if its n is at least
    twice the word's), the root that forms lead to (the word itself if it has none), and the number of near words."""
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near"))).alias("best"))
    found = words.join(near, "word", "left").withColumn("form_n", -F.col("best.least"))
    strong = F.col("form_n") >= 2 * F.col("n")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")), "forms")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_neighbourhoods(spark, sf_dir: str) -> DataFrame:
    """Words of all documents with their spelling variants; see ``vocabulary`` and ``group_variants`` for nulls, ties and odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return group_variants(written(vocabulary(docs), "vocabulary"))
