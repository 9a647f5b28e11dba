"""Lexical retrieval packing: a sharded BM25 inverted index fills each window with related documents.

Documents are put next to documents with similar wording by a range partitioning on a minhash of their
token pairs, with the id as tie-breaker, so that even a huge group of copies spreads over shards of
near equal size. Each shard has its own inverted index over token ids. The first unused document is the
seed of a window; its most telling tokens are the query, and the unused neighbours fill the window in BM25
order. A document that doesn't fit is cut and its rest is the seed of the next window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions, tokenizer_path, written
from .tokens import encoder

WINDOW = 4096
#: Tokens and documents of one index. More documents than that start another index of the same partition.
SHARD_TOKENS, SHARD_DOCS = 2_000_000, 8192
#: Distinct tokens of the seed with the largest BM25 weights that make up a query.
QUERY_TERMS = 24
K1, B = 1.2, 0.75

TOKEN_SCHEMA = "doc_id long, near long, ids binary"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def minhashes(ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A minhash over the token pairs of each of the documents, which stand in a row; 0 for those without a pair."""
    a = ids.astype(np.uint64)
    pairs = a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(29)
    pairs *= np.uint64(0xBF58476D1CE4E5B9)
    ends = np.cumsum(lens)
    pairs = np.append(pairs, np.uint64(0))
    pairs[ends - 1] = np.iinfo(np.uint64).max  # the pair that the next document's first token would end
    least = np.minimum.reduceat(pairs, ends - lens) >> np.uint64(1)
    return np.where(lens > 1, least, 0).astype(np.int64)


def binaries(ids: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Each document's ids as little-endian unsigned 16-bit numbers."""
    offsets = np.concatenate([[0], np.cumsum(lens)]) * 2
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())


class Index:
    """BM25 over the documents of one shard; tokens are terms."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        lens = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(n, dtype=np.uint32), lens)
        keys, tf = np.unique((owner << np.uint32(16)) | np.concatenate(docs).astype(np.uint32), return_counts=True)
        doc, term = (keys >> np.uint32(16)).astype(np.int32), (keys & np.uint32(0xFFFF)).astype(np.uint16)
        df = np.bincount(term, minlength=65536)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[doc] / lens.mean()))).astype(np.float32)
        self.n, self.df = n, df
        self.first = np.searchsorted(doc, np.arange(n + 1))
        self.term, self.own = term, weight
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.at = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, i: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share a query term with document ``i``, best first, ties by position."""
        a, b = self.first[i], self.first[i + 1]
        terms, weights = self.term[a:b], self.own[a:b]
        shared = self.df[terms] > 1
        terms, weights = terms[shared], weights[shared]
        if len(terms) > QUERY_TERMS:
            terms = terms[np.argpartition(-weights, QUERY_TERMS)[:QUERY_TERMS]]
        if not len(terms):
            return
        spans = [slice(self.at[t], self.at[int(t) + 1]) for t in terms]
        score = np.bincount(np.concatenate([self.docs[s] for s in spans]), weights=np.concatenate([self.weights[s] for s in spans]), minlength=self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        best = found[np.argsort(-score[found], kind="stable")]
        yield from best.tolist()


class Packer:
    """Windows of one partition, over its shards one after another."""

    def __init__(self, first_sequence: int):
        self.sequence, self.open, self.fill = first_sequence, [], 0

    def put(self, doc_id, ids: np.ndarray, start: int) -> int:
        """Put what fits of a document; returns how far it got."""
        take = min(len(ids) - start, WINDOW - self.fill)
        self.open.append((doc_id, start, take, ids, self.sequence, self.fill))
        self.fill += take
        if self.fill == WINDOW:
            self.done.extend(self.open)
            self.sequence, self.open, self.fill = self.sequence + 1, [], 0
        return start + take

    def shard(self, names: list, docs: list[np.ndarray]) -> list[tuple]:
        self.done: list[tuple] = []
        index, used, seeds = Index(docs), np.zeros(len(docs), bool), iter(range(len(docs)))
        rest: tuple[int, int] | None = None
        for seed in seeds:
            if used[seed]:
                continue
            used[seed] = True
            rest = (seed, 0)
            while rest:
                i, start = rest
                rest, window = None, self.sequence
                got = self.put(names[i], docs[i], start)
                if got < len(docs[i]):
                    rest = (i, got)
                    continue
                if self.sequence != window:
                    break
                for j in index.neighbours(i, used):
                    used[j] = True
                    got = self.put(names[j], docs[j], 0)
                    if got < len(docs[j]):
                        rest = (j, got)
                    if self.sequence != window:
                        break
        return self.done

    def end(self) -> list[tuple]:
        """The last window is cut into sequences whose lengths are powers of two, which need no padding."""
        out, left = [], self.fill
        for doc_id, start, length, ids, _, _ in self.open:
            while length:
                if not out or self.fill == self.size:
                    self.size, self.fill = 1 << (left.bit_length() - 1), 0
                    left -= self.size
                    self.sequence += bool(out)
                take = min(length, self.size - self.fill)
                out.append((doc_id, start, take, ids, self.sequence, self.fill))
                self.fill, start, length = self.fill + take, start + take, length - take
        return out


def tokenized(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text with the end id, and the minhash that places it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, spaces=False)
        for b in batches:
            at = 0
            for ids, lens in enc.ended(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(lens)], pa.array(minhashes(ids, lens)), binaries(ids, lens)], names=["doc_id", "near", "ids"])
                at += len(lens)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, TOKEN_SCHEMA)


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences, with their ids as little-endian unsigned 16-bit numbers.

    A null or empty text has the end id alone; a null id is kept as null; repeated rows are documents of
    their own; other columns are ignored; no rows give no pieces. The number of shuffle partitions is the number
    of partitions that are packed apart; each has full sequences, and at its end sequences of powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 32)
        names: list = []
        texts: list[np.ndarray] = []
        tokens = 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            cut = [(p[3][p[1] : p[1] + p[2]]) for p in pieces]
            crc = [zlib.crc32(c.astype("<u4").tobytes()) for c in cut]
            cols = [[p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], crc, [len(p[3]) for p in pieces], [p[4] for p in pieces], [p[5] for p in pieces]]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([c.tobytes() for c in cut], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

        for b in batches:
            for name, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names.append(name)
                texts.append(np.frombuffer(ids, np.uint16))
                tokens += len(texts[-1])
                if tokens >= SHARD_TOKENS or len(texts) >= SHARD_DOCS:
                    yield rows(packer.shard(names, texts))
                    names, texts, tokens = [], [], 0
        if texts:
            yield rows(packer.shard(names, texts))
        if packer.open:
            yield rows(packer.end())

    n = shuffle_partitions(docs.sparkSession)
    ids = written(tokenized(docs, vocabulary, id_col, text_col), "token-ids")
    return ids.repartitionByRange(n, "near", "doc_id").sortWithinPartitions("near", "doc_id", "ids").select("doc_id", "ids").mapInArrow(run, PIECE_SCHEMA)


def op1_bm25_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; see ``pack`` for nulls, ties and odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path("word_bpe_49k.json")).drop("ids")
