"""Language-model scores by context-tree weighting over bytes, and word counts as a base line.

A byte is eight binary choices. For each choice every context, the last 0 to DEPTH bytes, has a Krichevsky-Trofimov
estimate; a node of the tree weighs its own estimate against the product of its children's, half and half, over all training
text. All contexts of all training text are kept, however rare, in shards by their nearest SPLIT bytes, so the tree grows with the
corpus and no task holds more than a shard of it. Only the tree's top, nodes of less than SPLIT bytes, is put together on the
driver: at most 256 ** (SPLIT - 1) contexts at any size of the corpus (some thousands in real text).

Chunks of documents send their distinct byte strings (context and next byte) with training counts to the shards and get a code
length for each. They ask for the counts of their distinct words in the same way, so a frequent word is sent once for a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions, written

DEPTH, SPLIT = 6, 3
#: The end of a text; UTF-8 has no such byte. Before a text stand zero bytes.
END = 0xFF
#: Bytes of text that are sorted or looked up at once, and of a chunk of documents.
PIECE, CHUNK = 1_000_000, 8_000_000

_ROWS = "kind int, chunk long, bucket long, data binary, body binary, weighted double, zeros long, ones long"
#: Kinds of rows: a chunk's words, its byte strings, its documents, counts of its words, sizes of a task's vocabulary, nodes of
#: SPLIT - 1 bytes, a shard with its askers, code lengths for a chunk.
WORDS, STRINGS, DOCS, COUNTS, SIZES, NODES, SHARD, LENGTHS = range(1, 9)


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes split at the six ASCII white-space characters."""
    return text.encode().lower().split() if text else []


def _squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b"".join(a.tobytes() for a in arrays))


def _open(blob) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(blob))


def _planes(a: np.ndarray) -> np.ndarray:
    """64-bit numbers by bytes of equal weight, which compress well."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _numbers(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").ravel()


def _rising(a: np.ndarray) -> np.ndarray:
    """Rising numbers by their steps."""
    return _planes(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def _risen(raw: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.cumsum(_numbers(raw, n, at), dtype=np.uint64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of kind, chunk, bucket, data and, for documents, body."""
    cols = list(zip(*[(*r, None)[:5] for r in rows]))
    none = [pa.nulls(len(rows), t) for t in (pa.float64(), pa.int64(), pa.int64())]
    arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))] + none
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "chunk", "bucket", "data", "body", "weighted", "zeros", "ones"])


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each coded byte, its context from the nearest byte on and then the byte itself, for texts in a row,
    each after DEPTH zeros and with END; and where each text begins."""
    pad = b"\0" * DEPTH
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\xff")), np.uint8)
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(lens) - lens
    at = np.arange(lens.sum()) + np.repeat(DEPTH * np.arange(1, len(texts) + 1), lens)
    key = np.zeros(len(at), np.uint64)
    for d in range(1, DEPTH + 1):
        key = (key << np.uint64(8)) | raw[at - d]
    return (key << np.uint64(8)) | raw[at], begin


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and how often each stands there; ``keys`` is sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)).astype(np.int64)


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence."""
    low = np.ones_like(x)
    for i in range(8):
        low *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(low)


_SMALL = 1 << 14
_GAMMA = {shift: log_gamma(np.arange(_SMALL) + shift) for shift in (0.5, 1.0)}


def _log_gamma(n: np.ndarray, shift: float) -> np.ndarray:
    """log_gamma(n + shift) of whole numbers, small ones from a table."""
    out = _GAMMA[shift][np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(n >= _SMALL)
    out[large] = log_gamma(n[large] + shift)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov estimate of a sequence with these numbers of zeros and ones."""
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0) - 1.1447298858494002


def halved(own: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted estimate of nodes, half their own and half their children's, and the own one's share of it."""
    both = np.logaddexp(own, split) + np.log(0.5)
    return both, np.exp(own + np.log(0.5) - both)


class Subtree:
    """The nodes of ``low`` to DEPTH bytes over sorted distinct byte strings; strings that are only asked for count 0,
    which leaves every estimate as it is."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int = SPLIT):
        self.keys, self.counts, self.parent = {DEPTH: keys}, {DEPTH: counts.astype(np.float64)}, {}
        self.low = low
        for d in range(DEPTH, low, -1):
            k = self.keys[d]
            self.keys[d - 1], self.parent[d] = np.unique((k >> np.uint64(16) << np.uint64(8)) | (k & np.uint64(255)), return_inverse=True)
            self.counts[d - 1] = np.bincount(self.parent[d], self.counts[d], len(self.keys[d - 1]))

    def weigh(self, bit: int) -> None:
        """Nodes of the choice number ``bit`` of a byte, from the longest contexts up."""
        self.first, self.node, self.zeros, self.ones, self.share = {}, {}, {}, {}, {}
        for d in range(DEPTH, self.low - 1, -1):
            k = self.keys[d]
            g = k >> np.uint64(8 - bit)
            new = np.concatenate([[True], g[1:] != g[:-1]])
            first, one = np.flatnonzero(new), (k >> np.uint64(7 - bit)) & np.uint64(1)
            self.first[d], self.node[d] = first, np.cumsum(new) - 1
            self.ones[d] = np.add.reduceat(self.counts[d] * one, first)
            self.zeros[d] = np.add.reduceat(self.counts[d], first) - self.ones[d]
            own = log_kt(self.zeros[d], self.ones[d])
            if d == DEPTH:
                self.weighted, self.share[d] = own, np.ones_like(own)
            else:
                self.weighted, self.share[d] = halved(own, np.bincount(self._above(d + 1), self.weighted, len(first)))

    def _above(self, d: int) -> np.ndarray:
        """The node of one byte less for each node of ``d`` bytes."""
        return self.node[d - 1][self.parent[d][self.first[d]]]

    def prefix(self, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """For nodes of ``low`` bytes: the context of one byte less, and the choices before as a number with a leading one."""
        k = self.keys[self.low][self.first[self.low]]
        return (k >> np.uint64(16)).astype(np.int64), (1 << bit | (k & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int64)

    def chances(self, bit: int, done: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 probability of each string's choice; ``done`` and ``left`` are what shorter contexts say about a one and the weight
        that they leave, by nodes of ``low`` bytes."""
        for d in range(self.low, DEPTH + 1):
            if d > self.low:
                done, left = done[self._above(d)], left[self._above(d)]
            done = done + left * self.share[d] * (self.ones[d] + 0.5) / (self.zeros[d] + self.ones[d] + 1)
            left = left * (1 - self.share[d])
        p = done[self.node[DEPTH]]
        return np.log10(np.where((self.keys[DEPTH] >> np.uint64(7 - bit)) & np.uint64(1) == 1, p, 1 - p))


class Top:
    """Nodes of less than SPLIT bytes: what they say about a one, and the weight that they leave to longer contexts."""

    def __init__(self, context: np.ndarray, prefix: np.ndarray, weighted: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        """One entry for each node of SPLIT - 1 bytes: context (nearest byte first), choices before, and its children's sums."""
        code = (context << 8 | prefix).astype(np.int64)
        order = np.argsort(code)
        code, split, zeros, ones = code[order], weighted[order], zeros[order].astype(np.float64), ones[order].astype(np.float64)
        self.code, steps = code, []
        for d in range(SPLIT - 1, -1, -1):
            both, share = halved(log_kt(zeros, ones), split)
            one = (ones + 0.5) / (zeros + ones + 1)
            if d:
                code, up = np.unique((code >> 16 << 8) | (code & 255), return_inverse=True)
                zeros, ones, split = (np.bincount(up, x, len(code)) for x in (zeros, ones, both))
            else:
                up = np.arange(len(code))
            steps.append((share, one, up))
        self.done, self.left = np.zeros(len(code)), np.ones(len(code))
        for share, one, up in reversed(steps):  # from the empty context to nodes of SPLIT - 1 bytes
            done, left = self.done[up], self.left[up]
            self.done, self.left = done + left * share * one, left * (1 - share)

    def at(self, context: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.code, context << 8 | prefix)
        return self.done[i], self.left[i]


def pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about PIECE bytes, with the number of texts before each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def own_strings(texts: list[bytes], held: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct byte strings of the texts, sorted, and how often each stands in those that aren't held out."""
    found = []
    for flag in (False, True):
        for _, some in pieces([t for t, h in zip(texts, held) if bool(h) == flag]):
            keys, counts = counted(strings(some)[0])
            found.append((keys, counts * (not flag)))
    return summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))


def code_lengths(texts: list[bytes], keys: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log10 probability of each text with its end, from those of its byte strings."""
    out = np.zeros(len(texts))
    for begin, some in pieces(texts):
        own, first = strings(some)
        order = np.argsort(own)
        value = np.empty(len(own))
        value[order] = logs[np.searchsorted(keys, own[order])]
        out[begin : begin + len(some)] = np.add.reduceat(value, first)
    return out


def _parted(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """The rows of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    columns = [c[order] for c in columns]
    for name, s, e in zip(names.tolist(), first, [*first[1:], len(order)]):
        yield (name, *(c[s:e] for c in columns))


def score(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte. The model learns
    from rows where ``held_out`` is false; a null id counts as a training row. A null or empty text is its end
    alone; repeated rows count and are scored each; other columns are ignored; no rows give no rows. ``score`` is of the whole
    text with A-Z lower-cased, and its end; ``bits_per_byte`` is its code length over its bytes and the end. Code lengths of single bytes travel as
    32-bit numbers, so a score agrees with the exact recursion to about five digits after the point."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    n = shuffle_partitions(spark)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal k
            chunk, names, counts = part << 20 | k, {}, []
            for i, t in enumerate(texts):
                ws = t.split()
                flat = np.fromiter((names.setdefault(w, len(names)) for w in ws), np.int32, len(ws))
                if not held[i]:
                    counts.append(flat)
            hashes = np.array(list(map(xxhash.xxh3_64_intdigest, names)), np.uint64)
            seen = np.bincount(np.concatenate([np.zeros(0, np.int32), *counts]), minlength=len(hashes)).astype(np.int64)
            rows = []
            order = np.argsort(hashes)  # rising numbers take less room
            for where, h, c in _parted(_bucket(hashes, n)[order], hashes[order], seen[order]):
                rows.append((WORDS, chunk, where, _squeeze(_rising(h), _planes(c))))
            keys, seen = own_strings(texts, held)
            for where, x, c in _parted(_bucket(keys >> np.uint64(8 * (DEPTH - SPLIT + 1)), n), keys, seen):
                rows.append((STRINGS, chunk, where, _squeeze(np.array([len(x)], np.int64), _rising(x), _planes(c))))
            head = np.array([len(ids)], np.int64)
            lens = np.array([len(t) for t in texts], np.int64)
            null = np.array([d is None for d in ids], np.uint8)
            rows.append((DOCS, chunk, 0, None, _squeeze(head, np.array([d or 0 for d in ids], np.int64), lens, null, np.array(held, np.uint8), np.frombuffer(b"".join(texts), np.uint8), level=3)))
            k += 1
            for i in range(0, len(rows), 64):
                yield _batch(rows[i : i + 64])

        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids.append(i)
                held.append(h)
                texts.append(t.encode().lower() if t else b"")
                size += len(texts[-1]) + 1
                if size >= CHUNK:
                    yield from flush()
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield from flush()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, met = [], []
        for b in batches:
            for kind, chunk, bucket, data in zip(*(b.column(c).to_pylist() for c in ("kind", "chunk", "bucket", "data"))):
                x = _open(data)
                if kind == WORDS:
                    asked.append((chunk, bucket, _risen(x, len(x) // 16), _numbers(x, len(x) // 16, len(x) // 2).astype(np.int64)))
                else:
                    m = int(np.frombuffer(x, np.int64, 1)[0])
                    met.append((chunk, _risen(x, m, 8), _numbers(x, m, 8 + 8 * m).astype(np.int64)))
        if asked:
            known, counts = summed(np.concatenate([a[2] for a in asked]), np.concatenate([a[3] for a in asked]))
            for chunk, bucket, hashes, _ in asked:
                yield _batch([(COUNTS, chunk, bucket, _squeeze(_planes(counts[np.searchsorted(known, hashes)])))])
            yield _batch([(SIZES, int((counts > 0).sum()), int(counts.sum()), b"")])
        if met:
            keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for i in range(0, len(met), 8):
                keys, counts = summed(np.concatenate([keys, *(x[1] for x in met[i : i + 8])]), np.concatenate([counts, *(x[2] for x in met[i : i + 8])]))
            places = [_rising(np.searchsorted(keys, x[1])) for x in met]
            head = np.array([len(keys), len(met), *(v for x in met for v in (x[0], len(x[1])))], np.int64)
            yield _batch([(SHARD, 0, TaskContext.get().partitionId(), _squeeze(head, _rising(keys), _planes(counts), *places))])
            tree = Subtree(keys, counts)
            for bit in range(8):
                tree.weigh(bit)
                context, prefix = tree.prefix(bit)
                code, up = np.unique(context << 8 | prefix, return_inverse=True)
                sums = [np.bincount(up, x, len(code)) for x in (tree.weighted, tree.zeros[SPLIT], tree.ones[SPLIT])]
                for i in range(0, len(code), 100_000):
                    c, (w, z, o) = code[i : i + 100_000], (x[i : i + 100_000] for x in sums)
                    none = pa.nulls(len(c), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), NODES, np.int32)), pa.array(c >> 8), pa.array(c & 255), none, none, pa.array(w), pa.array(z.astype(np.int64)), pa.array(o.astype(np.int64))], names=["kind", "chunk", "bucket", "data", "body", "weighted", "zeros", "ones"])

    sent = written(docs.mapInArrow(chunks, _ROWS), "chunks")
    table = written(sent.filter(f"kind <> {DOCS}").drop("body").repartition(n, "bucket").mapInArrow(shards, _ROWS), "shards")
    distinct, seen = table.filter(f"kind = {SIZES}").agg(F.coalesce(F.sum("chunk"), F.lit(0)), F.coalesce(F.sum("bucket"), F.lit(0))).first()
    ends = docs.filter("NOT held_out").count()
    n_all, n_distinct = seen + ends, distinct + (ends > 0)
    nodes = table.filter(f"kind = {NODES}").groupBy("chunk", "bucket").agg(F.sum("weighted").alias("weighted"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()  # nodes of SPLIT - 1 bytes
    top = spark.sparkContext.broadcast(Top(*(nodes.column(c).to_numpy() for c in ("chunk", "bucket", "weighted", "zeros", "ones"))))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, data in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist()):
                x = _open(data)
                m, askers = np.frombuffer(x, np.int64, 2).tolist()
                head, at = np.frombuffer(x, np.int64, 2 * askers, 16).tolist(), 16 + 16 * askers
                tree = Subtree(_risen(x, m, at), _numbers(x, m, at + 8 * m).astype(np.int64))
                logs = np.zeros(m)
                for bit in range(8):
                    tree.weigh(bit)
                    logs += tree.chances(bit, *top.value.at(*tree.prefix(bit)))
                logs, at = logs.astype(np.float32), at + 16 * m
                for chunk, k in zip(head[::2], head[1::2]):
                    yield _batch([(LENGTHS, chunk, bucket, _squeeze(_rising(tree.keys[DEPTH][_risen(x, k, at).astype(np.int64)]), logs[_risen(x, k, at).astype(np.int64)]))])
                    at += 8 * k

    rated = table.filter(f"kind = {SHARD}").repartition(n, "bucket").mapInArrow(rate, _ROWS)

    def finish(t: pa.Table) -> pa.Table:
        kinds, data = t.column("kind").to_pylist(), t.column("data")
        body = _open(t.column("body")[kinds.index(DOCS)].as_py())
        docs_n, at, fields = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
        for kind in (np.int64, np.int64, np.uint8, np.uint8):
            fields.append(np.frombuffer(body, kind, docs_n, at))
            at += docs_n * np.dtype(kind).itemsize
        ids, lens, null, held = fields
        ends_at = at + np.cumsum(lens)
        texts = [body[e - k : e] for e, k in zip(ends_at.tolist(), lens.tolist())]
        # Words stand in the order of their hashes' buckets and then their hashes, as they were asked for.
        names: dict[bytes, int] = {}
        tokens = [np.fromiter((names.setdefault(w, len(names)) for w in ws), np.int32, len(ws)) for ws in map(bytes.split, texts)]
        hashes = np.array(list(map(xxhash.xxh3_64_intdigest, names)), np.uint64)
        order = np.lexsort((hashes, _bucket(hashes, n)))
        got = {bucket: data[i].as_py() for i, (kind, bucket) in enumerate(zip(kinds, t.column("bucket").to_pylist())) if kind == COUNTS}
        counts = np.zeros(len(order), np.int64)
        counts[order] = np.concatenate([np.zeros(0, np.int64), *(_numbers(x, len(x) // 8).astype(np.int64) for x in (_open(got[b]) for b in sorted(got)))])
        words_of = np.array([len(x) for x in tokens], np.int64)
        owner, flat = np.repeat(np.arange(docs_n, dtype=np.int32), words_of), np.concatenate([np.zeros(0, np.int32), *tokens])
        base = np.bincount(owner, np.log10(counts + 1.0)[flat], docs_n) + np.log10(ends + 1.0) - (words_of + 1) * np.log10(n_all + n_distinct + 1.0)
        known = np.bincount(owner, (counts > 0)[flat], docs_n).astype(np.int64) + (ends > 0)
        keys, logs = [], []
        for i, kind in enumerate(kinds):
            if kind == LENGTHS:
                x = _open(data[i].as_py())
                keys.append(_risen(x, len(x) // 12))
                logs.append(np.frombuffer(x, np.float32, len(x) // 12, len(x) // 12 * 8))
        keys, logs = np.concatenate(keys), np.concatenate(logs)
        order = np.argsort(keys)
        score = code_lengths(texts, keys[order], logs[order])
        bits = -score / np.log10(2) / (lens + 1)
        return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": words_of + 1, "n_known": known, "train_tokens": np.full(docs_n, n_all, np.int64), "base_score": base, "score": score, "bits_per_byte": bits})

    parts = sent.filter(f"kind = {DOCS}").select("kind", "chunk", "bucket", "data", "body")
    for more in (table.filter(f"kind = {COUNTS}"), rated):
        parts = parts.union(more.select("kind", "chunk", "bucket", "data", F.lit(None).cast("binary")))
    return parts.groupBy("chunk").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def op6_context_tree_weighting(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those that aren't held out; see ``score`` for nulls, ties and odd rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)
