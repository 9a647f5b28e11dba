"""Similarity join of documents on word shingles, by rare-first prefix filtering.

A document's shingles are ordered from rare to frequent by counts over the whole corpus (a sketch of
fixed size, so the order is the same everywhere). Two sets of Jaccard similarity t or more share one of their
first n - ceil(t * n) + 1 shingles. These prefixes are dealt by shingle; lists of the documents of a shingle give
candidates, which the lengths, the positions and a suffix filter thin out before a single exact check of each pair.

A list of many near copies is not expanded into all its pairs. First every document of a list meets one of the list's most
central documents; then, with the links found so far, only pairs from different components meet, first a few for each
document and at last all that are left. The components are those of all links; only links inside a component that is already joined are not listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import shuffle_partitions, written

WORDS, SIMILARITY = 5, 75  # a shingle's words; per cent
SKETCH_BITS, SKETCH_CHUNKS = 20, 16
BLOOM_BITS = 23
#: Prefix entries that a task holds before it sends them on.
FLUSH = 1_000_000
#: Rounds in which the documents of a list meet its first ones, and partners that each of those left outside then meets before all do.
PIVOTS, FEW = 6, 4
#: A list of more documents is split into cells of so many at most on either side.
CELL = 4096

_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes | str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z are lower-cased. Fewer words than ``width`` are
    one shingle; no words, none."""
    if text is None:
        return np.zeros(0, np.uint64)
    raw = text.encode() if isinstance(text, str) else text
    words = [xxhash.xxh3_64_intdigest(w) for w in raw.lower().split()]
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(words, np.uint64)
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * (_WEIGHTS[i % 8] + np.uint64(2 * (i // 8)))
    return np.unique(_mixed(out))


def prefix_size(n: int | np.ndarray):
    """How many of a set's rarest shingles must be looked at."""
    return n - (SIMILARITY * n + 99) // 100 + 1


def needed(n, m):
    """The least intersection of two sets of these sizes that link."""
    return -((-SIMILARITY * (n + m)) // (100 + SIMILARITY))


def _may_link(n, pos, m, at):
    """The length and positional filters for sets of sizes n and m whose first common shingle stands at pos and at."""
    return (100 * np.minimum(n, m) >= SIMILARITY * np.maximum(n, m)) & (np.minimum(n - pos, m - at) >= needed(n, m))


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


ENTRY = (("<u8", 8), ("<i8", 8), ("<u4", 4), ("<u4", 4))  # shingle, document, set size, position


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind, size in ENTRY:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * size
    return out


def sketch(docs: DataFrame) -> np.ndarray:
    """In how many documents shingles occur, by the top bits of their hashes; 4 MB at any size of the corpus."""
    cells, per = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint64)
        for b in batches:
            found = [shingles(t) for t in b.column(0).to_pylist()]
            for at in range(0, len(found), 256):
                total += np.bincount((np.concatenate(found[at : at + 256]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells).astype(np.uint64)
        blobs = [_pack(total[c * per : (c + 1) * per]) for c in range(SKETCH_CHUNKS)]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(SKETCH_CHUNKS), pa.int32()), "slot": pa.array([TaskContext.get().partitionId() % 32] * SKETCH_CHUNKS, pa.int32()), "data": pa.array(blobs, pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(per, np.uint64)
        for blob in t.column("data").to_pylist():
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint64)
        return pa.table({"chunk": t.column("chunk")[:1], "slot": t.column("slot")[:1], "data": pa.array([_pack(total)], pa.binary())})

    schema = "chunk int, slot int, data binary"
    sums = docs.select("text").mapInArrow(count, schema).groupBy("chunk", "slot").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    got = {r["chunk"]: np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["data"])), np.uint64) for r in sums.collect()}  # SKETCH_CHUNKS rows
    return np.concatenate([got.get(c, np.zeros(per, np.uint64)) for c in range(SKETCH_CHUNKS)])


def _prefixes(docs: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """Blobs of prefix entries by bucket (kind 1) and one row per document (kind 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, held, size = TaskContext.get().partitionId(), set(), [], 0

        def send() -> pa.RecordBatch:
            token, doc, n, pos = (np.concatenate(x) for x in zip(*held))
            bucket = ((token * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            bucket, cols = bucket[order], [c[order] for c in (token, doc, n, pos)]
            names, first = np.unique(bucket, return_index=True)
            ends = [*first[1:], len(bucket)]
            return rows([1] * len(names), names, [int(e - s) for s, e in zip(first, ends)], [_pack(*(c[s:e] for c in cols)) for s, e in zip(first, ends)])

        def rows(kind, bucket, n, data, doc=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "bucket": pa.array(bucket, pa.int64()), "doc": pa.array(doc or [None] * len(kind), pa.int64()), "n": pa.array(n, pa.int64()), "data": pa.array(data, pa.binary())})

        for b in batches:
            ids, sizes, digests = b.column(0).to_pylist(), [], []
            for doc, text in zip(ids, b.column(1).to_pylist()):
                s = shingles(text)
                n = len(s)
                sizes.append(n)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n and doc is not None else None
                digests.append(digest)
                if digest is None or digest in seen:
                    continue
                seen.add(digest)
                p = prefix_size(n)
                s = s[np.argsort(shared.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:p]]
                held.append((s, np.full(p, doc, np.int64), np.full(p, n, np.uint32), np.arange(p, dtype=np.uint32)))
                size += p
                if size >= FLUSH:
                    yield send()
                    held, size = [], 0
            yield rows([0] * len(ids), [(part + i) % buckets for i in range(len(ids))], sizes, digests, ids)
        if held:
            yield send()

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, bucket long, doc long, n long, data binary")


def _lists(blobs: DataFrame) -> DataFrame:
    """From the entries of each bucket: candidate pairs with the most central documents (kind 1: a, b),
    and lists of three documents or more (kind 2: list, doc, n, pos). Rows of kind 0 pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, a, b=None, n=None, pos=None, data=None) -> Iterator[pa.RecordBatch]:
            k = len(a)
            for at in range(0, k, 100_000):
                s = slice(at, at + 100_000)
                m = len(a[s])
                cut = lambda x: pa.array(x[s] if x is not None else [None] * m, pa.int64())  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * m, pa.int32()), "a": cut(a), "b": cut(b), "n": cut(n), "pos": cut(pos), "data": pa.array(data[s] if data is not None else [None] * m, pa.binary())})

        held = []
        for b in batches:
            x = b.to_pydict()
            docs = [i for i, k in enumerate(x["kind"]) if k == 0]
            yield from rows(0, [x["doc"][i] for i in docs], n=[x["n"][i] for i in docs], data=[x["data"][i] for i in docs])
            held += [_unpack(d, n) for k, n, d in zip(x["kind"], x["n"], x["data"]) if k == 1]
        if not held:
            return
        token, doc, n, pos = (np.concatenate(c) for c in zip(*held))
        held = []
        order = np.lexsort((doc, pos, token))
        token, doc, n, pos = token[order], doc[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        keep = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])
        group = np.cumsum(np.concatenate([[0], (token[1:] != token[:-1])]))
        size = np.bincount(group[keep], minlength=group[-1] + 1)
        keep &= size[group] > 1
        doc, n, pos, group, token = doc[keep], n[keep], pos[keep], group[keep], token[keep]
        if not len(doc):
            return
        # A document in which the shingle comes early has few rare ones of its own and stands in the middle of its
        # copies. The others meet it first; those that can't link to it meet the next one that is left.
        first = np.arange(len(doc))
        todo = np.arange(len(doc))
        for _ in range(PIVOTS):
            if not len(todo):
                break
            g = group[todo]
            lead = np.concatenate([[True], g[1:] != g[:-1]])
            head = todo[np.maximum.accumulate(np.where(lead, np.arange(len(todo)), 0))]
            met = _may_link(n[todo], pos[todo], n[head], pos[head]) & ~lead
            first[todo[met]] = head[met]
            todo = todo[~met & ~lead]
        good = first != np.arange(len(doc))
        pairs = np.unique(np.sort(np.stack([doc[first[good]], doc[good]], 1), axis=1), axis=0)
        yield from rows(1, pairs[:, 0], pairs[:, 1])
        longer = size[group] > 2
        # Lists with the same documents differ in positions alone: the first positions serve for all.
        doc, n, pos, group, token = doc[longer], n[longer], pos[longer], group[longer], token[longer]
        if len(doc):
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            names = np.bitwise_xor.reduceat(_mixed(doc.astype(np.uint64)), starts) + np.add.reduceat(_mixed(doc.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)), starts)
            name = np.repeat(names, np.diff([*starts, len(doc)])).astype(np.int64)
            order = np.lexsort((pos, doc, name))
            name, doc, n, pos = name[order], doc[order], n[order], pos[order]
            head = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])])
            yield from rows(2, name[head], doc[head], n[head], pos[head])

    return blobs.mapInArrow(run, "kind int, a long, b long, n long, pos long, data binary")


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 2) -> int:
    """At most how many elements two sorted sets share: both are parted at an element of the longer one,
    and what one side's lengths leave over can't match."""
    if depth == 0 or len(a) < 8 or len(b) < 8:
        return min(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    i = len(a) // 2
    j = int(np.searchsorted(b, a[i]))
    hit = int(j < len(b) and b[j] == a[i])
    return suffix_bound(a[:i], b[:j], depth - 1) + hit + suffix_bound(a[i + 1 :], b[j + hit :], depth - 1)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test, after the suffix filter."""
    if not len(a) or not len(b):
        return False
    least = needed(len(a), len(b))
    if suffix_bound(a, b) < least:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= least


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; every pair is checked once, on the whole texts."""
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).select(F.pmod(F.xxhash64("id"), F.lit(1 << BLOOM_BITS)).alias("h"))
    words = ends.groupBy(F.expr("h div 62").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 62 AS int))")).alias("v")).collect()  # at most 2 ** BLOOM_BITS / 62 rows
    bits = np.zeros((1 << BLOOM_BITS) // 62 + 1, np.int64)
    for r in words:
        bits[r["w"]] = r["v"]
    bloom = spark.sparkContext.broadcast(bits)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp = zstandard.ZstdCompressor(level=1)
        for b in batches:
            h = b.column(1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((bloom.value[h // 62] >> (h % 62)) & 1)
            some = b.take(pa.array(hit))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([comp.compress(t.encode()) for t in some.column(2).to_pylist()], pa.binary())], names=["id", "body"])

    body = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << BLOOM_BITS)).alias("h"), "text").mapInArrow(texts, "id long, body binary")
    right = pairs.join(body.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
    full = right.join(body.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a").select("a", "b", "body_a", "body_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        un, last, own = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            keep = []
            for i, (body_a, body_b) in enumerate(zip(b.column(2), b.column(3))):
                x, y = body_a.as_py(), body_b.as_py()
                if x != last:
                    last, own = x, shingles(un.decompress(x))
                if linked(own, shingles(un.decompress(y))):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return written(full.mapInArrow(check, "a long, b long"), "verified")


def _cells(entries: DataFrame) -> DataFrame:
    """The entries of lists of different components (list, doc, n, pos, component), dealt to cells (list, part_a, part_b): each document outside
    its list's largest component (side a) and each document of the list (side b) share one cell, and no cell grows with its list."""
    by = entries.groupBy("list", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("list").agg(F.max_by("component", F.struct("k", "component")).alias("large"), F.sum("k").alias("all"), F.max("k").alias("most"))
    by = by.filter("most < all").select("list", "large", F.ceil(F.col("all") / CELL).alias("n_b"), F.ceil((F.col("all") - F.col("most")) / CELL).alias("n_a"))
    rows = entries.join(by, "list")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    a = rows.filter("component <> large").withColumn("part_a", part("n_a")).withColumn("part_b", upto("n_b")).withColumn("a", F.lit(True))
    b = rows.withColumn("part_b", part("n_b")).withColumn("part_a", upto("n_a")).withColumn("a", F.lit(False))
    both = a.unionByName(b).groupBy("list", "part_a", "part_b").agg(F.collect_list(F.struct("doc", "n", "pos", "component", "a")).alias("entries"))
    return both.select("entries")


def _across(lists: DataFrame, most: int | None) -> DataFrame:
    """Pairs of different components in each list or cell, by lengths and positions. With ``most``, documents outside
    their list's largest component meet so many others at most: a first round that joins what links easily."""
    split = "a" in lists.schema["entries"].dataType.elementType.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            pairs = np.unique(np.concatenate(found), axis=0)
            for s in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[s : s + 100_000, k]) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for entries in batch.column(0):
                v = entries.values
                doc, n, pos, comp = (v.field(k).to_numpy(zero_copy_only=False) for k in ("doc", "n", "pos", "component"))
                order = np.lexsort((doc, pos))
                doc, n, pos, comp = doc[order], n[order], pos[order], comp[order]
                _, at, size = np.unique(comp, return_inverse=True, return_counts=True)
                place = np.arange(len(doc))
                if split:
                    seeking = v.field("a").to_numpy(zero_copy_only=False)[order]
                    met = ~seeking
                else:
                    large = int(np.argmax(size))
                    seeking, met = at != large, at == large
                for i in np.flatnonzero(seeking):
                    ok = (at != at[i]) & (met if split else met | (place > i)) & _may_link(n, pos, n[i], pos[i])
                    j = np.flatnonzero(ok)[:most]
                    if len(j):
                        found.append(np.stack([np.minimum(doc[j], doc[i]), np.maximum(doc[j], doc[i])], 1))
                        held += len(j)
                    if held > FLUSH:
                        yield from send()
                        found, held = [], 0
        if found:
            yield from send()

    return lists.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the smallest id that links reach, a row's own id if there is none. A null or empty text, or one of
    white space alone, has no shingles and no links; a null id has no links and a null component; rows that repeat an id
    share its component; other columns are ignored; no rows give no rows."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = shuffle_partitions(spark)
    counts = sketch(docs)
    table = written(_lists(_prefixes(docs, counts, 4 * n).repartition(n, "bucket")), "prefix-lists")
    rows = table.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("data").alias("digest"))
    # Equal sets are one class; its smallest id stands for it.
    classes = written(rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")), "classes")
    many = classes.filter("rep <> top")
    salted = lambda d, k: d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")
    copies = rows.filter("digest IS NOT NULL").withColumn("salt", salt).join(salted(many.select("digest", "rep"), 64), ["digest", "salt"]).filter("doc_id <> rep").select(F.col("doc_id").alias("copy"), "rep").distinct()
    copies = written(copies, "copies")

    def of_class(pairs: DataFrame) -> DataFrame:
        a = copies.select(F.col("copy").alias("a"), F.col("rep").alias("rep_a"))
        b = copies.select(F.col("copy").alias("b"), F.col("rep").alias("rep_b"))
        pairs = pairs.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("rep_a", "a").alias("x"), F.coalesce("rep_b", "b").alias("y"))
        return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    tested = written(of_class(table.filter("kind = 1").select("a", "b")), "pairs")
    same = components(_verified(docs, tested).union(copies.select("copy", "rep")))
    # What is left: pairs of different components in lists of three or more. Long lists are split into cells.
    listed = table.filter("kind = 2").select(F.col("a").alias("list"), F.col("b").alias("doc"), "n", "pos")
    long = written(listed.groupBy("list").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > CELL).select("list"), "long-lists")
    whole = lambda d: d.groupBy("list", "doc").agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
    split = not long.isEmpty()
    short, longer = (whole(listed.join(long, "list", "left_anti")), whole(listed.join(long, "list", "left_semi"))) if split else (whole(listed), None)
    for most in (FEW, None):
        labels = same.withColumnRenamed("node", "doc")
        placed = lambda d: d.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))  # noqa: B023, E731
        mixed = placed(short).groupBy("list").agg(F.collect_list(F.struct("doc", "n", "pos", "component")).alias("entries"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        mixed = written(mixed.select("list", "entries"), "mixed-lists")
        found = _across(mixed.select("entries"), most)
        if split:
            apart = written(placed(longer), "long-entries")
            found = found.union(_across(_cells(apart), most))
            longer = apart.drop("component")
        pairs = written(of_class(found).join(tested, ["a", "b"], "left_anti"), "pairs")
        same = components(_verified(docs, pairs).union(same.select("node", "component")))
        tested = tested.union(pairs)
        short = mixed.select("list", F.explode("entries").alias("e")).select("list", "e.doc", "e.n", "e.pos")
    labelled = rows.join(same.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return labelled.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The groups of all documents; see ``join`` for nulls, ties and odd rows."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
