"""Vectors of components learnt from the components themselves.

A component's text is cut into letter n-grams of its words, hashed to BUCKETS columns and weighted by how rare they are. Components by columns is
a sparse matrix, and a randomized singular value decomposition of it gives each column a vector: Spark multiplies the matrix with its
transpose and a thin matrix of random signs, one pass a round, and only matrices of BUCKETS rows meet on the driver. A component's vector is the
normed sum of its columns' vectors, so texts that were never seen have one too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlens.tables import written

BUCKETS, SIZES = 4096, (3, 4)
DIMENSIONS, SPARE, ROUNDS = 64, 10, 3


def buckets(text: Column) -> Column:
    """The columns of a text's n-grams, words closed by signs; repeated ones as often as they come."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.concat(F.lit("<"), w, F.lit(">")))

    def grams(w: Column) -> Column:
        at = lambda n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.concat(*[at(n) for n in SIZES])

    return F.transform(F.flatten(F.transform(words, grams)), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))


def _summed(held: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, one behind the other; those of empty runs are 0. Equal runs have equal sums to the last bit, wherever they lie."""
    out = np.zeros((len(n), held.shape[1]))
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(held, first[some], axis=0)
    return out


def _product(rows: DataFrame, weight: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """The transpose of the components' matrix times that matrix times ``thin``; ``rows``: columns, and times if they come more than once. Tasks sum their components; sums meet column by column."""
    spark = rows.sparkSession
    times = F.col("times") if "times" in rows.columns else F.lit(1).cast("long").alias("times")
    shared = spark.sparkContext.broadcast((weight, thin))  # BUCKETS rows, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, thin = shared.value
        out = np.zeros_like(thin)
        scaled = thin * weight[:, None]
        for b in batches:
            column = b.column(0)
            flat = column.flatten().to_numpy()
            n = np.diff(column.offsets.to_numpy())
            inner = _summed(scaled[flat], np.cumsum(n) - n, n) * b.column(1).to_numpy()[:, None]
            np.add.at(out, flat, np.repeat(inner, n, axis=0) * weight[flat, None])
        some = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([out[i].tobytes() for i in some], pa.binary())], names=["bucket", "sums"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts.setdefault(i, []).append(x)
        # In a fixed order, so that sums don't depend on which task was first.
        rows = [(i, np.sum([np.frombuffer(x) for x in sorted(xs)], axis=0).tobytes()) for i, xs in sorted(parts.items())]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "sums"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "bucket long, sums binary"
    out = np.zeros_like(thin)
    for r in rows.select("columns", times).mapInArrow(run, schema).repartition(n, "bucket").mapInArrow(met, schema).collect():  # BUCKETS rows at most
        out[r["bucket"]] = np.frombuffer(r["sums"])
    return out


class Subwords:
    """Vectors of the columns, and how to make those of texts."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors

    def frame(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with ``vector``: normed vectors of a column of texts; null where a text is null or has no n-gram."""
        shared = rows.sparkSession.sparkContext.broadcast(self.vectors)  # BUCKETS rows, a fixed size
        rows = rows.drop("vector")
        names = [*rows.columns, "vector"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                columns = b.column(b.num_columns - 1)
                n = np.diff(columns.offsets.to_numpy())
                out = _summed(shared.value[columns.flatten().to_numpy()], np.cumsum(n) - n, n)
                size = np.sqrt((out * out).sum(axis=1))
                out /= np.maximum(size, 1e-300)[:, None]
                offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
                vector = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()), mask=pa.array(size <= 1e-12))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], vector], names=names)

        fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in rows.columns)
        return rows.withColumn("__columns", F.coalesce(buckets(F.col(text)), F.array().cast("array<int>"))).mapInArrow(run, f"{fields}vector array<double>")


def learn(components: DataFrame, text: str, *, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = 3) -> Subwords:
    """Learn from a column of texts; null texts and those without an n-gram take no part. The same rows give the same vectors, however they are
    split (up to the last bits of sums)."""
    rows = components.groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("n")).select(buckets(F.col("text")).alias("columns"), "n")
    rows = written(rows.filter(F.size("columns") > 0).groupBy("columns").agg(F.sum("n").alias("times")), "subwords")
    seen = {r["b"]: r["n"] for r in rows.select(F.explode(F.array_distinct("columns")).alias("b"), "times").groupBy("b").agg(F.sum("times").alias("n")).collect()}  # BUCKETS rows at most
    total, held = rows.agg(F.coalesce(F.sum("times"), F.lit(0))).collect()[0][0], np.zeros(BUCKETS)
    for b, n in seen.items():
        held[b] = np.log((total + 1) / (n + 0.5))
    thin = np.random.default_rng(seed).choice([-1.0, 1.0], (BUCKETS, dimensions + SPARE))
    for _ in range(rounds):
        thin = np.linalg.qr(_product(rows, held, thin))[0]
    small = thin.T @ _product(rows, held, thin)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-value, kind="stable")[:dimensions]
    axes = thin @ vector[:, best]
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)  # signs are free: the largest entry is positive
    return Subwords(axes * held[:, None])


def register(components: DataFrame, text: str, name: str = "subwords") -> Subwords:
    """Learn from these components and register the vectorizer under ``name``."""
    from .registry import VECTORIZERS

    VECTORIZERS[name] = learn(components, text)
    return VECTORIZERS[name]
