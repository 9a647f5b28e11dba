"""Exact uniform sharding by a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn first, from the multivariate hypergeometric law
that a uniform shuffle of all rows would follow. Each partition then deals its rows at random by its own
line of the matrix, the rows are exchanged, and inside a shard they are permuted again by random keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_root

#: numpy's own sampler takes populations below this.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows drawn without replacement are among the ``good`` ones. Large populations are drawn by inversion; what lies
    beyond 14 standard deviations weighs less than the last bit of the uniform number, so leaving it out changes no draw."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    mean = sample * good / (good + bad)
    reach = 14 * math.sqrt(mean * bad / (good + bad) + 1) + 50
    k = np.arange(max(low, int(mean - reach)), min(high, int(mean + reach)) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(sample - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - sample + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    odds = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(odds, rng.random() * odds[-1])])


def line(rng: np.random.Generator, left: np.ndarray | list[int], n: int) -> np.ndarray:
    """How many of the next ``n`` rows go to each shard, of which so many places are left."""
    out, pool = np.zeros(len(left), np.int64), int(sum(left))
    for s, places in enumerate(left):
        pool -= int(places)
        out[s] = n if pool == 0 else hypergeometric(rng, int(places), pool, n)
        n -= int(out[s])
    return out


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts by partition and shard with the given sums, as a uniform shuffle would make them."""
    rng = np.random.default_rng(seed)
    left, out = np.array(shards, np.int64), np.zeros((len(rows), len(shards)), np.int64)
    for p, n in enumerate(rows):
        out[p] = line(rng, left, n)
        left -= out[p]
    return out


def deal(df: DataFrame, n_shards: int, seed: int = 7) -> DataFrame:
    """All rows of ``df`` with ``shard`` and ``slot`` (columns of these names in ``df`` are replaced). Shard
    sizes differ by one row at most; slots are gapless from 0 in each shard; every assignment of rows to
    slots is equally likely. Nulls and repeated rows are rows as any other; no rows, no result rows. The frame is
    checkpointed, so a rerun task sees the same rows in its partition."""
    spark = df.sparkSession
    shared_root(spark)
    df = df.drop("shard", "slot").checkpoint()
    counts = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    total, parts = sum(counts.values()), max(counts, default=-1) + 1
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = spark.sparkContext.broadcast(communication_matrix([counts.get(p, 0) for p in range(parts)], sizes, seed))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        rng, left = np.random.default_rng([seed, 1, p]), None
        for b in batches:
            left = matrix.value[p].copy() if left is None else left
            n = b.num_rows
            # The next n cards of the partition's shuffled deck of shard numbers.
            part = line(rng, left, n)
            left -= part
            shard = rng.permutation(np.repeat(np.arange(n_shards), part)).astype(np.int32)
            key = rng.integers(0, 2**63 - 1, n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard), pa.array(key)], names=[*b.schema.names, "shard", "__key"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    dealt = df.mapInArrow(local, f"{fields}, shard int, __key long")
    width = max(1, math.isqrt(max(1, total // n_shards)))
    dealt = dealt.withColumn("__bucket", F.expr(f"__key div {(2**63 - 1) // width + 1}"))
    # Second permutation: slots follow the random keys, bucket by bucket.
    before = dealt.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("shard", "__bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("__bucket")) - F.col("n")).alias("__first"))
    rank = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("__key")) - 1
    return dealt.withColumn("__rank", rank).join(before, ["shard", "__bucket"]).select(*df.columns, "shard", (F.col("__first") + F.col("__rank")).cast("long").alias("slot"))


def op2_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law ``rows``; see ``deal``. Null and empty texts have size 1; equal texts are dealt like other rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = deal(rows, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
