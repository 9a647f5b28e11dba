"""Nearest neighbours by a hash-prefix forest.

Vectors are dealt over shards of bounded size. A shard has many trees; a tree is the sorted array of its vectors' hash
strings (signs of random projections, as one number), so all strings with a common prefix are a range of the array. A query descends
every tree to its longest prefix, then all trees ascend together, bit by bit, and what enters their ranges is scored on the
original vectors. The ascent stops where the best found so far leave little to miss: a vector as near as the worst of them shares a
prefix of this length with the query in some tree, but for a chance of MISS. So near neighbours take few candidates, and no number of
candidates is set. Every shard is asked, since any may hold a query's nearest vectors; each block's best are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Trees of a shard, bits of a string, and random directions from which each tree draws its bits.
TREES, BITS, DIRECTIONS = 400, 18, 768
#: The chance to miss a vector at the border of the neighbours; nearer ones are missed less often.
MISS = 0.12
#: Vectors of a shard and queries of a block, on average.
SHARD_ROWS, BLOCK_QUERIES = 65_536, 512


class Forest:
    """Trees over vectors whose inner products with a query count. A last coordinate brings all vectors to the largest one's length, so the
    angle to a query falls as the inner product rises."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        square = (vectors**2).sum(1)
        self.length = float(np.sqrt(square.max()))
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((vectors.shape[1] + 1, DIRECTIONS)).astype(np.float32)
        self.drawn = np.stack([rng.permutation(DIRECTIONS)[:BITS] for _ in range(TREES)])
        keys = self.strings(np.concatenate([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1))
        self.order = np.empty(keys.shape, np.int32)
        for t, k in enumerate(keys):
            self.order[t] = np.argsort(k)
            k[:] = k[self.order[t]]
        self.keys = keys

    def strings(self, x: np.ndarray) -> np.ndarray:
        """Hash strings by tree and vector; the first bit of a string is its number's highest."""
        signs = (x.astype(np.float32) @ self.directions > 0).T
        out = np.zeros((TREES, len(x)), np.uint32)
        for bit in range(BITS):
            out = out << np.uint32(1) | signs[self.drawn[:, bit]]
        return out

    def ranges(self, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where strings that share the first ``depth`` bits with each key stand, by tree."""
        low = keys >> np.uint32(BITS - depth) << np.uint32(BITS - depth)
        high = low + np.uint32(1 << (BITS - depth))
        begin = np.stack([np.searchsorted(k, x) for k, x in zip(self.keys, low)])
        return begin, np.stack([np.searchsorted(k, x) for k, x in zip(self.keys, high)])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, rank: int):
        """For each query the places and scores of its best ``k`` found, best first, ties to the smaller id, and how many
        vectors were scored. The ascent ends by the ``rank``-th best."""
        keys = self.strings(np.concatenate([queries, np.zeros((len(queries), 1))], 1))
        n = len(self.ids)
        at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        tree = np.arange(TREES)[:, None] * n
        flat = self.order.ravel()
        for q, x in enumerate(queries):
            seen = self.ids == own[q]
            found, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
            reach = self.length * float(np.sqrt(x @ x))
            for depth in range(BITS, -1, -1):
                if depth not in at:
                    at[depth] = self.ranges(keys, depth)
                begin, end = at[depth][0][:, q], at[depth][1][:, q]
                size = end - begin
                total = int(size.sum())
                if total < rank and depth:
                    continue
                ends = np.cumsum(size)
                place = np.repeat(begin + tree[:, 0] - ends + size, size) + np.arange(total)
                hit = np.zeros(n, bool)
                hit[flat[place]] = True
                new = np.flatnonzero(hit & ~seen)
                seen[new] = True
                found.append(new)
                scores.append(self.vectors[new] @ x)
                s = np.concatenate(scores)
                if len(s) >= rank:
                    worst = np.partition(s, len(s) - rank)[len(s) - rank]
                    same = 1 - math.acos(max(-1.0, min(1.0, worst / reach))) / math.pi
                    if (1 - same**depth) ** TREES <= MISS:
                        break
            found, s = np.concatenate(found), np.concatenate(scores)
            if len(s) > k:
                bar = np.partition(s, len(s) - k)[len(s) - k]
                found = found[s >= bar - 1e-9 * reach]
            exact = (self.vectors[found] * x).sum(1)  # row by row in one order: equal vectors score alike wherever they stand
            best = np.lexsort((self.ids[found], -exact))[:k]
            yield found[best], exact[best], len(s)


def share(k: int, shards: int) -> int:
    """How many of a query's best ``k`` one of so many random shards holds at most, but for three standard deviations."""
    mean = k / shards
    return min(k, math.ceil(mean + 3 * math.sqrt(mean * (1 - 1 / shards)) + (shards > 1)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``vectors`` and ``queries``: vec_id long, embedding array. Returns query_id, rank, vec_id, score (inner product in
    double precision, ties to the smaller id), at most k rows a query.

    A query's own id is no candidate. Null ids take no part; nor do vectors that are null, zero or that hold a null or a number that is
    not finite. Vectors of another length than the query's are no candidates of it. Equal vectors under different ids are different
    candidates; a repeated row counts once. No queries or no candidates give no rows; other columns are ignored."""
    spark = vectors.sparkSession
    as_double = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)").withColumn("dim", F.size("v"))
    rows, asked = written(as_double(vectors), "vectors"), written(as_double(queries), "queries")
    plan = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"))
    plan = plan.join(asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks")), "dim")
    plan = F.broadcast(written(plan, "plan"))  # a row for each length of vectors
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Each block of queries meets each shard once: both sides are copied to their pairs.
    ask = asked.join(plan, "dim").select(F.lit(1).alias("asks"), "vec_id", "v", "dim", "shards", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int").alias("block"), upto("shards").alias("shard"))
    have = rows.join(plan, "dim").select(F.lit(0).alias("asks"), "vec_id", "v", "dim", "shards", upto("blocks").alias("block"), F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, asks, shards = t.column("vec_id").to_numpy(), t.column("asks").to_numpy(), t.column("shards")[0].as_py()
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        own, at = np.unique(ids[asks == 0], return_index=True)
        q, first = np.unique(ids[asks == 1], return_index=True)
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(own) and len(q):
            forest = Forest(own, x[asks == 0][at])
            xs = x[asks == 1][first]
            for i in range(0, len(q), 128):
                for j, (found, scores, _) in enumerate(forest.search(xs[i : i + 128], q[i : i + 128], k, share(k, shards))):
                    out.append((np.full(len(found), q[i + j]), own[found], scores))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    best = ask.union(have).groupBy("dim", "block", "shard").applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_hash_prefix_forest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one; see ``search`` for nulls, ties and odd rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.filter("vec_id % 20 = 0"))
