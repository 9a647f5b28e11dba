"""One-to-one matchings of least cost over the candidate edges that there are.

A document pair's edges are one Arrow group; memory is that of its edges, not of the product of its components. Documents of very many
components, whose candidate edges are sparse, are split further: components of documents that no way of edges joins are matched
apart from each other, each in a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.tables import written

THRESHOLD = 25.0


def match_edges(i: np.ndarray, j: np.ndarray, cost: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows 0 to n and columns 0 to m: as many edges as can be matched, at the least total cost. Returns each row's column (-1: none), and the
    prices of rows and columns, which prove it: no edge costs less than the two prices together, and matched edges cost just that.

    Each row in turn takes the cheapest way of swaps to a free column (Dijkstra over costs less prices), or leaves a row without one at a
    cost above any sum of edges. Parallel edges count at the least cost; ties go to the smallest column."""
    if n > m:
        back, v, u = match_edges(j, i, cost, m, n)
        out = np.full(n, -1, np.int64)
        taken = np.flatnonzero(back >= 0)
        out[back[taken]] = taken
        return out, u, v
    order = np.lexsort((cost, j, i))
    i, j, cost = i[order], j[order], cost[order].astype(float)
    first = np.ones(len(i), bool)
    first[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    i, j, cost = i[first], j[first], cost[first]
    edges = np.searchsorted(i, np.arange(n + 1)).tolist()
    to, price = j.tolist(), cost.tolist()
    low = min(price, default=0.0)
    alone = (n + 1) * (max(price, default=0.0) - low + 1.0) + abs(low)
    u = [min(price[edges[r] : edges[r + 1]], default=alone) for r in range(n)]
    v = [0.0] * m
    column, owner = [-1] * n, [-1] * m
    late = []
    for r in range(n):  # rows whose cheapest column is free take it
        for e in range(edges[r], edges[r + 1]):
            if price[e] == u[r] and owner[to[e]] < 0:
                column[r], owner[to[e]] = to[e], r
                break
        else:
            late.append(r)
    for r in late:
        far: dict[int, float] = {}
        via: dict[int, int] = {}
        done: list[int] = []
        closed: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, base, best, left = r, 0.0, float("inf"), r
        reached = [(r, 0.0)]
        while True:
            if base + alone - u[row] < best:
                best, left = base + alone - u[row], row
            shift = base - u[row]
            for e in range(edges[row], edges[row + 1]):
                k = to[e]
                d = shift + price[e] - v[k]
                if k not in closed and d < far.get(k, best):
                    far[k], via[k] = d, row
                    heappush(heap, (d, k))
            while heap and (heap[0][1] in closed or heap[0][0] > far[heap[0][1]]):
                heappop(heap)
            if not heap or heap[0][0] >= best:
                total, end = best, -1
                break
            base, k = heappop(heap)
            if owner[k] < 0:
                total, end = base, k
                break
            closed.add(k)
            done.append(k)
            row = owner[k]
            reached.append((row, base))
        for x, d in reached:
            u[x] += total - d
        for k in done:
            v[k] -= total - far[k]
        if end < 0:  # some row on the way is left without a column, and its column is free
            end, column[left] = column[left], -1
            if left == r:
                continue
        while True:
            x = via[end]
            before = column[x]
            column[x], owner[end] = end, x
            if x == r:
                break
            end = before
    return np.array(column, np.int64), np.array(u), np.array(v)


def assignment(pairs: DataFrame, block: list[str], threshold: float = THRESHOLD, *, split: bool = False) -> DataFrame:
    """For each pair of documents a one-to-one matching of the most edges at the least total cost; matches above the threshold are dropped after
    that. ``pairs``: block, file_a, component_a, file_b, component_b, cost: all pairs, or candidates alone. With ``split``, edges that no
    way of edges joins are solved in groups of their own; the matching is the same. Null costs are no edges; ties go to smaller
    components."""
    keys = [*block, "file_a", "file_b"]
    columns = [*keys, "component_a", "component_b", "cost"]
    rows = pairs.select(columns).filter("cost IS NOT NULL")
    group = keys
    if split:
        from .matching import chains

        rows = written(rows, "edges")
        node = lambda s: F.to_json(F.struct(*keys, F.lit(s).alias("side"), F.col(f"component_{s}").alias("c")))
        part = chains(rows.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
        rows = rows.withColumn("__node", node("a")).join(part.select(F.col("node").alias("__node"), F.col("label").alias("__part")), "__node").drop("__node")
        group = [*keys, "__part"]

    def solve(t: pa.Table) -> pa.Table:
        a, b, cost = (t.column(c).to_numpy() for c in ("component_a", "component_b", "cost"))
        xs, i = np.unique(a, return_inverse=True)
        ys, j = np.unique(b, return_inverse=True)
        at, _, _ = match_edges(i, j, cost, len(xs), len(ys))
        mine = np.flatnonzero(at[i] == j)
        mine = mine[np.lexsort((cost[mine], i[mine]))]
        mine = mine[np.flatnonzero(np.diff(i[mine], prepend=-1))]  # of parallel edges the cheapest
        return t.take(pa.array(mine[cost[mine] <= threshold]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups in a row: most are small, so many share a batch; the last one of a batch may go on in the next."""
        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            key = t.column("__group").combine_chunks()
            starts = [0, *(np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()]
            if held and held[-1].column("__group")[0] != key[0]:
                yield from solve(pa.concat_tables(held)).select(columns).to_batches()
                held = []
            found = []
            for s, e in zip(starts, [*starts[1:], len(t)]):
                held.append(t.slice(s, e - s))
                if e < len(t):
                    found.append(solve(pa.concat_tables(held)))
                    held = []
            if found:
                yield from pa.concat_tables(found).select(columns).combine_chunks().to_batches()
        if held:
            yield from solve(pa.concat_tables(held)).select(columns).to_batches()

    fields = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in columns)
    rows = rows.withColumn("__group", F.to_json(F.struct(*group))).repartition("__group").sortWithinPartitions("__group")
    return rows.select(*columns, "__group").mapInArrow(run, fields)
