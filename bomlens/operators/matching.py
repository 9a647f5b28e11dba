"""Component matching across tools: neighbours, assignment, trees, chains and n-way groups.

Neighbours are joined block by block in Spark. What needs all components of one project at a time (assignment, n-way groups)
runs as one Arrow group for each project, whose size is that of its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomlens.tables import written

from .assigning import THRESHOLD, assignment
from .batches import greedy, packed, runs
from .trees import parse, plain

NEIGHBOURS = 3
FORBIDDEN = 1e9


def attributes(*cs: Column) -> Column:
    """The distinct present attributes of a component."""
    return F.array_distinct(F.filter(F.array(*cs), lambda x: x.isNotNull() & (x != "")))


def nearest(elements: DataFrame, block: list[str], k: int = NEIGHBOURS) -> DataFrame:
    """In each block the k nearest elements of other documents by Euclidean distance, ties to smaller file and component.
    ``elements``: block columns, file, component, vector. A block is one project's components and is held by one task; it
    compares 1024 of them at a time with all, so that pairs are never rows. Elements without a vector take no part."""
    rows = elements.filter("vector IS NOT NULL").select(*block, "file", "component", F.col("vector").cast("array<double>").alias("vector"))

    def solve(t: pa.Table) -> pa.Table:
        x = np.array(t.column("vector").to_pylist(), np.float64)
        file, component = t.column("file").to_numpy(), t.column("component").to_numpy()
        order = np.lexsort((component, file))
        x, file, component = x[order], file[order], component[order]
        out = []
        for at in range(0, len(x), 1024):
            some = slice(at, at + 1024)
            far = np.zeros((len(x[some]), len(x)))
            for c in range(x.shape[1]):
                far += (x[some, c, None] - x[None, :, c]) ** 2
            far[file[some, None] == file[None, :]] = np.inf
            first = min(k, len(x)) - 1
            bar = np.partition(far, first, axis=1)[:, first]
            for i, row in enumerate(far):
                near = np.flatnonzero((row <= bar[i]) & (row < np.inf))
                near = near[np.argsort(row[near], kind="stable")][:k]
                out += [(at + i, j, r + 1, row[j]) for r, j in enumerate(near)]
        i, j, rank, distance = (np.array(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        i, j = i.astype(np.int64), j.astype(np.int64)
        cols = {b: t.column(b).take(pa.array(order[i])) for b in block}
        cols |= {"file_a": file[i], "component_a": component[i], "file_b": file[j], "component_b": component[j], "distance": distance.astype(np.float64), "rank": rank.astype(np.int32)}
        return pa.table(cols)

    kind = lambda c: rows.schema[c].dataType.simpleString()
    fields = [f"`{b}` {kind(b)}" for b in block] + [f"{c}_{s} {kind(c)}" for s in "ab" for c in ("file", "component")]
    return rows.groupBy(*block).applyInArrow(solve, ", ".join([*fields, "distance double", "rank int"]))


def pairwise(elements: DataFrame, block: list[str], cost, *, pivot: bool) -> DataFrame:
    """The cost of each pair of components of different documents of a block; with ``pivot``, of the largest document
    (the first of the largest) and each other one."""
    rows = elements
    if pivot:
        sizes = elements.groupBy(*block, "file").agg(F.count(F.lit(1)).alias("n"))
        first = sizes.groupBy(*block).agg(F.max_by("file", F.struct("n", -F.col("file"))).alias("pivot"))
        rows = elements.join(first, block)
    rest = [c for c in elements.columns if c not in block]
    a = rows.select(*block, *[F.col(c).alias(f"{c}_a") for c in rest], *(["pivot"] if pivot else []))
    b = elements.select(*block, *[F.col(c).alias(f"{c}_b") for c in rest])
    if pivot:  # only the pivot's rows meet the others
        a = a.filter("file_a = pivot").drop("pivot")
    pairs = a.join(b, block).filter("file_a <> file_b")
    return pairs.withColumn("cost", cost)


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a least-cost perfect matching of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    row_of, u, v = np.full(n + 1, -1), np.zeros(n), np.zeros(n + 1)
    for r in range(n):
        row_of[n], now = r, n
        least, back, seen = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[now] >= 0:
            seen[now] = True
            reach = cost[row_of[now]] - u[row_of[now]] - v[:n]
            better = ~seen[:n] & (reach < least)
            least[better], back[better] = reach[better], now
            open_ = np.where(seen[:n], np.inf, least)
            new = int(np.argmin(open_))
            step = open_[new]
            used = np.flatnonzero(seen)
            u[row_of[used]] += step
            v[used] -= step
            least[~seen[:n]] -= step
            now = new
        while now != n:
            row_of[now] = row_of[back[now]]
            now = back[now]
    out = np.empty(n, np.int64)
    out[row_of[:n]] = np.arange(n)
    return out


def chains(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: node and the smallest node that edges reach. Labels are written to the checkpoint folder each
    round, so plans stay short and lost executors cost nothing; rounds end when no label changes."""
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(b, a)).distinct(), "chain-edges")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("label")), "chain-labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).select(F.col("x").alias("node"), "label")
        low = labels.union(near).groupBy("node").agg(F.min("label").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
        new = written(low.join(jump, low["label"] == jump["via"], "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label")), "chain-labels")
        was = labels.select("node", F.col("label").alias("was"))
        if not new.join(was, "node").filter("label <> was").limit(1).count():
            return new
        labels = new


def match_weight(sets: list[frozenset], documents: int) -> float:
    """The weight of a tuple of elements: properties count with the square of how many of its elements hold them."""
    held: dict = {}
    for s in sets:
        for p in s:
            held[p] = held.get(p, 0) + 1
    return sum(n * n for n in held.values() if n > 1) / (documents * documents * len(held)) if held else 0.0


def n_way(elements: DataFrame, candidates: DataFrame, block: list[str], limit_s: float | None = None, limits: DataFrame | None = None) -> DataFrame:
    """Tuples with at most one component of each document. Candidate pairs are taken by weight, ties by file and component;
    two tuples merge if no document comes twice and the whole weight does not fall. ``elements``: block, file, component, attributes;
    ``candidates``: block, file_a, component_a, file_b, component_b. Returns block, match, file, component; singletons are left out.
    A project is held by one task, as columns; ``nway.n_way_rounds`` takes projects of any size. Of several rows of a component the last one's attributes
    count, pairs of unknown components are left out. With ``limit_s`` (M13), or a project's own limit in
    ``limits`` (block, limit_s), a project that takes longer is stopped and gives the single row of match -1; the others keep their groups."""
    long = lambda *cs: [F.col(c).cast("long").alias(c) for c in cs]
    one = elements.select(*block, *long("file", "component"), "attributes", *[F.lit(None).cast(t).alias(c) for c, t in (("file_b", "long"), ("component_b", "long"), ("limit_s", "double"))])
    two = candidates.join(limits.select(*block, "limit_s"), block, "left") if limits is not None else candidates.withColumn("limit_s", F.lit(limit_s).cast("double"))
    two = two.select(*block, F.col("file_a").cast("long").alias("file"), F.col("component_a").cast("long").alias("component"), F.lit(None).cast(elements.schema["attributes"].dataType).alias("attributes"), *long("file_b", "component_b"), F.col("limit_s").cast("double"))

    def solve(t: pa.Table, project: np.ndarray) -> pa.Table:
        pair = t.column("file_b").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        e, c = t.filter(pa.array(~pair)), t.filter(pa.array(pair))
        ids = lambda x, at, *names: (project[at], *(x.column(n).to_numpy() for n in names))
        keys = ids(e, ~pair, "file", "component")
        if not len(e) or not len(c):
            return out_of(t, [], [], [])
        node, first = runs(*keys)
        last = np.append(first[1:], len(e)) - 1
        # The rows of the pairs' components: pairs and components in one order.
        found = []
        for names in (("file", "component"), ("file_b", "component_b")):
            every = [np.concatenate([k[last], v]) for k, v in zip(keys, ids(c, pair, *names))]
            order = np.lexsort((np.arange(len(every[0])), *every[::-1]))
            of, start = runs(*[v[order] for v in every])
            head = order[start[of]]
            at = np.empty(len(order), np.int64)
            at[order] = np.where(head < len(last), head, -1)
            found.append(at[len(last) :])
        real = (found[0] >= 0) & (found[1] >= 0)
        a, b = found[0][real], found[1][real]
        limit = c.column("limit_s").combine_chunks().fill_null(np.inf).to_numpy(zero_copy_only=False)[real]
        rows, match, late = greedy(keys[0][last], keys[1][last], e.column("attributes").combine_chunks().take(pa.array(last)), a, b, limit if np.isfinite(limit).any() else None)
        return out_of(e, [*last[rows], *last[a[late]]], [*match, *[-1] * len(late)], len(rows))

    def out_of(t: pa.Table, rows: list, match: list, real) -> pa.Table:
        some = t.take(pa.array(rows, pa.int64()))
        match = np.array(match, np.int64)
        kept = np.arange(len(match)) < (real or 0)
        return pa.table({k: some.column(k) for k in block} | {"match": pa.array(match)} | {k: pa.array(np.where(kept, some.column(k).to_numpy(), -1)) for k in ("file", "component")})

    fields = ", ".join(f"`{c}` {elements.schema[c].dataType.simpleString()}" for c in block)
    return packed(one.unionByName(two), block, ["file_b", "file", "component", "attributes"], {}, solve, f"{fields}, match long, file long, component long")


def _escaped(text: str) -> str:
    """Braces and backslashes of plain text are escaped."""
    return "".join("\\" + c if c in "{}\\" else c for c in plain(text))


def bracket(value) -> str:
    """A JSON value as a tree in bracket notation; what is still to be written stands on a stack, so depth is no limit."""
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]  # whether it is text that is written as it is
    while todo:
        done, v = todo.pop()
        if done:
            out.append(v)
        elif isinstance(v, dict):
            out.append("{\\{\\}")
            todo.append((True, "}"))
            for k, x in reversed(v.items()):
                todo += [(True, "}"), (False, x), (True, "{\"" + _escaped(k) + "\":")]
        elif isinstance(v, list):
            out.append("{[]")
            todo.append((True, "}"))
            todo += [(False, x) for x in reversed(v)]
        elif v is None:
            out.append("{null}")
        else:
            out.append("{" + (f'"{_escaped(v)}"' if isinstance(v, str) else _escaped(str(v))) + "}")
    return "".join(out)


@F.pandas_udf(T.StringType())
def bracket_notation(texts):
    """J13 on a column of JSON texts; null where the text is none."""

    def one(t):
        try:
            return bracket(parse(t)) if t is not None else None
        except ValueError:
            return None

    return texts.map(one)


def match_groups(elements: DataFrame, block: list[str], cost, *, pivot: bool, threshold: float = THRESHOLD) -> DataFrame:
    """Pairwise costs, assignments, and chains of matched components. Nodes are ``block/file/component``."""
    found = assignment(pairwise(elements, block, cost, pivot=pivot), block, threshold)
    node = lambda s: F.concat_ws("/", *[F.col(c).cast("string") for c in block], F.col(f"file_{s}").cast("string"), F.col(f"component_{s}").cast("string"))
    edges = written(found, "matches").select(node("a").alias("a"), node("b").alias("b"), "cost")
    costs = edges.select(F.col("a").alias("node"), "cost").union(edges.select("b", "cost")).groupBy("node").agg(F.min("cost").alias("cost"))
    return chains(edges, "a", "b").join(costs, "node").select("node", F.col("label").alias("chain"), "cost")
