"""M06, M07, A15 at any size: greedy n-way groups in rounds.

The greedy order takes candidate pairs by weight and merges the two tuples that a pair's components stand in. A pair that comes before all
other pairs of both its tuples can be decided at once, whatever the others do: pairs before it touch neither tuple. All such pairs of a round
are decided together, as joins of tables, so no project is ever one row; the groups are those of the pairs taken one after another.
When few pairs are left, the tail of long dependencies is taken project by project in single tasks.
"""

from __future__ import annotations

import functools
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlens.tables import written

from .matching import chains

#: Undecided pairs (of all projects together) that are taken one after another at the end; it bounds what a task can get.
FEW = 50_000


def pair_weight(a: Column, b: Column, documents: Column) -> Column:
    """The weight of a tuple of two components: properties that both hold, four times, over all they hold, by the documents' number squared."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 0.0).otherwise(4.0 * F.size(F.array_intersect(a, b)) / (documents * documents * every))


def tuple_weight(held: Column, documents: Column) -> Column:
    """As ``matching.match_weight``, of a map from properties to how many components of the tuple hold them."""
    total = F.aggregate(F.map_values(held), F.lit(0).cast("long"), lambda s, n: s + F.when(n > 1, n * n).otherwise(0))
    return F.when(F.size(held) == 0, 0.0).otherwise(total.cast("double") / (documents * documents * F.size(held)))


def _point(s: str) -> Column:
    return F.struct(F.col(f"file_{s}").cast("long").alias("file"), F.col(f"component_{s}").cast("long").alias("component"))


def n_way_rounds(elements: DataFrame, candidates: DataFrame, block: list[str], few: int = FEW) -> DataFrame:
    """The groups of ``matching.n_way``. ``elements``: block, file, component, attributes; ``candidates``: block, file_a, component_a, file_b,
    component_b (either way round, repeated or not). Returns block, match (numbered by first members), file, component; components without
    a partner are left out. Null attributes and repeated ones count once or not at all; pairs of unknown components are left out."""
    own = F.array_distinct(F.array_compact(F.coalesce("attributes", F.array().cast("array<string>"))))
    rows = elements.select(*block, F.struct(F.col("file").cast("long").alias("file"), F.col("component").cast("long").alias("component")).alias("node"), own.alias("attributes"))
    documents = elements.groupBy(*block).agg(F.count_distinct("file").alias("documents"))
    a, b = _point("a"), _point("b")
    both = candidates.select(*block, F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    side = lambda s: rows.select(*block, F.col("node").alias(s), F.col("attributes").alias(f"at_{s}"))
    met = both.join(side("a"), [*block, "a"]).join(side("b"), [*block, "b"]).join(documents, block)
    order = F.struct((-pair_weight(F.col("at_a"), F.col("at_b"), F.col("documents"))).alias("least"), "a", "b")
    # Each pair with the tuples its components stand in, named after their first components.
    pairs = met.select(*block, order.alias("order"), F.col("a").alias("x"), F.col("b").alias("y"))
    pairs = written(pairs, "nway-pairs")
    nodes = pairs.select(*block, F.col("x").alias("node")).union(pairs.select(*block, "y")).distinct()
    ones = F.map_from_arrays("attributes", F.transform("attributes", lambda _: F.lit(1).cast("long")))
    tuples = rows.join(nodes, [*block, "node"]).join(documents, block).select(*block, F.col("node").alias("tuple"), F.array(F.col("node.file")).alias("files"), ones.alias("held"), "documents")
    tuples = written(tuples, "nway-tuples")
    kept: list[DataFrame] = []
    while pairs.count() > few:
        best = pairs.select(*block, F.col("x").alias("tuple"), "order").union(pairs.select(*block, "y", "order")).groupBy(*block, "tuple").agg(F.min("order").alias("first"))
        of = lambda s: best.select(*block, F.col("tuple").alias(s), F.col("first").alias(f"first_{s}"))  # noqa: E731, B023
        decided = pairs.join(of("x"), [*block, "x"]).join(of("y"), [*block, "y"]).filter("order = first_x AND order = first_y").select(*block, "order", "x", "y")
        state = lambda s: tuples.select(*block, F.col("tuple").alias(s), F.col("files").alias(f"files_{s}"), F.col("held").alias(f"held_{s}"), *(["documents"] if s == "x" else []))  # noqa: E731, B023
        whole = F.map_zip_with("held_x", "held_y", lambda _, m, n: F.coalesce(m, F.lit(0)) + F.coalesce(n, F.lit(0)))
        judged = decided.join(state("x"), [*block, "x"]).join(state("y"), [*block, "y"]).withColumn("held", whole)
        weight, d = tuple_weight(F.col("held"), F.col("documents")), F.col("documents")
        fits = ~F.arrays_overlap("files_x", "files_y") & (weight > 0) & (weight >= tuple_weight(F.col("held_x"), d) + tuple_weight(F.col("held_y"), d))
        judged = judged.select(*block, "order", F.least("x", "y").alias("tuple"), F.greatest("x", "y").alias("gone"), fits.alias("fits"), F.concat("files_x", "files_y").alias("files"), "held", "documents")
        judged = written(judged, "nway-judged")
        merged = judged.filter("fits")
        kept.append(merged.select(*block, F.col("order.a").alias("a"), F.col("order.b").alias("b")))
        touched = merged.select(*block, "tuple").union(merged.select(*block, "gone"))
        tuples = tuples.join(touched, [*block, "tuple"], "left_anti").union(merged.select(tuples.columns))
        tuples = written(tuples, "nway-tuples")
        moved = merged.select(*block, "gone", F.col("tuple").alias("to"))
        left = pairs.join(judged.select(*block, "order"), [*block, "order"], "left_anti")
        for s in "xy":
            left = left.join(moved.withColumnsRenamed({"gone": s}), [*block, s], "left").withColumn(s, F.coalesce("to", s)).drop("to")
        pairs = written(left.filter("x <> y").select(pairs.columns), "nway-pairs")
    kept = written(functools.reduce(DataFrame.union, [*kept, _one_by_one(pairs, tuples, block)]), "nway-kept")
    name = lambda c: F.to_json(F.struct(*block, F.col(c).alias("node")))
    groups = chains(kept.select(name("a").alias("a"), name("b").alias("b")), "a", "b")
    members = kept.select(*block, F.col("a").alias("node")).union(kept.select(*block, "b")).distinct().withColumn("name", name("node"))
    members = members.join(groups.select(F.col("node").alias("name"), "label"), "name").select(*block, "node", "label")
    first = members.groupBy(*block, "label").agg(F.min("node").alias("first"))
    # A project's groups are numbered in the order of their first components.
    numbers = first.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("first", "label"))).alias("all")).select(*block, F.posexplode("all").alias("match", "one")).select(*block, F.col("match").cast("long").alias("match"), "one.label")
    return members.join(numbers, [*block, "label"]).select(*block, "match", F.col("node.file").alias("file"), F.col("node.component").alias("component"))


def _one_by_one(pairs: DataFrame, tuples: DataFrame, block: list[str]) -> DataFrame:
    """The accepted ones of the last pairs, in their order."""
    needed = pairs.select(*block, F.col("x").alias("tuple")).union(pairs.select(*block, "y")).distinct()
    two = tuples.join(needed, [*block, "tuple"], "left_semi")
    left = pairs.select(*block, "order", F.col("x").alias("tuple"), F.col("y").alias("other"), F.lit(None).cast("array<long>").alias("files"), F.lit(None).cast("array<struct<key: string, value: bigint>>").alias("held"), F.lit(None).cast("long").alias("documents"))
    right = two.select(*block, F.lit(None).cast(pairs.schema["order"].dataType).alias("order"), "tuple", F.lit(None).cast(pairs.schema["x"].dataType).alias("other"), "files", F.map_entries("held").alias("held"), "documents")

    def solve(t: pa.Table) -> pa.Table:
        of, ranked = {}, []
        pair = lambda p: (p["file"], p["component"])
        for r in t.drop_columns(block).to_pylist():
            if r["order"] is None:
                of[pair(r["tuple"])] = {"files": set(r["files"]), "held": Counter({e["key"]: e["value"] for e in r["held"]}), "names": [pair(r["tuple"])]}
                documents = r["documents"]
            else:
                ranked.append(((r["order"]["least"], pair(r["order"]["a"]), pair(r["order"]["b"])), pair(r["tuple"]), pair(r["other"])))
        weigh = lambda held: sum(n * n for n in held.values() if n > 1) / (documents * documents * len(held)) if held else 0.0
        out = []
        for (_, a, b), x, y in sorted(ranked):
            s, u = of[x], of[y]
            if s is u or s["files"] & u["files"]:
                continue
            held = s["held"] + u["held"]
            if weigh(held) > 0 and weigh(held) >= weigh(s["held"]) + weigh(u["held"]):
                s["files"] |= u["files"]
                s["held"] = held
                s["names"] += u["names"]
                for n in u["names"]:
                    of[n] = s
                out.append((a, b))
        kind = pa.struct([("file", pa.int64()), ("component", pa.int64())])
        points = [pa.array([{"file": p[k][0], "component": p[k][1]} for p in out], kind) for k in (0, 1)]
        return pa.table({**{c: t.column(c).take(pa.array([0] * len(out), pa.int64())) for c in block}, "a": points[0], "b": points[1]})

    fields = "".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}, " for c in block)
    return left.union(right).groupBy(*block).applyInArrow(solve, f"{fields}a struct<file: bigint, component: bigint>, b struct<file: bigint, component: bigint>")
