"""N11, O08, M05 for blocks of any size: exact nearest neighbours over cells of bounded size.

Equal vectors of one file are one row, since they have the same neighbours and are equally far from all others. A large block is dealt to the cells of a few
of its own vectors (pivots), and large cells to chunks. Each vector first searches its own chunk, which bounds how far its neighbours can be; with that bound
and the triangle inequality it visits only the chunks that may hold a nearer one. Chunks lie in bundles of at most WIDE vectors, and a vector travels
once to a bundle, with a bit for each chunk that it visits there, so a task holds a bundle of candidates and as many queries, and the vectors on their
way are those of the block times its bundles, however small chunks are. Finds are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomlens.tables import written

from .matching import NEIGHBOURS, nearest

#: Vectors of a chunk at most (about; hashes deal them), and pivots of a block at most.
CHUNK, PIVOTS = 16_384, 64
#: Vectors of a bundle of chunks, and queries that meet it in one task (about).
WIDE = 16_384
#: Queries compared at once.
STEP = 512
_NEAR = "array<struct<distance: double, file: bigint, component: bigint, row: bigint>>"
_FOUND = pa.list_(pa.struct([("distance", pa.float64()), ("file", pa.int64()), ("component", pa.int64()), ("row", pa.int64())]))


def vectors(t: pa.Table, name: str) -> np.ndarray:
    column = t.column(name).combine_chunks()
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best(x: np.ndarray, x_file: np.ndarray, y: np.ndarray, y_file: np.ndarray, k: int, shut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` the k nearest rows of ``y`` of other files, in the order of distances and rows: where each row's finds begin, their rows and squared
    distances. A product of matrices finds those in reach; their distances are then summed coordinate by coordinate, so equal vectors are
    equally far. ``shut``: the rows of ``y`` that each row of ``x`` doesn't see."""
    begins, rows, fars = [np.zeros(1, np.int64)], [], []
    square = (y * y).sum(axis=1)
    wide = np.concatenate([y.T, square[None]]) if len(y) else np.zeros((x.shape[1] + 1 if x.ndim > 1 else 1, 0))
    for at in range(0, len(x) if len(y) else 0, STEP):
        q, f = x[at : at + STEP], x_file[at : at + STEP]
        slack = 1e-9 * ((q * q).sum(axis=1) + square.max() + 1e-300)
        rough = np.concatenate([-2 * q, np.ones((len(q), 1))], axis=1) @ wide  # squared distances, less the query's own square
        rough[f[:, None] == y_file[None]] = np.inf
        if shut is not None:
            rough[shut[at : at + STEP]] = np.inf
        least = np.minimum.reduceat(rough, np.arange(0, len(y), 32), axis=1) if len(y) >= 2048 >= 32 * k else rough  # k of these are k rows
        first = min(k, least.shape[1]) - 1
        bar = np.partition(least, first, axis=1)[:, first] + slack
        row, col = np.nonzero(rough <= np.where(np.isfinite(bar), bar, np.finfo(float).max)[:, None])
        far = np.zeros(len(row))
        for c in range(y.shape[1]):
            far += (q[row, c] - y[col, c]) ** 2
        order = np.lexsort((col, far, row))
        row, col, far = row[order], col[order], far[order]
        start = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - start[row] < k
        rows.append(col[keep])
        fars.append(far[keep])
        begins.append(begins[-1][-1] + np.searchsorted(row[keep], np.arange(len(q)), "right"))
    if not rows:
        return np.zeros(len(x) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(begins), np.concatenate(rows), np.concatenate(fars)


def top(x: np.ndarray, x_file: np.ndarray, y: np.ndarray, y_file: np.ndarray, y_component: np.ndarray, k: int) -> list[list[dict]]:
    """For each row of ``x`` the k nearest rows of ``y`` of other files: squared distance, file, component, in that order."""
    order = np.lexsort((y_component, y_file))
    y, y_file, y_component = y[order], y_file[order], y_component[order]
    begin, row, far = best(x, x_file, y, y_file, k)
    return [[{"distance": float(far[s]), "file": int(y_file[row[s]]), "component": int(y_component[row[s]])} for s in range(begin[r], begin[r + 1])] for r in range(len(x))]


def _found(begin: np.ndarray, row: np.ndarray, far: np.ndarray, t: pa.Table) -> pa.Array:
    some = t.select(["file", "component", "row"]).take(pa.array(row))
    parts = [pa.array(far), *[some.column(c).combine_chunks() if len(some) else pa.array([], pa.int64()) for c in ("file", "component", "row")]]
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.StructArray.from_arrays(parts, fields=list(_FOUND.value_type)))


def nearest_in_chunks(elements: DataFrame, block: list[str], k: int = NEIGHBOURS, *, chunk: int = CHUNK, pivots: int = PIVOTS) -> DataFrame:
    """The rows of ``matching.nearest``: block, file_a, component_a, file_b, component_b, distance (squared), rank. Blocks of at most ``chunk`` vectors are one
    group each, larger ones are dealt out; results are the same. Elements without a vector take no part."""
    rows = elements.filter("vector IS NOT NULL").select(*block, F.col("file").cast("long").alias("file"), F.col("component").cast("long").alias("component"), "vector")
    sizes = rows.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")).filter("chunks > 1")
    if not sizes.limit(1).count():
        return nearest(rows, block, k)
    sizes = written(sizes, "knn-sizes")
    small = nearest(rows.join(sizes.select(*block), block, "left_anti"), block, k)
    columns = ["file_a", "component_a", "file_b", "component_b", "distance", "rank"]
    return small.select(*block, *columns).union(_large(rows.join(sizes.select(*block), block, "left_semi"), block, k, chunk, pivots).select(*block, *columns))


def _large(elements: DataFrame, block: list[str], k: int, chunk: int, pivots: int) -> DataFrame:
    # Equal vectors are told by 128 bits, so that they needn't cross the network to meet.
    keyed = elements.withColumns({"h1": F.xxhash64(F.lit(1), "vector"), "h2": F.xxhash64(F.lit(2), "vector")})
    grouped = keyed.groupBy(*block, "file", "h1", "h2").agg(F.min("component").alias("component"), F.any_value("vector").alias("vector"))
    grouped = written(grouped.withColumn("row", F.monotonically_increasing_id()), "knn-vectors")
    members = written(keyed.drop("vector").join(grouped.select(*block, "file", "h1", "h2", "row"), [*block, "file", "h1", "h2"]).select(*block, "row", "file", "component"), "knn-members")
    rows = grouped.select(*block, "file", "component", "row", "vector")
    sizes = rows.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"), F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias("buckets"))
    sizes = written(sizes, "knn-sizes")
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in block) + f"file long, component long, row long, vector {rows.schema['vector'].dataType.simpleString()}"
    hashed = lambda seed, n: F.pmod(F.xxhash64("row", F.lit(seed)), n).cast("int")
    nth = F.row_number().over(Window.partitionBy(*block).orderBy(F.xxhash64("component", "file"), "file", "component", "row"))
    centres = written(rows.withColumn("cell", nth).filter(F.col("cell") <= pivots).join(sizes, block).filter("cell <= chunks").select(*block, "cell", F.col("vector").alias("centre")), "knn-centres")
    #: A copy of the block's pivots for each group of its rows.
    copies = lambda c: c.join(sizes, block).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).drop("chunks", "buckets")
    bucketed = lambda r: r.join(sizes, block).withColumn("bucket", hashed(1, F.col("buckets"))).drop("chunks", "buckets")
    key = [*block, "bucket"]

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        x, p = vectors(left, "vector"), vectors(right, "centre")
        order = np.argsort(right.column("cell").to_numpy(), kind="stable")
        far = np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in p[order]], axis=1) if len(x) else np.zeros((0, len(p)))
        at = far.argmin(axis=1)
        t = left.drop_columns(["bucket"])
        return t.append_column("cell", right.column("cell").take(pa.array(order[at]))).append_column("far", pa.array(far[np.arange(len(x)), at]))

    placed = written(bucketed(rows).groupBy(*key).cogroup(copies(centres).groupBy(*key)).applyInArrow(place, f"{kinds}, cell int, far double"), "knn-placed")
    cells = placed.groupBy(*block, "cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"), F.max("far").alias("radius"))
    # Chunks are numbered cell by cell; there are no more cells than pivots.
    cells = written(cells.withColumn("first", (F.sum("parts").over(Window.partitionBy(*block).orderBy("cell")) - F.col("parts")).cast("int")), "knn-cells")
    dealt = placed.join(cells.drop("radius"), [*block, "cell"]).withColumn("part", F.col("first") + hashed(2, F.col("parts"))).drop("parts", "first")

    def alone(t: pa.Table) -> pa.Table:
        t = t.sort_by([("file", "ascending"), ("component", "ascending"), ("row", "ascending")])
        x, file = vectors(t, "vector"), t.column("file").to_numpy()
        begin, row, far = best(x, file, x, file, k)
        full = np.diff(begin) == k
        reach = np.full(len(x), np.inf)
        reach[full] = np.sqrt(far[begin[1:][full] - 1])
        return t.append_column("reach", pa.array(reach)).append_column("near", _found(begin, row, far, t))

    searched = written(dealt.groupBy(*block, "part").applyInArrow(alone, f"{kinds}, cell int, far double, part int, reach double, near {_NEAR}"), "knn-searched")
    known = copies(centres.join(cells, [*block, "cell"]))
    each = max(1, WIDE // chunk)  # chunks of a bundle

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        x, p = vectors(left, "vector"), vectors(right, "centre")
        own, mine, part, reach = (left.column(c).to_numpy() for c in ("far", "cell", "part", "reach"))
        names, parts, firsts, radii = (right.column(c).to_numpy() for c in ("cell", "parts", "first", "radius"))
        visits = np.zeros((len(x), -(-int(parts.sum()) // each) * each), bool)
        for j in range(len(p)):
            d = np.sqrt(((x - p[j]) ** 2).sum(axis=1))
            least = np.maximum(d - radii[j], (d - own) / 2)  # a cell's vectors lie within its radius, and nearer to its pivot than to any other
            near = (least * (1 - 1e-9) - 1e-9 <= reach) | (mine == names[j])
            visits[:, firsts[j] : firsts[j] + parts[j]] = near[:, None]
        visits[np.arange(len(x)), part] = False
        out = []
        for b in range(visits.shape[1] // each):
            bits = visits[:, b * each : (b + 1) * each]
            who = np.flatnonzero(bits.any(axis=1))
            packed = np.packbits(bits[who], axis=1)
            t = left.select([*block, "row"]).take(pa.array(who))
            out.append(t.append_column("bundle", pa.array(np.full(len(who), b, np.int32))).append_column("bits", pa.array([m.tobytes() for m in packed], pa.binary())))
        return pa.concat_tables(out)

    asked = bucketed(searched.select(*block, "row", "vector", "far", "cell", "part", "reach"))
    route_kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in block)
    visits = written(asked.groupBy(*key).cogroup(known.groupBy(*key)).applyInArrow(route, f"{route_kinds}row long, bundle int, bits binary"), "knn-visits")
    # A bundle that many ask is copied once for each WIDE askers.
    turns = written(visits.groupBy(*block, "bundle").agg(F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias("turns")), "knn-turns")
    spot = [*block, "bundle"]
    queries = visits.join(searched.select("row", "file", "vector", "cell", "part"), "row").join(turns, spot).withColumn("turn", hashed(3, F.col("turns"))).drop("turns")
    held = dealt.withColumn("bundle", (F.col("part") / each).cast("int")).select(*spot, "file", "component", "row", "vector", "part").join(turns, spot).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("cell", "ascending"), ("row", "ascending")])  # queries of a cell visit much the same chunks
        right = right.sort_by([("part", "ascending"), ("file", "ascending"), ("component", "ascending"), ("row", "ascending")])
        x, y, f, g = vectors(left, "vector"), vectors(right, "vector"), left.column("file").to_numpy(), right.column("file").to_numpy()
        near = pa.chunked_array([], _FOUND)
        if len(left) and len(right):
            base = right.column("part")[0].as_py() // each * each
            chunk_of = right.column("part").to_numpy() - base
            bits = np.unpackbits(np.frombuffer(b"".join(left.column("bits").to_pylist()), np.uint8).reshape(len(left), -1), axis=1).astype(bool)
            mine = left.column("part").to_numpy() - base
            component, row_id = right.column("component").to_numpy(), right.column("row").to_numpy()
            found = []
            for at in range(0, len(x), STEP):
                some = slice(at, at + STEP)
                open_ = np.flatnonzero(bits[some].any(axis=0)[chunk_of])
                at_y = open_[np.lexsort((row_id[open_], component[open_], g[open_]))]
                hidden = chunk_of[at_y][None] == mine[some][:, None]  # its own chunk was searched before
                begin, row, far = best(x[some], f[some], y[at_y], g[at_y], k, hidden)
                found.append(_found(begin, at_y[row], far, right))
            near = pa.chunked_array(found, _FOUND)
        return left.select([*block, "row"]).append_column("near", near)

    more = queries.groupBy(*spot, "turn").cogroup(held.groupBy(*spot, "turn")).applyInArrow(meet, f"{route_kinds}row long, near {_NEAR}")
    all_ = searched.select(*block, "row", "near").union(more)
    merged = all_.groupBy(*block, "row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    # Rows of several components: the first ones are found, and all of them find.
    found = merged.select(F.col("row").alias("asker"), F.explode("near").alias("n")).select("asker", "n.distance", "n.row")
    nth = F.row_number().over(Window.partitionBy("row").orderBy("component"))
    first = members.select("row", F.col("file").alias("file_b"), "component").withColumn("nth", nth).filter(F.col("nth") <= k)
    found = found.join(first, "row").select("asker", F.struct("distance", F.col("file_b").alias("file"), "component").alias("n"))
    found = found.groupBy("asker").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("near"))
    out = members.join(found, F.col("row") == F.col("asker")).select(*block, F.col("file").alias("file_a"), F.col("component").alias("component_a"), F.posexplode("near").alias("at", "n"))
    return out.select(*block, "file_a", "component_a", F.col("n.file").alias("file_b"), F.col("n.component").alias("component_b"), F.col("n.distance").alias("distance"), (F.col("at") + 1).cast("int").alias("rank"))
