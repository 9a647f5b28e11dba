"""Search, ranking, pages, quotas and ordered de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds_all(hay: Column, tokens: list[str]) -> Column:
    """Every token stands somewhere in the lower-cased text; no tokens, true."""
    out = F.lit(True)
    for t in tokens:
        out = out & F.lower(hay).contains(t.lower())
    return out


def deep_search(text: Column, tokens: list[str], *meta: tuple[str, Column]) -> Column:
    """Tokens in ``key:value`` lines of metadata or in the document's first 100000 characters."""
    lines = [F.concat(F.lit(k + ":"), c.cast("string")) for k, c in meta]
    return holds_all(F.concat_ws("\n", *lines, F.substring(text, 1, 100_000)), tokens)


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """Partial top-k in every task, then one merge of k rows a task."""
    return rows.orderBy(*order).limit(k)


def quotas(limit: int, strata: list[str]) -> dict[str, int]:
    """The limit over the strata, the remainder to the first ones."""
    each, rest = divmod(limit, len(strata))
    return {s: each + (i < rest) for i, s in enumerate(strata)}


def quota_top(rows: DataFrame, stratum: str, limits: dict[str, int], *order: Column) -> DataFrame:
    """The best rows of each stratum up to its quota. The rank filter is pushed below the exchange as a group limit."""
    quota = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    most = max(limits.values(), default=0)
    ranked = rows.filter(F.col(stratum).isin(list(limits))).withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)))
    return ranked.filter(F.col("rank") <= most).filter(F.col("rank") <= F.element_at(quota, F.col(stratum)))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of 10 to 500 rows, counted from 1."""
    size = min(500, max(10, size))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return best.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])


def match_rank(groups: DataFrame, keys: list[str], cost: str, at: str) -> DataFrame:
    """Ranks from 1 by cost, ties and missing costs by their place."""
    order = [F.col(cost).asc_nulls_last(), F.col(at)]
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def argmax(rows: DataFrame, keys: list[str], value: str, score: str) -> DataFrame:
    """The value with the largest score, ties to the smallest value."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col(score), F.col(value))).alias(value))


def prefix_lookup(rows: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """The row with this id, else those whose ids begin so; the caller sees if there is more than one."""
    exact = F.col(id_col) == prefix
    hits = rows.filter(F.col(id_col).startswith(prefix)).withColumn("__exact", exact)
    any_ = hits.agg(F.coalesce(F.max("__exact"), F.lit(False)).alias("__any"))  # one row
    return hits.crossJoin(F.broadcast(any_)).filter("__exact OR NOT __any").drop("__exact", "__any")


def first_hit(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """For each key the row of the first table that has it."""
    union = None
    for i, t in enumerate(tables):
        t = t.withColumn("__at", F.lit(i))
        union = t if union is None else union.unionByName(t)
    return first_of(union, keys, "__at").drop("__at")


#: Names of a tool's output, the best first (fixed values), and the folder that goes first.
OUTPUTS, FOLDER = ["manifest.spdx.json", "manifest.json", "bom.json", "sbom.json", "cyclonedx.json"], "_manifest"


def best_output(files: DataFrame, keys: list[str]) -> DataFrame:
    """Which of a tool's files is its document: the first known name anywhere in the manifest folder, then any JSON file there,
    then a known name at the top. ``files``: keys, path (relative, with slashes). Ties go to the smallest path; without such a file, no row."""
    parts = F.split("path", "/")
    name, inside, top = F.element_at(parts, -1), F.element_at(parts, 1) == FOLDER, F.size(parts) == 1
    known = F.array_position(F.array(*map(F.lit, OUTPUTS)), name)
    n = len(OUTPUTS)
    order = F.when(inside & (known > 0), known).when(inside & name.endswith(".json"), n + 1).when(top & (known > 0), known + n + 1)
    rows = files.withColumn("__order", order).filter("__order IS NOT NULL")
    return rows.groupBy(*keys).agg(F.min_by("path", F.struct("__order", "path")).alias("path"))


def scanned_keys(keys: DataFrame) -> DataFrame:
    """Keys of the form insp:<inspection>:job:<job> of all inspections as columns; other keys go. ``keys``: key."""
    found = lambda i: F.regexp_extract("key", "^insp:([^:]*):job:(.*)$", i)
    return keys.filter(F.col("key").rlike("^insp:[^:]*:job:")).select(found(1).alias("insp_id"), found(2).alias("job_id"))


def tail(lines: Column, n: int = 10) -> Column:
    """The last ``n`` of a list of lines."""
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n)
