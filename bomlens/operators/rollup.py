"""Roll-ups of components by type, asset and name, and the comparison of tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomlens.functions.scalars import is_crypto_type


def component_rollup(components: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts over nothing, type, asset and name at once; ``level`` is how many of the three hold. Columns that
    a level sums over are null."""
    cols = [*keys, "type", "asset", "name"]
    rolled = components.rollup(*cols) if not keys else components.groupingSets([cols, cols[:-1], cols[:-2], list(keys)], *cols)
    level = 3 - sum(F.grouping(c) for c in ("type", "asset", "name"))
    return rolled.agg(level.cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


def comparison_table(counts: DataFrame, workers: list[str]) -> DataFrame:
    """``counts``: repo, worker, type, asset, name, n. One row for each base name with a column for each tool.

    A name's part up to its first hyphen is its base. Bases with one suffix and no count of their own keep it in
    the name; others list their suffixes in brackets, in code-point order. Rows without project or tool are
    dropped; tools that aren't asked for still count for the suffixes."""
    name = F.trim(F.coalesce("name", F.lit("")))
    base = F.substring_index(name, "-", 1)
    suffix = F.substring(name, F.length(base) + 1, F.length(name))
    rows = counts.filter("repo IS NOT NULL AND worker IS NOT NULL AND repo <> '' AND worker <> ''")
    rows = rows.select("repo", "worker", F.coalesce(F.nullif("type", F.lit("")), F.lit("(unknown)")).alias("type"), F.coalesce("asset", F.lit("")).alias("asset"), base.alias("base"), F.when(suffix == "-", "").otherwise(suffix).alias("suffix"), "n")
    cells = rows.groupBy("repo", "type", "asset", "base", "suffix", "worker").agg(F.sum("n").alias("n"))
    table = cells.groupBy("repo", "type", "asset", "base").agg(
        *[F.coalesce(F.sum(F.when(F.col("worker") == w, F.col("n"))), F.lit(0)).cast("long").alias(w) for w in workers],
        F.array_sort(F.collect_set(F.when(F.col("suffix") != "", F.col("suffix")))).alias("__s"),
        F.coalesce(F.bool_or((F.col("suffix") == "") & (F.col("n") != 0)), F.lit(False)).alias("__own"),
    )
    listed = F.array_join("__s", ", ")
    shown = (
        F.when(F.size("__s") == 0, F.col("base"))
        .when(F.col("base") == "", listed)
        .when((F.size("__s") == 1) & ~F.col("__own"), F.concat("base", F.element_at("__s", 1)))
        .otherwise(F.concat("base", F.lit(" ("), listed, F.lit(")")))
    )
    return table.select("repo", "type", "asset", "base", shown.alias("name"), *workers)


def crypto_totals(counts: DataFrame, workers: list[str], excluded: list[str]) -> DataFrame:
    """Each tool's components whose types aren't excluded; every tool has a row."""
    kept = F.when(~F.lower("type").isin([t.lower() for t in excluded]), F.col("n")).otherwise(0)
    sums = counts.groupBy("worker").agg(F.sum(kept).alias("n"))
    every = counts.sparkSession.createDataFrame([(w,) for w in workers], "worker string")
    return every.join(F.broadcast(sums.filter(F.col("worker").isin(workers))), "worker", "left").select("worker", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # a row for each tool


def excluded_types(components: DataFrame) -> DataFrame:
    """Observed types that aren't cryptographic."""
    return components.select(F.lower("type").alias("type")).distinct().filter(~is_crypto_type(F.col("type")))


def trend(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """The least-squares line of ``y`` over ``x`` for each key."""
    return rows.groupBy(key).agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.count(F.lit(1)).alias("n"))
