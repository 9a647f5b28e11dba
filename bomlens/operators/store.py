"""Inspections and their jobs as tables: every change is a new table, written by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import grid

PENDING = ("fired",)


def created(repos: DataFrame, workers: list[str], insp_id: str, name: str) -> DataFrame:
    """The inspection's row; it expects a job for every project and tool."""
    n = repos.agg(F.count(F.lit(1)).alias("repo_count"))
    return n.select(F.lit(insp_id).alias("insp_id"), F.lit(name).alias("name"), F.lit("created").alias("status"), "repo_count", F.lit(len(workers)).cast("long").alias("worker_count"), (F.col("repo_count") * len(workers)).alias("expected_jobs"))


def issued(repos: DataFrame, workers: list[str], insp_id: str, sent_at: Column) -> DataFrame:
    """A job for every project and tool; the id is derived from both, so a task that runs again makes the same ones."""
    cells = grid(repos, workers)
    return cells.withColumn("insp_id", F.lit(insp_id)).withColumn("job_id", F.md5(F.concat_ws("|", F.lit(insp_id), F.col("repo").cast("string"), "worker"))).withColumn("status", F.lit("fired")).withColumn("sent_at", sent_at)


def cancelled(jobs: DataFrame, insp_id: str) -> DataFrame:
    """Pending jobs of an inspection are cancelled; final ones stay."""
    hit = (F.col("insp_id") == insp_id) & F.col("status").isin(*PENDING)
    return jobs.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))


def reset(jobs: DataFrame, insp_id: str) -> DataFrame:
    """An inspection's jobs go; results that come for them later match nothing."""
    return jobs.filter(F.col("insp_id") != insp_id)


def retried(jobs: DataFrame, insp_id: str, attempt: int) -> DataFrame:
    """New jobs for cells without a completed one; the old rows stay beside them."""
    own = jobs.filter(F.col("insp_id") == insp_id)
    open_ = own.select("repo", "worker").distinct().join(own.filter("status = 'completed'").select("repo", "worker"), ["repo", "worker"], "left_anti")
    new = open_.withColumn("insp_id", F.lit(insp_id)).withColumn("job_id", F.md5(F.concat_ws("|", F.lit(insp_id), F.col("repo").cast("string"), "worker", F.lit(attempt)))).withColumn("status", F.lit("fired"))
    return jobs.unionByName(new, allowMissingColumns=True)


def deleted(tables: dict[str, DataFrame], insp_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of these inspections."""
    return {name: t.join(insp_ids.select("insp_id"), "insp_id", "left_anti") for name, t in tables.items()}


def cached(dimension: DataFrame, now: Column, seconds: int = 86400) -> DataFrame:
    """Rows of a dimension that are still fresh."""
    return dimension.filter(F.col("fetched_at") > now - F.expr(f"INTERVAL {seconds} SECONDS"))


def enriched(repos: DataFrame, fetched: DataFrame) -> DataFrame:
    """Projects with fetched columns; a fetched value wins where there is a fetched row, even a null one."""
    extra = [c for c in fetched.columns if c != "repo"]
    got = fetched.select("repo", F.lit(True).alias("__got"), *[F.col(c).alias(f"__{c}") for c in extra])
    kept = [F.when(F.col("__got"), F.col(f"__{c}")).otherwise(F.col(c) if c in repos.columns else F.lit(None)).alias(c) for c in extra]
    return repos.join(got, "repo", "left").select(*[c for c in repos.columns if c not in extra], *kept)


def timer_totals(timers: DataFrame) -> DataFrame:
    """Elapsed seconds by timer, over all that measured."""
    return timers.groupBy("name").agg(F.sum("elapsed").alias("elapsed"), F.count(F.lit(1)).alias("laps"))


def looked_up(inspections: DataFrame, insp_id: str) -> DataFrame:
    """One inspection by id, its tools as a list; a list that can't be read is empty. ``inspections``: insp_id, workers_json."""
    tools = F.coalesce(F.from_json("workers_json", "array<string>"), F.array().cast("array<string>"))
    return inspections.filter(F.col("insp_id") == insp_id).withColumn("workers", tools)


def sized(repos: DataFrame, payloads: DataFrame) -> DataFrame:
    """A project's size; where it is zero or missing, that of its result, else 0. ``repos``: repo, size; ``payloads``: repo, size."""
    other = payloads.groupBy("repo").agg(F.max("size").alias("__size"))
    return repos.join(other, "repo", "left").withColumn("size", F.coalesce(F.nullif("size", F.lit(0)), "__size", F.lit(0))).drop("__size")
