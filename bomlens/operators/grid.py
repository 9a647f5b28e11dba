"""The grid of projects and tools with the state of every job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlens.functions.scalars import STATUSES, job_status

LAST = "__last"


def grid(repos: DataFrame, workers: list[str]) -> DataFrame:
    """Every project with every tool; the tools are a literal list, so nothing is joined."""
    return repos.withColumn("worker", F.explode(F.array(*[F.lit(w) for w in workers])))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``, found by a partial maximum before any exchange."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias(LAST))
    return best.select(*keys, *[F.col(f"{LAST}.{c}").alias(c) for c in rest])


def with_status(cells: DataFrame, jobs: DataFrame) -> DataFrame:
    """Cells with their job's status; a cell without a job is pending. ``jobs``: repo, worker, status, payload_status."""
    joined = cells.join(jobs, ["repo", "worker"], "left")
    return joined.withColumn("status", job_status(F.col("status"), F.col("payload_status")))


def status_counts(cells: DataFrame) -> DataFrame:
    """Jobs of each tool by status, zero where there are none."""
    return cells.groupBy("worker").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def worker_summary(cells: DataFrame, components: Column) -> DataFrame:
    """Jobs, failures, timeouts, completed jobs and those that found nothing."""
    done = F.col("status") == "completed"
    return cells.groupBy("worker").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "timeout").alias("timeout"), F.count_if(done).alias("completed"), F.count_if(done & (components == 0)).alias("empty"))


def totals_pivot(rows: DataFrame, workers: list[str]) -> DataFrame:
    """A column for each tool with the largest total of a project, 0 where it has none."""
    return rows.groupBy("repo").agg(*[F.coalesce(F.max(F.when(F.col("worker") == w, F.col("total"))), F.lit(0)).cast("long").alias(w) for w in workers])


def progress(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs by state; done is all but pending."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    done = F.count_if(F.col("status").isin("completed", "failed", "cancelled"))
    return jobs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), is_("completed").alias("completed"), is_("failed").alias("failed"), is_("cancelled").alias("cancelled"), done.alias("done"), F.round(done / F.count(F.lit(1)), 6).alias("share"))


def fresh(known: DataFrame, results: DataFrame, pending: list[str]) -> DataFrame:
    """Results of jobs that are known and still pending; others are absorbed."""
    return results.join(known.filter(F.col("status").isin(pending)), "job_id", "left_semi")


def to_retry(cells: DataFrame, completed: DataFrame) -> DataFrame:
    """Cells with no completed job."""
    return cells.join(completed, ["repo", "worker"], "left_anti")
