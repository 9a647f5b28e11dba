"""Sinks: archives, configurations, tables for people."""

from __future__ import annotations

import zipfile
from typing import IO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlens.functions.deep_json import pretty
from bomlens.functions.scalars import first_present


def archive_rows(results: DataFrame, insp_id: str) -> DataFrame:
    """Path and content of every result that is ok. ``results``: repo, worker, status, json."""
    ok = results.filter("status = 'ok'")
    path = F.concat(F.lit(f"{insp_id}/"), F.col("worker"), F.lit("/"), F.translate(F.coalesce("repo", F.lit("")), "/", "_"), F.lit("_"), F.col("worker"), F.lit(".json"))
    text = F.coalesce("json", F.lit("{}"))
    return ok.select(path.alias("path"), F.coalesce(pretty(text), text).alias("content"))


def write_archive(rows: DataFrame, out: IO[bytes]) -> int:
    """A ZIP on the driver, row by row: a download is as large as its inspection, but memory holds one partition."""
    n = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in rows.orderBy("path").toLocalIterator():
            z.writestr(r["path"], r["content"])
            n += 1
    return n


def write_documents(results: DataFrame, folder: str) -> None:
    """K10 in parallel: one folder a tool."""
    results.filter("status = 'ok'").select("worker", "json").write.mode("overwrite").partitionBy("worker").text(folder)


def minimal_repo(full_name: Column, git_url: Column, branch: Column) -> Column:
    """K11, P13."""
    return F.struct(full_name.alias("full_name"), first_present(git_url, F.concat(F.lit("https://github.com/"), full_name)).alias("git_url"), branch.alias("branch"))


def config_json(name: Column, workers: Column, repos: Column, *, keep_nulls: bool) -> Column:
    """A configuration; missing branches are null or left out."""
    return F.to_json(F.struct(F.lit("1").alias("schema_version"), name.alias("name"), workers.alias("workers"), repos.alias("repos")), {"ignoreNullFields": str(not keep_nulls).lower()})


def models_csv(elements: DataFrame, folder: str) -> None:
    """Attributes of elements, sorted and joined by semicolons."""
    elements.select("file", "component", F.array_join(F.array_sort("attributes"), ";").alias("attributes")).write.mode("overwrite").option("header", True).csv(folder)


def status_json(summary: DataFrame) -> DataFrame:
    """K13."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("json"))
