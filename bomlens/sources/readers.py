"""Files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlens.functions.scalars import first_present, owner_and_repo

CONFIG = "schema_version string, name string, workers array<string>, repos array<struct<full_name: string, repo: string, git_url: string, clone_url: string, branch: string, default_branch: string>>"


def repo_list(spark: SparkSession, path: str) -> DataFrame:
    """One project a line; blank lines and headings go, repetitions stay."""
    lines = spark.read.text(path).filter("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    return lines.select(owner_and_repo(F.col("value")).alias("repo"))


def configuration(spark: SparkSession, path: str) -> DataFrame:
    """Name, workers and projects of configurations; projects by either of their names, addresses and branches."""
    rows = spark.read.schema(CONFIG).option("multiLine", True).json(path)
    full = lambda r: first_present(r["full_name"], r["repo"])
    one = lambda r: F.struct(full(r).alias("full_name"), first_present(r["git_url"], r["clone_url"], F.concat(F.lit("https://github.com/"), full(r))).alias("git_url"), first_present(r["branch"], r["default_branch"]).alias("branch"))
    return rows.select("name", "workers", F.transform("repos", one).alias("repos"))


def usable(config: DataFrame) -> DataFrame:
    """Configurations with tools and projects."""
    return config.filter("size(workers) > 0 AND size(repos) > 0")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every JSON file of a folder, not of those below it, as one text."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{json,JSON}").text(folder)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("json"))


def workers(spark: SparkSession, folder: str, override: str = "") -> list[str]:
    """Tools are folders with a main.py, hidden and private ones left out; a list overrides them."""
    if override.strip():
        return list(dict.fromkeys(w for w in override.replace(",", " ").split() if w))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "main.py").load(folder).select("path")
    names = files.select(F.element_at(F.split("path", "/"), -2).alias("name")).filter("NOT startswith(name, '.') AND NOT startswith(name, '_')")
    return sorted(r["name"] for r in names.distinct().collect())  # a row for each tool
