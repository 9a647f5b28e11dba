"""From completed jobs to match jobs, and from match results to what a viewer shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomlens.functions.deep_json import lowered_json, minimal_json
from bomlens.functions.documents import MATCHED_ROOTS, components, parsed


#: A message of the result (fixed value).
TOO_FEW = "Need at least two CBOM payloads to compute similarity"


def collected(jobs: DataFrame) -> DataFrame:
    """Documents of completed jobs with a text, by project and tool. ``jobs``: repo, worker, status, json."""
    return jobs.filter("status = 'completed' AND json IS NOT NULL AND trim(json) <> ''").select("repo", "worker", "json")


def match_inputs(documents: DataFrame, *, crypto_only: list[str] | None = None) -> DataFrame:
    """Each project's minimal components with their place in the document and the document's number. Projects with
    fewer than two documents that hold components are left out. Components that are no objects keep their places empty."""
    rows = documents.select("repo", "worker", F.posexplode(components(parsed(F.col("json")), MATCHED_ROOTS)).alias("component", "c"))
    if crypto_only is not None:
        rows = rows.filter(F.lower(F.trim(F.try_variant_get("c", "$.type", "string"))).isin(crypto_only))
    rows = rows.withColumn("minimal", minimal_json(F.to_json("c"))).filter("minimal IS NOT NULL").drop("c")
    tools = rows.groupBy("repo").agg(F.array_sort(F.collect_set("worker")).alias("tools")).filter(F.size("tools") >= 2)
    return rows.join(tools, "repo").withColumn("file", F.array_position("tools", F.col("worker")) - 1)


def envelopes(members: DataFrame, inputs: DataFrame) -> DataFrame:
    """One result a project: its groups of file, component and cost, how many there are, a status and an error.
    ``members``: repo, match, file, component, cost (match -1: the time was up); ``inputs``: repo, file. A project of fewer than two documents
    is an error, and no groups are looked for."""
    group = members.groupBy("repo", "match").agg(F.sort_array(F.collect_list(F.struct("file", "component", "cost"))).alias("group"))
    found = group.groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(F.struct("match", "group"))), lambda g: g["group"]).alias("matches"), F.min("match").alias("least"))
    out = inputs.groupBy("repo").agg(F.count_distinct("file").alias("documents")).join(found, "repo", "left")
    status = F.when(F.col("documents") < 2, "error").when(F.col("least") == -1, "timeout").otherwise("ok")
    out = out.withColumn("status", status).withColumn("matches", F.when(F.col("status") == "ok", F.col("matches")))
    error = F.when(F.col("status") == "error", TOO_FEW).when(F.col("status") == "timeout", "timeout")
    return out.select("repo", F.greatest(F.coalesce(F.size("matches"), F.lit(0)), F.lit(0)).alias("match_count"), "matches", "status", error.alias("error"))


def viewed(members: DataFrame, tools: list[str]) -> DataFrame:
    """Groups in order of their first cost, groups without one last, with the tools that take part, each once. ``members``:
    repo, match, at (place in the group), file, component, cost."""
    first = F.min_by(F.col("cost"), F.when(F.col("cost").isNotNull(), F.col("at")))
    names = F.array(*[F.lit(t) for t in tools])
    seq = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("at", "file"))), lambda e: (e["file"] >= 0) & (e["file"] < len(tools))), lambda e: F.element_at(names, e["file"].cast("int") + 1))
    groups = members.groupBy("repo", "match").agg(first.alias("cost"), F.array_join(F.transform(F.array_distinct(seq), lambda t: F.concat(F.lit("["), t, F.lit("]"))), " ").alias("badges"), F.count(F.lit(1)).alias("members"))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("cost").asc_nulls_last(), "match"))
    label = F.when(F.col("cost").isNull(), "n/a").otherwise(F.format_string("%.4f", "cost"))
    return groups.withColumn("rank", rank).select("repo", "match", "rank", label.alias("cost"), "badges", "members")


def aligned(members: DataFrame, components_: DataFrame) -> DataFrame:
    """Each member with its component; ``found`` is false where the place is out of range."""
    c = components_.withColumn("found", F.lit(True))
    return members.join(c, ["repo", "file", "component"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def prepared(documents: DataFrame) -> DataFrame:
    """The top-level components of each document, with their fields that count in lower case. ``documents``: repo, at, json.
    A text that is no JSON is left out and the documents after it move up; one without components keeps its number."""
    ok = documents.withColumn("doc", parsed(F.col("json"))).filter("doc IS NOT NULL")
    ok = ok.withColumn("file", F.row_number().over(Window.partitionBy("repo").orderBy("at")) - 1)
    found = F.try_variant_get("doc", "$.components", "array<variant>")
    rows = ok.select("repo", "file", F.posexplode(found).alias("component", "c"))
    return rows.select("repo", "file", "component", lowered_json(F.to_json("c")).alias("text"))
