"""Synthetic documents for tests and load, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomlens.functions.scalars import ASSET_TYPES, hash_bucket

EMPTY = '{"bomFormat":"CycloneDX","specVersion":"1.6","components":[]}'


def status(repo: Column) -> Column:
    """Every thirteenth project times out, every eleventh of the others fails, by the hash of its name."""
    return F.when(hash_bucket(repo, 13) == 0, "timeout").when(hash_bucket(repo, 11) == 0, "error").otherwise("ok")


def document(repo: Column) -> Column:
    """5 to 40 components whose asset types follow from the name's hash."""
    kinds = F.array(*[F.lit(k) for k in ASSET_TYPES])
    kind = lambda i: F.element_at(kinds, ((hash_bucket(repo, len(ASSET_TYPES)) + i * 31) % len(ASSET_TYPES) + 1).cast("int"))
    one = lambda i: F.struct(F.lit("crypto-asset").alias("type"), F.concat(F.lit("component-"), i.cast("string")).alias("name"), F.struct(kind(i).alias("assetType"), F.lit(0.9).alias("confidence")).alias("cryptoProperties"))
    return F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.transform(F.sequence(F.lit(0), (4 + hash_bucket(repo, 36)).cast("int")), one).alias("components")))


#: Of a generated document: its size in KB is this share of the project's, from FALLBACK_KB if that is unknown, and within these bounds.
LEAST_KB, MOST_KB, FALLBACK_KB = 10, 512, 500
NOTE = "A note of a component that was made up for tests, so long that the document has its size. "


def hashed(text: Column, n: int, digits: int = 32) -> Column:
    """The number of the first hexadecimal digits of the text's hash, modulo ``n``."""
    hex_, out = F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(0).cast("long")
    for at in range(0, digits, 7):
        size = min(7, digits - at)
        out = (out * 16**size + F.conv(F.substring(hex_, at + 1, size), 16, 10).cast("long")) % n
    return out


def target_kb(repo: Column, size_kb: Column) -> Column:
    """10 to 60 % of the project's size, by its name's hash, within the bounds."""
    size = F.when(size_kb > 0, size_kb.cast("long")).otherwise(FALLBACK_KB)
    return F.greatest(F.lit(LEAST_KB), F.least(F.lit(MOST_KB), (size * (10 + hashed(repo, 51, 30)) / 100).cast("long"))).cast("long")


def seconds(repo: Column, limit_s: float) -> Column:
    """How long making the document takes, below the limit."""
    return F.greatest(F.lit(0.05), F.least(F.lit(limit_s - 0.25), F.lit(limit_s) * (20 + hashed(repo, 66, 31)) / 100))


def generated_sized(repos: DataFrame, limit_s: float = 60.0) -> DataFrame:
    """``repos``: repo, size_kb, git_url, branch. Returns repo, status, seconds and document, empty unless the status is ok. A document has exactly its target size
    in bytes, with metadata: what its components lack to that is dealt to their notes; if they are too large already, three tenths of them
    stay. Projects are dealt to tasks by number, since their documents are thousands of times as large as their rows, of which a task would read all."""
    repos = repos.repartition(int(repos.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    repo, kinds = F.col("repo"), F.array(*[F.lit(k) for k in ASSET_TYPES])
    source = F.struct(F.coalesce("git_url", F.lit("")).alias("git_url"), F.coalesce("branch", F.lit("")).alias("branch"), F.coalesce(repo, F.lit("")).alias("full_name"))
    rows = repos.select("repo", source.alias("source"), status(repo).alias("status"), target_kb(repo, F.col("size_kb")).alias("target_kb"), seconds(repo, limit_s).alias("seconds"), (5 + hash_bucket(repo, 36)).alias("many"), hash_bucket(repo, len(ASSET_TYPES)).alias("kind"))

    def made(n: Column, notes) -> Column:
        kind = lambda i: F.element_at(kinds, ((F.col("kind") + i * 31) % len(ASSET_TYPES) + 1).cast("int"))
        one = lambda i: F.struct(F.lit("crypto-asset").alias("type"), F.concat(F.lit("component-"), i.cast("string")).alias("name"), F.struct(kind(i).alias("assetType"), F.lit(0.9).alias("confidence")).alias("cryptoProperties"), notes(i).alias("notes"))
        components = F.transform(F.slice(F.sequence(F.lit(0), F.lit(40)), F.lit(1), n.cast("int")), one)
        metadata = F.struct(F.lit("testing-synth").alias("generator"), F.col("source"), F.struct("target_kb", F.round("seconds", 3).alias("sleep_sec")).alias("testing"))
        return F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), components.alias("components"), metadata.alias("metadata")))

    bare = lambda n: F.octet_length(made(n, lambda i: F.lit("")))
    target = F.col("target_kb") * 1024
    rows = rows.withColumn("kept", F.when(bare(F.col("many")) > target, F.floor(F.col("many") * 0.3)).otherwise(F.col("many")))
    rows = rows.withColumn("room", F.greatest(target - bare(F.col("kept")), F.lit(0)))
    want = lambda i: (F.floor(F.col("room") / F.col("kept")) + F.when(i < F.col("room") % F.col("kept"), 1).otherwise(0)).cast("int")
    text = made(F.col("kept"), lambda i: F.rpad(F.lit(NOTE), want(i), F.lit(NOTE)))
    ok = F.col("status") == "ok"
    return rows.select("repo", "status", F.when(ok, F.col("seconds")).alias("seconds"), F.when(ok, text).otherwise("{}").alias("json"))


def generated(repos: DataFrame) -> DataFrame:
    """Repo, status and document, empty unless the status is ok."""
    s = status(F.col("repo"))
    return repos.select("repo", s.alias("status"), F.when(s == "ok", document(F.col("repo"))).otherwise("{}").alias("json"))


def skeleton(repos: DataFrame) -> DataFrame:
    """S18."""
    return repos.select("repo", F.lit("ok").alias("status"), F.lit(EMPTY).alias("json"))
