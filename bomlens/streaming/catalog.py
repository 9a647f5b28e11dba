"""Streams over the driver's events, drained into tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import timed
from .jobs import drained, enqueued, final_states, queue, source, states


def _folder(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="bomlens-")
    return f"{root}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return source(spark, sf_dir, schema, glob="events.parquet")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    once = _events(spark, sf_dir).dropDuplicates(["event_id"]).select(F.col("user_id").alias("job_id"), "event_type", "value")
    return drained(once, f"{folder}/state", f"{folder}/out").groupBy("job_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


def terminal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "cancelled").otherwise("fired")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"))
    return final_states(drained(states(rows), f"{folder}/state", f"{folder}/out", "update"))


def queued_match_jobs(spark: SparkSession, jobs: DataFrame) -> DataFrame:
    """Match jobs put into a queue in two goes and taken from it as a stream."""
    folder = _folder(spark)
    for part in (jobs.filter("repo % 2 = 0"), jobs.filter("repo % 2 = 1")):
        enqueued(part, f"{folder}/queue")
    return drained(queue(spark, f"{folder}/queue", "repo long, tools array<string>"), f"{folder}/state", f"{folder}/out").drop("batch")


#: A job's results are awaited for six hours, and its state is kept for two days after its decision.
LIMIT_MS, KEEP_MS, DELAY = 6 * 3_600_000, 48 * 3_600_000, "1 hour"


def timed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's last state under timers, and whether its state has been dropped."""
    folder = _folder(spark)
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "cancelled").otherwise("fired")
    at = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01', CAST(ts AS TIMESTAMP_NTZ))")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), "event_id", status.alias("status"), at.alias("at"))
    rows = rows.withColumn("time", F.timestamp_millis("at")).withWatermark("time", DELAY)
    before = spark.conf.get(key := "spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, timed.PROVIDER)
    try:
        out = drained(timed.timed_states(rows, LIMIT_MS, KEEP_MS), f"{folder}/state", f"{folder}/out", "update")
    finally:
        spark.conf.set(key, before)
    last = F.max_by(F.struct("status", "results", "dropped"), F.struct("batch", "dropped", F.col("status") != "fired"))
    return out.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.status", "s.results", "s.dropped")


def published_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs go through the queue: a stream publishes them, another one takes them."""
    from bomlens.sources.queue import JobQueue

    spark.dataSource.register(JobQueue)
    folder = _folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/customer.parquet").schema
    jobs = source(spark, sf_dir, schema, glob="customer.parquet").select(F.to_json(F.struct(F.col("c_custkey").alias("repo"), F.col("c_mktsegment").alias("tool"))).alias("job"))
    q = jobs.writeStream.format("job_queue").option("path", f"{folder}/queue").option("checkpointLocation", f"{folder}/publish").trigger(availableNow=True).start()
    q.awaitTermination()
    taken = drained(spark.readStream.format("job_queue").option("path", f"{folder}/queue").load(), f"{folder}/take", f"{folder}/out")
    return taken.select(F.from_json("job", "repo long, tool string").alias("j")).select("j.*")


def watched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results, watched until as many are final as the table holds."""
    from .watch import watched

    folder = _folder(spark)
    status = lambda: F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "cancelled").otherwise("fired")
    total = spark.read.parquet(f"{sf_dir}/events.parquet").filter(status() != "fired").count()
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("job_id"), status().alias("status"))
    out, state = watched(rows, f"watch{uuid.uuid4().hex}", total, f"{folder}/state", f"{folder}/out")
    last = out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return last.withColumn("share", F.lit(state["share"]))
