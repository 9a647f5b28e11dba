"""Jobs as streams: ingest of results, their states, late and stale results.

Queues become streaming sources, the checkpoint replaces taking items off a list, and delivery is at least once, so
results are de-duplicated by job. A job that is completed, failed or cancelled stays so.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FINAL = ("completed", "failed", "cancelled")
STATE = "status string, seen long"
OUTPUT = "job_id long, status string, results long, late boolean"


def source(spark: SparkSession, folder: str, schema, kind: str = "parquet", glob: str | None = None) -> DataFrame:
    """Files of a folder as a stream; each file is read once for a checkpoint."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def advance(limit_ms: int | None, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first result decides; what comes after it is late and changes nothing. Without a result for the
    time limit (T07), the job is a timeout and its state goes (T09)."""
    if state.hasTimedOut:
        status, seen = state.get
        if status not in FINAL:
            state.update(("timeout", seen))
            yield pd.DataFrame({"job_id": [key[0]], "status": ["timeout"], "results": [seen], "late": [False]})
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
    status, seen = state.get if state.exists else ("fired", 0)
    late = status in FINAL
    for s in rows["status"]:
        if status not in FINAL:
            status = s
    seen += len(rows)
    state.update((status, seen))
    if limit_ms and status not in FINAL:
        state.setTimeoutDuration(limit_ms)
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "results": [seen], "late": [late]})


def states(results: DataFrame, limit_ms: int | None = None) -> DataFrame:
    """``results``: job_id, event_id, ts, status. The state of every job that a micro-batch touches. A time limit is for queries that
    run on: one that reads what is there and ends would wait for it."""
    kind = GroupStateTimeout.ProcessingTimeTimeout if limit_ms else GroupStateTimeout.NoTimeout
    step = functools.partial(advance, limit_ms)
    return results.groupBy("job_id").applyInPandasWithState(lambda key, frames, state: step(key, frames, state), OUTPUT, STATE, "update", kind)


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Micro-batches, each result of a job once. Without ``every`` all that is there is read and the query ends."""
    once = stream.dropDuplicates(["job_id", "event_id"])
    writer = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drained(stream: DataFrame, checkpoint: str, out: str, mode: str = "append", seconds: float | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote. Each batch goes to a folder of its own, so a batch that
    runs twice overwrites itself. A stream that ends with its input takes as long as it takes; ``seconds`` is for callers who want a limit."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if seconds is None:
            q.awaitTermination()
        elif not q.awaitTermination(seconds):
            raise TimeoutError(f"the stream didn't end in {seconds} s")
    finally:
        q.stop()
    return spark.read.parquet(out)


def final_states(updates: DataFrame) -> DataFrame:
    """The last state that a stream of updates gave each job."""
    return updates.groupBy("job_id").agg(F.max_by(F.struct("status", "results"), F.struct("results", "batch")).alias("s")).select("job_id", "s.status", "s.results")


def enqueued(jobs: DataFrame, folder: str) -> None:
    """Append jobs to a queue, a folder of JSON lines; a job is taken from it by every reader with a checkpoint of its own, once."""
    jobs.select(F.to_json(F.struct(*jobs.columns)).alias("value")).write.mode("append").text(folder)


def queue(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A queue's jobs as a stream; lines that can't be read are left out."""
    lines = source(spark, folder, "value string", "text")
    return lines.select(F.from_json("value", schema).alias("job")).filter("job IS NOT NULL").select("job.*")
