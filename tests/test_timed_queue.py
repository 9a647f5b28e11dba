from __future__ import annotations

import os
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bomlens.sources.queue import Folder, JobQueue
from bomlens.streaming import catalog as SC
from bomlens.streaming import timed
from bomlens.streaming.jobs import drained


def files(spark, folder, parts, schema):
    """One file after another, in the order of their times."""
    for k, rows in enumerate(parts):
        path = f"{folder}/part"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"file://{path}")
        one = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        shutil.move(f"{path}/{one}", f"{folder}/in/{k}.parquet")
        os.utime(f"{folder}/in/{k}.parquet", (1_700_000_000 + k * 10,) * 2)


def test_silent_jobs_time_out_and_old_state_goes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timed.PROVIDER)
    at = lambda m: (10_000 + m) * 60_000  # noqa: E731  minutes
    schema = "job_id long, event_id long, status string, at long"
    parts = [
        [(1, 1, "fired", at(0)), (2, 2, "fired", at(0)), (3, 3, "fired", at(1)), (3, 4, "completed", at(5))],
        [(1, 5, "completed", at(9)), (4, 6, "fired", at(20))],  # job 1 in time; the watermark goes to 20, past job 2's limit
        [(2, 7, "completed", at(25)), (5, 8, "fired", at(60)), (5, 9, "failed", at(75))],  # too late for job 2; job 5's result comes after its limit
        [(6, 10, "fired", at(200))],
    ]
    files(spark, tmp_path, parts, schema)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    rows = rows.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "0 seconds")
    out = drained(timed.timed_states(rows, 600_000, 6_000_000), f"file://{tmp_path}/state", f"file://{tmp_path}/out", "update")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    by: dict = {}
    for r in sorted(out.collect(), key=lambda r: r["batch"]):
        by.setdefault(r["job_id"], []).append((r["status"], r["results"], r["dropped"]))
    assert by[1] == [("fired", 1, False), ("completed", 2, False), ("completed", 2, True)]
    assert by[2] == [("fired", 1, False), ("timeout", 2, False), ("timeout", 2, True)]
    assert by[3] == [("completed", 2, False), ("completed", 2, True)]
    assert by[4] == [("fired", 1, False), ("timeout", 1, False), ("timeout", 1, True)]  # by its timer alone
    assert by[5] == [("timeout", 2, False), ("timeout", 2, True)]
    assert by[6] == [("fired", 1, False)]


def test_timed_states_of_the_table(spark):
    got = {r["job_id"]: (r["status"], r["results"], r["dropped"]) for r in SC.timed_results(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()
    assert len({s for s, _, _ in got.values()}) > 2


def test_a_long_stream_is_waited_for(spark, tmp_path, monkeypatch):
    """Waits with a limit give up at once here, as they do on a table that takes longer than the limit."""
    from pyspark.sql.streaming.query import StreamingQuery

    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda q, timeout=None: wait(q) if timeout is None else False)
    files(spark, tmp_path, [[(1,)]], "id long")
    rows = lambda: spark.readStream.schema("id long").parquet(f"file://{tmp_path}/in")
    assert drained(rows(), f"file://{tmp_path}/state", f"file://{tmp_path}/out").count() == 1
    with pytest.raises(TimeoutError):
        drained(rows(), f"file://{tmp_path}/state2", f"file://{tmp_path}/out2", seconds=1)


@pytest.fixture
def queue(spark, tmp_path):
    spark.dataSource.register(JobQueue)
    return f"file://{tmp_path}/queue"


def test_a_batch_that_runs_again_publishes_once(spark, tmp_path, queue):
    """The stream is stopped between publishing and its own commit, as by a crash; what it has published is not published again."""
    files(spark, tmp_path, [[(k, f"{{\"id\": {k}}}") for k in range(p * 5, p * 5 + 5)] for p in range(3)], "id long, job string")

    def run():
        rows = spark.readStream.schema("id long, job string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in").select("job")
        q = rows.writeStream.format("job_queue").option("path", queue).option("producer", "p").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert Folder(queue).published() == {"p": [0, 1, 2]}
    for name in ("2", ".2.crc"):
        if os.path.exists(path := f"{tmp_path}/cp/commits/{name}"):
            os.remove(path)
    files(spark, tmp_path, [[(k, f"{{\"id\": {k}}}") for k in range(15, 18)]], "id long, job string")
    os.rename(f"{tmp_path}/in/0.parquet", f"{tmp_path}/in/3.parquet")
    run()
    jobs = Counter(r["job"] for r in spark.read.format("job_queue").option("path", queue).load().collect())
    assert set(jobs.values()) == {1} and len(jobs) == 18


def test_readers_take_each_job_once(spark, tmp_path, queue):
    put = lambda ids, name: spark.createDataFrame([(f'{{"id": {k}}}\nx',) for k in ids] + [(None,)], "job string").repartition(3).write.format("job_queue").option("path", queue).option("producer", name).mode("append").save()
    take = lambda who: drained(spark.readStream.format("job_queue").option("path", queue).load(), f"file://{tmp_path}/{who}", f"file://{tmp_path}/{who}-out").count()
    put(range(4), "a")
    assert take("one") == 4
    put(range(4, 10), "b")
    put(range(4), "a")  # the same producer's batch again: nothing new
    assert take("one") == 10 and take("two") == 10
    Folder(queue).put("jobs/stray.jsonl", b'"never"\n')  # a task's file without a manifest
    assert take("three") == 10
