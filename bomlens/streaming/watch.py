"""A running inspection is watched while its results come in, and ends once all of them have."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .jobs import FINAL


class Progress(StreamingQueryListener):
    """Counts of each batch as the stream observes them; ``show`` gets every new state, ``finished`` is set when done >= total, or the query ends."""

    def __init__(self, name: str, total: int, show: Callable[[dict], None] | None = None):
        self.name, self.total, self.show = name, total, show
        self.batches: dict[int, dict] = {}
        self.finished, self.error = threading.Event(), None
        self.id = None

    def state(self) -> dict:
        """Jobs done and failed so far, and the share of all; a batch that ran again counts once."""
        done, failed = (sum(b[k] for b in self.batches.values()) for k in ("done", "failed"))
        return {"done": done, "failed": failed, "total": self.total, "share": done / self.total if self.total else 1.0}

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.id = event.id

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name or self.name not in p.observedMetrics:
            return
        row = p.observedMetrics[self.name]
        if p.numInputRows:
            self.batches[p.batchId] = {"done": row["done"] or 0, "failed": row["failed"] or 0}
        state = self.state()
        if self.show:
            self.show(state)
        if state["done"] >= self.total:
            self.finished.set()

    def onQueryIdle(self, event) -> None:
        """Nothing new."""

    def onQueryTerminated(self, event) -> None:
        if event.id == self.id:
            self.error = event.exception
            self.finished.set()


def watched(results: DataFrame, name: str, total: int, checkpoint: str, out: str, *, show: Callable[[dict], None] | None = None, every: str = "1 second", seconds: float = 300) -> tuple[DataFrame, dict]:
    """Run a stream of results (job_id, status) until ``total`` of them are final, then stop it: what it wrote, and the last state. The view of the results is
    the table at ``out``, a folder for each batch."""
    spark = results.sparkSession
    final = F.col("status").isin(*FINAL)
    seen = results.observe(name, F.count_if(final).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    listener = Progress(name, total, show)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.streams.addListener(listener)
    try:
        q = seen.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
        try:
            if not listener.finished.wait(seconds):
                raise TimeoutError(f"{listener.state()} after {seconds} s")
        finally:
            q.stop()
    finally:
        spark.streams.removeListener(listener)
    if listener.error:
        raise RuntimeError(listener.error)
    return spark.read.parquet(out), listener.state()
