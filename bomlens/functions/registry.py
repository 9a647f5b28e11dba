"""What users plug in: producers of documents, vectorizers of components, and functions for SQL."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scalars

PRODUCERS: dict[str, Callable[[dict], str | tuple[str, float]]] = {}
VECTORIZERS: dict[str, Callable[[Column], Column]] = {"letters": scalars.letter_histogram}

RESULT = "job_id string, worker string, status string, json string, duration_sec double, size_bytes long, error string"


def producer(name: str):
    """Register a function from a job (a dict) to a document, or to a document and its seconds."""

    def add(f):
        PRODUCERS[name] = f
        return f

    return add


def produce(jobs: DataFrame, name: str) -> DataFrame:
    """Run a producer over jobs (job_id and what it needs). A failure is a row with its error, not the end of the task."""
    f = PRODUCERS[name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for job in frame.to_dict("records"):
                began = time.monotonic()
                try:
                    got = f(job)
                    text, seconds = got if isinstance(got, tuple) else (got, time.monotonic() - began)
                    out.append((job["job_id"], name, "ok", text, float(seconds), len(text.encode()), None))
                except TimeoutError as e:
                    out.append((job["job_id"], name, "timeout", "{}", time.monotonic() - began, 0, str(e)))
                except Exception as e:  # noqa: BLE001  what a plug-in raises is its result
                    out.append((job["job_id"], name, "error", "{}", time.monotonic() - began, 0, str(e)))
            yield pd.DataFrame(out, columns=["job_id", "worker", "status", "json", "duration_sec", "size_bytes", "error"])

    return jobs.mapInPandas(run, RESULT)


def vectorized(rows: DataFrame, text: str, name: str = "letters") -> DataFrame:
    """``vector`` by a registered vectorizer: a function of a column, or a model with a method ``frame`` for whole tables, as
    ``subwords.learn`` gives."""
    found = VECTORIZERS[name]
    return found.frame(rows, text) if hasattr(found, "frame") else rows.withColumn("vector", found(F.col(text)))


def register_sql(spark: SparkSession) -> None:
    """The matching functions for SQL, of pairs and of tables."""
    from bomlens.functions import table_functions
    from bomlens.operators import matching, trees

    spark.udf.register("bracket_notation", matching.bracket_notation)
    spark.udf.register("tree_edit_cost", trees.tree_edit_cost)
    table_functions.register(spark)
