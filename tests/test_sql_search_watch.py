from __future__ import annotations

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from bomlens.functions import registry
from bomlens.operators import matching as M
from bomlens.operators import trees as T
from bomlens.sources import search as S
from bomlens.streaming import watch


def pages_of(total, calls, broken=()):
    def fetch(query, page, size):
        calls.append(page)
        if page in broken and calls.count(page) <= broken[page]:
            raise ConnectionError("reset")
        rows = [(f"r{i}", query["language"], 1000 - i, i) for i in range(total)]
        return rows[page * size : (page + 1) * size]

    return fetch


def read(reader):
    return sorted(r for lane in reader.partitions() for r in reader.read(lane))


def test_lanes_stop_at_an_empty_page():
    calls: list[int] = []
    got = read(S.PagedReader(pages_of(250, calls), {"language": "go"}, 5000))
    assert len(got) == len(set(got)) == 250
    assert sorted(calls) == [0, 1, 2, 3, 4, 5, 6]  # three pages with rows, and each of the four lanes one empty page
    assert len(read(S.PagedReader(pages_of(250, []), {"language": "go"}, 120))) == 120
    assert len(read(S.PagedReader(pages_of(250, []), {"language": "go"}, 1))) == 1


def test_a_page_is_tried_again_alone(monkeypatch):
    monkeypatch.setattr(S, "PAUSE_S", 0.0)
    calls: list[int] = []
    assert len(read(S.PagedReader(pages_of(250, calls, {1: 2}), {"language": "go"}, 300))) == 250
    assert calls.count(1) == 3 and calls.count(0) == calls.count(2) == 1
    with pytest.raises(S.PageError, match="page 1 "):
        read(S.PagedReader(pages_of(250, [], {1: 9}), {"language": "go"}, 300))


def test_filters_reach_the_service(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = [(f"r{i}", "go" if i % 3 else "c", i, i) for i in range(900)]
    spark.createDataFrame(rows, S.SCHEMA).write.parquet(f"{tmp_path}/served")
    spark.dataSource.register(S.search_source("pushed", S.table_service(f"file://{tmp_path}/served")))
    found = spark.read.format("pushed").option("limit", "200").load().filter("language = 'go' AND stars > 100 AND stars <= 500 AND size_kb % 2 = 0")
    want = sorted((r for r in rows if r[1] == "go" and 100 < r[2] <= 500), key=lambda r: -r[2])[:200]
    assert sorted(map(tuple, found.collect())) == sorted(r for r in want if r[3] % 2 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    kept = plan[plan.index("Filter") :].split("\n")[0]
    assert "% 2" in kept and "= go" not in kept and "> 100" not in kept and "<= 500" not in kept  # the service's filters are Spark's no more
    assert spark.read.format("pushed").option("limit", "50").option("language", "c").load().count() == 50


def chains_of(rows):
    out: dict = {}
    for project, chain, node in rows:
        out.setdefault((project, chain), set()).add(node)
    return {(p, frozenset(g)) for (p, _), g in out.items()}


@pytest.mark.parametrize("pivot", [True, False])
@pytest.mark.parametrize("model", ["json", "unit"])
def test_calls_from_sql_are_the_dataframe_form(spark, pivot, model):
    r = np.random.default_rng(6)
    rows = [(p, f, c, json.dumps({"name": f"n{r.integers(0, 4)}", "tags": [f"t{k}" for k in r.integers(0, 3, r.integers(0, 3))]})) for p in ("p", "q") for f in range(3) for c in range(2 + (f + (p == "q")) % 3)]
    e = spark.createDataFrame(rows, "project string, file long, component long, text string")
    registry.register_sql(spark)
    e.createOrReplaceTempView("components_of_documents")
    name = "n_way_match_pivot" if pivot else "n_way_match_all"
    got = spark.sql(f"SELECT * FROM {name}(TABLE(components_of_documents) PARTITION BY project, cost => '{model}', threshold => 1.6D)").collect()
    costs = T.JSON_COSTS if model == "json" else T.Costs(rename=lambda kind, a, b: float(a != b), least=1.0)
    frame = M.match_groups(e, ["project"], T.tree_cost(costs)("text_a", "text_b"), pivot=pivot, threshold=1.6).collect()
    assert chains_of((x["project"], x["chain"], (x["file"], x["component"])) for x in got) == chains_of((x["node"].split("/")[0], x["chain"], tuple(map(int, x["node"].split("/")[1:]))) for x in frame)
    assert {(x["project"], x["file"], x["component"]): round(x["cost"], 9) for x in got} == {(x["node"].split("/")[0], *map(int, x["node"].split("/")[1:])): round(x["cost"], 9) for x in frame}
    assert len(got) > 4


def test_calls_that_cannot_be(spark):
    registry.register_sql(spark)
    for call in ("n_way_match_pivot(TABLE(SELECT 1 AS file))", "n_way_match_pivot(1)", "n_way_match_all(TABLE(SELECT 1 AS file, 1 AS component, '' AS text), cost => 'none')"):
        with pytest.raises(Exception, match="lacks|is a table|no cost model"):
            spark.sql(f"SELECT * FROM {call}").collect()
    assert spark.sql("SELECT * FROM n_way_match_pivot(TABLE(SELECT 'p' AS project, 0L AS file, 0L AS component, '{bad' AS text) PARTITION BY project)").count() == 0


def test_producers_as_table_functions(spark):
    @registry.producer("third")
    def third(job):
        if job["n"] % 3 == 1:
            raise TimeoutError("slow")
        if job["n"] % 3 == 2:
            raise ValueError("odd")
        return "{}", 2.5

    registry.register_sql(spark)
    spark.createDataFrame([(str(i), i) for i in range(6)], "job_id string, n long").createOrReplaceTempView("jobs_to_do")
    got = spark.sql("SELECT * FROM produce_third(TABLE(jobs_to_do))").collect()
    del registry.PRODUCERS["third"]
    assert {x["job_id"]: (x["status"], x["error"]) for x in got} == {str(i): [("ok", None), ("timeout", "slow"), ("error", "odd")][i % 3] for i in range(6)}
    assert {x["duration_sec"] for x in got if x["status"] == "ok"} == {2.5}


def test_a_watched_stream_ends_when_all_are_done(spark, tmp_path):
    schema = "job_id long, status string"
    for k, rows in enumerate([[(1, "fired"), (2, "completed")], [(1, "failed"), (3, "fired")], [(3, "cancelled")], [(4, "fired")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    seen: list[dict] = []
    out, state = watch.watched(stream, "watch_me", 3, f"file://{tmp_path}/cp", f"file://{tmp_path}/out", show=seen.append, every="100 milliseconds", seconds=60)
    assert state["done"] == state["total"] == 3 and state["failed"] == 1 and state["share"] == 1.0
    assert out.filter(F.col("status") != "fired").count() == 3
    assert [s["done"] for s in seen] == sorted(s["done"] for s in seen) and seen[0]["done"] < 3
    with pytest.raises(TimeoutError, match="'done': 3"):
        watch.watched(stream, "watch_more", 9, f"file://{tmp_path}/cp2", f"file://{tmp_path}/out2", every="100 milliseconds", seconds=8)
