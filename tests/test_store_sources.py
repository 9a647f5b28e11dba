"""The job store, match jobs, sources, sinks, plug-ins and streams on small cases."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from bomlens.functions import deep_json as J
from bomlens.functions import documents as D
from bomlens.functions import registry
from bomlens.operators import export as X
from bomlens.operators import grid as G
from bomlens.operators import match_jobs as MJ
from bomlens.operators import selection as L
from bomlens.operators import store
from bomlens.sources import readers, search, synthetic
from bomlens.streaming import jobs as streams


def test_job_life(spark):
    repos = spark.createDataFrame([("a/b",), ("c/d",)], "repo string")
    jobs = store.issued(repos, ["w1", "w2"], "i", F.lit(None).cast("timestamp"))
    assert jobs.count() == 4 and jobs.select("job_id").distinct().count() == 4
    assert {r["job_id"] for r in jobs.collect()} == {r["job_id"] for r in store.issued(repos, ["w1", "w2"], "i", F.lit(None).cast("timestamp")).collect()}
    done = jobs.withColumn("status", F.when((F.col("repo") == "a/b") & (F.col("worker") == "w1"), "completed").otherwise(F.col("status")))
    assert sorted(r["status"] for r in store.cancelled(done, "i").collect()) == ["cancelled"] * 3 + ["completed"]
    assert store.retried(done, "i", 2).count() == 7
    assert store.reset(done, "i").count() == 0


def test_results_of_final_and_unknown_jobs_are_absorbed(spark):
    known = spark.createDataFrame([("1", "fired"), ("2", "cancelled")], "job_id string, status string")
    results = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "job_id string, json string")
    assert [r["job_id"] for r in G.fresh(known, results, ["fired"]).collect()] == ["1"]


def test_status_key(spark):
    rows = [("completed", None, "completed"), ("failed", "timeout", "timeout"), ("failed", "error", "failed"), ("cancelled", None, "cancelled"), ("fired", None, "pending"), (None, None, "pending")]
    cells = spark.createDataFrame([(str(i), "w") for i in range(len(rows))], "repo string, worker string")
    jobs = spark.createDataFrame([(str(i), "w", s, p) for i, (s, p, _) in enumerate(rows) if s], "repo string, worker string, status string, payload_status string")
    got = {r["repo"]: r["status"] for r in G.with_status(cells, jobs).collect()}
    assert got == {str(i): want for i, (_, _, want) in enumerate(rows)}


def test_first_key_in_document_order():
    v = json.loads('{"a":[{"x":{"AssetType":"one"}}],"assetType":"two"}')
    assert J.found(v, "assettype") == (["a", "x", "AssetType"], "one")
    assert J.found({"a": 1}, "b") is None
    assert J.found({"k": [1, {"q": 2}]}, "q") == (["k", "q"], 2)


def test_minimal_and_lowered_components():
    c = {"type": "Crypto-Asset", "name": "AES-128@7", "other": 1, "cryptoProperties": {"assetType": "Algorithm", "algorithmProperties": {"primitive": "ae"}, "l": ["A", ["B"]]}}
    assert J.minimal(c) == {"type": "cryptoasset", "name": "aes128", "cryptoProperties": {"assetType": "algorithm", "algorithmProperties": {"primitive": "ae"}}}
    assert J.minimal(7) is None
    assert J.lowered(c) == {"type": "crypto-asset", "name": "aes-128@7", "cryptoProperties": {"assetType": "algorithm", "algorithmProperties": {"primitive": "ae"}, "l": ["a", ["B"]]}}


def test_context_regions():
    report = {"runs": [{"results": [{"locations": [{"physicalLocation": {"region": {"startLine": 3}}}, {}], "relatedLocations": [None]}]}]}
    p = J.with_context(report)["runs"][0]["results"][0]["locations"][0]["physicalLocation"]
    assert p["contextRegion"] == {"startLine": 3, "snippet": {"text": ""}}
    assert p["region"]["contextRegion"] == {"startLine": 3} and p["region"]["snippet"] == {"text": ""}


def test_match_inputs_need_two_documents(spark):
    doc = '{"components":[{"type":"t","name":"n"},7,{"type":"u"}]}'
    docs = spark.createDataFrame([("p", "w1", doc), ("p", "w2", f"[{doc}]"), ("q", "w1", doc), ("q", "w2", "{}")], "repo string, worker string, json string")
    got = MJ.match_inputs(docs).collect()
    assert {(r["repo"], r["file"], r["component"]) for r in got} == {("p", 0, 0), ("p", 0, 2), ("p", 1, 0), ("p", 1, 2)}


def test_viewer_ranks_groups_without_cost_last(spark):
    rows = [("p", 0, 0, 0, 1, None), ("p", 0, 1, 1, 1, None), ("p", 1, 0, 1, 0, None), ("p", 1, 1, 0, 2, 2.0), ("p", 1, 2, 0, 3, 1.0)]
    got = MJ.viewed(spark.createDataFrame(rows, "repo string, match long, at long, file long, component long, cost double"), ["x", "y"]).orderBy("rank").collect()
    assert [(r["match"], r["cost"], r["badges"]) for r in got] == [(1, "2.0000", "[y] [x]"), (0, "n/a", "[x] [y]")]


def test_archive(spark):
    rows = spark.createDataFrame([("a/b", "w", "ok", '{"bom":{"b":1,"a":2},"x":0}'), ("c", "w", "error", "{}"), ("d", "w", "ok", "{bad")], "repo string, worker string, status string, json string")
    out = io.BytesIO()
    assert X.write_archive(X.archive_rows(rows, "i"), out) == 2
    with zipfile.ZipFile(out) as z:
        assert z.namelist() == ["i/w/a_b_w.json", "i/w/d_w.json"]
        assert z.read("i/w/a_b_w.json").decode() == '{\n  "a": 2,\n  "b": 1\n}' and z.read("i/w/d_w.json") == b"{bad"


def test_config_keeps_or_drops_missing_branches(spark):
    row = spark.createDataFrame([("o/r", None)], "full_name string, branch string")
    repo = X.minimal_repo(F.col("full_name"), F.lit(None).cast("string"), F.col("branch"))
    for keep in (True, False):
        text = row.select(X.config_json(F.lit("n"), F.array(F.lit("w")), F.array(repo), keep_nulls=keep).alias("t")).first()["t"]
        assert ("branch" in json.loads(text)["repos"][0]) is keep


def test_readers(spark, tmp_path):
    (tmp_path / "list.md").write_text("# heading\n\nhttps://github.com/a/b/\nc/d\nc/d\n")
    assert [r["repo"] for r in readers.repo_list(spark, str(tmp_path / "list.md")).collect()] == ["a/b", "c/d", "c/d"]
    (tmp_path / "c.json").write_text('{"name":"n","workers":["w"],"repos":[{"repo":"o/r","default_branch":"dev"}]}')
    r = readers.usable(readers.configuration(spark, str(tmp_path / "c.json"))).first()
    assert r["repos"][0].asDict() == {"full_name": "o/r", "git_url": "https://github.com/o/r", "branch": "dev"}
    assert readers.documents(spark, str(tmp_path)).count() == 1
    for name in ("one", ".two", "_three"):
        (tmp_path / "workers" / name).mkdir(parents=True)
        (tmp_path / "workers" / name / "main.py").write_text("pass\n")
    assert readers.workers(spark, str(tmp_path / "workers")) == ["one"]
    assert readers.workers(spark, "", "b, a b") == ["b", "a"]


def test_search_source(spark):
    def fetch(query, page, size):
        rows = [(f"{query['language']}/r{i}", query["language"], 1000 - i, i) for i in range(250)]
        return rows[page * size : (page + 1) * size]

    spark.dataSource.register(search.search_source("projects", fetch))
    assert search.search(spark, "projects", language="go", limit=120).count() == 120
    assert {r["language"]: r["count"] for r in search.search_languages(spark, "projects", ["go", "c", "java"], 7).groupBy("language").count().collect()} == {"go": 3, "c": 2, "java": 2}


def test_quota():
    assert L.quotas(7, ["a", "b", "c"]) == {"a": 3, "b": 2, "c": 2}


def test_synthetic_documents(spark):
    rows = synthetic.generated(spark.createDataFrame([(f"o/r{i}",) for i in range(60)], "repo string"))
    got = rows.withColumn("n", F.size(D.components(D.parsed(F.col("json"))))).collect()
    assert {r["status"] for r in got} == {"ok", "timeout", "error"}
    assert all(5 <= r["n"] <= 40 if r["status"] == "ok" else r["n"] == 0 for r in got)
    assert synthetic.skeleton(rows).count() == 60


def test_sized_documents(spark):
    rows = spark.createDataFrame([(f"o/r{i}", [None, 0, 40, 900, 90_000][i % 5], "u", None) for i in range(100)], "repo string, size_kb long, git_url string, branch string")
    for r in synthetic.generated_sized(rows).collect():
        if r["status"] == "ok":
            d = json.loads(r["json"])
            kb = d["metadata"]["testing"]["target_kb"]
            assert len(r["json"]) == kb * 1024 and 10 <= kb <= 512 and 5 <= len(d["components"]) <= 40
            assert d["metadata"]["source"] == {"git_url": "u", "branch": "", "full_name": r["repo"]} and 12 <= r["seconds"] < 60
        else:
            assert r["json"] == "{}" and r["seconds"] is None


def test_producers(spark):
    @registry.producer("even")
    def even(job):
        if job["n"] == 3:
            raise TimeoutError("slow")
        if job["n"] % 2:
            raise ValueError("odd")
        return "{}", 1.5

    got = registry.produce(spark.createDataFrame([(str(i), i) for i in range(4)], "job_id string, n long"), "even").collect()
    assert {r["job_id"]: (r["status"], r["error"]) for r in got} == {"0": ("ok", None), "1": ("error", "odd"), "2": ("ok", None), "3": ("timeout", "slow")}


def test_sql_functions(spark):
    registry.register_sql(spark)
    assert spark.sql("SELECT bracket_notation('[1]') AS t").first()["t"] == "{[]{1}}"
    assert spark.sql("SELECT tree_edit_cost('[1]', '[1,2]') AS c").first()["c"] == 1.0


def test_streamed_states(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", "fired"), (1, 2, "2024-01-01 00:00:01", "completed"), (1, 3, "2024-01-01 00:00:02", "failed"), (2, 4, "2024-01-01 00:00:00", "fired")]
    schema = "job_id long, event_id long, ts timestamp, status string"
    table = spark.createDataFrame(rows, "job_id long, event_id long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(str(tmp_path / "in"))
    stream = streams.source(spark, str(tmp_path / "in"), schema)
    out = streams.final_states(streams.drained(streams.states(stream), str(tmp_path / "state"), str(tmp_path / "out"), "update"))
    assert {r["job_id"]: (r["status"], r["results"]) for r in out.collect()} == {1: ("completed", 3), 2: ("fired", 1)}
    seen = []
    q = streams.ingest(streams.source(spark, str(tmp_path / "in"), schema), lambda df, _: seen.append(df.count()), str(tmp_path / "ingest"))
    q.awaitTermination(60)
    assert sum(seen) == 4


def test_sized_documents_are_made_by_all_tasks(spark):
    """However few tasks read the projects: a single file of them is one task's."""
    repos = spark.range(400).select(F.concat(F.lit("r"), "id").alias("repo"), F.lit(200).alias("size_kb"), F.lit("u").alias("git_url"), F.lit("b").alias("branch")).coalesce(1)
    out = synthetic.generated_sized(repos).select(F.spark_partition_id().alias("task"), F.octet_length("json").alias("bytes")).groupBy("task").agg(F.sum("bytes").alias("bytes")).collect()
    assert len(out) == 4 and max(r["bytes"] for r in out) < 2 * min(r["bytes"] for r in out)
