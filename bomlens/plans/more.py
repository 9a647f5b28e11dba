"""More of the catalogue: the store, match jobs, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bomlens.functions import deep_json as J
from bomlens.functions import documents as D
from bomlens.functions import scalars as S
from bomlens.operators import export as X
from bomlens.operators import match_jobs as MJ
from bomlens.operators import selection as L
from bomlens.operators import store
from bomlens.plans.catalog import _DOCS, _documents, query
from bomlens.plans.standins import CURRENT, JOBS, WORKERS, all_jobs, table
from bomlens.sources import synthetic


@query(f"SELECT c_custkey AS repo, w.worker, md5('i1|' || c_custkey || '|' || w.worker) AS job_id, 'fired' AS status FROM customer CROSS JOIN (SELECT unnest({WORKERS!r}) AS worker) w")
def issued_jobs(spark, d):
    """K01, K02, N01."""
    repos = table(spark, d, "customer").select(F.col("c_custkey").alias("repo"))
    return store.issued(repos, WORKERS, "i1", F.lit(None).cast("timestamp")).select("repo", "worker", "job_id", "status")


@query("SELECT count(*) AS repo_count, 5::BIGINT AS worker_count, count(*) * 5 AS expected_jobs, 'created' AS status FROM customer")
def created_inspection(spark, d):
    """K01."""
    repos = table(spark, d, "customer").select(F.col("c_custkey").alias("repo"))
    return store.created(repos, WORKERS, "i1", "all").select("repo_count", "worker_count", "expected_jobs", "status")


_STORE = f"SELECT *, worker AS insp_id FROM ({JOBS})"


def _store(spark, d):
    return all_jobs(spark, d).withColumn("insp_id", F.col("worker"))


@query(f"SELECT insp_id, CASE WHEN insp_id = '2-HIGH' AND status = 'fired' THEN 'cancelled' ELSE status END AS status, count(*) AS n FROM ({_STORE}) GROUP BY 1, 2")
def cancelled_jobs(spark, d):
    """K04."""
    return store.cancelled(_store(spark, d), "2-HIGH").groupBy("insp_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT insp_id, count(*) AS n FROM ({_STORE}) WHERE insp_id NOT IN ('2-HIGH') GROUP BY 1")
def reset_jobs(spark, d):
    """K05, K07."""
    gone = spark.createDataFrame([("2-HIGH",)], "insp_id string")
    return store.deleted({"jobs": _store(spark, d)}, gone)["jobs"].groupBy("insp_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) + count(DISTINCT CASE WHEN insp_id = '2-HIGH' AND repo NOT IN (SELECT repo FROM ({_STORE}) WHERE insp_id = '2-HIGH' AND status = 'completed') THEN repo END) AS jobs FROM ({_STORE})")
def retried_jobs(spark, d):
    """New jobs stand beside the old ones."""
    return store.retried(_store(spark, d), "2-HIGH", 2).agg(F.count(F.lit(1)).alias("jobs"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey * 3600 < 86400 - 3600 * 3")
def cached_dimension(spark, d):
    """Rows that were fetched within a day."""
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    n = table(spark, d, "nation").withColumn("fetched_at", now - F.make_interval(hours=F.col("n_nationkey") + 3))
    return store.cached(n, now).select("n_nationkey", "n_name")


@query("SELECT event_type AS name, round(sum(value), 2) AS elapsed, count(*) AS laps FROM events GROUP BY 1")
def timer_totals(spark, d):
    """A17."""
    t = table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("value").alias("elapsed"))
    return store.timer_totals(t).withColumn("elapsed", F.round("elapsed", 2))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_mktsegment END AS language FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 2 = 0")
def enriched_repos(spark, d):
    """P14."""
    repos = table(spark, d, "customer").select(F.col("c_custkey").alias("repo"), F.col("c_mktsegment").alias("language"), "c_nationkey")
    n = table(spark, d, "nation")
    got = repos.filter("repo % 2 = 0").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("repo", F.col("n_name").alias("language"))
    return store.enriched(repos.drop("c_nationkey"), got).select(F.col("repo").alias("c_custkey"), "language")


@query(f"SELECT c.c_custkey AS repo, count(*) AS documents FROM ({_DOCS}) c JOIN ({CURRENT}) j ON j.repo = c.c_custkey WHERE j.status = 'completed' AND trim(doc) <> '' GROUP BY 1")
def collected_documents(spark, d):
    """S07, N03, P04."""
    from bomlens.operators.grid import latest

    jobs = latest(all_jobs(spark, d), ["repo", "worker"], "job_id")
    docs = _documents(spark, d).select(F.col("c_custkey").alias("repo"), F.col("doc").alias("json"))
    return MJ.collected(jobs.join(docs, "repo")).groupBy("repo").agg(F.count(F.lit(1)).alias("documents"))


def _inputs(spark, d):
    """Five customers in a row are a project, each with a document of a tool of its own; all documents that can be read enter."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    docs = _documents(spark, d).join(c, "c_custkey").filter("c_custkey % 7 < 4")
    worker = F.concat("c_mktsegment", F.lit("/"), (F.col("c_custkey") % 5).cast("string"))
    return MJ.match_inputs(docs.select(F.expr("c_custkey div 5").alias("repo"), worker.alias("worker"), F.col("doc").alias("json")))


@query(f"""WITH o AS (SELECT c_custkey // 5 AS repo, c_mktsegment || '/' || (c_custkey % 5) AS worker, c_custkey AS k FROM customer WHERE c_custkey % 7 < 4),
 t AS (SELECT repo FROM o GROUP BY 1 HAVING count(*) >= 2)
 SELECT repo, (dense_rank() OVER (PARTITION BY repo ORDER BY worker) - 1)::BIGINT AS file, component::INTEGER AS component,
 CASE component WHEN 0 THEN '{{"type":"' || lower(c_mktsegment) || '","name":"' || lower(c_mktsegment) || '","cryptoProperties":{{"assetType":"algorithm"}}}}'
 ELSE '{{"type":"","name":"n' || c_nationkey || '","cryptoProperties":{{"assetType":"key","algorithmProperties":{{"primitive":"ae"}}}}}}' END AS minimal
 FROM o JOIN t USING (repo) JOIN customer ON c_custkey = k, (SELECT unnest([0, 1]) AS component)""")
def match_inputs(spark, d):
    """M01, P03, J06, J07, J08."""
    return _inputs(spark, d).select("repo", F.col("file").cast("long").alias("file"), "component", "minimal")


def _matched(e, limit_s=None):
    from bomlens.functions.registry import vectorized
    from bomlens.operators import matching as M

    e = e.select("repo", F.col("file").cast("long").alias("file"), F.col("component").cast("long").alias("component"), "minimal")
    e = vectorized(e.withColumn("attributes", J.paths_of("minimal")), "minimal")
    near = M.nearest(e, ["repo"])
    members = M.n_way(e, near, ["repo"], limit_s).withColumn("cost", F.lit(0.0))
    return members, e


@query()
def match_results(spark, d):
    """Neighbours, groups and envelopes of all projects."""
    return MJ.envelopes(*_matched(_inputs(spark, d)))


@query("""WITH o AS (SELECT c_custkey // 5 AS repo, count(*) FILTER (c_custkey % 7 < 4) AS n FROM customer GROUP BY 1)
 SELECT repo, 0 AS match_count, CASE WHEN n < 2 THEN 'error' ELSE 'timeout' END AS status FROM o WHERE n > 0""")
def match_envelopes(spark, d):
    """Projects of one document are errors; with no time at all, all others are timeouts."""
    members, _ = _matched(_inputs(spark, d), 0.0)
    every = _documents(spark, d).filter("c_custkey % 7 < 4").select(F.expr("c_custkey div 5").alias("repo"), F.col("c_custkey").alias("file"))
    return MJ.envelopes(members, every).select("repo", "match_count", "status")


@query("""SELECT l_orderkey AS repo, l_linenumber % 3 AS file, l_linenumber AS component, p_name, p_name IS NOT NULL AS found FROM lineitem LEFT JOIN (SELECT l_orderkey AS o, l_linenumber AS c, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber < 4) ON o = l_orderkey AND c = l_linenumber""")
def aligned_members(spark, d):
    """Members of groups with the components at their places; places that no document has are not found."""
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("repo"), (F.col("l_linenumber") % 3).alias("file"), F.col("l_linenumber").alias("component"))
    c = table(spark, d, "lineitem").filter("l_linenumber < 4").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = c.select(F.col("l_orderkey").alias("repo"), (F.col("l_linenumber") % 3).alias("file"), F.col("l_linenumber").alias("component"), "p_name")
    return MJ.aligned(members, c)


@query("""SELECT repo, file, component, CASE component WHEN 0 THEN lower(c_mktsegment) || '@' || c_custkey ELSE 'n-' || c_nationkey END AS name
 FROM (SELECT *, c_custkey // 5 AS repo, (row_number() OVER (PARTITION BY c_custkey // 5 ORDER BY c_custkey) - 1)::INTEGER AS file FROM customer WHERE c_custkey % 7 NOT IN (4, 5)),
 (SELECT unnest([0, 1])::INTEGER AS component) WHERE c_custkey % 7 = 0""")
def prepared_documents(spark, d):
    """Only components at the top count; broken texts are skipped and those after them move up."""
    docs = _documents(spark, d).select(F.expr("c_custkey div 5").alias("repo"), F.col("c_custkey").alias("at"), F.col("doc").alias("json"))
    return MJ.prepared(docs).select("repo", "file", "component", F.try_variant_get(D.parsed(F.col("text")), "$.name", "string").alias("name"))


@query("""SELECT c_custkey AS repo, CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey % 4 ELSE coalesce(s, 0) END::BIGINT AS size FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def size_fallback(spark, d):
    """A zero or missing size is taken from the project's results."""
    repos = table(spark, d, "customer").select(F.col("c_custkey").alias("repo"), F.nullif((F.col("c_nationkey") % 4).cast("long"), F.when(F.col("c_custkey") % 2 == 0, 0)).alias("size"))
    return store.sized(repos, table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("size")))


@query("SELECT c_name AS insp_id, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END::INTEGER AS tools FROM customer WHERE c_name = 'Customer#000000012'")
def inspection_lookup(spark, d):
    """One inspection by its id; the filter reaches the scan."""
    tools = F.when(F.col("c_custkey") % 3 == 0, '["a","b"]').when(F.col("c_custkey") % 3 == 1, "{bad")
    found = store.looked_up(table(spark, d, "customer").select(F.col("c_name").alias("insp_id"), tools.alias("workers_json")), "Customer#000000012")
    return found.select("insp_id", F.size("workers").alias("tools"))


@query("SELECT o_orderpriority AS insp_id, count(*) AS jobs FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1")
def scanned_jobs(spark, d):
    """Jobs of all inspections by the pattern of their keys."""
    kind = F.when(F.col("o_orderkey") % 3 > 0, "job").otherwise("meta")
    keys = table(spark, d, "orders").select(F.concat(F.lit("insp:"), "o_orderpriority", F.lit(":"), kind, F.lit(":"), F.col("o_orderkey").cast("string")).alias("key"))
    return L.scanned_keys(keys).groupBy("insp_id").agg(F.count("job_id").alias("jobs"))


@query("SELECT c_custkey AS repo, 2::INTEGER AS tools FROM customer")
def queued_match_jobs(spark, d):
    """Match jobs through a queue."""
    from bomlens.streaming import catalog as SC

    jobs = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("repo"), F.array("c_mktsegment", F.lit("x")).alias("tools"))
    return SC.queued_match_jobs(spark, jobs).select("repo", F.size("tools").alias("tools"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '_manifest/x/manifest.json' WHEN 1 THEN '_manifest/a.json' WHEN 2 THEN 'bom.json' WHEN 3 THEN '_manifest/manifest.spdx.json' END AS path FROM supplier WHERE s_suppkey % 5 < 4""")
def best_output_file(spark, d):
    """S23."""
    k = F.col("s_suppkey") % 5
    paths = F.when(k == 0, F.array(*map(F.lit, ("_manifest/x/manifest.json", "_manifest/bom.json", "manifest.spdx.json")))).when(k == 1, F.array(*map(F.lit, ("_manifest/z.json", "_manifest/a.json", "bom.json")))).when(k == 2, F.array(*map(F.lit, ("sbom.json", "bom.json", "src/manifest.json")))).when(k == 3, F.array(*map(F.lit, ("_manifest/bom.json", "_manifest/manifest.spdx.json")))).otherwise(F.array(F.lit("readme.md"), F.lit("src/bom.json")))
    return L.best_output(table(spark, d, "supplier").select("s_suppkey", F.explode(paths).alias("path")), ["s_suppkey"])


@query("""SELECT c_custkey, '**' || c_name || '**<br/><span style=''opacity:0.75; font-size:0.9rem;''><b>ID:</b> ' || c_custkey || '<br/><b>Created:</b> ' || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '?' END || '  ·  <b>Jobs:</b> ' || c_nationkey || '</span>' AS header,
 strftime(DATE '2024-03-01' - (c_nationkey::INTEGER), '%Y-%m-%d') AS since, list_aggregate(list_transform(range(greatest(c_custkey % 17 - 9, 1), c_custkey % 17 + 1), lambda i: 'l' || i), 'string_agg', chr(10)) AS tail FROM customer WHERE c_custkey % 17 > 0""")
def inspection_texts(spark, d):
    """Headers, dates some days back, the last ten lines of a trace."""
    c = table(spark, d, "customer").filter("c_custkey % 17 > 0")
    lines = F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 17).cast("int")), lambda i: F.concat(F.lit("l"), i.cast("string")))
    header = S.inspection_header(F.col("c_name"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", header.alias("header"), S.days_ago(F.col("c_nationkey").cast("int"), F.lit("2024-03-01 00:00:00").cast("timestamp")).alias("since"), F.array_join(L.tail(lines), "\n").alias("tail"))


@query(f"""SELECT json_object('worker', worker, 'total', count(*), 'completed', count(*) FILTER (status = 'completed'))::VARCHAR AS json FROM ({JOBS}) GROUP BY worker""")
def status_as_json(spark, d):
    """K13."""
    rows = all_jobs(spark, d).groupBy("worker").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"))
    return X.status_json(rows)


@query("""SELECT p_partkey::VARCHAR AS component, (p_size % 3)::VARCHAR AS file, list_aggregate(list_sort(list_distinct([p_brand, p_type])), 'string_agg', ';') AS attributes FROM part""")
def models_as_csv(spark, d):
    """Elements written as CSV and read back."""
    from bomlens.operators.matching import attributes
    from bomlens.streaming.catalog import _folder

    folder = _folder(spark)
    X.models_csv(table(spark, d, "part").select((F.col("p_size") % 3).alias("file"), F.col("p_partkey").alias("component"), attributes(F.col("p_brand"), F.col("p_type")).alias("attributes")), folder)
    return spark.read.option("header", True).csv(folder)


@query(f"""WITH m AS (SELECT l_orderkey AS repo, l_suppkey AS match, l_linenumber AS at_, l_partkey % 7 - 1 AS file, CASE WHEN l_discount > 0.02 THEN l_extendedprice END AS cost FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_linenumber ORDER BY l_partkey, l_extendedprice, l_discount) = 1),
 g AS (SELECT repo, match, arg_min(cost, at_) FILTER (cost IS NOT NULL) AS c, count(*) AS members, list(file ORDER BY at_) FILTER (file BETWEEN 0 AND 4) AS files FROM m GROUP BY 1, 2),
 b AS (SELECT repo, match, string_agg('[' || ({WORKERS!r})[f + 1] || ']', ' ' ORDER BY i) AS badges FROM (SELECT repo, match, f, min(i) AS i FROM (SELECT repo, match, unnest(files) AS f, generate_subscripts(files, 1) AS i FROM g) GROUP BY ALL) GROUP BY 1, 2)
 SELECT repo, match, row_number() OVER (PARTITION BY repo ORDER BY c NULLS LAST, match)::INTEGER AS rank, CASE WHEN c IS NULL THEN 'n/a' ELSE format('{{:.4f}}', c) END AS cost, coalesce(badges, '') AS badges, members FROM g LEFT JOIN b USING (repo, match)""")
def match_viewer(spark, d):
    """M15, O02, D06."""
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("repo"), F.col("l_suppkey").alias("match"), F.col("l_linenumber").alias("at"), (F.col("l_partkey") % 7 - 1).alias("file"), F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")).alias("cost"), "l_partkey", "l_extendedprice", "l_discount")
    from bomlens.operators.selection import first_of

    m = first_of(m, ["repo", "match", "at"], "l_partkey", "l_extendedprice", "l_discount").drop("l_partkey", "l_extendedprice", "l_discount")
    return MJ.viewed(m, WORKERS)


@query("""SELECT p_partkey, 'cryptoProperties.deep.AssetType' AS asset_path, CASE WHEN p_size > 25 THEN 'x.primitive' END AS primitive_path FROM part""")
def deep_key_search(spark, d):
    """The first key of a name at any depth, whatever its case."""
    tail = F.when(F.col("p_size") > 25, ',"x":[1,{"primitive":"ae"}]').otherwise("")
    text = F.concat(F.lit('{"type":"t","cryptoProperties":{"deep":{"AssetType":"key"}}'), tail, F.lit("}"))
    return table(spark, d, "part").select("p_partkey", J.key_path(text, "assetType").alias("asset_path"), J.key_path(text, "primitive").alias("primitive_path"))


@query("""SELECT p_partkey, unnest(['type/' || p_type, 'sizes/' || p_size, 'sizes/' || (p_size + 1), 'in/brand/' || p_brand]) AS path FROM part""")
def document_paths(spark, d):
    """J09."""
    text = F.to_json(F.struct(F.col("p_type").alias("type"), F.array("p_size", F.col("p_size") + 1).alias("sizes"), F.struct(F.col("p_brand").alias("brand")).alias("in")))
    return table(spark, d, "part").select("p_partkey", F.explode(J.paths_of(text)).alias("path"))


@query("""SELECT p_partkey, lower(p_brand) AS brand, lower(p_type) AS type FROM part""")
def lowered_components(spark, d):
    """Fields that aren't allowed go, strings are lower-cased at every depth."""
    text = F.to_json(F.struct(F.col("p_type").alias("type"), F.col("p_brand").alias("other"), F.struct(F.array(F.struct(F.col("p_brand").alias("brand"))).alias("a")).alias("cryptoProperties")))
    low = D.parsed(J.lowered_json(text))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_variant_get(low, "$.other", "string"), F.try_variant_get(low, "$.cryptoProperties.a[0].brand", "string")).alias("brand"), F.try_variant_get(low, "$.type", "string").alias("type"))


@query("SELECT l_orderkey, count(*)::INTEGER AS results, count(*)::INTEGER AS patched FROM lineitem GROUP BY 1")
def sarif_reports(spark, d):
    """Results of a report, and regions that have a context region after the patch."""
    place = F.struct(F.struct(F.struct(F.col("l_linenumber").alias("startLine")).alias("region")).alias("physicalLocation"))
    reports = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(F.struct(F.array(place).alias("locations"))).alias("results"))).alias("runs"))).alias("report"))
    patched = D.parsed(J.context_regions("report"))
    regions = F.try_variant_get(patched, "$.runs[0].results", "array<variant>")
    with_context = F.filter(regions, lambda r: F.try_variant_get(r, "$.locations[0].physicalLocation.contextRegion.snippet.text", "string").isNotNull())
    return reports.select("l_orderkey", D.sarif_results(F.col("report")).alias("results"), F.size(with_context).alias("patched"))


@query("""SELECT c_custkey, 'library' AS type, 1 AS n FROM customer""")
def fenced_answers(spark, d):
    """An answer with a fenced list becomes a document."""
    text = F.lit('Here it is:\n```json\n[{"type":"library","name":"x"}]\n```\nDone.')
    c = D.components(D.parsed(D.fenced(text)))
    return table(spark, d, "customer").select("c_custkey", D.field(F.element_at(c, 1), "$.type").alias("type"), F.size(c).alias("n"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 7 < 4 AND c_custkey % 7 <> 3 THEN CASE WHEN lower(c_mktsegment) = 'building' THEN 1 ELSE 0 END WHEN c_custkey % 7 = 3 THEN 0 ELSE 0 END::INTEGER AS kept FROM ({_DOCS}) JOIN customer USING (c_custkey)""")
def included_components(spark, d):
    """Documents with components of one type alone."""
    doc = D.parsed(D.included(F.col("doc"), ["building"]))
    return _documents(spark, d).select("c_custkey", F.size(D.components(doc)).alias("kept"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'private or not found' WHEN 1 THEN 'private repo (auth required)' WHEN 2 THEN 'network error' ELSE 'unknown' END AS reason,
 'https://***@h.org/r' AS url, CASE c_custkey % 4 WHEN 0 THEN 'cpp' WHEN 1 THEN 'javascript' WHEN 2 THEN 'csharp' END AS language, 'a' || chr(10) || 'b' AS trace FROM customer""")
def text_rules(spark, d):
    """F21, F22, F28, F29."""
    k = F.col("c_custkey") % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    err = pick("fatal: Repository not found.", "could not read Username", "Could not resolve host: x", "")
    return table(spark, d, "customer").select("c_custkey", S.clone_reason(err).alias("reason"), S.redacted(F.lit("https://user:tok@h.org/r")).alias("url"), S.analyser_language(pick("C++", " TypeScript ", "C#", "cobol")).alias("language"), S.trace_text(F.lit("a"), F.lit(""), F.lit("b")).alias("trace"))


_PRETTY = """'{' || chr(10) || '  "components": [' || chr(10) || '    {' || chr(10) || '      "cryptoProperties": {' || chr(10) || '        "assetType": "algorithm"' || chr(10) || '      },' || chr(10) || '      "name": "' || c_mktsegment || '@' || c_custkey || '",' || chr(10) || '      "type": "' || lower(c_mktsegment) || '"' || chr(10) || '    },' || chr(10)
 || '    {' || chr(10) || '      "cryptoProperties": {' || chr(10) || '        "algorithmProperties": {' || chr(10) || '          "primitive": "ae"' || chr(10) || '        },' || chr(10) || '        "assetType": "key"' || chr(10) || '      },' || chr(10) || '      "name": "N-' || c_nationkey || '",' || chr(10) || '      "type": ""' || chr(10) || '    }' || chr(10) || '  ]' || chr(10) || '}'"""


@query(f"""SELECT 'i1/w/owner_' || c_custkey || '_w.json' AS path, CASE c_custkey % 7 WHEN 2 THEN '[' || chr(10) || '  {{' || chr(10) || '    "bom": ' || replace(p, chr(10), chr(10) || '    ') || chr(10) || '  }}' || chr(10) || ']'
 WHEN 3 THEN '[' || chr(10) || '  ' || replace(p, chr(10), chr(10) || '  ') || chr(10) || ']' WHEN 4 THEN '{{bad' WHEN 5 THEN '' WHEN 6 THEN '{{' || chr(10) || '  "components": []' || chr(10) || '}}' ELSE p END AS content
 FROM (SELECT c_custkey, {_PRETTY} AS p FROM customer WHERE c_custkey % 2 = 0)""")
def zip_export_rows(spark, d):
    """Paths and pretty contents of an archive."""
    rows = _documents(spark, d).select(F.concat(F.lit("owner/"), F.col("c_custkey").cast("string")).alias("repo"), F.lit("w").alias("worker"), F.when(F.col("c_custkey") % 2 == 0, "ok").otherwise("error").alias("status"), F.col("doc").alias("json"))
    return X.archive_rows(rows, "i1")


_DIGITS = """WITH h AS (SELECT c_name, md5(c_name) AS h FROM customer),
 p AS (SELECT c_name, ('0x' || substr(h, 1, 7))::BIGINT AS a, ('0x' || substr(h, 8, 7))::BIGINT AS b, ('0x' || substr(h, 15, 7))::BIGINT AS c, ('0x' || substr(h, 22, 7))::BIGINT AS d, ('0x' || substr(h, 29, 4))::BIGINT AS e FROM h)"""


def _modulo(n: int) -> str:
    """The 128-bit number of the five groups of digits, modulo n."""
    return f"(((((a % {n}) * 268435456 + b) % {n} * 268435456 + c) % {n} * 268435456 + d) % {n} * 65536 + e) % {n}"


@query(f"""{_DIGITS}, s AS (SELECT *, CASE WHEN {_modulo(13)} = 0 THEN 'timeout' WHEN {_modulo(11)} = 0 THEN 'error' ELSE 'ok' END AS status FROM p)
 SELECT c_name AS repo, status, CASE WHEN status = 'ok' THEN 5 + {_modulo(36)} ELSE 0 END::INTEGER AS components FROM s""")
def synthetic_documents(spark, d):
    """Generated documents and how many components they hold."""
    repos = table(spark, d, "customer").select(F.col("c_name").alias("repo"))
    return synthetic.generated(repos).select("repo", "status", F.size(D.components(D.parsed(F.col("json")))).alias("components"))


_PREFIX = """WITH h AS (SELECT c_name, c_nationkey, md5(c_name) AS h FROM customer),
 p AS (SELECT c_name, c_nationkey, ('0x' || substr(h, 1, 7))::BIGINT AS a, ('0x' || substr(h, 8, 7))::BIGINT AS b, ('0x' || substr(h, 15, 7))::BIGINT AS c, ('0x' || substr(h, 22, 7))::BIGINT AS d, ('0x' || substr(h, 29, 4))::BIGINT AS e, ('0x' || substr(h, 29, 2))::BIGINT AS f, ('0x' || substr(h, 29, 3))::BIGINT AS g FROM h)"""


@query(f"""{_PREFIX}, s AS (SELECT *, CASE WHEN {_modulo(13)} = 0 THEN 'timeout' WHEN {_modulo(11)} = 0 THEN 'error' ELSE 'ok' END AS status,
 ((((a % 51 * 268435456 + b) % 51 * 268435456 + c) % 51 * 268435456 + d) % 51 * 256 + f) % 51 AS r, ((((a % 66 * 268435456 + b) % 66 * 268435456 + c) % 66 * 268435456 + d) % 66 * 4096 + g) % 66 AS w FROM p)
 SELECT c_name AS repo, status, CASE WHEN status = 'ok' THEN 1024 * greatest(10, least(512, CASE WHEN c_nationkey > 0 THEN c_nationkey * 100 ELSE 500 END * (10 + r) // 100)) ELSE 2 END::BIGINT AS bytes,
 CASE WHEN status = 'ok' THEN 5 + {_modulo(36)} ELSE 0 END::INTEGER AS components, CASE WHEN status = 'ok' THEN round(greatest(0.05, least(59.75, 60.0 * (20 + w) / 100)), 3)::DOUBLE END AS seconds FROM s""")
def sized_synthetic_documents(spark, d):
    """Generated documents of a target size within its bounds, their components and how long they take."""
    repos = table(spark, d, "customer").select(F.col("c_name").alias("repo"), (F.col("c_nationkey") * 100).alias("size_kb"), F.lit("https://h.org/r").alias("git_url"), F.lit("main").alias("branch"))
    out = synthetic.generated_sized(repos)
    return out.select("repo", "status", F.octet_length("json").cast("long").alias("bytes"), F.size(D.components(D.parsed(F.col("json")))).alias("components"), F.round("seconds", 3).alias("seconds"))


def _single_files(spark, rows):
    """Each row as a JSON file of its own in the shared folder."""
    from bomlens.tables import shared_root

    folder = f"{shared_root(spark)}/files-{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", 1).json(folder)
    return folder


@query("""SELECT c_nationkey AS nation, count(*)::INTEGER AS components, min(c_name) AS first FROM customer GROUP BY 1""")
def scanned_folder(spark, d):
    """Every JSON file of a folder as one document."""
    from bomlens.sources import readers

    one = F.struct(F.col("c_name").alias("name"), F.lit("library").alias("type"))
    docs = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(one)).alias("components"))
    found = readers.documents(spark, _single_files(spark, docs)).withColumn("doc", D.parsed(F.col("json")))
    c = D.components(F.col("doc"))
    return found.select(F.try_variant_get("doc", "$.c_nationkey", "int").alias("nation"), F.size(c).alias("components"), D.field(F.element_at(c, 1), "$.name").alias("first"))


@query("""SELECT 'nation ' || c_nationkey AS name, 2::INTEGER AS tools, count(*)::INTEGER AS projects, min(CASE WHEN c_custkey % 2 = 0 THEN 'https://g.org/' || c_name ELSE 'https://github.com/' || c_name END) AS first FROM customer WHERE c_nationkey % 5 > 0 GROUP BY c_nationkey""")
def uploaded_configurations(spark, d):
    """Configurations as files, with either names of their fields; those without tools are not usable."""
    from bomlens.sources import readers

    even = F.col("c_custkey") % 2 == 0
    repo = F.struct(F.when(even, F.col("c_name")).alias("full_name"), F.when(~even, F.col("c_name")).alias("repo"), F.when(even, F.concat(F.lit("https://g.org/"), "c_name")).alias("clone_url"))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_list(repo).alias("repos"))
    tools = F.when(F.col("c_nationkey") % 5 > 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    folder = _single_files(spark, rows.select(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("name"), tools.alias("workers"), "repos"))
    found = readers.usable(readers.configuration(spark, folder))
    return found.select("name", F.size("workers").alias("tools"), F.size("repos").alias("projects"), F.array_min(F.transform("repos", lambda r: r["git_url"])).alias("first"))
