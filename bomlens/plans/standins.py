"""The domain's tables, read from the driver's: orders are jobs, lines with their parts are components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORKERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a job of a project (customer) and a tool (priority); a failed one with a high price is a timeout."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("fired")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("repo"), F.col("o_orderpriority").alias("worker"), status.alias("status"), F.when(F.col("o_totalprice") > 250000, "timeout").otherwise("error").alias("payload_status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("sent_at"))


#: The same in SQL.
JOBS = """SELECT o_orderkey AS job_id, o_custkey AS repo, o_orderpriority AS worker,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'fired' END AS status,
 CASE WHEN o_totalprice > 250000 THEN 'timeout' ELSE 'error' END AS payload_status, o_totalprice AS price, o_orderdate AS sent_at FROM orders"""

CURRENT = f"SELECT * FROM ({JOBS}) QUALIFY row_number() OVER (PARTITION BY repo, worker ORDER BY job_id DESC) = 1"

CELLS = f"""SELECT c.repo, w.worker, j.job_id, j.price,
 CASE WHEN j.status = 'completed' THEN 'completed' WHEN j.status = 'failed' THEN CASE WHEN j.payload_status = 'timeout' THEN 'timeout' ELSE 'failed' END
 WHEN j.status = 'cancelled' THEN 'cancelled' ELSE 'pending' END AS status
 FROM (SELECT c_custkey AS repo FROM customer) c CROSS JOIN (SELECT unnest({WORKERS!r}) AS worker) w LEFT JOIN ({CURRENT}) j ON c.repo = j.repo AND w.worker = j.worker"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components where neither their name nor their part is needed: every line has a part, so nothing is joined."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("type"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as components: type, asset, name (with suffix and an @ part) of a job."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = l.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus").join(p.select("p_partkey", "p_type", "p_size", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat("p_type", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("-"), (F.col("p_size") % 5).cast("string"))))
    return rows.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("asset"), name.alias("name"), "p_name", "p_partkey")


COMPONENTS = """SELECT l_orderkey AS job_id, l_linenumber AS pos, l_returnflag AS type, l_linestatus AS asset,
 p_type || CASE WHEN p_size % 3 = 0 THEN '' ELSE '-' || (p_size % 5)::VARCHAR END AS name, p_name, p_partkey
 FROM lineitem JOIN part ON l_partkey = p_partkey"""
