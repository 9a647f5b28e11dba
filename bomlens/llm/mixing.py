"""Mixing sources to target weights, with DataFrame operations only.

Every source's documents stand one after another in a pseudorandom order and are cut into blocks of a
fixed number of words. A source's target fixes how many blocks it gives. Each of these draws goes to an
output shard, so the counts of a source over the shards are multinomial; the slots of a source, numbered
through the shards, pass a pseudorandom permutation of its block numbers, and each pass over all blocks is
finished before the next begins, so no block is taken more often than its source's target asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, shuffle_partitions, written

#: Rounds of the swap-or-not permutation.
ROUNDS = 24
CHUNK = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def permuted(x: Column, n: Column, *tweak: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 (swap-or-not); ``tweak`` picks which one."""

    def one_round(v: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(r, *tweak), n) - v, n)
        top = F.greatest(v, mate)
        return F.when(F.xxhash64(top, r, *tweak).bitwiseAND(F.lit(1)) == 1, mate).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), one_round)


def source_targets(rows: DataFrame, weights: tuple[float, ...], factor: float, most: float) -> DataFrame:
    """One row per source: its size and target. Targets are in proportion to the weights, which repeat over
    the sources by code point with null last; none exceeds ``most`` times its source's size. Sources are a mix's
    few parts: their table is sorted in one task, so there should be no more than some millions."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(order - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # Sources in the order in which a rising level reaches their caps.
    rise = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = rise.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(float(factor)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / free).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return per.select("source", "source_size", "source_rows", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", level * F.col("weight"))).alias("target"))


def mix(rows: DataFrame, *, block: int = 256, shard_blocks: int = 4096, weights: tuple[float, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """``rows``: a written table with row_id (unique, and the same for the same row in any run), source, size. Returns the sources with their targets
    and the pieces of the mix: row_id, epoch, shard, slot, word_start, n_words (a document's words
    from word_start on, in this slot). A source's pieces hold floor(target) words. Rows of size 0 (empty or
    null text) give no piece; a null source is a source; without rows there are no pieces. ``block`` and
    ``shard_blocks`` are words in a block and the mean number of blocks in an output shard."""
    rows = rows.select("row_id", "source", F.col("size").cast("long").alias("size"))
    sources = source_targets(rows, weights, factor, most)
    plan = sources.select("source", "source_size", "source_rows", F.floor("target").cast("long").alias("want"))
    plan = written(plan.withColumn("n_full", F.expr(f"source_size div {block}")).withColumn("n_blocks", F.expr(f"(source_size + {block} - 1) div {block}")).withColumn("draws", F.expr(f"CASE WHEN want = 0 THEN 0 ELSE n_blocks * (want div source_size) + ((want % source_size) + {block} - 1) div {block} END")), "mix-plan")
    total = plan.agg(F.sum("draws")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))

    # Places of documents in their source's stream: sums over sqrt(rows) buckets, then inside each bucket.
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    widths = plan.select("source", F.ceil(F.sqrt("source_rows")).cast("long").alias("width"))
    salt = F.pmod(F.xxhash64("row_id"), F.lit(64)).cast("int")
    widths = widths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    placed = rows.filter("size > 0").withColumn("salt", salt)
    placed = placed.join(widths, same(placed, widths) & (placed["salt"] == widths["salt"])).select("row_id", placed["source"], "size", F.pmod(F.xxhash64("row_id", F.lit(seed)), F.col("width")).alias("bucket"))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("first", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
    run = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("row_id", F.lit(seed + 1)), "row_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum("size").over(run))
    placed = placed.join(sums, same(placed, sums) & (placed["bucket"] == sums["bucket"])).select("row_id", placed["source"], "size", (F.col("first") + F.col("upto") - F.col("size")).alias("start"))
    pieces = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))

    # Draws: how many of a source's draws each shard gets, then the slots one by one.
    chunks = plan.filter("draws > 0").select("source", "draws", F.explode(F.expr(f"sequence(0L, (draws - 1) div {CHUNK})")).alias("chunk")).repartition("source", "chunk")
    drawn = chunks.select("source", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(draws, (chunk + 1) * {CHUNK}) - 1)")).alias("draw"))
    counts = drawn.groupBy("source", F.pmod(F.xxhash64("source", "draw", F.lit(seed + 2)), F.lit(shards)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("first", F.sum("n").over(Window.partitionBy("source").orderBy("shard")) - F.col("n"))
    # Few bytes before the rows multiply, so their number of tasks is given.
    slots = counts.join(plan, same(counts, plan)).select(counts["source"], "shard", "first", counts["n"], "source_size", "want", "n_full", "n_blocks").repartition(shuffle_partitions(rows.sparkSession), "source", "shard")
    slots = slots.select("source", "shard", "source_size", "want", "n_full", "n_blocks", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
    lap, at = F.expr("slot div n_blocks"), F.expr("slot % n_blocks")
    slots = slots.withColumn("epoch", lap).withColumn("at", at)
    slots = slots.withColumn("block", F.when(F.col("at") < F.col("n_full"), permuted(F.col("at"), F.greatest("n_full", F.lit(1)), F.col("epoch"), F.col("source"), F.lit(seed + 3))).otherwise(F.col("at")))
    slots = slots.withColumn("end", F.col("block") * block + F.least(F.lit(block), F.expr(f"want - epoch * source_size - at * {block}")))

    # Both sides grow with the corpus, whatever their size looks like before the rows multiply.
    both = pieces.join(slots.hint("merge"), same(pieces, slots) & (pieces["block"] == slots["block"]))
    low, high = F.greatest("start", pieces["block"] * block), F.least(F.col("start") + F.col("size"), (pieces["block"] + 1) * block, F.col("end"))
    both = both.select("row_id", "epoch", "shard", "slot", (low - F.col("start")).alias("word_start"), (high - low).alias("n_words")).filter("n_words > 0")
    return sources, both


def numbered(counted: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``counted``: rows with ``n``. Each row n times, with ``copy`` from 0: equal rows can't be told apart, so
    giving them numbers by their count needs no order, and a row with a huge count is made in many tasks."""
    spark = counted.sparkSession
    runs = counted.withColumn("__run", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")))
    few = runs.filter(f"n <= {chunk}")
    many = runs.filter(f"n > {chunk}").repartition(shuffle_partitions(spark))
    return few.union(many).withColumn("copy", F.explode(F.expr(f"sequence(__run * {chunk}, least(n, (__run + 1) * {chunk}) - 1)"))).drop("__run", "n")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes. Rows with the same id, source and size are told apart by a number
    alone, so the draws don't depend on how the table is split. A null id is an id; a null or empty text has size 0
    and is never taken; other columns are ignored; no rows give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    rows = numbered(counted).withColumn("row_id", F.struct("doc_id", "source", "size", "copy"))
    rows = written(rows.select("row_id", "doc_id", "source", "size"), "mix-rows")
    sources, pieces = mix(rows)
    taken = pieces.groupBy("row_id").agg(F.sum("n_words").alias("taken"))
    sources = sources.select("source", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt"))
    out = rows.join(taken, "row_id", "left").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(64)).cast("int"))
    out = out.join(sources, out["source"].eqNullSafe(sources["source"]) & (out["salt"] == sources["salt"]))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
