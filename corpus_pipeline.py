"""From raw documents to packed training sequences, stage by stage.

Every stage takes all that its predecessor kept; all but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlens.llm import mixing, ngram_join, packing, toxicity
from bomlens.llm.shared import WORD, tokenizer_path, written

#: SQL can't express the stages' models and pseudorandom draws.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine doesn't reject (score below 0.7); null and empty texts stay."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score(docs.withColumnsRenamed({"score": "__score"}), model).filter("score < 0.7").drop("score")
    return kept.withColumnsRenamed({"__score": "score"}).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that similar word shingles link. Of rows that repeat an id, one of
    each text stays. Documents without an id or without words are in no group and stay."""
    keyed = written(docs.withColumn("__key", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)), "keyed")
    groups = written(ngram_join.join(keyed.select(F.col("doc_id"), "text")), "groups")
    kept = groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = written(kept, "kept")
    out = keyed.join(kept.filter("n = 1").select("doc_id"), "doc_id", "left_semi")
    # Rows that repeat an id share its component: equal texts are one document, different ones all stay.
    again = keyed.join(kept.filter("n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "__key"])
    return out.union(again).unionByName(keyed.filter("doc_id IS NULL")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A pass over a source that takes a part of a document gives the
    words it takes; n_chars follows the text. Documents without words are never taken. Rows are known by what they hold, so the
    same rows give the same mix however they are split."""
    content = F.to_json(F.struct(*docs.columns))
    keyed = written(docs.withColumn("__row", F.struct(F.xxhash64(content).alias("a"), F.xxhash64(F.lit(1), content).alias("b"))), "mix-documents")
    counted = written(keyed.select("__row", "source", mixing.word_count(F.col("text")).alias("size")).groupBy("__row", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    # Equal rows are one text that stands for all of them; they are numbered by their count.
    sized = written(mixing.numbered(counted).select(F.struct("__row.a", "__row.b", "copy").alias("row_id"), "__row", "source", "size"), "mix-rows")
    again = counted.filter("n > 1").select("__row")
    rows = keyed.join(again, "__row", "left_anti").union(keyed.join(again, "__row", "left_semi").dropDuplicates(["__row"]))
    _, pieces = mixing.mix(sized)
    takes = pieces.groupBy("row_id", "epoch").agg(F.sum("n_words").alias("__taken"), F.array_sort(F.collect_list(F.struct("word_start", "n_words"))).alias("__parts"))
    takes = takes.join(sized.select("row_id", "__row", "size"), "row_id").select("__row", "__parts", (F.col("__taken") == F.col("size")).alias("__whole"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform("__parts", lambda p: F.slice(words, (p["word_start"] + 1).cast("int"), p["n_words"].cast("int")))), " ")
    out = rows.join(takes, "__row").withColumn("text", F.when(F.col("__whole"), F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; a document that comes twice is packed twice."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
