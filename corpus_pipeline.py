"""The corpus pipeline: language ID, near-duplicate removal, substring dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's rows to the shared checkpoint folder, so that the next one reads them back. Stages that move
texts or sets through Arrow bound the bytes of the session's batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modweave.llm.jaccard_join import near_duplicates
from modweave.llm.language import UNKNOWN, languages
from modweave.llm.mixing import mix
from modweave.llm.packing import pack
from modweave.llm.runtime import bound_batches, ensure_checkpoint_dir
from modweave.llm.substring_dedup import substring_dedup

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*_COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those without any letter and those between two languages go; lang stays as given."""
    bound_batches(spark)
    judged = languages(_documents(docs), keep_text=True)
    return _documents(judged.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, nulls last; of different texts under one
    doc_id each is judged by itself, and of rows alike in doc_id and text one stays."""
    bound_batches(spark)
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("tag"))
    judged = near_duplicates(docs.select(name.alias("doc_id"), "text"))
    kept = judged.where("doc_id = component_id").select("doc_id.*").distinct().withColumnsRenamed({"doc_id": "__id", "tag": "__of"})
    rows = docs.withColumn("__tag", F.xxhash64("text"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__tag") == F.col("__of")), "left_semi")
    # the semi-join has dealt rows by doc_id and tag already
    nth = Window.partitionBy("doc_id", "__tag").orderBy("lang", "source", "n_chars")
    return _documents(rows.withColumn("__nth", F.row_number().over(nth)).where("__nth = 1"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeated windows cover; those that lose nothing stay as they are, those that lose all go."""
    bound_batches(spark)
    cleaned = substring_dedup(docs.select(*_COLUMNS, F.col("text").alias("__whole")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("__whole"))
    cleaned = cleaned.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return _documents(cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it."""

    def numbered(rows: DataFrame, tag: Column) -> DataFrame:  # repeated rows are told apart by number
        rows = rows.withColumn("__key", F.xxhash64("doc_id", "source", tag))
        return rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy("doc_id")))

    copies = numbered(mix(docs), F.col("tag")).select("__key", F.col("__nth").alias("__same"), "copies").where("copies > 0")
    mixed = numbered(docs, F.xxhash64("text")).join(copies, "__key").where("__nth - __same = 0")
    return _documents(mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, placed in sequences."""
    bound_batches(spark)
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizer ids are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage applied to all that its predecessor kept. A stage's rows go when the next one's are written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
