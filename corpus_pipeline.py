"""A training corpus from raw documents: filter by quality, drop near copies, redact secrets, mix sources, pack windows.

All stages take whole texts of any length, null ones as empty, and rows with any column null; extra columns go through
as they are, whatever their names; an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, packing, secretscan, simhash, weak_labels
from quire.llm.common import discard, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weak-label classifier keeps. Each row is judged by itself, so repeated rows and ties share their fate."""
    return weak_labels.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies, on shingles of five words and a similarity of 0.8 or more.

    Rows that share a doc_id are judged by their texts; of equal rows one stays; rows without a doc_id stay.
    """
    return simhash.deduplicated(docs, words=5)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, secrets replaced by a mark; a null text stays null."""
    return secretscan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks: its words in the mix over its size, rounded, copies as rows of their own. Documents without words stay once; a null source is a source."""
    mixed = mixing.mix(docs, keep=True)
    times = F.when(F.col("__size") > 0, F.round(F.col("__taken") / F.col("__size"))).otherwise(1).cast("int")
    return mixed.withColumn("__n", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed training windows; rows that share a doc_id, as copies do, are documents of their own."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("secret scans", secrets), ("mixing sources to target weights", mix), ("packing", pack)]

#: Fingerprints, tokenizer ids and the trained scorer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is a table in the shared folder, and the one before goes when it is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
        if before is not None:
            discard(before)
        before = docs
    return docs
