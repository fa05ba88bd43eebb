"""The append-only review log as a stream: windowed counts, idempotent replay and evolving card states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "cardId string, bookId string, rating int, reviewedAt long"


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON lines of a folder as they come; damaged lines have no card and are left out."""
    raw = spark.readStream.schema(REVIEW).json(folder).where("cardId is not null and reviewedAt is not null")
    return raw.withColumn("at", F.timestamp_seconds("reviewedAt"))


def block_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rated reviews by 15 minutes, final when the watermark has passed."""
    return stream.where("rating is not null").withWatermark("at", late).groupBy(F.window("at", "15 minutes")).agg(F.count("*").alias("n"))


def once(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (card, time) once, however often its line comes within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["cardId", "reviewedAt"])


def newest(stream: DataFrame) -> DataFrame:
    """The newest review of each card; an older line that comes late changes nothing."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, rating, n = state.get if state.exists else (-1, 0, 0)
        for pdf in batches:
            n += len(pdf)
            for at, r in sorted(zip(pdf["reviewedAt"], pdf["rating"], strict=True)):
                if at > last:
                    last, rating = int(at), int(r)
        state.update((last, rating, n))
        yield pd.DataFrame({"cardId": [key[0]], "last": [last], "rating": [rating], "n": [n]})

    rated = stream.where("rating is not null").select("cardId", "rating", "reviewedAt")
    return rated.groupBy("cardId").applyInPandasWithState(run, "cardId string, last long, rating int, n long", "last long, rating int, n long", "update", "NoTimeout")


def publish(stream: DataFrame, target: str, checkpoint: str):
    """Runs what is there into Parquet at `target`, batch by batch, each exactly once, and ends."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
