"""Shared folder, written intermediate tables and distributed components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset, a local one is made on a local master, and on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quire-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Python workers get `rows` rows at a time while the block runs; the session's own number comes back after.

    Other queries that start meanwhile in the same session get batches of that size too, which changes no result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    try:
        if rows:
            spark.conf.set(key, str(rows))
        yield
    finally:
        spark.conf.set(key, usual)


#: Rows of texts that a Python worker gets at a time: with 10,000, the usual number, long texts take hundreds of MB.
BATCH_ROWS = 1_000


def released(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step of mapInPandas or mapInArrow that gives its memory back to the system when a task ends; Python workers stay, and keep what they have freed else."""

    def run(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from step(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are over, which it does only once the driver's garbage is collected; what the first time sets free holds some of them."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def written(df: DataFrame, name: str, batch_rows: int | None = BATCH_ROWS) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and survives lost executors. batch_rows: see batches_of()."""
    path = scratch_path(df.sparkSession, name)
    with batches_of(df.sparkSession, batch_rows):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote for df; nothing may read df afterwards."""
    spark, path = df.sparkSession, df._quire_path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): (node, component), component being the smallest node reachable.

    Alternating large-star and small-star steps: a logarithmic number of rounds in practice, each a join with
    per-node minima, so no node's neighbours are ever gathered in one place. Each round is a written table.
    Self-loops are kept as nodes of their own; an empty input gives an empty result.
    """
    loops = edges.where("a = b").select(F.col("a").alias("node"))
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = cur.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark is not None and tuple(now) == mark:
            break
        mark = tuple(now)
        if now[0] == 0:
            break
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "edges")
        discard(cur)
        cur = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    return found.unionByName(loops.distinct().join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
