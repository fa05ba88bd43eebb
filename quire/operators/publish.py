"""Writers: staged tables that are checked before they replace what is there, and state kept without in-place updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, there = _fs(spark, path)
    fs.delete(there, True)


def recover(spark: SparkSession, target: str) -> None:
    """Brings back what a publish() that broke off between its two renames has left: the old table where there is no other."""
    fs, there = _fs(spark, target)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}__old")
    if fs.exists(old):
        if fs.exists(there):
            fs.delete(old, True)
        elif not fs.rename(old, there):
            raise OSError(f"cannot bring back {target}")


def publish(df: DataFrame, target: str, violations=None, fewer: bool = False) -> None:
    """Writes df beside target, checks it, then swaps it in; on any failure the old table stays, at its place or for recover().

    violations(df) must be empty; fewer=False refuses fewer rows than there are. What an earlier call has left comes back first.
    """
    spark = df.sparkSession
    recover(spark, target)
    staged, old = f"{target}__staged", f"{target}__old"
    df.write.mode("overwrite").parquet(staged)
    made = spark.read.parquet(staged)
    fs, there = _fs(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        if violations is not None and not violations(made).isEmpty():
            raise ValueError("the table has violations")
        if not fewer and fs.exists(there) and made.count() < spark.read.parquet(target).count():
            raise ValueError("the table would lose rows")
    except ValueError:
        fs.delete(path(staged), True)
        raise
    if fs.exists(there) and not fs.rename(there, path(old)):
        raise OSError(f"cannot set {target} aside")
    if not fs.rename(path(staged), there):
        recover(spark, target)
        raise OSError(f"cannot put {staged} in place")
    fs.delete(path(old), True)


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table with rows in place of those of the same key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows)


def append_log(df: DataFrame, folder: str) -> None:
    """Adds JSON lines to a log."""
    df.write.mode("append").json(folder)


def surplus(snapshots: DataFrame, keep: int) -> DataFrame:
    """Snapshots (path, made) beyond the newest `keep`, one at least."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.orderBy(F.desc("made"), F.desc("path"))
    return snapshots.withColumn("nth", F.row_number().over(w)).where(F.col("nth") > max(1, keep)).drop("nth")
