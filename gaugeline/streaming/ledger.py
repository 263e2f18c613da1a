"""Append-only ledger tables with resume by key, in batch and under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def not_done(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of keys that the ledger lacks."""
    return todo.join(done.select(*key), key, "left_anti")


def append_new(rows: DataFrame, path: str, key: list[str]) -> None:
    """Append the rows whose keys aren't in the table yet; the commit protocol takes the place of a lock."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(key)
    if exists(spark, path):
        rows = not_done(rows, spark.read.parquet(path), key)
    rows.write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stream_to_ledger(stream: DataFrame, path: str, checkpoint: str, key: list[str]):
    """Each micro-batch appends what is new, so a replayed batch adds nothing."""
    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(df: DataFrame, time: str, width: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums in tumbling event-time windows; a watermark for streams."""
    df = df.withWatermark(time, late) if late else df
    out = df.groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), *by, "n", "total")
