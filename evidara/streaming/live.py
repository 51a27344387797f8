"""The same analytics over a log that grows: streaming trends, sessions, reports, and idempotent sinks.

Each takes a streaming DataFrame of the log's schema. Late rows are taken within a watermark; what a batch has written before is written again
in its place, so that a restarted stream leaves every row once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.session import load, shared_dir


def trend(stream: DataFrame, ts: str, series: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(bucket, series, n) in tumbling windows."""
    marked = stream.withWatermark(ts, late)
    by = marked.groupBy(F.window(ts, window).alias("w"), F.coalesce(F.col(series), F.lit("none")).alias("series")).agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("bucket"), "series", "n")


def sessions(stream: DataFrame, ts: str, who: str, gap: str = "60 seconds", late: str = "1 hour") -> DataFrame:
    """(who, first_at, last_at, n): bursts with no gap as long as this, as maintenance waits for one to end."""
    marked = stream.withWatermark(ts, late)
    by = marked.groupBy(F.session_window(ts, gap).alias("w"), who).agg(F.count("*").alias("n"))
    return by.select(who, F.col("w.start").alias("first_at"), F.col("w.end").alias("last_at"), "n")


def reports(reported: DataFrame, asked: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(report_id, question_id): reports joined with the questions of their session in the window before them."""
    r = reported.withWatermark("reported_at", late)
    q = asked.withWatermark("asked_at", late)
    return r.join(q, F.expr(f"r_session = q_session and asked_at <= reported_at and asked_at >= reported_at - interval {window}")).select("report_id", "question_id")


def once(stream: DataFrame, ids: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Rows of which a repeat within the watermark is dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def into_partitions(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each key's rows in place of what it had: a retried batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path)

    return write


def replay(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """Run a streaming query over files that are there, to its end, and return what it has written."""
    # a stream reads folders: of a single file, the one of its name in its folder
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        source = spark.readStream.schema(schema).parquet(path)
    else:
        source = spark.readStream.schema(schema).option("pathGlobFilter", target.getName()).parquet(str(target.getParent().toString()))
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, n: int) -> None:
        # a batch that is retried writes over what it wrote before
        batch.write.mode("overwrite").parquet(f"{out}/rows" if mode == "complete" else f"{out}/rows/batch={n}")

    result = transform(source)
    running = result.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    return spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")


def streaming_trend(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "events").schema
    return replay(spark, f"{d}/events.parquet", known, lambda s: trend(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"))


def streaming_sessions(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "events").schema
    return replay(spark, f"{d}/events.parquet", known, lambda s: sessions(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours"))


def queries() -> dict:
    return {f.__name__: f for f in (streaming_trend, streaming_sessions)}
