"""Where rows go: idempotent replacement, write-once publishing, daily files, retention, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write rows in place of what their keys had: a retry writes the same again. Keys are partitions."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def publish_once(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key is not there yet; how many they were. What is there is never changed."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    rows = rows.dropDuplicates([key])
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def schema_matches(spark: SparkSession, path: str, rows: DataFrame) -> bool:
    """Whether a table has these columns, in kind and order; one that does not is read by nobody."""
    return exists(spark, path) and [(f.name, f.dataType) for f in spark.read.parquet(path).schema] == [(f.name, f.dataType) for f in rows.schema]


def append_audit(rows: DataFrame, folder: str, at: str = "at") -> None:
    rows.withColumn("day", F.date_format(at, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(folder)


def prune_days(spark: SparkSession, folder: str, oldest: str) -> list[str]:
    """Delete the daily folders before a day; which they were. Only names are looked at."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(target):
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < oldest:
            fs.delete(status.getPath(), True)
            gone.append(name[4:])
    return sorted(gone)


def statistics(spark: SparkSession, path: str, small: int = 16 << 20) -> dict[str, int]:
    """Rows, files and small files of a table."""
    df = spark.read.parquet(path)
    conf = spark._jsc.hadoopConfiguration()
    sizes = []
    for f in df.inputFiles():
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        sizes.append(p.getFileSystem(conf).getFileStatus(p).getLen())
    return {"rows": df.count(), "files": len(sizes), "small_files": sum(s < small for s in sizes)}


def swept(staged: DataFrame, files: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """(name, why): what a sweep removes: staged rows past their time, and files without a row. staged(name, staged_at), files(name)."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"interval {hours} hours")
    old = staged.where(F.col("staged_at") < cutoff).select("name", F.lit("old").alias("why"))
    return old.unionByName(files.join(staged, "name", "left_anti").select("name", F.lit("orphan").alias("why")))
