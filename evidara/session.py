"""Session helpers: local sessions for tests and benches, shared scratch tables, input spreading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, app: str = "evidara", memory: str = "8g") -> SparkSession:
    """A single-JVM session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for each application, as their workers run functions of it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="evidara-ship-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/evidara", "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(app)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, a Parquet file or a folder of them."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else one of our own where driver and executors are one process.

    On a cluster without the setting there is no folder that all can read, so that it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    own = tempfile.mkdtemp(prefix="evidara-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def scratch(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once into the shared folder and read it back: cuts lineage and survives lost executors.

    The folder is removed when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidara-{os.getpid()}-{uuid.uuid4().hex[:12]}-{name}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass  # the session has ended before us


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows of a scan that fewer tasks than there are cores would read.

    A file of one row group is one task however the scan is cut. What comes out of a shuffle stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


def few_rows(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows; reads at most limit + 1 of them."""
    return df.limit(limit + 1).count() <= limit


def keep_keys(df: DataFrame, keys: DataFrame, on: str, limit: int = 1_000_000) -> DataFrame:
    """Rows of df whose key is in keys: a broadcast semi join up to limit keys, a shuffled one beyond."""
    return df.join(F.broadcast(keys) if few_rows(keys, limit) else keys, on, "left_semi")
