"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidepane", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with.

    On a cluster the session comes from ``spark-submit``; only the SQL settings matter there:
    UTC, adaptive execution and its skew-join handling.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session (tests) may fall back to a temporary folder of its own, which goes with the process.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if sc.getCheckpointDir():
        return os.path.dirname(sc.getCheckpointDir())
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="tidepane-")
    atexit.register(shutil.rmtree, fallback, ignore_errors=True)
    sc.setCheckpointDir(fallback)
    return fallback


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; never reused between runs."""
    return f"{shared_dir(spark).rstrip('/')}/tidepane/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are on shared storage, so a lost executor costs nothing."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def save_round(df: DataFrame, folder: str, number: int) -> DataFrame:
    """The rows of a round of an iteration as a table of its own in ``folder``, read back.

    For loops of many rounds with joins: a checkpoint keeps the estimated size of its plan, the size of a join is the
    product of those of its sides, and so the digits of the estimate double with each round until planning stands
    still. A table read back has the size of its files.
    """
    path = f"{folder}/round-{number}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the tables ``folder/batch=<number>`` that are written to the end, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = [s.getPath() for s in files.listStatus(path) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("batch=")) for p in done)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_round(spark: SparkSession, folder: str, number: int) -> None:
    """Removes what :func:`save_round` wrote for a round that nothing reads any more."""
    drop_folder(spark, f"{folder}/round-{number}")
