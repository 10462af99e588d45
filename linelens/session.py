"""Session helpers: a sensible default session and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}
#: Spark's setting that removes the shuffle files of a finished write, instead of when the driver's garbage collector comes by.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster pass your own session in."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("linelens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables and checkpoints.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting gets a temporary folder; on a cluster a missing setting is an error,
    because executors could not read one another's local folders.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (
        None if sc.applicationId in _LOCAL_DIR else sc.getCheckpointDir())
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _LOCAL_DIR:
        _LOCAL_DIR[sc.applicationId] = tempfile.mkdtemp(prefix="linelens-")
    path = _LOCAL_DIR[sc.applicationId]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows once as a parquet table in the shared folder and go on from that table.

    This cuts the lineage through storage that outlives executors, fixes whatever was not
    deterministic (range borders, generated ids), and later readers scan only the columns
    they use. The shuffle files behind the table go with the write, so that a run of many tables
    holds those of one at a time on disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
