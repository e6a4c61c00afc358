"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "partwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and a fixed time zone.

    Partition counts are left to adaptive coalescing: start from plenty of shuffle partitions on a
    cluster and let Spark merge small ones; local callers pass their own number.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Methods the JVM would not compile run as separate projections instead of one fused stage.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where one machine runs all (master ``local[...]``) a fresh temporary folder is made instead; elsewhere each
    executor would write to a disk of its own, so a missing setting is an error.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not folder:
        existing = spark.sparkContext.getCheckpointDir()
        if existing:
            return existing
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-partwright-", dir="/tmp")
        spark.conf.set(CHECKPOINT_KEY, folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a step of an iteration to the shared folder and go on from the written table.

    Computed once, survives lost executors, and the files give the planner real sizes. The folder goes when the
    application ends, or before with ``drop_step``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    written = spark.read.schema(df.schema).parquet(path)
    written._step = path
    return written


def drop_step(step: DataFrame) -> None:
    """Delete the folder of a table that ``cut_lineage`` gave, once nothing is read from it any more."""
    path = getattr(step, "_step", None)
    if path is not None:
        fs, where = _file_system(step.sparkSession, path)
        fs.delete(where, True)
