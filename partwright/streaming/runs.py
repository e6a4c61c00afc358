"""Running a stream over what is there and reading back what its batches wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwright.session import shared_folder


def source(spark: SparkSession, folder: str, file_glob: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def with_state_store(spark: SparkSession) -> None:
    """State of streams that start from now on lies in RocksDB on the executors' disks, not in their memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(
    stream: DataFrame, base: str, make: Callable[[DataFrame], dict[str, DataFrame]], mode: str = "append"
) -> Callable[[str, T.StructType], DataFrame]:
    """Run over everything available; ``make`` turns each micro-batch into named tables.

    Each batch writes its tables to folders of ``base`` named by its number, in place of what a failed attempt left, so
    every row is written once and can be read as soon as its batch has ended. ``base`` also holds the state: a later run
    with the same folder goes on where this one ended. Returns a reader: table name and schema to rows with their
    ``batch``.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for table, rows in make(batch).items():
            rows.write.mode("overwrite").parquet(f"{base}/{table}/batch={number}")
        batch.unpersist()

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return reader(spark, base)


def reader(spark: SparkSession, base: str) -> Callable[[str, T.StructType], DataFrame]:
    """Reads what the batches of ``run_available`` have written so far; nothing yet is an empty table."""

    def read(table: str, schema: T.StructType) -> DataFrame:
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{base}/{table}/batch=-1")
        return spark.read.schema(whole).option("basePath", f"{base}/{table}").parquet(f"{base}/{table}").withColumn("batch", F.col("batch").cast("long"))

    return read
