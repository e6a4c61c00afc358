"""Continuous review: drawings are checked as they arrive and findings are appended.

The checks join the stream with small reference sides only, so the plan is the one of the batch review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partwright.plans import review
from partwright.streaming import runs


def review_stream(spark: SparkSession, drawings: DataFrame, base: str | None = None) -> DataFrame:
    """Findings of every submitted drawing, there to be read once its batch has ended. However late it comes, a drawing
    is reviewed; one that is submitted again gives nothing.

    The ids reviewed so far are the keyed state of the stream, in RocksDB; no batch reads what earlier ones wrote.
    ``base`` is the folder of findings and state, to go on from an earlier run.
    """
    runs.with_state_store(spark)
    read = runs.run_available(
        drawings.dropDuplicates(["part_id"]), base or runs.new_folder(spark, "reviews"), lambda batch: {"findings": review.drawing_findings(spark, batch)}
    )
    empty = spark.createDataFrame([], drawings.schema)
    return read("findings", review.drawing_findings(spark, empty).schema).drop("batch")
