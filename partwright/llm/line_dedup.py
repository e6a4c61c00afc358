"""Line dedup: lines that several documents share stay in the first of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwright.llm.common import SPACES, ascii_lower, hash128, text_or_empty
from partwright.session import cut_lineage


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10, with_row: bool = False) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` (and ``row``, the whole input row, on request): one row per input row.

    Lines are exploded with their position and hashed by their normalised key; distinct documents are counted per
    hash; keys in at least ``min_docs`` documents lose their lines in all but the document with the smallest id; the
    kept lines are put together by position. Only hashes and positions are shuffled for that; a key that a third of
    all documents hold is counted in two steps (per document, then per key) and met in a join that can be split.

    Null or empty texts are one empty line. Rows that repeat an id are one document for the count, each with its own
    lines. A null id is one document that comes after all others. Keys shorter than ``min_chars`` are never dropped.
    Tables without rows give no rows; further columns are ignored.
    """
    row = [F.struct("*").alias("row")] if with_row else []
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), *row)
    base = base.withColumn("_t", F.xxhash64("text"))
    line = base.select("doc_id", "_t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    key = line.select("doc_id", "_t", "pos", F.btrim("line", F.lit(SPACES)).alias("line")).where(F.length("line") >= min_chars)
    key = cut_lineage(key.select("doc_id", "_t", "pos", hash128(ascii_lower(F.col("line"))).alias("h")).select("doc_id", "_t", "pos", "h.a", "h.b"))
    holders = key.groupBy("a", "b", "doc_id").agg(F.count("*").alias("n"))
    shared = holders.groupBy("a", "b").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    # A table of its own: a join that stands right on the aggregation could not be split where a line is very frequent.
    shared = cut_lineage(shared.select("a", "b", "first"))
    drop = key.join(shared, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    drop = drop.groupBy(F.col("doc_id").alias("_d"), F.col("_t").alias("_dt")).agg(F.collect_set("pos").alias("gone"))
    lines = F.split("text", "\n", -1)
    found = base.join(drop, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_dt")), "left")
    places = F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1)
    return (
        found.withColumn("lines", lines)
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("n_dropped") <= 0, F.col("text")).otherwise(
            F.array_join(F.transform(F.array_except(places, "gone"), lambda i: F.element_at("lines", i + 1)), "\n")))
        .withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))
        .select("doc_id", "text", "n_lines", "n_dropped", *(["row"] if with_row else []))
    )
