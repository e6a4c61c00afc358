"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwright.llm.common import WORD, running_sums, text_or_empty


def text_quality(text: Column) -> Column:
    """Weight in (0.05, 1]: share of letters, digits, space and plain punctuation among the characters."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\x20\x09-\x0D.,;:'-]+", ""))
    return F.lit(0.05) + F.lit(0.95) * (plain / F.greatest(F.length(text), F.lit(1)))


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float = 3.0, share: float = 1.0) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    ``weights`` repeat over the sources in code point order, null last. The total (``share`` of all sizes) is dealt by
    weight; a source stops at ``most`` times its size and the rest is dealt again among the others until none is
    above. That end state is a water level: in order of ``cap / weight``, the level before each source follows from
    sums over the sources before it, and the first source that its level doesn't fill fixes the level of all.
    """
    ranked = running_sums(sizes.withColumn("one", F.lit(1)), [], [F.col("source")], {"place": "one"})
    ranked = ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).alias("weight"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = running_sums(ranked, [], [F.col("ratio"), F.col("source")], {"caps": "cap", "passed": "weight"})
    total = sizes.agg((F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(float(share))).alias("total"))
    weight = ranked.agg(F.sum("weight").alias("all_weight"))
    level = filled.crossJoin(total).crossJoin(weight).withColumn("level", (F.col("total") - F.col("caps")) / (F.col("all_weight") - F.col("passed")))
    best = level.where(F.col("ratio") > F.col("level")).agg(F.min_by("level", F.struct("ratio", F.col("source").isNull(), "source")).alias("best"))
    return filled.crossJoin(best).select(
        "source", "source_size", "weight", F.when(F.col("best").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("best"))).alias("target")
    )


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, share: float = 1.0, seed: str = "mix", id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", quality: Column | None = None,
) -> DataFrame:
    """``doc_id, text_hash, source, size, source_size, target, epochs, sampled, copies, taken``, one row per input row.

    ``size`` counts words. Each document draws an exponential key ``-ln(u) / quality`` where ``u`` comes from its id,
    so reruns agree. Within its source, sorted by key, sizes are summed. A source first takes as many complete epochs
    as its target holds (``most`` at the most), then documents in key order until the rest of its budget is met: the
    last one is taken if that ends nearer to the target. Documents are taken whole.

    A source of any size is summed over many partitions. Null texts have size 0 and are never taken. Null sources are
    one source, last in order. A null id draws one common key; repeated rows with equal keys are taken in an order
    that doesn't change the result. Tables without rows give no rows; further columns are ignored.
    """
    text = text_or_empty(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("text_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), (text_quality(text) if quality is None else quality).alias("quality"),
        F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_name"),
    )
    drawn = (F.conv(F.substring(F.md5("_name"), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(16**13 + 1))
    sized = sized.withColumn("key", -F.log(drawn) / F.col("quality")).drop("_name", "quality")
    summed = running_sums(sized, ["source"], [F.col("key"), F.col("doc_id"), F.col("text_hash")], {"before": "size"})
    sizes = summed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, most, share).withColumnRenamed("source", "_s")
    out = summed.join(targets, F.col("source").eqNullSafe(F.col("_s")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.floor(F.lit(float(most))))).otherwise(F.lit(0)).cast("int")
    out = out.withColumn("epochs", epochs)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    out = out.withColumn("sampled", (F.col("size") > 0) & (F.col("epochs") < F.lit(float(most))) & (F.col("before") + F.col("size") / 2 <= rest))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + F.col("sampled").cast("int")).otherwise(F.lit(0)))
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", "epochs", "sampled", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    Rows with equal id and text are copies of one another: their takes are added up and their other columns come from
    one of them.
    """
    plan = mix_sources(docs, id_col=id_col, text_col=text_col, **options)
    plan = plan.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.sum("copies").alias("_n")).where("_n > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_text")).dropDuplicates(["_id", "_text"])
    met = rows.join(plan, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_h")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")).select("row.*")
