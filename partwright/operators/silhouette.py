"""Silhouette comparison of photo pairs from pixel tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwright.operators import graph
from partwright.session import cut_lineage


# Tables with rows for every picture grow with the input, and as files they look far smaller than their rows are in
# memory: they are joined by shuffle, so that none passes through the driver.
SHUFFLED = "merge"

# ---- fixed values ---------------------------------------------------------------------------
CANVAS = 260
TARGET_DIAMETER = 140.0
ROTATION_STEP = 15
ANGLES = list(range(0, 360, ROTATION_STEP))
TURNS = [(round(math.cos(math.radians(a)), 9), round(math.sin(math.radians(a)), 9)) for a in ANGLES]
# ---------------------------------------------------------------------------------------------


def otsu_thresholds(pixels: DataFrame) -> DataFrame:
    """Grey level per photo that best splits the histogram; the first such level wins.

    Pixels are counted per level before anything else; a photo then has at most 256 rows.
    """
    histogram = pixels.groupBy("photo_id", "grey").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("photo_id")
    upto = w.orderBy("grey").rowsBetween(Window.unboundedPreceding, 0)
    weighted = F.col("n") * F.col("grey")
    h = histogram.select(
        "photo_id", "grey", F.sum("n").over(upto).cast("double").alias("below"), F.sum(weighted).over(upto).cast("double").alias("sum_below"),
        F.sum("n").over(w).cast("double").alias("total"), F.sum(weighted).over(w).cast("double").alias("sum_all"),
    )
    above = F.col("total") - F.col("below")
    gap = F.col("sum_below") * F.col("total") - F.col("sum_all") * F.col("below")
    spread = F.when(above > 0, gap * gap / (F.col("below") * above)).otherwise(0.0)
    return h.groupBy("photo_id").agg(F.max_by("grey", F.struct(spread.alias("s"), (-F.col("grey")).alias("g"))).alias("threshold"))


def runs(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``photo_id, y, x0, x1, dark, edge``: the pictures as runs of dark or light pixels within a row, written once.

    ``edge`` marks light runs at the border of the picture or beside pixels that are not there.
    """
    lit = pixels.join(thresholds.hint(SHUFFLED), "photo_id").select("photo_id", "x", "y", (F.col("grey") <= F.col("threshold")).alias("dark")).distinct()
    at = F.row_number().over(Window.partitionBy("photo_id", "y", "dark").orderBy("x"))
    found = lit.withColumn("run", F.col("x") - at).groupBy("photo_id", "y", "dark", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    row = Window.partitionBy("photo_id", "y").orderBy("x0")
    open_ends = (F.coalesce(F.lag("x1").over(row), F.col("x0")) != F.col("x0") - 1) | (F.coalesce(F.lead("x0").over(row), F.col("x1")) != F.col("x1") + 1)
    photo = Window.partitionBy("photo_id")
    border = (F.col("y") == F.min("y").over(photo)) | (F.col("y") == F.max("y").over(photo))
    return cut_lineage(found.select("photo_id", "y", "x0", "x1", "dark", (~F.col("dark") & (open_ends | border)).alias("edge")))


def _node(y: str, x: str) -> Column:
    """A run as one number within its picture, in reading order; 32 bits for each axis."""
    return F.shiftleft(F.col(y).cast("long"), 32) + F.col(x)


def _joined_runs(parts: DataFrame, reach: int, below: list[int]) -> DataFrame:
    """Links ``photo_id, src, dst`` of runs that touch, ``reach`` pixels diagonally allowed, in rows ``below`` apart."""
    upper = parts.select("photo_id", _node("y", "x0").alias("src"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.explode(F.array(*[F.col("y") + k for k in below])).alias("y"))
    lower = parts.select("photo_id", "y", _node("y", "x0").alias("dst"), "x0", "x1")
    met = upper.join(lower.hint(SHUFFLED), ["photo_id", "y"]).where((F.col("a0") <= F.col("x1") + reach) & (F.col("x0") <= F.col("a1") + reach))
    return met.select("photo_id", "src", "dst")


def outlines(parts: DataFrame) -> DataFrame:
    """Runs ``photo_id, y, x0, x1`` of each picture's silhouette: the largest dark part with all it encloses.

    Light runs that touch along edges are one part; what is linked to the border (node -1) lies outside. All else,
    linked along edges and corners, falls into filled parts; the one with the most pixels is kept, of equal ones the
    one that comes first in reading order. A picture without dark pixels has none.
    """
    light = parts.where(~F.col("dark"))
    sea = light.where("edge").select("photo_id", _node("y", "x0").alias("src"), F.lit(-1).cast("long").alias("dst"))
    reached = graph.connected_in_tiles(_joined_runs(light, 0, [1]).unionByName(sea), ["photo_id"], ["photo_id"])
    outside = reached.where((F.col("component") == -1) & (F.col("node") != -1)).select("photo_id", F.col("node").alias("_n"))
    named = parts.withColumn("node", _node("y", "x0"))
    solid = named.join(outside.hint(SHUFFLED), (named["photo_id"] == outside["photo_id"]) & (F.col("node") == F.col("_n")), "left_anti")
    solid = cut_lineage(solid.select("photo_id", "y", "x0", "x1", "node"))
    labels = graph.connected_in_tiles(_joined_runs(solid, 1, [0, 1]), ["photo_id"], ["photo_id"])
    labelled = solid.join(labels.hint(SHUFFLED), ["photo_id", "node"], "left").withColumn("component", F.coalesce("component", "node"))
    sized = labelled.groupBy("photo_id", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    best = sized.groupBy("photo_id").agg(F.max_by("component", F.struct("area", (-F.col("component")).alias("first"))).alias("component"))
    return labelled.join(best.hint(SHUFFLED), ["photo_id", "component"], "left_semi").select("photo_id", "y", "x0", "x1")


def masks(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pixels of each photo's silhouette (``outlines``), holes filled."""
    found = outlines(runs(pixels, thresholds))
    kind = pixels.schema["x"].dataType
    return found.select("photo_id", F.explode(F.sequence(F.col("x0").cast(kind), F.col("x1").cast(kind))).alias("x"), "y")


def shapes(mask: DataFrame, target: float = TARGET_DIAMETER) -> DataFrame:
    """Area, centroid and the scale that gives every silhouette the same area."""
    out = mask.groupBy("photo_id").agg(F.count(F.lit(1)).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return out.withColumn("scale", target / (2 * F.sqrt(F.col("area") / math.pi)))


def mask_overlap(pairs: DataFrame, mask: DataFrame) -> DataFrame:
    """Intersection over union of unaligned masks of ``pairs(photo_id, ref_id)``; an empty union gives 0.

    Counts only: both areas and the common pixels, which meet on (reference, x, y).
    """
    area = mask.groupBy("photo_id").agg(F.count(F.lit(1)).alias("n"))
    refs = pairs.select("ref_id").distinct()
    ref_mask = mask.withColumnRenamed("photo_id", "ref_id").join(refs, "ref_id", "left_semi")
    both = mask.join(pairs, "photo_id").join(ref_mask, ["ref_id", "x", "y"]).groupBy("photo_id", "ref_id").agg(F.count(F.lit(1)).alias("common"))
    out = pairs.join(area, "photo_id", "left").join(area.select(F.col("photo_id").alias("ref_id"), F.col("n").alias("m")), "ref_id", "left")
    out = out.join(both, ["photo_id", "ref_id"], "left")
    common = F.coalesce("common", F.lit(0))
    union = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)) - common
    return out.select("photo_id", "ref_id", F.when(union > 0, common / union).otherwise(0.0).alias("iou"))


def rasters(mask: DataFrame, width: int, target: float = TARGET_DIAMETER) -> DataFrame:
    """One row per photo: dark pixel numbers (bounded by the image size) with the shape columns."""
    dark = mask.groupBy("photo_id").agg(
        F.collect_list((F.col("y") * width + F.col("x")).cast("int")).alias("dark"), F.count(F.lit(1)).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
    )
    return dark.withColumn("scale", target / (2 * F.sqrt(F.col("area") / math.pi)))


def _sampled(dark, cx, cy, scale, dx, dy, width, height):
    """The silhouette at the given offsets from its centroid, for offsets of any shape."""
    image = np.zeros(width * height + 1, dtype=bool)
    image[np.asarray(dark, dtype=np.int64)] = True
    sx = np.floor(cx + dx / scale + 0.5).astype(np.int64)
    sy = np.floor(cy + dy / scale + 0.5).astype(np.int64)
    inside = (sx >= 0) & (sx < width) & (sy >= 0) & (sy < height)
    return image[np.where(inside, sy * width + sx, width * height)]


def best_rotations(pairs: DataFrame, raster: DataFrame, width: int, height: int, canvas: int = CANVAS) -> DataFrame:
    """Best overlap of the actual silhouette over 24 rotations of the common canvas, the first best angle wins.

    Rasters are written once. One row holds both rasters of a pair, and pairs are dealt out by their ids, so that a
    reference of many pictures is compared in many tasks; all angles are sampled as one array. Pairs with a missing
    silhouette give a null score.
    """
    raster = cut_lineage(raster.select("photo_id", "dark", "cx", "cy", "scale"))
    wanted = raster.join(pairs.select(F.col("ref_id").alias("photo_id")).distinct().hint(SHUFFLED), "photo_id", "left_semi")
    ref = cut_lineage(wanted).select(*[F.col(c).alias(f"ref_{c}" if c != "photo_id" else "ref_id") for c in raster.columns])
    joined = pairs.join(raster.hint(SHUFFLED), "photo_id", "left").join(ref, "ref_id", "left")
    workers = pairs.sparkSession.sparkContext.defaultParallelism
    joined = joined.repartition(max(workers, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "photo_id", "ref_id")
    schema = T.StructType([T.StructField("photo_id", T.LongType()), T.StructField("ref_id", T.LongType()), T.StructField("score", T.DoubleType()),
                           T.StructField("angle", T.IntegerType())])

    def compare(batches):
        ys, xs = np.mgrid[0:canvas, 0:canvas]
        dx, dy = xs - canvas / 2, ys - canvas / 2
        cos, sin = (np.array(t)[:, None, None] for t in zip(*TURNS))
        turned_dx, turned_dy = dx * cos - dy * sin, dx * sin + dy * cos
        for batch in batches:
            rows = []
            for pair in zip(*(batch[c] for c in ("photo_id", "ref_id", "dark", "cx", "cy", "scale", "ref_dark", "ref_cx", "ref_cy", "ref_scale"))):
                photo, ref, own, other = *pair[:2], pair[2:6], pair[6:]
                if own[0] is None or other[0] is None:
                    rows.append((photo, ref, None, None))
                    continue
                fixed = _sampled(*other, dx, dy, width, height)
                turned = _sampled(*own, turned_dx, turned_dy, width, height)
                both = np.count_nonzero(turned & fixed, axis=(1, 2))
                union = np.count_nonzero(turned, axis=(1, 2)) + np.count_nonzero(fixed) - both
                scores = np.divide(both, union, out=np.zeros(len(ANGLES)), where=union > 0)
                best = int(np.argmax(scores))
                rows.append((photo, ref, float(scores[best]), ANGLES[best]))
            yield pd.DataFrame(rows, columns=["photo_id", "ref_id", "score", "angle"]).astype({"angle": "Int32", "score": "Float64"})

    return joined.mapInPandas(compare, schema)
