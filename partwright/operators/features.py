"""Machining features of parts from tables of planar and cylindrical faces."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwright.functions import numbers as nx

# ---- fixed values ---------------------------------------------------------------------------
Z_ALIGNED = 0.9
AXIS_ALIGNED = 0.9
AXIS_TOLERANCE = 0.05
FULL_TURN_TOLERANCE_RAD = 0.01
REVOLVED_SHARE = 0.4
REVOLVED_MIN_COUNT = 3
THROUGH_SHARE = 0.8
# ---------------------------------------------------------------------------------------------


def full_turn(extent: Column) -> Column:
    return extent >= 2 * math.pi - FULL_TURN_TOLERANCE_RAD


def axis_key(x: Column, y: Column, z: Column) -> Column:
    """Direction with the first component beyond the tolerance made positive, two decimals."""
    t = AXIS_TOLERANCE
    flip = (x < -t) | ((F.abs(x) <= t) & ((y < -t) | ((F.abs(y) <= t) & (z < -t))))
    sign = F.when(flip, -1.0).otherwise(1.0)
    return F.concat_ws(",", *[nx.fixed(nx.exact_round(c * sign, 2), 2) for c in (x, y, z)])


def axis_span(dx: Column, dy: Column, dz: Column) -> Column:
    """Part size along the axis it is aligned with; null for a slanted axis."""
    sizes = [(dx, "x"), (dy, "y"), (dz, "z")]
    return F.coalesce(*[F.when(F.abs(d) >= AXIS_ALIGNED, F.col(f"{c}_max") - F.col(f"{c}_min")) for d, c in sizes])


def part_summary(faces: DataFrame) -> DataFrame:
    """One row per part from the long face table (``face_kind`` planar / cylindrical / other).

    Two aggregations in a row: by part and axis, then by part; no join back to the faces.
    """
    cyl, planar = F.col("face_kind") == "cylindrical", F.col("face_kind") == "planar"
    full = cyl & full_turn(F.col("angular_extent"))
    keyed = faces.withColumn("axis", F.when(full, axis_key(F.col("ax"), F.col("ay"), F.col("az"))))
    by_axis = keyed.groupBy("part_id", "axis").agg(
        F.count(F.lit(1)).alias("faces"), F.count_if(cyl).alias("cylinders"), F.count_if(full).alias("full"),
        F.count_if(planar & (F.abs(F.col("az")) >= Z_ALIGNED)).alias("millable"),
    )
    out = by_axis.groupBy("part_id").agg(
        F.sum("faces").alias("total_faces"), F.sum("cylinders").alias("cylinders"), F.sum("millable").alias("millable"),
        F.sum("full").alias("holes"), F.coalesce(F.max(F.when(F.col("axis").isNotNull(), F.col("full"))), F.lit(0)).alias("dominant"),
    )
    share = F.when(F.col("cylinders") > 0, F.col("dominant") / F.col("cylinders")).otherwise(0.0)
    revolved = (F.col("dominant") >= REVOLVED_MIN_COUNT) & (share >= REVOLVED_SHARE)
    out = out.withColumn("revolved", revolved).withColumn("dominant_share", share)
    kept = lambda c: F.when(F.col("revolved"), 0).otherwise(F.col(c)).cast("bigint").alias(c)
    return out.select(
        "part_id", "revolved", "dominant", "dominant_share", kept("millable"), kept("holes"),
        F.when(F.col("revolved"), F.col("total_faces")).otherwise(F.col("total_faces") - F.col("millable") - F.col("holes")).alias("unrecognised"),
        "total_faces", (~F.col("revolved") & ((F.col("millable") > 0) | (F.col("holes") > 0))).alias("supported"),
    )


def holes(faces: DataFrame, boxes: DataFrame) -> DataFrame:
    """Full-turn cylinders with diameter, depth and the through flag by the part's box."""
    full = faces.where((F.col("face_kind") == "cylindrical") & full_turn(F.col("angular_extent")))
    span = axis_span(F.col("ax"), F.col("ay"), F.col("az"))
    return full.join(boxes, "part_id").select(
        "part_id", "face_id", nx.exact_round(2 * F.col("radius"), 3).alias("diameter_mm"), nx.exact_round(F.col("height"), 3).alias("depth_mm"),
        F.coalesce(F.col("height") >= THROUGH_SHARE * span, F.lit(False)).alias("through"),
    )


def millable_faces(faces: DataFrame) -> DataFrame:
    flat = faces.where((F.col("face_kind") == "planar") & (F.abs(F.col("az")) >= Z_ALIGNED))
    return flat.select("part_id", "face_id", F.col("oz").alias("z_height_mm"), (F.col("az") > 0).alias("normal_up"))
