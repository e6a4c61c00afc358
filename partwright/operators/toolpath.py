"""Tool choice and path statistics over tables of features and moves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.functions import numbers as nx
from partwright.operators import sequences as seq
from partwright.plans import route
from partwright.sources.joins import lookup, settled
from partwright.sources.reference import load

# ---- fixed values ---------------------------------------------------------------------------
STOCK_MARGIN_MM = 3.0
DRILL_MATCH_MM = 0.5
MILL_SHARE_OF_HOLE = 0.5
SAFE_CLEARANCE_MM = 5.0
PECK_DEPTH_RATIO = 3.0
PECK_STEP_MM = 5.0
SCHEDULE_MS = 15000
# ---------------------------------------------------------------------------------------------

POINT = ["x", "y", "z"]


ROW = ["op_no", "kind", *POINT]


def _cuts(now, before) -> Column:
    """Whether a move that follows ``before`` cuts: not the first of its operation, and not rapid."""
    return (before("op_no") == now("op_no")) & (now("kind") != "rapid")


def scanned(moves: DataFrame, coarse: list[Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """Moves in one pass: ``move_no`` (unless they have it), the point before them in the same operation (``prev_x`` is null
    for a first move), and ``step``, the number of cutting moves of the plan so far.

    Without ``move_no``, ``order`` gives the order within a plan and ``coarse`` cuts large plans.
    """
    step = {"step": lambda now, before: F.when(_cuts(now, before), F.lit(1).cast("long"))}
    at = "move_no" if order else "_at"
    out = seq.scan(moves, ["plan_id"], coarse or [seq.bucket("move_no")], order or ["move_no"], at, ROW, step, fine=bool(coarse))
    same = F.col("prev_op_no") == F.col("op_no")
    return out.select(*moves.columns, *(["move_no"] if order else []), *[F.when(same, F.col(f"prev_{c}")).alias(f"prev_{c}") for c in POINT], "step")


def segments(moves: DataFrame) -> DataFrame:
    """Moves with the point before them in the same operation; ``prev_x`` is null for a first move."""
    return scanned(moves).drop("step")


def segment_length() -> Column:
    dx, dy, dz = (F.col(c) - F.col(f"prev_{c}") for c in POINT)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def path_lengths(moves: DataFrame) -> DataFrame:
    """Length of the path of every operation, rapid moves included."""
    return segments(moves).groupBy("plan_id", "op_no").agg(F.coalesce(F.sum(segment_length()), F.lit(0.0)).alias("length_mm"))


def _ranges(own: DataFrame) -> DataFrame:
    out = seq.running_sum(own, ["plan_id"], "op_no", F.col("own"), "end_step")
    return out.withColumn("start_step", F.col("end_step") - F.col("own")).drop("own")


def step_ranges(moves: DataFrame) -> DataFrame:
    """Step range of every operation: non-rapid moves counted on across the plan."""
    own = moves.groupBy("plan_id", "op_no").agg(F.count_if(F.col("kind") != "rapid").alias("own"))
    return _ranges(own).select("plan_id", "op_no", "start_step", "end_step")


def path_statistics(passed: DataFrame) -> DataFrame:
    """``plan_id, op_no, start_step, end_step, length_mm`` of every operation, from ``scanned`` moves."""
    both = passed.groupBy("plan_id", "op_no").agg(F.count_if(F.col("kind") != "rapid").alias("own"), F.coalesce(F.sum(segment_length()), F.lit(0.0)).alias("length_mm"))
    return _ranges(both).select("plan_id", "op_no", "start_step", "end_step", "length_mm")


def cutting_steps(moves: DataFrame) -> DataFrame:
    """Segments with their global step: +1 for each non-rapid segment, across operations of the plan."""
    return scanned(moves).withColumn("cuts", F.col("prev_x").isNotNull() & (F.col("kind") != "rapid"))


def active_operation(probes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Operation whose range holds the probed step, else the last operation of the plan; probes of unknown plans go.

    Range starts and probes stand in one order by step; a probe takes the last start before it. Ranges without steps
    hold no probe, so they are left out of the order; plans are cut into buckets of steps.
    """
    last = ranges.groupBy("plan_id").agg(F.max("op_no").alias("last_op"))
    starts = ranges.where("end_step > start_step").select("plan_id", F.col("start_step").alias("at"), F.struct("op_no", "end_step").alias("op"))
    asked = probes.select("plan_id", F.col("step").alias("at")).distinct()
    line = starts.select("plan_id", "at", F.lit(0).alias("is_probe"), "op").unionByName(asked.select("plan_id", "at", F.lit(1).alias("is_probe"), F.lit(None).cast(starts.schema["op"].dataType).alias("op")))
    line = line.withColumn("order", F.struct("at", "is_probe"))
    held = seq.carry_forward(line, ["plan_id"], "order", F.floor(F.col("at") / seq.BUCKET_ROWS), "op", "held").where("is_probe = 1")
    inside = held.where(F.col("at") < F.col("held.end_step")).select("plan_id", F.col("at").alias("step"), F.col("held.op_no").alias("op_no"))
    return probes.join(last, "plan_id").join(inside, ["plan_id", "step"], "left").select(*probes.columns, F.coalesce("op_no", "last_op").alias("op_no"))


def time_boundaries(weights: DataFrame) -> DataFrame:
    """Start and end of operations on the time scale by running share of ``weight``; total 0 counts as 1."""
    totals = weights.groupBy("plan_id").agg(F.sum("weight").alias("total"))
    run = seq.running_sum(weights, ["plan_id"], "op_no", F.col("weight"), "done").join(totals, "plan_id")
    total = F.when(F.col("total") == 0, 1).otherwise(F.col("total"))
    return run.select(
        "plan_id", "op_no", ((F.col("done") - F.col("weight")) / total * SCHEDULE_MS).alias("start_ms"),
        (F.col("done") / total * SCHEDULE_MS).alias("end_ms"),
    )


def boxes(points: DataFrame, key: str) -> DataFrame:
    aggs = [f(c).alias(f"{c}_{n}") for c in POINT for f, n in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy(key).agg(*aggs)


def expanded(box: DataFrame, margin: float = STOCK_MARGIN_MM) -> DataFrame:
    """Stock box: margin in X and Y only."""
    out = box
    for c in ("x", "y"):
        out = out.withColumn(f"{c}_min", F.col(f"{c}_min") - margin).withColumn(f"{c}_max", F.col(f"{c}_max") + margin)
    return out


@settled
def tools(spark: SparkSession) -> DataFrame:
    """Tools with known diameter: ``type_code, id, d, name``."""
    types = load(spark, "tooling_type").select(F.col("id").alias("tooling_type_id"), F.col("code").alias("type_code"))
    known = load(spark, "tooling").where("diameter_mm IS NOT NULL").join(types, "tooling_type_id")
    return known.select("type_code", "id", F.col("diameter_mm").alias("d"), F.col("designation").alias("name"))


def exact_tool(sizes: DataFrame, choice: DataFrame, target: str) -> DataFrame:
    """``target, id, d``: the first tool by id within half a millimetre of each target that has one.

    Both sides meet in cells of half a millimetre and their neighbours, so only close pairs are compared.
    """
    cell = lambda c: F.floor(F.col(c) / DRILL_MATCH_MM)
    near = sizes.select(target).distinct().withColumn("cell", F.explode(F.array(*[cell(target) + i for i in (-1, 0, 1)])))
    met = near.join(choice.select("id", "d").withColumn("cell", cell("d")), "cell").where(F.abs(F.col("d") - F.col(target)) < DRILL_MATCH_MM)
    return met.groupBy(target).agg(F.min(F.struct("id", "d")).alias("t")).select(target, "t.*")


def nearest_tool(sizes: DataFrame, choice: DataFrame, target: str) -> DataFrame:
    """``target, id, d``: the tool nearest to each distinct target by diameter, the smaller id on a tie.

    Tools and targets stand in one order by diameter, cut into slots of 8 mm: the last tool at or below a target and
    the first at or above it are the only candidates.
    """
    held = choice.groupBy("d").agg(F.min("id").alias("id")).select(F.col("d").alias("at"), F.lit(0).alias("asked"), F.struct("d", "id").alias("tool"))
    asked = sizes.select(F.col(target).alias("at")).where(F.col("at").isNotNull()).distinct()
    line = held.unionByName(asked.select("at", F.lit(1).alias("asked"), F.lit(None).cast(held.schema["tool"].dataType).alias("tool")))
    line = line.withColumn("up", F.struct("at", "asked")).withColumn("down", F.struct(-F.col("at"), "asked"))
    slot = F.floor(F.col("at") / 8)
    below = seq.carry_forward(line, [], "up", slot, "tool", "below").where("asked = 1").select("at", "below")
    above = seq.carry_forward(line, [], "down", -slot, "tool", "above").where("asked = 1").select("at", "above")
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.d") - F.col("at")).alias("gap"), F.col(f"{c}.id").alias("id"), F.col(f"{c}.d").alias("d")))
    return below.join(above, "at").select(F.col("at").alias(target), F.least(gap("below"), gap("above")).alias("t")).select(target, "t.id", "t.d")


def largest_tool(choice: DataFrame) -> DataFrame:
    """One row ``id, d``: the largest tool, the smaller id on a tie."""
    return choice.agg(F.min(F.struct(-F.col("d"), "id", "d")).alias("t")).select("t.id", "t.d")


def choose_tools(spark: SparkSession, holes: DataFrame) -> DataFrame:
    """An exact drill if one is within half a millimetre, else the end mill nearest to half the hole, the largest one
    for holes without a size.

    Tools are chosen once per distinct diameter and joined back by equality.
    """
    drills, mills = (tools(spark).where(F.col("type_code") == c).select("id", "d") for c in ("DRILL_TWIST", "MILL_END"))
    hole = F.col("diameter_mm")
    sizes = holes.select("diameter_mm").distinct().withColumn("half", hole * MILL_SHARE_OF_HOLE)
    exact = exact_tool(sizes, drills, "diameter_mm").select("diameter_mm", F.struct("id", "d").alias("drill"))
    near = nearest_tool(sizes, mills, "half").select("half", F.struct("id", "d").alias("near"))
    chosen = sizes.join(exact, "diameter_mm", "left").join(near, "half", "left").select(F.col("diameter_mm").alias("_size"), "drill", "near")
    largest = largest_tool(mills).select(F.struct("id", "d").alias("largest"))
    out = holes.join(chosen, F.col("diameter_mm").eqNullSafe(F.col("_size")), "left").crossJoin(largest)  # one row
    out = out.withColumn("mill", F.when(hole.isNull(), F.col("largest")).otherwise(F.col("near")))
    by_drill = F.col("drill").isNotNull()
    error = F.when(~by_drill & (F.col("mill.d") >= hole), "no_small_tool")
    return out.select(
        *holes.columns, F.when(by_drill, "DRILL").otherwise("MILL").alias("op_code"),
        F.when(by_drill, F.col("drill.id")).otherwise(F.col("mill.id")).alias("tooling_id"),
        F.when(by_drill, F.col("drill.d")).otherwise(F.col("mill.d")).alias("tool_diameter"), error.alias("tool_error"),
    )


@settled
def tool_modes(spark: SparkSession) -> DataFrame:
    """Formula, feed and machinability per operation and material group."""
    operations = load(spark, "operation_type").select(F.col("id").alias("operation_type_id"), F.col("code").alias("op_code"))
    groups = load(spark, "material_group").select(F.col("id").alias("material_group_id"), F.col("machinability_index").alias("kv"))
    pairs = operations.crossJoin(groups)  # reference rows only
    return pairs.join(route.first_formulas(spark), "operation_type_id", "left").join(
        route.feeds(spark), ["operation_type_id", "material_group_id"], "left"
    )


def tool_cutting_mode(spark: SparkSession, features: DataFrame) -> DataFrame:
    """Spindle speed and feed per minute for the chosen tool, or an error code."""
    out = lookup(features, tool_modes(spark), ["op_code", "material_group_id"])
    tool, feed = F.col("tool_diameter"), nx.middle(F.col("feed_min"), F.col("feed_max"))
    depth = F.coalesce(nx.middle(F.col("depth_min"), F.col("depth_max")), tool / 2)
    error = F.when(F.col("tool_error").isNotNull(), F.col("tool_error")).when(F.col("cv").isNull(), "no_formula").when(F.col("feed_min").isNull(), "no_feed")
    speed = nx.cutting_speed(F.col("cv"), F.col("tool_life_min"), F.col("m"), depth, F.col("xv"), feed, F.col("yv"), F.col("kv"))
    rpm = nx.exact_round(nx.spindle_speed(speed, tool), 0)
    out = out.withColumn("error_code", error).withColumn("spindle_rpm", F.when(error.isNull(), rpm.cast("bigint")))
    return out.withColumn("feed_mm_min", nx.exact_round(feed * F.col("spindle_rpm"), 1)).select(
        *features.columns, "error_code", "spindle_rpm", "feed_mm_min"
    )


def circular_time(diameter: Column, depth: Column, feed: Column) -> Column:
    """Minutes of a circularly milled hole."""
    return nx.exact_round(F.when(feed > 0, (F.lit(math.pi) * diameter + depth) / feed).otherwise(0.0), 2)


def drilling_time(depth: Column, tool: Column, feed: Column) -> Column:
    """Minutes of a drilled hole by its path: down and back up from the safe height, in pecks if the hole is deep.

    With n pecks of one step the way adds up to ``2 * (n * clearance + sum of the depths reached)``.
    """
    deep = depth > PECK_DEPTH_RATIO * tool
    n = F.when(deep, F.ceil(depth / PECK_STEP_MM)).otherwise(F.lit(1))
    way = 2 * (n * SAFE_CLEARANCE_MM + PECK_STEP_MM * n * (n - 1) / 2 + depth)
    return nx.exact_round(F.when(feed > 0, way / feed).otherwise(0.0), 2)
