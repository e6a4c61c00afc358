"""Quality verdicts, serial-production figures, remediation codes and the work schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwright.functions import numbers as nx
from partwright.functions import text as tx
from partwright.plans import printing, route
from partwright.sources.joins import lookup, settled

# ---- fixed values ---------------------------------------------------------------------------
SIMILARITY_OK = 0.80
SIMILARITY_DEFECTIVE = 0.55
CYCLE_MINUTES_PER_OPERATION = 12.0
COST_PER_OPERATION = 350.0
BASE_DEFECT_PERCENT = 2.0
DEFECT_PERCENT_PER_WARNING = 1.5
SHIFT_MINUTES = 480
MANY_OPERATIONS = 3
SCHEDULE_MS = 15000
PRINT_WEIGHT, STEP_WEIGHT = 2.0, 1.0
METAL_ICONS = [("TURN", "lathe"), ("MILL", "mill"), ("DRILL", "drill"), ("GRIND", "grind"), ("CONTROL", "control")]
PRINT_ICONS = [("FDM", "fdm_printer"), ("SLA", "resin_printer"), ("MSLA", "resin_printer"), ("SLS", "sls_printer")]
DECISIONS = ["approved", "rejected"]
# ---------------------------------------------------------------------------------------------


def verdict(score: Column) -> Column:
    """Missing score means no silhouette was found: inconclusive."""
    return F.when(score >= SIMILARITY_OK, "ok").when(score < SIMILARITY_DEFECTIVE, "defective").otherwise("inconclusive")


def serial_plan(parts: DataFrame) -> DataFrame:
    """Figures from ``op_count`` and ``warning_count``."""
    ops, warned = F.col("op_count"), F.col("warning_count")
    cycle = ops * CYCLE_MINUTES_PER_OPERATION
    return parts.select(
        "*", nx.exact_round(cycle, 1).alias("cycle_min"), nx.exact_round(ops * COST_PER_OPERATION, 2).alias("unit_cost"),
        nx.exact_round(cycle * 100 / SHIFT_MINUTES, 1).alias("batch_100_days"),
        F.when(warned > 1, "high").when(warned == 1, "medium").otherwise("low").alias("risk"),
        nx.exact_round(F.lit(BASE_DEFECT_PERCENT) + warned * DEFECT_PERCENT_PER_WARNING, 1).alias("defect_percent"),
    )


def advice_codes(kind: Column, ops: Column, warned: Column, decided: Column) -> Column:
    """Optimisation codes for good parts, remediation codes for defective ones, none otherwise."""
    found = F.array_compact(F.array(
        F.when((kind == "metal") & (ops > MANY_OPERATIONS), "merge_operations"),
        F.when(kind == "plastic", "parallel_printers"),
        F.when(warned > 0, "resolve_warnings"),
    ))
    good = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("no_suggestion")))
    repair = F.when(kind == "plastic", F.array(F.lit("check_print_parameters"), F.lit("check_postprocessing"))).otherwise(
        F.array(F.lit("check_machine_setup"), F.lit("check_tooling"))
    )
    return F.when(decided == "ok", good).when(decided == "defective", repair).otherwise(F.array().cast("array<string>"))


def quality_report(parts: DataFrame) -> DataFrame:
    """``parts`` has part_id, kind, op_count, warning_count and similarity."""
    decided = verdict(F.col("similarity"))
    planned = serial_plan(parts.withColumn("verdict", decided))
    good = F.col("verdict") == "ok"
    figures = ["cycle_min", "unit_cost", "batch_100_days", "risk", "defect_percent"]
    return planned.select(
        "part_id", "kind", "verdict", F.coalesce(nx.exact_round(F.col("similarity"), 4), F.lit(0.0)).alias("similarity"),
        *[F.when(good, F.col(c)).alias(c) for c in figures],
        advice_codes(F.col("kind"), F.col("op_count"), F.col("warning_count"), F.col("verdict")).alias("advice"),
    )


def boundaries(weights: DataFrame, key: str, order: str) -> DataFrame:
    """Start and end of each operation on the time scale, by running share of the weights.

    For templates: operations of one plan, bounded by the reference tables.
    """
    w = Window.partitionBy(key)
    total = F.sum("weight").over(w)
    total = F.when(total == 0, 1.0).otherwise(total)
    done = F.sum("weight").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return weights.withColumn("start_ms", (done - F.col("weight")) / total * SCHEDULE_MS).withColumn("end_ms", done / total * SCHEDULE_MS)


@settled
def metal_timing(spark: SparkSession) -> DataFrame:
    template = route.route_template(spark).select("material_group_id", "sequence_no", "op_code", "op_name", F.lit(1.0).alias("weight"))
    return boundaries(template, "material_group_id", "sequence_no")


@settled
def print_timing(spark: SparkSession) -> DataFrame:
    steps = printing.step_template(spark).select("am_material_group_id", (F.col("step_no") + 1).alias("step_no"), F.col("place").alias("at"),
                                                 F.col("step_name").alias("name"), F.lit(STEP_WEIGHT).alias("weight"))
    groups = printing.material_groups(spark).select("am_material_group_id", F.lit(1).alias("step_no"), F.lit(0).alias("at"),
                                                    F.lit(None).cast("string").alias("name"), F.lit(PRINT_WEIGHT).alias("weight"))
    return boundaries(groups.unionByName(steps), "am_material_group_id", "at")


def metal_schedule(spark: SparkSession, drawings: DataFrame) -> DataFrame:
    out = lookup(route.drawings_with_group(spark, drawings).select("part_id", "material_group_id"), metal_timing(spark), "material_group_id", "inner")
    return out.select(
        "part_id", F.col("sequence_no").alias("step_no"), F.col("op_name").alias("name"),
        tx.first_prefix(F.col("op_code"), METAL_ICONS, "machine_generic").alias("icon"), "start_ms", "end_ms",
    )


def print_schedule(spark: SparkSession, plans: DataFrame) -> DataFrame:
    """The print itself weighs 2, every post-processing step 1; step numbers move up by one."""
    out = lookup(plans.where("am_material_group_id IS NOT NULL").select("part_id", "am_technology_code", "am_material_group_id"), print_timing(spark),
                 "am_material_group_id", "inner")
    is_print = F.col("at") == 0
    return out.select(
        "part_id", "step_no", F.when(is_print, F.concat(F.lit("Печать ("), "am_technology_code", F.lit(")"))).otherwise(F.col("name")).alias("name"),
        F.when(is_print, tx.first_prefix(F.col("am_technology_code"), PRINT_ICONS, "printer_generic")).otherwise("postprocessing").alias("icon"),
        "start_ms", "end_ms",
    )


def decisions(approvals: DataFrame) -> DataFrame:
    """Validity of a decision: a rejection needs a comment; unknown decisions are invalid."""
    comment = tx.strip(F.col("comment"))
    given = F.when(comment != "", comment)
    code = (
        F.when(~F.col("decision").isin(DECISIONS), "unknown_decision")
        .when((F.col("decision") == "rejected") & given.isNull(), "comment_required").otherwise("valid")
    )
    return approvals.select("approval_id", "decision", comment.alias("comment"), code.alias("validity"))
