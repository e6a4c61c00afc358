"""Machining route: operations, cutting modes, requirement lines and cards for every drawing.

All that depends on the material group alone is joined once among the reference tables; drawings
then meet it in one broadcast join and are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwright.functions import numbers as nx
from partwright.functions import text as tx
from partwright.operators.matching import match_material_group
from partwright.sources.joins import lookup, settled
from partwright.sources.reference import load

# ---- fixed values ---------------------------------------------------------------------------
DEFAULT_WORKPIECE_TYPE = "ROLLED_BAR"
NO_MODEL_TEXT = "не подобрано"
NO_TOOLING_TEXT = "не подобрана"
# ---------------------------------------------------------------------------------------------


def first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row by ``order`` within ``keys``."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where("_rn = 1").drop("_rn")


def compatible_equipment(spark: SparkSession, workpiece_code: str = DEFAULT_WORKPIECE_TYPE) -> DataFrame:
    """Equipment types that take a material group and the workpiece type, distinct."""
    types = load(spark, "equipment_type").select(F.col("id").alias("equipment_type_id"), F.col("code").alias("equipment_code"),
                                                 F.col("name").alias("equipment_name"))
    workpiece = load(spark, "workpiece_type").where(F.col("code") == workpiece_code).select(F.col("id").alias("workpiece_type_id"))
    return (
        types.join(load(spark, "equipment_type_material_group"), "equipment_type_id")
        .join(load(spark, "equipment_type_workpiece_type"), "equipment_type_id")
        .join(workpiece, "workpiece_type_id")
        .select("material_group_id", "equipment_type_id", "equipment_code", "equipment_name").distinct()
    )


def equipment_operations(spark: SparkSession) -> DataFrame:
    operations = load(spark, "operation_type").select(
        F.col("id").alias("operation_type_id"), F.col("code").alias("op_code"), F.col("name").alias("op_name")
    )
    return load(spark, "equipment_type_operation_type").join(operations, "operation_type_id")


def operation_tooling(spark: SparkSession) -> DataFrame:
    tooling = load(spark, "tooling_type").select(F.col("id").alias("tooling_type_id"), F.col("name").alias("tooling_name"))
    return load(spark, "operation_type_tooling_type").join(tooling, "tooling_type_id")


def tooling_names(spark: SparkSession) -> DataFrame:
    """Names of the tooling of an operation in id order, as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("tooling_type_id", "tooling_name")))
    return operation_tooling(spark).groupBy("operation_type_id").agg(
        F.array_join(F.transform(ordered, lambda t: t["tooling_name"]), ", ").alias("tooling")
    )


def first_models(spark: SparkSession) -> DataFrame:
    return first_per(load(spark, "equipment_model"), ["equipment_type_id"], "id").select(
        "equipment_type_id", "model_name", "spindle_min", "spindle_max"
    )


def first_formulas(spark: SparkSession) -> DataFrame:
    return first_per(load(spark, "cutting_mode_formula"), ["operation_type_id"], "id").select(
        "operation_type_id", "tool_life_min", "cv", "m", "xv", "yv"
    )


def feeds(spark: SparkSession) -> DataFrame:
    return load(spark, "feed_reference").drop("id")


def machinability(spark: SparkSession) -> DataFrame:
    return load(spark, "material_group").select(F.col("id").alias("material_group_id"), F.col("machinability_index").alias("kv"))


def chosen_equipment(spark: SparkSession) -> DataFrame:
    """For each material group and operation the first compatible equipment type by id."""
    offered = compatible_equipment(spark).join(equipment_operations(spark), "equipment_type_id")
    return first_per(offered, ["material_group_id", "op_code"], "equipment_type_id")


@settled
def route_template(spark: SparkSession) -> DataFrame:
    """Planned operations per material group in technological order, numbered 5, 10, 15…"""
    planned = chosen_equipment(spark).join(load(spark, "operation_order"), "op_code")
    number = F.row_number().over(Window.partitionBy("material_group_id").orderBy("op_rank"))
    planned = planned.withColumn("sequence_no", 5 * number)
    for extra, on in (
        (first_models(spark), ["equipment_type_id"]),
        (tooling_names(spark), ["operation_type_id"]),
        (first_formulas(spark), ["operation_type_id"]),
        (feeds(spark), ["operation_type_id", "material_group_id"]),
        (machinability(spark), ["material_group_id"]),
    ):
        planned = planned.join(extra, on, "left")
    return planned


def drawings_with_group(spark: SparkSession, drawings: DataFrame) -> DataFrame:
    out = match_material_group(drawings, load(spark, "material"))
    given = F.when(F.col("blank_designation") != "", F.col("blank_designation"))
    return out.withColumn("blank_diameter", tx.profile_diameter(given))


def with_cutting_mode(ops: DataFrame) -> DataFrame:
    """Adds the reason code, or speed, spindle speed, feed and depth with the machine's limits applied."""
    drill = F.col("op_code") == "DRILL"
    diameter, feed = F.col("blank_diameter"), nx.middle(F.col("feed_min"), F.col("feed_max"))
    depth = F.when(drill, diameter / 2).otherwise(nx.middle(F.col("depth_min"), F.col("depth_max")))
    reason = (
        F.when(diameter.isNull(), "no_diameter").when(F.col("cv").isNull(), "no_formula")
        .when(F.col("feed_min").isNull(), "no_feed").when(depth.isNull(), "no_depth")
    )
    speed = nx.cutting_speed(F.col("cv"), F.col("tool_life_min"), F.col("m"), depth, F.col("xv"), feed, F.col("yv"), F.col("kv"))
    free = nx.spindle_speed(speed, diameter)
    limited = F.col("spindle_min").isNotNull() & F.col("spindle_max").isNotNull()
    spindle = F.when(limited, F.greatest("spindle_min", F.least(F.col("spindle_max"), free))).otherwise(free)
    real = F.when(limited, F.lit(math.pi) * diameter * spindle / 1000).otherwise(speed)
    usable = reason.isNull()
    return ops.select(
        "*", reason.alias("reason_code"),
        F.when(usable, nx.exact_round(real, 1)).alias("cutting_speed_m_min"),
        F.when(usable, nx.exact_round(spindle, 0).cast("bigint")).alias("spindle_speed_rpm"),
        F.when(usable, nx.exact_round(feed, 3)).alias("feed_mm_rev"),
        F.when(usable, nx.exact_round(depth, 2)).alias("depth_of_cut_mm"),
    )


def route_operations(spark: SparkSession, drawings: DataFrame) -> DataFrame:
    grouped = drawings_with_group(spark, drawings)
    return with_cutting_mode(lookup(grouped, route_template(spark), "material_group_id", "inner"))


@settled
def group_summary(spark: SparkSession) -> DataFrame:
    """Per material group: whether any equipment fits, number of operations, operations without a model."""
    equipped = compatible_equipment(spark).groupBy("material_group_id").agg(F.lit(True).alias("equipped"))
    modelless = F.array_sort(F.collect_list(F.when(F.col("model_name").isNull(), F.col("op_code"))))
    planned = route_template(spark).groupBy("material_group_id").agg(F.count(F.lit(1)).alias("op_count"), modelless.alias("modelless"))
    return equipped.join(planned, "material_group_id", "full")


WARNINGS_TYPE = "array<struct<warning_code:string,arg:string>>"


def with_warnings(spark: SparkSession, drawings: DataFrame) -> DataFrame:
    """Adds ``op_count`` and the ``warnings`` array of each drawing, in the order the route is planned."""
    grouped = drawings_with_group(spark, drawings)
    out = lookup(grouped, group_summary(spark), "material_group_id")
    material = F.when(F.col("material") != "", F.col("material"))
    blank = F.when(F.col("blank_designation") != "", F.col("blank_designation"))
    has_group = F.col("material_group_id").isNotNull()
    has_machine = has_group & F.col("equipped").isNotNull()
    nothing = F.lit(None).cast("string")

    def code(condition, name, arg=nothing):
        return F.when(condition, F.struct(F.lit(name).alias("warning_code"), arg.alias("arg")))

    before = F.array_compact(F.array(
        code(material.isNull(), "no_material"),
        code(material.isNotNull() & ~has_group, "unknown_material", material),
        code(has_group & F.col("equipped").isNull(), "no_machine", material),
        code(has_machine & blank.isNotNull() & F.col("blank_diameter").isNull(), "no_diameter", blank),
    ))
    models = F.transform(
        F.when(has_machine, F.col("modelless")), lambda o: F.struct(F.lit("no_model").alias("warning_code"), o.alias("arg"))
    )
    after = F.array_compact(F.array(code(has_machine & F.col("op_count").isNull(), "no_operation")))
    every = F.concat(before, F.coalesce(models, F.array().cast(WARNINGS_TYPE)), after)
    return out.withColumn("warnings", every).withColumn("op_count", F.coalesce("op_count", F.lit(0).cast("bigint"))).drop(
        "equipped", "modelless"
    )


def route_warnings(spark: SparkSession, drawings: DataFrame) -> DataFrame:
    return with_warnings(spark, drawings).select("part_id", F.posexplode("warnings").alias("pos", "w")).select(
        "part_id", (F.col("pos") + 1).alias("warning_no"), "w.warning_code", "w.arg"
    )


@settled
def requirement_template(spark: SparkSession) -> DataFrame:
    """Requirement lines per material group: machining lines, then hardening lines.

    "Null applies to all" is split into two equi-joins instead of one OR condition.
    """
    planned = chosen_equipment(spark).join(load(spark, "operation_order"), "op_code").select("material_group_id", "operation_type_id")
    groups = planned.select("material_group_id").distinct()
    rules = load(spark, "machining_requirement_template")
    general = groups.crossJoin(rules.where("operation_type_id IS NULL").drop("operation_type_id"))  # reference rows only
    special = planned.distinct().join(rules, "operation_type_id").drop("operation_type_id").dropDuplicates(["material_group_id", "id"])
    machining = general.unionByName(special).select(
        "material_group_id", F.lit(1).alias("part"), "id", F.col("formulation").alias("text"), "reference_standard"
    )
    hardening = load(spark, "surface_hardening_method")
    shared = groups.crossJoin(hardening.where("material_group_id IS NULL").drop("material_group_id"))  # reference rows only
    own = groups.join(hardening, "material_group_id")
    method = F.concat(
        "method_name", F.when(F.col("applicable_to") != "", F.concat(F.lit(" ("), "applicable_to", F.lit(")"))).otherwise(""),
        F.lit(" — "), "reference_instruction",
    )
    methods = shared.unionByName(own).select(
        "material_group_id", F.lit(2).alias("part"), "id", method.alias("text"), F.col("reference_instruction").alias("reference_standard")
    )
    line_no = F.row_number().over(Window.partitionBy("material_group_id").orderBy("part", "id"))
    return machining.unionByName(methods).withColumn("line_no", line_no)


def route_requirements(spark: SparkSession, drawings: DataFrame) -> DataFrame:
    return lookup(drawings_with_group(spark, drawings), requirement_template(spark), "material_group_id", "inner")


@settled
def template_columns(spark: SparkSession, code: str):
    row = load(spark, "document_template").where(F.col("code") == code)
    return row.select(F.size(tx.layout_columns(F.col("layout_schema"))).alias("n_columns"), "gost_form")


def route_card(spark: SparkSession, operations: DataFrame) -> DataFrame:
    """Nine text cells per operation."""
    empty = F.lit("")
    cells = [
        F.col("sequence_no").cast("string"), F.concat_ws(" ", "op_code", "op_name"), empty, empty, empty, empty,
        F.coalesce(F.when(F.col("model_name") != "", F.col("model_name")), F.lit(NO_MODEL_TEXT)), empty, empty,
    ]
    return operations.select("part_id", "sequence_no", F.array(*cells).alias("cells"))


def operation_card(spark: SparkSession, operations: DataFrame, code: str = "OK") -> DataFrame:
    """Up to fourteen cells per operation, cut to the columns of the template."""
    empty = F.lit("")

    def number(name: str, digits: int):
        return F.coalesce(nx.fixed(F.col(name), digits), empty)

    cells = [
        F.col("sequence_no").cast("string"), F.lit("1"), F.concat_ws(" ", "op_code", "op_name"),
        F.coalesce(F.when(F.col("model_name") != "", F.col("model_name")), F.lit(NO_MODEL_TEXT)),
        F.coalesce(F.when(F.col("tooling") != "", F.col("tooling")), F.lit(NO_TOOLING_TEXT)),
        number("depth_of_cut_mm", 2), number("feed_mm_rev", 2), number("cutting_speed_m_min", 1),
        F.coalesce(F.col("spindle_speed_rpm").cast("string"), empty), empty, empty, empty, empty, empty,
    ]
    width = template_columns(spark, code)
    return operations.crossJoin(F.broadcast(width)).select(  # one template row
        "part_id", "sequence_no", F.slice(F.array(*cells), 1, F.col("n_columns")).alias("cells"), F.col("reason_code").alias("note_code")
    )
