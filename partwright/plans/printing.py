"""Print plans, material recommendations and printer choice for requested parts.

As in the machining route, everything that depends on technology and material group is joined among
the reference tables first; requests then meet it in broadcast joins and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwright.functions import numbers as nx
from partwright.plans.route import first_per
from partwright.sources.joins import lookup, settled
from partwright.sources.reference import load

# ---- fixed values ---------------------------------------------------------------------------
NO_PRINTER_TEXT = "не подобран"
NO_GROUP_TEXT = "не определён"
OPTIONAL_TEXT = " (опционально)"
# ---------------------------------------------------------------------------------------------


def technologies(spark: SparkSession) -> DataFrame:
    return load(spark, "am_technology").select(
        F.col("id").alias("am_technology_id"), F.col("code").alias("am_technology_code"), F.col("name").alias("am_technology_name")
    )


def material_groups(spark: SparkSession) -> DataFrame:
    return load(spark, "am_material_group").select(
        F.col("id").alias("am_material_group_id"), "am_technology_id", F.col("code").alias("material_group_code"),
        F.col("name").alias("material_group_name"),
    )


def printer_types_of_groups(spark: SparkSession) -> DataFrame:
    types = load(spark, "printer_type").select(F.col("id").alias("printer_type_id"), F.col("code").alias("printer_type_code"))
    return load(spark, "printer_type_material_group").join(types, "printer_type_id")


def first_printer(spark: SparkSession) -> DataFrame:
    """The first printer type of a group and any one model of that type only."""
    first_type = first_per(printer_types_of_groups(spark), ["am_material_group_id"], "printer_type_id")
    models = first_per(load(spark, "printer_model"), ["printer_type_id"], "id").select(
        "printer_type_id", F.col("model_name").alias("printer_model_name")
    )
    return first_type.join(models, "printer_type_id", "left")


def first_density(spark: SparkSession) -> DataFrame:
    known = load(spark, "am_material").where("density_g_cm3 IS NOT NULL")
    return first_per(known, ["am_material_group_id"], "id").select("am_material_group_id", "density_g_cm3")


def first_profile(spark: SparkSession) -> DataFrame:
    return first_per(load(spark, "am_material"), ["am_material_group_id"], "id").select(
        "am_material_group_id", "trade_name", "print_temp_min_c", "print_temp_max_c", "bed_temp_c",
        "requires_heated_chamber", "requires_dry_storage",
    )


def first_effect(spark: SparkSession) -> DataFrame:
    known = load(spark, "postprocessing_quality_effect").where("pp_tooling_type_id IS NOT NULL")
    return first_per(known, ["pp_tooling_type_id"], "id").drop("id")


def effect_label(low: Column, high: Column, ra_low: Column, ra_high: Column) -> Column:
    return F.concat(
        F.lit("улучшение допуска на "), nx.span(low, high), F.lit("%, снижение Ra в "), nx.span(ra_low, ra_high), F.lit(" раз")
    )


def postprocessing_steps(spark: SparkSession) -> DataFrame:
    """Steps per material group by typical order (missing counts as 0), numbered; order 0 takes its place in the list."""
    names = load(spark, "pp_tooling_type").select(F.col("id").alias("pp_tooling_type_id"), F.col("name").alias("step_name"))
    steps = load(spark, "material_group_pp_tooling_type").join(names, "pp_tooling_type_id").join(
        first_effect(spark), "pp_tooling_type_id", "left"
    )
    order = F.coalesce("typical_order", F.lit(0))
    place = F.row_number().over(Window.partitionBy("am_material_group_id").orderBy(order, "pp_tooling_type_id"))
    return steps.withColumn("place", place).withColumn(
        "step_no", F.when(order == 0, F.col("place")).otherwise(F.col("typical_order"))
    ).withColumn("effect", effect_label(F.col("tol_min_pct"), F.col("tol_max_pct"), F.col("ra_min"), F.col("ra_max")))


def quality_standard(spark: SparkSession) -> DataFrame:
    """Tolerance texts per technology."""
    c = F.col
    return load(spark, "am_technology_tolerance").select(
        "am_technology_id", "layer_min", "layer_max",
        nx.span(c("tol_min"), c("tol_max"), "±").alias("tolerance_mm"),
        F.when(c("wall_max").isNotNull(), nx.span(c("wall_min"), c("wall_max")))
        .otherwise(F.concat(F.lit("от "), nx.short(c("wall_min")))).alias("wall_mm"),
        nx.span(c("ra_raw_min"), c("ra_raw_max")).alias("ra_raw_um"),
        F.when(c("ra_fin_min").isNotNull(), nx.span(c("ra_fin_min"), c("ra_fin_max"))).alias("ra_finished_um"),
        nx.short(c("thread_pitch")).alias("thread_pitch_mm"),
        F.when(c("clearance_min").isNotNull(), nx.span(c("clearance_min"), c("clearance_max"))).alias("clearance_mm"),
    )


@settled
def print_template(spark: SparkSession) -> DataFrame:
    """All that a (technology, material group) pair determines, one row per pair."""
    out = material_groups(spark).join(technologies(spark), "am_technology_id")
    for extra, on in (
        (first_printer(spark), "am_material_group_id"), (first_density(spark), "am_material_group_id"),
        (first_profile(spark), "am_material_group_id"), (quality_standard(spark), "am_technology_id"),
        (load(spark, "print_speed_reference"), "am_technology_id"),
    ):
        out = out.join(extra, on, "left")
    return out


def print_plans(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """One row per request with printer, estimate, profile and quality texts; ``known_technology`` tells the failure."""
    known = technologies(spark).select("am_technology_code", F.lit(True).alias("known_technology"))
    out = lookup(requests, known, "am_technology_code")
    out = lookup(out, print_template(spark), ["am_technology_code", "material_group_code"])
    volume = nx.effective_volume(F.col("length_x"), F.col("length_y"), F.col("length_z"))
    layer = nx.middle(F.col("layer_min"), F.col("layer_max"))
    grams = volume / 1000 * F.col("density_g_cm3")
    minutes = volume / F.col("volumetric_rate_mm3_s") / nx.SECONDS_PER_MINUTE
    ready = volume.isNotNull() & layer.isNotNull() & grams.isNotNull() & minutes.isNotNull()
    return out.select(
        "*",
        F.when(ready, nx.exact_round(layer, 3)).alias("layer_height_mm"),
        F.when(ready, nx.exact_round(minutes, 1)).alias("print_time_min"),
        F.when(ready, nx.exact_round(grams, 1)).alias("material_g"),
    )


def print_warnings(plans: DataFrame) -> DataFrame:
    def code(condition, name):
        return F.when(condition, F.lit(name))

    known, group = F.col("known_technology").isNotNull(), F.col("am_material_group_id").isNotNull()
    codes = F.array_compact(F.array(
        code(~known, "unknown_technology"),
        code(known & ~group, "unknown_material"),
        code(group & F.col("printer_type_id").isNull(), "no_printer_type"),
        code(group & F.col("printer_type_id").isNotNull() & F.col("printer_model_name").isNull(), "no_model"),
        code(group & F.col("trade_name").isNull(), "no_profile"),
    ))
    return plans.select("part_id", F.posexplode(codes).alias("pos", "warning_code")).select(
        "part_id", (F.col("pos") + 1).alias("warning_no"), "warning_code"
    )


def process_card(plans: DataFrame) -> DataFrame:
    """Seven text cells per request."""
    empty = F.lit("")

    def with_unit(name: str, unit: str):
        return F.coalesce(F.concat(nx.short(F.col(name)), F.lit(unit)), empty)

    cells = F.array(
        F.col("am_technology_code"), F.coalesce("printer_model_name", F.lit(NO_PRINTER_TEXT)),
        F.coalesce("material_group_name", F.lit(NO_GROUP_TEXT)), with_unit("layer_height_mm", " мм"), empty,
        with_unit("print_time_min", " мин"), with_unit("material_g", " г"),
    )
    return plans.select("part_id", cells.alias("cells"))


@settled
def step_template(spark: SparkSession) -> DataFrame:
    return postprocessing_steps(spark).select("am_material_group_id", "place", "step_no", "step_name", "is_required", "effect")


def postprocessing_card(spark: SparkSession, plans: DataFrame) -> DataFrame:
    empty = F.lit("")
    steps = step_template(spark)
    rows = lookup(plans.where("am_material_group_id IS NOT NULL"), steps, "am_material_group_id", "inner")
    cells = F.array(
        F.col("step_no").cast("string"), F.concat("step_name", F.when(F.col("is_required"), "").otherwise(OPTIONAL_TEXT)),
        empty, empty, empty, F.coalesce("effect", empty),
    )
    return rows.select("part_id", "place", cells.alias("cells"))


@settled
def recommendation_rules(spark: SparkSession) -> DataFrame:
    sources = load(spark, "recommendation_source").select(F.col("id").alias("source_id"), "source_type", "reliability")
    return (
        load(spark, "application_material_recommendation").withColumnRenamed("id", "rule_id")
        .join(material_groups(spark).drop("am_technology_id").withColumnRenamed("am_material_group_id", "group_id"), "group_id")
        .join(technologies(spark).withColumnRenamed("am_technology_id", "technology_id"), "technology_id")
        .join(sources, "source_id")
    )


def condition_ids(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """Adds ``known_ids`` (distinct ids of known codes) and ``unknown_codes`` (in request order).

    The dictionary travels as one map value, so arrays are resolved in place without a shuffle.
    """
    pairs = load(spark, "operating_condition").select(
        F.map_from_entries(F.collect_list(F.struct("code", "id"))).alias("dictionary")
    )
    out = requests.crossJoin(F.broadcast(pairs))  # one row: a global aggregate of the reference
    found = F.transform("condition_codes", lambda c: F.try_element_at(F.col("dictionary"), c))
    return out.select(
        *requests.columns,
        F.array_distinct(F.array_compact(found)).alias("known_ids"),
        F.filter("condition_codes", lambda c: ~F.map_contains_key(F.col("dictionary"), c)).alias("unknown_codes"),
    )


def recommend(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """Options of each request; base rules (condition null) stand in where no condition matches.

    Request columns: ``request_id``, ``class_code``, ``condition_codes``. Rows of unknown classes and
    classes without rules carry null options. ``fallback`` marks base rules used for a request that
    did name known conditions.
    """
    classes = load(spark, "part_application_class").select(F.col("id").alias("class_id"), F.col("code").alias("class_code"))
    rules = recommendation_rules(spark)
    has_rules = rules.where("condition_id IS NOT NULL").groupBy("class_id").agg(F.collect_set("condition_id").alias("rule_conditions"))
    out = lookup(condition_ids(spark, requests), classes, "class_code")
    out = lookup(out, has_rules, "class_id")
    hit = F.size("known_ids") > 0
    matched = hit & F.coalesce(F.arrays_overlap("known_ids", "rule_conditions"), F.lit(False))
    base = F.array(F.lit(0).cast("bigint"))
    out = out.withColumn("fallback", hit & ~matched & F.col("class_id").isNotNull()).withColumn("base_rule", ~matched)
    out = out.withColumn("rule_condition", F.explode(F.when(matched, F.array_intersect("known_ids", "rule_conditions")).otherwise(base)))
    # Base rules are told apart by a key of their own, so that no condition's id can be taken for theirs.
    keyed = rules.withColumn("rule_condition", F.coalesce("condition_id", F.lit(0).cast("bigint"))).withColumn("base_rule", F.col("condition_id").isNull())
    return lookup(out, keyed, ["class_id", "rule_condition", "base_rule"]).drop("base_rule")


@settled
def printer_options(spark: SparkSession) -> DataFrame:
    """Models of the recommended types that meet the class minimum."""
    models = load(spark, "printer_model").withColumnRenamed("id", "printer_model_id")
    rules = load(spark, "application_printer_recommendation").drop("id")
    classes = load(spark, "part_application_class").select(F.col("id").alias("class_id"), F.col("code").alias("class_code"))
    return (
        rules.join(classes, "class_id").join(models, "printer_type_id")
        .where("build_x >= min_x AND build_y >= min_y AND build_z >= min_z")
        .select("class_code", "printer_model_id", "model_name", "build_x", "build_y", "build_z", "priority")
    )


def printer_fit(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """Printers whose build volume holds the part and meets the class minimum; ``choice`` ranks them."""
    held = lookup(parts, printer_options(spark), "class_code", "inner").where(
        "length_x <= build_x AND length_y <= build_y AND length_z <= build_z"
    )
    best = F.min(F.struct("priority", "printer_model_id", "model_name")).alias("best")
    return held.groupBy("part_id").agg(best).select("part_id", "best.printer_model_id", "best.model_name", "best.priority")


@settled
def model_material_allowed(spark: SparkSession) -> DataFrame:
    """Printer model × material of its types' groups; a model-level exception wins over the type rule."""
    models = load(spark, "printer_model").select(F.col("id").alias("printer_model_id"), "printer_type_id")
    rule = models.join(load(spark, "printer_type_material_group"), "printer_type_id").join(
        load(spark, "am_material").select(F.col("id").alias("am_material_id"), "am_material_group_id"), "am_material_group_id"
    ).select("printer_model_id", "am_material_id", F.lit(True).alias("by_rule"))
    closed = load(spark, "printer_material_override")
    return rule.join(closed, ["printer_model_id", "am_material_id"], "full").select(
        "printer_model_id", "am_material_id", F.coalesce("is_allowed", "by_rule").alias("is_allowed")
    )


def size_class(parts: DataFrame, classes: DataFrame, size: str) -> DataFrame:
    """Tolerance grades by size: lower bound excluded, upper included; beyond the table nulls.

    A few ordered bounds: one nested-loop join against a broadcast of the class table.
    """
    inside = (F.col(size) > F.col("size_min")) & (F.col(size) <= F.col("size_max"))
    return parts.join(classes, inside, "left")
