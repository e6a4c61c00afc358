"""Matching of drawing texts to reference rows, and membership / completeness checks.

Every match is a join of the fact table with a reference side reduced to one row per key, so the
fact table is never shuffled and an OR of two keys needs no nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwright.functions import text as tx
from partwright.sources.joins import lookup

# ---- fixed values ---------------------------------------------------------------------------
DIAMETER_TOLERANCE_MM = 0.5
REQUIRED_MARK = "●"
CONDITIONAL_MARK = "○"
MATCHED, PARTIAL, NOT_FOUND = "matched", "partial_match", "not_found"
PASSED, VIOLATED, REVIEW, NOT_APPLICABLE = "passed", "violated", "needs_review", "not_applicable"
# ---------------------------------------------------------------------------------------------


def match_material(drawings: DataFrame, materials: DataFrame) -> DataFrame:
    """Exact = grade and standard on one row; else the first row by id sharing either; else none.

    Adds ``material_status``, ``matched_material_id``, ``matched_grade``, ``matched_standard``.
    """
    keyed = materials.select(
        "id", F.col("grade").alias("matched_grade"), F.col("gost_standard").alias("matched_standard"),
        tx.normalize_grade(F.col("grade")).alias("gk"),
        tx.standard_number(F.coalesce(F.col("gost_standard"), F.lit(""))).alias("sk"),
    )
    both = keyed.where("sk IS NOT NULL").groupBy("gk", "sk").agg(F.min("id").alias("exact_id"))
    by_grade = keyed.groupBy("gk").agg(F.min("id").alias("grade_id"))
    by_standard = keyed.where("sk IS NOT NULL").groupBy("sk").agg(F.min("id").alias("standard_id"))
    given = F.when(F.col("material") != "", F.col("material"))
    out = drawings.withColumn("gk", tx.grade_key(given)).withColumn("sk", tx.standard_number(given))
    out = lookup(lookup(lookup(out, both, ["gk", "sk"]), by_grade, "gk"), by_standard, "sk")
    out = out.withColumn("matched_material_id", F.coalesce("exact_id", F.least("grade_id", "standard_id")))
    named = keyed.select(F.col("id").alias("matched_material_id"), "matched_grade", "matched_standard")
    out = lookup(out, named, "matched_material_id")
    status = (
        F.when(F.col("exact_id").isNotNull(), MATCHED)
        .when(F.col("matched_material_id").isNotNull(), PARTIAL)
        .otherwise(NOT_FOUND)
    )
    return out.withColumn("material_status", status).drop("gk", "sk", "exact_id", "grade_id", "standard_id")


def match_material_group(drawings: DataFrame, materials: DataFrame) -> DataFrame:
    """Adds ``material_group_id`` by grade alone: the first row with the same normalised grade."""
    first = materials.groupBy(tx.normalize_grade(F.col("grade")).alias("gk")).agg(
        F.min_by("material_group_id", "id").alias("material_group_id")
    )
    given = F.when(F.col("material") != "", F.col("material"))
    return lookup(drawings.withColumn("gk", tx.grade_key(given)), first, "gk").drop("gk")


def match_blank(drawings: DataFrame, blanks: DataFrame, best: bool = False) -> DataFrame:
    """The first blank of the standard decides, even if a later one has the right size.

    ``best=True`` instead prefers a blank of the standard whose diameter fits.
    Adds ``blank_status``, ``matched_blank``, ``blank_reason``.
    """
    keyed = blanks.select(
        "id", tx.standard_number(F.coalesce(tx.standard_mention(F.col("designation")), F.lit(""))).alias("sk"),
        F.col("designation").alias("matched_blank"), F.col("diameter_mm").alias("ref_diameter"),
    ).where("sk IS NOT NULL")
    given = F.when(F.col("blank_designation") != "", F.col("blank_designation"))
    out = drawings.withColumn("sk", tx.standard_number(given)).withColumn("dd", tx.blank_diameter(given))
    whole = F.struct("matched_blank", "ref_diameter")
    if best:
        options = keyed.groupBy("sk").agg(F.sort_array(F.collect_list(F.struct("id", "matched_blank", "ref_diameter"))).alias("o"))
        out = lookup(out, options, "sk")
        fits = F.filter("o", lambda b: F.abs(F.col("dd") - b["ref_diameter"]) < DIAMETER_TOLERANCE_MM)
        out = out.withColumn("b", F.coalesce(F.get(fits, 0), F.get(F.col("o"), 0))).select("*", "b.matched_blank", "b.ref_diameter")
        out = out.drop("b", "o")
    else:
        first = keyed.groupBy("sk").agg(F.min_by(whole, F.col("id")).alias("b")).select("sk", "b.*")
        out = lookup(out, first, "sk")
    sized = F.col("dd").isNotNull() & F.col("ref_diameter").isNotNull()
    near = sized & (F.abs(F.col("dd") - F.col("ref_diameter")) < DIAMETER_TOLERANCE_MM)
    status = F.when(F.col("matched_blank").isNull(), NOT_FOUND).when(near, MATCHED).otherwise(PARTIAL)
    reason = F.when(F.col("matched_blank").isNotNull() & ~near, F.when(sized, "diameter_differs").otherwise("size_missing"))
    return (
        out.withColumn("blank_status", status).withColumn("blank_reason", reason)
        .withColumnRenamed("dd", "drawing_diameter").drop("sk", "ref_diameter")
    )


def enum_requirements(clauses: DataFrame, standards: DataFrame) -> DataFrame:
    """Closed lists of allowed values with the standard they come from."""
    chosen = clauses.where("requirement_type = 'ENUM_CHOICE' AND allowed_values IS NOT NULL")
    return chosen.join(
        standards.select(F.col("id").alias("standard_id"), F.col("designation").alias("standard_designation")),
        "standard_id",
    ).select("id", "standard_designation", "clause_number", "parameter_name", tx.split_values(F.col("allowed_values")).alias("allowed"))


def numeric_requirements(clauses: DataFrame, standards: DataFrame) -> DataFrame:
    chosen = clauses.where("requirement_type = 'NUMERIC_LIMIT' AND comparison_op IS NOT NULL")
    return chosen.join(
        standards.select(F.col("id").alias("standard_id"), F.col("designation").alias("standard_designation")),
        "standard_id",
    ).select("id", "standard_designation", "clause_number", "parameter_name", "comparison_op", "limit_min", "limit_max")


def scale_requirements(requirements: DataFrame) -> DataFrame:
    return requirements.where(F.lower("parameter_name").contains("масштаб"))


def check_scale(drawings: DataFrame, requirements: DataFrame) -> DataFrame:
    """Membership of the scale in any allowed row; the first requirement by id wins.

    No configured requirement gives no check rows at all: an absent check is not a passed one.
    """
    scales = scale_requirements(requirements)
    allowed = (
        scales.select("id", "standard_designation", "clause_number", "parameter_name", F.explode("allowed").alias("value"))
        .groupBy(tx.normalize_scale(F.col("value")).alias("scale_key"))
        .agg(F.min_by(F.struct("standard_designation", "clause_number", "parameter_name"), "id").alias("hit"))
    )
    head = scales.groupBy().agg(F.min_by("standard_designation", "id").alias("default_standard"))
    configured = head.where("default_standard IS NOT NULL")
    given = F.when(F.col("scale") != "", F.col("scale"))
    out = lookup(drawings.withColumn("scale_key", tx.normalize_scale(given)), allowed, "scale_key")
    out = out.crossJoin(F.broadcast(configured))  # one row by construction: a global aggregate
    status = F.when(given.isNull(), REVIEW).when(F.col("hit").isNotNull(), PASSED).otherwise(VIOLATED)
    return out.select(
        "part_id", F.lit("scale").alias("check_code"),
        F.coalesce("hit.standard_designation", "default_standard").alias("standard_designation"),
        F.coalesce("hit.clause_number", F.lit("2")).alias("clause_number"),
        status.alias("status"), given.alias("actual_value"),
    )


def check_title_block(drawings: DataFrame, fields: DataFrame, standards: DataFrame, field_map: DataFrame) -> DataFrame:
    """One row per drawing and mapped field that the standard specifies."""
    names = standards.select(F.col("id").alias("standard_id"), F.col("designation").alias("standard_designation"))
    spec = field_map.join(fields, "field_number").join(names, "standard_id").select(
        "field_pos", "attr", "field_number", "required_paper", "standard_designation"
    )
    columns = ["part_name", "designation", "material", "mass", "scale", "sheet_format"]
    long = drawings.select("part_id", *columns).unpivot("part_id", columns, "attr", "value")
    out = lookup(long, spec, "attr", "inner")
    filled = tx.is_filled(F.col("value"))
    status = (
        F.when(filled, PASSED)
        .when(F.col("required_paper") == REQUIRED_MARK, VIOLATED)
        .when(F.col("required_paper") == CONDITIONAL_MARK, REVIEW)
        .otherwise(NOT_APPLICABLE)
    )
    return out.select(
        "part_id", F.concat(F.lit("field_"), F.col("field_number")).alias("check_code"), "standard_designation",
        F.col("field_number").alias("clause_number"), status.alias("status"),
        F.when(filled, F.col("value")).alias("actual_value"), "field_pos",
    )


def first_bad_position() -> Column:
    """Aggregate: the first list position whose item number differs from it, null if there is none."""
    return F.min(F.when(F.col("number") != F.col("pos"), F.col("pos")))


def check_numbering(requirements: DataFrame) -> DataFrame:
    """Item numbers must be 1..n in listed order; drawings without items give no row.

    The list position is a column, so this is one aggregate with map-side combine.
    """
    return requirements.groupBy("part_id").agg(F.count(F.lit(1)).alias("items"), first_bad_position().alias("first_bad_pos")).select(
        "part_id", F.lit("numbering").alias("check_code"), F.lit("ГОСТ Р 2.316-2023").alias("standard_designation"),
        F.lit("6.6").alias("clause_number"),
        F.when(F.col("first_bad_pos").isNull(), PASSED).otherwise(VIOLATED).alias("status"), "items", "first_bad_pos",
    )


def check_material_reference(drawings: DataFrame) -> DataFrame:
    material = F.col("material")
    filled = F.coalesce(tx.is_filled(material), F.lit(False))
    return drawings.select(
        "part_id", F.lit("material_reference").alias("check_code"), F.lit("ГОСТ Р 2.109-2023").alias("standard_designation"),
        F.lit("6.3").alias("clause_number"),
        F.when(filled & tx.names_standard(material), PASSED).otherwise(REVIEW).alias("status"),
        F.when(filled, material).alias("actual_value"),
    )


def limit_status(value: Column, op: Column, low: Column, high: Column) -> Column:
    """Evaluate a measured value against a numeric limit; an absent bound falls back to the other."""
    bound = F.coalesce(high, low)
    floor = F.coalesce(low, high)
    holds = (
        F.when(op == "<=", value <= bound).when(op == "<", value < bound).when(op == "=", value == floor)
        .when(op == ">=", value >= floor).when(op == ">", value > floor)
        .when(op == "BETWEEN", (value >= low) & (value <= high))
    )
    return F.when(value.isNull() | holds.isNull(), REVIEW).when(holds, PASSED).otherwise(VIOLATED)
