"""Compliance registry: one row per requirement with a status, from all planning and review results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.functions import text as tx
from partwright.operators import matching as m
from partwright.plans import printing, review, route

# ---- fixed values ---------------------------------------------------------------------------
STATUSES = ["ok", "not_ok", "partial", "unchecked"]
NONE_TEXT = "—"
# ---------------------------------------------------------------------------------------------


def _by_match(status: Column) -> Column:
    return F.when(status == m.MATCHED, "ok").when(status == m.PARTIAL, "partial").otherwise("not_ok")


def _row(row_id, registry, doc, status) -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return ["part_id", lit(row_id).alias("row_id"), lit(registry).alias("registry"),
            F.coalesce(F.when(doc != "", doc), F.lit(NONE_TEXT)).alias("project_doc"), lit(status).alias("status")]


def metal_registry(spark: SparkSession, drawings: DataFrame, requirements: DataFrame) -> DataFrame:
    """Five sources: material, blank, standard checks, requirement lines and planned operations."""
    checked = review.with_checks(spark, drawings)
    matches = F.array(
        F.struct(F.lit("material").alias("row_id"), F.lit("materials").alias("registry"), F.col("material").alias("doc"),
                 _by_match(F.col("material_status")).alias("status")),
        F.struct(F.lit("blank").alias("row_id"), F.lit("blanks").alias("registry"), F.col("blank_designation").alias("doc"),
                 _by_match(F.col("blank_status")).alias("status")),
    )
    standard = F.transform(F.filter("checks", lambda c: c["status"] != m.NOT_APPLICABLE), lambda c: F.struct(
        F.concat(F.lit("check-"), c["check_code"]).alias("row_id"), F.concat(F.lit("standard "), c["standard_designation"]).alias("registry"),
        c["actual_value"].alias("doc"),
        F.when(c["status"] == m.PASSED, "ok").when(c["status"] == m.VIOLATED, "not_ok").otherwise("partial").alias("status"),
    ))
    from_drawing = checked.select("part_id", F.inline(F.concat(matches, standard))).select(
        *_row(F.col("row_id"), F.col("registry"), F.col("doc"), F.col("status"))
    )
    numbering = m.check_numbering(requirements).select(*_row(
        "check-numbering", F.concat(F.lit("standard "), F.col("standard_designation")), F.col("items").cast("string"),
        F.when(F.col("status") == m.PASSED, "ok").otherwise("not_ok"),
    ))
    category = tx.requirement_category(F.col("text"))
    lines = requirements.select(*_row(
        F.concat(F.lit("requirement-"), F.col("pos").cast("string")), "requirements", category,
        F.when(category.isNotNull(), "ok").otherwise("unchecked"),
    ))
    operations = route.route_operations(spark, drawings).select(*_row(
        F.concat(F.lit("operation-"), F.col("sequence_no").cast("string")), "equipment", F.col("model_name"),
        F.when(F.col("model_name").isNotNull(), "ok").otherwise("not_ok"),
    ))
    return from_drawing.unionByName(numbering).unionByName(lines).unionByName(operations)


def print_registry(plans: DataFrame) -> DataFrame:
    """Seven conditional sources from print plans that carry their chosen recommendation."""
    c = F.col

    def row(condition: Column, row_id: str, registry: str, doc: Column, status: Column | str) -> Column:
        value = F.lit(status) if isinstance(status, str) else status
        return F.when(condition, F.struct(F.lit(row_id).alias("row_id"), F.lit(registry).alias("registry"),
                                          doc.cast("string").alias("doc"), value.alias("status")))

    profile = c("trade_name").isNotNull()
    fixed = F.array_compact(F.array(
        row(c("rule_id").isNotNull(), "recommendation", "recommendation", F.concat_ws(" · ", "material_group_code", "am_technology_code"), "ok"),
        row(F.lit(True), "printer", "equipment", c("printer_model_name"), F.when(c("printer_model_name").isNotNull(), "ok").otherwise("not_ok")),
        row(F.lit(True), "temperature", "print parameters", F.coalesce("trade_name", "material_group_code"), F.when(profile, "ok").otherwise("not_ok")),
        row(profile & (c("requires_heated_chamber") | c("requires_dry_storage")), "special", "print parameters", c("trade_name"), "partial"),
        row(c("min_infill").isNotNull() | c("wall_count").isNotNull(), "infill", "print parameters", c("material_group_code"), "ok"),
        row(c("tolerance_mm").isNotNull(), "quality", "technology tolerances",
            F.concat(F.lit("допуск "), c("tolerance_mm"), F.lit(", стенка "), c("wall_mm")), "ok"),
    ))
    own = plans.select("part_id", F.inline(fixed)).select(*_row(c("row_id"), c("registry"), c("doc"), c("status")))
    warned = printing.print_warnings(plans).select(*_row(
        F.concat(F.lit("warning-"), c("warning_no").cast("string")), "planning remarks", c("warning_code"), "not_ok"
    ))
    return own.unionByName(warned)


def count_by_status(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rounded percentages; all four statuses are kept, with 0 where a key has none."""
    counted = rows.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    total = sum((F.col(s) for s in STATUSES[1:]), F.col(STATUSES[0]))
    counted = counted.withColumn("total", total)
    long = counted.unpivot([*keys, "total"], STATUSES, "status", "rows")
    percent = F.when(F.col("total") > 0, F.floor(F.col("rows") / F.col("total") * 100 + 0.5)).otherwise(0).cast("bigint")
    return long.select(*keys, "status", "rows", percent.alias("percent"))


def filter_rows(rows: DataFrame, status: str | None = None, registry: str | None = None, search: str | None = None) -> DataFrame:
    """Status and registry equality and a case-insensitive substring over the text columns."""
    out = rows
    if status is not None:
        out = out.where(F.col("status") == status)
    if registry is not None:
        out = out.where(F.col("registry") == registry)
    if search:
        out = out.where(F.lower(F.concat_ws(" ", "row_id", "project_doc", "registry")).contains(search.lower()))
    return out


def registries(rows: DataFrame) -> DataFrame:
    return rows.select("registry").distinct()


