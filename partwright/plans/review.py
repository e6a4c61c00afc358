"""Review report of drawings: checks, findings with severities, summaries and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.functions import text as tx
from partwright.operators import matching as m
from partwright.sources.joins import lookup, settled
from partwright.sources.reference import load

# ---- fixed values ---------------------------------------------------------------------------
SEVERITY_LABELS = {"blocking": "Критично", "warning": "Внимание", "info": "Информация"}
NO_FINDINGS_TEXT = "Значимых замечаний по результатам сверки с НСИ не выявлено."
TITLE_COLUMNS = ["part_name", "designation", "material", "mass", "scale", "sheet_format"]
RANK_NO_DRAWING, RANK_MATERIAL, RANK_BLANK, RANK_UNRECOGNISED, RANK_NUMBERING, RANK_REFERENCE, RANK_SCALE, RANK_FIELD = range(8)
# ---------------------------------------------------------------------------------------------


def _scales(spark: SparkSession) -> DataFrame:
    return m.scale_requirements(m.enum_requirements(load(spark, "gost_clause"), load(spark, "gost_standard")))


@settled
def allowed_scales(spark: SparkSession) -> DataFrame:
    """Normalised allowed value to the first requirement that lists it."""
    return (
        _scales(spark).select("id", "standard_designation", "clause_number", F.explode("allowed").alias("value"))
        .groupBy(tx.normalize_scale(F.col("value")).alias("scale_key"))
        .agg(F.min_by(F.struct("standard_designation", "clause_number"), "id").alias("hit"))
    )


@settled
def check_rules(spark: SparkSession) -> DataFrame:
    """One row: the standard of the scale check and the title-block field rules by column."""
    fields = load(spark, "title_block_map").join(load(spark, "gost_title_block_field"), "field_number").join(
        load(spark, "gost_standard").select(F.col("id").alias("standard_id"), F.col("designation").alias("standard_designation")), "standard_id"
    )
    spec = F.struct("field_pos", "attr", "field_number", "required_paper", "standard_designation")
    return _scales(spark).groupBy().agg(F.min_by("standard_designation", "id").alias("scale_standard")).crossJoin(
        fields.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("attr", spec))).alias("fields"))
    )


def with_checks(spark: SparkSession, drawings: DataFrame) -> DataFrame:
    """Material and blank match plus a ``checks`` array (reference, scale, title-block fields), in one pass.

    Every join is a broadcast of a reference side, so drawings are read once and not shuffled.
    """
    out = m.match_blank(m.match_material(drawings, load(spark, "material")), load(spark, "workpiece_blank"))
    scale = F.when(F.col("scale") != "", F.col("scale"))
    out = lookup(out.withColumn("scale_key", tx.normalize_scale(scale)), allowed_scales(spark), "scale_key")
    out = out.crossJoin(F.broadcast(check_rules(spark)))  # one row
    material = F.col("material")
    filled_material = F.coalesce(tx.is_filled(material), F.lit(False))

    def check(rank: Column, code: Column, standard: Column, clause: Column, status: Column, actual: Column) -> Column:
        return F.struct(rank.alias("rank"), code.alias("check_code"), standard.alias("standard_designation"),
                        clause.alias("clause_number"), status.alias("status"), actual.alias("actual_value"))

    reference = check(
        F.lit(RANK_REFERENCE), F.lit("material_reference"), F.lit("ГОСТ Р 2.109-2023"), F.lit("6.3"),
        F.when(filled_material & tx.names_standard(material), m.PASSED).otherwise(m.REVIEW), F.when(filled_material, material),
    )
    in_scale = F.when(F.col("scale_standard").isNotNull(), check(
        F.lit(RANK_SCALE), F.lit("scale"), F.coalesce("hit.standard_designation", "scale_standard"),
        F.coalesce("hit.clause_number", F.lit("2")),
        F.when(scale.isNull(), m.REVIEW).when(F.col("hit").isNotNull(), m.PASSED).otherwise(m.VIOLATED), scale,
    ))

    def field_check(name: str) -> Column:
        value, f = F.col(name).cast("string"), F.try_element_at("fields", F.lit(name))
        filled = F.coalesce(tx.is_filled(value), F.lit(False))
        status = (
            F.when(filled, m.PASSED).when(f["required_paper"] == m.REQUIRED_MARK, m.VIOLATED)
            .when(f["required_paper"] == m.CONDITIONAL_MARK, m.REVIEW).otherwise(m.NOT_APPLICABLE)
        )
        return F.when(f.isNotNull(), check(
            RANK_FIELD + f["field_pos"] - 1, F.concat(F.lit("field_"), f["field_number"]), f["standard_designation"],
            f["field_number"], status, F.when(filled, value),
        ))

    checks = F.array_compact(F.array(reference, in_scale, *[field_check(c) for c in TITLE_COLUMNS]))
    return out.withColumn("checks", checks).drop("scale_key", "hit", "scale_standard", "fields")


def reported_checks(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of the checks without the ones that do not apply."""
    return checked.select(*keys, F.inline("checks")).where(F.col("status") != m.NOT_APPLICABLE)


def _finding(condition: Column, rank: int, severity: str, code: str, arg: Column) -> Column:
    return F.when(condition, F.struct(F.lit(rank).alias("rank"), F.lit(severity).alias("severity"),
                                      F.lit(code).alias("finding_code"), arg.cast("string").alias("arg")))


def _own_findings(checked: DataFrame) -> Column:
    """Array of the findings that need the row of a checked drawing alone."""
    has = F.coalesce(F.col("has_drawing"), F.lit(True)) if "has_drawing" in checked.columns else F.lit(True)
    material, blank = F.col("material_status"), F.col("blank_status")
    own = F.array_compact(F.array(
        _finding(material == m.NOT_FOUND, RANK_MATERIAL, "blocking", "material_not_found", F.when(F.col("material") != "", F.col("material"))),
        _finding(material == m.PARTIAL, RANK_MATERIAL, "warning", "material_partial", F.col("matched_grade")),
        _finding(blank == m.NOT_FOUND, RANK_BLANK, "warning", "blank_not_found", F.when(F.col("blank_designation") != "", F.col("blank_designation"))),
        _finding(blank == m.PARTIAL, RANK_BLANK, "info", "blank_partial", F.col("blank_reason")),
    ))
    raised = F.filter("checks", lambda c: c["status"].isin(m.VIOLATED, m.REVIEW))
    by_check = F.transform(raised, lambda c: F.struct(
        c["rank"].alias("rank"), F.when(c["status"] == m.VIOLATED, "warning").otherwise("info").alias("severity"),
        F.concat(c["check_code"], F.lit("_"), c["status"]).alias("finding_code"), c["actual_value"].alias("arg"),
    ))
    missing = F.array(_finding(F.lit(True), RANK_NO_DRAWING, "blocking", "no_drawing", F.lit(None)))
    return F.when(has, F.concat(own, by_check)).otherwise(missing)


def drawing_findings(spark: SparkSession, drawings: DataFrame, keys: list[str] = ["part_id"]) -> DataFrame:
    """Findings that need the drawing row alone; stateless, so the same plan serves batch and stream."""
    checked = with_checks(spark, drawings)
    return checked.select(*keys, F.inline(_own_findings(checked)))


def requirements_by_drawing(requirements: DataFrame) -> DataFrame:
    """One row per drawing with lines: ``lines`` in order with their category, and ``line_findings`` (unrecognised items,
    their numbers in one list, and broken numbering).

    The lines are shuffled once, as they come, and each is classified once behind the shuffle: a small table lies in one or
    two splits, and the patterns are most of the work.
    """
    dealt = requirements.repartition("part_id").withColumn("category", tx.requirement_category(F.col("text")))
    line = F.struct("number", "text", F.col("category").isNotNull().alias("is_recognized"), "category")
    grouped = dealt.groupBy("part_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"), m.first_bad_position().alias("bad"))
    numbers = F.transform(F.filter("l", lambda x: ~x["line"]["is_recognized"]), lambda x: F.struct(x["pos"].alias("p"), x["line"]["number"].cast("string").alias("t")))
    grouped = grouped.withColumn("n", F.array_sort(numbers))
    found = F.array_compact(F.array(
        _finding(F.size("n") > 0, RANK_UNRECOGNISED, "info", "requirements_unrecognised", F.array_join(F.transform("n", lambda x: x["t"]), ", ")),
        _finding(F.col("bad").isNotNull(), RANK_NUMBERING, "warning", "numbering_violated", F.col("bad")),
    ))
    return grouped.select("part_id", F.transform("l", lambda x: x["line"]).alias("lines"), found.alias("line_findings"))


def requirement_findings(requirements: DataFrame) -> DataFrame:
    """Findings from requirement lines: unrecognised items (their numbers in one list) and broken numbering."""
    return requirements_by_drawing(requirements).select("part_id", F.inline("line_findings"))


def review_findings(spark: SparkSession, drawings: DataFrame, requirements: DataFrame) -> DataFrame:
    """All findings; ``rank`` is the reporting order within a drawing."""
    return drawing_findings(spark, drawings.repartition("part_id")).unionByName(requirement_findings(requirements))


def _summary_line(severity: Column, code: Column) -> Column:
    label = F.coalesce(*[F.when(severity == k, F.lit(v)) for k, v in SEVERITY_LABELS.items()])
    return F.concat(label, F.lit(": "), code)


def summaries(drawings: DataFrame, findings: DataFrame) -> DataFrame:
    """One text per drawing: severity labels and finding codes in order, or the no-findings text.

    Each rank occurs once after the first aggregation, so the list per drawing is at most the number of checks.
    """
    once = findings.groupBy("part_id", "rank", "severity", "finding_code").agg(F.min("arg").alias("arg"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", _summary_line(F.col("severity"), F.col("finding_code")).alias("line"))))
    texts = once.groupBy("part_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["line"]), " ").alias("summary"),
        F.max((F.col("severity") == "blocking").cast("int")).alias("blocking"),
    )
    out = drawings.select("part_id").join(texts, "part_id", "left")
    return out.select("part_id", F.coalesce("summary", F.lit(NO_FINDINGS_TEXT)).alias("summary"),
                      (F.coalesce("blocking", F.lit(0)) > 0).alias("has_blocking"))


def status_counts(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Violated and needs-review counts per report."""
    return checks.groupBy(*keys).agg(
        F.count_if(F.col("status") == m.VIOLATED).alias("violated"), F.count_if(F.col("status") == m.REVIEW).alias("needs_review")
    )


def documents(spark: SparkSession, drawings: DataFrame, requirements: DataFrame) -> DataFrame:
    """One JSON document per drawing: material, blank, requirement lines, standard checks, findings, blocking flag and
    summary. Drawings meet the lists of their lines and are checked behind that one join, each once; findings and summary
    come from the arrays of the row."""
    checked = with_checks(spark, drawings.repartition("part_id").join(requirements_by_drawing(requirements), "part_id", "left"))
    own = checked.withColumn("own", _own_findings(checked))
    found = F.array_sort(F.concat("own", F.coalesce("line_findings", F.array().cast(own.schema["own"].dataType))))
    out = own.withColumn("found", found)
    texts = F.array_distinct(F.transform("found", lambda f: F.struct(f["rank"].alias("rank"), _summary_line(f["severity"], f["finding_code"]).alias("line"))))
    summary = F.array_join(F.transform(F.array_sort(texts), lambda r: r["line"]), " ")
    checks = F.transform("checks", lambda c: F.struct(
        c["check_code"].alias("code"), c["standard_designation"].alias("standard_designation"), c["clause_number"].alias("clause_number"),
        c["status"].alias("status"), c["actual_value"].alias("actual_value")))
    items = F.transform("found", lambda f: F.struct(f["severity"].alias("severity"), f["finding_code"].alias("code"), f["arg"].alias("arg")))
    body = F.struct(
        "part_id",
        F.struct(F.when(F.col("material") != "", F.col("material")).alias("from_drawing"), F.col("material_status").alias("status"), F.col("matched_grade").alias("matched_grade"), F.col("matched_standard").alias("matched_gost")).alias("material_check"),
        F.struct(F.when(F.col("blank_designation") != "", F.col("blank_designation")).alias("from_drawing"), F.col("blank_status").alias("status"), F.col("matched_blank").alias("matched_designation"), F.col("blank_reason").alias("note")).alias("blank_check"),
        F.coalesce("lines", F.array().cast(checked.schema["lines"].dataType)).alias("technical_requirement_checks"), checks.alias("gost_checks"),
        items.alias("findings"), F.exists("found", lambda f: f["severity"] == "blocking").alias("has_blocking_findings"),
        F.when(F.size("found") == 0, NO_FINDINGS_TEXT).otherwise(summary).alias("summary"),
    )
    return out.select("part_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
