"""Matching and checking of drawings against reference tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwright.bindings import facts
from partwright.bindings import sqlfrag as q
from partwright.bindings.spec import FACT_SQL, REGISTRY
from partwright.operators import matching as m
from partwright.sources.reference import load

add = REGISTRY.add

FACT_SQL["material_match"] = f"""
SELECT part_id, material_status, matched_material_id, r.grade AS matched_grade, r.gost_standard AS matched_standard FROM (
  SELECT part_id,
    CASE WHEN min(CASE WHEN gm AND sm THEN id END) IS NOT NULL THEN 'matched'
         WHEN min(CASE WHEN gm OR sm THEN id END) IS NOT NULL THEN 'partial_match' ELSE 'not_found' END AS material_status,
    coalesce(min(CASE WHEN gm AND sm THEN id END), min(CASE WHEN gm OR sm THEN id END)) AS matched_material_id
  FROM (SELECT part_id, k.id, coalesce({q.grade_key("nullif(d.material, '')")} = k.gk, FALSE) AS gm,
               coalesce({q.number("nullif(d.material, '')")} = k.sk, FALSE) AS sm
        FROM drawings d CROSS JOIN (SELECT id, {q.normalize_grade('grade')} AS gk, {q.number('gost_standard')} AS sk FROM material) k)
  GROUP BY part_id) x LEFT JOIN material r ON r.id = x.matched_material_id"""

FACT_SQL["blank_match"] = f"""
SELECT part_id, CASE WHEN b.id IS NULL THEN 'not_found' WHEN abs(dd - b.diameter_mm) < 0.5 THEN 'matched'
   ELSE 'partial_match' END AS blank_status, b.designation AS matched_blank,
   CASE WHEN b.id IS NULL OR coalesce(abs(dd - b.diameter_mm) < 0.5, FALSE) THEN NULL
        WHEN dd IS NOT NULL AND b.diameter_mm IS NOT NULL THEN 'diameter_differs' ELSE 'size_missing' END AS blank_reason,
   dd AS drawing_diameter
FROM (SELECT part_id, {q.number("nullif(blank_designation, '')")} AS sk,
             {q.blank_diameter("nullif(blank_designation, '')")} AS dd FROM drawings) d
LEFT JOIN (SELECT *, {q.number(q.mention('designation'))} AS sk FROM workpiece_blank
           WHERE id IN (SELECT min(id) FROM workpiece_blank GROUP BY {q.number(q.mention('designation'))})) b ON b.sk = d.sk"""

SCALE_LIST = (
    "SELECT c.id, s.designation AS standard_designation, c.clause_number, c.parameter_name,"
    f" {q.strip('v')} AS value FROM (SELECT *, unnest(string_split(allowed_values, ';')) AS v FROM gost_clause"
    " WHERE requirement_type = 'ENUM_CHOICE' AND allowed_values IS NOT NULL) c JOIN gost_standard s ON s.id = c.standard_id"
    " WHERE contains(lower(c.parameter_name), 'масштаб')"
)
FACT_SQL["scale_check"] = f"""
SELECT part_id, 'scale' AS check_code, coalesce(h.standard_designation, 'ГОСТ 2.302-1968') AS standard_designation,
  coalesce(h.clause_number, '2') AS clause_number,
  CASE WHEN coalesce(scale, '') = '' THEN 'needs_review' WHEN h.id IS NOT NULL THEN 'passed' ELSE 'violated' END AS status,
  nullif(scale, '') AS actual_value
FROM drawings d LEFT JOIN (SELECT DISTINCT ON ({q.scale('value')}) {q.scale('value')} AS sk, * FROM ({SCALE_LIST})
   ORDER BY {q.scale('value')}, id) h ON h.sk = {q.scale("nullif(d.scale, '')")}"""

FACT_SQL["title_check"] = f"""
SELECT part_id, 'field_' || f.field_number AS check_code, s.designation AS standard_designation, f.field_number AS clause_number,
  CASE WHEN {q.filled('value')} THEN 'passed' WHEN f.required_paper = '●' THEN 'violated'
       WHEN f.required_paper = '○' THEN 'needs_review' ELSE 'not_applicable' END AS status,
  CASE WHEN {q.filled('value')} THEN value END AS actual_value, t.field_pos
FROM (SELECT part_id, t.attr, t.field_number, t.field_pos, CASE t.attr WHEN 'part_name' THEN d.part_name
        WHEN 'designation' THEN d.designation WHEN 'material' THEN d.material WHEN 'mass' THEN d.mass
        WHEN 'scale' THEN d.scale ELSE d.sheet_format END AS value FROM drawings d CROSS JOIN title_block_map t) t
JOIN gost_title_block_field f ON f.field_number = t.field_number
JOIN gost_standard s ON s.id = f.standard_id"""

FACT_SQL["numbering_check"] = """
SELECT part_id, 'numbering' AS check_code, 'ГОСТ Р 2.316-2023' AS standard_designation, '6.6' AS clause_number,
  CASE WHEN bool_and(number = rn) THEN 'passed' ELSE 'violated' END AS status, count(*) AS items,
  CAST(min(CASE WHEN number <> rn THEN rn END) AS INT) AS first_bad_pos
FROM (SELECT part_id, number, row_number() OVER (PARTITION BY part_id ORDER BY pos) AS rn FROM tech_requirements) GROUP BY part_id"""

FACT_SQL["reference_check"] = f"""
SELECT part_id, 'material_reference' AS check_code, 'ГОСТ Р 2.109-2023' AS standard_designation, '6.3' AS clause_number,
  CASE WHEN {q.filled('material')} AND {q.standard_reference('material')} THEN 'passed' ELSE 'needs_review' END AS status,
  CASE WHEN {q.filled('material')} THEN material END AS actual_value FROM drawings"""

MATCH_COLUMNS = ["part_id", "material_status", "matched_material_id", "matched_grade", "matched_standard"]
BLANK_COLUMNS = ["part_id", "blank_status", "matched_blank", "blank_reason", "drawing_diameter"]


def material_match(spark, d):
    return m.match_material(facts.drawings(spark, d), load(spark, "material")).select(MATCH_COLUMNS)


@add("j10_material_match", "SELECT * FROM material_match")
def _(spark, d):
    return material_match(spark, d)


@add("j10_material_match_counts", "SELECT material_status, count(*) AS parts FROM material_match GROUP BY material_status")
def material_match_counts(spark, d):
    return material_match(spark, d).groupBy("material_status").agg(F.count(F.lit(1)).alias("parts"))


@add(
    "j11_material_group",
    f"SELECT part_id, (SELECT arg_min(material_group_id, id) FROM material r WHERE {q.normalize_grade('r.grade')} ="
    f""" {q.grade_key("nullif(d.material, '')")}) AS material_group_id FROM drawings d""",
)
def _(spark, d):
    out = m.match_material_group(facts.drawings(spark, d), load(spark, "material"))
    return out.select("part_id", "material_group_id")


@add("j12_blank_match", "SELECT * FROM blank_match")
def _(spark, d):
    return m.match_blank(facts.drawings(spark, d), load(spark, "workpiece_blank")).select(BLANK_COLUMNS)


def requirements(spark):
    return m.enum_requirements(load(spark, "gost_clause"), load(spark, "gost_standard"))


def scale_check(spark, d):
    return m.check_scale(facts.drawings(spark, d), requirements(spark))


def title_check(spark, d):
    return m.check_title_block(
        facts.drawings(spark, d), load(spark, "gost_title_block_field"), load(spark, "gost_standard"), load(spark, "title_block_map")
    )


@add("j15_scale_membership", "SELECT * FROM scale_check")
def _(spark, d):
    return scale_check(spark, d)


@add("j16_title_block_completeness", "SELECT * FROM title_check")
def _(spark, d):
    return title_check(spark, d)


@add("w4_numbering_continuity", "SELECT * FROM numbering_check")
def _(spark, d):
    return m.check_numbering(facts.tech_requirements(spark, d))


@add("h9_standard_reference", "SELECT * FROM reference_check")
def _(spark, d):
    return m.check_material_reference(facts.drawings(spark, d))


@add(
    "f8_enum_requirement_hits",
    f"""SELECT id, standard_designation, clause_number, count(part_id) AS drawings FROM ({SCALE_LIST}) l
    LEFT JOIN drawings d ON {q.scale("d.scale")} = {q.scale('l.value')} GROUP BY ALL""",
)
def _(spark, d):
    from partwright.functions import text as tx

    listed = requirements(spark).select("id", "standard_designation", "clause_number", F.explode("allowed").alias("v"))
    listed = listed.withColumn("k", tx.normalize_scale(F.col("v")))
    used = facts.drawings(spark, d).groupBy(tx.normalize_scale(F.col("scale")).alias("k")).count()
    return listed.join(used, "k", "left").groupBy("id", "standard_designation", "clause_number").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("drawings")
    )


MEASURED = "SELECT p_partkey AS part_id, CAST(8 + p_partkey % 7 AS BIGINT) AS clause_id, p_size * 4e0 / 1e0 AS value FROM part"


@add(
    "f9_numeric_requirements",
    f"""SELECT c.id, s.designation AS standard_designation, c.clause_number, c.comparison_op, c.limit_min, c.limit_max,
    count(x.part_id) AS measured FROM gost_clause c JOIN gost_standard s ON s.id = c.standard_id
    LEFT JOIN ({MEASURED}) x ON x.clause_id = c.id
    WHERE c.requirement_type = 'NUMERIC_LIMIT' AND c.comparison_op IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    limits = m.numeric_requirements(load(spark, "gost_clause"), load(spark, "gost_standard"))
    counts = measured(spark, d).groupBy(F.col("clause_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return limits.join(counts, "id", "left").select(
        "id", "standard_designation", "clause_number", "comparison_op", "limit_min", "limit_max",
        F.coalesce("n", F.lit(0)).alias("measured"),
    )


def measured(spark, d):
    key = F.col("p_partkey")
    return facts.read(spark, d, "part").select(
        key.alias("part_id"), (8 + key % 7).alias("clause_id"), (F.col("p_size") * 4.0).alias("value")
    )


@add(
    "x5_numeric_limit",
    f"""SELECT part_id, clause_number, value, CASE WHEN CASE comparison_op WHEN '<=' THEN value <= coalesce(limit_max, limit_min)
      WHEN '>=' THEN value >= coalesce(limit_min, limit_max) WHEN 'BETWEEN' THEN value BETWEEN limit_min AND limit_max END
      THEN 'passed' ELSE 'violated' END AS status
    FROM ({MEASURED}) x JOIN gost_clause c ON c.id = x.clause_id WHERE c.requirement_type = 'NUMERIC_LIMIT'""",
)
def _(spark, d):
    from partwright.sources.joins import lookup

    limits = m.numeric_requirements(load(spark, "gost_clause"), load(spark, "gost_standard")).withColumnRenamed("id", "clause_id")
    out = lookup(measured(spark, d), limits, "clause_id", "inner")
    status = m.limit_status(F.col("value"), F.col("comparison_op"), F.col("limit_min"), F.col("limit_max"))
    return out.select("part_id", "clause_number", "value", status.alias("status"))


@add(
    "f10_title_block_fields",
    """SELECT f.field_number, s.designation AS standard_designation, f.required_paper, count(d.part_id) AS drawings
    FROM gost_title_block_field f JOIN gost_standard s ON s.id = f.standard_id JOIN title_block_map t USING (field_number)
    LEFT JOIN drawings d ON CASE t.attr WHEN 'part_name' THEN d.part_name WHEN 'designation' THEN d.designation
      WHEN 'material' THEN d.material WHEN 'mass' THEN d.mass WHEN 'scale' THEN d.scale ELSE d.sheet_format END IS NOT NULL
    GROUP BY ALL""",
)
def _(spark, d):
    checks = title_check(spark, d).select("part_id", F.col("clause_number").alias("field_number"))
    columns = ["part_name", "designation", "material", "mass", "scale", "sheet_format"]
    present = facts.drawings(spark, d).select([F.count(c).alias(c) for c in columns]).unpivot([], columns, "attr", "drawings")
    fields = load(spark, "gost_title_block_field").join(load(spark, "title_block_map"), "field_number")
    names = load(spark, "gost_standard").select(F.col("id").alias("standard_id"), F.col("designation").alias("standard_designation"))
    del checks
    return fields.join(names, "standard_id").join(present, "attr").select(
        "field_number", "standard_designation", "required_paper", "drawings"
    )


@add(
    "u8_allowed_values",
    f"""SELECT d.part_id, string_agg(DISTINCT l.value, '; ' ORDER BY l.value) AS expected FROM scale_check d CROSS JOIN ({SCALE_LIST}) l
    WHERE d.status = 'violated' GROUP BY d.part_id""",
)
def _(spark, d):
    allowed = m.scale_requirements(requirements(spark)).groupBy().agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("allowed")))), "; ").alias("expected")
    )
    bad = scale_check(spark, d).where("status = 'violated'").select("part_id")
    return bad.crossJoin(F.broadcast(allowed))  # one row by construction: a global aggregate of the reference
