"""Route planning over all drawings."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwright.bindings import facts
from partwright.bindings import sqlfrag as q
from partwright.bindings.spec import FACT_SQL, REGISTRY
from partwright.functions import text as tx
from partwright.plans import route
from partwright.sources.joins import lookup, settle
from partwright.sources.reference import load

add = REGISTRY.add

FACT_SQL["part_group"] = f"""
SELECT d.*, g.material_group_id, {q.profile_diameter("nullif(blank_designation, '')")} AS blank_diameter FROM drawings d
LEFT JOIN (SELECT {q.normalize_grade('grade')} AS gk, arg_min(material_group_id, id) AS material_group_id FROM material GROUP BY 1) g
  ON g.gk = {q.grade_key("nullif(d.material, '')")}"""

FACT_SQL["group_equipment"] = """
SELECT DISTINCT mg.material_group_id, e.id AS equipment_type_id, e.code AS equipment_code, e.name AS equipment_name
FROM equipment_type e JOIN equipment_type_material_group mg ON mg.equipment_type_id = e.id
JOIN equipment_type_workpiece_type w ON w.equipment_type_id = e.id JOIN workpiece_type t ON t.id = w.workpiece_type_id
WHERE t.code = 'ROLLED_BAR'"""

FACT_SQL["group_operation"] = """
SELECT g.material_group_id, o.id AS operation_type_id, o.code AS op_code, o.name AS op_name, min(g.equipment_type_id) AS equipment_type_id
FROM group_equipment g JOIN equipment_type_operation_type x ON x.equipment_type_id = g.equipment_type_id
JOIN operation_type o ON o.id = x.operation_type_id GROUP BY ALL"""

FACT_SQL["group_route"] = """
SELECT g.*, 5 * row_number() OVER (PARTITION BY g.material_group_id ORDER BY r.op_rank) AS sequence_no,
  m.model_name, m.spindle_min, m.spindle_max,
  (SELECT string_agg(t.name, ', ' ORDER BY t.id) FROM operation_type_tooling_type x JOIN tooling_type t ON t.id = x.tooling_type_id
   WHERE x.operation_type_id = g.operation_type_id) AS tooling,
  f.tool_life_min, f.cv, f.m, f.xv, f.yv, s.feed_min, s.feed_max, s.depth_min, s.depth_max, mg.machinability_index AS kv
FROM group_operation g JOIN operation_order r ON r.op_code = g.op_code
LEFT JOIN equipment_model m ON m.id = (SELECT min(id) FROM equipment_model y WHERE y.equipment_type_id = g.equipment_type_id)
LEFT JOIN cutting_mode_formula f ON f.id = (SELECT min(id) FROM cutting_mode_formula y WHERE y.operation_type_id = g.operation_type_id)
LEFT JOIN feed_reference s ON s.operation_type_id = g.operation_type_id AND s.material_group_id = g.material_group_id
LEFT JOIN material_group mg ON mg.id = g.material_group_id"""

FACT_SQL["route_ops"] = """
SELECT part_id, sequence_no, op_code, op_name, model_name, tooling, reason_code,
  CASE WHEN reason_code IS NULL THEN CAST(printf('%.1f', CASE WHEN lim THEN pi() * d * n / 1000 ELSE v END) AS DOUBLE) END AS cutting_speed_m_min,
  CASE WHEN reason_code IS NULL THEN CAST(round_even(n, 0) AS BIGINT) END AS spindle_speed_rpm,
  CASE WHEN reason_code IS NULL THEN CAST(printf('%.3f', feed) AS DOUBLE) END AS feed_mm_rev,
  CASE WHEN reason_code IS NULL THEN CAST(printf('%.2f', depth) AS DOUBLE) END AS depth_of_cut_mm
FROM (SELECT *, CASE WHEN lim THEN greatest(spindle_min, least(spindle_max, 1000 * v / (pi() * d))) ELSE 1000 * v / (pi() * d) END AS n
FROM (SELECT *, cv / (pow(tool_life_min, m) * pow(depth, xv) * pow(feed, yv)) * coalesce(kv, 1) AS v,
  CASE WHEN d IS NULL THEN 'no_diameter' WHEN cv IS NULL THEN 'no_formula' WHEN feed IS NULL THEN 'no_feed'
       WHEN depth IS NULL THEN 'no_depth' END AS reason_code, spindle_min IS NOT NULL AND spindle_max IS NOT NULL AS lim
FROM (SELECT p.part_id, p.blank_diameter AS d, r.*, (feed_min + feed_max) / 2 AS feed,
  CASE WHEN op_code = 'DRILL' THEN p.blank_diameter / 2 ELSE (depth_min + depth_max) / 2 END AS depth
  FROM part_group p JOIN group_route r ON r.material_group_id = p.material_group_id)))"""

FACT_SQL["route_warn"] = """
SELECT part_id, CAST(row_number() OVER (PARTITION BY part_id ORDER BY ord) AS INT) AS warning_no, warning_code, arg FROM (
SELECT part_id, 1 AS ord, 'no_material' AS warning_code, NULL AS arg FROM part_group WHERE coalesce(material, '') = ''
UNION ALL SELECT part_id, 2, 'unknown_material', material FROM part_group WHERE coalesce(material, '') <> '' AND material_group_id IS NULL
UNION ALL SELECT part_id, 3, 'no_machine', material FROM part_group WHERE material_group_id IS NOT NULL
  AND material_group_id NOT IN (SELECT material_group_id FROM group_equipment)
UNION ALL SELECT part_id, 4, 'no_diameter', blank_designation FROM part_group WHERE blank_diameter IS NULL
  AND coalesce(blank_designation, '') <> '' AND material_group_id IN (SELECT material_group_id FROM group_equipment)
UNION ALL SELECT part_id, 5, 'no_model', op_code FROM part_group JOIN group_route USING (material_group_id) WHERE model_name IS NULL
UNION ALL SELECT part_id, 6, 'no_operation', NULL FROM part_group WHERE material_group_id IN (SELECT material_group_id FROM group_equipment)
  AND material_group_id NOT IN (SELECT material_group_id FROM group_route))"""

FACT_SQL["group_requirement"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY material_group_id ORDER BY part_no, id) AS INT) AS line_no FROM (
SELECT g.material_group_id, 1 AS part_no, r.id, r.formulation AS text, r.reference_standard
FROM (SELECT DISTINCT material_group_id FROM group_route) g JOIN machining_requirement_template r
  ON r.operation_type_id IS NULL OR r.operation_type_id IN (SELECT operation_type_id FROM group_route y WHERE y.material_group_id = g.material_group_id)
UNION ALL SELECT g.material_group_id, 2, h.id, h.method_name || CASE WHEN coalesce(h.applicable_to, '') <> '' THEN ' (' || h.applicable_to || ')'
  ELSE '' END || ' — ' || h.reference_instruction, h.reference_instruction
FROM (SELECT DISTINCT material_group_id FROM group_route) g JOIN surface_hardening_method h
  ON h.material_group_id IS NULL OR h.material_group_id = g.material_group_id)"""

OP_COLUMNS = [
    "part_id", "sequence_no", "op_code", "op_name", "model_name", "tooling", "reason_code", "cutting_speed_m_min",
    "spindle_speed_rpm", "feed_mm_rev", "depth_of_cut_mm",
]


def operations(spark, d):
    ops = route.route_operations(spark, facts.drawings(spark, d))
    return ops.withColumn("sequence_no", F.col("sequence_no").cast("bigint")).select(OP_COLUMNS)


def grouped(spark, d):
    return route.drawings_with_group(spark, facts.drawings(spark, d))


@add("p2_route_plan", "SELECT * FROM route_ops")
def _(spark, d):
    return operations(spark, d)


@add("h17_cutting_mode", "SELECT part_id, op_code, reason_code, cutting_speed_m_min, spindle_speed_rpm, feed_mm_rev, depth_of_cut_mm FROM route_ops")
def _(spark, d):
    return operations(spark, d).drop("sequence_no", "op_name", "model_name", "tooling")


@add("p2_route_warnings", "SELECT * FROM route_warn")
def route_warnings(spark, d):
    return route.route_warnings(spark, facts.drawings(spark, d))


@add("u1_requirement_lines", "SELECT part_id, line_no, text, reference_standard FROM part_group JOIN group_requirement USING (material_group_id)")
def _(spark, d):
    return route.route_requirements(spark, facts.drawings(spark, d)).select("part_id", "line_no", "text", "reference_standard")


@add(
    "h28_requirement_text",
    """SELECT part_id, line_no, CASE WHEN coalesce(reference_standard, '') <> '' AND NOT contains(text, reference_standard)
    THEN text || ' (' || reference_standard || ')' ELSE text END AS text FROM part_group JOIN group_requirement USING (material_group_id)""",
)
def _(spark, d):
    lines = route.route_requirements(spark, facts.drawings(spark, d))
    return lines.select("part_id", "line_no", tx.requirement_with_standard(F.col("text"), F.col("reference_standard")).alias("text"))


@add(
    "f6_requirements_null_applies_to_all",
    """SELECT DISTINCT part_id, r.code FROM part_group JOIN group_route g USING (material_group_id)
    JOIN machining_requirement_template r ON r.operation_type_id IS NULL OR r.operation_type_id = g.operation_type_id""",
)
def _(spark, d):
    codes = load(spark, "machining_requirement_template").select("id", "code")
    template = settle(route.requirement_template(spark).where("part = 1").join(codes, "id").select("material_group_id", "code"))
    return lookup(grouped(spark, d), template, "material_group_id", "inner").select("part_id", "code")


@add(
    "f7_hardening_null_applies_to_all",
    """SELECT part_id, h.id AS method_id, h.method_name FROM part_group p JOIN surface_hardening_method h
    ON h.material_group_id IS NULL OR h.material_group_id = p.material_group_id WHERE p.material_group_id IS NOT NULL""",
)
def _(spark, d):
    methods = load(spark, "surface_hardening_method").select(F.col("id").alias("method_id"), "material_group_id", "method_name")
    parts = grouped(spark, d).where("material_group_id IS NOT NULL").select("part_id", "material_group_id")
    general = methods.where("material_group_id IS NULL").select(F.sort_array(F.collect_list(F.struct("method_id", "method_name"))).alias("ms"))
    all_parts = parts.crossJoin(F.broadcast(general)).select("part_id", F.inline("ms"))  # one row: a global aggregate
    own = lookup(parts, methods, "material_group_id", "inner").select("part_id", "method_id", "method_name")
    return all_parts.unionByName(own)


@add("p3_route_card", """SELECT part_id, sequence_no, concat_ws('|', sequence_no::VARCHAR, op_code || ' ' || op_name, '', '', '', '',
    coalesce(model_name, 'не подобрано'), '', '') AS cells FROM route_ops""")
def _(spark, d):
    card = route.route_card(spark, operations(spark, d))
    return card.select("part_id", "sequence_no", F.array_join("cells", "|").alias("cells"))


OP_CARD = """SELECT part_id, sequence_no, concat_ws('|', sequence_no::VARCHAR, '1', op_code || ' ' || op_name,
    coalesce(model_name, 'не подобрано'), coalesce(tooling, 'не подобрана'), coalesce(printf('%.2f', depth_of_cut_mm), ''),
    coalesce(printf('%.2f', feed_mm_rev), ''), coalesce(printf('%.1f', cutting_speed_m_min), ''),
    coalesce(spindle_speed_rpm::VARCHAR, ''){tail}) AS cells, reason_code AS note_code FROM route_ops"""


@add("p4_operation_card", OP_CARD.replace("{tail}", ", '', '', '', '', ''"))
def _(spark, d):
    card = route.operation_card(spark, operations(spark, d))
    return card.select("part_id", "sequence_no", F.array_join("cells", "|").alias("cells"), "note_code")


@add("h30_row_truncation", OP_CARD.replace("{tail}", ""))
def _(spark, d):
    card = route.operation_card(spark, operations(spark, d), code="MK")
    return card.select("part_id", "sequence_no", F.array_join("cells", "|").alias("cells"), "note_code")


@add("h29_fixed_digits", """SELECT part_id, sequence_no, coalesce(printf('%.2f', feed_mm_rev), '') AS feed_text,
    coalesce(printf('%.1f', cutting_speed_m_min), '') AS speed_text FROM route_ops""")
def _(spark, d):
    from partwright.functions import numbers as nx

    return operations(spark, d).select(
        "part_id", "sequence_no", F.coalesce(nx.fixed(F.col("feed_mm_rev"), 2), F.lit("")).alias("feed_text"),
        F.coalesce(nx.fixed(F.col("cutting_speed_m_min"), 1), F.lit("")).alias("speed_text"),
    )


def per_part(name, sql, template_of):
    """Reference rows of a material group, attached to every drawing of the group."""
    @add(name, sql)
    def _(spark, d):
        template, columns = template_of(spark)
        parts = grouped(spark, d).select("part_id", "material_group_id")
        return lookup(parts, settle(template), "material_group_id", "inner").select("part_id", *columns)


per_part("j1_compatible_equipment", "SELECT part_id, equipment_code FROM part_group JOIN group_equipment USING (material_group_id)",
         lambda s: (route.compatible_equipment(s), ["equipment_code"]))
per_part("j2_equipment_operations", """SELECT part_id, g.equipment_code, o.code AS op_code FROM part_group JOIN group_equipment g USING (material_group_id)
    JOIN equipment_type_operation_type x ON x.equipment_type_id = g.equipment_type_id JOIN operation_type o ON o.id = x.operation_type_id""",
         lambda s: (route.compatible_equipment(s).join(route.equipment_operations(s), "equipment_type_id"), ["equipment_code", "op_code"]))
per_part("j3_operation_tooling", """SELECT part_id, op_code, t.name AS tooling_name FROM part_group JOIN group_operation g USING (material_group_id)
    JOIN operation_type_tooling_type x ON x.operation_type_id = g.operation_type_id JOIN tooling_type t ON t.id = x.tooling_type_id""",
         lambda s: (route.chosen_equipment(s).join(route.operation_tooling(s), "operation_type_id"), ["op_code", "tooling_name"]))
per_part("j4_first_model", """SELECT part_id, g.equipment_code, m.model_name FROM part_group JOIN group_equipment g USING (material_group_id)
    LEFT JOIN equipment_model m ON m.id = (SELECT min(id) FROM equipment_model y WHERE y.equipment_type_id = g.equipment_type_id)""",
         lambda s: (route.compatible_equipment(s).join(route.first_models(s), "equipment_type_id", "left"), ["equipment_code", "model_name"]))
per_part("w1_first_equipment_per_operation", "SELECT part_id, op_code, equipment_type_id FROM part_group JOIN group_operation USING (material_group_id)",
         lambda s: (route.chosen_equipment(s), ["op_code", "equipment_type_id"]))
per_part("u7_distinct_operation_ids",
         "SELECT DISTINCT part_id, operation_type_id FROM part_group JOIN group_route USING (material_group_id) WHERE operation_type_id IS NOT NULL",
         lambda s: (route.route_template(s).where("operation_type_id IS NOT NULL").select("material_group_id", "operation_type_id").distinct(),
                    ["operation_type_id"]))
per_part("w2_operation_sequence", "SELECT part_id, op_code, sequence_no FROM part_group JOIN group_route USING (material_group_id)",
         lambda s: (route.route_template(s).withColumn("sequence_no", F.col("sequence_no").cast("bigint")), ["op_code", "sequence_no"]))
per_part("a11_tooling_names", "SELECT part_id, op_code, coalesce(tooling, 'не подобрана') AS tooling FROM part_group JOIN group_route USING (material_group_id)",
         lambda s: (route.route_template(s).withColumn("tooling", F.coalesce("tooling", F.lit(route.NO_TOOLING_TEXT))), ["op_code", "tooling"]))
per_part("f11_first_formula", "SELECT part_id, op_code, cv, m, xv, yv FROM part_group JOIN group_route USING (material_group_id)",
         lambda s: (route.route_template(s), ["op_code", "cv", "m", "xv", "yv"]))
per_part("f12_feed_reference", "SELECT part_id, op_code, feed_min, feed_max, depth_min, depth_max FROM part_group JOIN group_route USING (material_group_id)",
         lambda s: (route.route_template(s), ["op_code", "feed_min", "feed_max", "depth_min", "depth_max"]))


@add("f13_machinability", "SELECT part_id, coalesce(g.machinability_index, 1) AS kv FROM part_group p LEFT JOIN material_group g ON g.id = p.material_group_id")
def _(spark, d):
    out = lookup(grouped(spark, d), route.machinability(spark), "material_group_id")
    return out.select("part_id", F.coalesce("kv", F.lit(1.0)).alias("kv"))


@add("h40_operation_flags", "SELECT d.part_id, count(o.part_id) > 0 AS has_operations FROM drawings d LEFT JOIN route_ops o ON o.part_id = d.part_id GROUP BY d.part_id")
def _(spark, d):
    parts = facts.drawings(spark, d).select("part_id")
    planned = operations(spark, d).select("part_id").distinct().withColumn("has_operations", F.lit(True))
    return parts.join(planned, "part_id", "left").select("part_id", F.coalesce("has_operations", F.lit(False)).alias("has_operations"))
