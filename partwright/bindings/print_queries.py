"""Print planning and material recommendation over all parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwright.bindings import facts
from partwright.bindings.spec import FACT_SQL, REGISTRY
from partwright.functions import numbers as nx
from partwright.plans import printing as pr
from partwright.sources.joins import lookup, settle
from partwright.sources.reference import load

add = REGISTRY.add

FACT_SQL["print_base"] = """
SELECT r.*, t.id AS am_technology_id, g.id AS am_material_group_id, g.name AS material_group_name
FROM print_requests r LEFT JOIN am_technology t ON t.code = r.am_technology_code
LEFT JOIN am_material_group g ON g.am_technology_id = t.id AND g.code = r.material_group_code"""

FACT_SQL["print_plan"] = """
SELECT *, CASE WHEN ready THEN CAST(printf('%.3f', layer) AS DOUBLE) END AS layer_height_mm,
  CASE WHEN ready THEN CAST(printf('%.1f', vol / rate / 60) AS DOUBLE) END AS print_time_min,
  CASE WHEN ready THEN CAST(printf('%.1f', vol / 1000 * density) AS DOUBLE) END AS material_g
FROM (SELECT *, vol IS NOT NULL AND layer IS NOT NULL AND rate IS NOT NULL AND density IS NOT NULL AS ready FROM (
SELECT b.*, length_x * length_y * length_z * 0.25e0 AS vol, (tol.layer_min + tol.layer_max) / 2 AS layer,
  v.volumetric_rate_mm3_s AS rate, (SELECT arg_min(density_g_cm3, id) FROM am_material x WHERE x.am_material_group_id = b.am_material_group_id
    AND density_g_cm3 IS NOT NULL) AS density, ft.printer_type_id,
  (SELECT arg_min(model_name, id) FROM printer_model x WHERE x.printer_type_id = ft.printer_type_id) AS printer_model_name,
  m.trade_name, m.print_temp_min_c, m.print_temp_max_c, m.bed_temp_c, m.requires_heated_chamber, m.requires_dry_storage, tol.* EXCLUDE (am_technology_id)
FROM print_base b LEFT JOIN am_technology_tolerance tol ON tol.am_technology_id = b.am_technology_id AND b.am_material_group_id IS NOT NULL
LEFT JOIN print_speed_reference v ON v.am_technology_id = b.am_technology_id AND b.am_material_group_id IS NOT NULL
LEFT JOIN (SELECT am_material_group_id, min(printer_type_id) AS printer_type_id FROM printer_type_material_group GROUP BY 1) ft
  ON ft.am_material_group_id = b.am_material_group_id
LEFT JOIN am_material m ON m.id = (SELECT min(id) FROM am_material x WHERE x.am_material_group_id = b.am_material_group_id)))"""

STEPS = """
SELECT x.am_material_group_id, t.name AS step_name, x.is_required, x.pp_tooling_type_id,
  row_number() OVER (PARTITION BY x.am_material_group_id ORDER BY coalesce(x.typical_order, 0), t.id) AS place, x.typical_order,
  'улучшение допуска на ' || printf('%g', e.tol_min_pct) || '-' || printf('%g', e.tol_max_pct) || '%, снижение Ra в '
  || printf('%g', e.ra_min) || '-' || printf('%g', e.ra_max) || ' раз' AS effect
FROM material_group_pp_tooling_type x JOIN pp_tooling_type t ON t.id = x.pp_tooling_type_id
LEFT JOIN postprocessing_quality_effect e ON e.id = (SELECT min(id) FROM postprocessing_quality_effect y WHERE y.pp_tooling_type_id = t.id)"""
FACT_SQL["print_step"] = (
    f"SELECT *, CASE WHEN coalesce(typical_order, 0) = 0 THEN CAST(place AS INT) ELSE typical_order END AS step_no FROM ({STEPS})"
)

FACT_SQL["options"] = """
SELECT q.request_id, q.class_code, q.fallback, r.id AS rule_id, r.priority, g.code AS material_group_code, t.code AS am_technology_code,
  s.source_type, s.reliability, r.min_infill, r.wall_count
FROM (SELECT *, n_known > 0 AND NOT matched AND class_id IS NOT NULL AS fallback FROM (
  SELECT q.request_id, q.class_code, c.id AS class_id, q.condition_codes,
    (SELECT count(*) FROM operating_condition o WHERE list_contains(q.condition_codes, o.code)) AS n_known,
    EXISTS (SELECT 1 FROM operating_condition o JOIN application_material_recommendation r ON r.condition_id = o.id
            WHERE r.class_id = c.id AND list_contains(q.condition_codes, o.code)) AS matched
  FROM recommendation_requests q LEFT JOIN part_application_class c ON c.code = q.class_code)) q
LEFT JOIN (SELECT r.*, o.code AS condition_code FROM application_material_recommendation r LEFT JOIN operating_condition o ON o.id = r.condition_id) r
  ON r.class_id = q.class_id AND ((q.matched AND list_contains(q.condition_codes, r.condition_code)) OR (NOT q.matched AND r.condition_id IS NULL))
LEFT JOIN am_material_group g ON g.id = r.group_id LEFT JOIN am_technology t ON t.id = r.technology_id
LEFT JOIN recommendation_source s ON s.id = r.source_id"""


def requests(spark, d):
    return facts.print_requests(spark, d)


def plans(spark, d):
    return pr.print_plans(spark, requests(spark, d))


PLAN_COLUMNS = ["part_id", "am_technology_code", "material_group_name", "printer_model_name", "layer_height_mm", "print_time_min",
                "material_g", "trade_name"]


@add("p5_print_plan", f"SELECT {', '.join(PLAN_COLUMNS)} FROM print_plan")
def _(spark, d):
    return plans(spark, d).select(PLAN_COLUMNS)


@add("h19_print_estimate", "SELECT part_id, layer_height_mm, print_time_min, material_g FROM print_plan")
def _(spark, d):
    return plans(spark, d).select("part_id", "layer_height_mm", "print_time_min", "material_g")


@add("p5_print_warnings", """SELECT part_id, CAST(row_number() OVER (PARTITION BY part_id ORDER BY o) AS INT) AS warning_no, warning_code FROM (
    SELECT part_id, 1 AS o, 'unknown_technology' AS warning_code FROM print_plan WHERE am_technology_id IS NULL
    UNION ALL SELECT part_id, 2, 'unknown_material' FROM print_plan WHERE am_technology_id IS NOT NULL AND am_material_group_id IS NULL
    UNION ALL SELECT part_id, 3, 'no_printer_type' FROM print_plan WHERE am_material_group_id IS NOT NULL AND printer_type_id IS NULL
    UNION ALL SELECT part_id, 4, 'no_model' FROM print_plan WHERE printer_type_id IS NOT NULL AND printer_model_name IS NULL
    UNION ALL SELECT part_id, 5, 'no_profile' FROM print_plan WHERE am_material_group_id IS NOT NULL AND trade_name IS NULL)""")
def print_warnings(spark, d):
    return pr.print_warnings(plans(spark, d))


@add("h20_range_labels", """SELECT part_id, '±' || printf('%g', tol_min) || '-' || printf('%g', tol_max) AS tolerance_mm,
    CASE WHEN wall_max IS NOT NULL THEN printf('%g', wall_min) || '-' || printf('%g', wall_max) ELSE 'от ' || printf('%g', wall_min) END AS wall_mm,
    printf('%g', ra_raw_min) || '-' || printf('%g', ra_raw_max) AS ra_raw_um,
    printf('%g', ra_fin_min) || '-' || printf('%g', ra_fin_max) AS ra_finished_um, printf('%g', thread_pitch) AS thread_pitch_mm,
    printf('%g', clearance_min) || '-' || printf('%g', clearance_max) AS clearance_mm
    FROM print_plan WHERE am_material_group_id IS NOT NULL""")
def _(spark, d):
    return plans(spark, d).where("am_material_group_id IS NOT NULL").select(
        "part_id", "tolerance_mm", "wall_mm", "ra_raw_um", "ra_finished_um", "thread_pitch_mm", "clearance_mm"
    )


@add("h20_short_numbers", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, printf('%g', l_extendedprice) AS price,"
     " printf('%g', l_extendedprice / 1e9) AS small, printf('%g', l_extendedprice * 1e4) AS large FROM lineitem")
def _(spark, d):
    price = F.col("l_extendedprice")
    return facts.read(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", nx.short(price).alias("price"),
        nx.short(price / 1e9).alias("small"), nx.short(price * 1e4).alias("large"),
    )


@add("p6_print_process_card", """SELECT part_id, concat_ws('|', am_technology_code, coalesce(printer_model_name, 'не подобран'),
    coalesce(material_group_name, 'не определён'), coalesce(printf('%g', layer_height_mm) || ' мм', ''), '',
    coalesce(printf('%g', print_time_min) || ' мин', ''), coalesce(printf('%g', material_g) || ' г', '')) AS cells FROM print_plan""")
def _(spark, d):
    return pr.process_card(plans(spark, d)).select("part_id", F.array_join("cells", "|").alias("cells"))


@add("p6_postprocessing_card", """SELECT part_id, CAST(place AS INT) AS place, concat_ws('|', step_no::VARCHAR,
    step_name || CASE WHEN is_required THEN '' ELSE ' (опционально)' END, '', '', '', coalesce(effect, '')) AS cells
    FROM print_base JOIN print_step USING (am_material_group_id)""")
def _(spark, d):
    return pr.postprocessing_card(spark, plans(spark, d)).select("part_id", "place", F.array_join("cells", "|").alias("cells"))


def by_group(name, sql, template_of):
    """Reference rows of a printing material group, attached to every request that names it."""
    @add(name, sql)
    def _(spark, d):
        template, columns = template_of(spark)
        keyed = lookup(requests(spark, d), settle(pr.material_groups(spark).join(pr.technologies(spark), "am_technology_id")),
                       ["am_technology_code", "material_group_code"], "inner")
        return lookup(keyed.select("part_id", "am_material_group_id", "am_technology_id"), settle(template), template.columns[0], "inner").select("part_id", *columns)


by_group("j5_first_printer", """SELECT part_id, printer_type_id, printer_model_name FROM print_plan WHERE am_material_group_id IS NOT NULL AND printer_type_id IS NOT NULL""",
         lambda s: (pr.first_printer(s).select("am_material_group_id", "printer_type_id", "printer_model_name"), ["printer_type_id", "printer_model_name"]))
by_group("j6_postprocessing_steps", "SELECT part_id, step_name, is_required, typical_order FROM print_base JOIN print_step USING (am_material_group_id)",
         lambda s: (pr.postprocessing_steps(s).select("am_material_group_id", "step_name", "is_required", "typical_order"),
                    ["step_name", "is_required", "typical_order"]))
by_group("w3_step_numbers", "SELECT part_id, step_name, step_no FROM print_base JOIN print_step USING (am_material_group_id)",
         lambda s: (pr.postprocessing_steps(s).select("am_material_group_id", "step_name", "step_no"), ["step_name", "step_no"]))
by_group("f17_first_effect", "SELECT part_id, step_name, effect FROM print_base JOIN print_step USING (am_material_group_id) WHERE effect IS NOT NULL",
         lambda s: (pr.postprocessing_steps(s).where("effect IS NOT NULL").select("am_material_group_id", "step_name", "effect"), ["step_name", "effect"]))
by_group("h21_effect_label", "SELECT part_id, effect FROM print_base JOIN print_step USING (am_material_group_id)",
         lambda s: (pr.postprocessing_steps(s).select("am_material_group_id", "effect"), ["effect"]))
by_group("f15_technology_tolerance_and_speed", "SELECT part_id, tol_min, tol_max, layer_min, layer_max, rate AS volumetric_rate_mm3_s FROM print_plan WHERE am_material_group_id IS NOT NULL",
         lambda s: (load(s, "am_technology_tolerance").join(load(s, "print_speed_reference"), "am_technology_id", "left"),
                    ["tol_min", "tol_max", "layer_min", "layer_max", "volumetric_rate_mm3_s"]))
by_group("f16_first_density_and_profile", "SELECT part_id, density AS density_g_cm3, trade_name, print_temp_min_c, bed_temp_c FROM print_plan WHERE trade_name IS NOT NULL",
         lambda s: (pr.first_profile(s).join(pr.first_density(s), "am_material_group_id", "left"),
                    ["density_g_cm3", "trade_name", "print_temp_min_c", "bed_temp_c"]))


@add("f4_compound_key_lookup", "SELECT part_id, am_material_group_id, material_group_name FROM print_base")
def _(spark, d):
    keys = settle(pr.material_groups(spark).join(pr.technologies(spark), "am_technology_id"))
    return lookup(requests(spark, d), keys, ["am_technology_code", "material_group_code"]).select(
        "part_id", "am_material_group_id", "material_group_name"
    )


@add("f3_point_lookup_by_code", """SELECT part_id, t.id AS am_technology_id, c.id AS class_id FROM print_requests r
    JOIN recommendation_requests q ON q.request_id = r.part_id LEFT JOIN am_technology t ON t.code = r.am_technology_code
    LEFT JOIN part_application_class c ON c.code = q.class_code""")
def _(spark, d):
    key = F.col("p_partkey")
    both = facts.read(spark, d, "part").select(
        key.alias("part_id"), facts.pick(facts.TECHNOLOGIES, key + F.col("p_size")).alias("am_technology_code"),
        facts.pick(facts.PART_CLASSES, key).alias("class_code"),
    )
    classes = load(spark, "part_application_class").select(F.col("id").alias("class_id"), F.col("code").alias("class_code"))
    return lookup(lookup(both, pr.technologies(spark), "am_technology_code"), classes, "class_code").select(
        "part_id", "am_technology_id", "class_id"
    )


@add("f5_in_list_codes", "SELECT q.request_id, o.code, o.id AS condition_id FROM (SELECT request_id, unnest(condition_codes) AS code"
     " FROM recommendation_requests) q JOIN operating_condition o ON o.code = q.code")
def _(spark, d):
    codes = facts.recommendation_requests(spark, d).select("request_id", F.explode("condition_codes").alias("code"))
    known = load(spark, "operating_condition").select("code", F.col("id").alias("condition_id"))
    return lookup(codes, known, "code", "inner").select("request_id", "code", "condition_id")


@add("u6_unknown_codes", """SELECT request_id, string_agg(code, ', ' ORDER BY ix) AS unknown_codes FROM (SELECT request_id, unnest(condition_codes) AS code,
    unnest(range(len(condition_codes))) AS ix FROM recommendation_requests) WHERE code NOT IN (SELECT code FROM operating_condition) GROUP BY request_id""")
def _(spark, d):
    out = pr.condition_ids(spark, facts.recommendation_requests(spark, d)).where(F.size("unknown_codes") > 0)
    return out.select("request_id", F.array_join("unknown_codes", ", ").alias("unknown_codes"))


@add("f20_part_classes", "SELECT c.id, c.code, c.name, count(q.request_id) AS requests FROM part_application_class c"
     " LEFT JOIN recommendation_requests q ON q.class_code = c.code GROUP BY ALL")
def _(spark, d):
    asked = facts.recommendation_requests(spark, d).groupBy(F.col("class_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return load(spark, "part_application_class").join(asked, "code", "left").select(
        "id", "code", "name", F.coalesce("n", F.lit(0)).alias("requests")
    ).orderBy("id")


@add("j7_typical_conditions", """SELECT q.request_id, o.condition_type, o.code FROM recommendation_requests q LEFT JOIN part_application_class c ON c.code = q.class_code
    JOIN operating_condition o ON c.id IS NULL OR o.id IN (SELECT condition_id FROM part_application_class_typical_condition t WHERE t.class_id = c.id)""")
def _(spark, d):
    """Typical conditions of the class; all conditions where no class is given."""
    conditions = load(spark, "operating_condition").select(F.col("id").alias("condition_id"), "condition_type", "code")
    classes = load(spark, "part_application_class").select(F.col("id").alias("class_id"), F.col("code").alias("class_code"))
    typical = load(spark, "part_application_class_typical_condition").join(conditions, "condition_id")
    rows = F.sort_array(F.collect_list(F.struct("condition_type", "condition_id", "code"))).alias("rows")
    by_class = settle(classes.join(typical.groupBy("class_id").agg(rows), "class_id", "left"))
    everything = conditions.select(rows.alias("all_rows"))
    out = lookup(facts.recommendation_requests(spark, d), by_class, "class_code").crossJoin(F.broadcast(everything))  # one row
    chosen = F.when(F.col("class_id").isNull(), F.col("all_rows")).otherwise(F.col("rows"))
    return out.select("request_id", F.inline(chosen)).select("request_id", "condition_type", "code")


OPTION_COLUMNS = ["request_id", "class_code", "fallback", "rule_id", "priority", "material_group_code", "am_technology_code", "source_type",
                  "reliability", "min_infill", "wall_count"]


def recommendations(spark, d):
    return pr.recommend(spark, facts.recommendation_requests(spark, d)).select(OPTION_COLUMNS)


@add("j8_material_recommendations", f"SELECT {', '.join(OPTION_COLUMNS)} FROM options WHERE rule_id IS NOT NULL AND NOT fallback")
def _(spark, d):
    return recommendations(spark, d).where("rule_id IS NOT NULL AND NOT fallback")


@add("j9_recommendation_with_fallback", f"SELECT {', '.join(OPTION_COLUMNS)} FROM options")
def _(spark, d):
    return recommendations(spark, d)


@add("p7_material_recommendation", """SELECT request_id, class_code, fallback, rule_id, CASE WHEN rule_id IS NULL THEN NULL
    WHEN row_number() OVER (PARTITION BY request_id ORDER BY priority, rule_id) = 1 THEN 'best' ELSE 'alternative' END AS role FROM options""")
def _(spark, d):
    return split_best(recommendations(spark, d)).select("request_id", "class_code", "fallback", "rule_id", "role")


def split_best(options):
    """First by priority is the best option, the rest are alternatives; a request has at most the rules of its class."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("request_id").orderBy("priority", "rule_id"))
    return options.withColumn("role", F.when(F.col("rule_id").isNotNull(), F.when(place == 1, "best").otherwise("alternative")))


@add("t4_best_option", """SELECT request_id, rule_id, material_group_code FROM options WHERE rule_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY priority, rule_id) = 1""")
def _(spark, d):
    return split_best(recommendations(spark, d)).where("role = 'best'").select("request_id", "rule_id", "material_group_code")


@add("t1_ordered_conditions", """SELECT q.request_id, string_agg(o.code, ',' ORDER BY o.condition_type, o.id) AS codes FROM recommendation_requests q
    JOIN part_application_class c ON c.code = q.class_code JOIN part_application_class_typical_condition t ON t.class_id = c.id
    JOIN operating_condition o ON o.id = t.condition_id GROUP BY q.request_id""")
def _(spark, d):
    conditions = load(spark, "operating_condition").select(F.col("id").alias("condition_id"), "condition_type", "code")
    classes = load(spark, "part_application_class").select(F.col("id").alias("class_id"), F.col("code").alias("class_code"))
    ordered = F.array_sort(F.collect_list(F.struct("condition_type", "condition_id", "code")))
    text = load(spark, "part_application_class_typical_condition").join(conditions, "condition_id").groupBy("class_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["code"]), ",").alias("codes")
    ).join(classes, "class_id")
    return lookup(facts.recommendation_requests(spark, d), settle(text), "class_code", "inner").select("request_id", "codes")


SIZED = ["part_id", "length_x", "it6_um", "it7_um", "it8_um"]


@add("x3_size_class", """SELECT p_partkey AS part_id, CAST(p_size AS DOUBLE) / 2 AS length_x, c.it6_um, c.it7_um, c.it8_um FROM part
    LEFT JOIN dimensional_tolerance_class c ON p_size / 2e0 > c.size_min AND p_size / 2e0 <= c.size_max""")
def _(spark, d):
    parts = facts.read(spark, d, "part").select(F.col("p_partkey").alias("part_id"), (F.col("p_size").cast("double") / 2).alias("length_x"))
    return pr.size_class(parts, load(spark, "dimensional_tolerance_class"), "length_x").select(SIZED)


@add("x4_build_volume_fit", """SELECT part_id, printer_model_id, model_name, priority FROM (SELECT r.part_id, m.id AS printer_model_id, m.model_name, a.priority,
    row_number() OVER (PARTITION BY r.part_id ORDER BY a.priority, m.id) AS rn FROM print_requests r JOIN recommendation_requests q ON q.request_id = r.part_id
    JOIN part_application_class c ON c.code = q.class_code JOIN application_printer_recommendation a ON a.class_id = c.id
    JOIN printer_model m ON m.printer_type_id = a.printer_type_id AND m.build_x >= a.min_x AND m.build_y >= a.min_y AND m.build_z >= a.min_z
    WHERE r.length_x <= m.build_x AND r.length_y <= m.build_y AND r.length_z <= m.build_z) WHERE rn = 1""")
def _(spark, d):
    parts = requests(spark, d).withColumn("class_code", facts.pick(facts.PART_CLASSES, F.col("part_id")))
    return pr.printer_fit(spark, parts)


@add("x1_compatibility_with_exceptions", """SELECT p_partkey AS part_id, coalesce(o.is_allowed, EXISTS (SELECT 1 FROM printer_model m
      JOIN printer_type_material_group g ON g.printer_type_id = m.printer_type_id JOIN am_material a ON a.am_material_group_id = g.am_material_group_id
      WHERE m.id = 1 + p_partkey % 5 AND a.id = 1 + p_partkey % 8)) AS is_allowed
    FROM part LEFT JOIN printer_material_override o ON o.printer_model_id = 1 + p_partkey % 5 AND o.am_material_id = 1 + p_partkey % 8""")
def _(spark, d):
    key = F.col("p_partkey")
    asked = facts.read(spark, d, "part").select(
        key.alias("part_id"), (1 + key % 5).alias("printer_model_id"), (1 + key % 8).alias("am_material_id")
    )
    out = lookup(asked, pr.model_material_allowed(spark), ["printer_model_id", "am_material_id"])
    return out.select("part_id", F.coalesce("is_allowed", F.lit(False)).alias("is_allowed"))


@add("x2_interface_fit", """SELECT p_partkey AS part_id, m.model_name, x.designation FROM part JOIN (SELECT *, CASE id WHEN 3 THEN 'ISO 40' WHEN 4 THEN 'CAT40'
      ELSE shank_type END AS shank FROM tooling) x ON x.id = 1 + p_partkey % 7 JOIN equipment_model m ON m.spindle_nose_type = x.shank""")
def _(spark, d):
    key = F.col("p_partkey")
    tools = load(spark, "tooling").withColumn(
        "shank", F.when(F.col("id") == 3, "ISO 40").when(F.col("id") == 4, "CAT40").otherwise(F.col("shank_type"))
    )
    models = load(spark, "equipment_model").select("model_name", F.col("spindle_nose_type").alias("shank"))
    fits = settle(tools.join(models, "shank").select(F.col("id").alias("tooling_id"), "designation", "model_name"))
    asked = facts.read(spark, d, "part").select(key.alias("part_id"), (1 + key % 7).alias("tooling_id"))
    return lookup(asked, fits, "tooling_id", "inner").select("part_id", "model_name", "designation")


@add("x9_planned_vs_actual", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, print_time_min,
    CAST(printf('%.1f', print_time_min * (0.9e0 + l_discount) - print_time_min) AS DOUBLE) AS time_delta
    FROM lineitem JOIN print_plan ON part_id = l_partkey WHERE print_time_min IS NOT NULL""")
def _(spark, d):
    """Passport rows (one per line item) against the plan of their part; both sides large, joined on the part."""
    planned = plans(spark, d).where("print_time_min IS NOT NULL").select(F.col("part_id").alias("l_partkey"), "print_time_min")
    passports = facts.read(spark, d, "lineitem")
    joined = passports.join(planned, "l_partkey")
    actual = F.col("print_time_min") * (F.lit(0.9) + F.col("l_discount"))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "print_time_min",
        nx.exact_round(actual - F.col("print_time_min"), 1).alias("time_delta"),
    )
