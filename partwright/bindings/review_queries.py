"""Review reports, registry, quality and schedule over all drawings and print requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwright.bindings import facts
from partwright.bindings import print_queries as pq
from partwright.bindings import sqlfrag as q
from partwright.bindings.spec import FACT_SQL, REGISTRY
from partwright.operators.chunks import joined_in_order
from partwright.functions import text as tx
from partwright.plans import printing, quality, registry, review, route

add = REGISTRY.add

FACT_SQL["all_checks"] = """
SELECT part_id, check_code, standard_designation, clause_number, status, actual_value, 5 AS rank FROM reference_check
UNION ALL SELECT part_id, check_code, standard_designation, clause_number, status, actual_value, 6 FROM scale_check
UNION ALL SELECT part_id, check_code, standard_designation, clause_number, status, actual_value, 6 + field_pos FROM title_check"""

FACT_SQL["submissions"] = "SELECT *, part_id % 41 <> 0 AS has_drawing FROM drawings"

UNRECOGNISED = f"""SELECT part_id, string_agg(number::VARCHAR, ', ' ORDER BY pos) AS numbers,
  count(*) AS items FROM tech_requirements WHERE {q.category('text')} IS NULL GROUP BY ALL"""

FACT_SQL["findings"] = f"""
SELECT s.part_id, x.rank, x.severity, x.finding_code, x.arg FROM submissions s JOIN (
  SELECT part_id, 1 AS rank, 'blocking' AS severity, 'material_not_found' AS finding_code, nullif(material, '') AS arg
    FROM material_match JOIN drawings USING (part_id) WHERE material_status = 'not_found'
  UNION ALL SELECT part_id, 1, 'warning', 'material_partial', matched_grade FROM material_match WHERE material_status = 'partial_match'
  UNION ALL SELECT part_id, 2, 'warning', 'blank_not_found', nullif(blank_designation, '') FROM blank_match JOIN drawings USING (part_id)
    WHERE blank_status = 'not_found'
  UNION ALL SELECT part_id, 2, 'info', 'blank_partial', blank_reason FROM blank_match WHERE blank_status = 'partial_match'
  UNION ALL SELECT part_id, rank, CASE WHEN status = 'violated' THEN 'warning' ELSE 'info' END, check_code || '_' || status, actual_value
    FROM all_checks WHERE status IN ('violated', 'needs_review')) x ON x.part_id = s.part_id AND s.has_drawing
UNION ALL SELECT part_id, 0, 'blocking', 'no_drawing', NULL FROM submissions WHERE NOT has_drawing
UNION ALL SELECT part_id, 3, 'info', 'requirements_unrecognised', numbers FROM ({UNRECOGNISED}) WHERE part_id % 41 <> 0
UNION ALL SELECT part_id, 4, 'warning', 'numbering_violated', first_bad_pos::VARCHAR FROM numbering_check
  WHERE status = 'violated' AND part_id % 41 <> 0"""


def submissions(spark, d):
    return facts.drawings(spark, d).withColumn("has_drawing", F.col("part_id") % 41 != 0)


def lines_of_drawings(spark, d):
    """Requirement lines exist only where a drawing was given."""
    return facts.tech_requirements(spark, d).where(F.col("part_id") % 41 != 0)


def findings(spark, d):
    return review.review_findings(spark, submissions(spark, d), lines_of_drawings(spark, d))


@add("p1_review_findings", "SELECT * FROM findings")
def _(spark, d):
    return findings(spark, d)


@add("u2_findings_by_severity", "SELECT severity, finding_code, count(*) AS findings FROM findings GROUP BY ALL")
def _(spark, d):
    return findings(spark, d).groupBy("severity", "finding_code").agg(F.count(F.lit(1)).alias("findings"))


@add("u3_check_findings", """SELECT part_id, check_code, CASE WHEN status = 'violated' THEN 'warning' ELSE 'info' END AS severity
    FROM all_checks WHERE status IN ('violated', 'needs_review')""")
def _(spark, d):
    checks = review.reported_checks(review.with_checks(spark, facts.drawings(spark, d)), ["part_id"]).where("status <> 'passed'")
    return checks.select("part_id", "check_code", F.when(F.col("status") == "violated", "warning").otherwise("info").alias("severity"))


@add("f18_reported_checks", "SELECT part_id, check_code, standard_designation, clause_number, status, actual_value FROM all_checks WHERE status <> 'not_applicable'")
def _(spark, d):
    return review.reported_checks(review.with_checks(spark, facts.drawings(spark, d)), ["part_id"]).drop("rank")


@add("a8_check_counts", "SELECT part_id, count(*) FILTER (status = 'violated') AS violated, count(*) FILTER (status = 'needs_review') AS needs_review"
     " FROM all_checks WHERE status <> 'not_applicable' GROUP BY part_id")
def _(spark, d):
    checks = review.reported_checks(review.with_checks(spark, facts.drawings(spark, d)), ["part_id"])
    return review.status_counts(checks, ["part_id"])


@add("a10_blocking_flag", "SELECT part_id, bool_or(severity = 'blocking') AS has_blocking FROM findings GROUP BY part_id")
def _(spark, d):
    return findings(spark, d).groupBy("part_id").agg(F.bool_or(F.col("severity") == "blocking").alias("has_blocking"))


@add("a12_unrecognised_numbers", UNRECOGNISED)
def _(spark, d):
    lines = facts.tech_requirements(spark, d).where(tx.requirement_category(F.col("text")).isNull())
    return joined_in_order(lines.withColumn("numbers", F.col("number")), ["part_id"], "pos", "numbers", ", ")


LABEL = "CASE severity WHEN 'blocking' THEN 'Критично' WHEN 'warning' THEN 'Внимание' ELSE 'Информация' END"


@add("h36_review_summary", f"""SELECT d.part_id, coalesce(summary, 'Значимых замечаний по результатам сверки с НСИ не выявлено.') AS summary,
    coalesce(has_blocking, FALSE) AS has_blocking FROM drawings d LEFT JOIN (SELECT part_id,
      string_agg({LABEL} || ': ' || finding_code, ' ' ORDER BY rank) AS summary, bool_or(severity = 'blocking') AS has_blocking
      FROM (SELECT DISTINCT part_id, rank, severity, finding_code FROM findings) GROUP BY part_id) USING (part_id)""")
def _(spark, d):
    return review.summaries(facts.drawings(spark, d), findings(spark, d))


@add("s12_json_document", f"""SELECT m.part_id, to_json({{'part_id': m.part_id,
    'material_check': {{'from_drawing': nullif(d.material, ''), 'status': material_status, 'matched_grade': matched_grade, 'matched_gost': matched_standard}},
    'blank_check': {{'from_drawing': nullif(d.blank_designation, ''), 'status': blank_status, 'matched_designation': matched_blank, 'note': blank_reason}},
    'technical_requirement_checks': coalesce(l.items, []),
    'gost_checks': (SELECT list({{'code': check_code, 'standard_designation': standard_designation, 'clause_number': clause_number, 'status': status, 'actual_value': actual_value}} ORDER BY rank)
      FROM all_checks c WHERE c.part_id = m.part_id),
    'findings': coalesce(f.items, []), 'has_blocking_findings': coalesce(f.has_blocking, FALSE), 'summary': coalesce(f.summary, 'Значимых замечаний по результатам сверки с НСИ не выявлено.')}})::VARCHAR AS document
    FROM material_match m JOIN blank_match b ON b.part_id = m.part_id JOIN drawings d ON d.part_id = m.part_id
    LEFT JOIN (SELECT part_id, list({{'number': number, 'text': text, 'is_recognized': category IS NOT NULL, 'category': category}} ORDER BY pos) AS items
      FROM (SELECT *, {q.category('text')} AS category FROM tech_requirements) WHERE part_id % 41 <> 0 GROUP BY part_id) l ON l.part_id = m.part_id
    LEFT JOIN (SELECT part_id, list({{'severity': severity, 'code': finding_code, 'arg': arg}} ORDER BY rank, severity, finding_code, arg) AS items,
      string_agg({LABEL} || ': ' || finding_code, ' ' ORDER BY rank) AS summary, bool_or(severity = 'blocking') AS has_blocking FROM findings GROUP BY part_id) f ON f.part_id = m.part_id""")
def _(spark, d):
    return review.documents(spark, submissions(spark, d), lines_of_drawings(spark, d))


FACT_SQL["metal_rows"] = f"""
SELECT part_id, row_id, registry, coalesce(nullif(doc, ''), '—') AS project_doc, status FROM (
SELECT part_id, 'material' AS row_id, 'materials' AS registry, material AS doc,
  CASE material_status WHEN 'matched' THEN 'ok' WHEN 'partial_match' THEN 'partial' ELSE 'not_ok' END AS status FROM material_match JOIN drawings USING (part_id)
UNION ALL SELECT part_id, 'blank', 'blanks', blank_designation,
  CASE blank_status WHEN 'matched' THEN 'ok' WHEN 'partial_match' THEN 'partial' ELSE 'not_ok' END FROM blank_match JOIN drawings USING (part_id)
UNION ALL SELECT part_id, 'check-' || check_code, 'standard ' || standard_designation, actual_value,
  CASE status WHEN 'passed' THEN 'ok' WHEN 'violated' THEN 'not_ok' ELSE 'partial' END FROM all_checks WHERE status <> 'not_applicable'
UNION ALL SELECT part_id, 'check-numbering', 'standard ' || standard_designation, items::VARCHAR,
  CASE status WHEN 'passed' THEN 'ok' ELSE 'not_ok' END FROM numbering_check
UNION ALL SELECT part_id, 'requirement-' || pos, 'requirements', {q.category('text')},
  CASE WHEN {q.category('text')} IS NULL THEN 'unchecked' ELSE 'ok' END FROM tech_requirements
UNION ALL SELECT part_id, 'operation-' || sequence_no, 'equipment', model_name, CASE WHEN model_name IS NULL THEN 'not_ok' ELSE 'ok' END FROM route_ops)"""


def metal_rows(spark, d):
    return registry.metal_registry(spark, facts.drawings(spark, d), facts.tech_requirements(spark, d))


@add("u4_metal_registry", "SELECT * FROM metal_rows")
def _(spark, d):
    return metal_rows(spark, d)


FACT_SQL["chosen"] = """SELECT request_id AS part_id, rule_id, material_group_code, am_technology_code, min_infill, wall_count FROM options
  WHERE rule_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY priority, rule_id) = 1"""
FACT_SQL["chosen_plan"] = """
SELECT c.*, g.id AS am_material_group_id, t.id AS am_technology_id, ft.printer_type_id,
  (SELECT arg_min(model_name, id) FROM printer_model x WHERE x.printer_type_id = ft.printer_type_id) AS printer_model_name, m.trade_name,
  m.requires_heated_chamber OR m.requires_dry_storage AS special, '±' || printf('%g', tol_min) || '-' || printf('%g', tol_max) AS tolerance_mm,
  printf('%g', wall_min) || '-' || printf('%g', wall_max) AS wall_mm
FROM chosen c LEFT JOIN am_technology t ON t.code = c.am_technology_code
LEFT JOIN am_material_group g ON g.code = c.material_group_code AND g.am_technology_id = t.id
LEFT JOIN (SELECT am_material_group_id, min(printer_type_id) AS printer_type_id FROM printer_type_material_group GROUP BY 1) ft ON ft.am_material_group_id = g.id
LEFT JOIN am_material m ON m.id = (SELECT min(id) FROM am_material x WHERE x.am_material_group_id = g.id)
LEFT JOIN am_technology_tolerance tol ON tol.am_technology_id = t.id"""
FACT_SQL["plastic_rows"] = """
SELECT part_id, row_id, registry, coalesce(nullif(doc, ''), '—') AS project_doc, status FROM (
SELECT part_id, 'recommendation' AS row_id, 'recommendation' AS registry, material_group_code || ' · ' || am_technology_code AS doc, 'ok' AS status FROM chosen_plan
UNION ALL SELECT part_id, 'printer', 'equipment', printer_model_name, CASE WHEN printer_model_name IS NULL THEN 'not_ok' ELSE 'ok' END FROM chosen_plan
UNION ALL SELECT part_id, 'temperature', 'print parameters', coalesce(trade_name, material_group_code), CASE WHEN trade_name IS NULL THEN 'not_ok' ELSE 'ok' END FROM chosen_plan
UNION ALL SELECT part_id, 'special', 'print parameters', trade_name, 'partial' FROM chosen_plan WHERE special
UNION ALL SELECT part_id, 'infill', 'print parameters', material_group_code, 'ok' FROM chosen_plan WHERE min_infill IS NOT NULL OR wall_count IS NOT NULL
UNION ALL SELECT part_id, 'quality', 'technology tolerances', 'допуск ' || tolerance_mm || ', стенка ' || wall_mm, 'ok' FROM chosen_plan WHERE tolerance_mm IS NOT NULL
UNION ALL SELECT part_id, 'warning-' || row_number() OVER (PARTITION BY part_id ORDER BY o), 'planning remarks', w, 'not_ok' FROM (
  SELECT part_id, 1 AS o, 'no_model' AS w FROM chosen_plan WHERE printer_type_id IS NOT NULL AND printer_model_name IS NULL
  UNION ALL SELECT part_id, 2, 'no_profile' FROM chosen_plan WHERE am_material_group_id IS NOT NULL AND trade_name IS NULL))"""


def plastic_rows(spark, d):
    """The best recommended option of each request, planned as a print of the part."""
    best = pq.split_best(pq.recommendations(spark, d)).where("role = 'best'").select(
        F.col("request_id").alias("part_id"), "rule_id", "material_group_code", "am_technology_code", "min_infill", "wall_count",
        *[F.lit(None).cast("double").alias(c) for c in ("length_x", "length_y", "length_z")],
    )
    return registry.print_registry(printing.print_plans(spark, best))


@add("u5_print_registry", "SELECT * FROM plastic_rows")
def _(spark, d):
    return plastic_rows(spark, d)


BOTH = "(SELECT 'metal' AS kind, * FROM metal_rows UNION ALL SELECT 'plastic', * FROM plastic_rows)"


def both(spark, d):
    return metal_rows(spark, d).withColumn("kind", F.lit("metal")).unionByName(plastic_rows(spark, d).withColumn("kind", F.lit("plastic")))


@add("a7_status_counts", f"""SELECT kind, status, rows, CAST(floor(rows / sum(rows) OVER (PARTITION BY kind) * 100 + 0.5) AS BIGINT) AS percent FROM (
    SELECT k.kind, s.status, count(r.part_id) AS rows FROM (VALUES ('metal'), ('plastic')) k(kind)
    CROSS JOIN (VALUES ('ok'), ('not_ok'), ('partial'), ('unchecked')) s(status)
    LEFT JOIN {BOTH} r ON r.kind = k.kind AND r.status = s.status GROUP BY ALL)""")
def _(spark, d):
    return registry.count_by_status(both(spark, d), ["kind"])


@add("a9_registries", f"SELECT DISTINCT registry FROM {BOTH}")
def _(spark, d):
    return registry.registries(both(spark, d))


@add("f19_registry_filter", f"SELECT * FROM {BOTH} WHERE status = 'ok' AND registry = 'materials' AND contains(lower(concat_ws(' ', row_id, project_doc, registry)), 'гост 4543')")
def _(spark, d):
    return registry.filter_rows(both(spark, d), "ok", "materials", "ГОСТ 4543")


@add("p9_compliance_registry", f"SELECT kind, registry, status, count(*) AS rows FROM {BOTH} GROUP BY ALL")
def _(spark, d):
    return both(spark, d).groupBy("kind", "registry", "status").agg(F.count(F.lit(1)).alias("rows"))


SIMILARITY = "CASE WHEN part_id % 13 <> 0 THEN (part_id % 101) / 100e0 END"
FACT_SQL["assessed"] = f"""
SELECT p.part_id, 'metal' AS kind, (SELECT count(*) FROM group_route r WHERE r.material_group_id = p.material_group_id) AS op_count,
  (SELECT count(*) FROM route_warn w WHERE w.part_id = p.part_id) AS warning_count, {SIMILARITY} AS similarity FROM part_group p
UNION ALL SELECT b.part_id, 'plastic', CASE WHEN b.am_material_group_id IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM print_step s
    WHERE s.am_material_group_id = b.am_material_group_id) END, CASE WHEN am_technology_id IS NULL OR am_material_group_id IS NULL THEN 1
    ELSE (CASE WHEN printer_type_id IS NULL THEN 1 ELSE 0 END) + (CASE WHEN trade_name IS NULL THEN 1 ELSE 0 END) END, {SIMILARITY} FROM print_plan b"""
FACT_SQL["serial"] = """
SELECT *, op_count * 12e0 AS cycle_min, op_count * 350e0 AS unit_cost, CAST(printf('%.1f', op_count * 12e0 * 100 / 480) AS DOUBLE) AS batch_100_days,
  CASE WHEN warning_count > 1 THEN 'high' WHEN warning_count = 1 THEN 'medium' ELSE 'low' END AS risk, 2e0 + warning_count * 1.5e0 AS defect_percent,
  CASE WHEN similarity >= 0.8e0 THEN 'ok' WHEN similarity < 0.55e0 THEN 'defective' ELSE 'inconclusive' END AS verdict FROM assessed"""


def assessed(spark, d):
    similarity = F.when(F.col("part_id") % 13 != 0, (F.col("part_id") % 101) / F.lit(100.0)).alias("similarity")
    metal = route.with_warnings(spark, facts.drawings(spark, d)).select(
        "part_id", F.lit("metal").alias("kind"), "op_count", F.size("warnings").cast("bigint").alias("warning_count"), similarity
    )
    plans = pq.plans(spark, d)
    from partwright.sources.joins import lookup, settle

    steps = settle(printing.postprocessing_steps(spark).groupBy("am_material_group_id").agg(F.count(F.lit(1)).alias("steps")))
    group = F.col("am_material_group_id").isNotNull()
    warned = F.when(~group, F.lit(1)).otherwise(F.col("printer_type_id").isNull().cast("int") + F.col("trade_name").isNull().cast("int"))
    plastic = lookup(plans, steps, "am_material_group_id").select(
        "part_id", F.lit("plastic").alias("kind"),
        F.when(group, 1 + F.coalesce("steps", F.lit(0))).otherwise(0).cast("bigint").alias("op_count"), warned.cast("bigint").alias("warning_count"), similarity,
    )
    return metal.unionByName(plastic)


@add("a13_serial_plan", "SELECT part_id, kind, op_count, warning_count, similarity, cycle_min, unit_cost, batch_100_days, risk, defect_percent FROM serial")
def _(spark, d):
    return quality.serial_plan(assessed(spark, d))


@add("h26_verdict", "SELECT part_id, kind, verdict FROM serial")
def _(spark, d):
    return assessed(spark, d).select("part_id", "kind", quality.verdict(F.col("similarity")).alias("verdict"))


@add("p11_quality_report", """SELECT part_id, kind, verdict, coalesce(CAST(printf('%.4f', similarity) AS DOUBLE), 0) AS similarity,
    CASE WHEN verdict = 'ok' THEN cycle_min END AS cycle_min, CASE WHEN verdict = 'ok' THEN unit_cost END AS unit_cost,
    CASE WHEN verdict = 'ok' THEN batch_100_days END AS batch_100_days, CASE WHEN verdict = 'ok' THEN risk END AS risk,
    CASE WHEN verdict = 'ok' THEN defect_percent END AS defect_percent,
    CASE WHEN verdict = 'ok' THEN coalesce(nullif(concat_ws(',', CASE WHEN kind = 'metal' AND op_count > 3 THEN 'merge_operations' END,
      CASE WHEN kind = 'plastic' THEN 'parallel_printers' END, CASE WHEN warning_count > 0 THEN 'resolve_warnings' END), ''), 'no_suggestion')
     WHEN verdict = 'defective' AND kind = 'plastic' THEN 'check_print_parameters,check_postprocessing'
     WHEN verdict = 'defective' THEN 'check_machine_setup,check_tooling' ELSE '' END AS advice FROM serial""")
def _(spark, d):
    return quality.quality_report(assessed(spark, d)).withColumn("advice", F.array_join("advice", ","))


@add("p10_metal_schedule", """SELECT part_id, sequence_no AS step_no, op_name AS name, CASE WHEN starts_with(op_code, 'TURN') THEN 'lathe' WHEN starts_with(op_code, 'MILL')
    THEN 'mill' WHEN starts_with(op_code, 'DRILL') THEN 'drill' WHEN starts_with(op_code, 'GRIND') THEN 'grind' ELSE 'control' END AS icon,
    (sequence_no / 5 - 1) / n * 15000 AS start_ms, (sequence_no / 5) / n * 15000 AS end_ms
    FROM part_group JOIN (SELECT *, count(*) OVER (PARTITION BY material_group_id) AS n FROM group_route) USING (material_group_id)""")
def _(spark, d):
    out = quality.metal_schedule(spark, facts.drawings(spark, d))
    return out.withColumn("step_no", F.col("step_no").cast("bigint"))


@add("p10_print_schedule", """SELECT part_id, step_no, name, icon, start_ms, end_ms FROM (
    SELECT b.part_id, 1 AS step_no, 'Печать (' || am_technology_code || ')' AS name, CASE am_technology_code WHEN 'FDM' THEN 'fdm_printer' WHEN 'SLS' THEN 'sls_printer'
      ELSE 'resin_printer' END AS icon, 0e0 AS start_ms, 2e0 / (2 + (SELECT count(*) FROM print_step s WHERE s.am_material_group_id = b.am_material_group_id)) * 15000 AS end_ms
      FROM print_base b WHERE am_material_group_id IS NOT NULL
    UNION ALL SELECT part_id, step_no + 1, step_name, 'postprocessing', (1e0 + place) / (2 + n) * 15000, (2e0 + place) / (2 + n) * 15000
      FROM print_base JOIN (SELECT *, count(*) OVER (PARTITION BY am_material_group_id) AS n FROM print_step) USING (am_material_group_id))""")
def _(spark, d):
    return quality.print_schedule(spark, pq.plans(spark, d))


@add("h27_icon_by_prefix", """SELECT part_id, CASE WHEN starts_with(upper(am_technology_code), 'FDM') THEN 'fdm_printer' WHEN starts_with(upper(am_technology_code), 'SLA')
    OR starts_with(upper(am_technology_code), 'MSLA') THEN 'resin_printer' WHEN starts_with(upper(am_technology_code), 'SLS') THEN 'sls_printer'
    ELSE 'printer_generic' END AS icon FROM print_requests""")
def _(spark, d):
    return facts.print_requests(spark, d).select(
        "part_id", tx.first_prefix(F.col("am_technology_code"), quality.PRINT_ICONS, "printer_generic").alias("icon")
    )


@add("h34_decision_validation", f"""SELECT approval_id, decision, {q.strip('comment')} AS comment, CASE WHEN decision NOT IN ('approved', 'rejected') THEN 'unknown_decision'
    WHEN decision = 'rejected' AND coalesce({q.strip('comment')}, '') = '' THEN 'comment_required' ELSE 'valid' END AS validity FROM approvals""")
def _(spark, d):
    return quality.decisions(facts.approvals(spark, d))
