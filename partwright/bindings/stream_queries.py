"""Streams over ``events``: submitted drawings and zone readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwright.bindings import facts
from partwright.bindings import review_queries  # noqa: F401 - registers the fact statements used below
from partwright.bindings.spec import FACT_SQL, REGISTRY
from partwright.plans import review
from partwright.streaming import reviews, runs, zones

add = REGISTRY.add

READING = ["user_id % 10 AS zone_id", "ts", "event_id AS reading_id"]
# The table holds zone-less times meant as UTC; event time needs an instant, whatever the session's zone.
INSTANT = "CAST(convert_timezone('UTC', current_timezone(), ts) AS TIMESTAMP) AS ts"
STATUS = "CASE event_type WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'alert' WHEN 'error' THEN 'offline' ELSE 'online' END AS status"
FACT_SQL["reading"] = f"SELECT {', '.join(READING)}, {STATUS}, value AS load FROM events"
FACT_SQL["zone_window"] = """SELECT zone_id, epoch_us(ts) // 3500000 * 3500 AS window_ms, arg_max(status, (ts, reading_id)) AS status,
  CASE WHEN count(*) FILTER (status <> 'offline') > 0 THEN least(99e0, greatest(40e0, arg_max(load, (ts, reading_id)) FILTER (status <> 'offline'))) END AS own_load
  FROM reading GROUP BY ALL"""
FACT_SQL["zone_load"] = """SELECT zone_id, window_ms, status, last_value(own_load IGNORE NULLS) OVER (PARTITION BY zone_id ORDER BY window_ms
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS load FROM zone_window"""


def as_readings(events):
    return events.selectExpr("user_id % 10 AS zone_id", INSTANT, "event_id AS reading_id", STATUS, "value AS load")


@add("h33_load_clamp", "SELECT reading_id, status, CASE WHEN status = 'offline' THEN load ELSE least(99e0, greatest(40e0, load)) END AS load FROM reading")
def _(spark, d):
    return zones.clamped(as_readings(facts.read(spark, d, "events"))).select("reading_id", "status", "load")


@add("r2_zone_load_batch", "SELECT * FROM zone_load")
def _(spark, d):
    return zones.hold_last(zones.window_loads(as_readings(facts.read(spark, d, "events"))))


@add("r2_zone_load_stream", "SELECT * FROM zone_load")
def _(spark, d):
    schema = facts.read(spark, d, "events").schema
    return zones.load_stream(as_readings(runs.source(spark, d, "events.parquet", schema)))


FACT_SQL["submitted"] = f"SELECT event_id AS part_id, {facts.title_block_sql('event_id', 'event_type')} FROM events"


def _for_submissions(name: str) -> str:
    """The same statement over ``submitted`` in place of ``drawings``."""
    return FACT_SQL[name].replace("drawings", "submitted")


FACT_SQL["sub_material"] = _for_submissions("material_match")
FACT_SQL["sub_blank"] = _for_submissions("blank_match")
FACT_SQL["sub_scale"] = _for_submissions("scale_check")
FACT_SQL["sub_title"] = _for_submissions("title_check")
FACT_SQL["sub_reference"] = _for_submissions("reference_check")
STREAM_FINDINGS = """
SELECT part_id, 1 AS rank, 'blocking' AS severity, 'material_not_found' AS finding_code, nullif(material, '') AS arg FROM sub_material JOIN submitted USING (part_id) WHERE material_status = 'not_found'
UNION ALL SELECT part_id, 1, 'warning', 'material_partial', matched_grade FROM sub_material WHERE material_status = 'partial_match'
UNION ALL SELECT part_id, 2, 'warning', 'blank_not_found', nullif(blank_designation, '') FROM sub_blank JOIN submitted USING (part_id) WHERE blank_status = 'not_found'
UNION ALL SELECT part_id, 2, 'info', 'blank_partial', blank_reason FROM sub_blank WHERE blank_status = 'partial_match'
UNION ALL SELECT part_id, rank, CASE WHEN status = 'violated' THEN 'warning' ELSE 'info' END, check_code || '_' || status, actual_value FROM (
  SELECT part_id, check_code, status, actual_value, 5 AS rank FROM sub_reference UNION ALL SELECT part_id, check_code, status, actual_value, 6 FROM sub_scale
  UNION ALL SELECT part_id, check_code, status, actual_value, 6 + field_pos FROM sub_title) WHERE status IN ('violated', 'needs_review')"""


def as_submissions(events):
    return events.select(F.col("event_id").alias("part_id"), F.expr(INSTANT), *facts.title_block(F.col("event_id"), F.col("event_type")))


@add("r1_continuous_review_stream", STREAM_FINDINGS)
def _(spark, d):
    schema = facts.read(spark, d, "events").schema
    drawings = as_submissions(runs.source(spark, d, "events.parquet", schema))
    return reviews.review_stream(spark, drawings)


@add("r1_continuous_review_batch", STREAM_FINDINGS)
def _(spark, d):
    return review.drawing_findings(spark, as_submissions(facts.read(spark, d, "events")))


