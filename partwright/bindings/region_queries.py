"""View regions: pages are suppliers, boxes are their line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwright.bindings import facts
from partwright.bindings.spec import FACT_SQL, REGISTRY
from partwright.operators import regions as rg

add = REGISTRY.add

FACT_SQL["rects"] = """SELECT l_suppkey AS page_id, l_orderkey * 8 + l_linenumber AS seq, (l_partkey % 250) * 3e0 AS x0, (l_orderkey % 250) * 3e0 AS y0,
  (l_partkey % 250) * 3e0 + 2 + l_quantity / 5 AS x1, (l_orderkey % 250) * 3e0 + CASE WHEN l_linenumber = 5 THEN 0 ELSE 2 + l_linenumber END AS y1 FROM lineitem"""
FACT_SQL["rect_ids"] = """SELECT *, row_number() OVER (ORDER BY page_id, x0, y0, x1, y1) AS id, CAST(floor(x0 / 15) AS BIGINT) AS sx, CAST(floor(y0 / 15) AS BIGINT) AS sy,
  CAST(floor(x0 / 30) AS BIGINT) AS gx, CAST(floor(y0 / 30) AS BIGINT) AS gy, x1 > x0 AND y1 > y0 AS area FROM rects"""
FACT_SQL["rect_pairs"] = """SELECT a.id AS a, b.id AS b, a.page_id, a.sx AS ax, a.sy AS ay, b.sx AS bx, b.sy AS "by", a.area AND b.area AS full_boxes FROM rect_ids a
  CROSS JOIN (SELECT i.r AS dx, j.r AS dy FROM range(-1, 2) i(r), range(-1, 2) j(r)) o
  JOIN rect_ids b ON b.page_id = a.page_id AND b.gx = a.gx + o.dx AND b.gy = a.gy + o.dy AND a.id <> b.id
    AND a.x0 - 15 < b.x1 AND b.x0 < a.x1 + 15 AND a.y0 - 15 < b.y1 AND b.y0 < a.y1 + 15
    AND (a.area AND b.area OR a.area AND NOT b.area AND a.seq > b.seq OR b.area AND NOT a.area AND b.seq > a.seq)"""
FACT_SQL["protos"] = """WITH RECURSIVE lab(id, c) USING KEY (id) AS (SELECT id, id FROM rect_ids
    UNION SELECT p.a, min(l.c) FROM lab l JOIN rect_pairs p ON p.b = l.id JOIN recurring.lab o ON o.id = p.a WHERE l.c < o.c GROUP BY p.a)
  SELECT r.page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS members, l.c AS pid FROM lab l JOIN rect_ids r USING (id) GROUP BY r.page_id, l.c HAVING count(*) >= 8"""
FACT_SQL["merged_regions"] = """WITH RECURSIVE d AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS diag FROM protos),
  near AS (SELECT a.pid AS a, b.pid AS b FROM d a JOIN d b ON a.page_id = b.page_id AND a.pid <> b.pid AND a.x0 - 0.3e0 * least(a.diag, b.diag) < b.x1 AND b.x0 < a.x1 + 0.3e0 * least(a.diag, b.diag)
    AND a.y0 - 0.3e0 * least(a.diag, b.diag) < b.y1 AND b.y0 < a.y1 + 0.3e0 * least(a.diag, b.diag)),
  lab2(pid, c) USING KEY (pid) AS (SELECT pid, pid FROM protos UNION SELECT n.a, min(l.c) FROM lab2 l JOIN near n ON n.b = l.pid JOIN recurring.lab2 o ON o.pid = n.a WHERE l.c < o.c GROUP BY n.a)
  SELECT p.page_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM lab2 l JOIN protos p USING (pid) GROUP BY p.page_id, l.c"""
FACT_SQL["counted_regions"] = """SELECT g.page_id, g.x0, g.y0, g.x1, g.y1, count(*) AS element_count FROM merged_regions g JOIN rects r ON r.page_id = g.page_id
  AND r.x0 < g.x1 AND g.x0 < r.x1 AND r.y0 < g.y1 AND g.y0 < r.y1 AND r.x1 > r.x0 AND r.y1 > r.y0 GROUP BY ALL"""


def rects(spark, d):
    """One box per line item; every fifth line of an order is a stroke."""
    x, y = (F.col("l_partkey") % 250) * 3.0, (F.col("l_orderkey") % 250) * 3.0
    height = F.when(F.col("l_linenumber") == 5, 0).otherwise(2 + F.col("l_linenumber"))
    return facts.read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("page_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        x.alias("x0"), y.alias("y0"), (x + 2 + F.col("l_quantity") / 5).alias("x1"), (y + height).alias("y1"),
    )


@add("j21_linked_cells", 'SELECT DISTINCT page_id, ax, ay, bx, "by" FROM rect_pairs WHERE full_boxes AND (bx > ax OR (bx = ax AND "by" > ay))')
def _(spark, d):
    table = rects(spark, d)
    return rg.linked_subcells(table)


@add("a14_cluster_boxes", "SELECT page_id, x0, y0, x1, y1, members FROM protos")
def _(spark, d):
    table = rects(spark, d)
    return rg.clusters(spark, table).withColumn("members", F.col("members").cast("bigint"))


@add("a15_members_per_region", "SELECT * FROM counted_regions")
def _(spark, d):
    table = rects(spark, d)
    return rg.members_per_region(rg.merged(spark, rg.clusters(spark, table)), table)


REGIONS = """SELECT * EXCLUDE (largest) FROM (SELECT *, (x1 - x0) * (y1 - y0) AS area, max((x1 - x0) * (y1 - y0)) OVER (PARTITION BY page_id) AS largest FROM {t}) WHERE area >= largest * 0.001e0"""


@add("a16_noise_cut", REGIONS.replace("{t}", "(SELECT page_id, x0, y0, x1, y1 FROM rects)").replace("* 0.001e0", "* 0.3e0").replace("SELECT * EXCLUDE (largest)", "SELECT page_id, count(*) AS kept, round(sum(area), 6) AS area")
     + " GROUP BY page_id")
def _(spark, d):
    kept = rg.without_noise(rects(spark, d), 0.3)
    return kept.groupBy("page_id").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("area"), 6).alias("area"))


@add("p13_view_regions", REGIONS.replace("{t}", "counted_regions"))
def _(spark, d):
    table = rects(spark, d)
    return rg.view_regions(spark, table)


@add("t5_regions_by_area", REGIONS.replace("{t}", "counted_regions").replace("SELECT * EXCLUDE (largest)", "SELECT page_id, area, element_count") + " ORDER BY area DESC")
def _(spark, d):
    table = rects(spark, d)
    return rg.view_regions(spark, table).select("page_id", "area", "element_count")
