"""Faces and tool paths; parts and plans are the orders of ``lineitem``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from partwright.bindings import facts
from partwright.bindings.spec import FACT_SQL, REGISTRY
from partwright.functions import numbers as nx
from partwright.operators import features as ft
from partwright.operators import sequences as seq
from partwright.operators import toolpath as tp
from partwright.session import cut_lineage

add = REGISTRY.add
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
TOOL_DIAMETER_MM = 1.0


def unnumbered_moves(spark, d):
    """One move per line item: x quantity, y and z from the percentages, rapid where returned."""
    lines = facts.read(spark, d, "lineitem").select("l_orderkey", *LINE_ORDER, "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return lines.select(
        F.col("l_orderkey").alias("plan_id"), F.floor((F.col("l_linenumber") + 1) / 2).cast("int").alias("op_no"),
        F.when(F.col("l_returnflag") == "R", "rapid").otherwise("linear").alias("kind"), F.col("l_quantity").alias("x"),
        (F.round(F.col("l_discount") * 100) + 0.0).alias("y"), (F.round(F.col("l_tax") * 100) + 0.0).alias("z"),
        F.lit(TOOL_DIAMETER_MM).alias("tool_diameter"), *LINE_ORDER,
    )


def coarse_order():
    return [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 1000)]


def moves(spark, d):
    return seq.dense_position(unnumbered_moves(spark, d), ["plan_id"], coarse_order(), LINE_ORDER, "move_no").drop(*LINE_ORDER)


FACT_SQL["moves"] = f"""SELECT l_orderkey AS plan_id, CAST((l_linenumber + 1) // 2 AS INT) AS op_no,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS move_no,
  CASE WHEN l_returnflag = 'R' THEN 'rapid' ELSE 'linear' END AS kind, l_quantity AS x, round(l_discount * 100) + 0e0 AS y,
  round(l_tax * 100) + 0e0 AS z, {TOOL_DIAMETER_MM}e0 AS tool_diameter FROM lineitem"""
FACT_SQL["segs"] = """SELECT *, px IS NOT NULL AND kind <> 'rapid' AS cuts, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS len FROM (
  SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM moves WINDOW w AS (PARTITION BY plan_id, op_no ORDER BY move_no))"""
FACT_SQL["steps"] = "SELECT *, sum(CASE WHEN cuts THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id ORDER BY move_no ROWS UNBOUNDED PRECEDING)::BIGINT AS step FROM segs"
FACT_SQL["op_ranges"] = """SELECT plan_id, op_no, (sum(own) OVER w - own)::BIGINT AS start_step, (sum(own) OVER w)::BIGINT AS end_step, own FROM (
  SELECT plan_id, op_no, count(*) FILTER (kind <> 'rapid') AS own FROM moves GROUP BY ALL) WINDOW w AS (PARTITION BY plan_id ORDER BY op_no)"""
FACT_SQL["stock"] = "SELECT plan_id, min(x) - 3 AS x_min, max(x) + 3 AS x_max, min(y) - 3 AS y_min, max(y) + 3 AS y_max, min(z) AS z_min, max(z) AS z_max FROM moves GROUP BY plan_id"


@add("w9_path_length", "SELECT plan_id, op_no, round(coalesce(sum(len), 0), 6) AS length_mm FROM segs GROUP BY ALL")
def _(spark, d):
    return tp.path_lengths(moves(spark, d)).withColumn("length_mm", F.round("length_mm", 6))


@add("w10_step_ranges", "SELECT plan_id, op_no, start_step, end_step FROM op_ranges")
def _(spark, d):
    return tp.step_ranges(unnumbered_moves(spark, d))


@add("w11_time_boundaries", """SELECT plan_id, op_no, start_step / (CASE WHEN total = 0 THEN 1 ELSE total END) * 15000 AS start_ms,
    end_step / (CASE WHEN total = 0 THEN 1 ELSE total END) * 15000 AS end_ms FROM (SELECT *, sum(own) OVER (PARTITION BY plan_id) AS total FROM op_ranges)""")
def _(spark, d):
    weights = moves(spark, d).groupBy("plan_id", "op_no").agg(F.count_if(F.col("kind") != "rapid").alias("weight"))
    return tp.time_boundaries(weights)


@add("w12_global_steps", "SELECT plan_id, move_no, cuts, step FROM steps")
def _(spark, d):
    return tp.cutting_steps(moves(spark, d)).select("plan_id", "move_no", "cuts", "step")


@add("w15_active_operation", """SELECT p.plan_id, p.step, coalesce((SELECT min(op_no) FROM op_ranges r WHERE r.plan_id = p.plan_id AND p.step >= r.start_step
    AND p.step < r.end_step), (SELECT max(op_no) FROM op_ranges r WHERE r.plan_id = p.plan_id)) AS op_no
    FROM (SELECT o_orderkey AS plan_id, o_custkey % 6 AS step FROM orders) p WHERE p.plan_id IN (SELECT plan_id FROM op_ranges)""")
def _(spark, d):
    probes = facts.read(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"), (F.col("o_custkey") % 6).alias("step"))
    return tp.active_operation(probes, tp.step_ranges(unnumbered_moves(spark, d)))


BOX = ["plan_id", "x_min", "x_max", "y_min", "y_max", "z_min", "z_max"]


@add("h31_stock_box", f"SELECT {', '.join(BOX)} FROM stock")
def _(spark, d):
    return tp.expanded(tp.boxes(moves(spark, d), "plan_id")).select(BOX)


# ---- faces -----------------------------------------------------------------------------------
AXES = [(0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0), (0.02, -1.0, 0.0), (0.6, 0.8, 0.0)]
NORMALS = [(0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0), (0.0, 0.3, 0.95)]


def faces(spark, d):
    """Lines 1-4 are cylinders, 5-6 planes, 7 other faces; the face id is the place in the order."""
    lines = facts.read(spark, d, "lineitem").select("l_orderkey", *LINE_ORDER, "l_quantity", "l_returnflag")
    placed = seq.dense_position(lines, ["l_orderkey"], [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 1000)], LINE_ORDER, "face_id")
    cyl = F.col("l_linenumber") <= 4

    def component(i):
        axis = F.element_at(F.array(*[F.lit(a[i]) for a in AXES]), (F.col("l_partkey") % 5 + 1).cast("int"))
        normal = F.element_at(F.array(*[F.lit(a[i]) for a in NORMALS]), (F.col("l_partkey") % 4 + 1).cast("int"))
        return F.when(cyl, axis).otherwise(normal)

    return placed.select(
        F.col("l_orderkey").alias("part_id"), "face_id",
        F.when(cyl, "cylindrical").when(F.col("l_linenumber") <= 6, "planar").otherwise("other").alias("face_kind"),
        *[component(i).alias(n) for i, n in enumerate(("ax", "ay", "az"))],
        (F.col("l_suppkey") % 100).cast("double").alias("ox"), F.col("l_quantity").alias("oy"), (F.col("l_partkey") % 50).cast("double").alias("oz"),
        (F.col("l_quantity") / 2).alias("radius"), F.col("l_quantity").alias("height"),
        F.when(F.col("l_returnflag") == "R", math.pi).otherwise(2 * math.pi).alias("angular_extent"),
    )


def _component_sql(i):
    axes = ", ".join(f"{a[i]!r}e0" for a in AXES)
    normals = ", ".join(f"{a[i]!r}e0" for a in NORMALS)
    return (f"CASE WHEN l_linenumber <= 4 THEN list_extract([{axes}], CAST(l_partkey % 5 + 1 AS INT))"
            f" ELSE list_extract([{normals}], CAST(l_partkey % 4 + 1 AS INT)) END")


FACT_SQL["faces"] = f"""SELECT l_orderkey AS part_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS face_id,
  CASE WHEN l_linenumber <= 4 THEN 'cylindrical' WHEN l_linenumber <= 6 THEN 'planar' ELSE 'other' END AS face_kind,
  {_component_sql(0)} AS ax, {_component_sql(1)} AS ay, {_component_sql(2)} AS az, CAST(l_suppkey % 100 AS DOUBLE) AS ox, l_quantity AS oy,
  CAST(l_partkey % 50 AS DOUBLE) AS oz, l_quantity / 2 AS radius, l_quantity AS height,
  CASE WHEN l_returnflag = 'R' THEN pi() ELSE 2 * pi() END AS angular_extent FROM lineitem"""
FACT_SQL["axes"] = """SELECT *, CASE WHEN ax < -0.05e0 OR (abs(ax) <= 0.05e0 AND (ay < -0.05e0 OR (abs(ay) <= 0.05e0 AND az < -0.05e0))) THEN -1e0 ELSE 1e0 END AS sgn,
  face_kind = 'cylindrical' AND angular_extent >= 2 * pi() - 0.01e0 AS is_full FROM faces"""
FACT_SQL["summary"] = """SELECT f.part_id, coalesce(dom, 0) >= 3 AND coalesce(dom, 0) / cyl >= 0.4e0 AS revolved, coalesce(dom, 0) AS dominant,
  CASE WHEN cyl > 0 THEN coalesce(dom, 0) / cyl ELSE 0 END AS dominant_share, mill, hole, total FROM (
  SELECT part_id, count(*) AS total, count(*) FILTER (face_kind = 'cylindrical') AS cyl, count(*) FILTER (is_full) AS hole,
    count(*) FILTER (face_kind = 'planar' AND abs(az) >= 0.9e0) AS mill FROM axes GROUP BY part_id) f
  LEFT JOIN (SELECT part_id, max(n) AS dom FROM (SELECT part_id, printf('%.2f', ax * sgn + 0e0) AS kx, printf('%.2f', ay * sgn + 0e0) AS ky,
    printf('%.2f', az * sgn + 0e0) AS kz, count(*) AS n FROM axes WHERE is_full GROUP BY ALL) GROUP BY part_id) a USING (part_id)"""
FACT_SQL["face_box"] = """SELECT part_id, min(ox) AS x_min, max(ox) AS x_max, min(oy) AS y_min, max(oy) AS y_max, min(oz) AS z_min, max(oz) AS z_max FROM faces GROUP BY part_id"""
FACT_SQL["hole_rows"] = """SELECT part_id, face_id, CAST(printf('%.3f', 2 * radius) AS DOUBLE) AS diameter_mm, CAST(printf('%.3f', height) AS DOUBLE) AS depth_mm,
  coalesce(height >= 0.8e0 * CASE WHEN abs(ax) >= 0.9e0 THEN x_max - x_min WHEN abs(ay) >= 0.9e0 THEN y_max - y_min WHEN abs(az) >= 0.9e0 THEN z_max - z_min END, FALSE) AS through
  FROM axes JOIN face_box USING (part_id) WHERE is_full"""


def face_boxes(face_table):
    points = face_table.select("part_id", F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("oz").alias("z"))
    return tp.boxes(points, "part_id")


@add("a5_dominant_axis", "SELECT part_id, revolved, dominant, dominant_share FROM summary")
def _(spark, d):
    return ft.part_summary(faces(spark, d)).select("part_id", "revolved", "dominant", "dominant_share")


SUMMARY_SQL = """SELECT part_id, CASE WHEN revolved THEN 0 ELSE mill END AS millable, CASE WHEN revolved THEN 0 ELSE hole END AS holes,
    CASE WHEN revolved THEN total ELSE total - mill - hole END AS unrecognised, total AS total_faces, NOT revolved AND (mill > 0 OR hole > 0) AS supported FROM summary"""


@add("a6_feature_summary", SUMMARY_SQL)
def _(spark, d):
    return ft.part_summary(faces(spark, d)).drop("revolved", "dominant", "dominant_share")


@add("h40_feature_flags", f"SELECT part_id, millable + holes > 0 AS has_features FROM ({SUMMARY_SQL})")
def _(spark, d):
    return ft.part_summary(faces(spark, d)).select("part_id", (F.col("millable") + F.col("holes") > 0).alias("has_features"))


@add("h22_axis_key", "SELECT part_id, face_id, printf('%.2f', ax * sgn + 0e0) || ',' || printf('%.2f', ay * sgn + 0e0) || ',' || printf('%.2f', az * sgn + 0e0) AS axis FROM axes WHERE face_kind = 'cylindrical'")
def _(spark, d):
    cyl = faces(spark, d).where("face_kind = 'cylindrical'")
    return cyl.select("part_id", "face_id", ft.axis_key(F.col("ax"), F.col("ay"), F.col("az")).alias("axis"))


@add("h23_through_holes", "SELECT * FROM hole_rows")
def _(spark, d):
    table = faces(spark, d)
    return ft.holes(table, face_boxes(table))


@add("h24_full_turn", "SELECT part_id, face_id, is_full FROM axes WHERE face_kind = 'cylindrical'")
def _(spark, d):
    return faces(spark, d).where("face_kind = 'cylindrical'").select("part_id", "face_id", ft.full_turn(F.col("angular_extent")).alias("is_full"))


@add("p15_machining_features", """SELECT h.part_id, face_id, 'hole' AS feature, diameter_mm AS size_mm, through AS flag FROM hole_rows h JOIN summary s USING (part_id) WHERE NOT revolved
    UNION ALL SELECT part_id, face_id, 'facing', oz, az > 0 FROM faces JOIN summary USING (part_id) WHERE NOT revolved AND face_kind = 'planar' AND abs(az) >= 0.9e0""")
def _(spark, d):
    return part_features(spark, d)


def part_features(spark, d):
    table = cut_lineage(faces(spark, d))  # read four times
    holes = ft.holes(table, face_boxes(table)).select("part_id", "face_id", F.lit("hole").alias("feature"), F.col("diameter_mm").alias("size_mm"), F.col("through").alias("flag"))
    flats = ft.millable_faces(table).select("part_id", "face_id", F.lit("facing").alias("feature"), F.col("z_height_mm").alias("size_mm"), F.col("normal_up").alias("flag"))
    kept = ft.part_summary(table).where("NOT revolved").select("part_id")
    return holes.unionByName(flats).join(kept, "part_id", "left_semi")


TOOLS = """SELECT h.*, CASE WHEN dr.id IS NOT NULL THEN 'DRILL' ELSE 'MILL' END AS op_code, coalesce(dr.id, ml.id) AS tooling_id, coalesce(dr.diameter_mm, ml.diameter_mm) AS tool_diameter,
  CASE WHEN dr.id IS NULL AND ml.diameter_mm >= h.diameter_mm THEN 'no_small_tool' END AS tool_error, 1 + part_id % 5 AS material_group_id FROM hole_rows h
  LEFT JOIN (SELECT * FROM tooling WHERE tooling_type_id = 3 AND diameter_mm IS NOT NULL) dr ON abs(dr.diameter_mm - h.diameter_mm) < 0.5e0
  LEFT JOIN (SELECT * FROM tooling WHERE tooling_type_id = 4 AND diameter_mm IS NOT NULL) ml ON TRUE"""
FACT_SQL["tool_choice"] = TOOLS
FACT_SQL["tool_mode"] = """SELECT *, CAST(printf('%.1f', feed * spindle_rpm) AS DOUBLE) AS feed_mm_min FROM (SELECT *, CASE WHEN error_code IS NULL THEN
  CAST(round_even(1000 * v / (pi() * tool_diameter), 0) AS BIGINT) END AS spindle_rpm FROM (SELECT t.*, coalesce(t.tool_error, CASE WHEN f.cv IS NULL THEN 'no_formula'
    WHEN s.feed_min IS NULL THEN 'no_feed' END) AS error_code, (s.feed_min + s.feed_max) / 2 AS feed,
    f.cv / (pow(f.tool_life_min, f.m) * pow(coalesce((s.depth_min + s.depth_max) / 2, tool_diameter / 2), f.xv) * pow((s.feed_min + s.feed_max) / 2, f.yv)) * coalesce(g.machinability_index, 1) AS v
  FROM tool_choice t JOIN operation_type o ON o.code = t.op_code LEFT JOIN cutting_mode_formula f ON f.operation_type_id = o.id
  LEFT JOIN feed_reference s ON s.operation_type_id = o.id AND s.material_group_id = t.material_group_id LEFT JOIN material_group g ON g.id = t.material_group_id))"""


def chosen(spark, d):
    table = faces(spark, d)
    return tp.choose_tools(spark, ft.holes(table, face_boxes(table)).withColumn("material_group_id", 1 + F.col("part_id") % 5))


@add("j14_drill_or_mill", "SELECT part_id, face_id, diameter_mm, op_code, tooling_id, tool_diameter, tool_error FROM tool_choice")
def _(spark, d):
    return chosen(spark, d).drop("depth_mm", "through", "material_group_id")


@add("j13_nearest_tool", """SELECT part_id, face_id, (SELECT id FROM tooling WHERE diameter_mm IS NOT NULL ORDER BY abs(diameter_mm - h.diameter_mm), id LIMIT 1) AS nearest_id,
    (SELECT id FROM tooling WHERE diameter_mm IS NOT NULL ORDER BY diameter_mm DESC, id LIMIT 1) AS largest_id FROM hole_rows h""")
def _(spark, d):
    table = faces(spark, d)
    holes = ft.holes(table, face_boxes(table))
    nearest = tp.nearest_tool(holes, tp.tools(spark), "diameter_mm").select("diameter_mm", F.col("id").alias("nearest_id"))
    largest = tp.largest_tool(tp.tools(spark)).select(F.col("id").alias("largest_id"))
    return holes.join(nearest, "diameter_mm", "left").crossJoin(largest).select("part_id", "face_id", "nearest_id", "largest_id")  # one row


@add("f14_tools_with_diameter", "SELECT t.code, x.id, x.designation, x.diameter_mm, count(h.part_id) AS exact_holes FROM tooling x JOIN tooling_type t ON t.id = x.tooling_type_id"
     " LEFT JOIN hole_rows h ON abs(h.diameter_mm - x.diameter_mm) < 0.5e0 WHERE x.diameter_mm IS NOT NULL GROUP BY ALL")
def _(spark, d):
    table = faces(spark, d)
    sizes = ft.holes(table, face_boxes(table)).groupBy("diameter_mm").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("diameter_mm", "hole")
    cell = lambda c: F.floor(F.col(c) / tp.DRILL_MATCH_MM)
    near = sizes.withColumn("cell", F.explode(F.array(*[cell("hole") + i for i in (-1, 0, 1)])))
    known = tp.tools(spark).select(F.col("type_code").alias("code"), "id", F.col("name").alias("designation"), F.col("d").alias("diameter_mm"))
    hits = near.join(known.select("id", "diameter_mm", cell("diameter_mm").alias("cell")), "cell").where(F.abs(F.col("hole") - F.col("diameter_mm")) < tp.DRILL_MATCH_MM)
    hits = hits.groupBy("id").agg(F.sum("n").alias("exact_holes"))
    return known.join(hits, "id", "left").select("code", "id", "designation", "diameter_mm", F.coalesce("exact_holes", F.lit(0)).alias("exact_holes"))


@add("h18_tool_cutting_mode", "SELECT part_id, face_id, op_code, material_group_id, tool_diameter, error_code, spindle_rpm, feed_mm_min FROM tool_mode")
def _(spark, d):
    return tp.tool_cutting_mode(spark, chosen(spark, d)).drop("diameter_mm", "depth_mm", "through", "tooling_id", "tool_error")


@add("p16_hole_operations", """SELECT part_id, face_id, op_code, error_code, feed_mm_min, CASE WHEN error_code IS NULL THEN CASE WHEN op_code = 'MILL' THEN
    CAST(printf('%.2f', (pi() * diameter_mm + depth_mm) / feed_mm_min) AS DOUBLE) ELSE CAST(printf('%.2f', 2 * (n * 5e0 + 5e0 * n * (n - 1) / 2 + depth_mm) / feed_mm_min) AS DOUBLE) END END AS time_min
    FROM (SELECT *, CASE WHEN depth_mm > 3e0 * tool_diameter THEN ceil(depth_mm / 5e0) ELSE 1e0 END AS n FROM tool_mode)""")
def _(spark, d):
    out = tp.tool_cutting_mode(spark, chosen(spark, d))
    milled = tp.circular_time(F.col("diameter_mm"), F.col("depth_mm"), F.col("feed_mm_min"))
    drilled = tp.drilling_time(F.col("depth_mm"), F.col("tool_diameter"), F.col("feed_mm_min"))
    time = F.when(F.col("error_code").isNull(), F.when(F.col("op_code") == "MILL", milled).otherwise(drilled))
    return out.select("part_id", "face_id", "op_code", "error_code", "feed_mm_min", time.alias("time_min"))


@add("p16_path_statistics", """SELECT plan_id, op_no, start_step, end_step, CAST(printf('%.6f', length_mm) AS DOUBLE) AS length_mm, CAST(printf('%.2f', length_mm / 120) AS DOUBLE) AS time_min
    FROM op_ranges JOIN (SELECT plan_id, op_no, coalesce(sum(len), 0) AS length_mm FROM segs GROUP BY ALL) USING (plan_id, op_no)""")
def _(spark, d):
    passed = tp.scanned(unnumbered_moves(spark, d), coarse_order(), LINE_ORDER)
    return tp.path_statistics(passed).select(
        "plan_id", "op_no", "start_step", "end_step", nx.exact_round(F.col("length_mm"), 6).alias("length_mm"),
        nx.exact_round(F.col("length_mm") / 120, 2).alias("time_min"),
    )
