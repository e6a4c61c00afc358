"""Keyword search of user questions, and silhouettes from embeddings read as 8x8 pictures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwright.bindings import facts
from partwright.bindings import sqlfrag as q
from partwright.bindings.spec import FACT_SQL, REGISTRY
from partwright.functions import numbers as nx
from partwright.operators import search as se
from partwright.operators import silhouette as si
from partwright.plans import quality
from partwright.sources import reference

add = REGISTRY.add
# (rank, table, row id, searched columns, summary columns). The tables of the reference come first, in the order the
# assistant asks them; then the driver's tables, whole texts included.
REFERENCE_TARGETS = [
    (1, "material", "id", ["grade", "gost_standard", "application", "chemical_composition"], ["grade", "gost_standard", "application", "machinability_index"]),
    (2, "equipment_model", "id", ["model_name", "control_system"], ["model_name", "control_system"]),
    (3, "tooling", "id", ["designation"], ["designation"]),
    (4, "operation_type", "id", ["code", "name", "gost_code"], ["code", "name"]),
    (5, "workpiece_type", "id", ["code", "name"], ["code", "name"]),
    (6, "am_material", "id", ["trade_name"], ["trade_name"]),
    (7, "am_technology", "id", ["code", "name"], ["code", "name"]),
    (8, "printer_model", "id", ["model_name"], ["model_name"]),
    (9, "part_application_class", "id", ["code", "name"], ["code", "name"]),
]
TARGETS = [
    (10, "part", "p_partkey", ["p_name", "p_brand", "p_type"], ["p_name", "p_brand", "p_type"]),
    (11, "supplier", "s_suppkey", ["s_name"], ["s_name", "s_nationkey"]),
    (12, "nation", "n_nationkey", ["n_name"], ["n_name"]),
    (13, "region", "r_regionkey", ["r_name"], ["r_name"]),
    (14, "benchmark", "item_id", ["text"], ["item_id"]),
    (15, "pages", "page_id", ["url", "html"], ["url"]),
    (16, "documents", "doc_id", ["text"], ["lang", "source"]),
]
FACT_SQL["idx"] = " UNION ALL ".join(
    f"SELECT {rank} AS table_rank, '{name}' AS table_name, CAST({key} AS BIGINT) AS row_id, lower({c}) AS text, concat_ws(' · ', {', '.join(s)}) AS summary FROM {name}"
    for rank, name, key, cols, s in REFERENCE_TARGETS + TARGETS for c in cols
)
FACT_SQL["asked"] = f"SELECT DISTINCT conv_id, turn, unnest({q.keywords('text')}) AS keyword FROM conversations WHERE role = 'user'"
FACT_SQL["kw_row"] = """SELECT keyword, table_rank, row_id FROM (SELECT DISTINCT keyword FROM asked) k JOIN (SELECT DISTINCT table_rank, row_id, text FROM idx) i
  ON i.text LIKE '%' || k.keyword || '%' GROUP BY ALL"""
FACT_SQL["found"] = """SELECT conv_id, turn, place, table_name, row_id, summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY table_rank, row_id) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, table_rank ORDER BY row_id) AS in_table FROM (SELECT DISTINCT conv_id, turn, table_rank, row_id FROM asked JOIN kw_row USING (keyword)))
  WHERE in_table <= 3) JOIN (SELECT DISTINCT table_rank, table_name, row_id, summary FROM idx) USING (table_rank, row_id) WHERE place <= 6"""
KEYS = ["conv_id", "turn"]


def index(spark, d):
    parts = [se.index_of(reference.load(spark, target[1]), *target) for target in REFERENCE_TARGETS]
    parts += [se.index_of(facts.read(spark, d, name), rank, name, key, cols, s) for rank, name, key, cols, s in TARGETS]
    return reduce(DataFrame.unionByName, parts)


def questions(spark, d):
    return facts.read(spark, d, "conversations").where("role = 'user'").select(*KEYS, F.col("text").alias("question"))


def asked(spark, d):
    from partwright.functions import text as tx

    return questions(spark, d).select(*KEYS, F.explode(F.array_distinct(tx.keywords(F.col("question")))).alias("keyword"))


@add("h12_keyword_match", "SELECT keyword, table_rank, row_id FROM (SELECT *, row_number() OVER (PARTITION BY keyword, table_rank ORDER BY row_id) AS rn FROM kw_row) WHERE rn <= 3")
def _(spark, d):
    return se.keyword_hits(asked(spark, d), index(spark, d))


@add("t2_rows_per_table", "SELECT conv_id, turn, table_name, count(*) AS rows FROM found GROUP BY ALL")
def _(spark, d):
    return se.search(questions(spark, d), index(spark, d), KEYS).groupBy(*KEYS, "table_name").agg(F.count(F.lit(1)).alias("rows"))


@add("t3_rows_per_question", "SELECT conv_id, turn, count(*) AS rows FROM found GROUP BY ALL")
def _(spark, d):
    return se.search(questions(spark, d), index(spark, d), KEYS).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"))


@add("p8_reference_search", "SELECT conv_id, turn, CAST(place AS INT) AS place, table_name, row_id, summary FROM found")
def _(spark, d):
    return se.search(questions(spark, d), index(spark, d), KEYS)


@add("h37_template_answer", f"""SELECT c.conv_id, c.turn, coalesce('{se.FOUND_TEXT} (' || n || '):' || chr(10) || ls, '{se.NO_MATCH_TEXT}') AS answer FROM (SELECT conv_id, turn FROM conversations WHERE role = 'user') c
    LEFT JOIN (SELECT conv_id, turn, count(*) AS n, string_agg('— ' || table_name || ' · ' || summary, chr(10) ORDER BY place) AS ls FROM found GROUP BY ALL) USING (conv_id, turn)""")
def _(spark, d):
    asks = questions(spark, d)
    return se.answers(asks.select(*KEYS), se.search(asks, index(spark, d), KEYS), KEYS)


# ---- silhouettes -----------------------------------------------------------------------------
SIDE = 8
CANVAS, TARGET = 32, 17.0  # the default canvas in proportion to 8x8 pictures
FACT_SQL["pixel"] = f"""SELECT vec_id AS photo_id, label, CAST(ix % {SIDE} AS INT) AS x, CAST(ix // {SIDE} AS INT) AS y,
  CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 0.6e0) / 1.2e0 * 255))) AS INT) AS grey FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS ix FROM embeddings)"""
FACT_SQL["otsu"] = """SELECT photo_id, arg_max(grey, (CASE WHEN total > below THEN (sum_below * total - sum_all * below) * (sum_below * total - sum_all * below) / (below * (total - below)) ELSE 0 END, -grey)) AS threshold
  FROM (SELECT photo_id, grey, CAST(sum(n) OVER w AS DOUBLE) AS below, CAST(sum(n * grey) OVER w AS DOUBLE) AS sum_below, CAST(sum(n) OVER p AS DOUBLE) AS total, CAST(sum(n * grey) OVER p AS DOUBLE) AS sum_all
    FROM (SELECT photo_id, grey, count(*) AS n FROM pixel GROUP BY ALL) WINDOW w AS (PARTITION BY photo_id ORDER BY grey ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY photo_id)) GROUP BY photo_id"""
# The silhouette: light pixels reached from the border over edges lie outside; the rest, linked over edges and corners,
# falls into parts, of which the largest is kept.
FACT_SQL["lit_pixel"] = "SELECT photo_id, label, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, grey <= threshold AS dark, y * 1000 + x AS px FROM pixel JOIN otsu USING (photo_id)"
FACT_SQL["sea_pixel"] = f"""WITH RECURSIVE flood AS (SELECT photo_id, x, y FROM lit_pixel WHERE NOT dark AND (x IN (0, {SIDE - 1}) OR y IN (0, {SIDE - 1}))
  UNION SELECT l.photo_id, l.x, l.y FROM flood f JOIN (SELECT * FROM lit_pixel WHERE NOT dark) l ON l.photo_id = f.photo_id AND abs(l.x - f.x) + abs(l.y - f.y) = 1) SELECT * FROM flood"""
FACT_SQL["land_pixel"] = "SELECT * FROM lit_pixel ANTI JOIN sea_pixel USING (photo_id, x, y)"
FACT_SQL["land_label"] = """WITH RECURSIVE part_of(photo_id, px, c) USING KEY (photo_id, px) AS (SELECT photo_id, px, px FROM land_pixel
    UNION SELECT b.photo_id, b.px, min(l.c) FROM part_of l JOIN land_pixel a ON a.photo_id = l.photo_id AND a.px = l.px
      JOIN land_pixel b ON b.photo_id = a.photo_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 JOIN recurring.part_of o ON o.photo_id = b.photo_id AND o.px = b.px WHERE l.c < o.c GROUP BY b.photo_id, b.px)
  SELECT photo_id, px, c FROM part_of"""
FACT_SQL["dark"] = """SELECT photo_id, label, x, y FROM land_pixel JOIN land_label USING (photo_id, px)
  JOIN (SELECT photo_id, arg_max(c, (n, -c)) AS c FROM (SELECT photo_id, c, count(*) AS n FROM land_label GROUP BY ALL) GROUP BY photo_id) USING (photo_id, c)"""
FACT_SQL["shape"] = f"SELECT photo_id, count(*) AS area, avg(x) AS cx, avg(y) AS cy, {TARGET}e0 / (2 * sqrt(count(*) / pi())) AS scale FROM dark GROUP BY photo_id"
FACT_SQL["pair"] = "SELECT vec_id AS photo_id, min(vec_id) OVER (PARTITION BY label) AS ref_id FROM embeddings"
_turns = ", ".join(f"({a}, {c!r}e0, {s!r}e0)" for a, (c, s) in zip(si.ANGLES, si.TURNS))
FACT_SQL["turned"] = f"""WITH canvas AS (SELECT a.r - {CANVAS / 2}e0 AS dx, b.r - {CANVAS / 2}e0 AS dy, a.r * 1000 + b.r AS px FROM range({CANVAS}) a(r), range({CANVAS}) b(r)),
  fixed AS (SELECT s.photo_id AS ref_id, c.px FROM (SELECT * FROM shape WHERE photo_id IN (SELECT ref_id FROM pair)) s CROSS JOIN canvas c
    JOIN dark k ON k.photo_id = s.photo_id AND k.x = floor(s.cx + c.dx / s.scale + 0.5) AND k.y = floor(s.cy + c.dy / s.scale + 0.5)),
  moved AS (SELECT s.photo_id, t.angle, c.px FROM shape s CROSS JOIN (VALUES {_turns}) t(angle, co, si) CROSS JOIN canvas c
    JOIN dark k ON k.photo_id = s.photo_id AND k.x = floor(s.cx + (c.dx * t.co - c.dy * t.si) / s.scale + 0.5) AND k.y = floor(s.cy + (c.dx * t.si + c.dy * t.co) / s.scale + 0.5)),
  scores AS (SELECT m.photo_id, p.ref_id, m.angle, count(f.px) / (count(*) + (SELECT count(*) FROM fixed x WHERE x.ref_id = p.ref_id) - count(f.px)) AS score FROM moved m JOIN pair p USING (photo_id)
    LEFT JOIN fixed f ON f.ref_id = p.ref_id AND f.px = m.px GROUP BY m.photo_id, p.ref_id, m.angle)
  SELECT photo_id, ref_id, max(score) AS score, CAST(arg_max(angle, (score, -angle)) AS INT) AS angle FROM scores GROUP BY photo_id, ref_id"""


def pixels(spark, d):
    cells = facts.read(spark, d, "embeddings").select(F.col("vec_id").alias("photo_id"), F.posexplode("embedding").alias("at", "v"))
    grey = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 0.6) / 1.2 * 255))).cast("int")
    return cells.select("photo_id", (F.col("at") % SIDE).alias("x"), F.floor(F.col("at") / SIDE).cast("int").alias("y"), grey.alias("grey"))


def photo_masks(spark, d):
    table = pixels(spark, d)
    return si.masks(table, si.otsu_thresholds(table))


def pairs(spark, d):
    """Every picture against the first picture of its label."""
    photos = facts.read(spark, d, "embeddings").select(F.col("vec_id").alias("photo_id"), "label")
    first = photos.groupBy("label").agg(F.min("photo_id").alias("ref_id"))

    return photos.join(first, "label").select("photo_id", "ref_id")


@add("a17_otsu_threshold", "SELECT * FROM otsu")
def _(spark, d):
    return si.otsu_thresholds(pixels(spark, d))


@add("a18_silhouette_shape", "SELECT photo_id, area, cx, cy, scale FROM shape")
def _(spark, d):
    return si.shapes(photo_masks(spark, d), TARGET)


@add("a19_mask_iou", """SELECT p.photo_id, p.ref_id, (SELECT count(*) FROM dark a JOIN dark b ON a.x = b.x AND a.y = b.y WHERE a.photo_id = p.photo_id AND b.photo_id = p.ref_id) AS common,
    s.area + r.area AS areas FROM pair p JOIN shape s ON s.photo_id = p.photo_id JOIN shape r ON r.photo_id = p.ref_id""".replace("SELECT p.photo_id", "SELECT photo_id, ref_id, common / (areas - common) AS iou FROM (SELECT p.photo_id", 1) + ")")
def _(spark, d):
    return si.mask_overlap(pairs(spark, d), photo_masks(spark, d))


def rotated(spark, d):
    return si.best_rotations(pairs(spark, d), si.rasters(photo_masks(spark, d), SIDE, TARGET), SIDE, SIDE, CANVAS)


@add("w13_best_rotation", "SELECT photo_id, ref_id, score, angle FROM turned")
def _(spark, d):
    return rotated(spark, d)


@add("p17_silhouette_comparison", """SELECT photo_id, ref_id, CAST(printf('%.4f', score) AS DOUBLE) AS similarity, CASE WHEN score >= 0.8e0 THEN 'ok' WHEN score < 0.55e0 THEN 'defective'
    ELSE 'inconclusive' END AS verdict FROM turned""")
def _(spark, d):
    return rotated(spark, d).select(
        "photo_id", "ref_id", F.coalesce(nx.exact_round(F.col("score"), 4), F.lit(0.0)).alias("similarity"), quality.verdict(F.col("score")).alias("verdict")
    )
