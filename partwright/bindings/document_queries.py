"""STEP texts derived from parts; pages, words and numbered texts derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwright.bindings import facts
from partwright.bindings.spec import FACT_SQL, REGISTRY
from partwright.functions import text as tx
from partwright.operators import layout as ly
from partwright.operators import step as st
from partwright.session import cut_lineage

add = REGISTRY.add

# ---- STEP ------------------------------------------------------------------------------------
ESCAPED_NAME = "\\X2\\0414043504420430043B044C\\X0\\"  # «Деталь»


def step_files(spark, d):
    """A STEP text per part, every fourth one in Windows-1251; points, faces and style chains follow from the columns."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    points = F.transform(F.sequence(F.lit(1), (3 + size % 4).cast("int")), lambda i: cat(
        "#", text(i + 100), "=CARTESIAN_POINT('',(", text(key % 100 + i), ".5,-", text(size * i), ".25, ", text(i * 3), ".));\n"))
    faces = F.transform(F.sequence(F.lit(0), (key % 3).cast("int")), lambda f: cat(
        "#", text(f + 200), "=ADVANCED_FACE('',(#1),#2,.T.);\n",
        "#", text(f + 300), "=STYLED_ITEM('',(#", text(f + 310), "),#", text(f + 200), ");\n",
        "#", text(f + 310), "=PRESENTATION_STYLE_ASSIGNMENT((#", text(f + 320), "));\n",
        "#", text(f + 320), "=SURFACE_STYLE_USAGE(.BOTH.,#", text(f + 330), ");\n",
        "#", text(f + 330), "=SURFACE_SIDE_STYLE('',(#", F.when((key % 7 == 0) & (f == 0), "999").otherwise(text(f + 340)), "));\n",
        "#", text(f + 340), "=SURFACE_STYLE_FILL_AREA(#", text(f + 350), ");\n",
        "#", text(f + 350), "=FILL_AREA_STYLE('',(#", text(f + 360), "));\n",
        "#", text(f + 360), "=FILL_AREA_STYLE_COLOUR('',#", text(f + 370), ");\n",
        "#", text(f + 370), "=COLOUR_RGB('',0.", text(f + 1), ",0.5,", text(key % 2), ".);\n"))
    again = F.when(key % 5 == 0, "#370=COLOUR_RGB('',0.9,0.9,0.9);\n").otherwise("")
    software = F.when(key % 4 == 0, "КОМПАС-3D v21").otherwise("SolidWorks 2020")
    whole = cat("ISO-10303-21;\nFILE_NAME('part.stp','", software, "');\n#1=PRODUCT('", text(key), "','", ESCAPED_NAME, " ", text(key), "');\n",
                F.array_join(points, ""), F.array_join(faces, ""), again, "END-ISO-10303-21;\n")
    content = F.when(key % 4 == 0, tx.to_windows_1251(whole)).otherwise(F.encode(whole, "utf-8"))
    # Rows of part are small and lie in few splits; the texts made of them are not.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return facts.read(spark, d, "part").select("p_partkey", "p_size").repartition(tasks).select(key.alias("file_id"), content.alias("content"))


def step_texts(spark, d):
    return step_files(spark, d).select("file_id", tx.decode_step_escapes(tx.decode_step_bytes(F.col("content"))).alias("text"))


@add("s10_step_text_decoding", """SELECT p_partkey AS file_id, CASE WHEN p_partkey % 4 = 0 THEN 'КОМПАС-3D v21' ELSE 'SolidWorks 2020' END AS software FROM part""")
def _(spark, d):
    return st.headers(step_texts(spark, d)).select("file_id", "software")


@add("h15_step_escapes", "SELECT p_partkey AS file_id, 'Деталь ' || p_partkey AS product_name FROM part")
def _(spark, d):
    return st.headers(step_texts(spark, d)).select("file_id", "product_name")


@add("a3_face_count", "SELECT p_partkey AS file_id, 1 + p_partkey % 3 AS face_count FROM part")
def _(spark, d):
    texts = step_texts(spark, d)
    return st.face_counts(texts, st.entities(texts))


POINTS = """SELECT p_partkey AS file_id, i, (p_partkey % 100 + i) + 0.5e0 AS x, -(p_size * i + 0.25e0) AS y, i * 3e0 AS z
  FROM (SELECT *, unnest(range(1, 4 + p_size % 4)) AS i FROM part)"""


@add("h16_step_points", f"SELECT file_id, x, y, z FROM ({POINTS})")
def _(spark, d):
    points = st.matches(st.entities(step_texts(spark, d)), st.POINT, ["x", "y", "z"])
    return points.select("file_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])


BOX = """SELECT file_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max,
  max(x) - min(x) AS length_x, max(y) - min(y) AS length_y, max(z) - min(z) AS length_z FROM (""" + POINTS + ") GROUP BY file_id"


@add("a2_bounding_box", BOX)
def _(spark, d):
    return st.bounding_boxes(st.entities(step_texts(spark, d)))


COLOURS = """SELECT p_partkey AS file_id, 200 + f AS face_ref, CASE WHEN f = 0 AND p_partkey % 5 = 0 THEN 0.9e0 ELSE (f + 1) / 10e0 END AS r,
  CASE WHEN f = 0 AND p_partkey % 5 = 0 THEN 0.9e0 ELSE 0.5e0 END AS g, CASE WHEN f = 0 AND p_partkey % 5 = 0 THEN 0.9e0 ELSE CAST(p_partkey % 2 AS DOUBLE) END AS b
  FROM (SELECT *, unnest(range(0, 1 + p_partkey % 3)) AS f FROM part) WHERE NOT (p_partkey % 7 = 0 AND f = 0)"""


@add("j19_face_colours", COLOURS)
def _(spark, d):
    return st.face_colours(cut_lineage(st.entities(step_texts(spark, d))))


@add("h40_colour_flags", f"SELECT p_partkey AS file_id, count(c.file_id) > 0 AS has_colours FROM part LEFT JOIN ({COLOURS}) c ON c.file_id = p_partkey GROUP BY p_partkey")
def _(spark, d):
    texts = step_texts(spark, d)
    coloured = st.face_colours(cut_lineage(st.entities(texts))).select("file_id").distinct().withColumn("has_colours", F.lit(True))
    return texts.select("file_id").join(coloured, "file_id", "left").select("file_id", F.coalesce("has_colours", F.lit(False)).alias("has_colours"))


@add("p14_step_summary", f"""SELECT p_partkey AS file_id, 'Деталь ' || p_partkey AS product_name, CASE WHEN p_partkey % 4 = 0 THEN 'КОМПАС-3D v21' ELSE 'SolidWorks 2020' END AS software,
    1 + p_partkey % 3 AS face_count, b.length_x, b.length_y, b.length_z, coalesce(c.n, 0) AS coloured FROM part LEFT JOIN ({BOX}) b ON b.file_id = p_partkey
    LEFT JOIN (SELECT file_id, count(*) AS n FROM ({COLOURS}) GROUP BY 1) c ON c.file_id = p_partkey""")
def _(spark, d):
    return st.summary(step_texts(spark, d))


# ---- pages -----------------------------------------------------------------------------------
# Stamp lines of a page: (order, modulus, remainder, x0, offset from the stamp top, x1, height, text); a null modulus is always there.
STAMP = [
    (1, None, 0, 400.0, 0.0, 440.0, 10.0, "Масштаб"), (2, 3, 0, 450.0, 1.0, 465.0, 10.0, "1:2"), (3, 3, 1, 405.0, 11.0, 430.0, 3.0, "2,5:1"),
    (4, None, 0, 475.0, 0.0, 500.0, 10.0, "Масса"), (5, 2, 0, 480.0, 12.0, 495.0, 4.0, "2,5"), (6, None, 0, 540.0, 60.0, 570.0, 10.0, "Формат"),
    (7, 5, 1, 575.0, 61.0, 585.0, 10.0, "А3"), (8, 5, 2, 575.0, 63.0, 580.0, 10.0, "А4"), (9, None, 0, 400.0, 17.0, 450.0, 6.0, "12.05.2024"),
    (10, 7, 3, 400.0, 18.0, 450.0, 6.0, "АБВ.001.005"), (11, 7, 4, 400.0, 19.0, 450.0, 6.0, "ADD-77"), (12, None, 0, 410.0, 30.0, 520.0, 8.0, "Вал выходной"),
    (13, 4, 0, 505.0, 44.0, 560.0, 8.0, "нижний, левый"), (14, 4, 1, 525.0, 44.0, 560.0, 8.0, "в стороне"), (15, 2, 1, 530.0, 58.0, 556.0, 8.0, "узла"),
    (16, None, 0, 590.0, 20.0, 598.0, 8.0, "Лит."), (17, 3, 0, 400.0, 70.0, 470.0, 8.0, "45 ГОСТ 1050-2013"), (18, 3, 1, 400.0, 64.0, 440.0, 6.0, "Сталь 40Х"),
    (19, 6, 1, 420.0, 80.0, 470.0, 6.0, "ГОСТ 4543-2016"), (20, 6, 4, 470.0, 80.0, 520.0, 6.0, "ГОСТ 4543-2016"), (21, 2, 0, 400.0, 85.0, 470.0, 4.0, "Круг 40 ГОСТ 2590-2006"),
    (22, 2, 1, 470.0, 86.0, 480.0, 4.0, "Маленький текст"),
]
WIDTH, LINE_STEP, STAMP_ROOM = 600.0, 20.0, 400.0


def page_lines(spark, d):
    """All text lines of a document as the body of a page, a forging line on odd pages, and a stamp."""
    docs = facts.read(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("body"))
    docs = docs.withColumn("page_height", F.size("body") * LINE_STEP + STAMP_ROOM)
    body = docs.select("doc_id", "page_height", F.posexplode("body").alias("at", "text")).select(
        "doc_id", "page_height", (F.col("at") + 1).alias("line_no"), F.lit(40.0).alias("x0"), (F.col("at") * LINE_STEP).alias("y0"),
        (F.length("text") * 5.0 + 40.0).alias("x1"), (F.col("at") * LINE_STEP + 12.0).alias("y1"), "text",
    )
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("k", "m", "r", "sx0", "off", "sx1", "h", "t"), (a, b or 1, c, *rest))]) for a, b, c, *rest in STAMP])
    top = F.col("page_height") - 90.0
    stamp = docs.select("doc_id", "page_height", F.size("body").alias("n"), F.explode(rows).alias("s")).where(F.col("doc_id") % F.col("s.m") == F.col("s.r"))
    stamp = stamp.select("doc_id", "page_height", (F.col("n") + F.col("s.k")).alias("line_no"), F.col("s.sx0").alias("x0"), (top + F.col("s.off")).alias("y0"),
                         F.col("s.sx1").alias("x1"), (top + F.col("s.off") + F.col("s.h")).alias("y1"), F.col("s.t").alias("text"))
    forging = docs.where("doc_id % 4 = 1").select(
        "doc_id", "page_height", (F.size("body") + 100).alias("line_no"), F.lit(40.0).alias("x0"), F.lit(5.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(15.0).alias("y1"),
        F.lit("2. Гр. III ГОСТ 8479-70").alias("text"),
    )
    return body.unionByName(stamp).unionByName(forging).withColumn("page_width", F.lit(WIDTH))


_stamp_rows = ", ".join(f"({a}, {b or 1}, {c}, {x0}e0, {o}e0, {x1}e0, {h}e0, '{t}')" for a, b, c, x0, o, x1, h, t in STAMP)
FACT_SQL["page_docs"] = f"SELECT doc_id, string_split(text, chr(10)) AS body, len(string_split(text, chr(10))) * {LINE_STEP}e0 + {STAMP_ROOM}e0 AS page_height FROM documents"
FACT_SQL["lines"] = f"""
SELECT doc_id, page_height, {WIDTH}e0 AS page_width, ix + 1 AS line_no, 40e0 AS x0, ix * {LINE_STEP}e0 AS y0, length(text) * 5e0 + 40e0 AS x1, ix * {LINE_STEP}e0 + 12e0 AS y1, text
  FROM (SELECT doc_id, page_height, unnest(body) AS text, unnest(range(len(body))) AS ix FROM page_docs)
UNION ALL SELECT doc_id, page_height, {WIDTH}e0, len(body) + k, sx0, page_height - 90e0 + off, sx1, page_height - 90e0 + off + h, t
  FROM page_docs JOIN (VALUES {_stamp_rows}) s(k, m, r, sx0, off, sx1, h, t) ON doc_id % m = r
UNION ALL SELECT doc_id, page_height, {WIDTH}e0, len(body) + 100, 40e0, 5e0, 200e0, 15e0, '2. Гр. III ГОСТ 8479-70' FROM page_docs WHERE doc_id % 4 = 1"""
_known = ", ".join(f"'{x}'" for x in ly.KNOWN_LABELS)
FACT_SQL["stamp"] = f"SELECT *, text IN ({_known}) AS known FROM lines WHERE x0 >= page_width * 0.66e0 AND y0 >= page_height * 0.78e0"
FACT_SQL["label_value"] = """
SELECT l.doc_id, l.text AS label, coalesce(
  (SELECT arg_min(v.text, (v.x0, v.line_no)) FROM stamp v WHERE v.doc_id = l.doc_id AND v.text <> l.text AND NOT v.known AND v.x0 > l.x1
     AND abs((v.y0 + v.y1) / 2 - (l.y0 + l.y1) / 2) < 6),
  (SELECT arg_min(v.text, (v.y0, v.line_no)) FROM stamp v WHERE v.doc_id = l.doc_id AND v.text <> l.text AND v.y0 >= l.y1 - 1 AND v.x0 < l.x1 AND v.x1 > l.x0)) AS value
FROM (SELECT DISTINCT ON (doc_id, text) * FROM stamp WHERE text IN ('Масштаб', 'Формат', 'Масса') ORDER BY doc_id, text, line_no) l"""
FACT_SQL["designated"] = """SELECT doc_id, arg_min(text, (y0, line_no)) AS designation FROM stamp WHERE NOT known AND NOT contains(text, ' ')
  AND NOT regexp_matches(text, '^\\d{2}\\.\\d{2}\\.\\d{4}$') AND regexp_matches(text, '[A-ZА-ЯЁ0-9]') GROUP BY doc_id"""
# The titles of these pages, from the rules on the listed stamp lines: the start line, then what overlaps and is near.
FACT_SQL["titled"] = """
WITH RECURSIVE cand AS (SELECT s.doc_id, s.text, s.x0, s.x1, s.y0, s.y1, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.y0, s.line_no) AS rn FROM stamp s LEFT JOIN designated g USING (doc_id)
   WHERE NOT known AND regexp_full_match(text, '[A-ЯЁA-Za-zа-яё .,]+') AND text IS DISTINCT FROM g.designation),
 start AS (SELECT DISTINCT ON (doc_id) * FROM cand WHERE upper(text[1]) = text[1] AND lower(text[1]) <> text[1] ORDER BY doc_id, rn),
 fold AS (SELECT doc_id, rn, text AS title, y1, x0, x1, FALSE AS done, y0 AS sy FROM start
   UNION ALL SELECT f.doc_id, c.rn, CASE WHEN take THEN f.title || ' ' || c.text ELSE f.title END, CASE WHEN take THEN c.y1 ELSE f.y1 END,
     CASE WHEN take THEN least(f.x0, c.x0) ELSE f.x0 END, CASE WHEN take THEN greatest(f.x1, c.x1) ELSE f.x1 END, stop, f.sy
   FROM fold f JOIN cand c ON c.doc_id = f.doc_id AND c.rn = f.rn + 1,
     LATERAL (SELECT f.done OR c.y0 - f.y1 >= 20 AS stop), LATERAL (SELECT NOT stop AND c.y0 > f.sy AND c.x0 < f.x1 AND c.x1 > f.x0 AS take))
SELECT doc_id, arg_max(title, rn) AS part_name FROM fold GROUP BY doc_id"""
FACT_SQL["paired"] = """SELECT g.doc_id, arg_min(g.text || ' ' || s.text, (g.line_no, s.line_no)) AS material FROM stamp g JOIN stamp s ON s.doc_id = g.doc_id
  WHERE regexp_matches(g.text, '(?i)^Сталь\\s+\\S+') AND regexp_matches(s.text, '^ГОСТ\\s+[\\d.\\-]+$') AND abs(s.y0 - g.y1) < 25 AND abs(s.x0 - g.x0) < 30 GROUP BY g.doc_id"""
FACT_SQL["page_material"] = """SELECT d.doc_id, coalesce(a.t, p.material) AS material FROM documents d LEFT JOIN (SELECT doc_id, arg_min(text, line_no) AS t FROM stamp
  WHERE regexp_matches(text, '^[A-ЯЁ0-9ХГТ]+\\s+ГОСТ\\s+[\\d.\\-]+$') GROUP BY 1) a USING (doc_id) LEFT JOIN paired p USING (doc_id)"""
FACT_SQL["page_blank"] = """SELECT d.doc_id, coalesce(a.t, b.t) AS blank_designation FROM documents d
  LEFT JOIN (SELECT doc_id, arg_min(text, line_no) AS t FROM stamp WHERE regexp_matches(text, '(?i)^(Круг|Лист|Пруток|Полоса|Труба)\\s+') GROUP BY 1) a USING (doc_id)
  LEFT JOIN (SELECT doc_id, arg_min(regexp_extract(text, '(?i)^(?:\\d+\\.\\s*)?(Гр\\.?\\s*[IVX]+\\s+ГОСТ\\s+[\\d.\\-]+)', 1), line_no) AS t FROM lines
    WHERE regexp_matches(text, '(?i)^(?:\\d+\\.\\s*)?(Гр\\.?\\s*[IVX]+\\s+ГОСТ\\s+[\\d.\\-]+)') GROUP BY 1) b USING (doc_id)"""


def stamp(spark, d):
    return ly.stamp_lines(page_lines(spark, d))


@add("h25_stamp_area", "SELECT doc_id, count(*) AS stamp_lines, min(line_no) AS first_line FROM stamp GROUP BY doc_id")
def _(spark, d):
    out = stamp(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("stamp_lines"), F.min("line_no").alias("first_line"))
    return out.withColumn("first_line", F.col("first_line").cast("bigint"))


@add("j17_label_values", "SELECT * FROM label_value WHERE value IS NOT NULL")
def _(spark, d):
    return ly.label_values(stamp(spark, d)).where("value IS NOT NULL")


@add("w7_designation", "SELECT * FROM designated")
def _(spark, d):
    return ly.designations(stamp(spark, d))


@add("w6_multi_line_title", "SELECT * FROM titled")
def _(spark, d):
    s = stamp(spark, d)
    return ly.part_names(s, ly.designations(s))


@add("j18_grade_standard_pair", "SELECT * FROM paired")
def _(spark, d):
    return ly.grade_standard_pairs(stamp(spark, d))


@add("w8_first_matching_line", "SELECT * FROM page_blank WHERE blank_designation IS NOT NULL")
def _(spark, d):
    lines = page_lines(spark, d)
    return ly.blank_designations(lines, ly.stamp_lines(lines))


@add("p12_page_layout", """SELECT d.doc_id, s.value AS scale, f.value AS sheet_format, m.value AS mass, g.designation, t.part_name, pm.material, b.blank_designation FROM documents d
    LEFT JOIN label_value s ON s.doc_id = d.doc_id AND s.label = 'Масштаб' LEFT JOIN label_value f ON f.doc_id = d.doc_id AND f.label = 'Формат'
    LEFT JOIN label_value m ON m.doc_id = d.doc_id AND m.label = 'Масса' LEFT JOIN designated g ON g.doc_id = d.doc_id LEFT JOIN titled t ON t.doc_id = d.doc_id
    LEFT JOIN page_material pm ON pm.doc_id = d.doc_id LEFT JOIN page_blank b ON b.doc_id = d.doc_id""")
def _(spark, d):
    return ly.title_blocks(page_lines(spark, d))


# ---- words -----------------------------------------------------------------------------------
def words(spark, d):
    docs = facts.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_num", "line"))
    parts = docs.select("doc_id", "line_num", F.posexplode(F.split("line", " ")).alias("word_no", "text"))
    return parts.select(
        "doc_id", F.lit(1).alias("block_num"), F.floor(F.col("line_num") / 5).cast("int").alias("par_num"), "line_num", "word_no",
        (F.col("word_no") * 10.0).alias("left"), (F.col("line_num") * 20.0 + F.col("word_no") % 3).alias("top"), (F.length("text") * 8.0).alias("width"),
        F.lit(12.0).alias("height"), "text",
    )


@add("a4_words_to_lines", """SELECT doc_id, 1 AS block_num, CAST(line_num // 5 AS INT) AS par_num, CAST(line_num AS INT) AS line_num, min(word_no * 10e0) / 2 AS x0, min(line_num * 20e0 + word_no % 3) / 2 AS y0,
    max(word_no * 10e0 + length(w) * 8e0) / 2 AS x1, max(line_num * 20e0 + word_no % 3 + 12) / 2 AS y1, string_agg(w, ' ' ORDER BY word_no) AS text FROM (
    SELECT doc_id, line_num, unnest(string_split(line, ' ')) AS w, unnest(range(len(string_split(line, ' ')))) AS word_no FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_num FROM documents)) WHERE trim(w) <> '' GROUP BY doc_id, line_num""")
def _(spark, d):
    return ly.words_to_lines(words(spark, d), zoom=2.0)


# ---- numbered texts --------------------------------------------------------------------------
FACT_SQL["numbered"] = """SELECT doc_id, ix, CASE WHEN (doc_id + ix) % 4 = 0 THEN line ELSE (1 + (ix * 7 + doc_id) % 5) || '. ' || line END AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ix FROM documents)"""


def numbered_texts(spark, d):
    """Document lines with numbers 1..5 in front of most of them, as one raw text per document."""
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when((F.col("doc_id") + i) % 4 == 0, l).otherwise(
        F.concat((1 + (i * 7 + F.col("doc_id")) % 5).cast("string"), F.lit(". "), l)))
    return facts.read(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


@add("w5_numbered_requirements", """WITH RECURSIVE item AS (SELECT doc_id, ix, CAST(nullif(regexp_extract(line, '^\\s*(\\d+)\\.\\s*(.+?)\\.?\\s*$', 1), '') AS BIGINT) AS n,
      regexp_extract(line, '^\\s*(\\d+)\\.\\s*(.+?)\\.?\\s*$', 2) AS t FROM numbered),
    ok AS (SELECT * FROM item WHERE n IS NOT NULL AND regexp_matches(t, '[A-ZА-ЯЁa-zа-яё]')),
    first1 AS (SELECT doc_id, min(ix) AS ix, 1 AS n FROM ok WHERE n = 1 GROUP BY doc_id),
    chain AS (SELECT doc_id, ix, n FROM first1
      UNION ALL SELECT c.doc_id, (SELECT min(o.ix) FROM ok o WHERE o.doc_id = c.doc_id AND o.n = c.n + 1 AND o.ix > c.ix), c.n + 1 FROM chain c
      WHERE EXISTS (SELECT 1 FROM ok o WHERE o.doc_id = c.doc_id AND o.n = c.n + 1 AND o.ix > c.ix))
    SELECT c.doc_id, CAST(c.n AS INT) AS number, regexp_replace(o.t, '^\\s+|\\s+$', '', 'g') AS text FROM chain c JOIN ok o ON o.doc_id = c.doc_id AND o.ix = c.ix""")
def _(spark, d):
    return ly.numbered_requirements(numbered_texts(spark, d))
