"""Title block and text layout from positioned lines: ``doc_id, line_no, page_width, page_height, x0, y0, x1, y1, text``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwright.functions import text as tx

# ---- fixed values ---------------------------------------------------------------------------
STAMP_X, STAMP_Y = 0.66, 0.78
ROW_TOLERANCE = 6
BELOW_SLACK = 1
TITLE_GAP = 20
PAIR_DY, PAIR_DX = 25, 30
KNOWN_LABELS = ["Лит.", "Масса", "Масштаб", "Дата", "Лист", "Листов", "Формат", "Копировал", "Изм.", "№ докум.", "Подп.", "Разраб.", "Пров.",
                "Т.контр.", "Н.контр.", "Утв.", "Подп. и дата"]
VALUE_LABELS = ["Масштаб", "Формат", "Масса"]
# The first class runs from the LATIN letter A to the Cyrillic Я.
MATERIAL_LINE = r"^[A-ЯЁ0-9ХГТ]+(?U:\s)+ГОСТ(?U:\s)+(?U:[\d.\-])+$"
TITLE_LINE = r"^[A-ЯЁA-Za-zа-яё .,]+$"
BLANK_LINE = r"(?iuU)^(Круг|Лист|Пруток|Полоса|Труба)\s+"
FORGING_LINE = r"(?iuU)^(?:\d+\.\s*)?(Гр\.?\s*[IVX]+\s+ГОСТ\s+[\d.\-]+)"
DATE = r"^\d{2}\.\d{2}\.\d{4}$"
GRADE_LINE = r"(?iuU)^Сталь\s+\S+"
STANDARD_LINE = r"(?U)^ГОСТ\s+[\d.\-]+$"
HAS_SIGN = r"[A-ZА-ЯЁ0-9]"
NUMBERED_LINE = r"(?U)^\s*(\d+)\.\s*(.+?)\.?\s*$"
HAS_LETTER = r"[A-ZА-ЯЁa-zа-яё]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# ---------------------------------------------------------------------------------------------


def stamp_lines(lines: DataFrame) -> DataFrame:
    """Lines of the lower right corner."""
    return lines.where((F.col("x0") >= F.col("page_width") * STAMP_X) & (F.col("y0") >= F.col("page_height") * STAMP_Y))


def _known() -> Column:
    return F.col("text").isin(KNOWN_LABELS)


LINE = ["doc_id", "block_num", "par_num", "line_num"]
_BOX = [("x0", "min"), ("y0", "min"), ("x1", "max"), ("y1", "max")]


def _parts_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a line that lie in one batch as one row: their box, and their numbers and texts as lists."""
    made = [*_BOX, ("x1_nan", "any"), ("y1_nan", "any"), ("word_no", "list"), ("text", "list")]
    for batch in batches:
        if batch.num_rows:
            parts = pa.Table.from_batches([batch]).group_by(LINE, use_threads=False).aggregate(made)
            parts = parts.select([*LINE, *[f"{c}_{f}" for c, f in made]]).rename_columns([*LINE, *[c for c, _ in made]])
            yield from parts.combine_chunks().to_batches()


def words_to_lines(words: DataFrame, zoom: float) -> DataFrame:
    """Words grouped by (block, paragraph, line): box of the words, text joined by a space; blank words dropped.

    The group is one printed line, whose text becomes one value. Words of a line mostly come together, so each batch
    makes them one row before anything is shuffled; words may come in any order and a line in any number of batches.
    """
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    kept = words.where(tx.strip(F.col("text")) != "").select(
        *LINE, F.col("left").alias("x0"), F.col("top").alias("y0"), right.alias("x1"), bottom.alias("y1"),
        F.isnan(right).alias("x1_nan"), F.isnan(bottom).alias("y1_nan"), "word_no", "text",
    )
    listed = {"word_no", "text"}
    schema = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType) if f.name in listed else f.dataType) for f in kept.schema])
    parts = kept.mapInArrow(_parts_of_lines, schema).repartition(*LINE)
    ordered = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("word_no", "text"))))
    # Arrow's largest value leaves NaN out, which is the largest there is.
    largest = lambda c: F.when(F.bool_or(f"{c}_nan"), F.lit(float("nan"))).otherwise(F.max(c))
    return parts.groupBy(*LINE).agg(
        (F.min("x0") / zoom).alias("x0"), (F.min("y0") / zoom).alias("y0"), (largest("x1") / zoom).alias("x1"),
        (largest("y1") / zoom).alias("y1"), F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"),
    )


def label_values(stamp: DataFrame) -> DataFrame:
    """Value of each label: leftmost on the same row, else topmost below: ``doc_id, label, value``.

    The label side is one row per page and label, so the join adds at most one row per line and label.
    """
    labels = stamp.where(F.col("text").isin(VALUE_LABELS)).groupBy("doc_id", F.col("text").alias("label")).agg(
        F.min_by(F.struct("x0", "y0", "x1", "y1"), F.col("line_no")).alias("l")
    )
    near = labels.join(stamp, "doc_id").where(F.col("text") != F.col("label"))
    row = ~_known() & (F.col("x0") > F.col("l.x1")) & (
        F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("l.y0") + F.col("l.y1")) / 2) < ROW_TOLERANCE
    )
    below = (F.col("y0") >= F.col("l.y1") - BELOW_SLACK) & (F.col("x0") < F.col("l.x1")) & (F.col("x1") > F.col("l.x0"))
    found = near.groupBy("doc_id", "label").agg(
        F.min_by("text", F.when(row, F.struct("x0", "line_no"))).alias("right"),
        F.min_by("text", F.when(below, F.struct("y0", "line_no"))).alias("under"),
    )
    return found.select("doc_id", "label", F.coalesce("right", "under").alias("value"))


def designations(stamp: DataFrame) -> DataFrame:
    """Topmost line that is no label and no date, has no space and holds a letter or digit."""
    c = F.col("text")
    ok = ~_known() & ~c.contains(" ") & ~c.rlike(DATE) & c.rlike(HAS_SIGN)
    return stamp.where(ok).groupBy("doc_id").agg(F.min_by("text", F.struct("y0", "line_no")).alias("designation"))


def part_names(stamp: DataFrame, designation: DataFrame) -> DataFrame:
    """Multi-line title: from the topmost capitalised text line on, lines below that overlap the widening
    column, until the vertical gap reaches 20.

    The fold depends on order, so the text lines of one title block are folded as one array; their join is
    the value of one cell.
    """
    text_lines = stamp.where(~_known() & F.col("text").rlike(TITLE_LINE)).join(designation, "doc_id", "left").where(
        F.col("designation").isNull() | (F.col("text") != F.col("designation"))
    )
    item = F.struct("y0", "line_no", "x0", "x1", "y1", "text")
    first = F.substring("text", 1, 1)
    starts = (first == F.upper(first)) & (first != F.lower(first))
    grouped = text_lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("ls"), F.min(F.when(starts, item)).alias("s"))
    grouped = grouped.where("s IS NOT NULL")
    rest = F.filter("ls", lambda l: l["y0"] > F.col("s.y0"))
    start = F.struct(F.col("s.text").alias("title"), F.col("s.y1").alias("y1"), F.col("s.x0").alias("x0"), F.col("s.x1").alias("x1"), F.lit(False).alias("done"))

    def step(acc: Column, l: Column) -> Column:
        stop = acc["done"] | (l["y0"] - acc["y1"] >= TITLE_GAP)
        take = ~stop & (l["x0"] < acc["x1"]) & (l["x1"] > acc["x0"])
        return F.struct(
            F.when(take, F.concat(acc["title"], F.lit(" "), l["text"])).otherwise(acc["title"]).alias("title"),
            F.when(take, l["y1"]).otherwise(acc["y1"]).alias("y1"), F.when(take, F.least(acc["x0"], l["x0"])).otherwise(acc["x0"]).alias("x0"),
            F.when(take, F.greatest(acc["x1"], l["x1"])).otherwise(acc["x1"]).alias("x1"), stop.alias("done"),
        )

    return grouped.select("doc_id", F.aggregate(rest, start, step)["title"].alias("part_name"))


def first_match(lines: DataFrame, pattern: str, name: str, group: int | None = None) -> DataFrame:
    """First line in reading order that matches, or its capture group."""
    value = F.col("text") if group is None else F.regexp_extract("text", pattern, group)
    return lines.where(F.col("text").rlike(pattern)).groupBy("doc_id").agg(F.min_by(value, F.col("line_no")).alias(name))


def grade_standard_pairs(stamp: DataFrame) -> DataFrame:
    """First (grade line, standard line) pair in reading order that lie close together.

    Both sides keep the first line per exact position; positions meet through a grid of the distance
    limits, so only neighbouring cells are compared.
    """
    c = F.col("text")
    grades = stamp.where(c.rlike(GRADE_LINE)).groupBy("doc_id", F.col("x0").alias("gx"), F.col("y1").alias("gy")).agg(
        F.min(F.struct("line_no", "text")).alias("g")
    )
    standards = stamp.where(c.rlike(STANDARD_LINE)).groupBy("doc_id", F.col("x0").alias("sx"), F.col("y0").alias("sy")).agg(
        F.min(F.struct("line_no", "text")).alias("s")
    )
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    cells = grades.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select(
        "doc_id", "gx", "gy", "g", (F.floor(F.col("gx") / PAIR_DX) + F.col("dx")).alias("cx"), (F.floor(F.col("gy") / PAIR_DY) + F.col("dy")).alias("cy")
    )
    placed = standards.withColumn("cx", F.floor(F.col("sx") / PAIR_DX)).withColumn("cy", F.floor(F.col("sy") / PAIR_DY))
    close = (F.abs(F.col("sy") - F.col("gy")) < PAIR_DY) & (F.abs(F.col("sx") - F.col("gx")) < PAIR_DX)
    pairs = cells.join(placed, ["doc_id", "cx", "cy"]).where(close)
    best = pairs.groupBy("doc_id").agg(F.min(F.struct(F.col("g.line_no").alias("a"), F.col("s.line_no").alias("b"), F.col("g.text").alias("ga"), F.col("s.text").alias("sa"))).alias("p"))
    return best.select("doc_id", F.concat("p.ga", F.lit(" "), "p.sa").alias("material"))


def materials(stamp: DataFrame) -> DataFrame:
    """A line with grade and standard wins over a pair of lines."""
    single = first_match(stamp, MATERIAL_LINE, "single")
    paired = grade_standard_pairs(stamp)
    return single.join(paired, "doc_id", "full").select("doc_id", F.coalesce("single", "material").alias("material"))


def blank_designations(lines: DataFrame, stamp: DataFrame) -> DataFrame:
    """A profile line of the stamp, else a forging group anywhere on the page."""
    profile = first_match(stamp, BLANK_LINE, "profile")
    forging = first_match(lines, FORGING_LINE, "forging", 1)
    return profile.join(forging, "doc_id", "full").select("doc_id", F.coalesce("profile", "forging").alias("blank_designation"))


def title_blocks(lines: DataFrame) -> DataFrame:
    """One row per page with the seven title-block values."""
    stamp = stamp_lines(lines)
    named = designations(stamp)
    values = label_values(stamp).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("label") == l, F.col("value"))).alias(n) for l, n in (("Масштаб", "scale"), ("Формат", "sheet_format"), ("Масса", "mass"))]
    )
    out = lines.select("doc_id").distinct()
    for side in (values, named, part_names(stamp, named), materials(stamp), blank_designations(lines, stamp)):
        out = out.join(side, "doc_id", "left")
    return out


def numbered_requirements(texts: DataFrame) -> DataFrame:
    """Numbered lines of a raw text kept only where the number is the next one and the line has a letter.

    The fold runs inside one text value; no rows are grouped.
    """
    items = F.filter(
        F.transform(F.split("text", LINE_BREAK), lambda l: F.struct(
            F.regexp_extract(l, NUMBERED_LINE, 1).alias("n"), tx.strip(F.regexp_extract(l, NUMBERED_LINE, 2)).alias("t")
        )),
        lambda i: (i["n"] != "") & i["t"].rlike(HAS_LETTER),
    )
    empty = F.array().cast("array<struct<number:int,text:string>>")

    def step(kept: Column, i: Column) -> Column:
        due = i["n"].cast("decimal(38,0)") == F.size(kept) + 1
        return F.when(due, F.concat(kept, F.array(F.struct((F.size(kept) + 1).alias("number"), i["t"].alias("text"))))).otherwise(kept)

    return texts.select("doc_id", F.inline(F.aggregate(items, empty, step)))
