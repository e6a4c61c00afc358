"""STEP texts to entity tables, bounding boxes, face counts and face colours."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwright.functions import numbers as nx
from partwright.session import cut_lineage

# ---- fixed values: entity patterns ------------------------------------------------------------
POINT = (r"CARTESIAN_POINT\s*\(\s*'[^']*'\s*,\s*\(\s*"
         r"([-\d.Ee+]+)\s*,\s*([-\d.Ee+]+)\s*,\s*([-\d.Ee+]+)\s*\)\s*\)")
COLOUR = r"#(\d+)\s*=\s*COLOUR_RGB\s*\(\s*'[^']*'\s*,\s*([\d.Ee+]+)\s*,\s*([\d.Ee+]+)\s*,\s*([\d.Ee+]+)\s*\)"
FACE = r"#(\d+)\s*=\s*ADVANCED_FACE\s*\("
STYLED_ITEM = r"#(\d+)\s*=\s*STYLED_ITEM\s*\(\s*'[^']*'\s*,\s*\(\s*#(\d+)\s*\)\s*,\s*#(\d+)\s*\)"
STYLE_CHAIN = [
    r"#(\d+)\s*=\s*PRESENTATION_STYLE_ASSIGNMENT\s*\(\s*\(\s*#(\d+)\s*\)\s*\)",
    r"#(\d+)\s*=\s*SURFACE_STYLE_USAGE\s*\(\s*\.[A-Z]+\.\s*,\s*#(\d+)\s*\)",
    r"#(\d+)\s*=\s*SURFACE_SIDE_STYLE\s*\(\s*'[^']*'\s*,\s*\(\s*#(\d+)\s*\)\s*\)",
    r"#(\d+)\s*=\s*SURFACE_STYLE_FILL_AREA\s*\(\s*#(\d+)\s*\)",
    r"#(\d+)\s*=\s*FILL_AREA_STYLE\s*\(\s*\$?\s*'?[^,]*'?\s*,\s*\(\s*#(\d+)\s*\)\s*\)",
    r"#(\d+)\s*=\s*FILL_AREA_STYLE_COLOUR\s*\(\s*'[^']*'\s*,\s*#(\d+)\s*\)",
]
PRODUCT = r"PRODUCT\s*\(\s*'[^']*'\s*,\s*'((?:[^'\\]|\\.)*)'"
SOFTWARE = r"(?iu)'(SolidWorks[^']*|C3D[^']*|КОМПАС[^']*|ASCON[^']*)'"
# -----------------------------------------------------------------------------------------------


_ID = r"#(\d+)\s*=\s*"
#: Any of them; what all numbered ones begin with is matched once, not once per pattern.
ENTITY = rf"{POINT}|{_ID}(?:{'|'.join(p.removeprefix(_ID) for p in [FACE, STYLED_ITEM, *STYLE_CHAIN, COLOUR])})"


def entities(files: DataFrame) -> DataFrame:
    """``file_id, at, kind, raw``: every known entity of every text in file order, found in one pass."""
    found = files.select("file_id", F.posexplode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("at", "raw"))
    return found.select("file_id", "at", F.regexp_extract("raw", r"^(?:#\d+\s*=\s*)?([A-Z_]+)", 1).alias("kind"), "raw")


def kind_of(pattern: str) -> str:
    """The entity name a pattern is about."""
    return re.search(r"[A-Z][A-Z_]+(?=\\s)", pattern)[0]


def matches(found: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """The entities of one pattern with its groups as columns ``names``, and their place in the file (``at``)."""
    own = found.where(F.col("kind") == kind_of(pattern))
    return own.select("file_id", "at", *[F.regexp_extract("raw", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def headers(files: DataFrame) -> DataFrame:
    """Product name and software of every text: the first match of each."""

    def first(pattern: str) -> Column:
        return F.regexp_extract("text", pattern, 1)

    software = first(SOFTWARE)
    return files.select("file_id", first(PRODUCT).alias("product_name"), F.when(software != "", software).alias("software"))


def face_counts(files: DataFrame, found: DataFrame) -> DataFrame:
    """``file_id, face_count``, 0 for files without faces."""
    counts = found.where(F.col("kind") == kind_of(FACE)).groupBy("file_id").agg(F.count("*").alias("face_count"))
    return files.select("file_id").join(counts, "file_id", "left").select("file_id", F.coalesce("face_count", F.lit(0)).alias("face_count"))


def bounding_boxes(found: DataFrame) -> DataFrame:
    """Min and max of all points to three decimals and the lengths; files without points give no row."""
    points = matches(found, POINT, ["x", "y", "z"]).select("file_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    box = points.groupBy("file_id").agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    box = box.select("file_id", *[nx.exact_round(F.col(f"{c}_{n}"), 3).alias(f"{c}_{n}") for c in "xyz" for n in ("min", "max")])
    return box.select("*", *[nx.exact_round(F.col(f"{c}_max") - F.col(f"{c}_min"), 3).alias(f"length_{c}") for c in "xyz"])


def face_colours(found: DataFrame) -> DataFrame:
    """Colour of every styled face: six hops over reference entities, each an equi-join on (file, id).

    The last definition of an id in the file wins.
    """
    current = matches(found, STYLED_ITEM, ["item", "ref", "face"]).select(
        "file_id", F.col("at").alias("item_at"), F.col("face").cast("bigint").alias("face_ref"), F.col("ref").cast("bigint").alias("ref")
    )
    for pattern in STYLE_CHAIN:
        hop = matches(found, pattern, ["id", "to"]).groupBy("file_id", F.col("id").cast("bigint").alias("ref")).agg(
            F.max_by(F.col("to").cast("bigint"), F.col("at")).alias("to")
        )
        current = current.join(hop, ["file_id", "ref"]).select("file_id", "item_at", "face_ref", F.col("to").alias("ref"))
    colours = matches(found, COLOUR, ["id", "r", "g", "b"]).groupBy("file_id", F.col("id").cast("bigint").alias("ref")).agg(
        F.max_by(F.struct(*[F.col(c).cast("double").alias(c) for c in "rgb"]), F.col("at")).alias("rgb")
    )
    return current.join(colours, ["file_id", "ref"]).select("file_id", "face_ref", "rgb.*")


def summary(files: DataFrame) -> DataFrame:
    """``file_id, product_name, software, face_count, length_x, length_y, length_z, coloured`` of every file.

    The texts are read for their entities once; the entities are one table that all parts work on.
    """
    found = cut_lineage(entities(files))
    boxes = bounding_boxes(found).select("file_id", "length_x", "length_y", "length_z")
    coloured = face_colours(found).groupBy("file_id").agg(F.count(F.lit(1)).alias("coloured"))
    faces = found.groupBy("file_id").agg(F.count_if(F.col("kind") == kind_of(FACE)).alias("face_count"))
    out = headers(files).join(faces, "file_id", "left").join(boxes, "file_id", "left").join(coloured, "file_id", "left")
    return out.withColumn("face_count", F.coalesce("face_count", F.lit(0))).withColumn("coloured", F.coalesce("coloured", F.lit(0)))
