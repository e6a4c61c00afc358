"""Text functions over drawings, requirements and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from partwright.bindings import facts
from partwright.bindings import sqlfrag as q
from partwright.bindings.spec import REGISTRY
from partwright.functions import text as tx

add = REGISTRY.add


@add("h1_normalize_grade", f"SELECT part_id, {q.normalize_grade('material')} AS grade FROM drawings")
def _(spark, d):
    return facts.drawings(spark, d).select("part_id", tx.normalize_grade(F.col("material")).alias("grade"))


@add("h2_standard_number", f"SELECT part_id, {q.number('material')} AS number FROM drawings")
def _(spark, d):
    return facts.drawings(spark, d).select("part_id", tx.standard_number(F.col("material")).alias("number"))


@add("h3_grade_part", f"SELECT part_id, {q.grade_part('material')} AS grade FROM drawings")
def _(spark, d):
    return facts.drawings(spark, d).select("part_id", tx.grade_part(F.col("material")).alias("grade"))


@add("h4_standard_mention", f"SELECT part_id, {q.mention('blank_designation')} AS standard FROM drawings")
def _(spark, d):
    return facts.drawings(spark, d).select("part_id", tx.standard_mention(F.col("blank_designation")).alias("standard"))


@add("h5_profile_diameter", f"SELECT part_id, {q.profile_diameter('blank_designation')} AS diameter FROM drawings")
def _(spark, d):
    return facts.drawings(spark, d).select("part_id", tx.profile_diameter(F.col("blank_designation")).alias("diameter"))


@add("h6_blank_diameter", f"SELECT part_id, {q.blank_diameter('blank_designation')} AS diameter FROM drawings")
def _(spark, d):
    return facts.drawings(spark, d).select("part_id", tx.blank_diameter(F.col("blank_designation")).alias("diameter"))


@add("h7_normalize_scale", f"SELECT part_id, {q.scale('scale')} AS scale_key FROM drawings")
def _(spark, d):
    return facts.drawings(spark, d).select("part_id", tx.normalize_scale(F.col("scale")).alias("scale_key"))


@add(
    "h8_field_filled",
    f"SELECT part_id, {q.filled('part_name')} AS name_filled, {q.filled('mass')} AS mass_filled,"
    f" {q.filled('sheet_format')} AS format_filled FROM drawings",
)
def _(spark, d):
    def filled(c):
        return F.coalesce(tx.is_filled(F.col(c)), F.lit(False))

    return facts.drawings(spark, d).select(
        "part_id", filled("part_name").alias("name_filled"), filled("mass").alias("mass_filled"),
        filled("sheet_format").alias("format_filled"),
    )


@add("h10_stem_ru", f"SELECT part_id, pos, w AS word, {q.stem('w')} AS stem FROM (SELECT part_id, pos,"
     " unnest(string_split(lower(text), ' ')) AS w FROM tech_requirements)")
def _(spark, d):
    words = facts.tech_requirements(spark, d).select("part_id", "pos", F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.withColumn("stem", tx.stem_ru(F.col("word")))


@add("h11_keywords", f"SELECT conv_id, turn, array_to_string({q.keywords('text')}, ' ') AS words FROM conversations"
     " WHERE role = 'user'")
def _(spark, d):
    asked = facts.read(spark, d, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.array_join(tx.keywords(F.col("text")), " ").alias("words"))


@add("h11_keywords_requirements", f"SELECT part_id, pos, array_to_string({q.keywords('text')}, ' ') AS words"
     " FROM tech_requirements")
def _(spark, d):
    return facts.tech_requirements(spark, d).select("part_id", "pos", F.array_join(tx.keywords(F.col("text")), " ").alias("words"))


@add("h13_unicode_lower", "SELECT part_id, lower(material) AS low FROM drawings")
def _(spark, d):
    return facts.drawings(spark, d).select("part_id", F.lower("material").alias("low"))


@add("h14_summary", "SELECT part_id, concat_ws(' · ', part_name, designation, material, mass) AS summary FROM drawings")
def _(spark, d):
    return facts.drawings(spark, d).select(
        "part_id", F.concat_ws(" · ", "part_name", "designation", "material", "mass").alias("summary")
    )


@add(
    "h40_presence_flags",
    f"SELECT d.doc_id, length({q.strip('text')}) > 0 AS has_text FROM documents d",
)
def _(spark, d):
    docs = facts.read(spark, d, "documents")
    return docs.select("doc_id", (F.length(tx.strip(F.col("text"))) > 0).alias("has_text"))


@add("w14_requirement_category", f"SELECT part_id, pos, number, {q.category('text')} AS category FROM tech_requirements")
def _(spark, d):
    return facts.tech_requirements(spark, d).select(
        "part_id", "pos", "number", tx.requirement_category(F.col("text")).alias("category")
    )


@add(
    "s11_layout_columns",
    "SELECT p_partkey AS part_id, t.code, len(CAST(json_extract(layout_schema, '$.columns') AS VARCHAR[])) AS n_columns,"
    " array_to_string(CAST(json_extract(layout_schema, '$.columns') AS VARCHAR[]), ' | ') AS columns_text"
    " FROM part JOIN document_template t ON t.id = p_partkey % 5",
)
def _(spark, d):
    from partwright.sources import reference
    from partwright.sources.joins import lookup

    parts = facts.read(spark, d, "part").select(F.col("p_partkey").alias("part_id"), (F.col("p_partkey") % 5).alias("id"))
    templates = reference.load(spark, "document_template").select(
        "id", "code", tx.layout_columns(F.col("layout_schema")).alias("cols")
    )
    return lookup(parts, templates, "id", "inner").select(
        "part_id", "code", F.size("cols").cast("bigint").alias("n_columns"), F.array_join("cols", " | ").alias("columns_text")
    )


@add(
    "h35_json_scalar",
    "SELECT p_partkey AS part_id, t.code, json_extract_string(layout_schema, '$.columns[0]') AS first_column,"
    " json_extract_string(layout_schema, '$.columns[' || (p_partkey % 9) || ']') AS column_text"
    " FROM part JOIN document_template t ON t.id = p_partkey % 5",
)
def _(spark, d):
    """Single values of a template's JSON; a place beyond its columns is null."""
    from partwright.sources import reference
    from partwright.sources.joins import lookup

    parts = facts.read(spark, d, "part").select(F.col("p_partkey").alias("part_id"), (F.col("p_partkey") % 5).alias("id"))
    templates = reference.load(spark, "document_template").select("id", "code", tx.layout_columns(F.col("layout_schema")).alias("cols"))
    at = (F.col("part_id") % 9).cast("int")
    return lookup(parts, templates, "id", "inner").select("part_id", "code", F.get("cols", F.lit(0)).alias("first_column"), F.get("cols", at).alias("column_text"))
