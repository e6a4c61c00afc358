"""Fact tables derived from the given tables, each as a Spark plan and as the equal SQL.

A drawing is one row of ``part``: the id picks one of the listed spellings per column, so every row
of the table takes part and work grows with it. The lists below are inputs, not rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.bindings.spec import FACT_SQL

MATERIALS = [
    "45 ГОСТ 1050-2013", "Сталь 45 ГОСТ 1050-2013", "сталь 12хн3а гост 4543-2016", "40Х ГОСТ 4543-2016", "40Х",
    "Ст99 ГОСТ 4543-2016", "12Х18Н10Т ГОСТ 5632-2014", "Д16Т ГОСТ 4784-2019", "АМг6", None, "", "-",
    "СЧ20 ГОСТ 1412-85", "Сталь  20 ГОСТ1050-2013", "65Г ТУ 14-1-1", "Р6М5 ГОСТ 19265-73",
    "Сталь 30 ГОСТ 4543-2016", "ХВГ ОСТ 5950", "30ХГСА ГОСТ 4543-2016",
]
BLANKS = [
    "Круг 67 ГОСТ 2590-2006", "Круг Ø40 ГОСТ 2590-2006", "Круг 40,3 ГОСТ 2590-2006", "Лист 5 ГОСТ 19903-2015",
    None, "", "Гр. III ГОСТ 8479-70", "Пруток 60 ГОСТ 2590-2006", "Труба 32.5 ГОСТ 8732-78", "круг 25",
    "O 40 ГОСТ 2590-2006", "Полоса 10х50 ГОСТ 103-2006", "Круг 45 ГОСТ 7417-75",
]
SCALES = [
    "1:2", "М 1 : 5", "1:2,5", "1:3", None, "2:1", "1:1", "M1:1", "1:2.5", "5:1", "", "1:2000", "100:1", "1:7",
    "м1:10", "2,5:1", "1:100",
]
FORMATS = ["А4", "А3", None, "—", "А2", "не указан", "А1"]
MASSES = ["2,5", "0,8", "нет", None, "12"]
REQUIREMENTS = [
    "Материал: сталь 45", "Цементация h 0,8 мм", "40...45 HRC", "Покрытие Ц6.хр",
    "Неуказанные предельные отклонения H14, h14", "Допуски формы и расположения по стандарту",
    "Шероховатость поверхности Ra 3,2", "Обрабатывать после сборки", "Испытания давлением 2 МПа",
    "Момент затяжки 20 Нм", "Рабочая температура до 80 град", "Размеры для справок", "Острые кромки притупить",
    "Маркировать на бирке", "Поверхность Rz 20", "Общие допуски по ГОСТ 30893.1", "Отпуск 200 град",
    "±IT14/2", "Радиусы скругления 2 мм", "Смазать маслом", "Обозначение CHROME не указывать",
]
NUMBERINGS = [[1, 2, 3], [1, 3], [1, 2, 2], [1], [], [2, 3, 4, 5], [1, 2, 3, 4, 5, 6]]
TECHNOLOGIES = ["FDM", "SLA", "MSLA", "SLS", "DMLS"]
PRINT_GROUPS = ["PLA", "PETG", "ABS", "RESIN_STD", "RESIN_TOUGH", "RESIN_STD_MSLA", "PA12_SLS", "TPU_SLS", "NYLON_FDM",
                "WOOD", "ASA"]
PART_CLASSES = ["NOSE_CONE", "FUSELAGE", "WING", "PROPELLER", "MOUNT_BRACKET", "MOTOR_MOUNT", "LANDING_GEAR", "DUCT",
                "ANTENNA_HOUSING", "BALLOON"]
CONDITION_SETS = [
    [], ["UV_OUTDOOR_LONGTERM"], ["AIRSPEED_HIGH_150PLUS", "UV_OUTDOOR_LONGTERM"], ["NO_SUCH_CODE"],
    ["VIBRATION_HIGH_MOTOR_MOUNT", "NO_SUCH_CODE"], ["HUMIDITY_HIGH"],
    ["TEMP_HIGH_60_80", "IMPACT_HIGH_LANDING_CRASH", "TEMP_HIGH_60_80"],
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    items = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(items, (index % len(values)).cast("int") + 1)


def pick_sql(values: list, index: str) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"CAST(list_extract([{items}], CAST(({index}) % {len(values)} AS INT) + 1) AS VARCHAR)"


def _nested(values: list[list], index: Column, kind: str) -> Column:
    items = F.array(*[F.array(*[F.lit(x) for x in v]).cast(f"array<{kind}>") for v in values])
    return F.element_at(items, (index % len(values)).cast("int") + 1)


def _nested_sql(values: list[list], index: str, kind: str) -> str:
    def one(v):
        return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in v) + "]"

    items = ", ".join(f"{one(v)}::{kind}[]" for v in values)
    return f"list_extract([{items}], CAST(({index}) % {len(values)} AS INT) + 1)"


def title_block(key: Column, name: Column) -> list[Column]:
    """The seven title-block columns of a drawing with the given id."""
    return [
        F.when(key % 11 == 3, F.lit(None)).when(key % 11 == 7, "-").otherwise(name).alias("part_name"),
        F.when(key % 29 != 0, F.concat(F.lit("АБВ."), F.lpad(key.cast("string"), 8, "0"))).alias("designation"),
        pick(MATERIALS, key).alias("material"),
        pick(BLANKS, key).alias("blank_designation"),
        pick(SCALES, key).alias("scale"),
        pick(FORMATS, key).alias("sheet_format"),
        pick(MASSES, key).alias("mass"),
    ]


def title_block_sql(key: str, name: str) -> str:
    return (
        f"CASE WHEN {key} % 11 = 3 THEN NULL WHEN {key} % 11 = 7 THEN '-' ELSE {name} END AS part_name,"
        f" CASE WHEN {key} % 29 <> 0 THEN 'АБВ.' || lpad(CAST({key} AS VARCHAR), 8, '0') END AS designation,"
        f" {pick_sql(MATERIALS, key)} AS material, {pick_sql(BLANKS, key)} AS blank_designation,"
        f" {pick_sql(SCALES, key)} AS scale, {pick_sql(FORMATS, key)} AS sheet_format, {pick_sql(MASSES, key)} AS mass"
    )


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("part_id"), *title_block(F.col("p_partkey"), F.col("p_name")))


FACT_SQL["drawings"] = f"SELECT p_partkey AS part_id, {title_block_sql('p_partkey', 'p_name')} FROM part"


def tech_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    numbers = _nested(NUMBERINGS, key, "int")
    exploded = read(spark, sf_dir, "part").select(key.alias("part_id"), F.posexplode(numbers).alias("at", "number"))
    return exploded.select(
        "part_id", (F.col("at") + 1).alias("pos"), "number",
        pick(REQUIREMENTS, F.col("part_id") + 7 * F.col("at")).alias("text"),
    )


FACT_SQL["tech_requirements"] = (
    "SELECT part_id, CAST(ix + 1 AS INT) AS pos, CAST(numbers[ix + 1] AS INT) AS number,"
    f" {pick_sql(REQUIREMENTS, 'part_id + 7 * ix')} AS text FROM ("
    f"SELECT p_partkey AS part_id, numbers, unnest(range(len(numbers))) AS ix FROM ("
    f"SELECT p_partkey, {_nested_sql(NUMBERINGS, 'p_partkey', 'INT')} AS numbers FROM part))"
)


def print_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technology and material asked for, and the box of the part (missing for every ninth)."""
    key = F.col("p_partkey")
    boxed = key % 9 != 0
    return read(spark, sf_dir, "part").select(
        key.alias("part_id"),
        pick(TECHNOLOGIES, key + F.col("p_size")).alias("am_technology_code"),
        pick(PRINT_GROUPS, key).alias("material_group_code"),
        F.when(boxed, F.col("p_size") + 10.5).alias("length_x"),
        F.when(boxed, F.col("p_size") * 2.25).alias("length_y"),
        F.when(boxed, (key % 40) + 3.0).alias("length_z"),
    )


FACT_SQL["print_requests"] = (
    f"SELECT p_partkey AS part_id, {pick_sql(TECHNOLOGIES, 'p_partkey + p_size')} AS am_technology_code,"
    f" {pick_sql(PRINT_GROUPS, 'p_partkey')} AS material_group_code,"
    " CASE WHEN p_partkey % 9 <> 0 THEN p_size + 10.5e0 END AS length_x,"
    " CASE WHEN p_partkey % 9 <> 0 THEN p_size * 2.25e0 END AS length_y,"
    " CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 40) + 3e0 END AS length_z FROM part"
)


def recommendation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("request_id"), pick(PART_CLASSES, key).alias("class_code"),
        _nested(CONDITION_SETS, key, "string").alias("condition_codes"),
    )


FACT_SQL["recommendation_requests"] = (
    f"SELECT p_partkey AS request_id, {pick_sql(PART_CLASSES, 'p_partkey')} AS class_code,"
    f" {_nested_sql(CONDITION_SETS, 'p_partkey', 'VARCHAR')} AS condition_codes FROM part"
)


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("approval_id"),
        F.when(kind == "purchase", "approved").when(kind == "error", "rejected")
        .when(kind == "view", "rejected").otherwise(kind).alias("decision"),
        F.when(F.col("event_id") % 3 == 0, "  ").when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.col("props")))
        .alias("comment"),
    )


FACT_SQL["approvals"] = (
    "SELECT event_id AS approval_id, CASE WHEN event_type = 'purchase' THEN 'approved' WHEN event_type IN ('error',"
    " 'view') THEN 'rejected' ELSE event_type END AS decision, CASE WHEN event_id % 3 = 0 THEN '  '"
    " WHEN event_id % 3 = 1 THEN ' ' || props END AS comment FROM events"
)
