"""Text rules, matching and standard checks on literal rows with expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from partwright.functions import numbers as nx
from partwright.functions import text as tx
from partwright.operators import matching as m
from partwright.plans import review
from partwright.sources.reference import load

DRAWING = "part_id long, part_name string, designation string, material string, blank_designation string, scale string, sheet_format string, mass string"


def drawing(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], DRAWING)


def with_material(spark, text):
    return drawing(spark, ("Вал", "АБВ.1", text, None, None, None, None))


@pytest.mark.parametrize("text, status, grade", [
    ("45 ГОСТ 1050-2013", "matched", "Сталь 45"), ("12ХН3А ГОСТ 4543-2016", "matched", "12ХН3А"), ("Сталь 12хн3а гост 4543-2016", "matched", "12ХН3А"),
    ("40Х", "partial_match", "40Х"), ("Ст99 ГОСТ 4543-2016", "partial_match", "40Х"), ("АМг6", "not_found", None), ("", "not_found", None), (None, "not_found", None),
])
def test_material_match(spark, text, status, grade):
    row = m.match_material(with_material(spark, text), load(spark, "material")).first()
    assert (row.material_status, row.matched_grade) == (status, grade)


@pytest.mark.parametrize("text, best, status, reason, diameter", [
    ("Круг 67 ГОСТ 2590-2006", False, "partial_match", "diameter_differs", 67.0), ("Круг 40,3 ГОСТ 2590-2006", False, "matched", None, 40.3),
    ("Круг 60 ГОСТ 2590-2006", False, "partial_match", "diameter_differs", 60.0), ("Круг 60 ГОСТ 2590-2006", True, "matched", None, 60.0),
    ("Лист 5 ГОСТ 19903-2015", False, "not_found", None, None), ("Гр. III ГОСТ 8479-70", False, "partial_match", "size_missing", None),
])
def test_blank_match(spark, text, best, status, reason, diameter):
    row = m.match_blank(drawing(spark, ("Вал", "А", None, text, None, None, None)), load(spark, "workpiece_blank"), best).first()
    assert (row.blank_status, row.blank_reason, row.drawing_diameter) == (status, reason, diameter)


def test_scale_check_and_absent_configuration(spark):
    given = drawing(spark, *[("В", "А", None, None, s, None, None) for s in ("М 1 : 5", "1:2,5", "1:3", None)])
    rules = m.enum_requirements(load(spark, "gost_clause"), load(spark, "gost_standard"))
    statuses = [r.status for r in m.check_scale(given, rules).orderBy("part_id").collect()]
    assert statuses == ["passed", "passed", "violated", "needs_review"]
    assert m.check_scale(given, rules.where("id < 0")).count() == 0


def test_dash_is_not_filled_and_marks_decide(spark):
    given = drawing(spark, ("-", "АБВ", "нет", None, "1:1", None, "2,5"))
    rows = m.check_title_block(given, load(spark, "gost_title_block_field"), load(spark, "gost_standard"), load(spark, "title_block_map")).collect()
    assert {r.clause_number: r.status for r in rows} == {
        "1": "violated", "2": "passed", "3": "needs_review", "5": "passed", "6": "passed", "32": "violated"
    }


def test_numbering(spark):
    lines = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 3), (3, 1, 2)], "part_id long, pos int, number int")
    rows = {r.part_id: (r.status, r.first_bad_pos) for r in m.check_numbering(lines).collect()}
    assert rows == {1: ("passed", None), 2: ("violated", 2), 3: ("violated", 1)}


def test_one_pass_checks_equal_separate_checks(spark):
    from partwright.bindings import facts

    given = facts.drawings(spark, "/root/testdata/sf0.001")
    together = review.with_checks(spark, given).select("part_id", F.inline("checks")).select("part_id", "check_code", "status")
    apart = m.check_scale(given, m.enum_requirements(load(spark, "gost_clause"), load(spark, "gost_standard"))).select("part_id", "check_code", "status").unionByName(
        m.check_material_reference(given).select("part_id", "check_code", "status")
    ).unionByName(m.check_title_block(given, load(spark, "gost_title_block_field"), load(spark, "gost_standard"), load(spark, "title_block_map")).select("part_id", "check_code", "status"))
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, apart.collect()))


@pytest.mark.parametrize("text, code", [
    ("Материал: сталь 45", "material"), ("Цементация h 0,8", "chemical_thermal_treatment"), ("40...45 HRC", "heat_treatment"), ("ACHRCX", None),
    ("Острые кромки притупить", "rounding_edges"), ("±IT14/2", "unspecified_tolerances"), ("Размеры для справок", "reference_dimension"), ("Маркировать", None),
])
def test_requirement_category(spark, text, code):
    assert spark.range(1).select(tx.requirement_category(F.lit(text))).first()[0] == code


@pytest.mark.parametrize("word, stem", [("марки", "марк"), ("стали", "стал"), ("пропеллера", "пропеллер"), ("вал", "вал"), ("линиями", "лини")])
def test_stem(spark, word, stem):
    assert spark.range(1).select(tx.stem_ru(F.lit(word))).first()[0] == stem


@pytest.mark.parametrize("value, digits", [(2.675, 2), (0.175, 2), (0.125, 2), (2.5, 0), (1000000.005, 2), (0.0175, 3)])
def test_rounding_is_half_even_on_the_binary_value(spark, value, digits):
    assert spark.range(1).select(nx.exact_round(F.lit(value), digits)).first()[0] == round(value, digits)


@pytest.mark.parametrize("value", [67.0, 0.025, 1234567.0, 0.00001234, 100000.0, 0.0, 999999.5, 9999995.0, 123456.5, -2.5, -0.00005])
def test_short_number(spark, value):
    assert spark.range(1).select(nx.short(F.lit(value))).first()[0] == f"{value:g}"


@pytest.mark.parametrize("value", [9.999999e-5, 9.999995e-5, 9.9999949e-5, -9.9999996e-5, 1e100, 1.5e-100, float("nan"), float("-inf")])
def test_short_number_is_judged_once_rounded(spark, value):
    assert spark.range(1).select(nx.short(F.lit(value))).first()[0] == f"{value:g}"


def test_step_text_decoding(spark, tmp_path):
    from partwright.sources.catalog import read_step_files

    (tmp_path / "a.stp").write_bytes("FILE_NAME('КОМПАС')".encode("windows-1251"))
    (tmp_path / "b.stp").write_bytes("NAME('\\X2\\04120430043B\\X0\\ 1') Ж".encode())
    texts = {r.file_id[-5:]: r.text for r in read_step_files(spark, str(tmp_path)).collect()}
    assert texts == {"a.stp": "FILE_NAME('КОМПАС')", "b.stp": "NAME('Вал 1') Ж"}


def test_reference_build_overwrites_and_can_be_empty(spark, tmp_path):
    from partwright.sources import catalog

    names = catalog.build_reference(spark, str(tmp_path), with_seed=False)
    assert spark.read.parquet(f"{tmp_path}/material").count() == 0
    catalog.build_reference(spark, str(tmp_path))
    tables = catalog.open_tables(spark, str(tmp_path), names)
    assert tables["material"].count() == 21
    assert catalog.preview(tables, "material; DROP TABLE x", ["id"]) is None
    assert catalog.orphans(tables["material"], "material_group_id", tables["material_group"], "id", "x").first().violations == 0


def test_documents_hold_all_findings_and_classify_each_line_once(spark):
    import json

    from partwright.bindings import facts

    given = facts.drawings(spark, "/root/testdata/sf0.001").withColumn("has_drawing", F.col("part_id") % 5 != 0)
    # Lines of some drawings only: numbers that skip, stay or are missing, texts that are missing, one of no drawing.
    lines = spark.createDataFrame(
        [(1, 1, 1, "Материал: сталь 45"), (1, 2, 3, "Смазать маслом"), (1, 3, None, "Смазать маслом"), (2, 2, 2, "Цементация"), (2, 1, 1, None),
         (5, 1, 2, "Смазать маслом"), (-7, 1, 1, "Смазать маслом")], "part_id long, pos int, number int, text string")
    found = review.review_findings(spark, given, lines)
    want = {(r.part_id, r.severity, r.finding_code, r.arg) for r in found.collect() if r.part_id != -7}
    summaries = {r.part_id: (r.summary, r.has_blocking) for r in review.summaries(given, found).collect()}
    documents = review.documents(spark, given, lines)
    rows = {r.part_id: json.loads(r.document) for r in documents.collect()}
    assert {(k, f["severity"], f["code"], f["arg"]) for k, v in rows.items() for f in v["findings"]} == want
    assert {k: (v["summary"], v["has_blocking_findings"]) for k, v in rows.items()} == summaries
    assert [(x["number"], x["category"]) for x in rows[1]["technical_requirement_checks"]] == [(1, "material"), (3, None), (None, None)]
    assert [(x["number"], x["is_recognized"]) for x in rows[2]["technical_requirement_checks"]] == [(1, False), (2, True)]
    assert (1, "info", "requirements_unrecognised", "3") in want and (1, "warning", "numbering_violated", "2") in want
    assert rows[3]["technical_requirement_checks"] == []
    plan = documents._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("азотирован") == 1  # one pattern of the line categories
    assert plan.count("Relation [p_partkey") == 1  # drawings are read and checked once
