"""Routes, prints and recommendations on literal requests."""


from partwright.bindings import all_queries
from partwright.plans import printing, route

D = "/root/testdata/sf0.001"


def drawing(spark, material, blank):
    return spark.createDataFrame([(1, material, blank)], "part_id long, material string, blank_designation string")


def test_route_of_a_steel_shaft(spark):
    ops = route.route_operations(spark, drawing(spark, "45 ГОСТ 1050-2013", "Круг 67 ГОСТ 2590-2006")).orderBy("sequence_no").collect()
    assert [(o.sequence_no, o.op_code) for o in ops] == [(5, "TURN_ROUGH"), (10, "TURN_FIN"), (15, "GRIND")]
    assert ops[0].reason_code is None and 20 < ops[0].cutting_speed_m_min < 300
    assert ops[0].feed_mm_rev == 0.6 and ops[0].depth_of_cut_mm == 2.25


def test_sheet_gives_a_warning_and_no_mode(spark):
    given = drawing(spark, "45 ГОСТ 1050-2013", "Лист 5 ГОСТ 19903-2015")
    assert [r.warning_code for r in route.route_warnings(spark, given).collect()] == ["no_diameter"]
    assert {o.reason_code for o in route.route_operations(spark, given).collect()} == {"no_diameter"}


def test_unknown_and_missing_material(spark):
    assert [r.warning_code for r in route.route_warnings(spark, drawing(spark, "АМг6", None)).collect()] == ["unknown_material"]
    assert [r.warning_code for r in route.route_warnings(spark, drawing(spark, None, None)).collect()] == ["no_material"]
    assert [r.warning_code for r in route.route_warnings(spark, drawing(spark, "СЧ20", None)).collect()] == ["no_machine"]


def requests(spark, *rows):
    return spark.createDataFrame([(i, *r, 10.0, 20.0, 30.0) for i, r in enumerate(rows, 1)], "part_id long, am_technology_code string, material_group_code string, length_x double, length_y double, length_z double")


def test_print_plan_and_warnings(spark):
    plans = printing.print_plans(spark, requests(spark, ("FDM", "PETG"), ("DMLS", "PETG"), ("FDM", "WOOD"), ("FDM", "ASA")))
    first = plans.where("part_id = 1").first()
    assert (first.printer_model_name, first.layer_height_mm, first.print_time_min, first.material_g) == ("Prusa MK4", 0.2, 6.2, 1.9)
    assert [(r.part_id, r.warning_code) for r in printing.print_warnings(plans).orderBy("part_id").collect()] == [
        (2, "unknown_technology"), (3, "unknown_material"), (4, "no_profile")
    ]


def test_wash_before_cure(spark):
    steps = printing.postprocessing_card(spark, printing.print_plans(spark, requests(spark, ("SLA", "RESIN_STD")))).orderBy("place").collect()
    assert [s.cells[1] for s in steps] == ["Мойка в изопропиловом спирте (ИПС)", "УФ-камера дозасветки"]


def test_condition_without_rule_falls_back(spark):
    asked = spark.createDataFrame([(1, "FUSELAGE", ["HUMIDITY_HIGH"]), (2, "FUSELAGE", ["UV_OUTDOOR_LONGTERM", "HUMIDITY_HIGH"]), (3, "BALLOON", [])],
                                  "request_id long, class_code string, condition_codes array<string>")
    rows = printing.recommend(spark, asked).orderBy("request_id", "priority").collect()
    assert [(r.request_id, r.fallback, r.rule_id) for r in rows] == [(1, True, 4), (1, True, 6), (2, False, 5), (3, False, None)]


def test_every_query_builds_with_a_stable_schema(spark):
    registry = all_queries()
    assert set(registry.oracles) <= set(registry.queries)
    flagship = registry.queries["j10_material_match_counts"](spark, D)
    assert {r.material_status for r in flagship.collect()} == {"matched", "partial_match", "not_found"}
    assert flagship.columns == ["material_status", "parts"]
