"""Reference tables: classifiers, compatibility, standards and rules.

Fixed values: every row below must hold these exact ids, codes and numbers for right results. The
tables are the small, bounded side of all joins; the large side is always a fact table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partwright.sources.literal import FixedTable, table

# ---- metal working -------------------------------------------------------------------------

EQUIPMENT_TYPE = table(
    "equipment_type", "id bigint, code varchar, name varchar, parent_id bigint",
    (1, "METAL_CUT", "Металлорежущий станок", None),
    (2, "LATHE", "Токарный станок", 1),
    (3, "LATHE_SCREW", "Токарно-винторезный станок", 2),
    (4, "LATHE_CNC", "Токарный станок с ЧПУ", 2),
    (5, "MILL", "Фрезерный станок", 1),
    (6, "MILL_VERT", "Вертикально-фрезерный станок", 5),
    (7, "MILL_CNC", "Обрабатывающий центр (фрезерный с ЧПУ)", 5),
    (8, "DRILL", "Сверлильный станок", 1),
    (9, "DRILL_VERT", "Вертикально-сверлильный станок", 8),
    (10, "GRIND", "Шлифовальный станок", 1),
    (11, "GRIND_CYL", "Круглошлифовальный станок", 10),
)

OPERATION_TYPE = table(
    "operation_type", "id bigint, code varchar, name varchar, gost_code varchar",
    (1, "TURN_ROUGH", "Токарная черновая", "4110"),
    (2, "TURN_FIN", "Токарная чистовая", "4111"),
    (3, "MILL", "Фрезерная", "4120"),
    (4, "DRILL", "Сверлильная", "4130"),
    (5, "GRIND", "Шлифовальная", "4140"),
    (6, "CONTROL", "Контрольная", "0110"),
)

# Technological sequence of operations; codes outside it are not planned.
OPERATION_ORDER = table(
    "operation_order", "op_code varchar, op_rank int",
    ("TURN_ROUGH", 1), ("TURN_FIN", 2), ("MILL", 3), ("DRILL", 4), ("GRIND", 5), ("CONTROL", 6),
)

TOOLING_TYPE = table(
    "tooling_type", "id bigint, category_id bigint, code varchar, name varchar",
    (1, 1, "CUTTER_TURN_ROUGH", "Резец токарный проходной черновой"),
    (2, 1, "CUTTER_TURN_FIN", "Резец токарный проходной чистовой"),
    (3, 1, "DRILL_TWIST", "Сверло спиральное"),
    (4, 1, "MILL_END", "Фреза концевая"),
    (5, 1, "GRIND_WHEEL", "Круг шлифовальный"),
    (6, 2, "CHUCK_3JAW", "Патрон трёхкулачковый"),
    (7, 2, "VISE", "Тиски станочные"),
    (8, 2, "CENTER_ROTARY", "Центр вращающийся"),
    (9, 3, "CALIPER", "Штангенциркуль"),
    (10, 3, "MICROMETER", "Микрометр"),
)

MATERIAL_GROUP = table(
    "material_group", "id bigint, code varchar, name varchar, machinability_index double",
    (1, "STEEL_CARBON", "Сталь углеродистая конструкционная", 1.00),
    (2, "STEEL_ALLOY", "Сталь легированная конструкционная", 0.75),
    (3, "STEEL_STAINLESS", "Сталь нержавеющая (коррозионностойкая)", 0.45),
    (4, "CAST_IRON", "Чугун", 1.20),
    (5, "ALUM", "Алюминиевые сплавы", 2.50),
    (6, "STEEL_TOOL", "Сталь инструментальная углеродистая", 0.35),
    (7, "STEEL_HSS", "Сталь быстрорежущая", 0.20),
    (8, "STEEL_BEARING", "Сталь подшипниковая", 0.30),
    (9, "STEEL_SPRING", "Сталь рессорно-пружинная", 0.55),
)

WORKPIECE_TYPE = table(
    "workpiece_type", "id bigint, code varchar, name varchar",
    (1, "ROLLED_BAR", "Прокат сортовой (пруток/круг)"),
    (2, "ROLLED_SHEET", "Прокат листовой"),
    (3, "FORGING", "Поковка"),
    (4, "CASTING", "Отливка"),
    (5, "STAMPING", "Штамповка"),
)

EQUIPMENT_MODEL = table(
    "equipment_model",
    "id bigint, equipment_type_id bigint, model_name varchar, control_system varchar,"
    " spindle_min double, spindle_max double, spindle_nose_type varchar",
    (1, 3, "16К20", None, 12.0, 1600.0, "Патрон 3-кул. 250мм"),
    (2, 6, "6Р13", None, 31.5, 1600.0, "ISO 40"),
    (3, 4, "DMG CTX 310 ecoline", "Siemens 840D", 100.0, 4200.0, "ISO 40"),
    (4, 7, "HAAS VF-2", "Haas NGC", 60.0, 8100.0, "CAT40"),
    (5, 9, "2Н135", None, 31.5, 1400.0, "Морзе 4"),
    (6, 11, "3М151", None, 63.0, 400.0, "Патрон/центры"),
)

TOOLING = table(
    "tooling", "id bigint, tooling_type_id bigint, designation varchar, diameter_mm double, shank_type varchar",
    (1, 1, "Резец 2102-0055 Т15К6", None, None),
    (2, 2, "Резец 2103-0009 Т15К6", None, None),
    (3, 3, "Сверло Ø10 Р6М5", 10.0, "Цилиндрический"),
    (4, 4, "Фреза концевая Ø12 Р6М5", 12.0, "Цилиндрический"),
    (5, 6, "Патрон 3-кул. 250мм", None, None),
    (6, 7, "Тиски станочные 125мм", None, None),
    (7, 9, "Штангенциркуль ШЦ-I-125", None, None),
)

MATERIAL = table(
    "material",
    "id bigint, material_group_id bigint, grade varchar, gost_standard varchar, density_kg_m3 double,"
    " tensile_strength_mpa double, hardness_hb double, machinability_index double, hardness_hrc double,"
    " red_hardness_c double, application varchar, chemical_composition varchar, heat_treatment varchar",
    (1, 1, "Сталь 45", "ГОСТ 1050-2013", 7850.0, 600.0, 197.0, 1.00, None, None, "Валы, шестерни, оси, шпиндели, коленчатые валы средней нагруженности",
     "C 0.42-0.50, Mn 0.5-0.8, Si 0.17-0.37, S ≤0.04, P ≤0.035", "Улучшение: закалка 840-850°C (вода), отпуск 550-600°C"),
    (2, 2, "40Х", "ГОСТ 4543-2016", 7820.0, 730.0, 217.0, 0.80, None, None, "Валы, оси, шестерни, болты повышенной прочности",
     "C 0.36-0.44, Cr 0.8-1.1, Mn 0.5-0.8, Si 0.17-0.37, S ≤0.035, P ≤0.035", "Улучшение: закалка 850°C (масло), отпуск 500-550°C"),
    (3, 3, "12Х18Н10Т", "ГОСТ 5632-2014", 7900.0, 550.0, 170.0, 0.45, None, None, "Сварные и штампованные конструкции в агрессивных средах, пищевая/химическая промышленность",
     "C ≤0.12, Cr 17-19, Ni 9-11, Ti 0.4-1.0, Mn ≤2.0, Si ≤0.8", "Закалка (аустенизация) 1000-1080°C, охлаждение на воздухе/в воде"),
    (4, 4, "СЧ20", "ГОСТ 1412-85", 7200.0, 200.0, 180.0, 1.30, None, None, "Корпусные детали, станины, крышки, маховики",
     "C 3.3-3.5, Si 1.4-2.4, Mn 0.7-1.0, S ≤0.15, P ≤0.2", "Без термообработки (литьё)"),
    (5, 5, "Д16Т", "ГОСТ 4784-2019", 2780.0, 440.0, 105.0, 2.50, None, None, "Силовые элементы конструкций (авиастроение), детали высокой удельной прочности",
     "Al основа, Cu 3.8-4.9, Mg 1.2-1.8, Mn 0.3-0.9", "Закалка ~495-505°C (вода), естественное старение"),
    (6, 2, "12ХН3А", "ГОСТ 4543-2016", 7850.0, 950.0, 269.0, 0.75, None, None, "Зубчатые колёса и валы-шестерни, требующие высокой контактной прочности и вязкой сердцевины",
     "C 0.09-0.16, Cr 0.6-0.9, Ni 2.75-3.15, Mn 0.3-0.6, Si 0.17-0.37", "Цементация, закалка ~800-820°C (масло), низкий отпуск 160-200°C"),
    (7, 1, "Ст3сп", "ГОСТ 380-2005", 7850.0, 430.0, 137.0, 1.10, None, None, "Сварные металлоконструкции, детали неответственного назначения",
     "C 0.14-0.22, Mn 0.4-0.65, Si 0.05-0.17, S ≤0.05, P ≤0.04", "Без термообработки (поставляется горячекатаной)"),
    (8, 1, "Сталь 20", "ГОСТ 1050-2013", 7850.0, 410.0, 156.0, 1.15, None, None, "Детали малой прочности, цементируемые детали (втулки, оси, пальцы)",
     "C 0.17-0.24, Mn 0.35-0.65, Si 0.17-0.37, S ≤0.04, P ≤0.035", "Нормализация 900-920°C или цементация + закалка"),
    (9, 1, "Сталь 30", "ГОСТ 1050-2013", 7850.0, 500.0, 179.0, 1.05, None, None, "Детали средней прочности — рычаги, тяги, оси",
     "C 0.27-0.35, Mn 0.5-0.8, Si 0.17-0.37, S ≤0.04, P ≤0.035", "Нормализация 880-900°C"),
    (10, 1, "Сталь 40", "ГОСТ 1050-2013", 7850.0, 580.0, 187.0, 1.00, None, None, "Валы, шестерни, коленвалы средней нагруженности",
     "C 0.37-0.45, Mn 0.5-0.8, Si 0.17-0.37, S ≤0.035, P ≤0.035", "Улучшение: закалка 840-860°C (вода/масло), отпуск 550-600°C"),
    (11, 2, "40ХН2МА", "ГОСТ 4543-2016", 7850.0, 980.0, None, 0.65, None, None, "Высоконагруженные детали ответственного назначения: валы, шестерни, оси, болты, шпильки",
     "C 0.37-0.44, Cr 0.6-0.9, Ni 1.25-1.65, Mo 0.15-0.25, Mn 0.5-0.8, Si 0.17-0.37, S ≤0.025, P ≤0.025", "Закалка 840-860°C (масло), отпуск 550-600°C"),
    (12, 2, "30ХГСА", "ГОСТ 4543-2016", 7850.0, 1080.0, None, 0.65, None, None, "Ответственные сварные конструкции при знакопеременных нагрузках: лопасти винтов, шатуны, рычаги, болты, пружины",
     "C 0.28-0.34, Cr 0.8-1.1, Mn 0.8-1.1, Si 0.9-1.2, S ≤0.025, P ≤0.025", "Закалка 880°C (масло), отпуск 450-520°C"),
    (13, 3, "08Х18Н10Т", "ГОСТ 5632-2014", 7900.0, 510.0, 170.0, 0.45, None, None, "Сварные конструкции в агрессивных средах, пищевая/химическая промышленность (улучшенная стойкость к межкристаллитной коррозии по сравнению с 12Х18Н10Т)",
     "C ≤0.08, Cr 17-19, Ni 9-11, Ti 0.5-0.8 (не менее 5×C%), Mn ≤2.0, Si ≤0.8", "Закалка (аустенизация) 1000-1080°C, охлаждение в воде/на воздухе"),
    (14, 6, "У8", "ГОСТ 1435-99", 7850.0, None, None, 0.35, 63.0, None, "Инструмент с невысокой теплостойкостью — зубила, штампы, пуансоны",
     "C 0.75-0.84, Mn ≤0.4, Si ≤0.4, S ≤0.028, P ≤0.03", "Закалка 780-800°C (вода), отпуск 150-200°C"),
    (15, 6, "У10", "ГОСТ 1435-99", 7850.0, None, None, 0.35, 63.0, None, "Свёрла, метчики, напильники, измерительный инструмент",
     "C 0.95-1.04, Mn ≤0.4, Si ≤0.4, S ≤0.028, P ≤0.03", "Закалка 770-790°C (вода), отпуск 150-200°C"),
    (16, 7, "Р6М5", "ГОСТ 19265-73", 8150.0, None, None, 0.20, 64.0, 620.0, "Универсальный режущий инструмент (свёрла, фрезы, резцы) для обработки конструкционных сталей",
     "C 0.82-0.90, W 5.5-6.5, Mo 4.8-5.3, Cr 3.8-4.4, V 1.7-2.1", "Закалка 1210-1230°C (масло), тройной отпуск 550-570°C"),
    (17, 7, "Р18", "ГОСТ 19265-73", 8700.0, None, None, 0.18, 64.0, 620.0, "Сложный режущий инструмент: фрезы, метчики, развёртки, долбяки",
     "C 0.73-0.83, W 17-18.5, Cr 3.8-4.4, V 1.0-1.4, Mo ≤1.0, S ≤0.025, P ≤0.03", "Закалка 1260-1280°C (масло/воздух), тройной отпуск 550-570°C"),
    (18, 8, "ШХ15", "ГОСТ 801-78", 7810.0, None, None, 0.30, 63.0, None, "Шарики, ролики, кольца подшипников качения",
     "C 0.95-1.05, Cr 1.3-1.65, Mn 0.2-0.4, Si 0.17-0.37, S ≤0.02, P ≤0.027", "Закалка 820-850°C (масло), низкий отпуск 150-170°C"),
    (19, 6, "ХВГ", "ГОСТ 5950-2000", 7850.0, None, None, 0.30, 63.0, None, "Длинномерный инструмент с малой деформацией при закалке — протяжки, развёртки, метчики, плашки",
     "C 0.90-1.05, Cr 0.9-1.2, W 1.2-1.6, Mn 0.8-1.1, Si 0.1-0.4", "Закалка 830-860°C (масло), отпуск 150-160°C"),
    (20, 9, "65Г", "ГОСТ 14959-2016", 7850.0, 1000.0, 295.0, 0.55, None, None, "Пружины, рессоры, пружинные шайбы, диски сцепления",
     "C 0.62-0.70, Mn 0.9-1.2, Si 0.17-0.37, S ≤0.025, P ≤0.025", "Закалка 800-830°C (масло), отпуск 460-520°C"),
    (21, 2, "09Г2С", "ГОСТ 19281-2014", 7850.0, 490.0, 170.0, 0.90, None, None, "Сварные конструкции, резервуары, трубопроводы, металлоконструкции ответственного назначения",
     "C ≤0.12, Mn 1.3-1.7, Si 0.5-0.8, S ≤0.04, P ≤0.035", "Без термообработки/нормализация (хладостойкая до -70°C)"),
)

WORKPIECE_BLANK = table(
    "workpiece_blank", "id bigint, workpiece_type_id bigint, material_id bigint, designation varchar, diameter_mm double",
    (1, 1, 1, "Круг Ø40 Сталь 45 ГОСТ 2590-2006", 40.0),
    (2, 1, 2, "Круг Ø60 40Х ГОСТ 2590-2006", 60.0),
    (3, 3, 1, "Поковка вала Сталь 45", None),
    (4, 3, 6, "Поковка шестерни 12ХН3А ГОСТ 8479-70", None),
)

EQUIPMENT_TYPE_OPERATION_TYPE = table(
    "equipment_type_operation_type", "equipment_type_id bigint, operation_type_id bigint",
    (3, 1), (3, 2), (4, 1), (4, 2), (6, 3), (7, 3), (9, 4), (11, 5),
)
OPERATION_TYPE_TOOLING_TYPE = table(
    "operation_type_tooling_type", "operation_type_id bigint, tooling_type_id bigint, is_required boolean",
    (1, 1, True), (2, 2, True), (3, 4, True), (4, 3, True), (5, 5, True), (6, 9, True),
)
EQUIPMENT_TYPE_MATERIAL_GROUP = table(
    "equipment_type_material_group", "equipment_type_id bigint, material_group_id bigint",
    (3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (4, 3), (4, 5), (6, 1), (6, 2), (6, 4),
    (7, 1), (7, 2), (7, 4), (7, 5), (9, 1), (9, 2), (9, 4), (11, 1), (11, 2),
)
EQUIPMENT_TYPE_WORKPIECE_TYPE = table(
    "equipment_type_workpiece_type", "equipment_type_id bigint, workpiece_type_id bigint",
    (3, 1), (3, 3), (4, 1), (4, 3), (6, 3), (6, 4), (7, 3), (7, 4), (9, 3), (9, 4), (11, 1), (11, 3),
)

CUTTING_MODE_FORMULA = table(
    "cutting_mode_formula",
    "id bigint, operation_type_id bigint, tool_material_group_id bigint, tool_life_min double,"
    " cv double, m double, xv double, yv double",
    (1, 1, 1, 60.0, 161.5, 0.20, 0.15, 0.45),
    (2, 2, 1, 60.0, 161.5, 0.20, 0.15, 0.45),
    (3, 3, 2, 80.0, 46.7, 0.32, 0.24, 0.30),
    (4, 4, 2, 25.0, 33.6, 0.20, 0.40, 0.70),
    (5, 5, 1, 30.0, 15.1, 0.20, 0.20, 0.15),
)

FEED_REFERENCE = table(
    "feed_reference",
    "id bigint, operation_type_id bigint, material_group_id bigint, feed_min double, feed_max double,"
    " depth_min double, depth_max double",
    (1, 1, 1, 0.4, 0.8, 1.5, 3.0),
    (2, 1, 2, 0.3, 0.6, 1.5, 2.5),
    (3, 1, 3, 0.2, 0.4, 1.0, 2.0),
    (4, 2, 1, 0.1, 0.3, 0.2, 0.5),
    (5, 2, 2, 0.1, 0.25, 0.2, 0.4),
    (6, 2, 3, 0.08, 0.2, 0.15, 0.3),
    (7, 3, 1, 0.06, 0.12, 1.0, 3.0),
    (8, 3, 2, 0.05, 0.1, 1.0, 2.5),
    (9, 4, 1, 0.12, 0.2, None, None),
    (10, 4, 2, 0.1, 0.18, None, None),
    (11, 5, 1, 0.01, 0.03, 0.005, 0.02),
    (12, 5, 2, 0.01, 0.025, 0.005, 0.015),
    (13, 3, 5, 0.1, 0.18, 1.5, 4.0),
    (14, 4, 5, 0.15, 0.25, None, None),
)

MACHINING_REQUIREMENT = table(
    "machining_requirement_template",
    "id bigint, operation_type_id bigint, code varchar, formulation varchar, reference_standard varchar",
    (1, None, "CARBURIZE_HRC",
     "Поверхность _____ цементировать h = ___ мм; HRC ___, d_min = ___ мм сердцевина. Группа контроля ___ ОСТ 1 00021-78",
     "ОСТ 1 00021-78"),
    (2, 3, "CNC_MACHINING", "Обработка предусмотрена на станках с ЧПУ", None),
    (3, None, "THREAD_ROLLING", "Резьбу выполнять накаткой", None),
    (4, 3, "MILL_UNDERCUT", "Недовод фрезы до необрабатываемой поверхности — не более ___ мм", None),
    (5, None, "UNSPEC_WALL_TOLERANCE", "Неуказанные предельные отклонения толщин — ___ мм", None),
    (6, None, "UNSPEC_TOLERANCE", "Неуказанные предельные отклонения размеров по ОСТ 1 00022-80", "ОСТ 1 00022-80"),
    (7, None, "THREAD_SPEC", "Резьба — по ОСТ 1 00105-83", "ОСТ 1 00105-83"),
    (8, None, "THREAD_RUNOUT", "Сбег и недорез резьбы — по ОСТ 1 00010-81", "ОСТ 1 00010-81"),
    (9, None, "NO_CENTER_HOLES", "Центровые отверстия не допускаются", None),
    (10, None, "MAGNETIC_PARTICLE_CONTROL", "Контроль магнитно-порошковый — по инструкции ВИАМ № 370-70",
     "Инструкция ВИАМ № 370-70"),
)

SURFACE_HARDENING = table(
    "surface_hardening_method",
    "id bigint, material_group_id bigint, method_name varchar, reference_instruction varchar, applicable_to varchar",
    (1, None, "Скругление острых кромок", "ОСТ 1 03736-74",
     "Общее требование перед упрочнением, радиус указывается конструктором"),
    (2, 1, "Виброшлифование", "Инструкция ВИАМ № 901-72", "для сталей"),
    (3, 2, "Виброшлифование", "Инструкция ВИАМ № 901-72", "для сталей"),
    (4, 3, "Виброшлифование", "Инструкция ВИАМ № 901-72", "для сталей"),
    (5, 1, "Алмазное выглаживание", "Инструкция ВИАМ № 901-72", "для сталей"),
    (6, 2, "Алмазное выглаживание", "Инструкция ВИАМ № 901-72", "для сталей"),
    (7, 3, "Алмазное выглаживание", "Инструкция ВИАМ № 901-72", "для сталей"),
    (8, 5, "Обкатка", "Инструкция ВИАМ № 949-69", "для алюминиевых сплавов"),
    (9, 5, "Раскатывание отверстий", "Инструкция ВИАМ № 949-69", "для алюминиевых сплавов"),
    (10, 5, "Дробеструйный метод", "ПИ 1.4.379-77", "для алюминиевых сплавов"),
    (11, 5, "Ударно-барабанный способ", "ПИ 1.4.009-76", "для алюминиевых сплавов"),
)

DOCUMENT_TEMPLATE = table(
    "document_template", "id bigint, code varchar, gost_form varchar, layout_schema varchar",
    (1, "MK", "ГОСТ 3.1118-82, форма 1",
     '{"columns": ["№ операции", "Код/наименование операции", "Цех", "Уч.", "РМ", "Профессия/разряд",'
     ' "Оборудование", "Тпз", "Тшт"]}'),
    (2, "OK", "ГОСТ 3.1404-86, форма 3/2а",
     '{"columns": ["№ операции", "№ перехода", "Содержание перехода", "Оборудование",'
     ' "Оснастка (приспособление/инструмент/измерительный)", "t", "S", "V", "n", "Разряд работы",'
     ' "То", "Тв", "Тшт", "Тпз"]}'),
    (3, "PRINT_CARD", None,
     '{"columns": ["Технология", "Принтер", "Материал", "Высота слоя", "Заполнение", "Время печати",'
     ' "Расход материала"]}'),
    (4, "PP_CARD", None,
     '{"columns": ["№ шага", "Операция", "Оборудование", "Длительность", "Температура",'
     ' "Влияние на точность/шероховатость"]}'),
)

# ---- printing ------------------------------------------------------------------------------

AM_TECHNOLOGY = table(
    "am_technology", "id bigint, code varchar, name varchar",
    (1, "FDM", "Наплавление нитью (FDM/FFF)"),
    (2, "SLA", "Стереолитография (SLA, лазер)"),
    (3, "MSLA", "Маскированная стереолитография (MSLA/LCD)"),
    (4, "SLS", "Селективное лазерное спекание (SLS)"),
)

PRINTER_TYPE = table(
    "printer_type", "id bigint, am_technology_id bigint, code varchar, name varchar",
    (1, 1, "FDM_CARTESIAN", "FDM, картезианская кинематика"),
    (2, 1, "FDM_COREXY", "FDM, CoreXY кинематика"),
    (3, 2, "SLA_LASER", "SLA с лазерной засветкой"),
    (4, 3, "MSLA_LCD", "MSLA с LCD-маскированием"),
    (5, 4, "SLS_LASER", "SLS с лазерным спеканием порошка"),
)

AM_MATERIAL_GROUP = table(
    "am_material_group", "id bigint, am_technology_id bigint, code varchar, name varchar",
    (1, 1, "PLA", "PLA (полилактид)"),
    (2, 1, "PETG", "PETG"),
    (3, 1, "ABS", "ABS"),
    (4, 1, "ASA", "ASA"),
    (5, 1, "TPU", "TPU (гибкий эластомер)"),
    (6, 1, "NYLON_FDM", "Полиамид (нейлон) для FDM"),
    (7, 1, "PVA_SUPPORT", "PVA (растворимая поддержка)"),
    (8, 2, "RESIN_STD", "Смола стандартная"),
    (9, 2, "RESIN_TOUGH", "Смола ударопрочная (Tough/Durable)"),
    (10, 3, "RESIN_STD_MSLA", "Смола стандартная (MSLA)"),
    (11, 3, "RESIN_CAST", "Смола выжигаемая (для литья)"),
    (12, 4, "PA12_SLS", "Полиамид PA12 (SLS)"),
    (13, 4, "TPU_SLS", "TPU порошок (SLS)"),
)

PP_TOOLING_TYPE = table(
    "pp_tooling_type", "id bigint, category_id bigint, code varchar, name varchar",
    (1, 1, "WASH_STATION_IPA", "Мойка в изопропиловом спирте (ИПС)"),
    (2, 1, "WASH_STATION_WATER", "Мойка водосмываемых смол"),
    (3, 2, "UV_CURE_CHAMBER", "УФ-камера дозасветки"),
    (4, 3, "SUPPORT_CUTTER", "Инструмент для срезания поддержек"),
    (5, 4, "SANDING_KIT", "Набор для шлифовки/полировки"),
    (6, 5, "BUILD_PLATE_PEI", "Стол с PEI-покрытием"),
    (7, 5, "ADHESIVE_SPRAY", "Аэрозольная адгезия (для смол/ABS)"),
    (8, 6, "SIEVE_STATION", "Станция просеивания и восстановления порошка"),
    (9, 6, "BEAD_BLASTING", "Пескоструйная/дробеструйная очистка (SLS)"),
)

PRINTER_MODEL = table(
    "printer_model",
    "id bigint, printer_type_id bigint, model_name varchar, build_x double, build_y double, build_z double",
    (1, 2, "Bambu Lab X1-Carbon", 256.0, 256.0, 256.0),
    (2, 1, "Prusa MK4", 250.0, 210.0, 220.0),
    (3, 3, "Formlabs Form 3", 145.0, 145.0, 185.0),
    (4, 4, "Anycubic Photon Mono X2", 196.0, 122.0, 250.0),
    (5, 5, "EOS P 396", 340.0, 340.0, 600.0),
)

AM_MATERIAL = table(
    "am_material",
    "id bigint, am_material_group_id bigint, trade_name varchar, density_g_cm3 double, print_temp_min_c int,"
    " print_temp_max_c int, bed_temp_c int, requires_heated_chamber boolean, requires_dry_storage boolean",
    (1, 1, "eSUN PLA+", 1.24, 190, 220, 60, False, False),
    (2, 2, "Bambu Lab PETG HF", 1.27, 230, 260, 80, False, True),
    (3, 3, "Polymaker PolyLite ABS", 1.04, 240, 260, 100, True, False),
    (4, 7, "eSUN PVA", 1.23, 190, 210, 60, False, True),
    (5, 8, "Formlabs Grey Resin V5", 1.10, None, None, None, False, False),
    (6, 9, "Formlabs Tough 2000 Resin", 1.05, None, None, None, False, False),
    (7, 12, "EOS PA 2200", 0.93, None, None, None, False, True),
    (8, 6, "eSUN PA-CF", 1.12, 260, 280, 90, True, True),
)

PRINTER_TYPE_MATERIAL_GROUP = table(
    "printer_type_material_group", "printer_type_id bigint, am_material_group_id bigint",
    (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (2, 1), (2, 2), (2, 5), (2, 7),
    (3, 8), (3, 9), (4, 10), (4, 11), (5, 12), (5, 13),
)

MATERIAL_GROUP_PP_TOOLING_TYPE = table(
    "material_group_pp_tooling_type",
    "am_material_group_id bigint, pp_tooling_type_id bigint, is_required boolean, typical_order int",
    (8, 1, True, 1), (8, 3, True, 2), (9, 1, True, 1), (9, 3, True, 2), (10, 1, True, 1), (10, 3, True, 2),
    (11, 1, True, 1), (11, 3, True, 2), (1, 4, False, 1), (2, 4, False, 1), (3, 4, False, 1),
    (1, 5, False, 2), (2, 5, False, 2), (3, 5, False, 2), (12, 8, True, 1), (12, 9, False, 2), (13, 8, True, 1),
)

PRINTER_MATERIAL_OVERRIDE = table(
    "printer_material_override", "printer_model_id bigint, am_material_id bigint, is_allowed boolean",
    (3, 5, True), (3, 6, True),
)

AM_TECHNOLOGY_TOLERANCE = table(
    "am_technology_tolerance",
    "am_technology_id bigint, tol_min double, tol_max double, wall_min double, wall_max double, layer_min double,"
    " layer_max double, ra_raw_min double, ra_raw_max double, ra_fin_min double, ra_fin_max double,"
    " thread_pitch double, clearance_min double, clearance_max double",
    (1, 0.3, 0.5, 0.8, 1.2, 0.1, 0.3, 6.3, 25.0, 1.6, 6.3, 1.0, 0.2, 0.4),
    (2, 0.01, 0.1, 0.3, 0.6, 0.025, 0.1, 0.1, 1.6, 0.05, 0.4, 0.5, 0.1, 0.2),
    (3, 0.01, 0.1, 0.3, 0.6, 0.025, 0.1, 0.1, 1.6, 0.05, 0.4, 0.5, 0.1, 0.2),
    (4, 0.15, 0.3, 0.7, 1.0, 0.1, 0.15, 8.0, 18.0, 3.2, 8.0, None, None, None),
)

DIMENSIONAL_TOLERANCE_CLASS = table(
    "dimensional_tolerance_class", "size_min double, size_max double, it6_um double, it7_um double, it8_um double",
    (0.0, 3.0, 6.0, 10.0, 14.0),
    (3.0, 6.0, 8.0, 12.0, 18.0),
    (6.0, 10.0, 9.0, 15.0, 22.0),
    (10.0, 18.0, 11.0, 18.0, 27.0),
    (18.0, 30.0, 13.0, 21.0, 33.0),
)

POSTPROCESSING_EFFECT = table(
    "postprocessing_quality_effect",
    "id bigint, pp_tooling_type_id bigint, tol_min_pct double, tol_max_pct double, ra_min double, ra_max double",
    (1, None, 60.0, 80.0, 5.0, 10.0),
    (2, 5, 20.0, 40.0, 2.0, 4.0),
    (3, None, 30.0, 50.0, 3.0, 6.0),
    (4, None, 40.0, 60.0, 4.0, 8.0),
    (5, 5, 10.0, 25.0, 2.0, 3.0),
)

PRINT_SPEED = table(
    "print_speed_reference", "am_technology_id bigint, volumetric_rate_mm3_s double",
    (1, 4.0), (2, 8.0), (3, 15.0), (4, 3.0),
)

PART_CLASS = table(
    "part_application_class", "id bigint, code varchar, name varchar",
    (1, "NOSE_CONE", "Носовой обтекатель"),
    (2, "FUSELAGE", "Корпус (фюзеляж)"),
    (3, "WING", "Крыло/консоль"),
    (4, "PROPELLER", "Винт (пропеллер)"),
    (5, "MOUNT_BRACKET", "Кронштейн навески"),
    (6, "MOTOR_MOUNT", "Крепление двигателя"),
    (7, "LANDING_GEAR", "Стойка шасси"),
    (8, "DUCT", "Воздуховод/канал (для EDF)"),
    (9, "ANTENNA_HOUSING", "Кожух антенны"),
)

OPERATING_CONDITION = table(
    "operating_condition", "id bigint, condition_type varchar, code varchar, range_min double, range_max double",
    (1, "temperature", "TEMP_AMBIENT", -10.0, 40.0),
    (2, "temperature", "TEMP_HIGH_60_80", 60.0, 80.0),
    (3, "temperature", "TEMP_HIGH_80_100", 80.0, 100.0),
    (4, "airspeed", "AIRSPEED_LOW_0_80", 0.0, 80.0),
    (5, "airspeed", "AIRSPEED_MED_80_150", 80.0, 150.0),
    (6, "airspeed", "AIRSPEED_HIGH_150PLUS", 150.0, None),
    (7, "uv_exposure", "UV_INDOOR", None, None),
    (8, "uv_exposure", "UV_OUTDOOR_LONGTERM", None, None),
    (9, "vibration", "VIBRATION_LOW", None, None),
    (10, "vibration", "VIBRATION_HIGH_MOTOR_MOUNT", None, None),
    (11, "impact", "IMPACT_HIGH_LANDING_CRASH", None, None),
    (12, "humidity", "HUMIDITY_HIGH", None, None),
)

CLASS_CONDITION = table(
    "part_application_class_typical_condition", "class_id bigint, condition_id bigint",
    (1, 6), (1, 8), (1, 11), (2, 8), (2, 9), (3, 5), (3, 6), (3, 8), (4, 10), (5, 10), (5, 11),
    (6, 2), (6, 10), (7, 11), (8, 3), (8, 6), (9, 8),
)

RECOMMENDATION_SOURCE = table(
    "recommendation_source", "id bigint, source_type varchar, reliability varchar",
    (1, "community_practice", "medium"),
    (2, "manufacturer_datasheet", "medium"),
    (3, "community_practice", "medium"),
)

MATERIAL_RECOMMENDATION = table(
    "application_material_recommendation",
    "id bigint, class_id bigint, condition_id bigint, group_id bigint, technology_id bigint, priority int,"
    " min_infill double, wall_count int, source_id bigint",
    (1, 1, 6, 4, 1, 1, 30.0, 4, 1),
    (2, 1, 6, 2, 1, 2, 30.0, 4, 1),
    (3, 1, 8, 4, 1, 1, 30.0, 4, 1),
    (4, 2, None, 2, 1, 1, 15.0, 3, 1),
    (5, 2, 8, 4, 1, 2, 15.0, 3, 1),
    (6, 2, None, 8, 2, 3, None, None, 1),
    (7, 3, 5, 2, 1, 1, 20.0, 4, 1),
    (8, 3, 6, 4, 1, 1, 25.0, 4, 1),
    (9, 4, 10, 6, 1, 1, 100.0, 6, 3),
    (10, 4, 10, 12, 4, 2, 100.0, None, 3),
    (11, 5, 10, 6, 1, 1, 40.0, 4, 3),
    (12, 5, 11, 2, 1, 2, 40.0, 4, 1),
    (13, 6, 2, 6, 1, 1, 60.0, 5, 3),
    (14, 6, 2, 4, 1, 2, 50.0, 5, 1),
    (15, 7, 11, 5, 1, 1, 80.0, 3, 1),
    (16, 7, 11, 6, 1, 2, 60.0, 4, 3),
    (17, 8, 3, 4, 1, 1, 20.0, 3, 1),
    (18, 9, 8, 1, 1, 1, 15.0, 2, 1),
    (19, 9, 8, 2, 1, 2, 15.0, 2, 1),
)

PRINTER_RECOMMENDATION = table(
    "application_printer_recommendation",
    "id bigint, class_id bigint, printer_type_id bigint, min_x double, min_y double, min_z double, priority int",
    (1, 1, 2, 150.0, 150.0, 200.0, 1),
    (2, 3, 2, 300.0, 200.0, 150.0, 1),
    (3, 4, 5, 150.0, 150.0, 50.0, 1),
    (4, 6, 1, 100.0, 100.0, 100.0, 1),
)

# ---- drawing standards ---------------------------------------------------------------------

STANDARD = table(
    "gost_standard", "id bigint, designation varchar, status varchar",
    (2, "ГОСТ Р 2.104-2023", "ACTIVE"),
    (5, "ГОСТ Р 2.109-2023", "ACTIVE"),
    (7, "ГОСТ 2.302-1968", "ACTIVE"),
    (9, "ГОСТ 2.307-2011", "ACTIVE"),
    (11, "ГОСТ Р 2.316-2023", "ACTIVE"),
    (20, "ГОСТ Р 2.308", "ACTIVE"),
    (21, "ГОСТ 2.309", "ACTIVE"),
    (22, "ГОСТ 2.301", "ACTIVE"),
)

CLAUSE = table(
    "gost_clause",
    "id bigint, standard_id bigint, clause_number varchar, parent_clause_id bigint, requirement_type varchar,"
    " parameter_name varchar, comparison_op varchar, limit_min double, limit_max double, allowed_values varchar,"
    " amended_by_id bigint",
    (1, 7, "2-умен", None, "ENUM_CHOICE", "масштаб уменьшения (допустимый ряд)", None, None, None,
     "1:2;1:2,5;1:4;1:5;1:10;1:15;1:20;1:25;1:40;1:50;1:75;1:100;1:200;1:400;1:500;1:800;1:1000", None),
    (2, 7, "2-нат", None, "ENUM_CHOICE", "масштаб натуральной величины", None, None, None, "1:1", None),
    (3, 7, "2-увел", None, "ENUM_CHOICE", "масштаб увеличения (допустимый ряд)", None, None, None,
     "2:1;2,5:1;4:1;5:1;10:1;20:1;40:1;50:1;100:1", None),
    (4, 7, "3", None, "ENUM_CHOICE", "масштаб для генеральных планов крупных объектов", None, None, None,
     "1:2000;1:5000;1:10000;1:20000;1:25000;1:50000", None),
    (5, 7, "4", None, "ENUM_CHOICE", "масштаб увеличения по формуле (100n):1", None, None, None, None, None),
    (6, 7, "5", None, "PROCEDURAL", None, None, None, None, None, 10),
    (7, 9, "5", None, "PROCEDURAL", None, None, None, None, None, None),
    (8, 9, "5.37", 7, "NUMERIC_LIMIT", "радиус скругления, не указываемый непосредственно на изображении",
     "<=", None, 1.0, None, None),
    (9, 9, "5.44", 7, "NUMERIC_LIMIT", "фаска 45°, размер которой в масштабе чертежа допускается не изображать",
     "<=", None, 1.0, None, None),
    (10, 9, "6", None, "PROCEDURAL", None, None, None, None, None, None),
    (11, 11, "6", None, "PROCEDURAL", None, None, None, None, None, None),
    (12, 11, "6.3-1", 11, "NUMERIC_LIMIT", "расстояние между текстом ТТ и верхней рамкой листа (формат более А4)",
     ">=", 10.0, None, None, None),
    (13, 11, "6.3-2", 11, "NUMERIC_LIMIT", "ширина колонки текста технических требований",
     "<=", None, 185.0, None, None),
    (14, 11, "6.3-3", 11, "NUMERIC_LIMIT", "расстояние между колонками текста технических требований",
     "BETWEEN", 15.0, 20.0, None, None),
    (15, 5, "4.6", None, "CROSS_REFERENCE", None, None, None, None, None, None),
    (16, 5, "5.9", None, "CROSS_REFERENCE", None, None, None, None, None, None),
    (17, 5, "5.10", None, "CROSS_REFERENCE", None, None, None, None, None, None),
    (18, 5, "5.12", None, "PROCEDURAL", None, None, None, None, None, None),
)

CLAUSE_REFERENCE = table(
    "gost_clause_reference", "from_clause_id bigint, to_clause_id bigint, to_designation varchar, reference_type varchar",
    (16, 11, None, "REFERS_TO"),
    (17, 10, None, "REFERS_TO"),
    (17, None, "ГОСТ Р 2.308", "REFERS_TO"),
    (17, None, "ГОСТ 2.309", "REFERS_TO"),
    (15, None, "ГОСТ 2.301", "REFERS_TO"),
    (15, None, "ГОСТ 2.302-1968", "REFERS_TO"),
    (18, 17, None, "EXCEPTION_TO"),
    (4, 1, None, "EXCEPTION_TO"),
    (5, 3, None, "EXCEPTION_TO"),
)

TITLE_BLOCK_FIELD = table(
    "gost_title_block_field",
    "id bigint, standard_id bigint, field_number varchar, field_heading varchar, content_kind varchar, required_paper varchar",
    (1, 2, "1", None, "Реквизит КД «Наименование»", "●"),
    (2, 2, "2", None, "Реквизит КД «Обозначение»", "●"),
    (3, 2, "3", None, "Техническая характеристика изделия", "○"),
    (4, 2, "4", "Лит.", "Реквизит КД «Литера»", "○"),
    (5, 2, "5", "Масса", "Техническая характеристика изделия", "○"),
    (6, 2, "6", "Масштаб", "Реквизит КД «Масштаб»", "○"),
    (32, 2, "32", "Формат", "Реквизит КД «Формат листа»", "●"),
)

# Which column of a drawing holds which numbered field.
TITLE_BLOCK_MAP = table(
    "title_block_map", "field_pos int, attr varchar, field_number varchar",
    (1, "part_name", "1"), (2, "designation", "2"), (3, "material", "3"), (4, "mass", "5"),
    (5, "scale", "6"), (6, "sheet_format", "32"),
)

# ---- plant -----------------------------------------------------------------------------------

PLANT_ZONE = table(
    "plant_zone", "factory varchar, zone_pos int, zone_id varchar, status varchar, base_load double",
    ("metal", 0, "warehouse", "online", 73.0), ("metal", 1, "cutting", "online", 86.0),
    ("metal", 2, "forming", "online", 81.0), ("metal", 3, "cnc", "online", 91.0),
    ("metal", 4, "metal3d", "warning", 62.0), ("metal", 5, "heat", "online", 78.0),
    ("metal", 6, "surface", "online", 68.0), ("metal", 7, "quality", "online", 74.0),
    ("metal", 8, "assembly", "online", 84.0), ("metal", 9, "finished", "online", 65.0),
)
PLANT_FLOW = table(
    "plant_flow", "factory varchar, src varchar, dst varchar",
    ("metal", "warehouse", "cutting"), ("metal", "cutting", "forming"), ("metal", "forming", "cnc"),
    ("metal", "forming", "metal3d"), ("metal", "cnc", "heat"), ("metal", "metal3d", "heat"),
    ("metal", "heat", "surface"), ("metal", "surface", "quality"), ("metal", "quality", "assembly"),
    ("metal", "assembly", "finished"),
)
CONTROL_EDGE = table(
    "control_edge", "src varchar, dst varchar",
    ("gateway", "cloud"), ("network", "gateway"), ("safety", "network"), ("energy", "cloud"),
)

TABLES: dict[str, FixedTable] = {t.name: t for t in list(globals().values()) if isinstance(t, FixedTable)}


def load(spark: SparkSession, name: str, with_seed: bool = True) -> DataFrame:
    """One reference table; ``with_seed=False`` keeps the schema and drops the rows."""
    return TABLES[name].load(spark, with_seed)
