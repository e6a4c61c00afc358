"""Catalog, integrity, classifier and graph queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from partwright.bindings import facts
from partwright.bindings import sqlfrag as q
from partwright.bindings.spec import FACT_SQL, REGISTRY
from partwright.functions import text as tx
from partwright.operators import graph
from partwright.sources import catalog
from partwright.session import shared_folder
from partwright.sources.joins import lookup, settle
from partwright.sources.reference import load

add = REGISTRY.add
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in NAMES)


def tables(spark, d, names=NAMES):
    return catalog.open_tables(spark, d, names, ".parquet")


@add("s3_table_list", COUNTS)
def _(spark, d):
    return catalog.table_counts(tables(spark, d))


@add("a1_row_counts", COUNTS)
def _(spark, d):
    return catalog.table_counts({n: facts.read(spark, d, n) for n in NAMES})


@add("s2_open_table", "SELECT p_type, count(*) AS parts FROM part GROUP BY p_type")
def _(spark, d):
    tables(spark, d, ["part"])
    return spark.sql("SELECT p_type, count(*) AS parts FROM part GROUP BY p_type")


PREVIEW = ("SELECT coalesce(p_partkey::VARCHAR, '') AS p_partkey, coalesce(p_name, '') AS p_name, coalesce(p_brand, '') AS p_brand, coalesce(p_type, '') AS p_type,"
           " coalesce(p_size::VARCHAR, '') AS p_size, coalesce(p_retailprice::VARCHAR, '') AS p_retailprice, (SELECT count(*) FROM part) AS total_rows,"
           " (SELECT count(*) FROM part) > 200 AS truncated FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 200)")


@add("s4_table_preview", PREVIEW)
def _(spark, d):
    return catalog.preview(tables(spark, d, ["part"]), "part", ["p_partkey"])


@add("t6_preview_limit", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority FROM orders ORDER BY orders.o_orderkey LIMIT 200")
def _(spark, d):
    return catalog.preview(tables(spark, d, ["orders"]), "orders", ["o_orderkey"]).select("o_orderkey", "o_orderpriority")


@add("s5_columns", " UNION ALL ".join(f"SELECT '{n}' AS table_name, string_agg(column_name, ',' ORDER BY column_index) AS columns, (SELECT count(*) FROM {n}) AS rows"
                                      f" FROM duckdb_columns() WHERE table_name = '{n}' AND NOT internal" for n in NAMES))
def _(spark, d):
    """Columns come from the schema alone, also of empty tables; the count shows the table they belong to."""
    opened = tables(spark, d)
    names = {n: ",".join(df.columns) for n, df in opened.items()}
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return catalog.table_counts(opened).select("table_name", mapping[F.col("table_name")].alias("columns"), "rows")


FKS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"),
    ("lineitem", "l_partkey", "documents", "doc_id"),
]


@add("s6_referential_integrity", " UNION ALL ".join(
    f"SELECT '{c}.{k}->{p}' AS rule, count(*) AS violations FROM {c} WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} WHERE {p}.{pk} = {c}.{k})" for c, k, p, pk in FKS))
def _(spark, d):
    from functools import reduce

    rows = [catalog.orphans(facts.read(spark, d, c), k, facts.read(spark, d, p), pk, f"{c}.{k}->{p}") for c, k, p, pk in FKS]
    return reduce(lambda a, b: a.unionByName(b), rows)


@add("s7_constraints", """SELECT 'order status' AS rule, count(*) AS violations FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT 'event type', count(*) FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup', 'error')
    UNION ALL SELECT 'unique order', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'unique order line', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'priced or taxed', count(*) FROM lineitem WHERE NOT coalesce(l_discount > 0 OR l_tax > 0, FALSE)""")
def _(spark, d):
    orders, events, lines = (facts.read(spark, d, n) for n in ("orders", "events", "lineitem"))
    return (
        catalog.outside_domain(orders, "o_orderstatus", ["F", "O"], "order status")
        .unionByName(catalog.outside_domain(events, "event_type", ["click", "view", "purchase", "signup", "error"], "event type"))
        .unionByName(catalog.duplicates(orders, ["o_orderkey"], "unique order"))
        .unionByName(catalog.duplicates(lines, ["l_orderkey", "l_linenumber"], "unique order line"))
        .unionByName(catalog.broken_predicate(lines, (F.col("l_discount") > 0) | (F.col("l_tax") > 0), "priced or taxed"))
    )


@add("s8_resolve_codes", """SELECT part_id, op_code, o.id AS operation_type_id FROM (SELECT p_partkey AS part_id,
    list_extract(['TURN_ROUGH', 'MILL', 'WELD', 'DRILL'], CAST(p_partkey % 4 AS INT) + 1) AS op_code FROM part) s LEFT JOIN operation_type o ON o.code = s.op_code""")
def _(spark, d):
    key = F.col("p_partkey")
    staging = facts.read(spark, d, "part").select(key.alias("part_id"), facts.pick(["TURN_ROUGH", "MILL", "WELD", "DRILL"], key).alias("op_code"))
    return catalog.resolve_codes(staging, "op_code", load(spark, "operation_type"), id_name="operation_type_id")


DESIGNATIONS = ["ГОСТ Р 2.109-2023", "ГОСТ 2.302-1968", "ГОСТ 2.999", "ГОСТ Р 2.316-2023", "ГОСТ 2.307-2011"]
CLAUSES = ["5.9", "5.10", "6", "3", "4.6", "2-умен", "6.3-1"]


def staged_edges(spark, d):
    key = F.col("p_partkey")
    return facts.read(spark, d, "part").select(
        key.alias("edge_id"), facts.pick(DESIGNATIONS, key).alias("src_designation"), facts.pick(CLAUSES, key).alias("src_clause"),
        facts.pick(DESIGNATIONS, key + F.col("p_size")).alias("dst_designation"), facts.pick(CLAUSES, key + F.col("p_size")).alias("dst_clause"),
    )


FACT_SQL["edge_ids"] = f"""SELECT edge_id, a.id AS src_id, b.id AS dst_id, CASE WHEN a.id IS NULL AND b.id IS NULL THEN 'both' WHEN a.id IS NULL THEN 'src'
  WHEN b.id IS NULL THEN 'dst' END AS unresolved FROM (SELECT p_partkey AS edge_id, {facts.pick_sql(DESIGNATIONS, 'p_partkey')} AS sd, {facts.pick_sql(CLAUSES, 'p_partkey')} AS sc,
  {facts.pick_sql(DESIGNATIONS, 'p_partkey + p_size')} AS dd, {facts.pick_sql(CLAUSES, 'p_partkey + p_size')} AS dc FROM part) e
  LEFT JOIN (SELECT c.*, s.designation FROM gost_clause c JOIN gost_standard s ON s.id = c.standard_id) a ON a.designation = e.sd AND a.clause_number = e.sc
  LEFT JOIN (SELECT c.*, s.designation FROM gost_clause c JOIN gost_standard s ON s.id = c.standard_id) b ON b.designation = e.dd AND b.clause_number = e.dc"""


def clause_nodes(spark):
    names = load(spark, "gost_standard").select(F.col("id").alias("standard_id"), "designation")
    return settle(load(spark, "gost_clause").join(names, "standard_id").select("id", "designation", "clause_number"))


@add("s9_cross_reference_edges", "SELECT * FROM edge_ids")
def _(spark, d):
    return catalog.resolve_edges(staged_edges(spark, d), clause_nodes(spark))


@add("s1_reference_build", """SELECT p.p_partkey AS part_id, m.grade, m.chemical_composition, m.heat_treatment, g.code AS group_code, count(b.id) AS blanks FROM part p
    JOIN material m ON m.id = 1 + p.p_partkey % 21 JOIN material_group g ON g.id = m.material_group_id LEFT JOIN workpiece_blank b ON b.material_id = m.id GROUP BY ALL""")
def _(spark, d):
    """The shipped reference tables (46 of the reference's 80) are built from schema and seeds in the shared folder; parts are joined to what was built."""
    folder = f"{shared_folder(spark)}/reference-{uuid.uuid4().hex}"
    built = catalog.open_tables(spark, folder, catalog.build_reference(spark, folder))
    groups = built["material_group"].select(F.col("id").alias("material_group_id"), F.col("code").alias("group_code"))
    blanks = built["workpiece_blank"].groupBy(F.col("material_id").alias("id")).agg(F.count("*").alias("blanks"))
    materials = built["material"].join(groups, "material_group_id").join(blanks, "id", "left")
    parts = facts.read(spark, d, "part").select(F.col("p_partkey").alias("part_id"), (1 + F.col("p_partkey") % 21).alias("id"))
    return lookup(parts, materials, "id", "inner").select(
        "part_id", "grade", "chemical_composition", "heat_treatment", "group_code", F.coalesce("blanks", F.lit(0)).alias("blanks"))


@add("f1_material_scan", f"""SELECT m.id, m.grade, m.gost_standard, m.density_kg_m3, m.tensile_strength_mpa, m.hardness_hb, m.hardness_hrc, m.red_hardness_c, m.machinability_index,
    m.chemical_composition, m.heat_treatment, m.application, count(d.part_id) AS drawings FROM material m LEFT JOIN drawings d ON {q.grade_key("nullif(d.material, '')")} = {q.normalize_grade('m.grade')} GROUP BY ALL""")
def _(spark, d):
    columns = ["id", "grade", "gost_standard", "density_kg_m3", "tensile_strength_mpa", "hardness_hb", "hardness_hrc", "red_hardness_c", "machinability_index", "chemical_composition", "heat_treatment", "application"]
    used = facts.drawings(spark, d).groupBy(tx.grade_key(F.when(F.col("material") != "", F.col("material"))).alias("gk")).agg(F.count(F.lit(1)).alias("n"))
    keyed = load(spark, "material").select(*columns, tx.normalize_grade(F.col("grade")).alias("gk"))
    return keyed.join(used, "gk", "left").select(*columns, F.coalesce("n", F.lit(0)).alias("drawings"))


@add("f2_blank_scan", f"""SELECT b.id, b.designation, b.diameter_mm, {q.mention('b.designation')} AS gost_standard, count(d.part_id) AS drawings FROM workpiece_blank b
    LEFT JOIN drawings d ON {q.mention('d.blank_designation')} = {q.mention('b.designation')} GROUP BY ALL""")
def _(spark, d):
    used = facts.drawings(spark, d).groupBy(tx.standard_mention(F.col("blank_designation")).alias("gost_standard")).agg(F.count(F.lit(1)).alias("n"))
    blanks = load(spark, "workpiece_blank").select("id", "designation", "diameter_mm", tx.standard_mention(F.col("designation")).alias("gost_standard"))
    return blanks.join(used, "gost_standard", "left").select("id", "designation", "diameter_mm", "gost_standard", F.coalesce("n", F.lit(0)).alias("drawings"))


FACT = """SELECT id, concat_ws(', ', 'плотность ' || printf('%g', density_kg_m3) || ' кг/м³', 'предел прочности ' || printf('%g', tensile_strength_mpa) || ' МПа',
  'твёрдость ' || printf('%g', hardness_hb) || ' HB', 'твёрдость ' || printf('%g', hardness_hrc) || ' HRC', 'красностойкость ' || printf('%g', red_hardness_c) || '°C',
  'индекс обрабатываемости ' || printf('%g', machinability_index), 'применение: ' || application) AS props FROM material"""


@add("h38_material_fact_line", f"SELECT part_id, matched_grade || ' ' || matched_standard || ' (' || props || ')' AS fact FROM material_match JOIN ({FACT}) f ON f.id = matched_material_id")
def _(spark, d):
    from partwright.bindings import match_queries as mq
    from partwright.functions import numbers as nx

    def prop(prefix, column, suffix):
        return F.concat(F.lit(prefix), nx.short(F.col(column)), F.lit(suffix))

    props = F.concat_ws(
        ", ", prop("плотность ", "density_kg_m3", " кг/м³"), prop("предел прочности ", "tensile_strength_mpa", " МПа"), prop("твёрдость ", "hardness_hb", " HB"),
        prop("твёрдость ", "hardness_hrc", " HRC"), prop("красностойкость ", "red_hardness_c", "°C"), prop("индекс обрабатываемости ", "machinability_index", ""),
        F.concat(F.lit("применение: "), "application"),
    )
    lines = settle(load(spark, "material").select(F.col("id").alias("matched_material_id"), F.concat("grade", F.lit(" "), "gost_standard", F.lit(" ("), props, F.lit(")")).alias("fact")))
    return lookup(mq.material_match(spark, d), lines, "matched_material_id", "inner").select("part_id", "fact")


# ---- graph -----------------------------------------------------------------------------------


@add("x6_hierarchy_closure", """WITH RECURSIVE up AS (SELECT id, parent_id, 1 AS depth FROM equipment_type WHERE parent_id IS NOT NULL
    UNION ALL SELECT u.id, e.parent_id, u.depth + 1 FROM up u JOIN equipment_type e ON e.id = u.parent_id WHERE e.parent_id IS NOT NULL)
    SELECT p.p_partkey AS part_id, u.parent_id AS ancestor_id, u.depth FROM part p JOIN up u ON u.id = 1 + p.p_partkey % 11""")
def _(spark, d):
    """Ancestors by their tours: an interval per node is kept, not the pairs."""
    tours = settle(graph.euler_tours(load(spark, "equipment_type").select(F.col("id").alias("node"), F.col("parent_id").alias("parent"))))
    parts = facts.read(spark, d, "part").select(F.col("p_partkey").alias("part_id"), (1 + F.col("p_partkey") % 11).alias("equipment_type_id"))
    found = graph.above(tours, parts.select(F.col("equipment_type_id").alias("node")))
    ancestors = found.select(F.col("node").alias("equipment_type_id"), F.col("ancestor").alias("ancestor_id"), "depth")
    return lookup(parts, ancestors, "equipment_type_id", "inner").select("part_id", "ancestor_id", "depth")


@add("x7_reference_reachability", """WITH RECURSIVE e AS (SELECT DISTINCT src_id AS src, dst_id AS dst FROM edge_ids WHERE src_id IS NOT NULL AND dst_id IS NOT NULL
    UNION SELECT from_clause_id, to_clause_id FROM gost_clause_reference WHERE to_clause_id IS NOT NULL),
    reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)
    SELECT src, 'clause ' || dst AS target FROM reach
    UNION SELECT r.src, x.to_designation FROM (SELECT src, dst FROM reach UNION SELECT id, id FROM gost_clause) r
      JOIN gost_clause_reference x ON x.from_clause_id = r.dst WHERE x.to_designation IS NOT NULL""")
def _(spark, d):
    """Clauses reachable over resolved edges, and the outside standards those clauses name."""
    resolved = catalog.resolve_edges(staged_edges(spark, d), clause_nodes(spark)).where("unresolved IS NULL").select(
        F.col("src_id").alias("src"), F.col("dst_id").alias("dst")
    ).distinct()
    known = load(spark, "gost_clause_reference")
    edges = resolved.unionByName(known.where("to_clause_id IS NOT NULL").select(F.col("from_clause_id").alias("src"), F.col("to_clause_id").alias("dst")))
    reach = graph.closure(spark, edges).select("src", "dst")
    own = load(spark, "gost_clause").select(F.col("id").alias("src"), F.col("id").alias("dst"))
    outside = reach.unionByName(own).distinct().join(
        known.where("to_designation IS NOT NULL").select(F.col("from_clause_id").alias("dst"), "to_designation"), "dst"
    ).select("src", F.col("to_designation").alias("target"))
    return reach.select("src", F.concat(F.lit("clause "), F.col("dst").cast("string")).alias("target")).unionByName(outside).distinct()


@add("x8_amended_clause", """SELECT p_partkey AS part_id, c.clause_number, CASE WHEN c.amended_by_id IS NOT NULL THEN 'amended' ELSE 'original' END AS edition,
    coalesce(CASE WHEN c.amended_by_id IS NOT NULL THEN 'before amendment ' || c.amended_by_id END, c.clause_number) AS prior_text FROM part JOIN gost_clause c ON c.id = 1 + p_partkey % 18""")
def _(spark, d):
    clauses = load(spark, "gost_clause").select(F.col("id").alias("clause_id"), "clause_number", "amended_by_id")
    parts = facts.read(spark, d, "part").select(F.col("p_partkey").alias("part_id"), (1 + F.col("p_partkey") % 18).alias("clause_id"))
    out = lookup(parts, clauses, "clause_id", "inner")
    prior = F.concat(F.lit("before amendment "), F.col("amended_by_id").cast("string"))
    return out.select(
        "part_id", "clause_number", F.when(F.col("amended_by_id").isNotNull(), "amended").otherwise("original").alias("edition"),
        F.coalesce(prior, "clause_number").alias("prior_text"),
    )


ZONES = ["warehouse", "cutting", "forming", "cnc", "metal3d", "heat", "surface", "quality", "assembly", "finished"]


@add("j20_flow_graph", f"""WITH seen AS (SELECT DISTINCT {facts.pick_sql(ZONES, 'user_id')} AS zone_id FROM events)
    SELECT f.factory, f.src, f.dst, 'material' AS edge_type FROM plant_flow f WHERE f.src IN (SELECT zone_id FROM seen) AND f.dst IN (SELECT zone_id FROM seen)
    UNION ALL SELECT 'metal', zone_id, 'gateway', 'telemetry' FROM seen UNION ALL SELECT 'metal', src, dst, 'control' FROM control_edge""")
def _(spark, d):
    zones = facts.read(spark, d, "events").select(F.lit("metal").alias("factory"), facts.pick(ZONES, F.col("user_id")).alias("zone_id")).distinct()
    return graph.plant_edges(zones, load(spark, "plant_flow"), load(spark, "control_edge"))
