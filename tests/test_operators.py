"""Ordered, geometric, search and stream operators against brute force on small fixtures."""

import math
import random

import pytest

from pyspark.sql import functions as F

from partwright.operators import features as ft
from partwright.operators import graph
from partwright.operators import layout as ly
from partwright.operators import regions as rg
from partwright.operators import search as se
from partwright.operators import sequences as seq
from partwright.operators import toolpath as tp
from partwright.streaming import zones


def test_bucketed_windows(spark):
    random.seed(3)
    rows = [(k, p, random.randint(0, 9), float(random.randint(0, 99))) for k, n in ((1, 23), (2, 1), (3, 10)) for p in range(1, n + 1)]
    df = spark.createDataFrame(rows, "k long, p long, v int, x double")
    run = {(r.k, r.p): r.s for r in seq.running_sum(df, ["k"], "p", F.col("v"), "s", size=5).collect()}
    prev = {(r.k, r.p): r.prev_x for r in seq.with_previous(df, ["k"], "p", ["x"], size=5).collect()}
    rank = {(r.k, r.p): r.position for r in seq.dense_position(df, ["k"], [F.floor(F.col("p") / 4)], ["p"]).collect()}
    held = {(r.k, r.p): r.h for r in seq.carry_forward(df.withColumn("o", F.when(F.col("v") > 6, F.col("x"))), ["k"], "p", F.floor(F.col("p") / 4), "o", "h").collect()}
    for k, p, v, x in rows:
        group = [r for r in rows if r[0] == k and r[1] <= p]
        assert run[k, p] == sum(r[2] for r in group)
        assert prev[k, p] == (group[-2][3] if p > 1 else None)
        assert rank[k, p] == p
        known = [r[3] for r in group if r[2] > 6]
        assert held[k, p] == (known[-1] if known else None)


def test_rapid_moves_do_not_cut(spark):
    rows = [(1, 1, 1, "rapid", 0.0), (1, 1, 2, "rapid", 5.0), (1, 1, 3, "linear", 9.0), (1, 2, 4, "linear", 9.0), (1, 2, 5, "linear", 1.0)]
    moves = spark.createDataFrame([(*r, 0.0, 0.0, 1.0) for r in rows], "plan_id long, op_no int, move_no long, kind string, x double, y double, z double, tool_diameter double")
    assert [(r.cuts, r.step) for r in tp.cutting_steps(moves).orderBy("move_no").collect()] == [(False, 0), (False, 0), (True, 1), (False, 1), (True, 2)]
    assert [(r.start_step, r.end_step) for r in tp.step_ranges(moves).orderBy("op_no").collect()] == [(0, 1), (1, 3)]


def test_few_coaxial_cylinders_are_no_revolved_part(spark):
    face = lambda part, n, kind, az: (part, n, kind, 0.0, 0.0, az, 2 * math.pi)
    rows = [face(1, i, "cylindrical", 1.0 if i % 2 else -1.0) for i in range(3)] + [face(1, 9, "planar", 1.0)]
    rows += [face(2, i, "cylindrical", 1.0) for i in range(2)] + [face(2, 9, "planar", 1.0), face(2, 10, "other", 0.0)]
    faces = spark.createDataFrame(rows, "part_id long, face_id long, face_kind string, ax double, ay double, az double, angular_extent double")
    got = {r.part_id: (r.revolved, r.supported, r.unrecognised, r.holes) for r in ft.part_summary(faces).collect()}
    assert got == {1: (True, False, 4, 0), 2: (False, True, 1, 2)}


def brute_clusters(rects, t=15.0):
    """Pairs in drawing order: the first box is widened, the second must have an area."""
    rects = sorted(rects, key=lambda r: r[1])
    n, parent = len(rects), list(range(len(rects)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    cell = [(int(r[2] // (2 * t)), int(r[3] // (2 * t))) for r in rects]
    for i in range(n):
        for j in range(i + 1, n):
            a, b = rects[i], rects[j]
            near = a[0] == b[0] and all(abs(cell[i][k] - cell[j][k]) <= 1 for k in (0, 1))
            solid = b[4] > b[2] and b[5] > b[3]
            if near and solid and a[2] - t < b[4] and b[2] < a[4] + t and a[3] - t < b[5] and b[3] < a[5] + t:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rects[i])
    return sorted((g[0][0], min(r[2] for r in g), min(r[3] for r in g), max(r[4] for r in g), max(r[5] for r in g), len(g)) for g in groups.values() if len(g) >= 8)


def test_clusters_equal_pairwise_union(spark):
    random.seed(5)
    places = [(p, float(random.randint(0, 260)), float(random.randint(0, 260))) for p in (1, 2) for _ in range(90)]
    rects = [(p, k, x, y, x + random.choice([0.0, 1.0, 4.0, 30.0]), y + random.choice([0.0, 1.0, 6.0, 22.0])) for k, (p, x, y) in enumerate(places)]
    df = spark.createDataFrame(rects, "page_id long, seq long, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, rg.clusters(spark, df).collect())) == brute_clusters(rects)
    counted = rg.members_per_region(df.where("seq < 9 and x1 > x0 and y1 > y0"), df).collect()
    for r in counted:
        assert r.element_count == sum(q[0] == r.page_id and q[4] > q[2] and q[5] > q[3] and q[2] < r.x1 and r.x0 < q[4] and q[3] < r.y1 and r.y0 < q[5] for q in rects)


def drawn_rects(width, count, seed):
    random.seed(seed)
    places = [(p, float(random.randint(-width, width)), float(random.randint(-width, width) // 4)) for p in (1, 2) for _ in range(count)]
    return [(p, k, x, y, x + random.choice([0.0, 1.0, 4.0, 30.0]), y + random.choice([0.0, 1.0, 6.0, 22.0])) for k, (p, x, y) in enumerate(places)]


@pytest.mark.parametrize("width, rows", [(1500, 500_000), (1500, 40), (60, 40)])
def test_clusters_beyond_a_tile_and_tiles_beyond_a_task(spark, monkeypatch, width, rows):
    monkeypatch.setattr(rg, "ROWS", rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rects = drawn_rects(width, 400, 6)
        df = spark.createDataFrame(rects, "page_id long, seq long, x0 double, y0 double, x1 double, y1 double")
        assert sorted(map(tuple, rg.clusters(spark, df).collect())) == brute_clusters(rects)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_linked_subcells_come_once_and_boxes_are_shuffled_once(spark):
    rects = drawn_rects(150, 200, 7)
    df = spark.createDataFrame(rects, "page_id long, seq long, x0 double, y0 double, x1 double, y1 double")
    want = set()
    solid = [(r[0], int(r[2] // 15), int(r[3] // 15), *r[2:]) for r in rects if r[4] > r[2] and r[5] > r[3]]
    for a in solid:
        for b in solid:
            near = a[0] == b[0] and all(abs(a[k] // 2 - b[k] // 2) <= 1 for k in (1, 2)) and b[1:3] > a[1:3]
            if near and a[3] - 15 < b[5] and b[3] < a[5] + 15 and a[4] - 15 < b[6] and b[4] < a[6] + 15:
                want.add((a[0], a[1], a[2], b[1], b[2]))
    links = rg.linked_subcells(df)
    assert sorted(map(tuple, links.collect())) == sorted(want)
    assert links._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2  # the plan, before and after it ran


def test_components_within_keys(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "c", "b"), (1, "d", "e"), (2, "p", "q"), (2, "a", "p")], "k long, src string, dst string")
    nodes = spark.createDataFrame([(1, n) for n in "abcdef"] + [(2, n) for n in "apq"], "k long, node string")
    want = {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "d"): "d", (1, "e"): "d", (1, "f"): "f", (2, "a"): "a", (2, "p"): "a", (2, "q"): "a"}
    assert {(r.k, r.node): r.component for r in graph.components_within(spark, nodes, edges, "k").collect()} == want


def test_a_long_chain_settles(spark):
    n = 10_000
    edges = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("src"), ((F.col("id") + 1) * 7919 % n).alias("dst"))
    found = graph.connected(edges)
    assert found.agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).first() == (n, 0, 0)


def test_closure_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {(r.src, r.dst) for r in graph.closure(spark, edges).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}


def test_inflected_question_finds_the_steel(spark):
    rows = spark.createDataFrame([(1, "Сталь 45", "Валы"), (2, "40Х", "Оси"), (3, "a_b", "x%y")], "id long, grade string, use string")
    index = se.index_of(rows, 1, "material", "id", ["grade", "use"], ["grade", "use"])
    asked = spark.createDataFrame([(1, "Какие марки стали есть в базе?"), (2, "ничего такого"), (3, "40х"), (4, "a_b"), (5, "' OR 1=1 --")], "q long, question string")
    found = se.search(asked, index, ["q"])
    assert sorted((r.q, r.row_id) for r in found.collect()) == [(1, 1), (3, 2), (4, 3)]
    texts = {r.q: r.answer for r in se.answers(asked.select("q"), found, ["q"]).collect()}
    assert texts[2] == se.NO_MATCH_TEXT and texts[1].splitlines()[1] == "— material · Сталь 45 · Валы"


def test_numbered_lines_need_the_next_number_and_a_letter(spark):
    text = "1. Первое.\n3. Лишнее\n2. 15.03\n2. Второе \nтекст\n3. Третье\n01.02.2024"
    rows = ly.numbered_requirements(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.number, r.text) for r in rows] == [(1, "Первое"), (2, "Второе"), (3, "Третье")]


def test_offline_zone_holds_the_last_load(spark):
    rows = [(1, 0, "online", 20.0), (1, 4, "offline", 0.0), (1, 8, "online", 120.0), (2, 1, "offline", 5.0)]
    df = spark.createDataFrame([(z, 1700000000 + t, t, s, l) for z, t, s, l in rows], "zone_id long, sec long, reading_id long, status string, load double")
    out = zones.hold_last(zones.window_loads(df.withColumn("ts", F.timestamp_seconds("sec"))))
    assert [(r.zone_id, r.status, r.load) for r in out.orderBy("zone_id", "window_ms").collect()] == [(1, "online", 40.0), (1, "offline", 40.0), (1, "online", 99.0), (2, "offline", None)]


def test_stream_equals_batch(spark):
    from partwright.bindings import all_queries

    queries, d = all_queries().queries, "/root/testdata/sf0.001"
    batch = sorted(map(str, queries["r1_continuous_review_batch"](spark, d).collect()))
    stream = sorted(map(str, queries["r1_continuous_review_stream"](spark, d).select("part_id", "rank", "severity", "finding_code", "arg").collect()))
    assert stream == batch


def test_streams_of_three_batches_with_late_rows_equal_batch(spark, tmp_path):
    from partwright.bindings import stream_queries as sq
    from partwright.plans import review
    from partwright.streaming import reviews, runs

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(400).cache()
    # The oldest rows come in the last file, and some rows come twice.
    for k, part in enumerate(["event_id % 3 = 0", "event_id % 3 = 1 or event_id % 10 = 0", "event_id % 3 = 2"]):
        events.where(part).orderBy("ts", ascending=False).coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{k}"))
        for f in (tmp_path / f"part{k}").glob("*.parquet"):
            f.rename(tmp_path / f"{k}.parquet")
    stream = runs.source(spark, str(tmp_path), "?.parquet", events.schema, files_per_batch=1)
    want = sorted(map(str, zones.hold_last(zones.window_loads(sq.as_readings(events))).collect()))
    assert sorted(map(str, zones.load_stream(sq.as_readings(stream)).collect())) == want
    got = reviews.review_stream(spark, sq.as_submissions(stream))
    want = review.drawing_findings(spark, sq.as_submissions(events))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_step_texts_of_a_small_table_are_made_in_many_tasks(spark, tmp_path):
    from partwright.bindings import document_queries as dq

    spark.range(1, 40).selectExpr("id AS p_partkey", "id % 9 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    files = dq.step_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() >= 4 and files.select("file_id").distinct().count() == 39


def test_words_become_lines_before_they_are_shuffled(spark):
    random.seed(12)
    rows = []
    for doc, line in ((d, l) for d in (1, 2, None) for l in range(40)):
        for no in range(random.randint(1, 12)):
            left = random.choice([None, math.nan, 1.0, 7.5, -3.0, math.inf]) if line % 7 == 0 else random.random()
            rows.append((doc, line % 3, line // 5, line, no, left, random.random(), 2.0, random.choice([1.0, math.nan]), random.choice(["a", "b c", " ", "", None, "ж"])))
    words = spark.createDataFrame(rows, "doc_id long, block_num int, par_num int, line_num int, word_no int, left double, top double, width double, height double, text string")
    keys = ["doc_id", "block_num", "par_num", "line_num"]
    kept = words.where("trim(text) <> ''")
    want = kept.groupBy(*keys).agg(
        (F.min("left") / 2).alias("x0"), (F.min("top") / 2).alias("y0"), (F.max(F.col("left") + 2) / 2).alias("x1"), (F.max(F.col("top") + F.col("height")) / 2).alias("y1"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda w: w["text"]), " ").alias("text"),
    )
    for given in (words.coalesce(1), words.repartition(3, F.rand(1))):
        got = ly.words_to_lines(given, 2.0)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        written = got._jdf.queryExecution().executedPlan().toString()
        assert written.index("Exchange") < written.index("MapInArrow")  # the plan is printed from its end


def test_only_large_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(seq, "BUCKET_ROWS", 6)
    random.seed(7)
    rows = [(k, random.choice([None, 1, 2, 3]), p, random.randint(0, 9)) for k, n in ((1, 40), (2, 3), (3, 6), (None, 4), (5, 17)) for p in range(n)]
    df = spark.createDataFrame(rows, "k long, c int, p int, v int").repartition(3)
    sums = {"up": lambda now, before: F.when(F.coalesce(before("v") < now("v"), F.lit(True)), now("v"))}
    got = seq.scan(df, ["k"], [F.col("c"), F.floor(F.col("p") / 2)], ["c", "p"], "at", ["v"], sums, fine=True).collect()
    want = []
    for key in (1, 2, 3, None, 5):
        total, before = 0, None
        for at, (k, c, p, v) in enumerate(sorted([r for r in rows if r[0] == key], key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            total += v if before is None or before < v else 0
            want.append((k, c, p, v, at, before, total))
            before = v
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_values_are_carried_over_slots_and_null_keys(spark):
    rows = [(k, o, 10 * o if o in (0, 5) else None) for k in (1, None) for o in range(9)]
    df = spark.createDataFrame(rows, "k int, o int, v int")
    held = seq.carry_forward(df, ["k"], "o", F.floor(F.col("o") / 9), "v", "h").collect()
    assert sorted([(r.k, r.o, r.h) for r in held], key=str) == sorted([(k, o, 50 if o >= 5 else 0) for k, o, _ in rows], key=str)
