"""Silhouettes of planted pictures against a flood fill in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from partwright.operators import graph
from partwright.operators import silhouette as si
from partwright.session import cut_lineage


def table(spark, pictures):
    rows = [(k, x, y, 10 if c == "#" else 200) for k, lines in pictures.items() for y, line in enumerate(lines) for x, c in enumerate(line)]
    return spark.createDataFrame(rows, "photo_id long, x int, y int, grey int")


def mask_of(spark, pictures):
    pixels = table(spark, pictures)
    found = {k: set() for k in pictures}
    for r in si.masks(pixels, pixels.select("photo_id").distinct().withColumn("threshold", F.lit(100))).collect():
        found[r.photo_id].add((r.x, r.y))
    return found


def flooded(lines):
    """Fill from outside over edges, then take the largest part linked over edges and corners."""
    h, w = len(lines), len(lines[0])
    free = {(x, y) for y in range(h) for x in range(w) if lines[y][x] != "#"}
    todo = [(x, y) for x, y in free if x in (0, w - 1) or y in (0, h - 1)]
    sea = set(todo)
    while todo:
        x, y = todo.pop()
        for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if p in free and p not in sea:
                sea.add(p)
                todo.append(p)
    land = {(x, y) for y in range(h) for x in range(w)} - sea
    best, seen = set(), set()
    for x, y in sorted(land, key=lambda p: (p[1], p[0])):
        if (x, y) in seen:
            continue
        part, todo = {(x, y)}, [(x, y)]
        while todo:
            a, b = todo.pop()
            for p in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if p in land and p not in part:
                    part.add(p)
                    todo.append(p)
        seen |= part
        if len(part) > len(best):
            best = part
    return best


PART = ["..........", ".#######..", ".#######..", ".#######..", ".#######..", "..........", ".........."]


def test_specks_and_holes_change_nothing(spark):
    hole = [line for line in PART]
    hole[2] = ".##.####.."
    hole[3] = ".###.###.."  # touches the hole above by a corner only
    hole[6] = "........##"
    pictures = {1: PART, 2: hole}
    got = mask_of(spark, pictures)
    assert got[1] == got[2] == flooded(PART) and len(got[1]) == 28
    pixels = table(spark, pictures)
    limits = pixels.select("photo_id").distinct().withColumn("threshold", F.lit(100))
    shape = {r.photo_id: r[1:] for r in si.shapes(si.masks(pixels, limits)).collect()}
    assert shape[1] == shape[2] and shape[1][:3] == (28, 4.0, 2.5)
    pairs = spark.createDataFrame([(2, 1), (1, 1), (3, 1)], "photo_id long, ref_id long")
    scores = {r.photo_id: (r.score, r.angle) for r in si.best_rotations(pairs, si.rasters(si.masks(pixels, limits), 10), 10, 10, 60).collect()}
    assert scores == {1: (1.0, 0), 2: (1.0, 0), 3: (None, None)}


def test_random_pictures_against_a_flood_fill(spark):
    r = random.Random(2)
    pictures = {k: ["".join(r.choice("##." if k % 2 else "#..") for _ in range(13)) for _ in range(11)] for k in range(40)}
    pictures[98] = ["....."] * 4
    pictures[99] = ["#####"] * 3
    assert mask_of(spark, pictures) == {k: flooded(v) for k, v in pictures.items()}


def test_parts_inside_holes_belong_to_the_outer_part(spark):
    ring = ["#######", "#.....#", "#.###.#", "#.#.#.#", "#.###.#", "#.....#", "#######"]
    assert len(mask_of(spark, {1: ring})[1]) == 49
    equal = ["##...##", "##...##", "......."]
    assert mask_of(spark, {1: equal})[1] == {(0, 0), (1, 0), (0, 1), (1, 1)}


@pytest.mark.parametrize("chunk", [3, 2_000_000])
def test_tiles_of_a_graph(spark, monkeypatch, chunk):
    monkeypatch.setattr(graph, "EDGES", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    r = random.Random(9)
    edges = [(k, r.randint(-30, 30) * 2**33, r.randint(-30, 30) * 2**33) for k in ("a", "b", None) for _ in range(35)] + [("c", 5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for k, s, d in edges:
        if s != d:
            p, q = sorted((root((k, s)), root((k, d))), key=lambda n: n[1])
            up[q] = p
    try:
        df = spark.createDataFrame(edges, "k string, src long, dst long").where("k is not null")
        want = {n: root(n)[1] for n in list(up) if n[0] is not None}
        for tile in (["k"], ["k", F.shiftright("src", 37)], ["src"]):
            got = {(x.k, x.node): x.component for x in graph.connected_in_tiles(df, ["k"], tile).collect()}
            assert got == want
        assert graph.connected_in_tiles(df.limit(0), ["k"], ["k"]).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_tables_of_all_pictures_are_not_broadcast(spark):
    pixels = spark.range(40 * 36).selectExpr("id div 36 as photo_id", "id % 6 as x", "cast(id % 36 div 6 as int) as y", "cast(pmod(hash(id), 256) as int) as grey")
    mask = cut_lineage(si.masks(pixels, si.otsu_thresholds(pixels)))
    for table in (si._joined_runs(si.runs(pixels, si.otsu_thresholds(pixels)), 1, [0, 1]), si.masks(pixels, si.otsu_thresholds(pixels))):
        table.collect()
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
    assert mask.select("photo_id").distinct().count() == 40
