"""The ordered scan against plain loops, whatever the buckets."""

import random

from pyspark.sql import functions as F

from partwright.operators import sequences as seq
from partwright.operators import toolpath as tp


def test_values_of_the_row_before_cross_buckets(spark):
    r = random.Random(4)
    rows = [(k, o, r.randint(0, 3), r.choice([None, 1.5, 2.0, -4.25])) for k in ("a", "b") for o in r.sample(range(500), 60)] + [("c", 7, 1, None)]
    df = spark.createDataFrame(rows, "k string, o long, g int, x double")
    far = lambda now, before: F.when(now("g") == before("g"), F.abs(now("x") - before("x")))
    for width in (1, 7, 100, 10_000):
        got = seq.scan(df, ["k"], [F.floor(F.col("o") / width)], ["o"], "at", ["g", "x"], {"far": far, "all": lambda now, _: now("x")}).collect()
        seen = {(x.k, x.o): (x.at, x.prev_g, x.prev_x, x.far, x.all) for x in got}
        assert len(got) == len(rows)
        for key in "abc":
            before, total, whole = None, 0.0, 0.0
            for at, (_, o, g, x) in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: x[1]), 1):
                if before and before[0] == g and x is not None and before[1] is not None:
                    total += abs(x - before[1])
                whole += x or 0.0
                assert seen[key, o] == (at, *(before or (None, None)), total, whole)
                before = (g, x)
    assert seq.scan(df.limit(0), ["k"], [], ["o"]).count() == 0


def test_path_statistics_in_one_scan(spark):
    r = random.Random(5)
    rows = [(p, n, 1 + n // 9, r.choice(["rapid", "linear"]), *[float(r.randint(0, 9)) for _ in range(3)]) for p in (1, 2) for n in range(1, 41)]
    moves = spark.createDataFrame(rows, "plan_id long, move_no long, op_no int, kind string, x double, y double, z double")
    want = tp.step_ranges(moves).join(tp.path_lengths(moves), ["plan_id", "op_no"])
    got = tp.path_statistics(tp.scanned(moves.withColumnRenamed("move_no", "o"), [F.floor(F.col("o") / 5)], ["o"]))
    close = lambda df: sorted((*x[:4], round(x.length_mm, 9)) for x in df.select("plan_id", "op_no", "start_step", "end_step", "length_mm").collect())
    assert close(got) == close(want)
    steps = {(x.plan_id, x.move_no): x.step for x in tp.cutting_steps(moves).collect()}
    for p in (1, 2):
        count, last = 0, None
        for _, n, op, kind, *_ in (x for x in rows if x[0] == p):
            count += last == op and kind != "rapid"
            last = op
            assert steps[p, n] == count


def test_summaries_need_no_order_of_their_own(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(1000).selectExpr("id % 7 as k", "id as o", "id * 0.5 as x")
        scanned = seq.scan(df, ["k"], [F.floor(F.col("o") / 50)], ["o"], "at", ["x"], {"s": lambda now, _: now("x")})
        for out, ordered in ((scanned.drop("s"), 1), (scanned, 2)):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("row_number()") == ordered and "partial_max_by" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
