"""Hierarchies as intervals of a tour."""

import random

import pytest
from pyspark.sql import functions as F

from partwright.operators import graph


def climbed(parents):
    out = set()
    for node in parents:
        at, depth = parents[node], 1
        while at is not None:
            out.add((node, at, depth))
            at, depth = parents[at], depth + 1
    return out


def test_ancestors_of_random_forests(spark):
    r = random.Random(3)
    ids = r.sample(range(10_000), 120)
    parents = {n: r.choice(ids[:k]) if k and r.random() < 0.9 else None for k, n in enumerate(ids)}
    nodes = spark.createDataFrame(list(parents.items()), "node long, parent long")
    tours = graph.euler_tours(nodes)
    got = graph.above(tours, nodes).collect()
    assert {tuple(x) for x in got} == climbed(parents) and len(got) == len(climbed(parents))
    rows = tours.collect()
    assert len(rows) == 120 and all(x.enter < x.leave for x in rows)
    assert {x.node for x in rows if x.root == x.node} == {n for n, p in parents.items() if p is None} == {x.node for x in rows if x.depth == 0}
    assert graph.euler_tours(nodes.limit(0)).count() == 0


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    nodes = spark.range(n).select((F.col("id") * 7919 % n).alias("node"), F.when(F.col("id") > 0, (F.col("id") - 1) * 7919 % n).alias("parent"))
    tours = graph.euler_tours(nodes)
    assert tours.agg(F.count("*"), F.max("depth"), F.min("root"), F.max("root")).first()[:] == (n, n - 1, 0, 0)
    deep = spark.createDataFrame([((n - 1) * 7919 % n,)], "node long")
    assert graph.above(tours, deep).agg(F.count("*"), F.max("depth")).first()[:] == (n - 1, n - 1)


def test_a_cycle_is_reported(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "node long, parent long")
    with pytest.raises(graph.CycleError):
        graph.euler_tours(nodes)
