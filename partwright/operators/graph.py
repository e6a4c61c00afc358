"""Edges, closures and reachability over node tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwright.session import cut_lineage, drop_step

class CycleError(ValueError):
    """A hierarchy in which something is above itself."""


#: Edges a task unites at once.
EDGES = 2_000_000


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """All (src, dst, depth) pairs reachable over ``edges(src, dst)``, shortest depth each.

    Paths are doubled: each round joins the pairs found so far with themselves and keeps the shortest, so a depth of n
    takes about log n rounds, cycles end, and a round reads the round before alone.
    """
    known = cut_lineage(edges.select("src", "dst").distinct().withColumn("depth", F.lit(1)))
    mark = None
    while True:
        seen = known.agg(F.count("*").alias("n"), F.sum("depth").alias("d")).first()
        if mark == (seen["n"], seen["d"]):
            return known
        mark = (seen["n"], seen["d"])
        first = known.select("src", F.col("dst").alias("mid"), F.col("depth").alias("d1"))
        second = known.select(F.col("src").alias("mid"), "dst", F.col("depth").alias("d2"))
        longer = first.join(second, "mid").select("src", "dst", (F.col("d1") + F.col("d2")).alias("depth"))
        old, known = known, cut_lineage(known.unionByName(longer).groupBy("src", "dst").agg(F.min("depth").alias("depth")))
        drop_step(old)


def united(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of some edges, in order, and for each the place of the smallest its component has."""
    nodes, at = np.unique(np.concatenate([v, u]), return_inverse=True)
    v, u = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[v], root[u]), np.maximum(root[v], root[u])
        if np.array_equal(low, high):
            return nodes, root
        np.minimum.at(root, high, low)
        while not np.array_equal(root, up := root[root]):
            root = up


def _stars(keys: list[str], batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Edges ``v, u`` from every node to the smallest one its component has within these batches."""
    table = pa.Table.from_batches(batches)
    group = np.zeros(table.num_rows, dtype=np.int64)
    for key in keys:
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        group = np.unique(group * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
    ends = np.concatenate([table.column(c).to_numpy() for c in ("v", "u")])
    ids, at = np.unique(ends, return_inverse=True)
    named = np.concatenate([group, group]) * len(ids) + at
    first = np.unique(named, return_index=True)[1]
    nodes, root = united(*np.split(named, 2))
    inner = np.flatnonzero(root != np.arange(len(nodes)))
    rows = pa.array(first[inner] % table.num_rows)
    columns = [table.column(key).combine_chunks().take(rows) for key in keys]
    return pa.record_batch([*columns, pa.array(ids[nodes[inner] % len(ids)]), pa.array(ids[nodes[root[inner]] % len(ids)])], [*keys, "v", "u"])


def contracted(edges: DataFrame, keys: list[str], tile: list[Column | str]) -> DataFrame:
    """``keys, v, u``: edges with the same components as ``edges(keys, src, dst)``, at most one per node and task.

    Edges are dealt out by ``tile`` (once), and each task unites what it is dealt, ``EDGES`` at a time, so that a tile
    of any size fits. Components within one tile come out as stars around their smallest node; what is linked across
    tiles stays to be settled. Node ids are whole numbers; edges never leave their ``keys``.
    """
    ends = [F.greatest("src", "dst").cast("long").alias("v"), F.least("src", "dst").cast("long").alias("u")]
    dealt = edges.repartition(*tile).select(*keys, *ends).where("u < v")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= EDGES:
                yield _stars(keys, held)
                held, n = [], 0
        if n:
            yield _stars(keys, held)

    return dealt.mapInArrow(unite, dealt.schema)


def _all_stars(edges: DataFrame, keys: list[str]) -> bool:
    """Whether every ``v`` of ``edges(keys, v, u)`` has one edge and no ``u`` is a ``v``."""
    roles = F.inline(F.array(F.struct(F.col("v").alias("n"), F.lit(1).alias("inner"), F.lit(0).alias("hub")), F.struct(F.col("u").alias("n"), F.lit(0).alias("inner"), F.lit(1).alias("hub"))))
    seen = edges.select(*keys, roles).groupBy(*keys, "n").agg(F.sum("inner").alias("inner"), F.max("hub").alias("hub"))
    return seen.where((F.col("inner") > 1) | ((F.col("inner") > 0) & (F.col("hub") > 0))).isEmpty()


def connected_in_tiles(edges: DataFrame, keys: list[str], tile: list[Column | str]) -> DataFrame:
    """``keys, node, component`` for every node of ``edges(keys, src, dst)``: the smallest node it can reach.

    Components that lie within a tile cost one shuffle; only if some reach beyond theirs do the star rounds of
    ``connected`` follow, over one edge per node and tile.
    """
    stars = cut_lineage(contracted(edges, keys, tile))
    if not _all_stars(stars, keys):
        found = connected(stars.select(*keys, F.col("v").alias("src"), F.col("u").alias("dst")), keys)
        drop_step(stars)
        return found
    labels = stars.select(*keys, F.col("v").alias("node"), F.col("u").alias("component"))
    return labels.unionByName(labels.select(*keys, F.col("component").alias("node"), "component").distinct())


def connected(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``node, component`` for every node of ``edges(src, dst)``: the smallest node it can reach, itself included.

    Alternates two star steps until the edges no longer change: every node hands its larger neighbours to the
    smallest of its neighbours and itself, then every node hands its smaller neighbours to the smallest of them. Both
    keep who is connected with whom and flatten trees quickly, whatever their depth: a chain of n nodes takes about
    log n rounds. The joins on a hub node can be split by adaptive execution. Each round is a table in the shared
    folder. With ``keys``, edges never leave their key, node ids count within it, and the keys are in the result.
    """
    keys = keys or []
    kind = edges.schema["src"].dataType
    now = edges.select(*keys, F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).where("u < v").distinct()
    now = cut_lineage(now)
    mark = None
    while True:
        both = now.select(*keys, F.col("u").alias("n"), F.col("v").alias("o")).unionByName(now.select(*keys, F.col("v").alias("n"), F.col("u").alias("o")))
        least = both.groupBy(*keys, "n").agg(F.min("o").alias("m")).withColumn("m", F.least("m", "n"))
        large = both.where("o > n").join(least, [*keys, "n"]).select(*keys, F.col("o").alias("v"), F.col("m").alias("u")).distinct()
        large = cut_lineage(large.where("u < v"))
        least = large.groupBy(*keys, "v").agg(F.min("u").alias("m"))
        small = large.join(least, [*keys, "v"]).select(*keys, F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
        old, now = now, cut_lineage(small.select(*keys, "e.v", "e.u").where("u < v").distinct())
        drop_step(large)
        drop_step(old)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "v", "u").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen["n"], seen["h"]):
            break
        mark = (seen["n"], seen["h"])
    stars = now.select(*keys, F.col("v").cast(kind).alias("node"), F.col("u").cast(kind).alias("component"))
    return stars.unionByName(stars.select(*keys, F.col("component").alias("node"), "component").distinct())


def euler_tours(nodes: DataFrame) -> DataFrame:
    """``node, root, enter, leave, depth`` of every row of ``nodes(node, parent)``; ``parent`` is null at a root.

    The tour around a tree goes down to the first child by id, on to the next sibling when a child is done, and up after
    the last; every node is entered and left once. Each step knows the next one, and the places of all steps come from
    pointer jumping: every round doubles how far a step sees, so a chain of n nodes takes about log n rounds, each one
    join of a table in the shared folder. ``above`` then asks two numbers; no pair of nodes is stored.

    Node ids are unique; a parent that is no node is an error of the caller. Cycles raise ``CycleError``.
    """
    step = lambda node, leaving: F.struct(F.col(node).alias("node"), F.lit(leaving).alias("leaving"))
    beside = Window.partitionBy("parent").orderBy("node")
    sibling = nodes.where("parent is not null").select("node", "parent", F.lead("node").over(beside).alias("sibling"))
    child = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    linked = nodes.join(child, "node", "left").join(sibling.select("node", "sibling"), "node", "left")
    down = F.struct(step("node", False).alias("at"), F.when(F.col("child").isNotNull(), step("child", False)).otherwise(step("node", True)).alias("to"), F.lit(1).cast("long").alias("w"))
    up = F.struct(step("node", True).alias("at"), F.when(F.col("sibling").isNotNull(), step("sibling", False)).when(F.col("parent").isNotNull(), step("parent", True)).alias("to"), F.lit(-1).cast("long").alias("w"))
    # ``far`` steps and ``w`` levels lie between ``at`` and ``to``, which is null once the end of the tour is in sight.
    tour = linked.select(F.inline(F.array(down, up))).select("at", "to", F.lit(1).cast("long").alias("far"), "w", F.col("at").alias("last"))
    tour = cut_lineage(tour)
    reach, count = 1, tour.count()
    while not tour.where("to is not null").isEmpty():
        if reach > count:
            raise CycleError("the hierarchy has a cycle")
        ahead = tour.select(F.col("at").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("w").alias("w2"), F.col("last").alias("last2"))
        met = tour.join(ahead, "to", "left")
        seen = F.col("to").isNotNull()
        old, tour = tour, cut_lineage(met.select(
            "at", F.when(seen, F.col("to2")).alias("to"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"),
            (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.when(seen, F.col("last2")).otherwise(F.col("last")).alias("last"),
        ))
        drop_step(old)
        reach *= 2
    # What is left to the end of the tour is turned round: places count down from it.
    at = tour.groupBy(F.col("at.node").alias("node")).agg(
        F.max(F.when(~F.col("at.leaving"), -F.col("far"))).alias("enter"), F.max(F.when(F.col("at.leaving"), -F.col("far"))).alias("leave"),
        F.max(F.when(~F.col("at.leaving"), -F.col("w"))).alias("depth"), F.max("last.node").alias("root"),
    )
    return at.select("node", "root", "enter", "leave", "depth")


def above(tours: DataFrame, of: DataFrame) -> DataFrame:
    """``node, ancestor, depth``: the nodes whose tours enclose each distinct ``node`` of ``of``, and how far above."""
    own = tours.join(of.select("node").distinct(), "node", "left_semi")
    outer = tours.select("root", F.col("node").alias("ancestor"), F.col("enter").alias("e"), F.col("leave").alias("l"), F.col("depth").alias("d"))
    met = own.join(outer, "root").where((F.col("e") < F.col("enter")) & (F.col("leave") < F.col("l")))
    return met.select("node", "ancestor", (F.col("depth") - F.col("d")).alias("depth"))


def components(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node of the connected component of every node: ``node, component``."""
    found = connected(edges)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def plant_edges(zones: DataFrame, flows: DataFrame, control: DataFrame) -> DataFrame:
    """Material flows with both ends resolved to zones, a telemetry edge per zone, and the fixed control edges."""
    ends = zones.select("factory", "zone_id").distinct()
    material = flows.join(ends.withColumnRenamed("zone_id", "src"), ["factory", "src"]).join(
        ends.withColumnRenamed("zone_id", "dst"), ["factory", "dst"]
    ).select("factory", "src", "dst", F.lit("material").alias("edge_type"))
    telemetry = ends.select("factory", F.col("zone_id").alias("src"), F.lit("gateway").alias("dst"), F.lit("telemetry").alias("edge_type"))
    fixed = ends.select("factory").distinct().crossJoin(control).select("factory", "src", "dst", F.lit("control").alias("edge_type"))
    return material.unionByName(telemetry).unionByName(fixed)


def components_within(spark: SparkSession, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Connected components where edges never leave their ``key``: ``key, node, component`` (node ids are texts).

    All keys are settled together: a node's name is its key and id, so the smallest name is the smallest id.
    """
    named = lambda c: F.struct(F.col(key).alias("k"), F.col(c).alias("n"))
    found = connected(edges.select(named("src").alias("src"), named("dst").alias("dst")))
    labels = found.select(F.col("node.k").alias(key), F.col("node.n").alias("node"), F.col("component.n").alias("component"))
    nodes = nodes.select(key, "node").distinct()
    return nodes.join(labels, [key, "node"], "left").select(key, "node", F.coalesce("component", "node").alias("component"))
