"""View regions from drawn boxes: neighbours, clusters, merging, counts.

Input ``page_id, seq, x0, y0, x1, y1`` where ``seq`` is the drawing order. Two boxes are neighbours when one, widened
by the merge distance, overlaps the other and their upper-left corners lie in the same or adjoining cells of twice
the distance. A box without area (a stroke) overlaps nothing as the second of a pair, but as the first it is widened:
strokes are neighbours of boxes with area that are drawn after them.

Boxes are not compared pairwise. Boxes with area whose corners share a sub-cell of one merge distance are always
neighbours, so a sub-cell is one node; two sub-cells are linked if the outermost edges of the one reach
the outermost edges of the other, for which each side keeps only its undominated corners.

Boxes are dealt out once, by page and tile, with those a few sub-cells beyond a tile's border; a task finds the links
of its tiles and hands on parts, not boxes. It holds some ``ROWS`` boxes at a time: of a tile with more it keeps its
strokes and, per sub-cell, the boxes with an undominated corner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.operators import graph
from partwright.session import cut_lineage

# ---- fixed values ---------------------------------------------------------------------------
MERGE_DISTANCE = 15.0
MIN_MEMBERS = 8
MERGE_FRACTION = 0.3
MIN_AREA_SHARE = 0.001
# ---------------------------------------------------------------------------------------------

BOX = ["x0", "y0", "x1", "y1"]
#: A tile of a page is TILE sub-cells wide and high; neighbours lie at most BORDER sub-cells away.
TILE, BORDER = 64, 3
WIDE = TILE + 2 * BORDER
#: Boxes a task reads at once, and pairs of a stroke and a box it looks at in one go.
ROWS, PAIRS = 500_000, 2_000_000
#: Members are counted in grid cells of 2^COARSE or larger: below that, levels cost more rows than they spare pairs.
COARSE = 9


def has_area() -> Column:
    return (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))


def with_area(rects: DataFrame) -> DataFrame:
    return rects.where(has_area())


def _undominated(code: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows whose point (u, v) no other point of the code exceeds in both; by code, ``u`` falling and ``v`` rising."""
    order = np.lexsort((-v, -u, code))
    values = np.unique(v)
    key = code[order] * len(values) + np.searchsorted(values, v[order])
    best = np.maximum.accumulate(key)
    return order[np.concatenate([[True], key[1:] > best[:-1]]) if len(key) else np.array([], bool)]


def _corners(x0, y0, x1, y1) -> dict[str, tuple]:
    return {"pp": (x1, y1), "mm": (-x0, -y0), "pm": (x1, -y0), "mp": (-x0, y1)}


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of whole numbers from 0 on, in order."""
    base = int(b.max()) + 1 if len(b) else 1
    return np.divmod(np.unique(a * base + b), base)


def _pairs(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All ``i, j`` with ``low[i] <= j < high[i]``, about ``PAIRS`` at a time."""
    count = high - low
    ends, at = np.cumsum(count), 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = count[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, np.arange(len(i)) + np.repeat(low[at:to] - (np.cumsum(n) - n), n)
        at = to


class _Tiles:
    """The boxes and strokes of some tiles. A code is a tile's number and a sub-cell's place in the widened tile."""

    def __init__(self, rows: dict[str, np.ndarray], distance: float):
        self.rows, self.distance = rows, distance
        change = [rows[c][1:] != rows[c][:-1] for c in ("page_id", "tx", "ty")]
        starts = np.concatenate([[0], np.flatnonzero(change[0] | change[1] | change[2]) + 1])
        self.tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows["tx"]))))
        self.page, self.tx, self.ty = (rows[c][starts] for c in ("page_id", "tx", "ty"))
        self.sx, self.sy = (np.floor(rows[c] / distance).astype(np.int64) for c in ("x0", "y0"))
        self.code = self.coded(self.tile, self.sx, self.sy)
        self.area = (rows["x1"] > rows["x0"]) & (rows["y1"] > rows["y0"])

    def coded(self, tile, sx, sy):
        return (tile * WIDE + sx - self.tx[tile] * TILE + BORDER) * WIDE + sy - self.ty[tile] * TILE + BORDER

    def places(self, code):
        """Page, ``sx`` and ``sy`` of codes, whether the sub-cell is the tile's own, and whether other tiles meet it."""
        tile, x, y = code // WIDE**2, code // WIDE % WIDE, code % WIDE
        inside = lambda margin: (np.minimum(x, y) >= margin) & (np.maximum(x, y) < WIDE - margin)
        return self.page[tile], self.tx[tile] * TILE + x - BORDER, self.ty[tile] * TILE + y - BORDER, inside(BORDER), ~inside(2 * BORDER)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of linked sub-cells, each pair once; the first is the tile's own, the second lies right of, or below, it."""
        at = np.flatnonzero(self.area)
        code = self.code[at]
        corner = {k: (c[0][at], c[1][at]) for k, c in _corners(*(self.rows[c] for c in BOX)).items()}
        found = []
        for first, second, steps in (("pp", "mm", range(BORDER + 1)), ("pm", "mp", range(-BORDER, 0))):
            (u, v), (bu, bv) = corner[first], corner[second]
            a = _undominated(code, u, v)
            a = a[self.places(code[a])[3]]
            b = _undominated(code, bu, bv)[::-1]  # codes fall, u rises and v falls within a code
            b = b[np.argsort(code[b], kind="stable")]
            values = np.unique(bu[b])
            key = code[b] * (len(values) + 1) + np.searchsorted(values, bu[b])
            over = np.searchsorted(values, -(u[a] + self.distance), "right")
            sx, sy = self.sx[at][a], self.sy[at][a]
            for dx in range(BORDER + 1):
                for dy in steps:
                    if dx == 0 and dy <= 0:
                        continue
                    near = (np.abs((sx + dx) // 2 - sx // 2) <= 1) & (np.abs((sy + dy) // 2 - sy // 2) <= 1)
                    own = a[near]
                    target = code[own] + dx * WIDE + dy
                    # Of the corners that reach in u, the one with the smallest u reaches farthest in v.
                    place = np.searchsorted(key, target * (len(values) + 1) + (over[near] if dx else 0))
                    there = np.flatnonzero(place < len(b))
                    there = there[code[b[place[there]]] == target[there]]
                    if dy:
                        there = there[bv[b[place[there]]] > -(v[own[there]] + self.distance)]
                    one = code[own[there]]
                    if len(one):
                        one = one[np.concatenate([[True], one[1:] != one[:-1]])]
                    found.append((one, one + dx * WIDE + dy))
        return tuple(np.concatenate(c) for c in zip(*found))

    def reached(self) -> tuple[np.ndarray, np.ndarray]:
        """Strokes (rows) with the codes of sub-cells that hold a later neighbour of theirs."""
        strokes, boxes = np.flatnonzero(~self.area), np.flatnonzero(self.area)
        boxes = boxes[np.argsort(self.code[boxes], kind="stable")]
        codes, r, found = self.code[boxes], self.rows, [(np.empty(0, np.int64),) * 2]
        corner = self.coded(self.tile[strokes], (self.sx[strokes] // 2 - 1) * 2, (self.sy[strokes] // 2 - 1) * 2)
        for column in range(6):
            low = corner + column * WIDE
            for i, j in _pairs(np.searchsorted(codes, low), np.searchsorted(codes, low + 5, "right")):
                s, b = strokes[i], boxes[j]
                near = r["seq"][b] > r["seq"][s]
                for axis in "xy":
                    near &= (r[f"{axis}0"][s] - self.distance < r[f"{axis}1"][b]) & (r[f"{axis}0"][b] < r[f"{axis}1"][s] + self.distance)
                found.append(_distinct(s[near], self.code[b[near]]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def kept(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """Rows of one tile: the strokes, and boxes with an undominated corner, the first of a sub-cell counting for all."""
        strokes, boxes = rows[~self.area[rows]], rows[self.area[rows]]
        code = self.code[boxes]
        outer = [_undominated(code, u[boxes], v[boxes]) for u, v in _corners(*(self.rows[c] for c in BOX)).values()]
        outer = np.unique(np.concatenate(outer))
        _, first, of = np.unique(code[outer], return_index=True, return_inverse=True)
        sums = np.bincount(np.searchsorted(code[outer][first], code), self.rows["n"][boxes], len(first)).astype(np.int64)
        n = np.zeros(len(outer), np.int64)
        n[first] = sums
        left = np.concatenate([strokes, boxes[outer]])
        return {k: v[left] for k, v in self.rows.items()} | {"n": np.concatenate([self.rows["n"][strokes], n])}


def _by_tile(rects: DataFrame, distance: float, found: Callable[[_Tiles, tuple, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``found`` makes of some tiles, their strokes with the sub-cells reached, and the first tile not yet whole."""
    def tiles(c):
        s = F.floor(F.col(c) / distance)
        return F.sequence(F.floor((s - F.when(has_area(), BORDER).otherwise(0)) / TILE), F.floor((s + F.when(has_area(), BORDER).otherwise(0)) / TILE))

    seq = F.coalesce(F.col("seq").cast("long"), F.when(has_area(), -(2**63)).otherwise(2**63 - 1))
    whole = rects.where(has_area().isNotNull() & F.col("page_id").isNotNull()).select("page_id", seq.alias("seq"), *[F.col(c).cast("double").alias(c) for c in BOX])
    dealt = whole.withColumn("tx", F.explode(tiles("x0"))).withColumn("ty", F.explode(tiles("y0"))).repartition("page_id", "tx", "ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, hits = None, [], (np.empty(0, np.int64),) * 2
        batches, more = iter(batches), True
        while more:
            batch = next(batches, None)
            more = batch is not None
            if more:
                rows.append(batch)
            if not rows and held is None or more and sum(b.num_rows for b in rows) < ROWS:
                continue
            new = pa.Table.from_batches(rows) if rows else None
            new = {c: new.column(c).to_numpy() for c in new.column_names} | {"n": np.ones(new.num_rows, np.int64)} if rows else {}
            rows = []
            now = {c: np.concatenate([t[c] for t in (held, new) if t]) for c in held or new}
            if not len(now["n"]):
                continue
            tiles = _Tiles(now, distance)
            hits = _distinct(*(np.concatenate(c) for c in zip(hits, tiles.reached())))
            last = len(tiles.page) - 1 if more else len(tiles.page)
            if last:
                yield from found(tiles, hits, last)
            if more:
                # Strokes come first in a tile, so those kept are the first rows of tile 0 next time.
                ours, of = np.flatnonzero(tiles.tile == last), tiles.tile[hits[0]] == last
                held, hits = tiles.kept(ours), (hits[0][of] - ours[0], hits[1][of] - last * WIDE**2)

    return dealt.sortWithinPartitions("page_id", "tx", "ty", has_area()).mapInArrow(run, schema)
def linked_subcells(rects: DataFrame, distance: float = MERGE_DISTANCE) -> DataFrame:
    """Pairs of different sub-cells that hold neighbouring boxes, each once; the second lies right of, or below, the first."""
    def found(tiles: _Tiles, hits: tuple, last: int) -> Iterator[pa.RecordBatch]:
        a, b = tiles.links()
        whole = a // WIDE**2 < last
        page, ax, ay, _, _ = tiles.places(a[whole])
        _, bx, by, _, _ = tiles.places(b[whole])
        yield pa.record_batch([pa.array(c) for c in (page, ax, ay, bx, by)], ["page_id", "ax", "ay", "bx", "by"])

    page = rects.schema["page_id"].dataType.simpleString()
    return _by_tile(with_area(rects), distance, found, f"page_id {page}, ax long, ay long, bx long, by long")


def _parts(tiles: _Tiles, hits: tuple, last: int) -> Iterator[pa.RecordBatch]:
    """Connected parts of every tile as ``node`` with a box and members, and edges ``node, other`` from the sub-cells that
    other tiles meet to the part they are in. A stroke binds the sub-cells it reaches together and counts with the first
    of them; without any it is in no group."""
    a, b = tiles.links()
    whole = a // WIDE**2 < last
    strokes, codes = (c[tiles.tile[hits[0]] < last] for c in hits)
    lead = np.diff(strokes, prepend=-1) != 0
    first = codes[lead]
    bound = first[np.cumsum(lead) - 1]
    boxes = np.flatnonzero(tiles.area & (tiles.tile < last))
    boxes = boxes[tiles.places(tiles.code[boxes])[3]]
    rows, at = np.concatenate([boxes, strokes[lead]]), np.concatenate([tiles.code[boxes], first])
    if not len(rows):
        return
    nodes, root = graph.united(np.concatenate([a[whole], bound, at]), np.concatenate([b[whole], codes, at]))
    part = root[np.searchsorted(nodes, at)]
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
    rows = rows[order]
    folded = [f.reduceat(tiles.rows[c][rows], starts) for f, c in ((np.minimum, "x0"), (np.minimum, "y0"), (np.maximum, "x1"), (np.maximum, "y1"), (np.add, "n"))]
    met = np.flatnonzero(tiles.places(nodes)[4] & (root != np.arange(len(nodes))))

    def named(code):
        page, sx, sy, _, _ = tiles.places(code)
        return pa.array(page), pa.array((sx << 32) | (sy & ((1 << 32) - 1)))

    names = ["page_id", "node", "other", *BOX, "members"]
    kinds = [pa.float64()] * 4 + [pa.int64()]
    page, node = named(nodes[part[order][starts]])
    yield pa.record_batch([page, node, pa.nulls(len(node), pa.int64()), *[pa.array(c, k) for c, k in zip(folded, kinds)]], names)
    page, node = named(nodes[met])
    yield pa.record_batch([page, node, named(nodes[root[met]])[1], *[pa.nulls(len(node), k) for k in kinds]], names)


def clusters(spark: SparkSession, rects: DataFrame, distance: float = MERGE_DISTANCE, min_members: int = MIN_MEMBERS) -> DataFrame:
    """Boxes of connected groups with at least ``min_members`` (two or more) boxes, strokes included."""
    page = rects.schema["page_id"].dataType.simpleString()
    found = cut_lineage(_by_tile(rects, distance, _parts, f"page_id {page}, node long, other long, x0 double, y0 double, x1 double, y1 double, members long"))
    edges = found.where("other is not null").select("page_id", F.col("node").alias("src"), F.col("other").alias("dst"))
    labels = graph.connected_in_tiles(edges, ["page_id"], ["page_id"])
    grown = _grown(_labelled(found.where("other is null"), labels), F.col("component"), F.col("members"))
    return grown.where(F.col("members") >= min_members).select("page_id", *BOX, "members")


def _grown(rows: DataFrame, key: Column, count: Column) -> DataFrame:
    return rows.groupBy("page_id", key.alias("cluster")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum(count).alias("members")
    )


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, ["page_id", "node"], "left").withColumn("component", F.coalesce("component", "node"))


def _level(width: Column, height: Column) -> Column:
    return F.greatest(F.ceil(F.log2(F.greatest(width, height, F.lit(1.0)))), F.lit(0)).cast("int")


def _cells(df: DataFrame, level: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """One row per grid cell of size 2^level that the box touches."""
    size = F.pow(F.lit(2.0), level)
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return df.withColumn("level", level).withColumn("cx", F.explode(span(x0, x1))).withColumn("cy", F.explode(span(y0, y1)))


def _levels(df: DataFrame) -> DataFrame:
    """The few grid levels in use, as one row."""
    return df.select(_level(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("l")).groupBy().agg(F.array_sort(F.collect_set("l")).alias("levels"))


def merged(spark: SparkSession, boxes: DataFrame, fraction: float = MERGE_FRACTION) -> DataFrame:
    """Second pass: clusters join when their gap is below a fraction of the smaller one's diagonal.

    Each box lies in the grid of its own size; a smaller box probes the grids of larger sizes, where it
    touches a few cells only.
    """
    named = cut_lineage(boxes.withColumn("node", F.monotonically_increasing_id()))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sized = named.select("page_id", "node", *BOX, F.sqrt(w * w + h * h).alias("diag"), _level(w, h).alias("own"))
    large = _cells(sized, F.col("own"), *[F.col(c) for c in BOX]).select(
        "page_id", "level", "cx", "cy", F.col("node").alias("dst"), F.col("diag").alias("ddiag"), *[F.col(c).alias(f"d{c}") for c in BOX]
    )
    reach = F.col("diag") * fraction
    lowest = F.floor(F.log2(F.greatest(F.col("diag") / 2, F.lit(1.0))))
    probe = sized.crossJoin(F.broadcast(_levels(sized)))  # one row
    probe = probe.withColumn("at", F.explode(F.filter("levels", lambda l: l >= lowest)))
    probe = _cells(probe, F.col("at"), F.col("x0") - reach, F.col("y0") - reach, F.col("x1") + reach, F.col("y1") + reach)
    pairs = probe.join(large, ["page_id", "level", "cx", "cy"]).where(
        (F.col("node") != F.col("dst")) & (F.col("diag") <= F.col("ddiag"))
        & (F.col("x0") - reach < F.col("dx1")) & (F.col("dx0") < F.col("x1") + reach) & (F.col("y0") - reach < F.col("dy1")) & (F.col("dy0") < F.col("y1") + reach)
    )
    edges = pairs.select("page_id", F.col("node").alias("src"), "dst")
    labels = graph.connected_in_tiles(edges, ["page_id"], ["page_id"])
    return _grown(_labelled(named, labels), F.col("component"), F.col("members")).select("page_id", *BOX, "members")


def members_per_region(regions: DataFrame, rects: DataFrame) -> DataFrame:
    """Number of boxes that overlap each region; a stroke overlaps none.

    Box and region meet in the grid of the larger of the two; a pair counts in the one cell that holds
    the corner of their overlap, so nothing is counted twice and no pair list is kept.
    """
    regions = regions.select("page_id", *[F.col(c).alias(f"r{c}") for c in BOX])
    coarse = lambda level: F.greatest(level, F.lit(COARSE))
    r_level = coarse(_level(F.col("rx1") - F.col("rx0"), F.col("ry1") - F.col("ry0")))
    b_level = coarse(_level(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    region_box, rect_box = [F.col(f"r{c}") for c in BOX], [F.col(c) for c in BOX]
    rects = with_area(rects).select("page_id", *BOX)
    size = F.pow(F.lit(2.0), F.col("level"))
    corner = (F.floor(F.greatest("rx0", "x0") / size) == F.col("cx")) & (F.floor(F.greatest("ry0", "y0") / size) == F.col("cy"))
    overlap = (F.col("x0") < F.col("rx1")) & (F.col("rx0") < F.col("x1")) & (F.col("y0") < F.col("ry1")) & (F.col("ry0") < F.col("y1"))
    keys = ["page_id", "level", "cx", "cy"]
    region_levels, rect_levels = (df.groupBy().agg(F.array_sort(F.collect_set(level)).alias("levels")) for df, level in ((regions, r_level), (rects, b_level)))
    lowest = F.broadcast(regions.agg(F.min(r_level).alias("lowest")))  # one row
    small_rects = rects.crossJoin(F.broadcast(region_levels)).withColumn("at", F.explode(F.filter("levels", lambda l: l >= b_level))).drop("levels")  # one row
    inside = _cells(regions, r_level, *region_box).join(_cells(small_rects, F.col("at"), *rect_box).drop("at"), keys)
    small_regions = regions.crossJoin(F.broadcast(rect_levels)).withColumn("at", F.explode(F.filter("levels", lambda l: l > r_level))).drop("levels")  # one row
    large_rects = rects.join(lowest, b_level > F.col("lowest")).drop("lowest")
    around = _cells(small_regions, F.col("at"), *region_box).drop("at").join(_cells(large_rects, b_level, *rect_box), keys)
    names = ["page_id", *[f"r{c}" for c in BOX]]
    found = inside.where(overlap & corner).select(*names).unionByName(around.where(overlap & corner).select(*names))
    counted = found.groupBy(*names).agg(F.count(F.lit(1)).alias("element_count"))
    return counted.select("page_id", *[F.col(f"r{c}").alias(c) for c in BOX], "element_count")


def without_noise(regions: DataFrame, share: float = MIN_AREA_SHARE) -> DataFrame:
    """Regions of at least the given share of the largest area on the page."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    sized = regions.withColumn("area", area)
    largest = sized.groupBy("page_id").agg(F.max("area").alias("largest"))
    return sized.join(largest, "page_id").where(F.col("area") >= F.col("largest") * share).drop("largest")


def view_regions(spark: SparkSession, rects: DataFrame) -> DataFrame:
    """Both passes, member counts and the noise cut, largest regions first."""
    protos = clusters(spark, rects)
    regions = members_per_region(merged(spark, protos), rects)
    return without_noise(regions).orderBy(F.desc("area"), "page_id", "x0", "y0")
