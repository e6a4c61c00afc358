"""Approximate nearest neighbours by inner product: probed lists, scanned by adaptive dimension blocks."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwright.llm.common import small_batches
from partwright.session import cut_lineage

#: Bounds: vectors that lists, rotation and thresholds are fitted on, and lists.
SAMPLE, SAMPLE_BYTES, LISTS = 4096, 8 << 20, 512
#: Most candidates and queries of one tile, columns of one block, and standard deviations of the abandon test.
CANDIDATES, QUERIES_PER_TILE, BLOCK, SIGMAS = 2048, 512, 16, 3.0


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` (float array) of vectors that can be compared: not null, not zero, all components finite, and of
    the length that most such vectors have (the larger of equally frequent ones)."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    lengths = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return v.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


class Index:
    """Fitted on a bounded sample: an inner product becomes a distance by one more column that evens out the norms;
    list centres, a random rotation, and how many lists to probe."""

    def __init__(self, sample: np.ndarray, rows: int, most: float, k: int, aim: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.most = most
        self.sample = sample
        wide = self.widened(sample)
        n = len(wide)
        lists = max(1, min(LISTS, math.ceil(math.sqrt(rows)), n // 8 or 1))
        centres = wide[rng.permutation(n)[:lists]].copy()
        for _ in range(12):
            own = self._near(wide, centres)
            for j in range(lists):
                mine = own == j
                if mine.any():
                    centres[j] = wide[mine].mean(axis=0)
        self.centres = centres
        d = wide.shape[1]
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        self.probes = self._calibrated(wide, k, aim, rng)

    def widened(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.most - np.square(x).sum(axis=1)))[:, None]])

    @staticmethod
    def queries(x: np.ndarray) -> np.ndarray:
        """Queries of unit length with 0 in the added column: their order of candidates is that of inner products."""
        norm = np.sqrt(np.square(x).sum(axis=1))[:, None]
        return np.hstack([x / norm, np.zeros((len(x), 1))])

    @staticmethod
    def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (2 * x @ centres.T - np.square(centres).sum(axis=1)).argmax(axis=1)

    def list_of(self, x: np.ndarray) -> np.ndarray:
        return self._near(self.widened(x), self.centres)

    def probe_order(self, x: np.ndarray) -> np.ndarray:
        """All lists, nearest first: those whose centre has the largest inner product come first."""
        return np.argsort(-(self.queries(x) @ self.centres.T), axis=1, kind="stable")

    def _calibrated(self, wide: np.ndarray, k: int, aim: float, rng: np.random.Generator) -> int:
        """Fewest probes that find ``aim`` of the sample's own neighbours for up to 256 of its vectors, chosen at random.
        Equal vectors count once, as queries and as neighbours: copies lie in one list and would pass for easy queries.
        The whole table's neighbours are nearer than the sample's, so they are found no worse."""
        once = np.unique(self.sample, axis=0, return_index=True)[1]
        wide, sample = wide[once], self.sample[once]
        asked = rng.permutation(len(once))[:256]
        product = sample[asked] @ sample.T
        product[np.arange(len(asked)), asked] = -np.inf
        k = min(k, len(wide) - 1)
        if k < 1:
            return len(self.centres)
        top = np.argpartition(-product, k - 1, axis=1)[:, :k]
        rank = np.argsort(self.probe_order(sample[asked]), axis=1)
        own = self._near(wide, self.centres)
        need = np.take_along_axis(rank, own[top], axis=1)
        found = np.cumsum(np.bincount(need.ravel(), minlength=len(self.centres))) / need.size
        return int(np.argmax(found >= min(aim, found[-1]))) + 1

    def floors(self, x: np.ndarray, k: int) -> np.ndarray:
        """For each query an inner product that at least ``k`` of the sample's other vectors reach."""
        if len(self.sample) <= k:
            return np.full(len(x), -np.inf)
        product = x @ self.sample.T
        # One more than k: the query itself may be in the sample.
        return -np.partition(-product, k, axis=1)[:, k] - 1e-9


def fit_index(vectors: DataFrame, k: int = 20, aim: float = 0.985, bound: int = SAMPLE) -> bytes:
    """A pickled ``Index`` for vectors as ``usable`` gives them. At most an eighth of the vectors, ``bound`` and
    ``SAMPLE_BYTES`` are sampled (256 of small tables), by a hash of their ids; one task fits it."""
    seen = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most"), F.max(F.size("v")).alias("d")).first()
    n, most = seen["n"], float(seen["most"] or 0.0)
    take = min(max(n // 8, 256), bound, max(64, SAMPLE_BYTES // (8 * max(1, seen["d"] or 1))))
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(take)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if got:
            rows = pd.concat(got).sort_values("vec_id", kind="stable")
            yield pd.DataFrame({"index": [pickle.dumps(Index(np.stack(rows["v"].to_list()), n, most, k, aim))]})

    made = sample.coalesce(1).mapInPandas(fit, "index binary").first()
    return bytes(made["index"]) if made else b""


@lru_cache(maxsize=2)
def _loaded(index: bytes) -> Index:
    return pickle.loads(index)


def _stack(arrays: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(a, dtype=np.float64) for a in arrays])


def _scan(index: Index, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> pd.DataFrame:
    """The best ``k`` of one tile's candidates for each of its queries.

    Distances of rotated vectors add up over blocks of columns. After each block a candidate is abandoned for a query
    if its distance so far, blown up to all columns, is beyond the query's limit by more than a test on that many
    columns allows; candidates abandoned for all queries and queries without candidates leave the matrices.
    """
    unit = index.queries(q)
    wide, turned = index.widened(x) @ index.rotation, unit @ index.rotation
    norm = np.sqrt(np.square(q).sum(axis=1))
    # ||u - w||^2 = 1 + most - 2 <u, x>: the limit that belongs to the least inner product wanted.
    limit = 1 + index.most - 2 * floor / norm
    d = wide.shape[1]
    rows, cols = np.arange(len(q)), np.arange(len(x))
    alive = query_ids[:, None] != ids[None, :]
    so_far = np.zeros(alive.shape)
    for at in range(0, d, BLOCK):
        a, b = turned[rows, at : at + BLOCK], wide[cols, at : at + BLOCK]
        so_far += np.square(a).sum(axis=1)[:, None] + np.square(b).sum(axis=1)[None, :] - 2 * a @ b.T
        seen = min(d, at + BLOCK)
        allowed = limit[rows] * (1 + SIGMAS / math.sqrt(seen)) ** 2 * seen / d if seen < d else limit[rows]
        alive &= so_far <= allowed[:, None] + 1e-9
        keep_rows, keep_cols = alive.any(axis=1), alive.any(axis=0)
        if not keep_rows.all() or not keep_cols.all():
            rows, cols = rows[keep_rows], cols[keep_cols]
            alive, so_far = alive[np.ix_(keep_rows, keep_cols)], so_far[np.ix_(keep_rows, keep_cols)]
        if not len(rows) or not len(cols):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    if len(cols) > k:
        so_far = np.where(alive, so_far, np.inf)
        alive &= so_far <= np.partition(so_far, k - 1, axis=1)[:, k - 1 : k] + 1e-9
    i, j = np.nonzero(alive)
    i, j = rows[i], cols[j]
    score = (q[i] * x[j]).sum(axis=1)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    best = place < k
    return pd.DataFrame({"query_id": query_ids[i[best]], "vec_id": ids[j[best]], "score": score[best]})


def nearest(vectors: DataFrame, queries: Column, k: int = 20, aim: float = 0.985, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``queries`` (a condition on ``vec_id``) holds its ``k``
    other rows of largest inner product that the search finds, ties to the smaller id.

    Every vector is put in the list of its nearest centre. A query is sent to its first lists, as many as the sample
    calls for to find ``aim`` of the neighbours. Lists are cut into tiles of bounded size by candidates and by
    queries, so that a list of any size is spread over tasks; each tile is scanned by ``_scan``, starting from a limit
    that ``k`` sampled vectors reach. Scores are exact, on the original vectors in double precision. Queries that find
    fewer than ``k`` rows are sent to all lists without a limit, which is exact.

    Vectors that ``usable`` leaves out take no part, neither as queries nor as candidates. Rows that repeat an id are
    candidates (or queries) of that id once each; a query never finds its own id. With fewer than ``k`` other rows all
    are returned. Tables without usable rows give none; further columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    clean = usable(vectors, id_col, vector_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    packed = fit_index(clean, k, aim)
    if not packed:
        return empty
    shared = spark.sparkContext.broadcast(packed)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _loaded(shared.value)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_list())
                yield pd.DataFrame({"list": index.list_of(x).astype(np.int32), "vec_id": batch["vec_id"].to_numpy(), "x": [r.tobytes() for r in x]})

    listed = cut_lineage(clean.mapInPandas(assign, "list int, vec_id long, x binary"))
    held = {r["list"]: r["n"] for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # LISTS numbers at most

    def probe(everything: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _loaded(shared.value)
            size = np.array([held.get(j, 0) for j in range(len(index.centres))])
            for batch in batches:
                if len(batch):
                    x = _stack(batch["x"])
                    floor = np.full(len(x), -np.inf) if everything else index.floors(x, k)
                    order = index.probe_order(x)
                    enough = (np.cumsum(size[order], axis=1) > k).argmax(axis=1) + 1
                    n = np.full(len(x), order.shape[1]) if everything else np.maximum(index.probes, enough)
                    who = np.repeat(np.arange(len(x)), n)
                    lists = np.concatenate([order[i, : n[i]] for i in range(len(x))])
                    yield pd.DataFrame({"list": lists.astype(np.int32), "query_id": batch["vec_id"].to_numpy()[who], "q": batch["x"].to_numpy()[who], "floor": floor[who]})

        return run

    def scan(few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        if not len(few) or not len(many):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return _scan(_loaded(shared.value), many["vec_id"].to_numpy(), _stack(many["x"]), few["query_id"].to_numpy(), _stack(few["q"]), few["floor"].to_numpy(), k)

    def search(asked: DataFrame, everything: bool) -> DataFrame:
        sent = cut_lineage(asked.mapInPandas(probe(everything), "list int, query_id long, q binary, floor double"))
        load = {r["list"]: r["n"] for r in sent.groupBy("list").agg(F.count("*").alias("n")).collect()}
        cut = spark.createDataFrame(
            [(j, -(-held[j] // CANDIDATES), -(-load[j] // QUERIES_PER_TILE)) for j in held if j in load], "list int, c_tiles int, q_tiles int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = sent.join(F.broadcast(cut), "list").select("list", upto("c_tiles").alias("c"), one_of("query_id", "q_tiles").alias("t"), "query_id", "q", "floor")
        right = listed.join(F.broadcast(cut), "list").select("list", one_of("vec_id", "c_tiles").alias("c"), upto("q_tiles").alias("t"), "vec_id", "x")
        found = left.groupBy("list", "c", "t").cogroup(right.groupBy("list", "c", "t")).applyInPandas(scan, "query_id long, vec_id long, score double")
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return cut_lineage(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

    asked = listed.where(queries)
    found = search(asked, False)
    most = min(k, sum(held.values()) - 1)
    full = found.groupBy("query_id").count().where(F.col("count") >= most).select(F.col("query_id").alias("vec_id"))
    short = cut_lineage(asked.join(full, "vec_id", "left_anti").select("vec_id", "x"))
    if short.isEmpty():
        return found
    again = search(short, True)
    return found.join(again.select("query_id").distinct(), "query_id", "left_anti").select(*found.columns).unionByName(again)
