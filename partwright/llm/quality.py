"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwright.llm.common import small_batches, text_or_empty
from partwright.llm.tokens import Store

#: Buckets of hashed words, latent factors, and the bound on labelled rows that a model is fitted on.
BUCKETS, FACTORS, SAMPLE = 1 << 14, 8, 6000
STRUCTURE = 16
MARKS = re.compile(r"[^\w\s.,;:'’\"()?!-]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
LETTER_RUN = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _buckets() -> Store:
    return Store(lambda word: zlib.crc32(word) % BUCKETS)


def structure(text: str, words: list[bytes], distinct: int, n_chars: float | None) -> list[float]:
    """Statistics of the whole text, each about within [-1, 1]; the last two describe the metadata ``n_chars``."""
    n = len(text) or 1
    w = len(words) or 1
    marks = len(MARKS.findall(text))
    upper = len(UPPER.findall(text))
    letters = sum(map(len, LETTER_RUN.findall(text)))
    lines = text.split("\n")
    same = sum(a == b for a, b in zip(words, words[1:]))
    sentence_ends = text.count(".") + text.count("?") + text.count("!") - 2 * text.count("...")
    given = n_chars is not None and np.isfinite(n_chars)
    return [
        1.0 if not words else 0.0,
        np.log1p(len(text)) / 12, np.log1p(len(words)) / 10, min(n / w / 12, 2.0), min(10 * marks / w, 3.0), marks / n * 4,
        upper / n * 2, letters / n, distinct / w, min(3 * same / w, 3.0), min(5 * text.count("|") / w, 3.0), min(5 * text.count("!") / w, 3.0),
        min(3 * len(lines) / w, 2.0), min(8 * sentence_ends / w, 2.0),
        np.log1p(max(n_chars, 0.0)) / 12 if given else 0.0, 0.0 if given else 1.0,
    ]


def features(text: str, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse row: feature numbers and values. Structure comes first, words (unit length in all) after it."""
    words = text.encode().lower().split()
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    kept = _buckets()
    at = np.fromiter((kept[w] for w in counts), dtype=np.int64, count=len(counts))
    weight = np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    if len(at):
        weight /= np.sqrt(np.square(weight).sum())
    index = np.concatenate((np.arange(STRUCTURE), STRUCTURE + at))
    return index, np.concatenate((structure(text, words, len(counts), n_chars), weight))


def interactions(value: np.ndarray, v: np.ndarray) -> float:
    """Sum over all feature pairs of ``<v_i, v_j> x_i x_j`` in linear time: half of the squared sums less the sums of squares."""
    scaled = v * value[:, None]
    return 0.5 * float((np.square(scaled.sum(axis=0)) - np.square(scaled).sum(axis=0)).sum())


class Machine:
    """Weights of a factorisation machine; ``score`` is the probability of label 1."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(STRUCTURE + BUCKETS)
        self.v = rng.normal(0, 0.05, (STRUCTURE + BUCKETS, FACTORS))

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        return self.bias + float(self.w[index] @ value) + interactions(value, self.v[index])

    def score(self, text: str, n_chars: float | None = None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text, n_chars)), -35, 35))))

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.15, decay: float = 2e-4) -> "Machine":
        """Stochastic steps with per-feature rates (AdaGrad) on the logistic loss, in a fixed order; the rarer label
        weighs as much in all as the other one (within the clip of the weights), the bias is then set back to the true
        share."""
        if not len(rows):
            self.v[:] = 0
            return self
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).clip(0.2, 5)
        gw, gv, gb = np.full(len(self.w), 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                index, value = rows[k]
                v = self.v[index]
                total = (v * value[:, None]).sum(axis=0)
                raw = self.bias + self.w[index] @ value + 0.5 * (np.square(total) - np.square(v * value[:, None]).sum(axis=0)).sum()
                error = weight[k] * (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[k])
                g = error * value + decay * self.w[index]
                gw[index] += g * g
                self.w[index] -= rate * g / np.sqrt(gw[index])
                g = error * value[:, None] * (total - v * value[:, None]) + decay * v
                gv[index] += g * g
                self.v[index] -= 0.3 * rate * g / np.sqrt(gv[index])
                gb += error * error
                self.bias -= rate * error / np.sqrt(gb)
        if 0 < labels.mean() < 1:
            # Log-odds of the true share less those of the weighted one.
            ones, zeros = weight[labels == 1].sum(), weight[labels == 0].sum()
            self.bias += float(np.log(labels.sum() / (1 - labels).sum()) - np.log(ones / zeros))
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column | None = None, bound: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """At most ``bound`` labelled rows, chosen by a hash of their ids: ``doc_id, text, n_chars, label``.

    Labels other than 0 and 1 and ids with contradicting labels are left out. The ids are taken first, so that only
    their texts are read on; rows that repeat an id count once.
    """
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = usable.where(F.lit(True) if train is None else train)
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    text = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), n_chars.alias("n_chars"))
    return text.join(F.broadcast(usable), "doc_id").dropDuplicates(["doc_id"])


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, bound: int = SAMPLE, **names) -> bytes:
    """A fitted machine, pickled. One task fits it on the bounded sample; the driver only gets the model."""
    sample = labelled_sample(docs, labels, train, bound, **names)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b[["doc_id", "text", "n_chars", "label"]] for b in batches]
        rows, y = [], np.empty(0)
        if got:
            all_rows = pd.concat(got).sort_values("doc_id")
            rows = [features(t, n) for t, n in zip(all_rows["text"], all_rows["n_chars"])]
            y = all_rows["label"].to_numpy(dtype=float)
        yield pd.DataFrame({"model": [_packed(Machine().fit(rows, y))]})

    made = sample.coalesce(1).mapInPandas(fit, "model binary").first()
    return bytes(made["model"]) if made else _packed(Machine().fit([], np.empty(0)))


def _packed(machine: Machine) -> bytes:
    return pickle.dumps((machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)))


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Machine:
    machine = Machine()
    machine.bias, w, v = pickle.loads(model)
    machine.w, machine.v = w.astype(np.float64), v.astype(np.float64)
    return machine


def quality_scores(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """``doc_id, score`` (and ``row``, the whole input row, on request): one row per input row, from the whole text.

    The score is the probability of label 1. Null and empty texts get the score of an empty text; a missing ``n_chars``
    is a feature of its own. Ids are only carried along (null and repeated ones too); source, language and labels are
    no inputs; other columns are ignored. A table without rows gives none; without labelled rows every score is 0.5.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _loaded(shared.value)
        for batch in batches:
            found = [machine.score(t, n) for t, n in zip(batch["text"], batch["n_chars"])]
            yield batch.drop(columns=["text", "n_chars"]).assign(score=found)

    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), n_chars.alias("n_chars"))
    kind = base.schema["doc_id"].dataType.simpleString()
    if not with_row:
        return base.mapInPandas(score, f"doc_id {kind}, score double")

    def scored(text: pd.Series, n: pd.Series) -> pd.Series:
        machine = _loaded(shared.value)
        return pd.Series([machine.score(t, c) for t, c in zip(text, n)], dtype="float64")

    udf = F.pandas_udf(scored, "double")
    return docs.select(F.col(id_col).alias("doc_id"), F.struct("*").alias("row"), udf(text_or_empty(text_col), n_chars).alias("score"))
