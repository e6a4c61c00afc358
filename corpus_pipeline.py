"""A training corpus from the documents table: filter, dedup lines, dedup documents, mix sources, pack sequences.

``STAGES`` are applied in order, each to all rows that the one before kept, written as Parquet and read again. All but
the last return the columns of ``documents``. Rows with null ids are kept by every stage; empty texts pass the filter
only by their score, link with nothing and are never taken by the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.llm.common import table
from partwright.llm.line_dedup import line_dedup
from partwright.llm.mixing import mixed_documents
from partwright.llm.near_dedup import near_duplicates
from partwright.llm.packing import pack
from partwright.llm.quality import fit_quality, quality_scores
from partwright.llm.queries import TRAINING, vocabulary_path
from partwright.llm.tokens import stored_pieces
from partwright.session import cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labels, scores 0.5 or more."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), train=F.expr(TRAINING))
    return quality_scores(docs, model, with_row=True).where("score >= 0.5").select("row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share, in the first of them only; ``n_chars`` follows the text."""
    kept = line_dedup(docs, with_row=True)
    new = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more): the smallest id."""
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources (weights 5, 2, 1, three epochs at most) takes them."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every taken document in sequences of 2048 tokens."""
    return pack(stored_pieces(docs, vocabulary_path()))


STAGES = [
    ("quality_filter", keep_quality),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("source_mixing", mix),
    ("best_fit_packing", pack_sequences),
]

#: A fitted model, sketches and a vocabulary have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
