"""Keyword search of many questions over many texts, however long, without a cross join.

A keyword lies within one word of a text, and a row among the first with the keyword is among the first with that word.
So one pass over the texts gives every distinct word with its first rows, and keywords meet words, not texts. All
distinct keywords form one automaton (in shares, where they are too many for one). Keywords that may reach beyond a
word, which hold ``_`` or a separator, are sought in the whole texts. Only the first rows per keyword and table can
reach an answer, so a task hands on just those, and each later level keeps just its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwright.functions import text as tx
from partwright.session import cut_lineage

# ---- fixed values ---------------------------------------------------------------------------
ROWS_PER_TABLE = 3
ROWS_PER_QUESTION = 6
NO_MATCH_TEXT = "По вашему вопросу не найдено записей в базе НСИ."
FOUND_TEXT = "По вашему вопросу найдено в базе НСИ"
# ---------------------------------------------------------------------------------------------

#: Keywords in one automaton: some 10 MB. Up to so many are handed to all tasks, more are dealt out in shares.
KEYWORDS = 200_000
#: What stands for any one letter in a keyword, as in SQL.
ANY = "_"
#: What ends a word, here and in Java: ASCII other than letters, digits, hyphen and underscore. Other signs stay in words.
SEPARATORS = r"[\x00-\x2C\x2E\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"
#: Words and their characters a task holds before it hands them on.
WORDS, LETTERS = 400_000, 20_000_000


def index_of(table: DataFrame, rank: int, name: str, row_id: str, search: list[str], summary: list[str]) -> DataFrame:
    """Rows of one table as ``table_rank, table_name, row_id, texts, summary``."""
    return table.select(
        F.lit(rank).alias("table_rank"), F.lit(name).alias("table_name"), F.col(row_id).cast("bigint").alias("row_id"),
        F.array_compact(F.array(*[F.lower(F.col(c).cast("string")) for c in search])).alias("texts"),
        F.concat_ws(" · ", *[F.col(c).cast("string") for c in summary]).alias("summary"),
    )


def _first(df: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """First rows per key; Spark prunes to ``count`` per key before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= count).drop("_rn")


class Finder:
    """The first rows, per table, of texts that hold each of some keywords."""

    def __init__(self, keywords: list[str]):
        self.keywords = keywords
        self.plain, self.wild, everywhere = ahocorasick.Automaton(), {}, []
        at: dict[str, list[int]] = {}
        for k, keyword in enumerate(keywords):
            part = max(keyword.split(ANY), key=len)
            if ANY in keyword:
                self.wild[k] = re.compile(".".join(map(re.escape, keyword.split(ANY))), re.DOTALL)
            if part:
                at.setdefault(part, []).append(k)
            else:
                everywhere.append(k)
        for part, held in at.items():
            self.plain.add_word(part, held)
        if at:
            self.plain.make_automaton()
        self.everywhere, self.empty = everywhere, not at
        self.first: dict[tuple[int, int], list[int]] = {}

    def read(self, rank: int, row_id: int, text: str) -> None:
        held = set(self.everywhere)
        if not self.empty:
            for _, found in self.plain.iter(text):
                held.update(found)
        for k in held:
            rows = self.first.setdefault((k, rank), [])
            if row_id in rows or (len(rows) == ROWS_PER_TABLE and row_id > rows[-1]):
                continue
            if k in self.wild and not self.wild[k].search(text):
                continue
            rows.append(row_id)
            rows.sort()
            del rows[ROWS_PER_TABLE:]

    def rows(self) -> pa.RecordBatch:
        found = [(self.keywords[k], rank, row_id) for (k, rank), rows in self.first.items() for row_id in rows]
        columns = list(zip(*found)) or [[], [], []]
        return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["keyword", "table_rank", "row_id"])


FOUND = "keyword string, table_rank int, row_id long"


def _one_automaton(words: list[str], texts: DataFrame) -> DataFrame:
    """One pass over the texts where they lie; no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(words)
        for batch in batches:
            for rank, row_id, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for text in own:
                    finder.read(rank, row_id, text)
        yield finder.rows()

    return texts.mapInArrow(scan, FOUND)


def _in_shares(words: DataFrame, count: int, texts: DataFrame, slices: int) -> DataFrame:
    """Keywords fall into shares of about ``KEYWORDS``; a slot has the keywords of one share and a slice of the texts, and
    builds its automaton from the rows that come first. Texts are shuffled once per share."""
    shares = -(-count // KEYWORDS)
    share = F.pmod(F.xxhash64("keyword"), F.lit(shares)).cast("int")
    word = words.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), share.alias("share"), F.lit(0).alias("kind"), "keyword", F.lit(0).alias("table_rank"), F.lit(0).cast("long").alias("row_id"), F.lit(None).cast("array<string>").alias("texts"))
    text = texts.select(F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("keyword"), "table_rank", "row_id", "texts")
    slots = word.unionByName(text).repartition(slices * shares, "share", "slice").sortWithinPartitions("share", "slice", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, words, finder = None, [], None
        for batch in batches:
            for slice_, share, kind, keyword, rank, row_id, own in zip(*(batch.column(c).to_pylist() for c in ("slice", "share", "kind", "keyword", "table_rank", "row_id", "texts"))):
                if (share, slice_) != slot:
                    if finder is not None:
                        yield finder.rows()
                    slot, words, finder = (share, slice_), [], None
                if kind == 0:
                    words.append(keyword)
                    continue
                finder = finder or Finder(words)
                for text in own:
                    finder.read(rank, row_id, text)
        if finder is not None:
            yield finder.rows()

    return slots.mapInArrow(scan, FOUND)


def first_rows_of_words(texts: DataFrame) -> DataFrame:
    """``table_rank, row_id, texts``: the distinct words of the texts, each with its first rows per table only."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, seen, held, letters = re.compile(SEPARATORS), {}, 0, 0

        def rows() -> pa.RecordBatch:
            found = [(rank, word, first) for rank, words in seen.items() for word, first in words.items()]
            ranks, words, firsts = list(zip(*found)) or [(), (), ()]
            return pa.record_batch([pa.array(ranks, pa.int32()), pa.array(words, pa.string()), pa.array(firsts, pa.list_(pa.int64()))], ["table_rank", "word", "first"])

        for batch in batches:
            for rank, row_id, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                known = seen.setdefault(rank, {})
                for word in {word for text in own for word in apart.split(text)}:
                    first = known.get(word)
                    if first is None:
                        known[word] = (row_id,)
                        held, letters = held + 1, letters + len(word)
                    elif (len(first) < ROWS_PER_TABLE or row_id < first[-1]) and row_id not in first:
                        known[word] = tuple(sorted((*first, row_id))[:ROWS_PER_TABLE])
                if held >= WORDS or letters >= LETTERS:
                    yield rows()
                    seen, held, letters = {}, 0, 0
        yield rows()

    found = texts.mapInArrow(cut, "table_rank int, word string, first array<bigint>").where("word <> ''")
    # A task hands on three rows per word and table, so the set of one word stays small.
    firsts = F.slice(F.array_sort(F.collect_set("row_id")), 1, ROWS_PER_TABLE)
    first = found.select("table_rank", "word", F.explode("first").alias("row_id")).groupBy("table_rank", "word").agg(firsts.alias("first"))
    return first.select("table_rank", F.explode("first").alias("row_id"), F.array("word").alias("texts"))


def _hits(words: DataFrame, count: int, texts: DataFrame, least: int) -> DataFrame:
    """Keywords against texts; of many keywords each slot builds its automaton for at least so many texts."""
    if count <= KEYWORDS:
        return _one_automaton([r.keyword for r in words.collect()], texts)
    slices = min(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), texts.count() // least + 1)
    return _in_shares(words, count, texts, slices)


def keyword_hits(keywords: DataFrame, index: DataFrame) -> DataFrame:
    """First matching rows of every distinct keyword and table: ``keyword, table_rank, row_id``.

    A keyword matches a text that holds it; ``_`` in it stands for any letter.
    """
    words = cut_lineage(keywords.select("keyword").where(F.length("keyword") > 0).distinct())
    texts = index.select(F.col("table_rank").cast("int").alias("table_rank"), "row_id", "texts")
    beyond = F.contains("keyword", F.lit(ANY)) | F.col("keyword").rlike(SEPARATORS)
    counts = words.agg(F.count_if(~beyond).alias("within"), F.count_if(beyond).alias("beyond")).first()
    found = _hits(words.where(~beyond), counts["within"], cut_lineage(first_rows_of_words(texts)), KEYWORDS)
    if counts["beyond"]:
        found = found.unionByName(_hits(words.where(beyond), counts["beyond"], texts, 1))
    return _first(found.distinct(), ["keyword", "table_rank"], ["row_id"], ROWS_PER_TABLE)


def search(questions: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Up to three rows per table and six per question, in table order: ``keys, place, table_name, row_id, summary``.

    Of a keyword's rows only the first six can reach an answer: each one before takes a place, or its table has three.
    """
    asked = cut_lineage(questions.select(*keys, F.explode(F.array_distinct(tx.keywords(F.col("question")))).alias("keyword")))
    row = F.struct("table_rank", "row_id")
    hits = keyword_hits(asked, index).groupBy("keyword").agg(F.slice(F.array_sort(F.collect_list(row)), 1, ROWS_PER_QUESTION).alias("rows"))
    met = asked.join(cut_lineage(hits), "keyword").groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("rows")))).alias("rows"))
    # In order, a row is beyond the third of its table if the one three places before is of the same table.
    third = F.filter("rows", lambda r, i: (i < ROWS_PER_TABLE) | (F.get(F.col("rows"), i - ROWS_PER_TABLE)["table_rank"] != r["table_rank"]))
    top = met.select(*keys, F.posexplode(F.slice(third, 1, ROWS_PER_QUESTION)).alias("at", "row"))
    top = top.select(*keys, (F.col("at") + 1).alias("place"), "row.*")
    return top.join(index.drop("texts"), ["table_rank", "row_id"]).select(*keys, "place", "table_name", "row_id", "summary")


def answers(questions: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Template answer: a heading with the count and one line per match, or the fixed no-match text."""
    line = F.concat(F.lit("— "), "table_name", F.lit(" · "), "summary")
    ordered = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))  # at most six
    texts = results.groupBy(*keys).agg(ordered.alias("ls"))
    body = F.array_join(F.concat(
        F.array(F.concat(F.lit(FOUND_TEXT + " ("), F.size("ls").cast("string"), F.lit("):"))), F.transform("ls", lambda l: l["line"])
    ), "\n")
    return questions.join(texts, keys, "left").select(*keys, F.when(F.col("ls").isNull(), NO_MATCH_TEXT).otherwise(body).alias("answer"))
