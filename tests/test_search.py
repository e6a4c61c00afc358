"""Keyword search against a plain scan of every text."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from partwright.operators import search as se


def like(text, keyword):
    """``text LIKE '%keyword%'`` with ``_`` for any letter."""
    n = len(keyword)
    return any(all(k == "_" or k == c for k, c in zip(keyword, text[i : i + n])) for i in range(len(text) - n + 1))


def plain_hits(keywords, rows):
    found = defaultdict(set)
    for rank, row_id, texts in rows:
        for keyword in keywords:
            if any(like(t.lower(), keyword) for t in texts if t is not None):
                found[keyword, rank].add(row_id)
    return sorted((k, rank, row) for (k, rank), ids in found.items() for row in sorted(ids)[: se.ROWS_PER_TABLE])


@pytest.mark.parametrize("most", [200_000, 7])
def test_hits_against_a_plain_scan(spark, monkeypatch, most):
    monkeypatch.setattr(se, "KEYWORDS", most)
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abя-_é") for _ in range(n))
    rows = [(rank, row, [word(r.choice([0, 3, 40])) if r.random() < 0.9 else None for _ in range(2)]) for rank in (1, 2) for row in range(60)]
    rows += [(3, 7, ["ab" * 50_000]), (3, 7, ["repeated rows"]), (3, 2, [])]
    keywords = sorted({word(r.randint(1, 4)) for _ in range(60)} | {"___", "_", "repeated", "ab" * 40})
    tables = [
        se.index_of(spark.createDataFrame([(row, *(texts + [None, None])[:2]) for k, row, texts in rows if k == rank], "id long, a string, b string"), rank, f"t{rank}", "id", ["a", "b"], ["id"])
        for rank in (1, 2, 3)
    ]
    index = tables[0].unionByName(tables[1]).unionByName(tables[2]).repartition(5)
    asked = spark.createDataFrame([(k,) for k in [*keywords, *keywords, "", None]], "keyword string")
    got = sorted(tuple(x) for x in se.keyword_hits(asked, index).collect())
    assert got == plain_hits(keywords, rows)
    assert se.keyword_hits(asked.limit(0), index).count() == 0
    assert se.keyword_hits(asked, index.limit(0)).count() == 0


def test_table_order_and_limits(spark):
    first = spark.createDataFrame([(k, f"bolt {k}") for k in range(9)], "id long, name string")
    index = se.index_of(first, 1, "one", "id", ["name"], ["name"])
    for rank, name in ((2, "two"), (3, "three")):
        index = index.unionByName(se.index_of(first.where("id > 3"), rank, name, "id", ["name"], ["name", "id"]))
    asks = spark.createDataFrame([(1, "which Bolts 8?"), (2, "no such thing"), (3, None)], "q long, question string")
    got = se.search(asks, index, ["q"])
    assert sorted((r.q, r.place, r.table_name, r.row_id, r.summary) for r in got.collect()) == []
    asks = spark.createDataFrame([(1, "the bolt"), (2, "nothing"), (3, None)], "q long, question string")
    rows = sorted((r.q, r.place, r.table_name, r.row_id, r.summary) for r in se.search(asks, index, ["q"]).collect())
    assert rows == [(1, 1, "one", 0, "bolt 0"), (1, 2, "one", 1, "bolt 1"), (1, 3, "one", 2, "bolt 2"), (1, 4, "two", 4, "bolt 4 · 4"), (1, 5, "two", 5, "bolt 5 · 5"), (1, 6, "two", 6, "bolt 6 · 6")]
    texts = {r.q: r.answer for r in se.answers(asks.select("q"), se.search(asks, index, ["q"]), ["q"]).collect()}
    assert texts[1].startswith(se.FOUND_TEXT + " (6):\n— one · bolt 0") and texts[2] == texts[3] == se.NO_MATCH_TEXT
    assert se.search(asks.where(F.lit(False)), index, ["q"]).count() == 0


@pytest.mark.parametrize("most", [400_000, 2])
def test_words_are_handed_on_with_their_first_rows_only(spark, monkeypatch, most):
    monkeypatch.setattr(se, "WORDS", most)
    texts = spark.createDataFrame([(1, k, [f"bolt, м{k % 2} (nut)bolt", "a_b"] if k < 50 else []) for k in range(60)], "table_rank int, row_id long, texts array<string>").repartition(3)
    got = sorted((r.texts[0], r.row_id) for r in se.first_rows_of_words(texts).collect())
    assert got == sorted([(w, k) for w in ("bolt", "nut", "a_b") for k in range(3)] + [("м0", k) for k in (0, 2, 4)] + [("м1", k) for k in (1, 3, 5)])
    asked = spark.createDataFrame([("t_b",), ("ol",), (", м1",), ("a_b",), ("м",)], "keyword string")
    hits = {}
    for r in se.keyword_hits(asked, texts.select("table_rank", "row_id", "texts")).collect():
        hits.setdefault(r.keyword, set()).add(r.row_id)
    assert hits == {"t_b": {0, 1, 2}, "ol": {0, 1, 2}, ", м1": {1, 3, 5}, "a_b": {0, 1, 2}, "м": {0, 1, 2}}


def test_answers_take_tables_in_order_whatever_the_keyword(spark):
    tables = [se.index_of(spark.createDataFrame([(k, f"{w} {k}") for k in range(5) for w in own], "id long, name string"), rank, f"t{rank}", "id", ["name"], ["name"])
              for rank, own in ((1, ["screw"]), (2, ["bolt"]), (3, ["screw", "bolt"]))]
    index = tables[0].unionByName(tables[1]).unionByName(tables[2].dropDuplicates(["row_id"]))
    asks = spark.createDataFrame([(1, "screw bolt"), (2, "bolt")], "q long, question string")
    got = se.search(asks, index, ["q"]).select("q", "place", "table_name", "row_id").collect()
    assert sorted(map(tuple, got))[:6] == [(1, k + 1, "t1", k) for k in range(3)] + [(1, k + 4, "t2", k) for k in range(3)]
    assert sorted((r.place, r.table_name, r.row_id) for r in got if r.q == 2)[:3] == [(k + 1, "t2", k) for k in range(3)]
