"""Filter audit against applying every order document by document."""

import random
from collections import Counter
from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from partwright.llm.filter_audit import filter_audit, order_totals, removal_intervals


def masks_of(rows):
    """Failed filters of ``(doc_id, text, lang)``, in plain Python."""
    out = []
    for i, text, lang in rows:
        text = text or ""
        words = text.encode().split()
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text)
        fails += "E" * any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
        out.append((i, lang or "", fails))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found = Counter()
    for i, part, fails in masks_of(rows):
        for order in permutations("ABCDE"):
            order, gone = "".join(order), False
            for step, f in enumerate(order, 1):
                at = (part, order, step)
                found[at, "kept"] += 0
                if f in fails and not gone:
                    found[at, "removed"] += 1
                    found[at, "good_lost"] += i in good
                    found[at, "toxic_lost"] += i in toxic
                    found[(part, f), "shapley"] += 1
                    gone = True
                elif f in fails:
                    found[at, "redundant"] += 1
                found[at, "kept"] += not gone
                found[at, "unique_fails"] += fails == f
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    keys = {at for at, _ in found if len(at) == 3}
    return sorted((*at, *[found[at, n] for n in names], found[(at[0], at[1][at[2] - 1]), "shapley"]) for at in keys)


def test_audit_of_odd_tables_against_brute_force(spark, odd, none):
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (5, None, None), (9, 1, 0), (None, 1, 1), (77, 1, 1)]
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' as part", "'clash' as text")
    got = filter_audit(odd, label).collect()
    assert sorted(tuple(r) for r in got) == brute([(r.doc_id, r.text, r.lang) for r in odd.collect()], labels)
    assert filter_audit(none, label).count() == 0
    assert {r.shapley for r in filter_audit(odd, label.limit(0)).collect()} == {r.shapley for r in got}


def test_audit_of_random_texts(spark):
    r = random.Random(5)
    text = lambda: " ".join(r.choice(["Up", "low", "x1", "50%", "a|b", "ÄÖ"] + [f"w{k}" for k in range(r.choice([3, 300]))]) for _ in range(r.choice([0, 20, 199, 200, 260])))
    texts = [text() for _ in range(60)]
    rows = [(k, r.choice(texts), r.choice(["en", "de", None, ""])) for k in range(150)]
    labels = [(k, r.randint(0, 1), r.randint(0, 1)) for k in range(0, 150, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, labels)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_intervals_cover_each_order_once(k):
    orders = list(permutations(range(k)))
    found = Counter()
    for mask, step, begin, end in removal_intervals(k):
        assert 0 <= begin < end <= factorial(k)
        for rank in range(begin, end):
            found[mask, step, rank] += 1
    want = {(m, next(s for s, f in enumerate(o, 1) if m >> f & 1), n): 1 for m in range(1, 1 << k) for n, o in enumerate(orders)}
    assert found == want


def test_own_filters_and_their_bounds(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x")], "doc_id long, text string, lang string")
    label = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    got = filter_audit(docs, label, {"P": F.col("text") == "a", "Q": F.col("doc_id") < 3}, repeated=None).collect()
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant) for r in got) == [("PQ", 1, 2, 1, 0), ("PQ", 2, 1, 1, 1), ("QP", 1, 1, 2, 0), ("QP", 2, 1, 0, 1)]
    for names in (list("ABCDEFGHI"), [], ["AB"]):
        with pytest.raises(ValueError):
            order_totals(docs.selectExpr("'x' as part", "1 as mask", "1 as removed", "1 as good_lost", "1 as toxic_lost"), names)
