"""Near-duplicates, fingerprints, nearest vectors."""

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from partwright.llm import near_dedup
from partwright.llm.near_dedup import accident, band_hashes, linked_in_buckets, near_duplicates, registers, shingle_set
from partwright.llm.nearest import nearest
from partwright.llm.piecewise import alike, edit_distances, fingerprint, fingerprints, with_next
from partwright.llm.queries import _compared, edited


def brute_components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(width, len(w))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()))
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return sorted([(i, len(s), root(i) if i is not None else None) for i, s in sets], key=str)


def test_near_duplicates_of_odd_tables(odd, none):
    got = near_duplicates(odd, width=2).collect()
    want = brute_components([(r.doc_id, r.text) for r in odd.collect()], 2, 80)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)
    assert near_duplicates(none).count() == 0


def test_a_large_group_of_drifting_copies_loses_no_link(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    seed = [r.choice(words) for _ in range(60)]
    rows = []
    for k in range(160):
        copy = list(seed)
        for _ in range(r.randint(0, 9)):
            copy[r.randrange(60)] = r.choice(words)
        rows.append((1000 - k, " ".join(copy)))
    rows += [(2000 + k, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 5, 40])))) for k in range(60)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in got], key=str) == brute_components(rows, 2, 80)


def test_one_call_searches_many_buckets(monkeypatch):
    r = random.Random(6)
    rows = []
    for family in range(30):
        seed = [f"f{family}w{k}" for k in range(80)]
        for copy in range(4):
            words = [f"c{copy}" if r.random() < 0.02 * copy else w for w in seed]
            s = shingle_set(" ".join(words), 1)
            for band, bucket in enumerate(band_hashes(registers(s)[None, :])[0].tolist()):
                rows.append((bucket, band, 10 * family + copy, 10 * family + copy, s.tobytes(), registers(s).tobytes()))
    table = pd.DataFrame(rows, columns=["bucket", "band", "doc_id", "component", "s", "regs"])
    table["main"] = table.groupby("bucket")["component"].transform("max")
    few = table[table["component"] != table["main"]].sample(frac=1, random_state=1)
    sets = {row.doc_id: set(np.frombuffer(row.s, dtype=np.uint64).tolist()) for row in table.itertuples()}
    shared = {(a.doc_id, b) for _, bucket in table.groupby("bucket") for a in bucket.itertuples() for b in bucket["doc_id"] if a.doc_id < b}
    want = {(a, b) for a, b in shared if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    for pairs in (near_dedup.PAIRS, 7):
        monkeypatch.setattr(near_dedup, "PAIRS", pairs)
        got = linked_in_buckets(few, table, 80)
        assert {tuple(sorted(p)) for p in got.itertuples(index=False)} == want and len(got) == len(want) > 60


def test_corrected_estimates():
    r = random.Random(8)
    for share in (0.2, 0.5, 0.8):
        found = []
        for _ in range(30):
            words = [str(r.random()) for _ in range(900)]
            n = int(450 * (1 - share) / (1 + share) + 0.5) if share < 1 else 0
            a, b = words[:450], words[n : n + 450]
            x, y = registers(shingle_set(" ".join(a), 1)), registers(shingle_set(" ".join(b), 1))
            found.append(((x == y).mean() - accident()) / (1 - accident()))
        assert abs(np.mean(found) - (450 - n) / (450 + n)) < 0.03
    assert 0 < accident() < 1e-3


def test_edit_distance_and_likeness():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            new = [i + 1]
            for j, e in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != e)))
            row = new
        return row[-1]

    r = random.Random(2)
    a = ["".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(200)]
    b = ["".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(200)]
    assert list(edit_distances(a, b)) == [plain(x, y) for x, y in zip(a, b)]
    text = " ".join(r.choice(["one", "two", "three", "four", "five"]) + str(r.randint(0, 99)) for _ in range(500))
    other = " ".join(str(r.random()) for _ in range(200))
    assert alike(fingerprint(text), fingerprint(text)) == 1.0
    assert alike(fingerprint(text), fingerprint("start " + text)) > 0.8
    assert alike(fingerprint(text), fingerprint(text[:900] + "CHANGED" + text[900:])) > 0.7
    assert alike(fingerprint(text), fingerprint(other)) == 0.0
    assert fingerprint("") == "3::::" and len(fingerprint("a" * 100_000)) < 20


def test_next_documents_of_odd_tables(odd, none):
    schema = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    got = with_next(odd, _compared, schema).collect()
    rows = sorted([(r.doc_id, r.text or "") for r in odd.collect()], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = edited(text, following)
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprint(text), fingerprint(new), round(alike(fingerprint(text), fingerprint(following)), 12)))
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_next, 12)) for r in got], key=str) == sorted(want, key=str)
    assert with_next(none, _compared, schema).count() == 0
    assert sorted([tuple(r) for r in fingerprints(odd).collect()], key=str) == sorted([(i, len(t), fingerprint(t)) for i, t in rows], key=str)
    one = odd.where("doc_id = 5")
    assert [r.near_next for r in with_next(one, _compared, schema).collect()] == [1.0]


def test_nearest_on_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 12)).round(3)
    x[100:400] = x[100]  # a hot vector
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(900, None), (920, []), (940, [0.0] * 12), (960, [1.0] * 11), (980, [1.0] * 11 + [float("nan")]), (1000, [1.0] * 11 + [None]), (1020, [float("inf")] * 12), (None, [1.0] * 12), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("list"), F.lit("q").alias("score"))
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    ids = np.array([*range(700), 3])
    full = np.vstack([x, x[3:4]])
    hit = 0
    for q, found in got.items():
        score = (full * x[q]).sum(axis=1)
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert found == [(k + 1, *p[::-1]) for k, p in enumerate(sorted([(-s, i) for _, i, s in found]))] or [(f[1], -f[2]) for f in found] == [(i, s) for s, i in sorted((-f[2], f[1]) for f in found)]
        hit += len({ids[k] for k in order} & {f[1] for f in found})
    assert hit / (20 * len(got)) >= 0.9
    few = df.where("vec_id < 8")
    assert nearest(few, F.col("vec_id") % 20 == 0).count() == 7 + 1  # id 3 stands twice
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(df.where("vec_id >= 900"), F.col("vec_id") % 20 == 0).count() == 0


def test_copies_at_the_lowest_ids_do_not_set_the_probes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 12)).round(3)
    x[:2400] = x[0]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = range(2600, 12_000, 200)
    got = {}
    for r in nearest(df, F.expr("vec_id % 200 = 0 and vec_id >= 2600"), k=20).collect():
        got.setdefault(r.query_id, []).append(r.score)
    found = 0
    for i in asked:
        scores = x @ x[i]
        scores[i] = -np.inf
        found += sum(s >= np.sort(scores)[-20] - 1e-9 for s in got[i])
    assert found >= 0.95 * 20 * len(asked)
