"""Secret spans against a plain scan of every text; the ledger over several runs."""

import random
import re
from collections import defaultdict
from dataclasses import replace

from pyspark.sql import functions as F

from partwright.llm.secret_ledger import BASE_RULES, RULES, Ledger, Rule, secret_spans

# The rules as the contract writes them, letter case of the first spelt out.
ASSIGN = re.compile("(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def plain(text):
    text = text or ""
    spans = [(m.start(), 1, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 2, m.end(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    spans += [(m.start(), 3, m.end(), "hex") for m in HEX.finditer(text) if len(m.group()) >= 24]
    return sorted(spans)


def generated(seed, n):
    r = random.Random(seed)
    part = ["password", "PassWd", "Secret", "toKEN", "api_key", "apikey", "API", "AKIA", "=", ":", " ", "  ", '"', "'", "abc", "0123456789abcdef" * 2, "deadbeef", "Z9" * 9, "é", "\n", "ſecret=abcdefgh", "toKen: 1234567", ".", "AKIA" + "Q" * 16, "漢"]
    return ["".join(r.choice(part) for _ in range(r.randint(0, 40))) for _ in range(n)]


def got(df):
    return sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in df.collect()), key=str)


def test_base_spans_against_a_plain_scan(spark):
    texts = generated(3, 3000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = got(secret_spans(docs, rules=BASE_RULES))
    assert found == sorted(((i, plain(t)) for i, t in enumerate(texts)), key=str)
    assert sum(len(s) for _, s in found) > 1000


def test_odd_tables(odd, none):
    wanted = sorted(((r.doc_id, plain(r.text)) for r in odd.collect()), key=str)
    assert got(secret_spans(odd, rules=BASE_RULES)) == wanted
    assert secret_spans(none).count() == 0


def test_further_kinds_and_order(spark):
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END RSA PRIVATE KEY-----"
    text = f"x{pem} token={'a1' * 15} é https://me:pw12@host/ eyJab.eyJcd.sig_1 ghp_{'A' * 36} -----BEGIN PUBLIC KEY-----"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secret_spans(docs).first()["spans"]
    values = [(s.kind, text[s.start : s.end]) for s in spans]
    assert values == [("pem", pem), ("assign", f"token={'a1' * 15}"), ("hex", "a1" * 15), ("login", "://me:pw12@"), ("jwt", "eyJab.eyJcd.sig_1"), ("service", f"ghp_{'A' * 36}")]
    assert [s.rank for s in spans] == [[r.kind for r in RULES].index(k) + 1 for k, _ in values]


def test_long_runs_take_linear_time(spark):
    texts = ["token" + " " * 300_000, "://" * 100_000, "AKIA" * 60_000, "a" * 400_000, "://a:" * 60_000, "-----BEGIN RSA PRIVATE KEY-----" + "A" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_spans(docs).collect()}
    assert found == {0: [], 1: [], 2: [("access", 0, 240_000)], 3: [("hex", 0, 400_000)], 4: [], 5: []}


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    old, new = "a token=abcdef1", "b secret: 1234567"
    first = spark.createDataFrame([("p", 1, old), ("q", 1, old), ("r", 1, None), ("r", 2, "")], "path string, version int, text string")
    run = lambda df, rules=BASE_RULES: sorted((r.path, r.version, [(s.kind, s.start) for s in r.spans]) for r in secret_spans(df, folder, rules, ["path", "version"]).collect())
    assert run(first) == [("p", 1, [("assign", 2)]), ("q", 1, [("assign", 2)]), ("r", 1, []), ("r", 2, [])]
    book = Ledger(spark, folder)
    scans = lambda: sorted((len(r.rules), r.n) for r in book.rows().groupBy("blob", "rules").agg(F.count("*").alias("n")).collect())
    assert scans() == [(3, 1), (3, 1)]
    # The same versions again, and a further version of one path: one blob is scanned.
    more = first.union(spark.createDataFrame([("p", 2, new)], first.schema))
    assert run(more) == [("p", 1, [("assign", 2)]), ("p", 2, [("assign", 2)]), ("q", 1, [("assign", 2)]), ("r", 1, []), ("r", 2, [])]
    assert scans() == [(3, 1), (3, 1), (3, 1)]
    # A new version of one rule: all blobs are scanned by this rule alone, and its old findings are not reported.
    second = tuple(replace(r, version=2, pattern="secret", group=0, least=1) if r.kind == "assign" else r for r in BASE_RULES)
    assert run(more, second) == [("p", 1, []), ("p", 2, [("assign", 2)]), ("q", 1, []), ("r", 1, []), ("r", 2, [])]
    assert scans() == [(1, 1), (1, 1), (1, 1), (3, 1), (3, 1), (3, 1)]
    assert run(more)[0] == ("p", 1, [("assign", 2)])
    # What a retried batch wrote twice counts once.
    book.append(book.rows())
    assert run(more) == [("p", 1, [("assign", 2)]), ("p", 2, [("assign", 2)]), ("q", 1, [("assign", 2)]), ("r", 1, []), ("r", 2, [])]


def test_ids_and_copies(spark):
    hot = "the hot text, passwd='qwerty1'"
    rows = [(None, hot), (None, hot), (4, hot), (4, hot), (4, "other token:zzzzzz"), (9, hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = defaultdict(list)
    for r in secret_spans(docs, rules=(*BASE_RULES, Rule("note", 1, "hot", needles=("hot",)))).collect():
        by[r.doc_id].append([(s.kind, s.start, s.end) for s in r.spans])
    want = [("note", 4, 7), ("assign", 14, 29)]
    assert {k: sorted(v) for k, v in by.items()} == {None: [want, want], 4: sorted([want, want, [("assign", 6, 18)]]), 9: [want]}
