"""Line dedup, mixing, spans of personal data."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from partwright.llm.disclosure import private_spans, sanitised, span_report
from partwright.llm.line_dedup import line_dedup
from partwright.llm.mixing import mix_sources, mixed_documents, source_targets


def brute_lines(rows):
    holders = defaultdict(set)
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    for i, lines in split:
        for line in lines:
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, lines in split:
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)], key=order) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup_against_brute_force(odd, none):
    got = sorted([tuple(r) for r in line_dedup(odd).collect()], key=str)
    assert got == brute_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert line_dedup(none).count() == 0
    rows = line_dedup(odd, with_row=True).select("row.*").columns
    assert rows == odd.columns


def brute_targets(sizes):
    """Deal by weight, stop sources at three times their size, deal the rest again, until none is above."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            free.remove(s)


def brute_copies(rows):
    """How often each of ``(doc_id, text, source)`` is taken; ids are different and not null."""
    found = defaultdict(list)
    for i, text, source in rows:
        text = text or ""
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        plain = len(regex.sub(r"[^\p{L}\p{N}\x20\x09-\x0D.,;:'-]+", "", text))
        quality = 0.05 + 0.95 * (plain / max(len(text), 1))
        u = (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 1) / (16**13 + 1)
        found[source].append((-math.log(u) / quality, i, size))
    targets = brute_targets({s: sum(x[2] for x in v) for s, v in found.items()})
    copies = {}
    for source, items in found.items():
        total, before = sum(x[2] for x in items), 0
        epochs = min(3, math.floor(targets[source] / total)) if total else 0
        for _, i, size in sorted(items):
            take = size > 0 and epochs < 3 and before + size / 2 <= targets[source] - epochs * total
            copies[i] = epochs + take if size else 0
            before += size
    return copies


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, None: 85, "e": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df, (5, 2, 1)).collect()}
    assert {s: pytest.approx(t) for s, t in brute_targets(sizes).items()} == got
    assert source_targets(df.limit(0), (5, 2, 1)).count() == 0


def test_mix_meets_its_targets(odd, none):
    rows = mix_sources(odd).collect()
    assert len(rows) == odd.count() and rows != []
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(odd).collect()))
    sizes = {len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd.collect()}
    assert sizes == {r.size for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for got in by.values():
        assert abs(sum(r.taken for r in got) - got[0].target) <= max(r.size for r in got) / 2 + 1e-9
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert mix_sources(none).count() == 0 and mixed_documents(none).count() == 0


def test_base_spans_and_no_terms_in_copies(odd, none, spark):
    got = {(r.doc_id, r.kind, r.value) for r in private_spans(odd).collect()}
    assert got == {(7, "email", "a.b@c.de"), (7, "phone", "10175557713"), (7, "ip", "10.0.0.255")}
    assert span_report(odd).count() == odd.count() and span_report(none).count() == 0
    text = {r.doc_id: r.text for r in sanitised(odd).collect()}[7]
    assert text.endswith("mail [email] and [phone], [ip]")


def test_terms_that_give_a_value_away(spark):
    mail = "jo@x.org"
    lines = [f"Zorblax wrote to {mail} on day {w}" for w in ("one", "two", "six")] + [f"nobody wrote to us on a day of {w}" for w in ("rain", "wind", "snow", "hail", "dust", "too")]
    docs = spark.createDataFrame(list(enumerate(lines)) + [(50, f"Zorblax wrote {mail} too")], "doc_id long, text string")
    found = [(r.doc_id, r.start, r.end, r.value) for r in private_spans(docs, alpha=0.9).where("kind = 'term'").collect()]
    assert sorted(found) == [(0, 0, 7, "zorblax"), (1, 0, 7, "zorblax"), (2, 0, 7, "zorblax"), (50, 0, 7, "zorblax")]
    # Counted by hand: value and term meet in 4 of 10 lines, each occurs in 4.
    assert math.log(4 * 10 / (4 * 4)) >= 0.9 * math.log(10 / 4)
    assert {r.doc_id: r.text for r in sanitised(docs).collect()}[0] == " wrote to [email] on day one"
    copies = spark.createDataFrame([(k, lines[0]) for k in range(5)], "doc_id long, text string")
    assert private_spans(copies).where("kind = 'term'").count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    """Base spans as the contract writes them: ``start, end, kind, value``."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and (not 12 <= len(digits) <= 19 or sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10):
                continue
            out.append((m.start(), m.end(), kind, m[0].lower() if kind == "email" else m[0] if kind == "ip" else digits))
    return out


def plain_terms(docs, alpha, support):
    """Terms by counting, in every line, the values in it and beside it."""
    words = lambda text: regex.findall(r"[\p{L}\p{M}]+", text.lower())
    total, with_value, with_term, both, wordings = 0, defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for text in docs.values():
        lines = text.split("\n")
        for k, line in enumerate(lines):
            total += 1
            near = [lines[k - 1] if k else "", line, lines[k + 1] if k + 1 < len(lines) else ""]
            values, found = {s[2:] for x in near for s in plain_spans(x)}, set(words(line))
            for w in found:
                with_term[w] += 1
            for v in values:
                with_value[v] += 1
                for w in found:
                    both[v, w] += 1
                    wordings[v, w].add(tuple(near))
    telling = {
        (v, w) for (v, w), n in both.items() if len(wordings[v, w]) >= support and with_value[v] < total
        and math.log(n * total / (with_term[w] * with_value[v])) >= alpha * math.log(total / with_value[v]) - 1e-12
    }
    out = set()
    for i, text in docs.items():
        base = plain_spans(text)
        mine = {w for v, w in telling if v in {s[2:] for s in base}}
        for m in regex.finditer(r"[\p{L}\p{M}]+", text):
            if m[0].lower() in mine and not any(m.start() < e and m.end() > s for s, e, _, _ in base):
                out.add((i, m.start(), m.end(), m[0].lower()))
    return out


def test_spans_against_a_plain_scan(spark):
    r = random.Random(7)
    part = ["a@b.co", "x.y", "@", ".", "+1", "4111 1111 1111 1111", "10.0.0.1", "999.1.1.1", "7", " ", "-", "(", ")", "555", "\n", "é", "漢", "Ab", "%", "4242-4242-4242-4242", "1.2.3.4.5"]
    docs = {i: "".join(r.choice(part) for _ in range(r.randint(0, 30))) for i in range(2500)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {(x.doc_id, x.start, x.end, x.kind, x.value) for x in private_spans(df).where("kind <> 'term'").collect()}
    assert got == {(i, *s) for i, text in docs.items() for s in plain_spans(text)} and len(got) > 500


def test_terms_against_counting(spark):
    r = random.Random(8)
    people = [("Ann Lee", "ann.lee@x.org"), ("李明", "lm@y.cn"), ("Bo", "+1 555 123 4567"), ("Chris Long", "chris@z.net")]
    filler = ["the plan is good", "we met at noon", "it rains", "a b c", "Lee wind", ""]
    docs = {}
    for i in range(120):
        lines = [r.choice(filler) + f" {r.choice('pqrs')}" for _ in range(r.randint(1, 5))]
        if r.random() < 0.4:
            name, address = r.choice(people)
            lines += [f"{name}", f"{r.choice(['', 'write to '])}{address}"] if r.random() < 0.7 else [f"{name} has {address}"]
        docs[i] = "\n".join(lines)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for alpha, support in ((0.9, 2), (0.6, 3)):
        got = {(x.doc_id, x.start, x.end, x.value) for x in private_spans(df, alpha=alpha, support=support).where("kind = 'term'").collect()}
        assert got == plain_terms(docs, alpha, support)
        assert {"ann", "李明", "bo"} <= {x[3] for x in got}


def test_long_runs_do_not_blow_up(spark):
    texts = ["a" * 200_000 + "@", "1." * 50_000, "1 " * 50_000, "a@b" + ".c" * 50_000, "+1" + " " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.kind, r.end) for r in private_spans(docs).where("kind <> 'ip'").collect()}
    assert got == {3: ("email", 100_003)}
    assert private_spans(docs).where("kind = 'ip'").count() == 12_500
    assert hashlib.sha256(b"").hexdigest() == span_report(docs).where("doc_id = 0").select(F.sha2(F.array_join(F.transform("spans", lambda s: s["kind"]), ","), 256)).first()[0]
