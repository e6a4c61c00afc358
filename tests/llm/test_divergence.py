"""Source divergence against exact counting in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from partwright.llm import divergence
from partwright.llm.divergence import source_divergence, terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, ranks=50):
    """Rows of ``(lang, source, text)`` counted, shared and ranked one by one."""
    count, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        count[lang, source].update(found)
        held[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (n + 5 * v) for t in kept}

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        own = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(whole[t] - own[s][t], t.encode(), t) for t in kept if count[lang, s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, ranks)):
                out += [(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(sorted(items)[:most], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = {lang: ["".join(r.choice("abcdefgÀéß漢я") for _ in range(r.randint(1, 4))) for _ in range(90)] for lang in ("en", "de", "")}
    out = []
    for k in range(400):
        lang = r.choice(["en", "en", "de", None])
        source = r.choice(["hot", "hot", "b", "ü", "Z", None, ""])
        shift = sum(map(ord, source or "x")) % 40
        text = " ".join(r.choice(words[lang or ""][shift:]).upper() if r.random() < 0.2 else r.choice(words[lang or ""]) for _ in range(r.randint(0, 40)))
        out.append((lang, source, text if r.random() < 0.95 else None))
    return [*out, ("xx", "a", "1 2 3"), ("xx", "b", ""), ("yy", "one", "word")]


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(source_divergence(docs, least=5)) == brute(rows, 5)
    assert got(source_divergence(docs, least=5, ranks=3)) == brute(rows, 5, 3)


def test_terms_that_share_a_digest_are_told_apart(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for bits in (0, 3, 6):
        assert got(source_divergence(docs, least=7, digest_bits=bits)) == brute(rows, 7)


def test_counts_are_handed_on_in_shares(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert got(source_divergence(docs, least=5)) == brute(rows, 5)


def test_odd_tables(odd, none):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert got(source_divergence(odd, least=2)) == brute(rows, 2)
    assert source_divergence(none).count() == 0


def test_terms_and_large_counts(spark):
    assert terms("Ab1cÉ_漢字's [x]\x00Y z\x7f") == ["ab".encode(), "cÉ".encode(), "漢字".encode(), b"s", b"x", "y z".encode()]
    big = spark.range(1).selectExpr("cast(9e17 as long) as c", "cast(2e18 as long) as n", "cast(3 as long) as v")
    assert big.select(divergence._share(*[big[c] for c in "cnv"])).first()[0] == 1 + 10**9 * (9 * 10**17 + 5) // (2 * 10**18 + 15)
