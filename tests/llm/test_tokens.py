"""Token counts of prefixes, pieces, packing."""

import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest

from partwright.llm.packing import pack, plan_rounds
from partwright.llm.tokens import prefix_counts, token_counts, token_pieces, vocabulary as loaded

ODD = ["'", "'re", "'s", "ll", " ", "  ", "\n", "\t", "a", "the", "ing", "Ab", "9", "12", "²", "é", "ß", "漢", "字", "🙂", "\xa0", " ", "_", "-", "!!", "<|endoftext|>", "<|endof", "é", "ſ", "\x1c", "\x85", "'v", "Ж", "१", "\r\n", "​"]


def test_every_prefix_has_the_library_count(vocabulary):
    v, r = loaded(vocabulary), random.Random(9)
    count = lambda t: len(v.library.encode(t, add_special_tokens=False).ids)
    for _ in range(300):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 12)))
        assert list(prefix_counts(v.prefix_steps(text))) == [count(text[: i + 1]) for i in range(len(text))], text
        assert v.ids(text) == np.array(v.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_unambiguous_characters_split_as_in_the_library(vocabulary):
    v = loaded(vocabulary)
    for c in map(chr, range(1, 0x250)):
        for text in (f"a{c}b", f" {c}9{c}", f"{c * 3} x"):
            assert v.ids(text) == np.array(v.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text
            assert v._split(text) == [text[a:b] for _, (a, b) in v.library.pre_tokenizer.pre_tokenize_str(text)], text


def test_counts_of_odd_tables(odd, none, vocabulary):
    lib = loaded(vocabulary).library
    got = token_counts(odd, vocabulary, budget=5, with_steps=True).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()]
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=str) == sorted(want, key=str)
    for r in got:
        counts = prefix_counts(bytes(r.steps))
        assert r.n_tokens == (counts[-1] if len(counts) else 0)
        assert r.budget_chars == max([i + 1 for i, n in enumerate(counts) if n <= 5], default=0)
    assert token_counts(none, vocabulary).count() == 0


def check_packed(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def best_fit_decreasing(lengths, capacity):
    gaps, made = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        made += at == len(gaps) and gap == capacity
        insort(gaps, gap - length)
    return len(gaps)


def test_pieces_and_packing_of_odd_tables(odd, none, vocabulary):
    lib = loaded(vocabulary).library
    pieces = token_pieces(odd, vocabulary, capacity=64)
    packed = pack(pieces, capacity=64).collect()
    ids = {(r.doc_id, r.text): lib.encode(r.text or "", add_special_tokens=False).ids + [0] for r in odd.collect()}
    want = []
    for r in odd.collect():
        own, at, piece = ids[r.doc_id, r.text], 0, 0
        size = len(own) % 64 or min(len(own), 64)
        while at < len(own):
            part = own[at : at + size]
            want.append((r.doc_id, piece, at, size, zlib.crc32(np.array(part, dtype="<u4").tobytes())))
            at, size, piece = at + size, 64, piece + 1
    assert sorted([tuple(r)[:5] for r in packed], key=str) == sorted(want, key=str)
    assert check_packed(packed, 64) == best_fit_decreasing([w[3] for w in want], 64)
    assert pack(token_pieces(none, vocabulary), capacity=64).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_rounds_equal_best_fit_item_by_item(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 30) for _ in range(r.randint(1, 400))] + [7] * r.randint(0, 300)
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    plan = plan_rounds(dict(counts), 30)
    assert len({row[4] + k // row[3] for row in plan for k in range(row[2])}) == best_fit_decreasing(lengths, 30)
    for length, n in counts.items():
        ranks = sorted(k for row in plan if row[0] == length for k in range(row[1], row[1] + row[2]))
        assert ranks == list(range(n))


def test_lengths_out_of_range_raise(spark):
    bad = spark.createDataFrame([(1, 0, 0)], "doc_id long, piece int, length long")
    with pytest.raises(Exception, match="1 to 2048"):
        pack(bad).collect()
