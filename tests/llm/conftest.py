import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and very long texts, ties, repeated rows and further columns with clashing names."""
    base = "alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    shared = "This line is shared by several documents."
    rows = [
        (1, f"{base}\n{shared}\nshort", "en", "a", 70), (2, f"{base}\n{shared}\nshort", "en", "a", None), (2, f"{base}\n{shared}\nshort", "en", "a", None),
        (3, "", None, None, 0), (4, None, None, "b", None), (5, "word", "en", "b", 4), (6, "word", "en", None, 4), (None, f"other\n{shared}", "en", "b", 9),
        (7, " THIS line is shared by several documents.\t\nmail a.b@c.de and +1 (017) 555-7713, 10.0.0.255", "de", "c", 80),
        (8, "漢字 и ещё 🙂 " * 3, "xx", "c", 30), (9, "x " * 40_000 + "end", "en", "a", 80_003), (10, "\n\n\n", "en", "c", 3), (3, "a second text under a repeated id, of some length", "en", "a", 49),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["pos", "line", "key", "size", "score", "row", "part", "value", "copies", "length", "bucket", "start"]
    return df.selectExpr("*", *[f"'clash' as {n}" for n in names])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
