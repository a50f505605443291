import pytest

WORDS = ["tion", "the", "Ont", "hashe", "érie", "über", "ñas", "it's", "x1", "blent", "oring", "eanst", "re", "wher", "lyest"]


def prose(rng, n):
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + rng.choice(WORDS) * rng.randrange(2))
        out.append(rng.choice([" ", " ", " ", " ", ". ", ", ", ".\n", "\n\n", "  "]))
    return "".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text, source, and columns whose names the operators use themselves: nulls, empty and long texts, ties, repeated rows."""
    import random

    rng = random.Random(5)
    base = prose(rng, 300)
    texts = [
        (None, "no id here " * 20, "a"), (None, None, None), (1, None, "a"), (2, "", "b"), (3, base, "a"), (3, base, "a"), (4, base, None), (5, base + " one more end", "a"),
        (6, prose(rng, 40_000), "b"), (7, "z" * 3000, "b"), (8, "<|endoftext|> a <|endoftext|>b", "b"), (9, " \n\t \n", "b"), (10, "two words", "a"), (11, "two words", "c"), (12, "## %% && $$ " * 60, "c"), (-5, "Σίσυφος ΟΔΟΣ 中文 ½ é 😀 \x1c\x85", "c"),
    ]
    return [(i, t, s, 7, "x", 1.5) for i, t, s in texts + [(100 + k, prose(rng, 80 + k), "d") for k in range(25)]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string, source string, length int, `__text` string, n_words double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
