"""Brute-force helpers for the training-data operators."""

import pytest

TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away from it all.",
    "THE QUICK brown fox jumps over the lazy dog and runs away from it all.",
    "",
    None,
    " \t\n ",
    "one two",
    "One\x0btwo",
    "<|endoftext|> mid<|endoftext|>",
    "naïve café – „Größe“ 12,5 % ½ ﬁ e\u0301 한국어 👩‍👩‍👧",
    "tab\x1cunit\x85next\u2028line\u3000wide",
    "it's I'LL we'd 've 12ab３",
    "x" * 5000,
    "word " * 3000,
]


@pytest.fixture(scope="session")
def texts():
    return list(TEXTS)


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with nulls, copies, a repeated row, a null id and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, i) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "alone", "en", "s1", 1), (99, "word " * 3000, "de", "s0", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slots int").cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
