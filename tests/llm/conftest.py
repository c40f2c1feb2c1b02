import pytest

LONG = " ".join(f"w{i}" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog by the river bank today.", "en", "a", 5),
    (2, "The quick brown fox jumps over the lazy dog by the river bank today.", "en", "a", 5),
    (2, "The quick brown fox jumps over the lazy dog by the river bank today.", "en", "a", 5),
    (3, None, "en", None, None), (4, "", None, "a", 0), (5, " \n\t", "de", "a", 3), (6, "12345 !!", "de", "a", 8),
    (None, "Ein ganz anderer Satz ohne Kennung, der trotzdem bleibt.", "de", "b", 9), (7, LONG, "xx", "b", 1), (8, "zwei Worte", "de", "b", 2),
    (9, "<|endoftext|> it's  3 o'clock now 日本語", "en", "b", 2),
]
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, dk int, component_id int, n int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named as the operators name theirs."""
    return spark.createDataFrame([(*r, "s", 1, 2, 3) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
