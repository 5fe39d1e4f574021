import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (0, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "a", 9, 1, "x"),
        (1, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "a", 9, 1, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "b", 0, 2, ""),
        (4, "\n\n \t", "fr", "b", 4, 2, "y"),
        (5, "word " * 20000, "en", "a", 100000, 3, "z"),
        (6, "x" * 50000, None, "a", 50000, 3, "z"),
        (7, "le chat est sur la table\nle chat est sur la table\nécole été", "fr", None, 60, 4, "w"),
        (8, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "c", 9, 1, "x"),
        (8, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "c", 9, 1, "x"),
        (9, "+1 (212) 555-0100 a@b.co 10.0.0.1 4111 1111 1111 1111 <|endoftext|>", "en", "c", 9, 1, "x"),
        (10, "token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" and 日本語のテキスト \U0001f600", None, "c", 9, 1, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, component string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
