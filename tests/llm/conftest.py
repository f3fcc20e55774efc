import random

import pytest

WORDS = "the of and to in is was for that with stone river bread light under over again never house green".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, tiny, very long, repeated and tied texts; null ids and languages; clashing extra columns."""
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) for _ in range(40_000))
    texts = [None, "", " \t\n", "a", "Ünïcödé 日本語 Σίσυφος <|endoftext|> it's", long, long + " x", "same text here", "same  text\there", "same text here", "line one\nline two\nline three\nline four"]
    texts += ["\n".join(" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(5)) for _ in range(12)]
    texts += texts[-3:]
    rows = [(i, t, None if i % 7 == 3 else ("en", "fr")[i % 2], f"src{i % 3}", i) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "same text here", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long").withColumnRenamed("source", "fp").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, kept long")
