import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, part string, score double"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def long_text(n, seed=1):
    return " ".join(f"{WORDS[(i * i + seed * i) % 12]}{(i * 7919 + seed) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, columns whose names clash."""
    texts = [None, "", " \t\n", "one", "two words", "three little words", long_text(40), long_text(30_000), long_text(40), "Ünï 日本語 😀 <|endoftext|> end.\n\nNew  section\x1f x"]
    texts.append(long_text(40).replace("alpha", "ALPHA"))
    rows = [(i, t, "en" if i % 2 else None, ("a", "b", None)[i % 3], None if t is None else len(t), 7, "r", "p", 0.5) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
