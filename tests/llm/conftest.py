import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept boolean, cls long, family int, pos int, score double, lang_pred string, first long, size long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns that operators use names of."""
    long = "wort und satz. " * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
        (3, None, "en"),
        (4, "", None),
        (5, " \n\t", "de"),
        (6, long, "de"),
        (7, long + "x", "de"),
        (8, "Der schnelle braune Fuchs springt \U0001f98a über den faulen Hund <|endoftext|> é", "de"),
        (9, "ab", "en"),
        (10, "ab", None),
        (None, "ab", "en"),
        (None, None, None),
        (11, "1234 !!", "en"),
        (12, "THE QUICK brown fox jumps over the lazy dog near the river bank tonight", "en"),
        (-5, "\\[x] </s> ▁ a\x00b", "en"),
    ]
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), "d", False, 1, 2, 3, 0.5, "p", 4, 5) for i, t, g in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
