import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_words import WORDS, prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two", "de", None, 7), (4, "one two", "de", "b", 7), (5, "x" * 70_000, None, "b", 70_000), (6, "word " * 30_000, "en", "c", 150_000),
        (7, "the quick brown fox jumps over the lazy dog again and again", "en", "c", 59), (7, "the quick brown fox jumps over the lazy dog again and again", "en", "c", 59), (None, "no id here", None, None, None), (8, "  \n\t ", "fr", "d", 5),
        (9, "Ünïcödé 😀 ▁ text\u0000end <|endoftext|>", "fr", "d", 30), (10, "!!! ??? 123", "es", "d", 11),
    ]
    extra = "text_sha256 string, keep_id long, score double, host string, ids string, label int, c0 string, key string, `doc id` int"
    return spark.createDataFrame([(*r, "s", -1, 0.5, "h", "i", 3, "c", "k", 4) for r in rows], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def copies(spark):
    """Bases with near copies at all distances, exact copies, a passage that many share, and short texts."""
    r, rows = random.Random(3), []
    passage = prose("shared", 30)
    for b in range(12):
        base = prose(b, r.choice([6, 9, 20, 60, 150])).split()
        for e in range(8):
            w = list(base)
            for _ in range(e if len(w) > 30 else e // 3):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append(" ".join(w) + (" " + passage if b % 3 == 0 else ""))
        rows.append(rows[-1])
        rows.append(rows[-2].upper())
    rows += ["", None, "a b", "a b", "A  b", "one two three four five", "one two three four six"]
    return spark.createDataFrame([(i * 3 + 1, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(rows)], SCHEMA)
