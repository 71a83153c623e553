from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    syllables = ["ka", "lo", "mi", "ter", "sun", "vor", "el", "ash", "ing", "po"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n: int = 120, seed: int = 1) -> list[tuple]:
    """Ordinary rows, and nulls in every column, empty and long texts, ties, copies, case variants, repeated rows."""
    rng = random.Random(seed)
    rows = [(i, "\n".join(sentence(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6))), "en", f"s{rng.choice([0, 0, 0, 1, 2, 3])}", 0) for i in range(n)]
    rows += [(n + i, rows[3][1], "en", "s0", 0) for i in range(30)]
    rows += [(n + 40, rows[4][1].upper(), "en", "s1", 0), (n + 41, None, None, None, None), (n + 42, "", "en", None, 0), (n + 43, " \n\t ", "en", "s1", 0)]
    rows += [(n + 44, sentence(rng, 6000), "en", "s2", 0), (None, sentence(rng, 20), "en", "s2", 0), (n + 45, "Ünïcode Ä ß 漢字 😀 don't", "de", "s3", 0)]
    rows += [(n + 46, rows[5][1], "en", "s0", 0)] * 2
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
