import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows ``(doc_id, text[, lang[, source]])`` as documents."""

    def make(rows, parts=3):
        full = [(*r, *[None] * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DDL).repartition(parts)

    return make


@pytest.fixture(scope="session")
def clashing(frame):
    """Documents with extra columns named like working columns of the operators."""

    def make(rows):
        from pyspark.sql import functions as F

        names = "row size target taken copies shuffle bucket skey digest content salt kept lines keys dropped text_key spans hits_email fingerprint turn stretches node key a b found learned"
        return frame(rows).withColumns({c: F.lit(c) for c in names.split()})

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented texts: ``prose(seed, words)``."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 8))) for _ in range(n))

    return make


ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", None, "a"),
    (None, "no id here at all", "en", None),
    (None, None, None, None),
    (5, "same row twice with some words", "en", "b"),
    (5, "same row twice with some words", "en", "b"),
    (6, "long " * 30000, "en", "b"),
    (7, "émile Ünïcode 𝒳𝒴 ﬁne\r\nline", "fr", "c"),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
