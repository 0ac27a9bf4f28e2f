"""Rows that every operator must get through: nulls, blanks, ties, repeats, long
texts, and further columns with the names of results."""

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * k + k * seed) % len(WORDS)] + (str((k * seed) % 13) if k % 3 == 0 else "") for k in range(n))


ODD_ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, None, 4),
    (4, "one", "fr", "b", 3),
    (5, "Ünïcödé ÄÖ 日本語 text\x00with\x85odd blanks", "de", None, 10),
    (None, "row without id", "en", "a", 14),
    (None, None, None, None, None),
    (7, prose(7, 40), "en", "a", 1),
    (7, prose(7, 40), "en", "a", 1),
    (8, prose(7, 40), "en", "b", 1),
    (9, prose(9, 30000), "en", "c", 1),
    (10, "x" * 50000, "en", "c", 1),
    (11, prose(11, 5), "en", "a", 1),
    (11, prose(12, 60), "fr", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    names = ["score", "label", "id", "n", "size", "block", "bit", "component", "held", "h", "shard", "ids", "_id", "_text", "_runs", "epoch", "mix_id", "src", "start", "content", "marks", "seq", "digest", "key"]
    return odd.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
