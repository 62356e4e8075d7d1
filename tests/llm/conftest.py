import random

import pytest

#: Names that operators use for columns of their own, or add.
CLASHING = ["h", "n", "key", "id", "root", "found", "gone", "spans", "copy", "all", "base", "mark", "_doc", "_mark", "_spans", "_text", "_row", "lang_pred", "lang_score", "toxicity", "fingerprint", "ids", "bytes", "n_words", "n_tokens", "kept", "kept_text", "value", "range", "__others", "a.b", "first", "hash"]


@pytest.fixture(scope="session")
def clashing():
    return CLASHING


@pytest.fixture(scope="session")
def vocabulary():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def prose(vocabulary):
    """prose(seed, n): n random words."""
    return lambda seed, n: " ".join(random.Random(seed).choices(vocabulary, k=n))


@pytest.fixture(scope="session")
def odd_rows(prose):
    """(doc_id, text) of nulls, empty and blank texts, repeated rows and ids, and a very long text."""
    long = prose(1, 60_000)
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, prose(2, 120)), (5, prose(2, 120)), (6, prose(2, 120)), (7, prose(3, 130)), (7, prose(4, 140)), (None, prose(2, 120)), (None, None), (8, "x" * 200_000), (9, long), (10, long + " more"), (11, "Ünï çødé 文字 😀 " * 30), (12, "!!! ??? 123"), (13, "\x00 a\x0bb\x1fc d e")]


@pytest.fixture
def frame(spark):
    """frame(rows): a table (doc_id, text) in several partitions."""
    return lambda rows, parts=3: spark.createDataFrame(list(rows), "doc_id long, text string").repartition(parts)


@pytest.fixture
def with_clashes():
    """A frame with further columns of names that operators use."""
    from pyspark.sql import functions as F

    return lambda docs: docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING if c not in docs.columns))


@pytest.fixture
def own_columns():
    """Whether the further columns came through as they were, but for those that the operator replaces."""

    def check(out, but=()):
        rows = [r.asDict() for r in out.collect()]
        for r in rows:
            for c in CLASHING:
                if c not in but:
                    assert r[c] == f"own {c}", c
        return rows

    return check
