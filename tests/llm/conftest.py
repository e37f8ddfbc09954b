import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, key string"


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(5)
    return ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """Nulls in every column, empty, blank and long texts, copies, near copies, repeated rows, extra columns with clashing names."""
    rnd = random.Random(9)

    def prose(n):
        return " ".join(rnd.choices(words, k=n))

    base, long = prose(80), "\n".join(prose(30) for _ in range(400))
    texts = [base, base, base.replace(" ", " ", 1) + " tail", " ".join(base.split()[:-3] + ["x", "y", "z"]), prose(60), "", None, " \n\t ", "one two", "one two", "Über die Straße\nnaïve 東京 😀", long, long[: len(long) // 2], "a" * 5000, "line\n" * 300, base + "\n" + prose(20)]
    rows = [(i + 1, t, "en", f"s{i % 4}" if i % 5 else None, len(t) if t else None, 0.5, 1, "k") for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None, None), (None, "lonely text of a few words", None, "s1", None, None, None, None), rows[4], rows[4], (5, "another text under the same id", "de", "s2", 1, 0.1, 2, "z")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
