import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, did string, th int, size string"


def row(doc_id, text, source="a"):
    """Extra columns carry names that operators use inside."""
    return (doc_id, text, "en", source, 7, 0.5, 3, "x", 1, "y")


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, empty, short, long, equal and nearly equal texts, repeated rows and ids, many scripts and kinds of white space."""
    rnd = random.Random(6)
    text = [" ".join(rnd.choices(words, k=rnd.randint(25, 120))) for _ in range(20)]
    rows = [row(i, t, rnd.choice(["a", "b", None])) for i, t in enumerate(text)]
    rows += [row(20, None), row(21, ""), row(22, " \t\n"), row(23, "one"), row(24, "ONE"), row(25, "one two three")]
    rows += [row(30, text[0]), row(31, text[0]), row(32, text[0] + " tail"), row(33, "lead " + text[3])]
    rows += [row(40, text[5]), row(40, text[5]), row(41, text[6]), row(41, text[7])]
    rows += [row(50, "again and again " * 60), row(51, "x" * 5000), row(52, "é ß 日本 " * 40), row(53, "é ß 日本 " * 40)]
    rows += [row(None, text[8]), row(None, None), row(60, " ".join(rnd.choices(words, k=20000)))]
    rows += [row(61, "mail a.b@c.example.org or +1 (415) 555-0100, 10.0.0.1 and 4111 1111 1111 1111"), row(62, "zz@@ 1.2.3.999 +12")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
