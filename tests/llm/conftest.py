import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(start, n):
    return " ".join(WORDS[(start * 7 + i * i + i // 5) % len(WORDS)] + str((start + i) % 11) for i in range(n))


BASE = sentence(1, 90)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))

# Nulls in every column, empty and very long texts, ties, repeated rows, ids that repeat with another text.
ROWS = [
    (0, BASE, "en", "a", 1), (1, BASE.replace(" ", "\n"), "en", "b", 1), (2, BASE + " ending here", "en", "a", 1),
    (3, "", "en", None, 0), (4, None, None, "b", None), (5, " \t\n", "de", "c", 3), (6, LONG, "fr", "b", len(LONG)),
    (7, LONG, "fr", "b", len(LONG)), (8, "one two", "en", "a", 7), (8, "one two", "en", "a", 7), (9, "one two three", "en", "", 13),
    (9, sentence(5, 70), "en", "é", 1), (None, sentence(6, 80), "es", "a", 1), (None, "one two", "es", None, 7),
    (10, "no break　space, ÀÉ ß 你好 🙂 1d10t", "en", "z", 3), (11, sentence(7, 300) + "\n" + sentence(7, 300), "en", "a", 1),
    (12, "x", "en", "a", 1), (13, sentence(8, 200), "en", "a", 1),
]
CLASHING = "row digest node root size bucket kept _n _bucket start code copies n position key span anchor".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return list(ROWS)


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with the hard cases and extra columns whose names the operators use themselves."""
    extra = ", ".join(f"{c} string" for c in CLASHING)
    data = [(*r, *(f"{c}{i}" for c in CLASHING)) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(data, f"{SCHEMA}, {extra}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (2, 1, 1), (6, 1, 0), (8, 0, 1), (13, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
