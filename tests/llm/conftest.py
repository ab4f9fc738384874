import pytest
from corpusdeck.llm.shipping import ship


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


#: Documents with every awkward case: nulls, no words, repeats, ties, columns with clashing names.
DOCS = "doc_id long, text string, block string, node long, `row` string, `a b` int"


@pytest.fixture(scope="session")
def odd(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, base, "x", 1, "r", 1),
        (2, base, None, None, None, None),
        (2, base, None, None, None, None),
        (3, "", "x", 2, "r", 1),
        (4, None, "x", 2, "r", 1),
        (None, base, "x", 2, "r", 1),
        (None, None, None, None, None, None),
        (5, " \t\n ", "x", 2, "r", 1),
        (6, "one two", "x", 2, "r", 1),
        (7, "one two", "x", 2, "r", 1),
        (8, "long " * 40_000 + base, "x", 2, "r", 1),
        (8, "same id, other text", "x", 2, "r", 1),
        (9, base.replace("w59", "other"), "x", 2, "r", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
