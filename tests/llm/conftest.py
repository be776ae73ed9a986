import random

import pytest

WORDS = "the and tion ering of onth that with hean ser lo mi ka tu ver ne ro pa qui est dor lum fen gas".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every awkward case: nulls, empty and long texts, copies, repeated rows, clashing column names."""
    base, other = prose(1, 120), prose(2, 90)
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (1, base, "a"), (2, base, "b"), (3, " ".join(edited), "c"), (4, other, None), (5, None, "e"), (6, "", "f"), (7, "   ", "g"),
        (8, "one two", "h"), (9, "One\tTWO", "i"), (10, other + " " + prose(3, 2), "j"), (10, other + " " + prose(3, 2), "j"),
        (None, prose(4, 40), "k"), (12, prose(5, 30_000), "l"), (13, "same line that is long enough\nshort\n" + prose(6, 20), "m"),
        (14, prose(7, 15) + "\nSame line that is long enough \nshort", "n"), (15, "üñí çödé " * 12, "o"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, root string")
    return df.withColumn("kept", df["root"]).withColumn("n_removed", df["root"])


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")
