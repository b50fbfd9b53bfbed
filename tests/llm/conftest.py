import random

import pytest

WORDS = "the of and cat dog tree river stone house light wind water fire earth green blue red old new small great wolf bird fish bread".split()


def make_rows():
    rng = random.Random(4)
    rows = []
    for i in range(120):
        text = "\n".join(" ".join(rng.choice(WORDS) + rng.choice(["", "x", "y", "z", "q"]) for _ in range(rng.randint(3, 14))) + "." for _ in range(rng.randint(1, 12)))
        rows.append((i, text, f"s{i % 4}", "en"))
    base = " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(200))
    words = base.split()
    for i in range(120, 150):  # near copies
        w = list(words)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 999))
        rows.append((i, " ".join(w), "s0", "en"))
    for i in range(150, 180):  # copies that differ in case
        rows.append((i, rows[3][1].upper() if i % 2 else rows[3][1], "s0", "de"))
    for i in range(180, 195):  # a line that many documents share
        rows.append((i, rows[i - 180][1] + "\n  Shared Line OF many  \nown " + str(i), "s1", "fr"))
    rows += [(200, None, None, None), (201, "", "s1", "en"), (202, " \t\n\n ", "s2", "en"), (203, "word", "s2", "en"), (204, "Wörd ÉÀ \U0001F600 \x1c x", None, "fr")]
    rows += [(205, " ".join(rng.choice(WORDS) for _ in range(30000)), "s3", "en"), (206, "a" * 100000, "s3", "en")]
    rows += [(207, "same row twice here", "s2", "en"), (207, "same row twice here", "s2", "en")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with null, empty, long, equal and repeated rows, and columns whose names clash with the operators' own."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    extra = "'x' AS key", "1 AS n", "'y' AS digest", "2 AS size", "true AS kept", "'z' AS block", "0.5D AS score", "3 AS label"
    return frame.selectExpr("*", *extra).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id < 0")
