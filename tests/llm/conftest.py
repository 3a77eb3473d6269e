import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, gid int, fp long, rest string, bucket int, held_out string, score double, kept long, before string"


def prose(rng, n, words="the of and thing ando erst haon reth onth blere ingor estea while under over tion ment"):
    vocabulary = words.split()
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "s", "er", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near and exact copies, shared passages."""
    rng = random.Random(4)
    passage = prose(rng, 60)
    shared = prose(rng, 25)
    texts = {i: prose(rng, rng.randint(1, 120)) for i in range(0, 400, 7)}
    texts |= {1: None, 2: "", 3: "   \n\t ", 4: "12345 !!!", 5: "é" * 49, 6: "a" * 5000, 8: "x", 9: passage, 10: passage, 11: passage + " tail one", 12: "head two " + passage}
    texts |= {13: shared + ". " + prose(rng, 90), 15: prose(rng, 30) + "\n" + shared, 16: shared + "\n" + shared, 17: prose(rng, 9000), 18: "日本語のテキスト。" * 30, 19: "日本語のテキスト。" * 31}
    texts |= {20: "mail ana.b@mail1.example.com or +1 (555) 555-0101, 10.0.0.255 and 4111 1111 1111 1111", 22: "<|endoftext|> it's they'll 'tis x  \n", 23: "\0nul\0", 24: "and the AND The and the and"}
    long = prose(rng, 120).split()
    texts |= {30: " ".join(long), 31: " ".join([*long[:60], "changed", *long[61:]]), 32: " ".join(long).upper()}
    rows = [(i, t, "en" if i % 3 else None, "src0", None if t is None else len(t)) for i, t in texts.items()]
    rows += [(40, "tie one " + passage, "en", None, None), (40, "tie two " + shared, "fr", "s", 1), (None, prose(rng, 40), "en", "s", 2), (None, None, None, None, None)]
    rows += [rows[-2], rows[5], rows[5], (50, rows[5][1], "en", "s", 3)]
    return [(*r, 1, 2, "r", 3, "h", 0.5, 4, "b") for r in rows]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small(spark):
    """The driver's smallest table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
