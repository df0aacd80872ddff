"""Tables with everything awkward: nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, size string, key string, part int, words array<string>, kept boolean"


def words(text):
    return WORD.findall(text or "")


def sentence(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i * 17) % 9973}" for i in range(n))


def awkward_rows():
    shared = sentence(99, 60)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "b", 3),
        (None, sentence(5, 80), "fr", "b", 1), (6, sentence(6, 80) + "\n" + shared, "fr", None, 1), (7, shared + " " + sentence(7, 50), "de", "c", 1),
        (8, sentence(8, 400), "de", "c", 1), (8, sentence(8, 400), "de", "c", 1), (9, sentence(8, 400).replace("w8", "q8", 1), "de", "c", 1),
        (10, sentence(10, 30_000), "es", "d", 1), (11, "tie tie tie", "es", "d", 1), (12, "tie tie tie", "es", "d", 1),
        (13, sentence(13, 34), "en", "e", 1), (14, sentence(13, 34), "en", "e", 1), (15, sentence(15, 35), "en", "e", 1), (16, sentence(15, 35), "en", "", 1),
        (17, "ÄÖ é ñ   ß x " + shared.upper(), "de", "é", 1), (18, "x" * 5000, "en", "z", 1), (None, None, None, None, None),
        (19, " ".join(["same"] * 120), "en", "a", 1),
    ]
    return [(*r, 7, "s", "k", 3, ["w"], False) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
