import re

import pytest

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "The quick brown fox jumps over lazy dogs. " * 8000
EXTRA = "kept boolean, score double, digest string, file string, row long, key string, part long, n long, first string, _held string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, white space, repeated rows and ids, a null id, a very long text and its copy."""
    return [(1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (1, "another text of the same id"), (2, None), (3, ""), (4, " \n\t "), (None, "a  b c d e f g h i j k l"), (None, None),
            (5, LONG), (6, LONG.replace(" ", "\n")), (7, "Größe ist ½ 漢字 😀."), (8, "\x00 !!"), (0, "a b\tc d e f g h i j k l")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    extra = [c.split()[0] for c in EXTRA.split(", ")]
    return spark.createDataFrame([(*r, "en", "src0", None, *[None] * len(extra)) for r in odd_rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
