"""Columns called as the operators' own, or as Spark calls a file's."""

import pytest

from tempofold.llm import common, exact, jaccard, merkle, tokenfile

NAMES = ("__place", "__gone", "__place_gone", "_metadata", "file", "row", "class_key", "key", "node", "salt")


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"one two three four five six {i // 2}", "src", "en", 5, *[f"{n} {i}" for n in NAMES]) for i in range(8)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)).repartition(2)


@pytest.mark.parametrize("stored", [False, True])
def test_rows_keep_their_columns_whatever_they_are_called(spark, clashing, tmp_path, stored):
    docs = clashing
    if stored:
        docs.write.parquet(f"{tmp_path}/d")
        docs = spark.read.parquet(f"{tmp_path}/d")
    for keep in (exact.keep, jaccard.keep):
        kept = keep(docs)
        assert kept.columns == docs.columns
        got = sorted(kept.collect(), key=lambda r: r.doc_id)
        assert [r.doc_id for r in got] == [0, 2, 4, 6]
        assert all(r[n] == f"{n} {r.doc_id}" for r in got for n in NAMES)
    assert common.located(docs).columns == ["doc_id", "text", "file", "row"]
    assert tokenfile.checksums(spark, tokenfile.write(docs, f"{tmp_path}/t")).count() == 8
    assert merkle.prove(docs).count() == 8
