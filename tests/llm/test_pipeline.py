import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tempofold.llm import QUERIES, common

from .conftest import SF, shingle_set
from .test_decontam import brute as hits
from .test_exact import brute as classes


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, common.written(stage(spark, docs, SF), "t-stage")
        seen.append((before, docs))
        assert k == 4 or docs.columns == names
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = map(rows, seen[0])
    gone = before.keys() - after.keys()
    assert all(labels.get(i, 1) for i in gone) and sum(labels.get(i, 0) for i in after) <= 2
    before, after = map(rows, seen[1])
    assert after.keys() == {i for i, keep, _, _ in classes(list(before.items())) if i == keep}
    before, after = map(rows, seen[2])
    sets = {i: shingle_set(t) for i, t in before.items()}
    near = lambda a, b: sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert not any(near(a, b) for a in after for b in after if a < b)
    assert all(any(near(a, b) for b in before if b < a) for a in before.keys() - after.keys())
    before, after = map(rows, seen[3])
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert after.keys() == {i for i, _, n, _ in hits(list(before.items()), bench) if not n}
    assert {r.doc_id for r in seen[4][1].select("doc_id").distinct().collect()} == after.keys()


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows_and_none(spark, odd, none, k):
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, odd, SF)
    assert 0 < out.count() and (k == 4 or out.columns == odd.columns)
    assert stage(spark, none, SF).count() == 0
    assert stage(spark, odd.select("*", F.lit(1).alias("template")), SF).count() == out.count()
