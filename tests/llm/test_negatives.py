import numpy as np
import pytest
from pyspark.sql import functions as F

from tempofold.llm import negatives

from .conftest import SF

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, moved=True):
    """rows: (vec_id, embedding, label)."""
    kept = [(i, np.floor(256 * np.asarray(v, float)).astype(object), (lab + 1) % 10 if moved and i % 7 == 0 else lab) for i, v, lab in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, va, la in kept:
        if a % 50:
            continue
        ranked = sorted((-int(va @ v), i, lab) for i, v, lab in kept if i != a)
        for neg, p, _ in [r for r in ranked if r[2] == la][:5]:
            window = [(n, i) for n, i, lab in ranked if lab != la and 50 * -neg <= 100 * -n <= 95 * -neg]
            out += [(a, p, k + 1, i, -neg, -n) for k, (n, i) in enumerate(window[:3])]
    return sorted(out)


def query(spark, table, tmp_path, name="t"):
    table.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return sorted(tuple(r) for r in negatives.op12_hard_negatives(spark, f"{tmp_path}/{name}").select(*COLUMNS).collect())


def test_registered_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in negatives.op12_hard_negatives(spark, SF).select(*COLUMNS).collect())
    assert got == brute(rows) and got


def clustered(n, dim, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    near = rng.integers(0, 8, n)
    points = centres[near] + spread * rng.normal(size=(n, dim))
    points /= np.linalg.norm(points, axis=1)[:, None]
    return [(int(i), p.astype("f4").tolist(), int(c + (rng.random() < 0.3)) % 10) for i, (p, c) in enumerate(zip(points, near))]


def test_several_rounds_and_chunks(spark, tmp_path, monkeypatch):
    for name, value in (("FIRST_ROWS", 40), ("GROWTH", 3), ("BLOCK", 4)):
        monkeypatch.setattr(negatives, name, value)
    monkeypatch.setattr(negatives.Index.__init__, "__defaults__", (20, 16, 300))
    rows = clustered(900, 12, 3)
    assert query(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), tmp_path) == brute(rows)


def test_clusters_are_pruned(spark):
    rows = clustered(3_000, 16, 5, 0.05)
    index = negatives.Index(negatives.rows_of(spark.createDataFrame(rows, SCHEMA)), cell_rows=30)
    plan = list(index.rows.where("vec_id % 50 = 0").select(F.col("pos").alias("q"), "vec_id", "label", F.lit(True).alias("same"), F.lit(negatives.LOWEST).alias("lo"), F.lit(negatives.HIGHEST).alias("hi"), "vec",
                                   F.lit(0).alias("taken"), F.array(*[F.struct(F.lit(-50_000).cast("long").alias("neg"), F.lit(1).cast("long").alias("id"))] * 5).alias("best")).toArrow().to_batches())
    cells = [len(c) for b in negatives._planned(iter(plan), index.books, index.radii, index.counts, index.kind, 10**9, 5) for c in b.column("cells").to_pylist()]
    assert np.mean(cells) < 0.5 * np.count_nonzero(index.counts)


def test_heap_visits_every_cell_once_in_order():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (1, 6), (7, 1), (5, 8)):
        upper = rng.integers(-4, 5, shape[0]).astype(float), rng.integers(-4, 5, shape[1]).astype(float)
        seen = list(negatives.visits(upper))
        assert len({(i, j) for _, i, j in seen}) == len(seen) == shape[0] * shape[1]
        assert all(b == upper[0][i] + upper[1][j] for b, i, j in seen) and all(x >= y for (x, *_), (y, *_) in zip(seen, seen[1:]))


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(rng.choice([-0.5, 0.0, 0.25, 0.5], size=(160, 4)))]  # many ties
    rows += [(200, [0.5, 0.5, 0.5, 0.5], 1)] * 30 + [(i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(201, 320)]  # repeated ids and copies
    bad = [(350, None, 1), (400, [nan, 0.0, 0.0, 0.0], 1), (401, [inf, 1.0, 1.0, 1.0], 1), (402, [1.0, None, 0.0, 0.0], 2), (403, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1)]
    extra = [(*r, None, "x") for r in rows + bad + [(450, [1.0, 1.0], 1), (451, [], 1)]]
    table = spark.createDataFrame(extra, f"{SCHEMA}, pos long, cell string").repartition(4)
    assert query(spark, table, tmp_path) == brute(rows + bad)
    assert query(spark, spark.createDataFrame([], SCHEMA), tmp_path, "none") == []
    assert query(spark, spark.createDataFrame([(50, [1.0], 1)], SCHEMA), tmp_path, "one") == []
    assert query(spark, spark.createDataFrame([(50, [], 1), (51, [], 1), (52, [], 2)], SCHEMA), tmp_path, "flat") == brute([(50, [], 1), (51, [], 1), (52, [], 2)])


@pytest.mark.parametrize("scale", [30.0, 1e6])
def test_large_components(spark, tmp_path, scale):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(scale * v)], int(i % 4)) for i, v in enumerate(rng.normal(size=(150, 6)))]
    assert query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tmp_path) == brute(rows)


def test_products_beyond_a_long_are_refused(spark):
    with pytest.raises(ValueError):
        negatives.Index(negatives.rows_of(spark.createDataFrame([(1, [1e12, 1.0], 1)], "vec_id long, embedding array<double>, label int")))
