"""Slice kernels against plain pandas, with one key holding most rows and slices of a few rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempofold.operators import ordered, series
from tempofold.operators.quantiles import exact_quantiles

RUN = 4


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 300
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    t = np.sort(rng.random(n) * 1000)
    x = np.where(rng.random(n) < 0.3, np.nan, np.round(rng.normal(size=n), 3))
    return pd.DataFrame({"id": np.arange(n), "key": key, "t": t, "x": x})


@pytest.fixture(scope="module")
def df(spark, pdf):
    rows = [(int(i), k, float(t), None if np.isnan(x) else float(x)) for i, k, t, x in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "id bigint, key string, t double, x double").repartition(3)


def test_dense_index_counts_from_zero_in_every_key(df, pdf):
    got = ordered.dense_index(df, ["key"], ["t", "id"], ordered.time_bucket("t", 7.0), size="n").toPandas().set_index("id").sort_index()
    want = pdf.groupby("key").cumcount()
    assert (got["idx"] == want).all()
    assert (got["n"] == pdf.groupby("key")["id"].transform("size")).all()


@pytest.mark.parametrize("ahead,strict", [(False, False), (True, False), (False, True), (True, True)])
def test_carry_last_matches_fill(df, pdf, ahead, strict):
    got = ordered.carry_last(df, ["key"], ["t", "id"], ordered.time_bucket("t", 5.0), {"y": F.col("x")}, ahead=ahead, strict=strict)
    got = got.toPandas().set_index("id").sort_index()["y"]
    g = pdf.groupby("key")["x"]
    want = g.bfill() if ahead else g.ffill()
    if strict:
        want = want.groupby(pdf["key"]).shift(-1 if ahead else 1)
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy())


def test_running_sum(df, pdf):
    got = ordered.running_sum(df, ["key"], ["t", "id"], ordered.time_bucket("t", 9.0), {"s": F.coalesce("x", F.lit(0.0))})
    got = got.toPandas().set_index("id").sort_index()["s"]
    np.testing.assert_allclose(got, pdf["x"].fillna(0).groupby(pdf["key"]).cumsum(), atol=1e-9)


def test_row_frames_see_over_run_edges(df, pdf):
    x = ordered.dense_index(df.withColumn("x", F.coalesce("x", F.lit(0.0))), ["key"], ["t", "id"], ordered.time_bucket("t", 11.0))
    got = ordered.row_frames(x, ["key"], 2, lambda f: {"m": F.max("x").over(f(-2, 2)), "p": F.lag("x", 2).over(f(None, None))}, run=RUN)
    got = got.toPandas().set_index("id").sort_index()
    assert len(got) == len(pdf)
    g = pdf["x"].fillna(0).groupby(pdf["key"])
    np.testing.assert_allclose(got["m"], g.transform(lambda s: s.rolling(5, center=True, min_periods=1).max()))
    np.testing.assert_allclose(got["p"].to_numpy(dtype=float), g.shift(2).to_numpy())


def test_time_frames_count_neighbours_in_seconds(df, pdf):
    got = ordered.time_frames(df, ["key"], "t", 15.0, 20.0, lambda f: {"n": F.count("*").over(f(-15.0, 15.0))}).toPandas().set_index("id").sort_index()["n"]
    want = [((pdf["key"] == k) & ((pdf["t"] - t).abs() <= 15.0)).sum() for k, t in zip(pdf["key"], pdf["t"])]
    assert (got.to_numpy() == np.array(want)).all()


def test_asof_prefers_equal_times_and_last_tie(spark):
    left = spark.createDataFrame([("k", 1.0, 1), ("k", 0.5, 2), ("k", 9.0, 3), ("z", 1.0, 4)], "key string, t double, id int")
    right = spark.createDataFrame([("k", 1.0, "a", 1), ("k", 1.0, "b", 2), ("k", 5.0, "c", 3)], "key string, t double, v string, n int")
    hit = {r.id: r.hit.v if r.hit else None for r in ordered.asof(left, right, ["key"], "t", ["v"], 2.0, tie=["n"]).collect()}
    assert hit == {1: "b", 2: None, 3: "c", 4: None}
    strict = {r.id: r.hit.v if r.hit else None for r in ordered.asof(left, right, ["key"], "t", ["v"], 2.0, ahead=True, allow_equal=False, tie=["n"]).collect()}
    assert strict == {1: "c", 2: "a", 3: None, 4: None}


def test_exact_quantiles_match_numpy_with_ties_and_signs(spark):
    rng = np.random.default_rng(5)
    data = {"many": np.round(rng.normal(size=500) * 100, 1), "same": np.full(50, 2.5), "one": np.array([-7.0]), "pair": np.array([0.0, 10.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    qs = {"lo": 0.05, "mid": 0.5, "hi": 0.9}
    out = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", qs, count="n").collect()
    assert {r.k for r in out} == set(data)
    for r in out:
        np.testing.assert_allclose([r.lo, r.mid, r.hi], np.percentile(data[r.k], [5, 50, 90]), atol=1e-9)
        assert r.n == len(data[r.k])


def test_band_pairs_meet_once(spark):
    a = spark.createDataFrame([("k", float(i) / 3) for i in range(30)], "k string, a double")
    b = spark.createDataFrame([("k", float(i) / 4) for i in range(40)], "k string, b double")
    got = sorted((r.a, r.b) for r in ordered.band_pairs(a, b, ["k"], "a", "b", 0.4, 0.4).collect())
    want = sorted((i / 3, j / 4) for i in range(30) for j in range(40) if abs(i / 3 - j / 4) <= 0.4)
    assert got == want


def test_gradient_matches_numpy(spark):
    t = np.array([0.0, 0.1, 0.35, 0.4, 1.0])
    x = np.array([1.0, 3.0, 2.0, 5.0, 4.0])
    df = spark.createDataFrame([("k", int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(t, x))], "key string, idx bigint, t double, x double")
    got = [r.g for r in series.gradient(df, ["key"], "t", {"g": "x"}).orderBy("idx").collect()]
    np.testing.assert_allclose(got, np.gradient(x, t))


def test_moving_average_repeats_edges(spark):
    x = np.array([1.0, 4.0, 2.0, 8.0, 5.0])
    df = spark.createDataFrame([("k", int(i), 5, float(v)) for i, v in enumerate(x)], "key string, idx bigint, n int, x double")
    got = [r.smooth for r in series.moving_average(df, ["key"], "x", 3).orderBy("idx").collect()]
    pad = np.concatenate([np.repeat(x[:1], 3), x, np.repeat(x[-1:], 3)])
    np.testing.assert_allclose(got, [pad[i:i + 7].mean() for i in range(5)])


def test_idle_spans_known_case(spark):
    why = ["walking", "walking", None, "walking", None, None, None, "still", "still", None, None, "no music"]
    df = spark.createDataFrame([("k", i, 12, float(i), float(i + 1), w) for i, w in enumerate(why)], "key string, idx bigint, n int, t0 double, t1 double, why string")
    got = {r.kind: (r.t0, r.t1) for r in series.idle_spans(df, ["key"]).collect()}
    assert got == {"lead-in": (0.0, 4.0), "outro": (11.0, 12.0)}
