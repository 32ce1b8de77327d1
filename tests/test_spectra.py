import numpy as np

from tempofold.operators import evalstats


def test_one_transform_and_sums_over_runs_agree(spark):
    rng = np.random.default_rng(9)
    rows = [(k, i, float(v)) for k, n in (("a", 301), ("b", 64), ("c", 1), ("d", 2)) for i, v in enumerate(rng.normal(3, 1, n))]
    df = spark.createDataFrame(rows, "k string, idx long, v double").repartition(4)
    fast = {r.k: (r.low, r.high) for r in evalstats.band_power(df, ["k"], "v", 15.0).collect()}
    runs = {r.k: (r.low, r.high) for r in evalstats.band_power(df, ["k"], "v", 15.0, run=50, whole=60).collect()}
    assert fast.keys() == runs.keys() and all(np.allclose(fast[k], runs[k], rtol=1e-8, atol=1e-8) for k in fast)
    assert fast["c"] == (0.0, 0.0)
    x = np.array([v for k, _, v in rows if k == "a"])
    power, hz = np.abs(np.fft.rfft(x - x.mean())) ** 2, np.arange(151) * 15 / 301
    assert np.allclose(fast["a"], (power[1:][hz[1:] <= 3].sum(), power[hz >= 5].sum()))
