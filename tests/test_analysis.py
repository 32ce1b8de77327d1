import math

from pyspark.sql import functions as F

from tempofold.operators import analysis, motion


def _span(spark, whys, first=0, gap=()):
    rows = [("k", c, w) for c, w in enumerate(whys, first) if c not in gap]
    span, idle = analysis.dance_span(spark.createDataFrame(rows, "key string, c long, why string"), "key")
    return tuple(span.select("q_start", "q_end").first()), {(r["from"], r["to"], r.kind) for r in idle.collect()}


def test_where_the_dance_is(spark):
    idle = ["not in frame"] * 2 + [None] + ["walking"]
    dance = [None, None, "still", None, None, None, None]
    assert _span(spark, idle + dance + ["walking", "no music"]) == ((16, 44), {(0, 4, "lead-in"), (11, 13, "outro")})
    assert _span(spark, ["still"] + dance) == ((0, 32), set())  # one still count at an edge is no walk-in
    assert _span(spark, ["still"] * 6) == ((0, 24), {(0, 6, "lead-in")})  # idle throughout: kept whole
    assert _span(spark, ["no music", "no music", None, None], first=-2)[0] == (0, 8)
    # Counts without samples are no rows; the dance begins at the first count after the lead-in.
    assert _span(spark, ["no music", "no music", "no music", None, None], gap=(2,))[0] == (12, 20)


def test_levels_nest_and_describe_their_samples(spark):
    rows = []
    for clip, spc in (("a", 0.5), ("b", 0.8)):
        for i in range(600):
            t = i / 30
            beat = t / spc
            rows.append((clip, t, not 4 < t < 4.2, 1.1 + math.sin(2 * math.pi * beat / 2), 1.0 + math.cos(beat), 0.2, 1.0, math.sin(beat), math.cos(beat * 1.3)))
    samples = spark.createDataFrame(rows, "key string, t double, ok boolean, energy double, limb double, root double, music double, vx double, vy double")
    grids = spark.createDataFrame([("a", 0.1, 0.5, 120.0), ("b", 0.0, 0.8, 75.0)], "key string, one double, spc double, bpm double")
    fast = spark.createDataFrame([("a", q) for q in range(9, 60, 4)], "key string, q long")
    steps, idle = analysis.analyse(samples, grids, "key", ["vx", "vy"], fast=fast, width_s=1.0)
    got = [r.asDict() for r in steps.collect()]
    by = {(r["key"], r["level"], r["step"]): r for r in got}
    names = list(motion.LEVELS)
    for r in got:
        spc, one = {"a": (0.5, 0.1), "b": (0.8, 0.0)}[r["key"]]
        assert math.isclose(r["ta"], one + r["a"] * spc / 4) and r["a"] < r["b"]
        inside = [x for x in rows if x[0] == r["key"] and r["ta"] - 1e-9 <= x[1] <= r["tb"] + 1e-9]
        assert abs(r["samples"] - len(inside)) <= 1  # an edge may lie within rounding of a sample
        if r["level"] == names[0]:
            assert r["parent"] is None
        else:
            up = by[r["key"], names[names.index(r["level"]) - 1], r["parent"]]
            assert up["a"] <= r["a"] and r["b"] <= up["b"] and up["chunk"] == r["chunk"]
    for key in "ab":
        for level in names:
            run = sorted((r["a"], r["b"]) for r in got if r["key"] == key and r["level"] == level)
            assert all(x[1] == y[0] for x, y in zip(run, run[1:])) and len(run) >= 1
    # Sub-beat cuts need evidence there; clip b has none.
    assert not any(r["sub_beat"] for r in got if r["key"] == "b")
    assert len({(r["key"], r["level"]) for r in got}) == 6


def test_lock_tells_a_beat_from_noise(spark):
    rows = [("on", i / 30, True, 2 + math.sin(2 * math.pi * i / 30 / 0.5)) for i in range(300)] + [("off", i / 30, True, 2 + math.sin(2 * math.pi * i / 30 / 0.77)) for i in range(300)] + [("flat", i / 30, True, 2.0) for i in range(300)]
    s = spark.createDataFrame(rows, "key string, t double, ok boolean, limb double")
    mean = {r.key: r["m"] for r in motion.beat_lock(s, "key", F.lit(0.0), F.lit(0.5)).groupBy("key").agg(F.avg("lock").alias("m")).collect()}
    assert mean["on"] > 0.9 and mean["off"] < 0.5 and mean["flat"] == 0.0
