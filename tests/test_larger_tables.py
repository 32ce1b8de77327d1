"""Cases that the queries got wrong on larger tables, each as small as shows the fault."""

import datetime as dt
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tempofold import session
from tempofold.catalogue import QUERIES
from tempofold.operators import analysis, evalstats, events, identity, motion, ordered, quantiles, retention, series
from tempofold.plans import check


def test_null_distribution_joins_no_replayed_rows(spark):
    grids = spark.createDataFrame([("a", 0.0, 4.0), ("b", 0.0, 4.0)], "key string, one double, spc double")
    # In every count three hits a second apart, onsets at all positions in key a only.
    hits = spark.createDataFrame([(k, 4.0 * c + j) for k in "ab" for c in range(20) for j in range(3)], "key string, t double")
    onsets = spark.createDataFrame([("a", 4.0 * c + j) for c in range(30) for j in range(4)] + [("b", 1.0)], "key string, t double")
    out = evalstats.null_distribution(grids, hits, onsets, "key", "t", 0.5, replicates=50, tol_frac=1 / 8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell" not in plan  # the replayed rows themselves met the positions, or were broadcast to them

    def brute(key):
        counts = []
        ons = [r.t for r in onsets.collect() if r.key == key]
        hs = [r.t for r in hits.collect() if r.key == key]
        for r in range(1, 51):
            moved = [t + (0.1 + 0.8 * (r * 0.6180339887498949 % 1.0)) * 4.0 for t in hs]
            n = 0
            for c in range(-1, 32):
                near = lambda marks: [any(abs(m - (4.0 * c + j)) <= 0.5 for m in marks) for j in range(4)]
                h, o = near(moved), near(ons)
                n += sum(h) >= 3 and sum(o) >= 3 and (h[1] or h[3])
            counts.append(n)
        return sum(counts) / 50

    got = {r.key: r for r in out.collect()}
    assert abs(got["a"]["mean"] - brute("a")) < 1e-9 and got["a"]["mean"] > 0
    assert got["b"]["mean"] == 0 and got["b"].replicates == 50


def test_play_buckets_of_sums_that_fall_short_by_rounding(spark):
    rows = [("v", "a", float(i), i, 0.1) for i in range(300)]  # thirty seconds, 29.999999999999964 as a sum of doubles
    df = spark.createDataFrame(rows, "visitor string, lesson string, t double, id int, s double")
    got = events.play_buckets(df, "visitor", "lesson", "t", "id", "s", width_s=50.0).first()
    assert (got.buckets, got.rest_s) == (1, 0)


def test_track_ids_are_rounded_half_to_even(spark, tmp_path):
    at = lambda *a: dt.datetime(2024, 1, 1, *a)
    user = 6020  # user * 1e9 + an even second and a half lies exactly between two ids
    rows = [(i, t, user, "view", 1.0, '{"k": 1}') for i, t in enumerate([at(1, 0, 0, 500000), at(1, 0, 10)])]
    rows += [(9 + i, t, 6040, "view", 1.0, '{"k": 1}') for i, t in enumerate([at(2, 0, 0, 500000), at(2, 0, 10)])]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    start = int(at(1).replace(tzinfo=dt.UTC).timestamp())
    got = QUERIES["track_links"](spark, str(tmp_path)).first()
    assert (got.a, got.b) == (6020 * 10**9 + start, 6040 * 10**9 + start + 3600)


def test_subsample_takes_times_to_the_microsecond(spark):
    # 0.8 s apart on paper, a little less as doubles: 1.25 frames a second are two and a half times 0.5, a tie that goes to 2.
    df = spark.createDataFrame([("c", 0, 12 * 0.1), ("c", 1, 20 * 0.1)], "clip string, i int, t double")
    assert df.select(1 / (F.max("t") - F.min("t"))).first()[0] > 1.25
    assert motion.subsample(df, "clip", "i", "t", 0.5).first().fps == 0.625


def test_step_features_count_samples_of_one_moment(spark):
    rows = [("k", t, 1.0, a, b, 0.0, 0.0, 0.0) for t, a, b in [(0.0, 0.1, 0.3), (0.0, 0.1, 0.3), (1.0, 0.2, 0.2), (2.0, 0.3, 0.1), (4.0, 0.4, 0.4)]]
    samples = spark.createDataFrame(rows, "key string, t double, energy double, speed_a double, speed_b double, x double, y double, z double")
    steps = spark.createDataFrame([("k", 0, 0.0, 2.0), ("k", 1, 2.0, 4.0)], "key string, step int, ta double, tb double")
    got = {r.step: r.samples for r in motion.step_features(samples, steps, "key", ["a", "b"], 60.0).collect()}
    assert got == {0: 4, 1: 2}  # the sample at 2.0 belongs to both, the one at 4.0 once to the last, both at 0.0 count


def test_looks_ahead_read_a_slice_once(spark):
    df = spark.createDataFrame([("k", float(i), i if i % 4 == 1 else None) for i in range(40)], "key string, t double, v int")
    ahead = ordered.carry_last(df, ["key"], ["t"], ordered.time_bucket("t", 7.0), {"x": F.col("v")}, ahead=True, strict=True)
    both = ordered.carry_both(df, ["key"], ["t"], ordered.time_bucket("t", 7.0), F.col("v"))
    for out in (ahead, both):
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    marks = [i for i in range(40) if i % 4 == 1]
    for r in ahead.collect():
        assert r.x == min((m for m in marks if m > r.t), default=None)
    for r in both.collect():
        assert (r._back, r._ahead) == (max((m for m in marks if m <= r.t), default=None), min((m for m in marks if m >= r.t), default=None))


def test_quantiles_have_the_last_bit_of_sql(spark):
    rng = random.Random(4)
    rows = [(n, rng.random() * 50) for n in range(2, 60) for _ in range(n)]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"a": 0.2, "b": 0.3, "c": 0.75})
    for r in got.collect():
        v = sorted(x for k, x in rows if k == r.k)
        for q, x in ((0.2, r.a), (0.3, r.b), (0.75, r.c)):
            h = q * (len(v) - 1)
            lo, hi, d = v[math.floor(h)], v[math.ceil(h)], h - math.floor(h)
            assert x == float(Fraction(lo) * Fraction(1 - d) + Fraction(hi * d))


def test_segmentation_reads_events_once(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), 7, "view", float(i * 37 % 100), '{"k": 1}') for i in range(60)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["segmentation"](spark, str(tmp_path))
    assert "user_id" not in out._jdf.queryExecution().optimizedPlan().toString()  # scores and the first cuts are read from where they were written
    steps = out.orderBy("level", "a").collect()
    for level in ("beginner", "intermediate"):
        one = [(r.a, r.b) for r in steps if r.level == level]
        assert one[0][0] == 0 and all(b == a for (_, b), (a, _) in zip(one, one[1:]))


def test_deletion_plan_sorts_no_store(spark):
    targets = spark.createDataFrame([("a",), ("b",), ("b",)], "clip_id string")
    paths = spark.createDataFrame([("a.npz",), ("a.removed.json",), ("job_b.job-meta.json",), ("c.npz",)], "path string")
    uploads = spark.createDataFrame([("b.mp4",), ("c.mp4",)], "path string")
    keys = spark.createDataFrame([("video/a.mp4",), ("glb/c_track1.x.glb",)], "key string")
    jobs = spark.createDataFrame([("a", 1), ("c", 2)], "clip_id string, job_id int")
    index = spark.createDataFrame([("b", 5), ("b", 6), ("c", 7)], "clip_id string, entry_id int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for targets too many to be broadcast
    try:
        out = retention.deletion_plan(targets, paths, uploads, keys, jobs, index)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == [("a", "jobs", "1"), ("a", "objects", "video/a.mp4"), ("a", "results", "a.npz"), ("b", "index", "5"), ("b", "index", "6"), ("b", "results", "job_b.job-meta.json"), ("b", "uploads", "b.mp4")]


def test_step_features_keep_keys_without_a_spacing(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 3)
    rows = [(0, at, 1, "view", 10.0, '{"k": 40}')]  # one sample
    rows += [(i, at, 2, "view", 10.0, '{"k": 4}') for i in (1, 2, 3)]  # all at one moment
    rows += [(i, at + dt.timedelta(hours=i), 3, "view", 0.0, '{"k": 0}') for i in (4, 5)]  # nothing moves
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.key: (r.samples, r.lead) for r in QUERIES["step_features"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, "b"), 2: (3, "a"), 3: (2, "a")}  # as SQL has them


def _joined_rows(spark, run):
    """The most rows that a join of ``run`` put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, done = 0, store.executionsList()
    for i in range(before, done.size()):
        at = done.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(n) for n in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(n) for n in range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_track_links_meet_few_of_many_ends(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):  # one clip, and nearly every fragment could follow a thousand others
        t = round(rng.uniform(0, 50), 3)
        rows.append(("c", i, t, t + round(rng.uniform(0, 2), 3), 9, rng.choice([0.5, 0.56, rng.random() * 9]), rng.choice([0.5, 0.44, rng.random() * 9])))
    rows += [("c", 3000 + i, 60.0, 60.0, 9, 0.5, 0.5) for i in range(300)]  # alike, and each could follow itself
    tracks = spark.createDataFrame(rows, "clip string, track_id bigint, first_t double, last_t double, frames int, first_x double, last_x double")
    got = {}
    most = _joined_rows(spark, lambda: got.update({r.b: r.a for r in motion.track_links(tracks, "clip", 40.0, 0.15).collect()}))
    want = {}
    for _, b, s, _, _, x, _ in rows:
        ends = [(s - e, a) for _, a, _, e, _, _, y in rows if a != b and e <= s and s - e <= 40.0 and abs(y - x) <= 0.15]
        if ends:
            want[b] = min(ends)[1]
    assert got == want and got[3000] == 3001 and got[3001] == 3000
    assert 0 < most < 100_000


def test_content_groups_are_settled_in_three_steps(spark):
    rng = random.Random(5)

    def one_more(word, bits):
        return word ^ (((1 << bits) - 1) << rng.randrange(64 - bits))

    frames, word = [], 0
    for _ in range(14):  # a chain: each matches the one before and hardly another
        word = one_more(word, 8)
        frames.append(word)
    frames += [frames[3], frames[9], frames[9]] + [one_more(rng.choice(frames), rng.randrange(1, 12)) for _ in range(60)]
    signed = [f - (1 << 64) if f >> 63 else f for f in frames]
    rows = [(i, None, 2.0, [f], [f]) for i, f in enumerate(signed)]
    df = spark.createDataFrame(rows, "vec_id bigint, sha256 string, duration_s double, ahash array<bigint>, dhash array<bigint>")
    before = {b: [a for a in range(b) if (frames[a] ^ frames[b]).bit_count() <= 8] for b in range(len(frames))}
    first = {x for x in before if not before[x]}
    lead = {x for x in before if not first & set(before[x])}
    want = {x: min((a for a in before[x] if a in lead), default=x) for x in before}
    greedy = {}
    for x in before:
        greedy[x] = next((a for a in before[x] if greedy[a] == a), x)
    assert want != greedy
    assert {r.vec_id: r.leader for r in identity.three_step_groups(df, "vec_id").collect()} == want
    assert {r.vec_id: r.leader for r in identity.content_groups(df, "vec_id", "vec_id").collect()} == greedy


def test_quarters_are_written_before_they_meet_samples(spark, tmp_path, monkeypatch):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), 7, "view", float(i * 37 % 100), '{"k": 1}') for i in range(40)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")

    class Seen(Exception):
        pass

    def look(positions, *args, **kw):
        raise Seen(positions._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(series, "grid_score", look)
    with pytest.raises(Seen) as e:
        QUERIES["analyse"](spark, str(tmp_path))
    assert "Generate" not in str(e.value)  # the planner would take the quarters to be as few as the spans, and broadcast them


def test_what_grows_with_the_input_is_not_broadcast(spark):
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k in limits:
            spark.conf.unset(k)  # a session somebody else made
        session.tune(spark)
        ids = session.stored(spark.range(400_000).withColumn("label", F.lit("a")), "few-bytes")
        assert "Broadcast" not in check.physical(spark.range(3_000_000).join(ids, "id"))
        assert "Broadcast" in check.physical(spark.range(3_000_000).join(session.stored(spark.range(100), "few-rows"), "id"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stop_cues_where_most_samples_share_a_moment(spark):
    rng = random.Random(3)
    energy = [round(rng.random() * 9, 2) for _ in range(24)]
    rows = [("k", i, 24, float(i // 6), e, True, 2.0, 1.0, 0.0) for i, e in enumerate(energy)]  # a spacing of 0
    df = spark.createDataFrame(rows, "key string, idx bigint, n bigint, t double, energy double, ok boolean, spc double, p double, r double")

    def stop(i):
        if not 0 < i < 23 or energy[i] > min(energy[max(0, i - 2):i + 3]):
            return 0.0
        ref = min(max(energy[:i]), max(energy[i + 1:]))
        return max(0.0, (ref - energy[i]) / (ref + 1e-6))

    got = {r.idx: r.cue for r in analysis.cut_cues(df, "key", ["p", "r"]).collect()}
    assert len(got) == 24 and all(abs(got[i] - stop(i)) < 1e-6 for i in got) and sum(map(stop, range(24))) > 0
    whole = series.stop_cue(df, ["key"], "energy", None).collect()
    assert {r.idx: r.stop for r in whole} == {r.idx: r.stop for r in series.stop_cue(df, ["key"], "energy", 24).collect()}


def test_means_of_counts_are_summed_in_the_order_of_time(spark):
    ks = [49, 39, 5, 41]  # a mean of 0.335: 0.34 as summed from the first, 0.33 from the last
    rows = [("k", float(i), True, 1.0, k / 100, 1.0) for i, k in enumerate(ks)]
    samples = spark.createDataFrame(spark.sparkContext.parallelize(rows[::-1], 1), "key string, t double, ok boolean, limb double, root double, music double")
    assert motion.counts_motion(samples, "key", F.lit(0.0), F.lit(8.0)).first().root == 0.34
