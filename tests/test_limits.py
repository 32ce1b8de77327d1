import random

import numpy as np
import pyarrow as pa
import pytest

from tempofold.operators import limits
from tempofold.streaming import limits as streams

SCHEMA = "id long, ip string, t double"
HOUR, DAY = 3600, 86400


def brute(rows, hour, day, everybody):
    """The rule word for word: every window is counted over all accepted rows."""
    taken, out = [], {}
    for i, ip, t in sorted(rows, key=lambda r: (r[2], r[0])):
        us = round(t * 1e6)
        midnight = (us // limits.DAY + 1) * limits.DAY
        live = [a for a, _ in taken if a > us - limits.DAY]
        own = [a for a, who in taken if who == ip and a // limits.DAY == us // limits.DAY]
        recent = [a for a in own if a > us - limits.HOUR]
        code = free = None
        if len(live) >= everybody:
            code, free = limits.EVERYBODY, min(live, default=us) + limits.DAY
        elif len(own) >= day:
            code, free = limits.ADDRESS, min(min(own, default=us) + limits.DAY, midnight)
        elif len(recent) >= hour:
            code, free = limits.ADDRESS, min(min(recent, default=us) + limits.HOUR, midnight)
        if code is None:
            taken.append((us, ip))
        out[i] = (code is None, code, None if code is None else max(60, (free - us) // 1_000_000))
    return out


def attempts(n, seed, days=4, addresses=5, burst=False):
    rng = random.Random(seed)
    at = lambda: 1_000_000.0 if burst and rng.random() < 0.4 else rng.randrange(days * DAY * 4) / 4
    return [(i, rng.choice([None, *map(str, range(addresses))]), at()) for i in range(n)]


@pytest.mark.parametrize(("rule", "burst"), [((3, 8, 25), False), ((2, 3, 1000), False), ((5, 20, 12), True), ((1, 0, 10), False), ((2, 4, 0), False)])
def test_slices_decide_as_one_log(spark, rule, burst):
    rows = attempts(400, sum(rule), burst=burst)
    got = limits.replay(spark.createDataFrame(rows, SCHEMA).repartition(3), "ip", "t", ["id"], *rule, slice_rows=60)
    assert {r.id: (r.accepted, r.code, r.wait_s) for r in got.collect()} == brute(rows, *rule)


def test_one_second_is_cut_into_slices(spark):
    rows = [(i, str(i % 50), 5.0) for i in range(2_000)]
    got = limits.replay(spark.createDataFrame(rows, SCHEMA), "ip", "t", ["id"], 3, 3, 100, slice_rows=150)
    accepted = sorted(r.id for r in got.where("accepted").collect())
    assert accepted == list(range(100))


def test_rows_before_count_and_nothing_is_something(spark):
    rows = attempts(150, 9)
    early = [r for r in rows if r[2] < 2 * DAY]
    late = [r for r in rows if r[2] >= 2 * DAY]
    want = brute(rows, 2, 5, 15)
    before = spark.createDataFrame([r for r in early if want[r[0]][0]], SCHEMA)
    got = limits.replay(spark.createDataFrame(late, SCHEMA), "ip", "t", ["id"], 2, 5, 15, before=before, slice_rows=30)
    assert {r.id: (r.accepted, r.code, r.wait_s) for r in got.collect()} == {r[0]: want[r[0]] for r in late}
    assert limits.replay(spark.createDataFrame([], SCHEMA), "ip", "t", ["id"]).count() == 0
    with pytest.raises(ValueError):
        limits.replay(spark.createDataFrame(rows, SCHEMA), "ip", "t", ["id"], everybody=-1)


def test_stream_decides_as_one_log_and_runs_again_alike(spark, tmp_path):
    rows = attempts(200, 4, days=3)
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for day in range(3):
        spark.createDataFrame([r for r in rows if r[2] // DAY == day], SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        streams.decide_limits(stream, out, state, "ip", "t", ["id"], 2, 6, 18, {"availableNow": True}).awaitTermination()
    decided = streams.limit_decisions(spark, stream.schema, out)
    assert {r.id: (r.accepted, r.code, r.wait_s) for r in decided.collect()} == brute(rows, 2, 6, 18)
    held = spark.read.parquet(f"{out}/held/batch=2")
    assert held.count() <= 18


def test_removals_begin_anew_at_midnight(spark):
    rows = [(i, "a", DAY - 10.0 + i) for i in range(9)] + [(i, "a", DAY + i * 1.0) for i in range(9, 16)]
    got = {r.id: (r.accepted, r.code, r.wait_s) for r in limits.removals(spark.createDataFrame(rows, SCHEMA), "ip", "t", ["id"], width_s=3.0).collect()}
    assert [i for i, (ok, *_) in got.items() if ok] and sorted(i for i, (ok, *_) in got.items() if ok) == [0, 1, 2, 3, 4, 9, 10, 11, 12, 13]
    assert got[5] == (False, limits.REMOVALS, 60) and got[15] == (False, limits.REMOVALS, DAY - 15)


def test_accepted_places_are_those_of_the_fold():
    rng = random.Random(11)
    for _ in range(300):
        n, span = rng.randrange(1, 400), rng.choice([2, 20, 80]) * limits.HOUR
        at = sorted(rng.randrange(span) for _ in range(n))
        address = [rng.choice([None, "a", "b", "c", "d"][: rng.choice([2, 5])]) for _ in range(n)]
        held = sorted((rng.randrange(-limits.DAY + 1, 0), rng.choice("ab")) for _ in range(rng.randrange(12)))
        rule = (rng.randrange(4), rng.randrange(8), rng.randrange(14))
        want = [i for i, kept in enumerate(limits.decide(at, address, held, *rule)[0]) if kept]
        assert limits.accepted_places(np.array(at), pa.array(address, pa.string()), held, *rule) == want
