"""Event rules against the known outcomes of the product's own checks."""

import datetime as dt
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from tempofold.operators import events as ev


def _kept(spark, items):
    body = json.dumps(items)
    rows = ev.validate_events(ev.client_items(spark.createDataFrame([(1, body)], "rid int, body string"))).orderBy("pos").collect()
    return [(r.name, json.loads(r.props), r.lesson) for r in rows]


def test_allowlist(spark):
    got = _kept(spark, [
        {"name": "play_seconds", "props": {"seconds": 30.9 - 1}, "lesson": "job_1"},
        {"name": "play_seconds", "props": {"seconds": 31}},
        {"name": "play_seconds", "props": {"seconds": True}},
        {"name": "loop_created", "props": {"counts": 4.567, "snapped": 1}},
        {"name": "loop_created", "props": {"counts": 4.567, "snapped": True, "via": "drag", "other": 3}, "lesson": "bad id!"},
        {"name": "lesson_opened", "props": {"ref": " TikTok.com "}, "lesson": 7},
        {"name": "lesson_opened", "props": {"ref": "a/b"}},
        {"name": "nope", "props": {}},
        {"name": "tap_on_one"},
        "text", None,
    ])
    assert got == [("play_seconds", {"seconds": 29}, "job_1"), ("loop_created", {"counts": 4.57, "snapped": True, "via": "drag"}, None),
                   ("lesson_opened", {"ref": "tiktok.com"}, None), ("tap_on_one", {}, None)]


def test_batch_limits(spark):
    many = [{"name": "tap_on_one"}] * 60
    assert len(_kept(spark, many)) == 50
    big = spark.createDataFrame([(1, json.dumps([{"name": "tap_on_one", "props": {"x": "y" * 17000}}])), (2, '{"name":"tap_on_one"}'), (3, "not json")], "rid int, body string")
    assert ev.client_items(big).count() == 0


def test_visitor_hash_is_hmac(spark):
    salt = bytes(range(32))
    rows = spark.createDataFrame([("1.2.3.4", "agent", dt.datetime(2024, 5, 1, 3))], "ip string, ua string, at timestamp")
    salts = spark.createDataFrame([(dt.date(2024, 5, 1), salt)], "day date, salt binary")
    got = ev.visitor_hash(rows, salts, "at", "ip", "ua").first().day_hash
    assert bytes(got) == hmac.new(salt, b"1.2.3.4|agent", hashlib.sha256).digest()


def test_salts_rotate(spark):
    d = lambda n: dt.date(2024, 5, n)
    old = spark.createDataFrame([(d(1), b"x"), (d(2), b"y")], "day date, salt binary")
    got = {r.day: bytes(r.salt) for r in ev.rotate_salts(old, spark.createDataFrame([(d(2),), (d(3),)], "day date"), F.lit(d(2))).collect()}
    assert set(got) == {d(2), d(3)} and got[d(2)] == b"y" and len(got[d(3)]) == 32


def _log(spark, rows):
    return spark.createDataFrame(rows, "occurred_at timestamp, name string, job_id string, visitor string, props string")


def test_rollup_known_case(spark):
    old, new = dt.datetime(2023, 1, 5, 10), dt.datetime(2024, 6, 1)
    log = _log(spark, [(old, "play_seconds", "j", "v1", '{"seconds":30}'), (old, "play_seconds", "j", "v1", '{"seconds":30}'), (old, "play_seconds", "j", "v2", '{"seconds":30}'),
                       (old, "job_finished", "j", None, '{"state":"failed","error_code":"export_error"}'), (old, "dispatch", "j", "ip", None), (new, "tap_on_one", "j", "v1", "{}")])
    cut = ev.rollup_cutoff(F.lit(dt.datetime(2024, 6, 1)))
    rolled = ev.rollup(log, cut)
    got = {(r.name, r.detail): (r.n, r.visitors, None if r.seconds is None else float(r.seconds)) for r in rolled.collect()}
    assert got == {("play_seconds", ""): (3, 2, 90.0), ("job_finished", "failed:export_error"): (1, 0, None), ("dispatch", ""): (1, 1, None), ("_visitors", ""): (4, 2, None)}
    assert ev.rollup(log, cut, existing=rolled).count() == 0


def test_daily_cap_restarts_at_midnight(spark):
    rows = [(i, "v", dt.datetime(2024, 1, 1, 23, 59, 50 + i)) for i in range(5)] + [(10 + i, "v", dt.datetime(2024, 1, 2, 0, 0, i)) for i in range(3)]
    got = ev.daily_cap(spark.createDataFrame(rows, "id int, visitor string, occurred_at timestamp"), cap=2)
    assert sorted(r.id for r in got.collect()) == [0, 1, 10, 11]


def test_play_buckets_flush_on_change(spark):
    plays = [(1.0, 1, "a", 20.0), (2.0, 2, "a", 45.4), (3.0, 3, "b", 10.0), (4.0, 4, "a", 29.6)]
    df = spark.createDataFrame([("v", *p) for p in plays], "visitor string, t double, id int, lesson string, s double")
    got = [(r.lesson, r.buckets, r.rest_s) for r in ev.play_buckets(df, "visitor", "lesson", "t", "id", "s", width_s=2.0).orderBy("from_t").collect()]
    assert got == [("a", 2, 5), ("b", 0, 10), ("a", 0, 30)]


def test_only_empty_values_count_as_no_props(spark):
    shapes = {'"false"': False, '"0"': False, '"[]"': False, "[null]": False, "[1]": False, "1": False, "true": False, '""': True, "[]": True, "{}": True, "0": True, "0.0": True, "false": True, "null": True}
    body = "[" + ",".join(f'{{"name":"link_copied","props":{p},"lesson":"l{k}"}}' for k, p in enumerate(shapes)) + "]"
    got = ev.validate_events(ev.client_items(spark.createDataFrame([(body,)], "body string")))
    assert {int(r.lesson[1:]) for r in got.collect()} == {k for k, ok in enumerate(shapes.values()) if ok}


def test_rejects_are_counted(spark):
    bodies = ["[" + " " * 20000 + "]", "{}", "nonsense", "[" + ",".join(["{}"] * 60) + "]", "[]"]
    got = {r.reason: (r.bodies, r["items"]) for r in ev.rejected(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()}
    assert got == {"body too large": (1, 0), "no array": (2, 0), "past the batch limit": (1, 10)}


def test_payload_keeps_json_types(spark):
    import json

    log = spark.createDataFrame([("loop_created", "v", "job_1", '{"seconds":5,"snapped":true,"via":"drag","x":1.5,"lesson":"other"}'), ("dispatch", None, "job_2", None)], "name string, visitor string, job_id string, props string")
    got = [json.loads(r.payload) for r in ev.forward_payload(log.withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp"))).collect()]
    fixed = {"$process_person_profile": False, "$geoip_disable": True, "$ip": None}
    assert got[0]["properties"] == {"seconds": 5, "snapped": True, "via": "drag", "x": 1.5, "lesson": "job_1", **fixed}
    assert got[1]["properties"] == {"lesson": "job_2", **fixed} and got[1]["distinct_id"] == "job_2"
