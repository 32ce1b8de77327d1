"""File sources driven to the end; the RocksDB store and the Python state processors are the real ones."""

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tempofold.operators import jobs
from tempofold.streaming import events as se


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    se.use_rocksdb(spark)


def _feed(spark, tmp_path, schema, *batches):
    src = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def _run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120), "stream did not finish"
    return df.sparkSession.sql(f"select * from {name}").collect()


def T(*a):
    return dt.datetime(2024, 1, *a)


def test_daily_cap_across_batches(spark, tmp_path):
    s = _feed(spark, tmp_path, "visitor string, id int, occurred_at timestamp", [("v", 1, T(1, 10)), ("v", 2, T(1, 11))], [("v", 3, T(1, 12)), ("v", 4, T(2, 1)), ("w", 5, T(1, 9, 30))])
    assert sorted(r.id for r in _run(se.capped(s, 2, lateness="1 day"), tmp_path, "cap")) == [1, 2, 4, 5]


def test_limiter_keeps_state_between_batches(spark, tmp_path):
    s = _feed(spark, tmp_path, "ip string, id int, t double", [("a", 1, 0.0), ("a", 2, 1.0)], [("a", 3, 2.0), ("a", 4, 10.5), ("b", 5, 2.0)])
    assert {r.id: r.accepted for r in _run(se.limited(s, "ip", [(10.0, 2)]), tmp_path, "lim")} == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_play_meter_emits_whole_buckets_and_flushes(spark, tmp_path):
    s = _feed(spark, tmp_path, "visitor string, lesson string, seconds double, at timestamp, t double",
              [("v", "a", 20.0, T(1, 1), 1.0)], [("v", "a", 45.4, T(1, 1, 0, 30), 2.0), ("v", "b", 10.0, T(1, 1, 1), 3.0)])
    assert sorted((r.lesson, r.seconds) for r in _run(se.play_meter(s), tmp_path, "play"))[:3] == [("a", 5), ("a", 30), ("a", 30)]


def test_latest_status_ignores_older_attempts(spark, tmp_path):
    s = _feed(spark, tmp_path, "job_id string, state string, retry_count bigint, updated_at timestamp",
              [("j", "failed", 0, T(1, 1)), ("j", "queued", 1, T(1, 2))], [("j", "failed", 0, T(1, 3))])
    assert [r.state for r in _run(se.latest_status(s), tmp_path, "latest", "update")] == ["queued"]


def test_stale_export_is_checked_then_given_up(spark, tmp_path):
    at = lambda m: T(1, 1, m)
    sch = "job_id string, state string, stage_message string, retry_count bigint, updated_at timestamp"
    s = _feed(spark, tmp_path, sch, [("j", "processing", jobs.EXPORT_STAGE, 0, at(0)), ("k", "processing", jobs.EXPORT_STAGE, 0, at(0))],
              [("k", "succeeded", "", 0, at(5)), ("x", "queued", "", 0, at(14))], [("x", "queued", "", 0, at(59))], [("x", "queued", "", 0, T(1, 3))])
    got = [(r.job_id, r.verdict) for r in _run(se.stale_exports(s), tmp_path, "stale")]
    assert got[0] == ("j", "check") and ("j", "give_up") in got and not [g for g in got if g[0] == "k"]


def test_finish_once_and_daily_counts(spark, tmp_path):
    sch = "job_id string, retry_count bigint, name string, occurred_at timestamp"
    s = _feed(spark, tmp_path, sch, [("j", 0, "job_finished", T(1, 1)), ("j", 0, "job_finished", T(1, 2))], [("j", 1, "job_finished", T(1, 3)), ("j", 0, "job_finished", T(1, 4))], [("z", 0, "job_finished", T(5, 1))])
    assert sorted((r.job_id, r.retry_count) for r in _run(se.finished_once(s), tmp_path / "a", "once")) == [("j", 0), ("j", 1), ("z", 0)]
    assert [(str(r.day), r.n) for r in _run(se.daily_counts(s), tmp_path / "b", "daily")] == [("2024-01-01", 4)]


def test_ingest_to_partitioned_log(spark, tmp_path):
    body = json.dumps([{"name": "tap_on_one", "lesson": "job_1"}, {"name": "bad"}])
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"body": body, "user_agent": "ua", "ip": "1.1.1.1", "received_at": "2024-01-02T03:04:05Z"}) + "\n")
    salts = spark.createDataFrame([(dt.date(2024, 1, 2), b"s" * 32)], "day date, salt binary")
    q = se.append_log(se.ingest(se.client_batches(spark, str(src)), salts), str(tmp_path / "log"), str(tmp_path / "ck"), {"availableNow": True})
    assert q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "log")).collect()
    assert [(r.name, r.job_id, len(r.day_hash), str(r.day)) for r in rows] == [("tap_on_one", "job_1", 32, "2024-01-02")]


def test_late_rows_are_routed_and_counted(spark, tmp_path):
    s = _feed(spark, tmp_path, "id int, name string, occurred_at timestamp", [(1, "a", T(1, 1)), (2, "a", T(1, 2)), (3, "a", T(9, 1))])
    rolled = spark.createDataFrame([(dt.date(2024, 1, 1),)], "day date")
    q = se.route_late(s, lambda: rolled, str(tmp_path / "log"), str(tmp_path / "late"), str(tmp_path / "ck"), {"availableNow": True})
    assert q.awaitTermination(120)
    assert [(str(r.day), r.late) for r in spark.read.parquet(str(tmp_path / "late")).collect()] == [("2024-01-01", 2)]
    assert [r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [3]


def test_sessions_and_lockouts(spark, tmp_path):
    log = _feed(spark, tmp_path / "l", "visitor string, job_id string, name string, props string, occurred_at timestamp",
                [("v", "j", "lesson_opened", "{}", T(1, 1)), ("v", "j", "play_seconds", '{"seconds":30}', T(1, 1, 10)), ("v", "j", "tap_on_one", "{}", T(1, 3))], [("z", "j", "lesson_opened", "{}", T(3, 1))])
    got = sorted((r.visitor, r.opens, r.play_seconds, r.corrected_count_one) for r in _run(se.lesson_sessions(log), tmp_path / "ls", "sess"))
    assert got[:2] == [("v", 0, 0, True), ("v", 1, 30, False)]
    fails = _feed(spark, tmp_path / "f", "ip string, at timestamp", [("a", T(1, 1, 0, i)) for i in range(10)] + [("b", T(1, 1))], [("c", T(2, 1))])
    assert {r.ip for r in _run(se.lockouts(fails), tmp_path / "fs", "lock")} == {"a"}


def test_forward_cap_holds_over_batches(spark, tmp_path):
    sch = "id bigint, name string, visitor string, job_id string, props string, occurred_at timestamp"
    row = lambda i, day=1: (i, "tap_on_one", "v", "j", "{}", T(day, 1, 0, i))
    s = _feed(spark, tmp_path, sch, [row(1), row(2)], [row(3), row(4), row(5, 2)])
    sent = []
    se.forward(s, lambda df, n: sent.extend(r.id for r in df.collect()), str(tmp_path / "fw"), cap=3, trigger={"availableNow": True}).awaitTermination(120)
    assert sorted(sent) == [1, 2, 3, 5]


def test_visitors_and_jobs_share_few_state_values(spark, tmp_path):
    who = ["u", "v", "w", None]
    first = [(v, 10 * n + i, T(1, 1, i)) for i in range(3) for n, v in enumerate(who)]
    second = [(v, 100 + 10 * n + i, T(d, 2, i)) for d in (1, 2) for i in range(2) for n, v in enumerate(who)]
    s = _feed(spark, tmp_path / "a", "visitor string, id int, occurred_at timestamp", first, second)
    got = Counter((r.visitor, r.occurred_at.day) for r in _run(se.capped(s, 4, lateness="1 day", parts=2), tmp_path / "a", "cap"))
    assert got == {(v, d): 4 if d == 1 else 2 for v in who for d in (1, 2)}

    sch = "job_id string, state string, retry_count bigint, updated_at timestamp"
    s = _feed(spark, tmp_path / "b", sch, [(f"j{i}", "queued", 1, T(1, 2)) for i in range(9)],
              [(f"j{i}", "failed", 0 if i % 3 else 2, T(1, 3)) for i in range(9)] + [("new", "queued", 0, T(1, 1))])
    got = sorted((r.job_id, r.state) for r in _run(se.latest_status(s, parts=2), tmp_path / "b", "latest", "update"))
    assert got == sorted([(f"j{i}", "queued") for i in range(9)] + [(f"j{i}", "failed") for i in (0, 3, 6)] + [("new", "queued")])
