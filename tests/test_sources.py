import datetime as dt
import gzip
import json
import os

from pyspark.sql import functions as F, types as T

from tempofold.sources import readers, sinks


def test_log_append_fold_and_rerun(spark, tmp_path):
    log, rolled = str(tmp_path / "log"), str(tmp_path / "rolled")
    day = lambda m, d, h=1: dt.datetime(2024, m, d, h)
    rows = [(1, day(1, 1), "tap_on_one", b"a"), (2, day(1, 1, 2), "tap_on_one", b"b"), (3, day(1, 2), "tap_on_one", b"a"), (4, day(5, 1), "tap_on_one", b"a")]
    sinks.append_events(spark.createDataFrame(rows, "id bigint, occurred_at timestamp, name string, day_hash binary"), log, files_per_day=2)
    assert sinks.fold_old_days(spark, log, rolled, "2024-03-01", dry_run=True) == 3
    assert sinks.fold_old_days(spark, log, rolled, "2024-03-01") == 3
    assert [r.id for r in readers.event_log(spark, log).collect()] == [4]
    got = {(str(r.day), r.name): (r.n, r.visitors) for r in spark.read.parquet(rolled).collect()}
    assert got[("2024-01-01", "tap_on_one")] == (2, 2) and got[("2024-01-02", "_visitors")] == (1, 1)
    assert sinks.fold_old_days(spark, log, rolled, "2024-03-01") == 0


def test_publish_then_pointer(spark, tmp_path):
    v, p = str(tmp_path / "v"), str(tmp_path / "p")
    for body in (b"one", b"two"):
        sinks.publish(spark.createDataFrame([("c", body)], "clip_id string, body binary"), v, p, "clip_id", "body")
    assert [bytes(r.body) for r in sinks.latest_published(spark, v, p, "clip_id").collect()] == [b"two"]
    assert spark.read.parquet(v).count() == 2


def test_listing_reads_no_contents(spark, tmp_path):
    (tmp_path / "a.npz").write_bytes(b"12345")
    df = readers.object_listing(spark, str(tmp_path))
    assert [(r.name, r.bytes) for r in df.collect()] == [("a.npz", 5)]
    assert "content" not in df.columns


def test_score_caches_report_corrupt_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"s": 0.5}')
    (tmp_path / "bad.json").write_text('{"s": 0.')
    good, bad = readers.score_caches(spark, str(tmp_path), T.StructType([T.StructField("s", T.DoubleType())]))
    assert [(r.clip, r.s) for r in good.collect()] == [("good", 0.5)]
    assert [r.clip for r in bad.collect()] == ["bad"]


def test_status_documents_are_checked(spark, tmp_path):
    ok = {"schema_version": "1.0.0", "job_id": "j", "state": "queued", "stage_message": "", "progress": None, "error": None, "retry_count": 0}
    (tmp_path / "a.json").write_text(json.dumps(ok))
    (tmp_path / "b.json").write_text(json.dumps({**ok, "state": "odd", "progress": 2.0}))
    (tmp_path / "c.json").write_text("{")
    got = {os.path.basename(r.file): r.violations for r in readers.job_status(spark, str(tmp_path)).collect()}
    assert got == {"a.json": [], "b.json": ["state", "progress"], "c.json": ["not a document"]}


def test_beat_tracks_and_labels(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"_note": "x", "clip-a": {"beats": [0.0, 0.5], "downbeats": [0.0], "accents": [1.0, 0.2]}}))
    (tmp_path / "l.json").write_text(json.dumps({"_about": "y", "labels": [{"clip": "clip-a", "count_one_s": 0.5, "spc": 0.5}]}))
    long = readers.beats_long(readers.beat_tracks(spark, str(tmp_path / "t.json")))
    assert [(r.clip, r.t) for r in long["beats"].collect()] == [("clip-a", 0.0), ("clip-a", 0.5)]
    assert [(r.i, r.accent) for r in long["accents"].collect()] == [(0, 1.0), (1, 0.2)]
    assert [r.count_one_s for r in readers.count_labels(spark, str(tmp_path / "l.json")).collect()] == [0.5]


def test_motion_documents_from_gzip(spark, tmp_path):
    doc = {"schema_version": "1.0.0", "job_id": "j", "sample_times_s": [0.0, 0.1], "persons": []}
    (tmp_path / "abc.json.gz").write_bytes(gzip.compress(json.dumps(doc).encode()))
    r = readers.motion_documents(spark, str(tmp_path)).select("clip_id", F.size("doc.sample_times_s").alias("n")).first()
    assert (r.clip_id, r.n) == ("abc", 2) or r.n == 2
