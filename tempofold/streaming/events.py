"""Event streams: ingest, caps, limits, sessions, daily counts, once-only finishes, late data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import events, jobs, ordered
from ..sources import sinks
from . import state

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State processors keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def client_batches(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schemas.CLIENT_BATCH).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest(batches: DataFrame, salts: DataFrame) -> DataFrame:
    """Bodies to accepted log rows: parse, allowlist, visitor hash. No state and no shuffle."""
    ok = events.validate_events(events.client_items(batches))
    hashed = events.visitor_hash(ok, salts, "received_at", "ip", "user_agent")
    return hashed.select(F.col("received_at").alias("occurred_at"), "name", F.col("lesson").alias("job_id"), "day_hash", "props", "pos")


def _keyed(rows: DataFrame, keys: Sequence[str], processor, out: T.StructType, mode: str = "append", time: str = "None") -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode=mode, timeMode=time)


def _part(key: str, parts: int):
    return F.pmod(F.hash(key), F.lit(parts))


def capped(rows: DataFrame, cap: int = events.DAILY_CAP, at: str = "occurred_at", lateness: str = "1 hour", parts: int = 64) -> DataFrame:
    """At most ``cap`` rows per visitor and UTC day, in time order within a micro-batch.

    The visitors of a day are kept in ``parts`` values of the state; raise it beyond some millions a day.
    """
    daily = rows.withWatermark(at, lateness).withColumn("_day", F.floor(ordered.seconds(at) / 86400).cast("bigint")).withColumn("_part", _part("visitor", parts))
    return _keyed(daily, ["_day", "_part"], state.DailyCap(cap, rows.columns, rows.schema["visitor"].dataType, at), rows.schema, time="EventTime")


def limited(rows: DataFrame, key: str, limits: Sequence[tuple[float, int]], expire: bool = False) -> DataFrame:
    """Sliding-window limits with refused rows flagged, not dropped.

    With ``expire`` a key that is silent for the widest span leaves the state; that needs a trigger that
    goes on, since a stream with a clock never runs out of batches.
    """
    out = T.StructType([*rows.schema.fields, T.StructField("accepted", T.BooleanType())])
    return _keyed(rows, [key], state.SlidingLimiter(list(limits), rows.columns, expire=expire), out, time="ProcessingTime" if expire else "None")


def play_meter(plays: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """play_seconds rows per visitor. Plays need visitor, lesson, seconds, at, t."""
    out = T.StructType([T.StructField("visitor", T.StringType()), T.StructField("lesson", T.StringType()), T.StructField("seconds", T.LongType())])
    return _keyed(plays.withWatermark("at", watermark), ["visitor"], state.PlayMeter(), out, time="EventTime")


def stale_exports(status: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """Verdicts on exports that stopped reporting. Status rows need job_id, state, stage_message, retry_count, updated_at."""
    rows = status.withWatermark("updated_at", watermark).withColumn("updated_ms", F.unix_millis("updated_at"))
    out = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("retry_count", T.LongType()), T.StructField("verdict", T.StringType())])
    return _keyed(rows, ["job_id"], state.StaleExport(jobs.EXPORT_STAGE), out, time="EventTime")


def latest_status(status: DataFrame, keep_days: int | None = None, parts: int = 1024) -> DataFrame:
    """Newest status per job as an update stream; jobs are kept in ``parts`` values of the state.

    With ``keep_days`` a job that is silent so long is forgotten; that needs a trigger that goes on, since
    a stream with a clock never runs out of batches, and each job is a key of its own.
    """
    rows = status.withColumn("updated_ms", F.unix_millis("updated_at"))
    if keep_days:
        return _keyed(rows, ["job_id"], state.LatestStatus(status.columns, keep_days * state.DAY_MS), status.schema, mode="update", time="ProcessingTime")
    rows = rows.withColumn("_part", _part("job_id", parts))
    return _keyed(rows, ["_part"], state.LatestStatuses(status.columns, status.schema["job_id"].dataType), status.schema, mode="update")


def daily_counts(log: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Closed days only: a day's counts come out once the watermark passes it."""
    return (log.withWatermark("occurred_at", lateness).groupBy(F.window("occurred_at", "1 day"), "name")
            .agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "name", "n"))


def finished_once(finished: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One finish per (job, attempt)."""
    return finished.withWatermark("occurred_at", lateness).dropDuplicatesWithinWatermark(["job_id", "retry_count"])


def lesson_sessions(log: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Visits per visitor and lesson with play seconds and whether count 1 was corrected."""
    name = F.col("name")
    return (log.withWatermark("occurred_at", lateness).groupBy("visitor", "job_id", F.session_window("occurred_at", gap))
            .agg(F.count_if(name == "lesson_opened").alias("opens"),
                 F.coalesce(F.sum(F.when(name == "play_seconds", events.prop("seconds", "int"))), F.lit(0)).alias("play_seconds"),
                 F.bool_or(name.isin(*events.CORRECTIONS)).alias("corrected_count_one"))
            .select("visitor", F.col("job_id").alias("lesson"), F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"),
                    "opens", "play_seconds", "corrected_count_one"))


def lockouts(failures: DataFrame, limit: int = 10, window: str = "600 seconds", slide: str = "60 seconds") -> DataFrame:
    """Addresses with too many failures in a sliding window."""
    return (failures.withWatermark("at", window).groupBy("ip", F.window("at", window, slide)).agg(F.count("*").alias("failures"))
            .filter(F.col("failures") >= limit).select("ip", F.col("window.start").alias("from"), F.col("window.end").alias("to"), "failures"))


def batch_ids(rows: DataFrame, keys: Sequence[str], t: str, tie: str, size: int = 20, width_s: float = 60.0) -> DataFrame:
    """Outgoing batches of ``size`` events within one micro-batch; adds ``batch``."""
    x = ordered.dense_index(rows, keys, [t, tie], ordered.time_bucket(t, width_s), idx="_i")
    return x.withColumn("batch", F.floor(F.col("_i") / size)).drop("_i")


# -- sinks --------------------------------------------------------------------

def append_log(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Exactly-once file sink partitioned by day."""
    day = sinks.as_log(rows).withColumn("day", F.to_date("occurred_at"))
    return (day.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day")
            .outputMode("append").trigger(**(trigger or {"processingTime": "15 seconds"})).start())


def append_live(rows: DataFrame, tombstones: Callable[[], DataFrame], path: str, checkpoint: str, clip: str = "clip_id",
                trigger: dict | None = None) -> StreamingQuery:
    """Rows whose lesson is still up; tombstones are read afresh for every micro-batch. A batch that is tried again overwrites its own folder."""
    def write(batch: DataFrame, n: int) -> None:
        batch.join(tombstones().select(clip), clip, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def route_late(rows: DataFrame, rolled: Callable[[], DataFrame], log_path: str, late_path: str, checkpoint: str,
               trigger: dict | None = None) -> StreamingQuery:
    """Events of a folded day go to a correction table with their count kept; the rest to the log."""
    def write(batch: DataFrame, _: int) -> None:
        days = rolled().select("day").distinct()
        dated = batch.withColumn("day", F.to_date("occurred_at"))
        dated.join(days, "day", "left_semi").groupBy("day", "name").agg(F.count("*").alias("late")).write.mode("append").parquet(late_path)
        dated.join(days, "day", "left_anti").write.mode("append").partitionBy("day").parquet(log_path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def forward(rows: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, cap: int = events.FORWARD_DAILY_CAP,
            trigger: dict | None = None) -> StreamingQuery:
    """Vendor payloads in batches of twenty, while the day's total is within the cap. ``send`` gets (payloads, batch number).

    Each batch leaves its rows per day in a folder of its own beside the checkpoint, so the cap holds
    over batches, and a batch that is tried again counts once.
    """
    def write(batch: DataFrame, n: int) -> None:
        totals = f"{checkpoint}-totals"
        batch.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{totals}/batch={n}")
        had = batch.sparkSession.read.schema("day date, n bigint, batch bigint").parquet(totals).filter(F.col("batch") < n).groupBy("day").agg(F.sum("n").alias("n"))
        gated = events.forward_gate(batch, cap, before=had)
        send(batch_ids(events.forward_payload(gated).withColumn("_t", ordered.seconds("occurred_at")), [], "_t", "id").drop("_t"), n)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def append_labels(labels: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append-only label log; the latest per clip is ``jobs.latest_labels``."""
    return (labels.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(**(trigger or {"processingTime": "15 seconds"})).start())
