"""Job status: merging stores, eligibility, timings, queues and funnels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import counts as C, text
from ..session import stored
from . import ordered
from .quantiles import exact_quantiles

# States and the limits of retries, exports and idle lessons.
STATES = ("queued", "processing", "succeeded", "failed")
TERMINAL = ("succeeded", "failed")
SCHEMA_VERSION = "1.0.0"
MAX_RETRIES = 2
EXPORT_STAGE = "Building the 3D body file"
EXPORT_STALE_S, EXPORT_GIVE_UP_S = 720.0, 2160.0
TTL_DAYS, TOUCH_EVERY_S = 180, 86400
RATE_PER_HOUR = 1.95

STATUS_FIELDS = ("job_id", "state", "stage_message", "progress", "error", "retry_count")


def status_documents(rows: DataFrame) -> DataFrame:
    """Job rows as status JSON, fields in contract order, nulls kept."""
    doc = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "job_id", "state",
                   F.coalesce("stage_message", F.lit("")).alias("stage_message"), "progress", "error", "retry_count")
    return rows.select("job_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("status"))


def with_queued_default(requested: DataFrame, status: DataFrame) -> DataFrame:
    """Every requested job with its status; one that wrote nothing yet is queued."""
    j = requested.select("job_id").join(status, "job_id", "left")
    return j.withColumns({"state": F.coalesce("state", F.lit("queued")), "stage_message": F.coalesce("stage_message", F.lit("")),
                          "retry_count": F.coalesce("retry_count", F.lit(0))})


def row_violations() -> Column:
    """Names of the table constraints a job row breaks."""
    state, progress = F.col("state"), F.col("progress")
    return F.array_compact(F.array(
        F.when(state.isNull() | ~state.isin(*STATES), "state"),
        F.when(progress.isNotNull() & ~progress.between(0.0, 1.0), "progress"),
        F.when(F.col("retry_count").isNull() | (F.col("retry_count") < 0), "retry_count"),
        F.when(F.col("error").isNotNull() & F.coalesce(state != "failed", F.lit(True)), "error_only_when_failed")))


def split_by_violations(rows: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with ``violations``)."""
    tagged = rows.withColumn("violations", violations)
    return tagged.filter(F.size("violations") == 0).drop("violations"), tagged.filter(F.size("violations") > 0)


def merge_status(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """One status per job from the row store and the document store.

    A terminal row wins; otherwise the document, unless it is from an earlier attempt.
    """
    pack = lambda df, name: df.select("job_id", F.struct(*[c for c in df.columns if c != "job_id"]).alias(name))
    j = pack(rows, "_row").join(pack(docs, "_doc"), "job_id", "full")
    older = F.coalesce(F.col("_doc.retry_count"), F.lit(0)) < F.col("_row.retry_count")
    pick = (F.when(F.col("_row.state").isin(*TERMINAL), F.lit("row")).when(F.col("_doc").isNull(), "row")
            .when(F.col("_row").isNotNull() & older, "row").otherwise("document"))
    common = [c for c in rows.columns if c != "job_id" and c in docs.columns]
    j = j.withColumn("source", pick)
    return j.select("job_id", *[F.when(F.col("source") == "row", F.col(f"_row.{c}")).otherwise(F.col(f"_doc.{c}")).alias(c) for c in common], "source")


def finish_join(finished: DataFrame, dispatches: DataFrame) -> DataFrame:
    """Wall seconds of each finish from its job's last dispatch to the worker's own finish time, else when it was seen."""
    last = dispatches.groupBy("job_id").agg(F.max("t").alias("dispatched"))
    wall = F.bround(F.coalesce("finished_t", "seen_t") - F.col("dispatched"))
    return finished.join(last, "job_id", "left").withColumn("wall_s", wall.cast("bigint"))


def stage_seconds(stage_at: Column, dispatched: Column) -> Column:
    """Map of stage -> whole seconds since dispatch; stages without a number drop out."""
    numeric = F.map_filter(stage_at, lambda k, v: v.isNotNull() & ~F.isnan(v))
    return F.when(dispatched.isNotNull(), F.transform_values(numeric, lambda k, v: F.bround(v - dispatched).cast("bigint")))


def waterfall(stages: DataFrame, by: Sequence[str], seconds: str, qs: dict[str, float] | None = None) -> DataFrame:
    """Exact latency percentiles per stage; a stage may hold every job there is."""
    return exact_quantiles(stages, by, seconds, qs or {"median_s": 0.5, "p90_s": 0.9}, count="n")


def throughput(frames: Column, elapsed_s: Column, wall_s: Column, rate: float = RATE_PER_HOUR) -> Column:
    return F.struct((frames / elapsed_s).alias("fps"), (wall_s / 3600 * rate).alias("cost"))


def retry_refusal() -> Column:
    """First reason a retry is refused, null when it may run. Needs state, error, removed, has_meta, retry_count."""
    return (F.when(F.col("removed"), "removed").when(F.col("state") != "failed", "not_failed")
            .when(~F.coalesce(F.col("error.retryable"), F.lit(False)), "not_retryable")
            .when(~F.col("has_meta"), "no_meta").when(F.col("retry_count") >= MAX_RETRIES, "retries_exhausted"))


def retryable_jobs(status: DataFrame, tombstones: DataFrame, meta: DataFrame) -> DataFrame:
    """Jobs with the refusal reason of a retry; a null reason may run, as ``next_retry``."""
    gone = tombstones.select("clip_id", F.lit(True).alias("_gone"))
    j = status.join(meta.select("job_id", "clip_id", F.lit(True).alias("_meta")), "job_id", "left").join(gone, "clip_id", "left")
    j = j.withColumn("removed", F.coalesce("_gone", F.lit(False))).withColumn("has_meta", F.coalesce("_meta", F.lit(False)))
    return j.withColumn("refusal", retry_refusal()).withColumn(
        "next_retry", F.when(F.col("refusal").isNull(), F.col("retry_count") + 1)).drop("_gone", "_meta", "removed", "has_meta")


def stale_exports(status: DataFrame, now_s: Column) -> DataFrame:
    """Exports past their time: ``check`` once stale, ``give_up`` once three times that."""
    age = now_s - F.col("since_s")
    return status.filter((F.col("state") == "processing") & (F.col("stage_message") == EXPORT_STAGE)).withColumn(
        "verdict", F.when(age >= EXPORT_GIVE_UP_S, "give_up").when(age >= EXPORT_STALE_S, "check")).filter("verdict is not null")


def is_expired(last_access_s: Column, now_s: Column) -> Column:
    return now_s - last_access_s > TTL_DAYS * 86400


def touches(opens: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Last access per lesson from its opens; removed lessons are never touched again."""
    return opens.join(tombstones.select("clip_id"), "clip_id", "left_anti").groupBy("clip_id").agg(F.max("t").alias("at"))


def touch_writes(opens: DataFrame, clip: str = "clip_id", t: str = "t", width_s: float = 3600.0) -> DataFrame:
    """The throttled writes themselves: an open writes only a day after the last write. Adds ``writes``.

    A write points to the first open a day or more after it, and after a quiet day the next open writes
    whatever came before; so the writes are the chains from those opens, and a lesson that is opened a
    million times is spread over tasks. Opens of one moment are alike to the rule: the first of them by
    the other columns writes. ``clip`` and ``t`` (seconds) must not be null.
    """
    us = F.round(F.col(t) * 1_000_000).cast("bigint")
    placed = stored(opens.withColumn("_us", us).withColumn("_row", F.monotonically_increasing_id()), "touch-opens")
    moments = stored(placed.select(F.col(clip).alias("_clip"), "_us").distinct().withColumn("_s", F.col("_us") / 1_000_000), "touch-moments")
    # Numbered in slices, moments meet their predecessor within a run and their successor by an as-of lookup on whole microseconds.
    before = ordered.carry_last(moments, ["_clip"], ["_us"], ordered.time_bucket("_s", width_s), {"_prev": F.col("_us")}, strict=True)
    day = TOUCH_EVERY_S * 1_000_000
    probes = before.withColumn("_first", F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") >= day)).select("_clip", (F.col("_us") + day).alias("_at"), "_us", "_first")
    marks = moments.select("_clip", F.col("_us").alias("_at"))
    ahead = ordered.asof(probes, marks, ["_clip"], "_at", [], width_s * 1_000_000, ahead=True).withColumn("_next", F.col("hit.t"))
    written = ordered.reachable(ahead, ["_clip"], "_us", "_next", "_first").select(F.col("_clip").alias(clip), "_us")
    ties = [c for c in opens.columns if c not in (clip, t)]
    heads = placed.join(written, [clip, "_us"]).groupBy(clip, "_us").agg(F.min(F.struct(*ties, "_row")).alias("_h")).select(F.col("_h._row").alias("_row"), F.lit(True).alias("writes"))
    return placed.join(heads, "_row", "left").select(*opens.columns, F.coalesce("writes", F.lit(False)).alias("writes"))


def recent_succeeded(jobs: DataFrame, limit: int, created: str = "created_at", tie: str = "job_id") -> DataFrame:
    """Newest succeeded jobs; a top-k, so each task keeps only ``limit`` rows."""
    return jobs.filter(F.col("state") == "succeeded").orderBy(F.col(created).desc(), F.col(tie)).limit(limit)


def newest_per_clip(jobs: DataFrame, clip: str = "clip_id", created: str = "created_at", tie: str = "job_id") -> DataFrame:
    """Newest row per clip by aggregate (ties: smallest id)."""
    rows = F.struct(*jobs.columns)
    return jobs.groupBy(clip).agg(F.max_by(rows, F.struct(F.col(created), -F.col(tie))).alias("_r")).select("_r.*")


def owner_queue(jobs: DataFrame, beats: DataFrame, meta: DataFrame, labels: DataFrame) -> DataFrame:
    """Queue rows: detector proposal, credit, and the latest owner label over them."""
    last = labels.groupBy("clip_id").agg(F.max_by(F.struct("count_one_s", "duration_s"), "at").alias("_label"))
    b = beats.select("clip_id", "bpm", "seconds_per_count", F.col("count_one_s").alias("_det"))
    j = jobs.join(b, "clip_id", "left").join(meta.select("job_id", "credit"), "job_id", "left").join(last, "clip_id", "left")
    detected = F.when(F.col("_det").isNotNull(), F.greatest(F.lit(0.0), F.col("_det")))
    return j.withColumn("count_one_s", F.coalesce("_label.count_one_s", detected)).withColumn(
        "duration_s", F.col("_label.duration_s")).withColumn("confirmed", F.col("_label").isNotNull()).drop("_det", "_label")


def with_early_counts(status: DataFrame, proposals: DataFrame) -> DataFrame:
    """Counts folded into live statuses that lack them. ``proposals``: clip_id, grid struct."""
    j = status.join(proposals, "clip_id", "left")
    live = F.col("state").isin("queued", "processing") & F.col("counts").isNull()
    return j.withColumn("counts", F.when(live, C.counts_milestone(F.col("grid"))).otherwise(F.col("counts"))).drop("grid")


def stamp_credit(meta: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Set a missing credit, refresh one for the same canonical URL, keep one for another post.

    ``meta.credit`` and ``arrivals.new_credit`` are structs of one type with ``url``.
    """
    j = meta.join(arrivals, "job_id", "left")
    old, new = F.col("credit"), F.col("new_credit")
    same = text.clean_url(old["url"]) == new["url"]
    return j.withColumn("credit", F.when(new.isNull(), old).when(old.isNull() | F.coalesce(same, F.lit(False)), new).otherwise(old)).drop("new_credit")


def resolve_clip(requests: DataFrame, jobs: DataFrame, meta: DataFrame) -> DataFrame:
    """job_id -> clip_id from the job row, else the meta record, else the id without its prefix."""
    j = requests.join(jobs.select("job_id", F.col("clip_id").alias("_a")), "job_id", "left").join(
        meta.select("job_id", F.col("clip_id").alias("_b")), "job_id", "left")
    return j.withColumn("clip_id", F.coalesce("_a", "_b", F.regexp_replace("job_id", "^job_", ""))).drop("_a", "_b")


def flow_steps() -> dict[str, Column]:
    """States of the three steps from a status row with progress, dancers, frames_done, frames_total."""
    state = F.coalesce("state", F.lit("queued"))
    p = F.coalesce("progress", F.lit(0.0))
    done, busy = state == "succeeded", state == "processing"
    dancers = F.when(F.col("dancers").isNotNull() | done, "done").when(busy & (p >= 0.1), "now").otherwise("wait")
    frames = F.col("frames_done").isNotNull() & (F.coalesce("frames_total", F.lit(0)) > 0)
    body = F.when(done, "done").when(frames | (busy & (p >= 0.95)), "now").otherwise("wait")
    return {"clip_step": F.lit("done"), "dancers_step": dancers, "body_step": body}


def my_lessons(opens: DataFrame, user: str, lesson: str, at: str, thumb: str, keep: int = 50) -> DataFrame:
    """Newest ``keep`` lessons per user; a lesson opened again keeps its last known thumbnail.

    Aggregated per (user, lesson) first; the ranked filter is a top-k that Spark
    also applies before the shuffle.
    """
    one = opens.groupBy(user, lesson).agg(F.max(at).alias("last_opened"), F.max_by(thumb, F.when(F.col(thumb).isNotNull(), F.col(at))).alias("thumb"))
    rank = F.row_number().over(W.partitionBy(user).orderBy(F.col("last_opened").desc(), F.col(lesson)))
    return one.withColumn("place", rank).filter(F.col("place") <= keep)


def latest_labels(labels: DataFrame, clip: str = "clip_id", at: str = "at") -> DataFrame:
    """Latest owner label per clip from the append-only label log."""
    return labels.groupBy(clip).agg(F.max_by(F.struct(*[c for c in labels.columns if c != clip]), at).alias("_l")).select(clip, "_l.*")
