"""Event analytics: batch parsing, allowlist, visitor hashes, caps, reports, roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import hashes
from . import ordered

# The limits of one client batch and the per-visitor daily cap.
MAX_BODY_BYTES = 16 * 1024
MAX_BATCH = 50
DAILY_CAP = 2000
FORWARD_DAILY_CAP = 30000
UNCOUNTED = ("dispatch", "removal")  # limiter rows carry another hash
SERVER_NAMES = ("job_created", "job_finished")

# The allowlist, name -> prop -> rule.
#   ("host",) | ("num", lo, hi, integer) | ("bool",) | ("enum", options...)
VIEWS = ("overlay", "video", "front", "side", "back", "top", "hands", "feet")
ALLOWLIST: dict[str, dict[str, tuple]] = {
    "lesson_opened": {"ref": ("host",)},
    "play_seconds": {"seconds": ("num", 1, 30, True)},
    "loop_created": {"counts": ("num", 0.5, 2000, False), "start": ("num", 0, 2000, False), "snapped": ("bool",),
                     "via": ("enum", "drag", "count", "marker", "preset", "step", "handoff", "other")},
    "speed_changed": {"speed": ("num", 0.1, 2, False)},
    "build_up_toggled": {"on": ("bool",)},
    "click_toggled": {"on": ("bool",), "mode": ("enum", "counts", "ands")},
    "view_toggled": {"view": ("enum", *VIEWS), "on": ("bool",)},
    "tap_on_one": {},
    "count_one_nudged": {"by": ("num", -8, 8, False)},
    "count_one_alternate": {"shift": ("num", -16, 16, False)},
    "dancer_picked": {"persons": ("num", 1, 20, True), "index": ("num", 0, 19, True)},
    "link_copied": {},
}
CORRECTIONS = ("tap_on_one", "count_one_nudged", "count_one_alternate")
LESSON_RULE = "^[A-Za-z0-9_-]{1,64}$"


def client_items(batches: DataFrame, body: str = "body", max_body_bytes: int = MAX_BODY_BYTES, max_batch: int = MAX_BATCH) -> DataFrame:
    """Explode JSON-array bodies into (pos, name, props, lesson). What the ingest rule leaves out is counted by ``rejected``.

    ``props`` is a VARIANT so that JSON types survive to validation.
    """
    parsed = F.try_parse_json(F.when(F.octet_length(body) <= max_body_bytes, F.col(body)))
    items = F.slice(F.try_variant_get(parsed, "$", "array<variant>"), 1, max_batch)

    def text(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    # Fields are read before the explode, so later rules look at plain columns
    # instead of digging into the variant again.
    fields = F.transform(items, lambda i: F.struct(
        F.schema_of_variant(i).startswith("OBJECT").alias("object"), text(F.try_variant_get(i, "$.name", "variant")).alias("name"),
        F.try_variant_get(i, "$.props", "variant").alias("props"), text(F.try_variant_get(i, "$.lesson", "variant")).alias("lesson")))
    rest = [c for c in batches.columns if c != body]
    flat = batches.select(*rest, F.posexplode(fields).alias("pos", "_item"))
    return flat.filter("_item.object").select(*rest, "pos", "_item.name", "_item.props", "_item.lesson")


def rejected(batches: DataFrame, body: str = "body", max_body_bytes: int = MAX_BODY_BYTES, max_batch: int = MAX_BATCH) -> DataFrame:
    """reason, bodies, items: what ``client_items`` leaves out by rule - bodies too large or no array, items past the batch limit."""
    large = F.octet_length(body) > max_body_bytes
    n = F.size(F.try_variant_get(F.try_parse_json(F.when(~large, F.col(body))), "$", "array<variant>"))
    over = F.greatest(F.coalesce(n, F.lit(0)) - max_batch, F.lit(0))
    reason = F.when(large, "body too large").when(n.isNull(), "no array").when(over > 0, "past the batch limit")
    return batches.select(reason.alias("reason"), over.cast("bigint").alias("_n")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("bodies"), F.sum("_n").alias("items"))


def _prop(props: Column | str, key: str) -> Column:
    return F.try_variant_get(props, f"$.{key}", "variant")


def _checked(value: Column, rule: tuple) -> tuple[Column, Column]:
    """(valid, cleaned as VARIANT-compatible JSON scalar) for one prop value."""
    kind = F.schema_of_variant(value)
    if rule[0] == "host":
        text = F.lower(F.trim(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("none"))))
        return (text == "") | text.rlike("^[a-z0-9.-]{1,253}$"), F.to_json(F.struct(text.alias("x")))
    if rule[0] == "bool":
        b = F.try_variant_get(value, "$", "boolean")
        return kind == "BOOLEAN", F.to_json(F.struct(b.alias("x")))
    if rule[0] == "enum":
        s = F.try_variant_get(value, "$", "string")
        return (kind == "STRING") & s.isin(*rule[1:]), F.to_json(F.struct(s.alias("x")))
    _, lo, hi, integer = rule
    number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    d = F.try_variant_get(value, "$", "double")
    out = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)) if integer else F.bround(d, 2)
    return number & d.between(float(lo), float(hi)), F.to_json(F.struct(out.alias("x")))


def validate_events(items: DataFrame) -> DataFrame:
    """Keep allowlisted events with clean props (JSON text, keys in rule order); bad lesson ids become null.

    The rules are constants, so each becomes an expression: no explode, no join, no shuffle.
    """
    shape = F.schema_of_variant("props")
    # Nothing, false, zero, and an empty text, list or object count as no props; a text that spells one of them does not.
    number = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL")
    empty = (F.col("props").isNull() | (shape == "VOID") | (shape == "OBJECT<>")
             | F.coalesce((shape == "BOOLEAN") & ~F.try_variant_get("props", "$", "boolean"), F.lit(False))
             | F.coalesce(number & (F.try_variant_get("props", "$", "double") == 0), F.lit(False))
             | F.coalesce((shape == "STRING") & (F.try_variant_get("props", "$", "string") == ""), F.lit(False))
             | F.coalesce((shape == "ARRAY<VOID>") & (F.size(F.try_variant_get("props", "$", "array<variant>")) == 0), F.lit(False)))
    obj = empty | shape.startswith("OBJECT")
    bodies, checks = [], F.lit(False)
    for name, rules in ALLOWLIST.items():
        ok, parts = F.lit(True), []
        for key, rule in rules.items():
            value = _prop("props", key)
            good, clean = _checked(value, rule)
            ok = ok & (value.isNull() | F.coalesce(good, F.lit(False)))
            # to_json gives {"x":v}; keep the scalar's own JSON text.
            parts.append(F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), F.regexp_replace(clean, r'^\{"x":(.*)\}$', "$1"))))
        body = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ",") if parts else F.lit(""), F.lit("}"))
        bodies.append(F.when((F.col("name") == name), body))
        checks = checks | ((F.col("name") == name) & ok)
    return (items.filter(F.col("name").isin(*ALLOWLIST) & obj & checks)
            .withColumn("lesson", F.when(F.col("lesson").rlike(LESSON_RULE), F.col("lesson")))
            .withColumn("props", F.coalesce(*bodies)))


# -- visitors ---------------------------------------------------------------

def salt_pads(salts: DataFrame) -> DataFrame:
    """Per-day HMAC pads from (day, salt); one row per day."""
    return salts.withColumn("_pads", hashes.hmac_pads(F.col("salt"))).select(
        "day", F.col("_pads.inner").alias("_inner"), F.col("_pads.outer").alias("_outer"))


def visitor_hash(rows: DataFrame, salts: DataFrame, at: str, ip: str, user_agent: str) -> DataFrame:
    """Add ``day_hash`` = HMAC-SHA256(salt of the UTC day, ip|user agent).

    The salt table is keyed by day, so the broadcast side holds one short row per
    day of history whatever the log's size, and the log is never shuffled by day.
    """
    message = F.concat(F.col(ip), F.lit("|"), F.coalesce(F.col(user_agent), F.lit(""))).cast("binary")
    pads = F.struct(F.col("_inner").alias("inner"), F.col("_outer").alias("outer"))
    return (rows.withColumn("_day", F.to_date(at)).join(
        F.broadcast(salt_pads(salts.dropDuplicates(["day"])).withColumnRenamed("day", "_day")), "_day", "left")
            .withColumn("day_hash", hashes.hmac_sha256(pads, message)).drop("_day", "_inner", "_outer"))


def rotate_salts(existing: DataFrame, days: DataFrame, today: Column) -> DataFrame:
    """Salt table after rotation: past days dropped, a random salt for each new day."""
    fresh = days.select("day").distinct().join(existing.select("day"), "day", "left_anti").withColumn(
        "salt", F.unhex(F.sha2(F.concat(*[F.uuid() for _ in range(4)]).cast("binary"), 256)))
    return existing.unionByName(fresh).filter(F.col("day") >= today)


def daily_cap(log: DataFrame, cap: int = DAILY_CAP, visitor: str = "visitor", at: str = "occurred_at",
              tie: str = "id", width_s: float = 3600.0, names: Sequence[str] | None = None) -> DataFrame:
    """First ``cap`` rows per visitor and UTC day; adds ``nth`` (1-based).

    ``names`` limits the count to those event names (others are not client events and drop out).
    """
    rows = log if names is None else log.filter(F.col("name").isin(*names))
    rows = rows.withColumn("_day", F.to_date(at)).withColumn("_t", ordered.seconds(at))
    done = ordered.dense_index(rows, [visitor, "_day"], ["_t", tie], ordered.time_bucket("_t", width_s), idx="_i")
    return done.withColumn("nth", F.col("_i") + 1).filter(F.col("nth") <= cap).drop("_day", "_t", "_i")


def forward_gate(log: DataFrame, cap: int = FORWARD_DAILY_CAP, at: str = "occurred_at", tie: str = "id",
                 width_s: float = 600.0, before: DataFrame | None = None) -> DataFrame:
    """Rows that may be forwarded: the day's running total, this row included, is within the cap.

    ``before`` (day, n) holds what earlier batches of the day had; a row per day.
    """
    rows = log.withColumn("_day", F.to_date(at)).withColumn("_t", ordered.seconds(at))
    done = ordered.dense_index(rows, ["_day"], ["_t", tie], ordered.time_bucket("_t", width_s), idx="_i")
    if before is not None:
        done = done.join(before.select(F.col("day").alias("_day"), F.col("n").alias("_n")), "_day", "left")
    had = F.lit(0) if before is None else F.coalesce("_n", F.lit(0))
    return done.withColumn("today", F.col("_i") + 1 + had).filter(F.col("today") <= cap).drop("_day", "_t", "_i", "_n")


def forward_payload(log: DataFrame) -> DataFrame:
    """One JSON document per event for the analytics vendor: no IP, no geo, no person profile.

    Values keep their JSON types: a quoted "false" would switch a privacy flag on.
    """
    none = F.expr("cast(map() as map<string,variant>)")
    props = F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$", "map<string,variant>"), none)
    fixed = F.create_map(F.lit("$process_person_profile"), F.parse_json(F.lit("false")), F.lit("$geoip_disable"), F.parse_json(F.lit("true")),
                         F.lit("$ip"), F.parse_json(F.lit("null")))
    lesson = F.when(F.coalesce(F.col("job_id"), F.lit("")) != "", F.create_map(F.lit("lesson"), F.col("job_id").cast("variant"))).otherwise(none)
    replaced = F.concat(F.map_keys(lesson), F.map_keys(fixed))
    merged = F.map_from_entries(F.concat(F.filter(F.map_entries(props), lambda e: ~F.array_contains(replaced, e["key"])), F.map_entries(lesson), F.map_entries(fixed)))
    return log.withColumn("payload", F.to_json(F.struct(
        F.col("name").alias("event"), F.coalesce("visitor", "job_id").alias("distinct_id"),
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), merged.alias("properties")),
        {"ignoreNullFields": "false"}))


# -- reports ----------------------------------------------------------------

def prop(key: str, kind: str = "string") -> Column:
    raw = F.get_json_object("props", f"$.{key}")
    return raw if kind == "string" else raw.cast(kind)


def _day(at: str = "occurred_at") -> Column:
    return F.to_date(at).alias("day")


def visitors_exact(log: DataFrame, by: Sequence[Column], value: Column, name: str = "visitors") -> DataFrame:
    """Exact distinct counts in two map-side-combined steps: dedupe, then count."""
    names = [f"_g{i}" for i in range(len(by))]
    slim = log.select(*[c.alias(n) for c, n in zip(by, names)], value.alias("_v")).distinct()
    return slim.groupBy(*names).agg(F.count("_v").alias(name))


def report_daily(log: DataFrame, rolled: DataFrame | None = None) -> DataFrame:
    """Visitors, uploads, non-deduplicated runs, finished and succeeded jobs per day."""
    dedup = F.coalesce(prop("deduplicated", "boolean"), F.lit(False))
    name = F.col("name")
    # Per (day, visitor) first: the distinct count then is a plain count of groups.
    per = log.groupBy(_day(), "visitor").agg(
        F.count_if(~name.isin(*UNCOUNTED)).alias("_seen"), F.count_if(name == "job_created").alias("uploads"),
        F.count_if((name == "job_created") & ~dedup).alias("gpu_runs"),
        F.count_if(name == "job_finished").alias("finished"),
        F.count_if((name == "job_finished") & (prop("state") == "succeeded")).alias("succeeded"))
    sums = ("uploads", "gpu_runs", "finished", "succeeded")
    live = per.groupBy("day").agg(F.count_if((F.col("_seen") > 0) & F.col("visitor").isNotNull()).alias("visitors"),
                                  *[F.sum(c).alias(c) for c in sums])
    if rolled is None:
        return live
    n, detail = F.col("n"), F.col("detail")
    old = rolled.groupBy("day").agg(
        F.sum(F.when(name == "_visitors", F.col("visitors"))).alias("visitors"),
        F.sum(F.when(name == "job_created", n)).alias("uploads"),
        F.sum(F.when((name == "job_created") & (detail == ""), n)).alias("gpu_runs"),
        F.sum(F.when(name == "job_finished", n)).alias("finished"),
        F.sum(F.when((name == "job_finished") & detail.startswith("succeeded"), n)).alias("succeeded"))
    return live.unionByName(old)


def report_events(log: DataFrame, rolled: DataFrame | None = None) -> DataFrame:
    """Events and exact visitors per day and name."""
    live = (log.filter(~F.col("name").isin(*UNCOUNTED)).groupBy(_day(), "name", "visitor").agg(F.count("*").alias("_n"))
            .groupBy("day", "name").agg(F.sum("_n").alias("events"), F.count("visitor").alias("visitors")))
    if rolled is None:
        return live
    old = rolled.filter(~F.col("name").isin(*UNCOUNTED, "_visitors")).groupBy("day", "name").agg(
        F.sum("n").alias("events"), F.sum("visitors").alias("visitors"))
    return live.unionByName(old)


def report_failures(log: DataFrame, rolled: DataFrame | None = None) -> DataFrame:
    live = (log.filter((F.col("name") == "job_finished") & (prop("state") == "failed"))
            .groupBy(_day(), F.coalesce(prop("error_code"), F.lit("(none)")).alias("error_code"))
            .agg(F.count("*").alias("jobs")))
    if rolled is None:
        return live
    code = F.coalesce(F.nullif(F.split_part("detail", F.lit(":"), F.lit(2)), F.lit("")), F.lit("(none)"))
    old = rolled.filter((F.col("name") == "job_finished") & F.col("detail").startswith("failed")).groupBy(
        "day", code.alias("error_code")).agg(F.sum("n").alias("jobs"))
    return live.unionByName(old)


def report_loops(log: DataFrame) -> DataFrame:
    return log.filter(F.col("name") == "loop_created").groupBy(
        _day(), prop("via").alias("via"), prop("snapped", "boolean").alias("snapped"),
        prop("counts", "double").alias("counts")).agg(F.count("*").alias("loops"))


def report_lesson_visits(log: DataFrame) -> DataFrame:
    """One row per visitor, lesson and day that opened the lesson, without the visitor."""
    name = F.col("name")
    return (log.filter(F.col("job_id").isNotNull() & ~name.isin(*UNCOUNTED, *SERVER_NAMES))
            .groupBy(_day(), "visitor", F.col("job_id").alias("lesson"))
            .agg(F.bool_or(name == "lesson_opened").alias("_opened"),
                 F.coalesce(F.sum(F.when(name == "play_seconds", prop("seconds", "int"))), F.lit(0)).alias("play_seconds"),
                 F.bool_or(name.isin(*CORRECTIONS)).alias("corrected_count_one"))
            .filter("_opened").select("day", "lesson", "play_seconds", "corrected_count_one"))


def report_referrers(log: DataFrame) -> DataFrame:
    return log.filter(F.col("name") == "lesson_opened").groupBy(
        _day(), F.coalesce(F.nullif(prop("ref"), F.lit("")), F.lit("(direct)")).alias("host")).agg(
        F.count("*").alias("opens"))


# -- roll-up ----------------------------------------------------------------

def rollup_cutoff(now: Column, months: int = 13) -> Column:
    """Midnight of the day ``months`` before now: only whole days fold."""
    return F.date_trunc("day", F.add_months(now, -months).cast("timestamp"))


def detail_key() -> Column:
    """state:error_code for finishes, 'deduplicated' for deduplicated uploads, else ''."""
    name = F.col("name")
    return (F.when(name == "job_finished", F.concat(F.coalesce(prop("state"), F.lit("")), F.lit(":"),
                                                    F.coalesce(prop("error_code"), F.lit(""))))
            .when((name == "job_created") & prop("deduplicated", "boolean"), "deduplicated").otherwise(""))


def rollup(log: DataFrame, cutoff: Column, existing: DataFrame | None = None) -> DataFrame:
    """Fold whole days before ``cutoff`` into (day, name, detail, n, visitors, seconds).

    The ``_visitors`` row counts a day's distinct visitors across all counted
    events. Keys already in ``existing`` are left alone, so a rerun adds nothing.
    Both levels come from one pass: rows are first reduced to
    (day, name, detail, visitor), and that small table feeds both.
    """
    old = log.filter(F.col("occurred_at") < cutoff)
    per = old.groupBy(_day(), "name", detail_key().alias("detail"), "visitor").agg(
        F.count("*").alias("_n"), F.sum(prop("seconds", "decimal(38,6)")).alias("_s"))
    by_name = per.groupBy("day", "name", "detail").agg(
        F.sum("_n").alias("n"), F.count("visitor").alias("visitors"), F.sum("_s").cast("decimal(38,6)").alias("seconds"))
    by_day = (per.filter(~F.col("name").isin(*UNCOUNTED)).groupBy("day", "visitor").agg(F.sum("_n").alias("_n"))
              .groupBy("day").agg(F.sum("_n").alias("n"), F.count("visitor").alias("visitors"))
              .select("day", F.lit("_visitors").alias("name"), F.lit("").alias("detail"), "n", "visitors",
                      F.lit(None).cast("decimal(38,6)").alias("seconds")))
    out = by_name.unionByName(by_day)
    return out if existing is None else out.join(existing, ["day", "name", "detail"], "left_anti")


def late_for_rollup(log: DataFrame, rolled: DataFrame) -> DataFrame:
    """Events whose day is already folded, counted per key instead of silently dropped."""
    days = rolled.select("day").distinct()
    return (log.withColumn("day", F.to_date("occurred_at")).join(days, "day", "left_semi")
            .groupBy("day", "name", detail_key().alias("detail")).agg(F.count("*").alias("late")))


# -- limits -----------------------------------------------------------------

def window_load(rows: DataFrame, keys: Sequence[str], t: str, tie: str, spans_s: dict[str, float],
                width_s: float) -> DataFrame:
    """For each row, how many rows of its key lie in (t - span, t) and the oldest of them.

    Counts come from index differences: the row's own position minus the position
    of the last row at or before t - span, found by an as-of lookup. No frame is
    ever materialised, so the span may hold any number of rows.
    """
    by = list(keys)
    bucket = ordered.time_bucket(t, width_s)
    out = ordered.dense_index(rows, by, [t, tie], bucket, idx="_pos")
    # Each mark says: rows up to here are gone, the next one is the oldest left. A
    # mark before everything stands for "nothing is gone".
    slim = ordered.dense_index(rows.select(*by, t, tie), by, [t, tie], bucket, idx="_gone")
    marks = ordered.row_frames(slim, by, 1, lambda frame: {"_oldest": F.lead(t).over(frame(None, None))}, idx="_gone").select(
        *by, F.col(t).alias("_at"), "_gone", "_oldest")
    start = rows.groupBy(*by).agg(F.min(t).alias("_oldest")).select(
        *by, (F.col("_oldest") - max(spans_s.values()) - 1).alias("_at"), F.lit(-1).cast("bigint").alias("_gone"), "_oldest")
    marks = marks.unionByName(start)
    for name, span in spans_s.items():
        probe = out.withColumn("_at", F.col(t) - F.lit(float(span)))
        probe = ordered.asof(probe, marks, by, "_at", ["_gone", "_oldest"], width_s, tie=["_gone"], out="_past")
        n = F.col("_pos") - F.col("_past._gone") - 1
        out = probe.withColumn(f"n_{name}", n).withColumn(f"oldest_{name}", F.when(n > 0, F.col("_past._oldest"))).drop("_past", "_at")
    return out.drop("_pos")


# Limits per address and for everybody, and the shortest wait told.
IP_HOUR, IP_DAY, GLOBAL_DAY, REMOVALS_DAY, MIN_WAIT_S = 5, 20, 200, 5, 60


def retry_after(t: Column, oldest: Column, hours: int, until_midnight: bool) -> Column:
    """Whole seconds until the oldest counted row leaves the window, at least a minute."""
    free = F.coalesce(oldest, t) + hours * 3600
    if until_midnight:
        free = F.least(free, (F.floor(t / 86400) + 1) * 86400)
    return F.greatest(F.lit(MIN_WAIT_S).cast("bigint"), F.floor(free - t))


def once_only(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``, by a map-side-combined aggregate."""
    rest = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.min_by(rest, F.struct(*order)).alias("_r")).select("_r.*")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in ``order``."""
    rest = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(rest, F.struct(*order)).alias("_r")).select("_r.*")


def insert_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First write wins: rows to append for keys the table does not have yet."""
    return once_only(incoming.join(existing.select(*keys), list(keys), "left_anti"), keys, order)


def play_buckets(plays: DataFrame, visitor: str, lesson: str, t: str, tie: str, seconds: str,
                 width_s: float = 3600.0, size: int = 30) -> DataFrame:
    """Playing time as whole buckets of ``size`` seconds, the rest flushed at each change of lesson.

    The whole buckets of a visitor's unbroken run on a lesson are those of its total, which is taken to
    the microsecond: a sum that falls short of a bucket by rounding alone still fills it.
    """
    order = [t, tie]
    rows = plays.withColumn("_s", F.greatest(F.lit(0.0), F.col(seconds).cast("double")))
    prev = ordered.carry_last(rows, [visitor], order, ordered.time_bucket(t, width_s),
                              {"_before": F.col(lesson)}, strict=True)
    change = F.when(F.col("_before").isNull() | (F.col("_before") != F.col(lesson)), 1).otherwise(0)
    runs = ordered.running_sum(prev, [visitor], order, ordered.time_bucket(t, width_s), {"_run": change})
    per = runs.groupBy(visitor, "_run", lesson).agg(F.round(F.sum("_s"), 6).alias("_all"), F.min(t).alias("from_t"))
    per = per.withColumn("buckets", F.floor(F.col("_all") / size).cast("bigint"))
    rest = F.floor(F.col("_all") - F.floor(F.col("_all") / size) * size + 0.5).cast("bigint")
    return per.withColumn("rest_s", F.when(rest >= 1, F.least(rest, F.lit(size))).otherwise(0)).drop("_all", "_run")


def lockouts(failures: DataFrame, key: str, t: str, tie: str, window_s: float = 600.0, limit: int = 10,
             width_s: float = 3600.0) -> DataFrame:
    """Failures with the number of failures in the last ``window_s`` and whether the key is locked out."""
    done = window_load(failures, [key], t, tie, {"recent": window_s}, width_s)
    return done.withColumn("recent", F.col("n_recent") + 1).withColumn(
        "locked", F.col("recent") >= limit).drop("n_recent", "oldest_recent")
