"""Event analytics and limits over the driver's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev, limits, ordered
from ..session import scratch
from ..streaming import limits as stream_rules
from .base import EV, LOG, event_log, events, query

CUT = "2024-01-16"


def _text_day(df):
    return df.withColumn("day", F.col("day").cast("string"))


def _longs(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


DAILY = """SELECT CAST(d AS VARCHAR) AS day, CAST(count(DISTINCT visitor) FILTER (WHERE name NOT IN ('dispatch', 'removal')) AS BIGINT) AS visitors,
  CAST(count(*) FILTER (WHERE name = 'job_created') AS BIGINT) AS uploads,
  CAST(count(*) FILTER (WHERE name = 'job_created' AND NOT dedup) AS BIGINT) AS gpu_runs,
  CAST(count(*) FILTER (WHERE name = 'job_finished') AS BIGINT) AS finished,
  CAST(count(*) FILTER (WHERE name = 'job_finished' AND state = 'succeeded') AS BIGINT) AS succeeded FROM logx GROUP BY 1"""


@query("report_daily", f"WITH {LOG} {DAILY}")
def report_daily(spark, d):
    return _text_day(ev.report_daily(event_log(spark, d)))


@query("report_events", f"""WITH {LOG} SELECT CAST(d AS VARCHAR) AS day, name, count(*) AS events,
  count(DISTINCT visitor) AS visitors FROM logx WHERE name NOT IN ('dispatch', 'removal') GROUP BY 1, 2""")
def report_events(spark, d):
    return _text_day(ev.report_events(event_log(spark, d)))


@query("report_failures", f"""WITH {LOG} SELECT CAST(d AS VARCHAR) AS day, coalesce(error_code, '(none)') AS error_code,
  count(*) AS jobs FROM logx WHERE name = 'job_finished' AND state = 'failed' GROUP BY 1, 2""")
def report_failures(spark, d):
    return _text_day(ev.report_failures(event_log(spark, d)))


@query("report_loops", f"""WITH {LOG} SELECT CAST(d AS VARCHAR) AS day, (['drag', 'count', 'marker'])[k % 3 + 1] AS via,
  k % 2 = 0 AS snapped, CAST(k % 8 + 0.5 AS DOUBLE) AS counts, count(*) AS loops
  FROM logx WHERE name = 'loop_created' GROUP BY 1, 2, 3, 4""")
def report_loops(spark, d):
    return _text_day(ev.report_loops(event_log(spark, d)))


@query("report_referrers", f"""WITH {LOG} SELECT CAST(d AS VARCHAR) AS day,
  CASE WHEN k % 3 = 0 THEN '(direct)' ELSE 'site' || (k % 7) || '.example.com' END AS host, count(*) AS opens
  FROM logx WHERE name = 'lesson_opened' GROUP BY 1, 2""")
def report_referrers(spark, d):
    return _text_day(ev.report_referrers(event_log(spark, d)))


@query("lesson_visits", f"""WITH {LOG}, v AS (SELECT d, visitor, job_id, bool_or(name = 'lesson_opened') AS opened,
  CAST(coalesce(sum(1 + k % 30) FILTER (WHERE name = 'play_seconds'), 0) AS BIGINT) AS play_seconds,
  bool_or(name = 'tap_on_one') AS corrected FROM logx
  WHERE name NOT IN ('dispatch', 'removal', 'job_created', 'job_finished') GROUP BY 1, 2, 3)
  SELECT CAST(d AS VARCHAR) AS day, job_id AS lesson, play_seconds, corrected AS corrected_count_one FROM v WHERE opened""")
def lesson_visits(spark, d):
    return _text_day(ev.report_lesson_visits(event_log(spark, d)))


ROLL = """roll AS (SELECT d, name, CASE WHEN name = 'job_finished' THEN state || ':' || coalesce(error_code, '')
    WHEN dedup THEN 'deduplicated' ELSE '' END AS detail, count(*) AS n, count(DISTINCT visitor) AS visitors,
    CAST(sum(CASE WHEN name IN ('job_created', 'play_seconds') THEN 1 + k % 30 END) AS DOUBLE) AS seconds
  FROM logx WHERE occurred_at < TIMESTAMP '2024-01-16' GROUP BY 1, 2, 3
  UNION ALL SELECT d, '_visitors', '', count(*), count(DISTINCT visitor), NULL FROM logx
  WHERE occurred_at < TIMESTAMP '2024-01-16' AND name NOT IN ('dispatch', 'removal') GROUP BY 1)"""


def _rolled(log):
    return ev.rollup(log, F.lit(CUT).cast("timestamp"))


@query("rollup_daily", f"WITH {LOG}, {ROLL} SELECT CAST(d AS VARCHAR) AS day, name, detail, n, visitors, seconds FROM roll")
def rollup_daily(spark, d):
    return _text_day(_rolled(event_log(spark, d))).withColumn("seconds", F.col("seconds").cast("double"))


# A rolled-up day with no row of a kind reports null, as a filtered sum does; a live day reports 0.
_OLD = ", ".join(f"CASE WHEN day < '{CUT}' THEN nullif({c}, 0) ELSE {c} END AS {c}" for c in ("visitors", "uploads", "gpu_runs", "finished", "succeeded"))


@query("rollup_union", f"WITH {LOG}, daily AS ({DAILY}) SELECT day, {_OLD} FROM daily")
def rollup_union(spark, d):
    log = event_log(spark, d)
    live = log.filter(F.col("occurred_at") >= F.lit(CUT).cast("timestamp"))
    out = ev.report_daily(live, _rolled(log))
    return _text_day(_longs(out, "visitors", "uploads", "gpu_runs", "finished", "succeeded"))


@query("rollup_failures_union", f"""WITH {LOG} SELECT CAST(d AS VARCHAR) AS day, coalesce(error_code, '(none)') AS error_code,
  count(*) AS jobs FROM logx WHERE name = 'job_finished' AND state = 'failed' GROUP BY 1, 2""")
def rollup_failures_union(spark, d):
    log = event_log(spark, d)
    live = log.filter(F.col("occurred_at") >= F.lit(CUT).cast("timestamp"))
    return _text_day(_longs(ev.report_failures(live, _rolled(log)), "jobs"))


@query("rollup_events_union", f"""WITH {LOG} SELECT CAST(d AS VARCHAR) AS day, name, count(*) AS events FROM logx
  WHERE name NOT IN ('dispatch', 'removal') GROUP BY 1, 2""")
def rollup_events_union(spark, d):
    log = event_log(spark, d)
    live = log.filter(F.col("occurred_at") >= F.lit(CUT).cast("timestamp"))
    return _text_day(_longs(ev.report_events(live, _rolled(log)).drop("visitors"), "events"))


@query("rollup_rerun_is_empty", "SELECT CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS n WHERE false")
def rollup_rerun_is_empty(spark, d):
    log = event_log(spark, d)
    cut = F.lit(CUT).cast("timestamp")
    return ev.rollup(log, cut, existing=ev.rollup(log, cut)).select("name", "n")


@query("late_for_rollup", f"""WITH {LOG} SELECT CAST(d AS VARCHAR) AS day, name, count(*) AS late FROM logx
  WHERE d < DATE '2024-01-16' GROUP BY 1, 2""")
def late_for_rollup(spark, d):
    log = event_log(spark, d)
    out = ev.late_for_rollup(log, _rolled(log)).groupBy("day", "name").agg(F.sum("late").alias("late"))
    return _text_day(out)


@query("validate_events", f"""WITH {EV}, b AS (SELECT *, k % 12 AS m FROM ev)
  SELECT event_id, CASE WHEN m = 0 THEN 'lesson_opened' WHEN m = 1 THEN 'play_seconds' WHEN m IN (2, 3) THEN 'loop_created'
      WHEN m = 5 THEN 'click_toggled' WHEN m = 6 THEN 'view_toggled' WHEN m = 7 THEN 'tap_on_one'
      WHEN m = 8 THEN 'count_one_nudged' ELSE 'dancer_picked' END AS name,
    CASE WHEN m = 0 THEN '{{"ref":"site' || (k % 7) || '.example.com"}}'
      WHEN m = 1 THEN '{{"seconds":' || k || '}}'
      WHEN m = 2 THEN '{{"counts":' || (k / 4) || ',"snapped":true,"via":"drag"}}'
      WHEN m = 3 THEN '{{"snapped":false,"via":"other"}}'
      WHEN m = 5 THEN '{{"on":false,"mode":"ands"}}'
      WHEN m = 6 THEN '{{"view":"feet","on":true}}' WHEN m = 7 THEN '{{}}'
      WHEN m = 8 THEN '{{"by":' || CAST(k % 9 - 4 AS DOUBLE) || '}}' ELSE '{{"persons":' || (k % 21) || ',"index":' || (k % 20) || '}}' END AS props,
    CASE WHEN k % 10 < 8 THEN 'job_' || (k % 20) END AS lesson
  FROM b WHERE m IN (0, 1, 2, 3, 5, 6, 7, 8, 9) AND (m <> 1 OR (k >= 1 AND k <= 30)) AND (m <> 2 OR (k / 4.0) >= 0.5)
    AND (m <> 9 OR k % 21 >= 1)""")
def validate_events(spark, d):
    """Client batches of one item, rebuilt from ``k``; some break each rule of the allowlist."""
    e = events(spark, d)
    k, m = F.col("k"), F.col("k") % 12
    s = lambda c: c.cast("string")

    def cat(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    item = (F.when(m == 0, cat('"name":"lesson_opened","props":{"ref":" Site', s(k % 7), '.EXAMPLE.com ","junk":1}'))
            .when(m == 1, cat('"name":"play_seconds","props":{"seconds":', s(k), '}'))
            .when(m == 2, cat('"name":"loop_created","props":{"via":"drag","snapped":true,"counts":', s(k / 4), '}'))
            .when(m == 3, cat('"name":"loop_created","props":{"via":"other","snapped":false}'))
            .when(m == 4, cat('"name":"loop_created","props":{"via":"other","snapped":1}'))
            .when(m == 5, cat('"name":"click_toggled","props":{"on":false,"mode":"ands"}'))
            .when(m == 6, cat('"name":"view_toggled","props":{"view":"feet","on":true}'))
            .when(m == 7, cat('"name":"tap_on_one","props":{"x":{"y":1}}'))
            .when(m == 8, cat('"name":"count_one_nudged","props":{"by":', s(k % 9 - 4), '}'))
            .when(m == 9, cat('"name":"dancer_picked","props":{"persons":', s(k % 21), ',"index":', s(k % 20), '}'))
            .when(m == 10, cat('"name":"view_toggled","props":{"view":"left"}'))
            .otherwise(cat('"name":"made_up","props":{}')))
    lesson = F.when(k % 10 < 8, cat('"job_', s(k % 20), '"')).when(k % 10 == 8, F.lit('"bad id!"')).otherwise(F.lit("7"))
    body = cat("[{", item, ',"lesson":', lesson, "}]")
    batches = e.select("event_id", body.alias("body"))
    return ev.validate_events(ev.client_items(batches)).select("event_id", "name", "props", "lesson")


HM = """(SELECT string_agg(substr('{hi}', CAST(strpos('0123456789ABCDEF', substr(hx, 2 * i + 1, 1)) AS BIGINT), 1) ||
  substr('{lo}', CAST(strpos('0123456789ABCDEF', substr(hx, 2 * i + 2, 1)) AS BIGINT), 1), '' ORDER BY i) FROM range(0, 64) r(i))"""


@query("visitor_hash", f"""WITH {EV}, days AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM ev),
  keys AS (SELECT d, rpad(upper(sha256('salt ' || CAST(d AS VARCHAR))), 128, '0') AS hx FROM days),
  pads AS (SELECT d, string_agg(CASE WHEN true THEN substr('32107654BA98FEDC', CAST(strpos('0123456789ABCDEF', substr(hx, CAST(2 * i + 1 AS BIGINT), 1)) AS BIGINT), 1)
        || substr('67452301EFCDAB89', CAST(strpos('0123456789ABCDEF', substr(hx, CAST(2 * i + 2 AS BIGINT), 1)) AS BIGINT), 1) END, '' ORDER BY i) AS ip,
      string_agg(substr('54761032DCFE98BA', CAST(strpos('0123456789ABCDEF', substr(hx, CAST(2 * i + 1 AS BIGINT), 1)) AS BIGINT), 1)
        || substr('CDEF89AB45670123', CAST(strpos('0123456789ABCDEF', substr(hx, CAST(2 * i + 2 AS BIGINT), 1)) AS BIGINT), 1), '' ORDER BY i) AS op
    FROM keys, range(0, 64) r(i) GROUP BY d)
  SELECT event_id, sha256(unhex(op) || unhex(sha256(unhex(ip) || CAST('10.0.0.' || user_id || '|' || event_type AS BLOB)))) AS day_hash
  FROM ev JOIN pads ON pads.d = CAST(ev.ts AS DATE)""")
def visitor_hash(spark, d):
    """Keyed hash of address and agent; the day's salt is derived here so SQL can repeat it."""
    e = events(spark, d).withColumn("ip", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")))
    salts = e.select(F.to_date("ts").alias("day")).distinct().withColumn(
        "salt", F.unhex(F.sha2(F.concat(F.lit("salt "), F.col("day").cast("string")).cast("binary"), 256)))
    out = ev.visitor_hash(e, salts, "ts", "ip", "event_type")
    return out.select("event_id", F.lower(F.hex("day_hash")).alias("day_hash"))


@query("daily_cap", f"""WITH {LOG} SELECT id, visitor, CAST(row_number() OVER (PARTITION BY visitor, d ORDER BY t, id) AS BIGINT) AS nth
  FROM logx QUALIFY nth <= 3""")
def daily_cap(spark, d):
    return ev.daily_cap(event_log(spark, d), cap=3).select("id", "visitor", "nth")


@query("forward_gate", f"""WITH {LOG} SELECT id, CAST(row_number() OVER (PARTITION BY d ORDER BY t, id) AS BIGINT) AS today
  FROM logx QUALIFY today <= 200""")
def forward_gate(spark, d):
    return ev.forward_gate(event_log(spark, d), cap=200).select("id", "today")


@query("forward_payload", f"""WITH {LOG} SELECT id, name AS event, visitor AS distinct_id,
  strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS at, job_id AS lesson,
  true AS private, CASE WHEN name IN ('job_created', 'play_seconds') THEN 'number' END AS seconds_kind,
  CASE WHEN name = 'loop_created' THEN (['drag', 'count', 'marker'])[k % 3 + 1] END AS via FROM logx""")
def forward_payload(spark, d):
    p = ev.forward_payload(event_log(spark, d))
    g = lambda path: F.get_json_object("payload", path)
    return p.select("id", g("$.event").alias("event"), g("$.distinct_id").alias("distinct_id"),
                    g("$.timestamp").alias("at"), g("$.properties.lesson").alias("lesson"),
                    (F.col("payload").contains('"$process_person_profile":false') & F.col("payload").contains('"$geoip_disable":true') & F.col("payload").contains('"$ip":null')).alias("private"),
                    F.when(F.col("payload").rlike('"seconds":-?[0-9]'), "number").when(F.col("payload").contains('"seconds":'), "other").alias("seconds_kind"), g("$.properties.via").alias("via"))


@query("once_only", f"""WITH {LOG} SELECT job_id, k % 3 AS retry_count, arg_min(id, (t, id)) AS id FROM logx
  WHERE name = 'job_finished' GROUP BY 1, 2""")
def once_only(spark, d):
    done = event_log(spark, d).filter("name = 'job_finished'").withColumn("retry_count", F.col("k") % 3)
    return ev.once_only(done, ["job_id", "retry_count"], ["t", "id"]).select("job_id", "retry_count", "id")


@query("latest_state", f"WITH {LOG} SELECT visitor, arg_max(id, (t, id)) AS id, arg_max(name, (t, id)) AS name FROM logx GROUP BY 1")
def latest_state(spark, d):
    return ev.latest(event_log(spark, d), ["visitor"], ["t", "id"]).select("visitor", "id", "name")


@query("first_write_wins", f"""WITH {LOG} SELECT visitor, arg_min(id, (t, id)) AS id FROM logx
  WHERE name = 'lesson_opened' AND visitor NOT IN (SELECT visitor FROM logx WHERE name = 'removal') GROUP BY 1""")
def first_write_wins(spark, d):
    log = event_log(spark, d)
    held = log.filter("name = 'removal'").select("visitor").distinct()
    return ev.insert_new(held, log.filter("name = 'lesson_opened'"), ["visitor"], ["t", "id"]).select("visitor", "id")


@query("sliding_limit", f"""WITH {EV}, a AS (SELECT event_id, user_id % 10 AS ip, t FROM ev),
  w AS (SELECT x.event_id, x.ip, x.t, count(y.event_id) FILTER (WHERE y.t > x.t - 3600) AS n_hour,
    count(y.event_id) AS n_day, min(y.t) FILTER (WHERE y.t > x.t - 3600) AS oldest_hour, min(y.t) AS oldest_day
    FROM a x LEFT JOIN a y ON x.ip = y.ip AND y.t > x.t - 86400 AND (y.t < x.t OR (y.t = x.t AND y.event_id < x.event_id)) GROUP BY 1, 2, 3)
  SELECT event_id, n_hour, n_day, CAST(CASE WHEN n_day >= 20 THEN greatest(60, floor(least(oldest_day + 86400, (floor(t / 86400) + 1) * 86400) - t))
    WHEN n_hour >= 5 THEN greatest(60, floor(least(oldest_hour + 3600, (floor(t / 86400) + 1) * 86400) - t)) END AS BIGINT) AS wait_s,
    CASE WHEN n_day >= 20 THEN 'day' WHEN n_hour >= 5 THEN 'hour' END AS breached FROM w""")
def sliding_limit(spark, d):
    """Load of each address before each attempt, as if every attempt counted (an upper bound)."""
    a = events(spark, d).select("event_id", (F.col("user_id") % 10).alias("ip"), "t")
    w = ev.window_load(a, ["ip"], "t", "event_id", {"hour": 3600.0, "day": 86400.0}, width_s=21600.0)
    breached = F.when(F.col("n_day") >= ev.IP_DAY, "day").when(F.col("n_hour") >= ev.IP_HOUR, "hour")
    wait = (F.when(F.col("n_day") >= ev.IP_DAY, ev.retry_after(F.col("t"), F.col("oldest_day"), 24, True))
            .when(F.col("n_hour") >= ev.IP_HOUR, ev.retry_after(F.col("t"), F.col("oldest_hour"), 1, True)))
    return w.select("event_id", "n_hour", "n_day", wait.alias("wait_s"), breached.alias("breached"))


LIMITS = """a AS (SELECT event_id, user_id % 10 AS ip, epoch_us(ts) AS us FROM events),
  whole AS MATERIALIZED (SELECT list({'event_id': event_id, 'ip': ip, 'us': us} ORDER BY us, event_id) AS every FROM a),
  f AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS code, NULL::BIGINT AS wait_s, []::STRUCT(us BIGINT, ip BIGINT)[] AS kept
    UNION ALL SELECT i, x.event_id, code, CASE WHEN code IS NOT NULL THEN greatest(60, (free - x.us) // 1000000) END,
      CASE WHEN code IS NULL THEN list_append(live, {'us': x.us, 'ip': x.ip}) ELSE live END
    FROM (SELECT *, CASE WHEN len(live) >= 200 THEN 'daily_limit_reached' WHEN len(own) >= 20 OR len(recent) >= 5 THEN 'too_many_lessons' END AS code,
        CASE WHEN len(live) >= 200 THEN live[1].us + 86400000000 WHEN len(own) >= 20 THEN least(own[1].us + 86400000000, midnight) ELSE least(recent[1].us + 3600000000, midnight) END AS free
      FROM (SELECT *, list_filter(own, lambda z: z.us > x.us - 3600000000) AS recent
        FROM (SELECT *, list_filter(live, lambda z: z.ip = x.ip AND z.us >= midnight - 86400000000) AS own
          FROM (SELECT i, x, (x.us // 86400000000 + 1) * 86400000000 AS midnight, list_filter(kept, lambda z: z.us > x.us - 86400000000) AS live
            FROM (SELECT f.i + 1 AS i, f.kept, whole.every[f.i + 1] AS x FROM f, whole WHERE f.i < len(whole.every)))))))"""


@query("limit_replay", f"WITH RECURSIVE {LIMITS} SELECT event_id, code IS NULL AS accepted, code, wait_s FROM f WHERE i > 0")
def limit_replay(spark, d):
    """Every event as an attempt from one of ten addresses, under the limits of everybody, an address's day and its hour."""
    a = events(spark, d).select("event_id", (F.col("user_id") % 10).alias("ip"), "t")
    return limits.replay(a, "ip", "t", ["event_id"]).select("event_id", "accepted", "code", "wait_s")


@query("stream_limits", f"""WITH RECURSIVE {LIMITS} SELECT event_id, code, wait_s FROM f WHERE i > 0""")
def stream_limits(spark, d):
    """The same attempts as a stream of several batches in time order: what a batch accepts counts in the next ones."""
    a = events(spark, d).select("event_id", (F.col("user_id") % 10).alias("ip"), "t")
    source, out, state = scratch(spark, "attempts"), scratch(spark, "limit-decisions"), scratch(spark, "limit-state")
    for week in range(5):  # each week arrives, and the stream catches up
        a.where(F.floor((F.dayofmonth(F.timestamp_seconds("t")) - 1) / 7) == week).write.mode("append").parquet(source)
        attempts = spark.readStream.schema(a.schema).parquet(source)
        stream_rules.decide_limits(attempts, out, state, "ip", "t", ["event_id"], trigger={"availableNow": True}).awaitTermination()
    return stream_rules.limit_decisions(spark, a.schema, out).select("event_id", "code", "wait_s")


@query("removal_limit", f"""WITH {EV}, a AS (SELECT event_id, user_id % 40 AS ip, t, row_number() OVER (PARTITION BY user_id % 40, CAST(ts AS DATE) ORDER BY t, event_id) AS n FROM ev)
  SELECT event_id, ip, n <= 5 AS accepted, CASE WHEN n > 5 THEN 'too_many_removals' END AS code,
    CASE WHEN n > 5 THEN greatest(60, CAST(floor((floor(t / 86400) + 1) * 86400 - t) AS BIGINT)) END AS wait_s FROM a""")
def removal_limit(spark, d):
    a = events(spark, d).select("event_id", (F.col("user_id") % 40).alias("ip"), "t")
    return limits.removals(a, "ip", "t", ["event_id"]).select("event_id", "ip", "accepted", "code", "wait_s")


@query("lockout", f"""WITH {EV}, a AS (SELECT event_id, user_id % 3 AS ip, t FROM ev WHERE event_type = 'error')
  SELECT x.event_id, x.ip, count(y.event_id) + 1 AS recent, count(y.event_id) + 1 >= 4 AS locked FROM a x LEFT JOIN a y
  ON x.ip = y.ip AND y.t > x.t - 7200 AND (y.t < x.t OR (y.t = x.t AND y.event_id < x.event_id)) GROUP BY 1, 2""")
def lockout(spark, d):
    a = events(spark, d).filter("event_type = 'error'").select("event_id", (F.col("user_id") % 3).alias("ip"), "t")
    return ev.lockouts(a, "ip", "t", "event_id", window_s=7200.0, limit=4, width_s=86400.0).select(
        "event_id", "ip", "recent", "locked")


@query("sessions", f"""WITH {EV}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600 THEN 0 ELSE 1 END AS new FROM ev
    WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g)
  SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(max(t) - min(t), 3) AS length_s FROM s GROUP BY 1, 2""")
def sessions(spark, d):
    s = ordered.sessions(events(spark, d), ["user_id"], "t", ["event_id"], gap_s=21600.0, width_s=86400.0)
    return s.groupBy("user_id", F.col("session").cast("bigint").alias("session")).agg(
        F.count("*").alias("n"), F.round(F.max("t") - F.min("t"), 3).alias("length_s"))


@query("play_buckets", f"""WITH {EV}, p AS (SELECT *, k % 4 AS lesson, CASE WHEN lag(k % 4) OVER w = k % 4 THEN 0 ELSE 1 END AS ch FROM ev
    WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
  r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM p),
  q AS (SELECT user_id, run, lesson, min(t) AS from_t, sum(value) AS s FROM r GROUP BY 1, 2, 3)
  SELECT user_id, lesson, round(from_t, 3) AS from_t, CAST(floor(round(s, 6) / 30) AS BIGINT) AS buckets,
    CAST(floor(round(s, 6) - floor(round(s, 6) / 30) * 30 + 0.5) AS BIGINT) AS rest_s FROM q""")
def play_buckets(spark, d):
    e = events(spark, d).withColumn("lesson", F.col("k") % 4)
    out = ev.play_buckets(e, "user_id", "lesson", "t", "event_id", "value", width_s=86400.0)
    return out.select("user_id", "lesson", F.round("from_t", 3).alias("from_t"), "buckets",
                      F.col("rest_s").cast("bigint").alias("rest_s"))
