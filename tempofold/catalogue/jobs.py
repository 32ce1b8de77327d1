"""Job status, retention and queues: orders play jobs, line items their stages, customers lessons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs, retention
from .base import query, table

NOW = 978307200.0  # 2001-01-01, after most of the tables' dates
NOWQ = "978307200.0"


def _orders(spark, d):
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "succeeded").otherwise("processing")
    key = F.col("o_orderkey")
    code = F.when(key % 2 == 0, "pipeline_error").otherwise("clip_too_long")
    err = F.when(F.col("state") == "failed", F.struct(code.alias("code"), F.lit("it stopped").alias("message"), (key % 2 == 0).alias("retryable")))
    return (o.withColumn("state", state).withColumn("error", err)
            .select(key.alias("job_id"), F.col("o_custkey").alias("clip_id"), "state", F.lit("").alias("stage_message"),
                    (F.col("o_totalprice") / 450000).alias("progress"), "error", (key % 4).cast("int").alias("retry_count"),
                    F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double").alias("us"), "o_orderpriority"))


ORD = """o AS (SELECT o_orderkey AS job_id, o_custkey AS clip_id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'processing' END AS state,
  o_totalprice / 450000 AS progress, o_orderkey % 4 AS retry_count, epoch_us(o_orderdate) / 1e6 AS t, o_orderdate, o_orderpriority FROM orders),
  tomb AS (SELECT c_custkey AS clip_id, c_mktsegment AS reason FROM customer WHERE c_custkey % 7 = 0)"""


def _tombs(spark, d):
    return table(spark, d, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("clip_id"), F.col("c_mktsegment").alias("reason"))


@query("row_violations", f"""WITH {ORD} SELECT job_id, array_to_string(list_filter([CASE WHEN progress > 1 THEN 'progress' END,
  CASE WHEN retry_count - 1 < 0 THEN 'retry_count' END, CASE WHEN job_id % 5 = 0 AND state <> 'failed' THEN 'error_only_when_failed' END], lambda x: x IS NOT NULL), ',') AS broken
  FROM o WHERE progress > 1 OR retry_count - 1 < 0 OR (job_id % 5 = 0 AND state <> 'failed')""")
def row_violations(spark, d):
    """Job rows, some bent by key, split into good and quarantined."""
    o = _orders(spark, d).withColumn("retry_count", F.col("retry_count") - 1)
    o = o.withColumn("error", F.when(F.col("job_id") % 5 == 0, F.lit("x")))
    _, bad = jobs.split_by_violations(o, jobs.row_violations())
    return bad.select("job_id", F.array_join("violations", ",").alias("broken"))


@query("status_documents", f"""WITH {ORD} SELECT CAST(job_id AS VARCHAR) AS job_id, state, retry_count, state = 'failed' AS has_error FROM o""")
def status_documents(spark, d):
    docs = jobs.status_documents(_orders(spark, d).withColumn("job_id", F.col("job_id").cast("string")))
    g = lambda p: F.get_json_object("status", p)
    return docs.select("job_id", g("$.state").alias("state"), g("$.retry_count").cast("bigint").alias("retry_count"), g("$.error.code").isNotNull().alias("has_error"))


@query("merge_status", f"""WITH {ORD}, r AS (SELECT * FROM o WHERE job_id % 3 <> 0), d AS (SELECT job_id, CASE WHEN job_id % 2 = 0 THEN 'processing' ELSE 'failed' END AS state, job_id % 3 AS retry_count FROM o WHERE job_id % 5 <> 0)
  SELECT job_id, CASE WHEN pick THEN r.state ELSE d.state END AS state, CASE WHEN pick THEN r.retry_count ELSE d.retry_count END AS retry_count, CASE WHEN pick THEN 'row' ELSE 'document' END AS source
  FROM r FULL JOIN d USING (job_id), LATERAL (SELECT coalesce(r.state IN ('succeeded', 'failed'), false) OR d.state IS NULL OR (r.state IS NOT NULL AND d.retry_count < r.retry_count) AS pick) z""")
def merge_status(spark, d):
    o = _orders(spark, d).select("job_id", "state", F.col("retry_count").cast("bigint").alias("retry_count"))
    docs = o.filter("job_id % 5 <> 0").select("job_id", F.when(F.col("job_id") % 2 == 0, "processing").otherwise("failed").alias("state"), (F.col("job_id") % 3).alias("retry_count"))
    return jobs.merge_status(o.filter("job_id % 3 <> 0"), docs)


@query("queued_default", f"WITH {ORD} SELECT l_orderkey AS job_id, coalesce(max(o.state), 'queued') AS state FROM lineitem LEFT JOIN o ON o.job_id = l_orderkey AND o.job_id % 3 = 0 GROUP BY 1")
def queued_default(spark, d):
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id")).distinct()
    return jobs.with_queued_default(asked, _orders(spark, d).filter("job_id % 3 = 0")).select("job_id", "state")


@query("finish_join", """WITH d AS (SELECT l_orderkey AS job_id, max(epoch_us(l_shipdate) / 1e6) AS dispatched FROM lineitem GROUP BY 1)
  SELECT o_orderkey AS job_id, CAST(round_even(CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(o_orderdate) / 1e6 + 1e8 ELSE epoch_us(o_orderdate) / 1e6 END - dispatched, 0) AS BIGINT) AS wall_s
  FROM orders LEFT JOIN d ON d.job_id = o_orderkey WHERE o_orderstatus <> 'P'""")
def finish_join(spark, d):
    t = F.col("us") / 1e6
    fin = _orders(spark, d).filter("state in ('succeeded', 'failed')").select(
        "job_id", t.alias("seen_t"), F.when(F.col("job_id") % 2 == 0, t + 1e8).alias("finished_t"))
    disp = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("t"))
    return jobs.finish_join(fin, disp).select("job_id", "wall_s")


@query("stage_waterfall", """WITH s AS (SELECT l_linenumber AS stage, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT CAST(stage AS BIGINT) AS stage, count(*) AS n, round(quantile_cont(s, 0.5), 2) AS median_s, round(quantile_cont(s, 0.9), 2) AS p90_s FROM s GROUP BY 1""")
def stage_waterfall(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("s"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("timestamp").alias("o"))
    x = li.join(o, "l_orderkey").select(F.col("l_linenumber").cast("bigint").alias("stage"), ((F.unix_micros("s") - F.unix_micros("o")) / 1e6).alias("sec"))
    w = jobs.waterfall(x, ["stage"], "sec")
    return w.select("stage", F.col("n").cast("bigint").alias("n"), F.round("median_s", 2).alias("median_s"), F.round("p90_s", 2).alias("p90_s"))


@query("stage_seconds", """SELECT l_orderkey AS job_id, count(*) AS stages, CAST(max(round_even((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6, 0)) AS BIGINT) AS last_s
  FROM (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def stage_seconds(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_shipdate").cast("timestamp")).alias("s"))
    per = li.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("k"), (F.unix_micros("s") / 1e6).alias("v")))).alias("stage_at"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("dispatched"))
    x = per.join(o, "l_orderkey").withColumn("s", jobs.stage_seconds(F.col("stage_at"), F.col("dispatched")))
    return x.select(F.col("l_orderkey").alias("job_id"), F.size("s").cast("bigint").alias("stages"), F.array_max(F.map_values("s")).alias("last_s"))


@query("throughput", """SELECT o_orderpriority AS tier, round(avg(o_totalprice / 3600 * 1.95), 4) AS cost, round(avg((o_orderkey % 300 + 1) / (o_custkey % 90 + 1)), 4) AS fps FROM orders GROUP BY 1""")
def throughput(spark, d):
    o = table(spark, d, "orders")
    x = o.withColumn("p", jobs.throughput(F.col("o_orderkey") % 300 + 1, F.col("o_custkey") % 90 + 1, F.col("o_totalprice")))
    return x.groupBy(F.col("o_orderpriority").alias("tier")).agg(F.round(F.avg("p.cost"), 4).alias("cost"), F.round(F.avg("p.fps"), 4).alias("fps"))


@query("retryable_jobs", f"""WITH {ORD}, m AS (SELECT job_id, clip_id FROM o WHERE job_id % 9 <> 0)
  SELECT o.job_id, CASE WHEN m.clip_id IN (SELECT clip_id FROM tomb) THEN 'removed' WHEN state <> 'failed' THEN 'not_failed' WHEN o.job_id % 2 <> 0 THEN 'not_retryable'
    WHEN m.job_id IS NULL THEN 'no_meta' WHEN retry_count >= 2 THEN 'retries_exhausted' END AS refusal FROM o LEFT JOIN m USING (job_id)""")
def retryable_jobs(spark, d):
    o = _orders(spark, d)
    return jobs.retryable_jobs(o.drop("clip_id"), _tombs(spark, d), o.filter("job_id % 9 <> 0")).select("job_id", "refusal")


@query("stale_exports", f"""WITH {ORD}, e AS (SELECT job_id, 1700 * progress AS age FROM o WHERE state = 'processing' AND job_id % 2 = 0)
  SELECT job_id, CASE WHEN age * 2 >= 2160 THEN 'give_up' ELSE 'check' END AS verdict FROM e WHERE age * 2 >= 720""")
def stale_exports(spark, d):
    o = _orders(spark, d).withColumn("since_s", NOW - 1700 * F.col("progress") * 2)
    o = o.withColumn("stage_message", F.when(F.col("job_id") % 2 == 0, jobs.EXPORT_STAGE).otherwise(""))
    return jobs.stale_exports(o, F.lit(NOW)).select("job_id", "verdict")


@query("topk_recent", f"WITH {ORD} SELECT job_id, clip_id FROM o WHERE state = 'succeeded' ORDER BY t DESC, job_id LIMIT 50")
def topk_recent(spark, d):
    return jobs.recent_succeeded(_orders(spark, d), 50, created="us").select("job_id", "clip_id")


@query("active_jobs", f"WITH {ORD} SELECT state, count(*) AS n FROM o WHERE state IN ('queued', 'processing') GROUP BY 1")
def active_jobs(spark, d):
    return _orders(spark, d).filter(F.col("state").isin("queued", "processing")).groupBy("state").agg(F.count("*").alias("n"))


@query("first_per_key", f"WITH {ORD} SELECT clip_id, job_id FROM o WHERE state = 'succeeded' QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY t DESC, job_id) = 1")
def first_per_key(spark, d):
    done = _orders(spark, d).filter("state = 'succeeded'")
    return jobs.newest_per_clip(done, created="us").select("clip_id", "job_id")


@query("owner_queue", f"""WITH {ORD}, n AS (SELECT * FROM o WHERE state = 'succeeded' QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY t DESC, job_id) = 1),
  b AS (SELECT c_custkey AS clip_id, c_acctbal / 1000 AS det FROM customer WHERE c_custkey % 4 <> 0),
  l AS (SELECT l_suppkey * 3 AS clip_id, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS one FROM lineitem GROUP BY 1)
  SELECT n.job_id, n.clip_id, round(coalesce(l.one, CASE WHEN b.det IS NOT NULL THEN greatest(0, b.det) END), 6) AS count_one_s, l.one IS NOT NULL AS confirmed
  FROM n LEFT JOIN b USING (clip_id) LEFT JOIN l USING (clip_id)""")
def owner_queue(spark, d):
    done = jobs.newest_per_clip(_orders(spark, d).filter("state = 'succeeded'"), created="us").select("job_id", "clip_id")
    beats = table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(
        F.col("c_custkey").alias("clip_id"), (F.col("c_acctbal") / 1000).alias("count_one_s"), F.lit(120.0).alias("bpm"), F.lit(0.5).alias("seconds_per_count"))
    meta = done.select("job_id", F.lit(None).cast("string").alias("credit"))
    labels = table(spark, d, "lineitem").select((F.col("l_suppkey") * 3).alias("clip_id"), F.col("l_quantity").alias("count_one_s"),
                                                F.lit(30.0).alias("duration_s"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    out = jobs.owner_queue(done, beats, meta, labels)
    return out.select("job_id", "clip_id", F.round("count_one_s", 6).alias("count_one_s"), "confirmed")


@query("early_counts", f"""WITH {ORD}, b AS (SELECT c_custkey AS clip_id, c_acctbal / 700 AS one, (c_custkey % 9) / 10.0 AS spc FROM customer)
  SELECT job_id, CASE WHEN state = 'processing' AND job_id % 3 <> 0 AND spc > 0 THEN round_even(one, 4) END AS count_one_s FROM o LEFT JOIN b USING (clip_id)""")
def early_counts(spark, d):
    g = table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id"), F.struct(
        F.lit(120.0).alias("bpm"), (F.col("c_acctbal") / 700).alias("count_one_s"), ((F.col("c_custkey") % 9) / 10).alias("seconds_per_count"),
        F.lit(0.5).alias("confidence")).alias("grid"))
    has = F.when(F.col("job_id") % 3 == 0, F.struct(F.lit(1.0).alias("bpm"), F.lit(None).cast("double").alias("count_one_s"), F.lit(1.0).alias("seconds_per_count"), F.lit(0.0).alias("confidence")))
    return jobs.with_early_counts(_orders(spark, d).withColumn("counts", has), g).select("job_id", F.col("counts.count_one_s").alias("count_one_s"))


@query("stamp_credit", """SELECT page_id AS job_id, CASE WHEN page_id % 3 = 0 THEN 'new' WHEN page_id % 3 = 1 THEN 'new' ELSE 'old' END AS who FROM pages""")
def stamp_credit(spark, d):
    """Old credits absent, for the same page with a tracking query, or for another page."""
    from ..functions import text
    p = table(spark, d, "pages")
    url = F.when(F.col("page_id") % 3 == 1, F.concat(text.clean_url(F.col("url")), F.lit("?utm=1"))).when(F.col("page_id") % 3 == 2, F.lit("https://other.example.com/x"))
    meta = p.select(F.col("page_id").alias("job_id"), F.when(url.isNotNull(), F.struct(url.alias("url"), F.lit("old").alias("creator"))).alias("credit"))
    new = p.select(F.col("page_id").alias("job_id"), F.struct(text.clean_url(F.col("url")).alias("url"), F.lit("new").alias("creator")).alias("new_credit"))
    return jobs.stamp_credit(meta, new).select("job_id", F.col("credit.creator").alias("who"))


@query("resolve_clip", f"WITH {ORD} SELECT 'job_' || job_id AS job_id, CASE WHEN job_id % 3 = 0 THEN 'c' || clip_id WHEN job_id % 3 = 1 THEN 'm' || clip_id ELSE CAST(job_id AS VARCHAR) END AS clip_id FROM o")
def resolve_clip(spark, d):
    o = _orders(spark, d)
    name = F.concat(F.lit("job_"), F.col("job_id").cast("string"))
    rows = o.filter("job_id % 3 = 0").select(name.alias("job_id"), F.concat(F.lit("c"), F.col("clip_id").cast("string")).alias("clip_id"))
    meta = o.filter("job_id % 3 = 1").select(name.alias("job_id"), F.concat(F.lit("m"), F.col("clip_id").cast("string")).alias("clip_id"))
    return jobs.resolve_clip(o.select(name.alias("job_id")), rows, meta)


@query("flow_funnel", f"""WITH {ORD}, s AS (SELECT CASE WHEN job_id % 4 = 0 OR state = 'succeeded' THEN 'done' WHEN state = 'processing' AND progress >= 0.1 THEN 'now' ELSE 'wait' END AS dancers_step,
    CASE WHEN state = 'succeeded' THEN 'done' WHEN job_id % 8 = 0 OR (state = 'processing' AND progress >= 0.95) THEN 'now' ELSE 'wait' END AS body_step FROM o)
  SELECT dancers_step, body_step, count(*) AS jobs FROM s GROUP BY 1, 2""")
def flow_funnel(spark, d):
    o = _orders(spark, d).withColumn("dancers", F.when(F.col("job_id") % 4 == 0, 1)).withColumn(
        "frames_done", F.when(F.col("job_id") % 8 == 0, 10)).withColumn("frames_total", F.lit(20))
    return o.withColumns(jobs.flow_steps()).groupBy("dancers_step", "body_step").agg(F.count("*").alias("jobs"))


@query("my_lessons", """WITH a AS (SELECT l_suppkey AS u, l_partkey AS lesson, max(l_shipdate) AS at, arg_max(l_linestatus, l_orderkey * 100 + l_linenumber) FILTER (WHERE l_linenumber % 2 = 0) AS thumb, max(l_orderkey * 100 + l_linenumber) AS o FROM lineitem GROUP BY 1, 2)
  SELECT u, lesson, row_number() OVER (PARTITION BY u ORDER BY o DESC, lesson) AS place FROM a QUALIFY place <= 50""")
def my_lessons(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("lesson"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"),
                                            F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("thumb"))
    return jobs.my_lessons(li, "u", "lesson", "at", "thumb").select("u", "lesson", F.col("place").cast("bigint").alias("place"))


@query("touch_last", f"WITH {ORD} SELECT clip_id, max(t) AS at FROM o WHERE clip_id NOT IN (SELECT clip_id FROM tomb) GROUP BY 1")
def touch_last(spark, d):
    return jobs.touches(_orders(spark, d).withColumn("t", F.col("us") / 1e6), _tombs(spark, d))


@query("touch_writes", """WITH RECURSIVE a AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  f AS (SELECT user_id, i, event_id, t AS last, true AS writes FROM a WHERE i = 1 UNION ALL SELECT a.user_id, a.i, a.event_id, CASE WHEN a.t - f.last >= 86400 THEN a.t ELSE f.last END, a.t - f.last >= 86400 FROM f JOIN a ON a.user_id = f.user_id AND a.i = f.i + 1)
  SELECT event_id, writes FROM f""")
def touch_writes(spark, d):
    from .base import events
    e = events(spark, d).select("event_id", F.col("user_id").alias("clip_id"), "t")
    return jobs.touch_writes(e).select("event_id", "writes")


# -- retention ----------------------------------------------------------------

def _listing(spark, d):
    """Stored files of every order's lesson; which ones exist follows from the key."""
    k = F.col("o_orderkey")
    c = F.concat(F.lit("c"), k.cast("string"))

    def name(cond, *parts):
        return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    names = F.array_compact(F.array(
        name(k % 3 == 0, "/", c, ".npz"), name(k % 2 == 0, c, ".motion-result.json.gz"), name(k % 5 != 0, c, ".export-manifest.json"),
        name(k % 11 == 0, c, ".removed.json"), name(k % 4 == 0, c, "_track1.ab12.glb"), name(k % 6 == 0, "job_", c, ".job-meta.json"),
        name(k % 13 == 0, c, ".last-access.json")))
    return table(spark, d, "orders").select(F.explode(names).alias("path"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("mtime_s"))


LST = """fl AS (SELECT o_orderkey AS k, 'c' || o_orderkey AS clip_id, epoch_us(o_orderdate) / 1e6 AS m, o_orderkey % 3 = 0 AS npz, o_orderkey % 2 = 0 AS doc, o_orderkey % 5 <> 0 AS man,
  o_orderkey % 11 = 0 AS rem, o_orderkey % 4 = 0 AS glb, o_orderkey % 6 = 0 AS meta, o_orderkey % 13 = 0 AS touch FROM orders)"""


def _uploads(spark, d):
    return table(spark, d, "orders").filter("o_orderkey % 22 = 0").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("path"))


@query("tombstone_anti", f"WITH {ORD} SELECT job_id FROM o WHERE clip_id NOT IN (SELECT clip_id FROM tomb)")
def tombstone_anti(spark, d):
    return retention.not_removed(_orders(spark, d), _tombs(spark, d)).select("job_id")


@query("late_writes", f"""WITH {LST} SELECT clip_id, CAST(npz::int + doc::int + man::int + glb::int + meta::int + touch::int + (k % 22 = 0)::int AS BIGINT) AS files FROM fl
  WHERE rem AND (npz OR doc OR man OR glb OR meta OR touch OR k % 22 = 0)""")
def late_writes(spark, d):
    return retention.late_writes(_listing(spark, d), _uploads(spark, d))


@query("orphan_audit", f"""WITH {ORD} SELECT t.clip_id, t.reason, coalesce(a.n, 0) AS jobs, coalesce(b.n, 0) AS index, coalesce(c.n, 0) AS events, coalesce(a.n, 0) + coalesce(b.n, 0) > 0 AS dirty FROM tomb t
  LEFT JOIN (SELECT clip_id, count(*) AS n FROM o GROUP BY 1) a USING (clip_id) LEFT JOIN (SELECT l_suppkey AS clip_id, count(*) AS n FROM lineitem GROUP BY 1) b USING (clip_id)
  LEFT JOIN (SELECT user_id AS clip_id, count(*) AS n FROM events GROUP BY 1) c USING (clip_id)""")
def orphan_audit(spark, d):
    stores = {"jobs": _orders(spark, d), "index": table(spark, d, "lineitem").select(F.col("l_suppkey").alias("clip_id")),
              "events": table(spark, d, "events").select(F.col("user_id").alias("clip_id"))}
    return retention.orphan_audit(_tombs(spark, d), stores)


@query("route_plan", f"""WITH {LST} SELECT clip_id, CASE WHEN rem AND k % 2 = 0 THEN 'skip: removed (quarantined)' WHEN rem THEN 'skip: removed' WHEN npz AND (k % 10 = 3 OR meta) THEN 'reexport'
  WHEN npz THEN 'skip: eval clip, surface already standard, npz kept' WHEN doc THEN 'swap' ELSE 'skip: no npz and no stored MotionResult' END AS route FROM fl WHERE man""")
def route_plan(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("clip_id"))
    return retention.route_plan(_listing(spark, d), o.filter("o_orderkey % 10 = 3"), o.filter("o_orderkey % 2 = 0"))


@query("live_set", f"WITH {LST} SELECT clip_id FROM fl WHERE (doc OR npz) AND NOT rem")
def live_set(spark, d):
    return retention.live_set(_listing(spark, d))


SWEEP = LST + f""", sw AS (SELECT *, CASE WHEN touch OR man OR npz THEN m ELSE {NOWQ} END AS opened, (doc OR npz) AND NOT rem AS live FROM fl), sx AS (SELECT *, live AND {NOWQ} - opened > 180 * 86400 AS expired FROM sw)"""


@query("reap_set", f"WITH {SWEEP} SELECT clip_id FROM fl WHERE npz AND doc AND NOT rem AND clip_id NOT IN (SELECT clip_id FROM sx WHERE expired)")
def reap_set(spark, d):
    s = retention.sweep(_listing(spark, d), _uploads(spark, d), F.lit(NOW))
    return retention.reap_set(_listing(spark, d), s.filter("action = 'expire'"))


@query("daily_sweep", f"""WITH {SWEEP} SELECT clip_id, 'expire' AS action, round_even(({NOWQ} - opened) / 86400, 1) AS age_days FROM sx WHERE expired
  UNION ALL SELECT clip_id, 'reap_npz', round_even(({NOWQ} - opened) / 86400, 1) FROM sx WHERE live AND NOT expired AND npz AND doc
  UNION ALL SELECT clip_id, 'keep', round_even(({NOWQ} - opened) / 86400, 1) FROM sx WHERE live AND NOT expired
  UNION ALL SELECT clip_id, 'resweep', round_even(({NOWQ} - opened) / 86400, 1) FROM sx WHERE rem AND (npz OR doc OR man OR glb OR meta OR touch OR k % 22 = 0)""")
def daily_sweep(spark, d):
    return retention.sweep(_listing(spark, d), _uploads(spark, d), F.lit(NOW), dry_run=True).drop("dry_run")


def _keys(spark, d):
    k = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(F.array(
        F.concat(F.lit("video/"), k, F.lit(".mp4")), F.concat(F.lit("motion-result/"), k, F.lit(".aa.json.gz")),
        F.concat(F.lit("glb/"), k, F.lit("_track2.bb.glb")))).alias("key"))


@query("object_owner", "SELECT kind, count(*) AS n, count(DISTINCT o_orderkey) AS clips FROM orders, (VALUES ('video'), ('motion-result'), ('glb')) v(kind) GROUP BY 1")
def object_owner(spark, d):
    return retention.object_owner(_keys(spark, d)).groupBy("kind").agg(F.count("*").alias("n"), F.approx_count_distinct("clip_id").alias("_")).drop("_").join(
        retention.object_owner(_keys(spark, d)).select("kind", "clip_id").distinct().groupBy("kind").agg(F.count("*").alias("clips")), "kind")


@query("superseded", "SELECT 'c' || o_orderkey AS clip_id, kind FROM orders, (VALUES ('motion-result'), ('glb')) v(kind) WHERE NOT (kind = 'glb' AND o_orderkey % 3 = 0)")
def superseded(spark, d):
    keys = _keys(spark, d)
    keep = keys.filter(F.col("key").startswith("glb/") & (F.col("o_orderkey") % 3 == 0)).select("key")
    return retention.superseded(keys.select("key"), keep).select("clip_id", "kind")


@query("deletion_plan", f"""WITH {LST}, t AS (SELECT * FROM fl WHERE k % 17 = 0) SELECT clip_id, store, count(*) AS items FROM (
  SELECT clip_id, 'results' AS store, unnest(range(0, npz::int + doc::int + man::int + glb::int + meta::int + touch::int)) AS x FROM t
  UNION ALL SELECT clip_id, 'uploads', 0 FROM t WHERE k % 22 = 0 UNION ALL SELECT clip_id, 'objects', unnest(range(0, 3)) FROM t
  UNION ALL SELECT clip_id, 'jobs', 0 FROM t UNION ALL SELECT t.clip_id, 'index', 0 FROM t JOIN lineitem ON l_orderkey = k) GROUP BY 1, 2""")
def deletion_plan(spark, d):
    clip = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("clip_id")
    t = table(spark, d, "orders").filter("o_orderkey % 17 = 0").select(clip("o_orderkey"))
    j = table(spark, d, "orders").select(clip("o_orderkey"), F.col("o_orderkey").alias("job_id"))
    idx = table(spark, d, "lineitem").select(clip("l_orderkey"), F.col("l_linenumber").alias("entry_id"))
    plan = retention.deletion_plan(t, _listing(spark, d).select("path"), _uploads(spark, d), _keys(spark, d).select("key"), j, idx)
    return plan.groupBy("clip_id", "store").agg(F.count("*").alias("items"))


@query("quarantine_plan", """SELECT 'c' || o_orderkey AS clip_id, 'results:/f' || (o_orderkey % 3) AS source, sha256(CAST(o_custkey AS VARCHAR)) AS sha256,
  '/c' || o_orderkey || '/results/f' || (o_orderkey % 3) || CASE WHEN o_orderkey % 4 = 0 THEN '.' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 12) ELSE '' END AS dest
  FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 10 <> 6""")
def quarantine_plan(spark, d):
    """Half the lessons quarantined; some files kept before, some names taken by other bytes."""
    clip = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    src = F.concat(F.lit("results:/f"), (F.col("o_orderkey") % 3).cast("string"))
    sha = F.sha2(F.col("o_custkey").cast("string").cast("binary"), 256)
    f = table(spark, d, "orders").select("o_orderkey", clip.alias("clip_id"), src.alias("source"), sha.alias("sha256"))
    done = f.filter("o_orderkey % 10 = 6").select("clip_id", "source", F.lit("/elsewhere").alias("path"), "sha256")
    taken = f.filter("o_orderkey % 4 = 0 and o_orderkey % 10 <> 6").select("clip_id", F.lit("x:/y").alias("source"), F.concat(F.lit("/"), "clip_id", F.lit("/results/f"), (F.col("o_orderkey") % 3).cast("string")).alias("path"), F.lit("0").alias("sha256"))
    kept = done.unionByName(taken)
    return retention.quarantine_plan(f.filter("o_orderkey % 2 = 0"), f, kept).select("clip_id", "source", "dest", "sha256")


@query("blocklist_growth", """SELECT DISTINCT clip_id, sha FROM (SELECT 'c' || o_orderkey AS clip_id, 'a' || o_custkey AS sha FROM orders UNION ALL SELECT 'c' || l_orderkey, 'b' || l_suppkey FROM lineitem) x
  WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey % 3 = 0 AND 'c' || o.o_orderkey = x.clip_id AND 'a' || o.o_custkey = x.sha)""")
def blocklist_growth(spark, d):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = table(spark, d, "orders").select("o_orderkey", s("c", "o_orderkey").alias("clip_id"), s("a", "o_custkey").alias("sha256"))
    li = table(spark, d, "lineitem").select(s("c", "l_orderkey").alias("clip_id"), s("b", "l_suppkey").alias("sha256"))
    return retention.new_fingerprints(o, li, o.filter("o_orderkey % 3 = 0")).select("clip_id", F.col("sha256").alias("sha"))


@query("expired_lessons", f"SELECT c_custkey AS clip_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 GROUP BY 1 HAVING {NOWQ} - max(epoch_us(o_orderdate) / 1e6) > 180 * 86400")
def expired_lessons(spark, d):
    t = jobs.touches(_orders(spark, d).withColumn("t", F.col("us") / 1e6), _tombs(spark, d))
    return t.filter(jobs.is_expired(F.col("at"), F.lit(NOW))).select("clip_id")
