"""Time-series and grid operators over each user's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import counts as C
from ..operators import grid, ordered, series
from .base import EV, events, query

DAY = 86400.0
BASE = 1704067200  # 2024-01-01 UTC, so that hours stay small numbers


def _user(spark, d, kind: str | None = None):
    e = events(spark, d).select("event_id", "user_id", "t", "value", "k", "event_type")
    return e if kind is None else e.filter(F.col("event_type") == kind)


def _r(c, n=4):
    return F.round(c, n).alias(c if isinstance(c, str) else c._jc.toString())


def _indexed(spark, d, size=None):
    return series.indexed(_user(spark, d), ["user_id"], "t", ["event_id"], DAY, size=size)


@query("asof_sample", f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'click'), s AS (SELECT * FROM ev WHERE event_type = 'view'),
  f AS (SELECT user_id, arg_min(event_id, t) AS first_id FROM s GROUP BY 1)
  SELECT p.event_id, coalesce(s.event_id, f.first_id) AS sample_id FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.t >= s.t
  LEFT JOIN f ON f.user_id = p.user_id""")
def asof_sample(spark, d):
    s = _user(spark, d, "view").withColumnRenamed("event_id", "sample_id")
    out = series.asof_sample(_user(spark, d, "click"), s, ["user_id"], "t", ["sample_id"], DAY)
    return out.select("event_id", F.col("hit.sample_id").alias("sample_id"))


@query("next_sample", f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'click'), s AS (SELECT * FROM ev WHERE event_type = 'view'),
  f AS (SELECT user_id, arg_max(event_id, t) AS last_id FROM s GROUP BY 1)
  SELECT p.event_id, coalesce(s.event_id, f.last_id) AS sample_id FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.t <= s.t
  LEFT JOIN f ON f.user_id = p.user_id""")
def next_sample(spark, d):
    s = _user(spark, d, "view").withColumnRenamed("event_id", "sample_id")
    out = series.next_sample(_user(spark, d, "click"), s, ["user_id"], "t", ["sample_id"], DAY)
    return out.select("event_id", F.col("hit.sample_id").alias("sample_id"))


@query("asof_interp", f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'click'), s AS (SELECT * FROM ev WHERE event_type = 'view'),
  a AS (SELECT p.event_id, p.user_id, p.t, s.t AS ta, s.value AS va FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.t >= s.t),
  b AS (SELECT a.*, s.t AS tb, s.value AS vb FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.t < s.t)
  SELECT event_id, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END, 4) AS value FROM b""")
def asof_interp(spark, d):
    out = series.asof_interp(_user(spark, d, "click").drop("value"), _user(spark, d, "view"), ["user_id"], "t", "value", DAY)
    return out.select("event_id", F.round("interp", 4).alias("value"))


@query("nearest_within", f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'click'), s AS (SELECT * FROM ev WHERE event_type = 'error')
  SELECT p.event_id, arg_min(s.event_id, (abs(p.t - s.t), s.t)) AS near_id, round(min(abs(p.t - s.t)), 3) AS gap_s
  FROM p LEFT JOIN s ON p.user_id = s.user_id AND abs(p.t - s.t) <= 7200 GROUP BY 1""")
def nearest_within(spark, d):
    s = _user(spark, d, "error").withColumnRenamed("event_id", "near_id")
    out = series.nearest(_user(spark, d, "click"), s, ["user_id"], "t", ["near_id"], DAY, within_s=7200.0)
    return out.select("event_id", F.col("hit.near_id").alias("near_id"), F.round(F.abs(F.col("t") - F.col("hit.t")), 3).alias("gap_s"))


@query("nearest_any", f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'click'), s AS (SELECT * FROM ev WHERE event_type = 'error')
  SELECT p.event_id, arg_min(s.event_id, (abs(p.t - s.t), s.t)) AS near_id FROM p JOIN s ON p.user_id = s.user_id GROUP BY 1""")
def nearest_any(spark, d):
    s = _user(spark, d, "error").withColumnRenamed("event_id", "near_id")
    out = series.nearest(_user(spark, d, "click"), s, ["user_id"], "t", ["near_id"], DAY)
    return out.filter("hit is not null").select("event_id", F.col("hit.near_id").alias("near_id"))


@query("band_join_counts", f"""WITH {EV}, h AS (SELECT user_id % 10 AS u, t FROM ev WHERE event_type = 'click'),
  o AS (SELECT user_id % 10 AS u, t FROM ev WHERE event_type = 'view'),
  c AS (SELECT DISTINCT u, CAST(floor((t - {BASE}) / 14400) AS BIGINT) + z.z AS c FROM h, (VALUES (-1), (0), (1)) z(z)),
  p AS (SELECT u, c, j, {BASE} + (c + j / 4.0) * 14400 AS at FROM c, range(0, 4) r(j)),
  q AS (SELECT u, c, j, EXISTS (SELECT 1 FROM h WHERE h.u = p.u AND abs(h.t - p.at) <= 1800) AS hit,
    EXISTS (SELECT 1 FROM o WHERE o.u = p.u AND abs(o.t - p.at) <= 1800) AS ons FROM p)
  SELECT u AS key, c, CAST(sum(hit::int) AS BIGINT) AS hits, CAST(sum(ons::int) AS BIGINT) AS onsets FROM q GROUP BY 1, 2
  HAVING sum(hit::int) >= 3 AND sum(ons::int) >= 3 AND bool_or(hit AND j IN (1, 3))""")
def band_join_counts(spark, d):
    e = _user(spark, d).withColumn("key", F.col("user_id") % 10)
    grids = e.select("key").distinct().withColumn("one", F.lit(float(BASE))).withColumn("spc", F.lit(14400.0))
    hits, ons = [e.filter(F.col("event_type") == k).select("key", "t") for k in ("click", "view")]
    out = series.fast_counts(grids, hits, ons, "key", "t", tol_max=1800.0, tol_frac=1 / 8)
    return out.select("key", "c", F.col("hits").cast("bigint").alias("hits"), F.col("onsets").cast("bigint").alias("onsets"))


SER = EV + """, ser AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
  lag(t) OVER w AS t0, lead(t) OVER w AS t1, lag(value) OVER w AS v0, lead(value) OVER w AS v1 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))"""


@query("moving_avg", f"""WITH {SER} SELECT event_id, round((sum(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
    + greatest(0, 3 - i) * first_value(value) OVER w + greatest(0, 3 - (n - 1 - i)) * last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 7, 4) AS smooth
  FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def moving_avg(spark, d):
    out = series.moving_average(_indexed(spark, d, "n"), ["user_id"], "value", 3)
    return out.select("event_id", F.round("smooth", 4).alias("smooth"))


@query("gradient", f"""WITH {SER} SELECT event_id, round(3600 * CASE WHEN v0 IS NULL THEN (v1 - value) / (t1 - t) WHEN v1 IS NULL THEN (value - v0) / (t - t0)
    ELSE ((t - t0) * (t - t0) * v1 + ((t1 - t) * (t1 - t) - (t - t0) * (t - t0)) * value - (t1 - t) * (t1 - t) * v0) / ((t - t0) * (t1 - t) * (t1 - t0)) END, 3) AS slope FROM ser""")
def gradient(spark, d):
    out = series.gradient(_indexed(spark, d), ["user_id"], "t", {"g": "value"})
    return out.select("event_id", F.round(F.col("g") * 3600, 3).alias("slope"))


@query("peaks", f"""WITH {SER}, q AS (SELECT user_id, quantile_cont(value, 0.75) AS thr FROM ev GROUP BY 1),
  m AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM ser)
  SELECT event_id, value FROM m JOIN q USING (user_id) WHERE i >= 2 AND i < n - 2 AND value >= top AND value > thr""")
def peaks(spark, d):
    return series.peaks(_indexed(spark, d, "n"), ["user_id"], "value").select("event_id", "value")


@query("stop_cue", f"""WITH {SER}, m AS (SELECT *, min(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS low,
    greatest(max(value) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS a, greatest(max(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) AS b
    FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
  SELECT event_id, round(CASE WHEN i > 0 AND i < n - 1 AND value <= low THEN greatest(0, (least(a, b) - value) / (least(a, b) + 1e-6)) ELSE 0 END, 4) AS stop FROM m""")
def stop_cue(spark, d):
    out = series.stop_cue(_indexed(spark, d, "n"), ["user_id"], "value", window=4)
    return out.select("event_id", F.round("stop", 4).alias("stop"))


@query("turn_cue", f"""WITH {SER}, g AS (SELECT *, value - 20 AS p, CAST(k AS DOUBLE) - 50 AS q FROM ser),
  m AS (SELECT *, avg(p) OVER b AS ap, avg(q) OVER b AS aq, avg(p) OVER f AS bp, avg(q) OVER f AS bq FROM g
    WINDOW b AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
  z AS (SELECT *, sqrt(ap * ap + aq * aq) AS na, sqrt(bp * bp + bq * bq) AS nb FROM m)
  SELECT event_id, round(CASE WHEN i >= 3 AND i < n - 3 THEN (1 - (ap * bp + aq * bq) / (na * nb + 1e-9)) / 2 * least(1, least(na, nb) / 30) ELSE 0 END, 4) AS turn FROM z""")
def turn_cue(spark, d):
    x = _indexed(spark, d, "n").withColumn("p", F.col("value") - 20).withColumn("q", F.col("k").cast("double") - 50)
    return series.turn_cue(x, ["user_id"], ["p", "q"], F.lit(30.0)).select("event_id", F.round("turn", 4).alias("turn"))


@query("median5", f"""WITH {SER} SELECT event_id, round(coalesce(quantile_cont(CASE WHEN k % 5 <> 0 THEN value END, 0.5) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
    CASE WHEN k % 5 <> 0 THEN value END), 4) AS median FROM ser""")
def median5(spark, d):
    x = _indexed(spark, d).withColumn("value", F.when(F.col("k") % 5 != 0, F.col("value")))
    return series.median_filter(x, ["user_id"], "value").select("event_id", F.round("median", 4).alias("median"))


@query("gauss_smooth", f"""WITH {EV}, w AS (SELECT a.event_id, b.value AS x, (b.t - a.t) AS d, exp(-0.5 * ((b.t - a.t) / 7200) * ((b.t - a.t) / 7200)) AS w
    FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000),
  s AS (SELECT event_id, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * x) AS x0, sum(w * d * x) AS x1 FROM w GROUP BY 1)
  SELECT event_id, round(CASE WHEN s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 THEN (s2 * x0 - s1 * x1) / (s0 * s2 - s1 * s1) ELSE x0 / s0 END, 3) AS smooth FROM s""")
def gauss_smooth(spark, d):
    out = series.local_linear(_user(spark, d), ["user_id"], "t", "value", 7200.0, DAY)
    return out.select("event_id", F.round("smooth", 3).alias("smooth"))


@query("steady_track", f"""WITH {EV}, g AS (SELECT *, sum(CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gaps FROM ev),
  r AS (SELECT * FROM g WHERE k % 6 <> 0),
  w AS (SELECT a.event_id, b.value AS x, exp(-0.5 * ((b.t - a.t) / 14400) * ((b.t - a.t) / 14400)) AS w FROM r a JOIN r b
    ON a.user_id = b.user_id AND a.gaps = b.gaps AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 43200000000)
  SELECT ev.event_id, round(sum(w * x) / sum(w), 4) AS steady FROM ev LEFT JOIN w USING (event_id) GROUP BY 1""")
def steady_track(spark, d):
    x = _user(spark, d).withColumn("value", F.when(F.col("k") % 6 != 0, F.col("value")))
    out = series.steady_track(x, ["user_id"], "t", ["value"], 14400.0, DAY, ["event_id"])
    return out.select("event_id", F.round("steady_value", 4).alias("steady"))


@query("ffill", f"""WITH {EV}, g AS (SELECT *, CASE WHEN k % 3 = 0 THEN value END AS v FROM ev),
  h AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f,
    first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g)
  SELECT event_id, coalesce(f, b) AS held, v IS NOT NULL AS observed, v IS NULL AND f IS NOT NULL AS interpolated,
    CASE WHEN v IS NOT NULL THEN NULL WHEN f IS NULL THEN 'out_of_frame' ELSE 'low_confidence' END AS suppressed FROM h""")
def ffill(spark, d):
    x = _user(spark, d).withColumn("v", F.when(F.col("k") % 3 == 0, F.col("value")))
    out = series.hold(x, ["user_id"], ["t", "event_id"], ordered.time_bucket("t", DAY), "v")
    return out.select("event_id", "held", "observed", "interpolated", "suppressed")


@query("contact_interp", f"""WITH {SER}, g AS (SELECT *, value - 30 AS gap FROM ser), c AS (SELECT *, CASE WHEN gap < -15 THEN i END AS ci, CASE WHEN gap < -15 THEN gap END AS cg FROM g),
  h AS (SELECT *, last_value(ci IGNORE NULLS) OVER b AS ai, last_value(cg IGNORE NULLS) OVER b AS ag, first_value(ci IGNORE NULLS) OVER f AS bi, first_value(cg IGNORE NULLS) OVER f AS bg FROM c
    WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  r AS (SELECT *, CASE WHEN ai IS NULL AND bi IS NULL THEN NULL WHEN ai IS NULL THEN -bg WHEN bi IS NULL THEN -ag WHEN ai = bi THEN -ag
    ELSE -ag + (ag - bg) * (i - ai) / (bi - ai) END AS raw FROM h),
  z AS (SELECT *, (coalesce(lag(raw) OVER w, raw) + raw + coalesce(lead(raw) OVER w, raw)) / 3 AS near FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i))
  SELECT event_id, round(CASE WHEN raw IS NULL THEN greatest(0, -gap) ELSE greatest(near, -gap) END, 6) AS lift FROM z""")
def contact_interp(spark, d):
    x = _indexed(spark, d, "n").withColumn("gap", F.col("value") - 30)
    return series.sole_lift(x, ["user_id"], "gap", band=-15.0).select("event_id", F.round("lift", 6).alias("lift"))


@query("islands", f"""WITH {SER}, c AS (SELECT user_id, i, n, t, CASE event_type WHEN 'error' THEN 'walking' WHEN 'signup' THEN 'still' WHEN 'purchase' THEN CASE WHEN k < 50 THEN 'no music' END END AS why FROM ser),
  p AS (SELECT *, why IS NOT NULL AS idle, lead(why IS NULL) OVER w AS nx, lag(why IS NULL) OVER w AS pv FROM c WINDOW w AS (PARTITION BY user_id ORDER BY i)),
  e AS (SELECT user_id, max(n) AS n, coalesce(min(i) FILTER (WHERE NOT idle AND nx), max(n)) AS l, max(i) FILTER (WHERE NOT idle AND pv) AS tj FROM p GROUP BY 1),
  e2 AS (SELECT *, CASE WHEN tj > l THEN tj + 1 ELSE l END AS tl FROM e),
  s AS (SELECT e2.user_id, max(e2.n) AS n, max(l) AS l, max(tl) AS tl,
    count(*) FILTER (WHERE i < l AND why IN ('walking', 'still')) < 2 AND count(*) FILTER (WHERE i < l AND why = 'no music') = 0 AS m0,
    count(*) FILTER (WHERE i >= tl AND why IN ('walking', 'still')) < 2 AND count(*) FILTER (WHERE i >= tl AND why = 'no music') = 0 AS m1 FROM p JOIN e2 USING (user_id) GROUP BY 1),
  s2 AS (SELECT user_id, n, CASE WHEN l < n AND m0 THEN 0 ELSE l END AS l, tl, m1 FROM s), s3 AS (SELECT user_id, l, CASE WHEN tl > l AND m1 THEN n ELSE tl END AS tl FROM s2),
  r AS (SELECT p.*, i - row_number() OVER (PARTITION BY user_id, idle ORDER BY i) AS isl FROM p),
  k AS (SELECT r.*, CASE WHEN i < l THEN 'lead-in' WHEN i >= tl THEN 'outro' WHEN idle THEN 'pause' END AS kind FROM r JOIN s3 USING (user_id))
  SELECT user_id, kind, round(min(t), 3) AS t0, round(max(t), 3) AS t1, count(*) AS counts,
    array_to_string(list_sort(list_distinct(list(coalesce(why, 'one lively count')))), ',') AS why FROM k WHERE kind IS NOT NULL
  GROUP BY user_id, kind, CASE WHEN kind = 'pause' THEN isl END HAVING kind <> 'pause' OR count(*) >= 4""")
def islands(spark, d):
    why = (F.when(F.col("event_type") == "error", "walking").when(F.col("event_type") == "signup", "still")
           .when((F.col("event_type") == "purchase") & (F.col("k") < 50), "no music"))
    x = _indexed(spark, d, "n").withColumn("why", why).withColumn("t0", F.col("t")).withColumn("t1", F.col("t"))
    out = series.idle_spans(x, ["user_id"])
    return out.select("user_id", "kind", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"), "counts",
                      F.array_join("why", ",").alias("why"))


@query("hysteresis", f"""WITH {SER} SELECT event_id, CAST(min(CASE WHEN k >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS INT) = 1 AS usable FROM ser""")
def hysteresis(spark, d):
    return series.hysteresis(_indexed(spark, d), ["user_id"], F.col("k") >= 10).select("event_id", "usable")


@query("unwrap", f"""WITH {SER}, a AS (SELECT *, (k - 50) / 50.0 * 3.1 AS ang FROM ser), b AS (SELECT *, ang - lag(ang) OVER (PARTITION BY user_id ORDER BY i) AS dd FROM a)
  SELECT event_id, round(ang - 2 * pi() * sum(coalesce(floor((dd + pi()) / (2 * pi())), 0)) OVER (PARTITION BY user_id ORDER BY i), 4) AS yaw FROM b""")
def unwrap(spark, d):
    x = _indexed(spark, d).withColumn("ang", (F.col("k") - 50) / F.lit(50.0) * 3.1)
    return series.unwrap(x, ["user_id"], "ang").select("event_id", F.round("unwrapped", 4).alias("yaw"))


@query("implausible", f"""WITH {SER}, m AS (SELECT *, (value - v0) / (t - t0) AS v, lag((value - v0) / (t - t0)) OVER (PARTITION BY user_id ORDER BY i) AS u FROM ser)
  SELECT event_id, round(abs(v) * 3600, 3) AS speed_h, coalesce(abs(v) > 0.01, false) OR coalesce(abs(v - u) / (t - t0) > 1e-6, false) AS rejected FROM m""")
def implausible(spark, d):
    out = series.implausible(_indexed(spark, d), ["user_id"], "t", ["value"], max_speed=0.01, max_accel=1e-6)
    return out.select("event_id", F.round(F.col("speed") * 3600, 3).alias("speed_h"), "rejected")


@query("contact_weights", f"""WITH {EV}, g AS (SELECT *, row_number() OVER w AS i, lag(t) OVER w AS t0, lead(t) OVER w AS t1, lag(value) OVER w AS v0, lead(value) OVER w AS v1
    FROM ev WHERE k % 4 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
  f AS (SELECT user_id, quantile_cont(value, 0.05) AS fl FROM ev WHERE k % 4 <> 0 GROUP BY 1),
  s AS (SELECT g.*, fl, abs(CASE WHEN v0 IS NULL THEN (v1 - value) / (t1 - t) WHEN v1 IS NULL THEN (value - v0) / (t - t0)
    ELSE ((t - t0) * (t - t0) * v1 + ((t1 - t) * (t1 - t) - (t - t0) * (t - t0)) * value - (t1 - t) * (t1 - t) * v0) / ((t - t0) * (t1 - t) * (t1 - t0)) END) AS dh FROM g JOIN f USING (user_id))
  SELECT ev.event_id, round(CASE WHEN dh IS NULL THEN 0 ELSE greatest(0, least(1, 1 - (s.value - fl) / 60)) * greatest(0, least(1, 1 - dh / 0.01)) END, 4) AS weight FROM ev LEFT JOIN s USING (event_id)""")
def contact_weights(spark, d):
    out = series.contact_weights(_user(spark, d), ["user_id"], ["user_id"], "t", "value", F.col("k") % 4 != 0, band=60.0, max_speed=0.01, width_s=DAY)
    return out.select("event_id", F.round("weight", 4).alias("weight"))


@query("close_contacts", f"""WITH {SER}, m AS (SELECT *, min(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS low, lag(value, 2) OVER w AS two FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY i)),
  h AS (SELECT *, v0 - 2 * value + v1 AS den FROM m WHERE i >= 2 AND i < n - 2 AND value < 10 AND value <= low AND two - value > 5)
  SELECT event_id, round(t + greatest(-0.5, least(0.5, CASE WHEN den > 1e-9 THEN 0.5 * (v0 - v1) / den ELSE 0 END)) * (t1 - t), 2) AS contact_t FROM h""")
def close_contacts(spark, d):
    out = series.close_contacts(_indexed(spark, d, "n"), ["user_id"], "t", "value", near=10.0, closing=5.0)
    return out.select("event_id", F.round("contact_t", 2).alias("contact_t"))


@query("normalise", f"""WITH {EV}, q AS (SELECT user_id, quantile_cont(value, 0.75) AS s FROM ev GROUP BY 1)
  SELECT event_id, round(value / (s + 1e-9), 4) AS normal FROM ev JOIN q USING (user_id)""")
def normalise(spark, d):
    return series.normalise(_user(spark, d), ["user_id"], "value", 0.75).select("event_id", F.round("normal", 4).alias("normal"))


@query("autocorrelation", f"""WITH {SER}, s AS (SELECT user_id, avg(value) AS m, var_pop(value) AS v, count(*) AS n FROM ev GROUP BY 1)
  SELECT a.user_id, CAST(l.lag AS BIGINT) AS lag, round(sum((a.value - m) * (b.value - m)) / (max(v) * max(s.n)), 4) AS r
  FROM ser a JOIN s USING (user_id), range(2, 8) l(lag), ser b WHERE b.user_id = a.user_id AND b.i = a.i - l.lag GROUP BY 1, 2""")
def autocorrelation(spark, d):
    out = series.autocorrelation(_indexed(spark, d), ["user_id"], "value", 2, 8)
    return out.select("user_id", "lag", F.round("r", 4).alias("r"))


@query("phase_hist", f"""WITH {EV} SELECT user_id % 10 AS key, CAST(floor((((t - {BASE}) / 5400) - floor((t - {BASE}) / 5400)) * 8) AS BIGINT) AS bin, count(*) AS hits FROM ev GROUP BY 1, 2""")
def phase_hist(spark, d):
    x = _user(spark, d).withColumn("key", F.col("user_id") % 10)
    return series.phase_histogram(x, ["key"], "t", F.lit(float(BASE)), F.lit(5400.0))


@query("half_beat_offset", f"""WITH {EV}, o AS (SELECT user_id % 10 AS key, ((t - {BASE}) / 2700 + 0.5) - floor((t - {BASE}) / 2700 + 0.5) - 0.5 AS dev FROM ev)
  SELECT key, round(quantile_cont(dev * 2700 * 1000, 0.5) FILTER (WHERE abs(dev) <= 0.25), 1) AS median_ms FROM o GROUP BY 1""")
def half_beat_offset(spark, d):
    from ..operators.quantiles import exact_quantiles
    x = _user(spark, d).withColumn("key", F.col("user_id") % 10).withColumn(
        "off", series.half_beat_offset(F.col("t"), F.lit(float(BASE)), F.lit(5400.0)))
    return exact_quantiles(x, ["key"], "off", {"m": 0.5}).select("key", F.round("m", 1).alias("median_ms"))


@query("fourier_at_beat", f"""WITH {EV}, m AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS dv, 2 * pi() * (t - {BASE}) / {DAY} AS ph FROM ev),
  g AS (SELECT user_id, count(*) AS n, sum(dv * cos(ph)) AS c1, sum(dv * sin(ph)) AS s1, sum(dv * cos(2 * ph)) AS c2, sum(dv * sin(2 * ph)) AS s2, sum(dv * dv) AS ss FROM m GROUP BY 1)
  SELECT user_id, n, round(sqrt(c1 * c1 + s1 * s1) / (sqrt(ss * n) + 1e-9), 4) AS strength,
    round(CASE WHEN n > 8 AND ss > 0 THEN least(1, (c1 * c1 + s1 * s1 + c2 * c2 + s2 * s2) * 2 / (n * ss)) ELSE 0 END, 4) AS lock FROM g""")
def fourier_at_beat(spark, d):
    x = _user(spark, d).withColumn("spc", F.lit(DAY))
    out = series.fourier_at(x, ["user_id"], "t", "value", F.lit(float(BASE)), F.col("spc"))
    return out.select("user_id", "n", F.round("strength", 4).alias("strength"), F.round("lock", 4).alias("lock"))


@query("xcorr_lag", f"""WITH {EV}, a AS (SELECT user_id % 5 AS key, t, value FROM ev WHERE event_type = 'click'), b AS (SELECT user_id % 5 AS key, t, value FROM ev WHERE event_type = 'view'),
  e AS (SELECT key, greatest(a0, b0) + 14400 AS lo, least(a1, b1) - 14400 AS hi FROM (SELECT key, min(t) AS a0, max(t) AS a1 FROM a GROUP BY 1) JOIN (SELECT key, min(t) AS b0, max(t) AS b1 FROM b GROUP BY 1) USING (key)),
  g AS (SELECT key, CAST(unnest(range(-4, CAST(ceil((hi - lo) / 3600) AS BIGINT) + 4)) AS BIGINT) AS g, lo, CAST(ceil((hi - lo) / 3600) AS BIGINT) AS n FROM e),
  p AS (SELECT key, g, n, lo + g * 3600 AS t FROM g),
  pa AS (SELECT p.*, a.t AS ta, a.value AS va FROM p ASOF LEFT JOIN a ON p.key = a.key AND p.t >= a.t), pa2 AS (SELECT pa.*, a.t AS tb, a.value AS vb FROM pa ASOF LEFT JOIN a ON pa.key = a.key AND pa.t < a.t),
  av AS (SELECT key, g, n, t, CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END AS av FROM pa2),
  pb AS (SELECT av.*, b.t AS ta, b.value AS va FROM av ASOF LEFT JOIN b ON av.key = b.key AND av.t >= b.t), pb2 AS (SELECT pb.*, b.t AS tb, b.value AS vb FROM pb ASOF LEFT JOIN b ON pb.key = b.key AND pb.t < b.t),
  ab AS (SELECT key, g, n, av, CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END AS bv FROM pb2)
  SELECT x.key, CAST(l.lag AS BIGINT) AS lag, round(corr(x.av, y.bv), 4) AS r FROM ab x, range(-4, 5) l(lag), ab y WHERE x.g >= 0 AND x.g < x.n AND y.key = x.key AND y.g = x.g + l.lag GROUP BY 1, 2""")
def xcorr_lag(spark, d):
    e = _user(spark, d).withColumn("key", F.col("user_id") % 5)
    a, b = [e.filter(F.col("event_type") == k).select("key", "t", "value") for k in ("click", "view")]
    out = series.xcorr_lag(a, b, ["key"], "t", "value", 4, 3600.0, DAY)
    return out.select("key", "lag", F.round("r", 4).alias("r"))


@query("grid_score", f"""WITH {EV}, cue AS (SELECT user_id % 10 AS key, t, value FROM ev WHERE event_type = 'view'), env AS (SELECT user_id % 10 AS key, t, k / 100.0 AS env FROM ev WHERE event_type = 'click'),
  pos AS (SELECT DISTINCT user_id % 10 AS key, CAST(floor((t - {BASE}) / 21600) AS BIGINT) AS q FROM ev), p AS (SELECT *, {BASE} + q * 21600 AS at,
    CASE WHEN q % 16 = 0 THEN 0 WHEN q % 4 = 0 THEN 1 WHEN q % 2 = 0 THEN 2 ELSE 3 END AS level FROM pos),
  b AS (SELECT p.key, p.q, max(value) AS best FROM p JOIN cue ON cue.key = p.key AND abs(cue.t - p.at) <= CASE WHEN level < 3 THEN 5400 ELSE 2700 END GROUP BY 1, 2),
  l AS (SELECT p.key, p.q, max(env) AS loud FROM p JOIN env ON env.key = p.key AND abs(env.t - p.at) <= 1800 GROUP BY 1, 2)
  SELECT p.key, p.q, round(CASE WHEN best IS NULL THEN 0 WHEN level = 3 THEN CASE WHEN p.q % 3 = 0 THEN 0.9 ELSE 0 END
    ELSE least(1, best / 200 * (1 + 0.3 * coalesce(loud, 0))) END, 6) AS score FROM p LEFT JOIN b USING (key, q) LEFT JOIN l USING (key, q)""")
def grid_score(spark, d):
    e = _user(spark, d).withColumn("key", F.col("user_id") % 10)
    q = F.floor((F.col("t") - BASE) / 21600)
    pos = e.select("key", q.alias("q")).distinct().withColumn("at", BASE + F.col("q") * F.lit(21600.0))
    pos = pos.withColumn("level", C.metrical(F.col("q"))).withColumn("fast", F.pmod("q", F.lit(3)) == 0)
    cues = e.filter("event_type = 'view'").select("key", "t", (F.col("value") / 200).alias("cue"))
    env = e.filter("event_type = 'click'").select("key", "t", (F.col("k") / 100).alias("env"))
    reach = F.when(F.col("level") < 3, 5400.0).otherwise(2700.0)
    out = series.grid_score(pos, cues, env, "key", "t", reach, 5400.0, accent_reach=1800.0)
    return out.select("key", "q", F.round("score", 6).alias("score"))


# -- grids --------------------------------------------------------------------

BEATS = EV + f""", bt AS (SELECT user_id, (t - {BASE}) / 3600 AS h, value, row_number() OVER w - 1 AS i, (t - lag(t) OVER w) / 3600 AS gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
  med AS (SELECT user_id, quantile_cont(gap, 0.5) AS mg FROM bt GROUP BY 1),
  st AS (SELECT bt.*, mg, CASE WHEN gap IS NULL THEN 0 ELSE greatest(1, round_even(gap / mg, 0)) END AS step FROM bt JOIN med USING (user_id)),
  ix AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY i) AS c FROM st),
  ft AS (SELECT user_id, count(*) AS n, max(mg) AS mg, CASE WHEN count(*) < 4 THEN coalesce(max(mg), 0.5) ELSE regr_slope(h, c) END AS spc,
    CASE WHEN count(*) < 4 THEN min(h) ELSE regr_intercept(h, c) END AS phase, stddev_pop(gap / step) / avg(gap / step) AS cv FROM ix GROUP BY 1)"""


def _beats(spark, d):
    return events(spark, d).select("user_id", ((F.col("t") - BASE) / 3600).alias("h"), "value", "k", "event_type")


@query("grid_fit", f"WITH {BEATS} SELECT user_id, n, round(mg, 4) AS median_gap, round(spc, 4) AS spc, round(phase, 3) AS phase FROM ft")
def grid_fit(spark, d):
    g, _ = grid.fit(_beats(spark, d), "user_id", "h", width_s=24.0)
    return g.select("user_id", "n", F.round("median_gap", 4).alias("median_gap"), F.round("spc", 4).alias("spc"), F.round("phase", 3).alias("phase"))


@query("grid_confidence", f"""WITH {BEATS}, z AS (SELECT *, CASE WHEN n < 4 THEN 0 ELSE round_even(greatest(0, 1 - cv / 0.5) * least(1, n / 8), 3) END AS c FROM ft)
  SELECT user_id, round(cv, 4) AS cv, round(CASE WHEN 60 / spc BETWEEN 70 AND 180 THEN c ELSE least(c, 0.4) END, 3) AS confidence FROM z""")
def grid_confidence(spark, d):
    g, _ = grid.fit(_beats(spark, d), "user_id", "h", width_s=24.0)
    return g.select("user_id", F.round("cv", 4).alias("cv"), F.round("confidence", 3).alias("confidence"))


@query("beat_index", f"WITH {BEATS} SELECT user_id, round(h, 6) AS h, CAST(c AS BIGINT) AS c FROM ix")
def beat_index(spark, d):
    _, x = grid.fit(_beats(spark, d), "user_id", "h", width_s=24.0)
    return x.select("user_id", F.round("h", 6).alias("h"), F.col("c").cast("bigint").alias("c"))


@query("half_time", f"""WITH {EV}, bt AS (SELECT user_id, (t - {BASE}) / 3600 AS h, row_number() OVER w - 1 AS i, (t - lag(t) OVER w) / 3600 AS gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
  db AS (SELECT user_id, h, h - lag(h) OVER (PARTITION BY user_id ORDER BY h) AS gap FROM bt WHERE i % (2 + 2 * (user_id % 2)) = 0),
  bars AS (SELECT user_id, quantile_cont(gap, 0.5) AS bar, count(gap) AS bars FROM db GROUP BY 1),
  med AS (SELECT user_id, median(gap) AS mg FROM bt GROUP BY 1), m AS (SELECT med.*, CASE WHEN bars >= 2 THEN bar / mg ELSE 4 END AS bar_beats FROM med LEFT JOIN bars USING (user_id)),
  u AS (SELECT *, 60 / mg < 70 AND round_even(bar_beats, 0) = 2 AS half FROM m),
  st AS (SELECT bt.*, mg, bar_beats, half, CASE WHEN gap IS NULL THEN 0 ELSE greatest(1, round_even(gap / CASE WHEN half THEN mg / 2 ELSE mg END, 0)) END AS step FROM bt JOIN u USING (user_id)),
  ix AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY i) AS c FROM st)
  SELECT user_id, count(*) AS n, round(max(bar_beats), 4) AS bar_beats, coalesce(bool_or(half), false) AND count(*) >= 4 AS half, CAST(max(c) AS BIGINT) AS last_c, round(CASE WHEN count(*) < 4 THEN coalesce(max(mg), 0.5) ELSE regr_slope(h, c) END, 4) AS spc,
    round(CASE WHEN count(*) < 4 THEN min(h) ELSE regr_intercept(h, c) END, 3) AS phase FROM ix GROUP BY 1""")
def half_time(spark, d):
    """Every second beat a downbeat for one half of the users, every fourth for the other: slow two-beat bars are read at double the rate."""
    x = series.indexed(_beats(spark, d), ["user_id"], "h", width_s=24.0)
    down = x.filter(F.col("idx") % (2 + 2 * (F.col("user_id") % 2)) == 0).select("user_id", "h")
    g, _ = grid.fit(_beats(spark, d), "user_id", "h", down, width_s=24.0)
    return g.select("user_id", "n", F.round("bar_beats", 4).alias("bar_beats"), "half", "last_c", F.round("spc", 4).alias("spc"), F.round("phase", 3).alias("phase"))


@query("phase_vote", f"""WITH {BEATS}, db AS (SELECT user_id, (t - {BASE}) / 3600 AS h FROM ev WHERE event_type = 'signup'),
  nr AS (SELECT db.user_id, db.h, arg_min(ix.c, (abs(ix.h - db.h), ix.h)) AS c FROM db JOIN ix ON ix.user_id = db.user_id GROUP BY 1, 2),
  vt AS (SELECT user_id, {', '.join(f"count(*) FILTER (WHERE c % 4 = {k}) AS v{k}" for k in range(4))} FROM nr GROUP BY 1),
  sc AS (SELECT user_id, {', '.join(f"coalesce(avg(value) FILTER (WHERE c % 4 = {k}), 0) AS s{k}" for k in range(4))} FROM ix GROUP BY 1),
  a AS (SELECT ft.*, [s0, s1, s2, s3] AS s, [coalesce(v0, 0), coalesce(v1, 0), coalesce(v2, 0), coalesce(v3, 0)] AS v FROM ft JOIN sc USING (user_id) LEFT JOIN vt USING (user_id)),
  b AS (SELECT *, list_position(s, list_max(s)) - 1 AS kick, list_reverse_sort(s)[2] AS second, list_sum(v) AS votes FROM a),
  c AS (SELECT *, CASE WHEN second > 0 THEN list_max(s) / second ELSE 1 END AS margin, CASE WHEN votes > 0 THEN list_position(v, list_max(v)) - 1 ELSE kick END AS model FROM b),
  e AS (SELECT *, CASE WHEN margin >= 1.1 THEN kick ELSE model END AS k, least(1, greatest(0, (margin - 1) / 0.3)) AS strength FROM c)
  SELECT user_id, CAST(k AS BIGINT) AS k, round(margin, 4) AS margin, round(phase + spc * k, 3) AS count_one,
    round_even(CASE WHEN votes > 0 AND k = kick AND kick = model THEN 0.5 + 0.5 * least(strength, v[k + 1] / votes) ELSE 0.4 * abs(strength - CASE WHEN votes > 0 THEN v[model + 1] / votes ELSE 0 END) END, 3) AS sure
  FROM e WHERE n >= 8""")
def phase_vote(spark, d):
    b = _beats(spark, d)
    fits, x = grid.fit(b.withColumn("accent", F.col("value")), "user_id", "h", width_s=24.0, payload=["accent"], materialise=True)
    # Without downbeats no track reads as half-time, so the beats are the counts.
    out = grid.phase_vote(fits.filter("n >= 8"), x, None, b.filter("event_type = 'signup'"), "user_id", "h", width_s=24.0)
    return out.select("user_id", F.col("k").cast("bigint").alias("k"), F.round("margin", 4).alias("margin"),
                      F.round("count_one_s", 3).alias("count_one"), F.round("count_one_confidence", 3).alias("sure"))


@query("tempo_alternates", f"""WITH {BEATS} SELECT user_id, CASE WHEN n < 4 THEN 'few' WHEN 60 / spc BETWEEN 70 AND 180 THEN 'plain' ELSE 'odd' END AS kind,
  round(spc / 2, 4) AS double_spc, round(spc * 2, 4) AS half_spc, round(120 / spc, 2) AS double_bpm FROM ft""")
def tempo_alternates(spark, d):
    g, _ = grid.fit(_beats(spark, d), "user_id", "h", width_s=24.0)
    g = g.withColumn("alts", grid.tempo_alternates(F.col("spc"), F.col("bpm"))).withColumn(
        "warn", grid.warnings(F.col("n"), F.lit(False), F.lit(2.0), F.col("bpm")))
    kind = F.when(F.exists("warn", lambda w: w.startswith("few beats")), "few").when(F.size("warn") > 0, "odd").otherwise("plain")
    a = F.col("alts")
    return g.select("user_id", kind.alias("kind"), F.round(a[0]["seconds_per_count"], 4).alias("double_spc"),
                    F.round(a[1]["seconds_per_count"], 4).alias("half_spc"), F.round(a[0]["bpm"], 2).alias("double_bpm"))


GRID_OF = f"(t - {BASE}) / 60 AS m, 0.5 + (k % 13) / 10.0 AS spc, (user_id % 7) - 2.0 AS one"


@query("count_labels", f"""WITH {EV}, g AS (SELECT event_id, {GRID_OF}, (t - {BASE}) / 3600 AS x FROM ev)
  SELECT event_id, CAST(floor((x - one) / spc + 1) AS BIGINT) AS c, CAST(least(greatest(floor((x - one) / spc + 1), 1), 600) AS BIGINT) AS current,
    CAST(least(greatest(floor((x - one) / spc + 1 + 0.5), 1), 601) AS BIGINT) AS boundary,
    CAST(floor((floor((x - one) / spc + 1) - 1) / 8) * 8 + 1 AS BIGINT) AS eight, (CAST(floor((x - one) / spc + 1) AS BIGINT) - 1) % 8 + 1 AS label,
    CAST(greatest(1, floor((720 - one) / spc) + 1) AS BIGINT) AS total FROM g""")
def count_labels(spark, d):
    e = events(spark, d).select("event_id", ((F.col("t") - BASE) / 3600).alias("x"), (0.5 + (F.col("k") % 13) / 10.0).alias("spc"),
                                ((F.col("user_id") % 7) - 2.0).alias("one"))
    one, spc, x = F.col("one"), F.col("spc"), F.col("x")
    c = F.floor(C.count_at_time(one, spc, x))
    total = F.lit(600).cast("bigint")
    return e.select("event_id", c.alias("c"), C.current_count(one, spc, total, x).alias("current"),
                    C.nearest_boundary(one, spc, total, x).alias("boundary"), C.eight_start(c).alias("eight"),
                    C.count_label(c).alias("label"), C.count_total(one, spc, F.lit(720.0)).alias("total"))


@query("snap_rebase", f"""WITH {EV}, g AS (SELECT event_id, k, 0.5 + (k % 13) / 10.0 AS spc, 1.0 + (user_id % 7) / 4.0 AS one, value / 10 AS req FROM ev),
  s AS (SELECT *, round_even((req - one) / spc, 0) AS k0 FROM g), t AS (SELECT *, CASE WHEN one + k0 * spc < 0 THEN k0 + 1 ELSE k0 END AS kk FROM s),
  u AS (SELECT *, one + kk * spc AS t FROM t)
  SELECT event_id, CASE WHEN t <= 12 THEN round(t, 4) END AS count_one, CASE WHEN t <= 12 THEN CAST(kk AS BIGINT) END AS beats,
    CASE WHEN t <= 12 THEN CAST(greatest(1, floor((12 - round(t, 6)) / spc) + 1) AS BIGINT) END AS total,
    CASE WHEN t <= 12 THEN CAST(CASE WHEN kk % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN (round_even((one + spc - round(t, 6)) / spc, 0) % 4) <> 0 THEN 1 ELSE 0 END AS BIGINT) END AS alts FROM u""")
def snap_rebase(spark, d):
    e = events(spark, d).select("event_id", (0.5 + (F.col("k") % 13) / 10.0).alias("spc"),
                                (1.0 + (F.col("user_id") % 7) / 4.0).alias("one"), (F.col("value") / 10).alias("req"))
    alt = F.struct((F.col("one") + F.col("spc")).alias("count_one_s"), F.lit(1).cast("bigint").alias("shift_counts"), F.lit(0.3).alias("confidence"))
    pc = F.struct(F.col("one").alias("count_one_s"), F.col("spc").alias("seconds_per_count"), F.array(alt).alias("count_one_alternates"))
    r = e.withColumn("r", C.rebase(pc, F.col("req"), F.lit(12.0)))
    n = F.when(F.col("r").isNotNull(), F.coalesce(F.size(F.col("r.count_one_alternates")), F.lit(0)).cast("bigint"))
    return r.select("event_id", F.round("r.count_one_s", 4).alias("count_one"), F.col("r.moved_beats").alias("beats"),
                    F.col("r.count_total").alias("total"), F.when(n < 0, 0).otherwise(n).cast("bigint").alias("alts"))


@query("grid_edits", f"""WITH {EV}, g AS (SELECT event_id, 0.5 + (k % 13) / 10.0 AS spc, 1.0 + (user_id % 7) / 4.0 AS one, value / 10 AS x FROM ev),
  o AS (SELECT *, one - floor(one / spc + 1e-6) * spc AS first FROM g)
  SELECT event_id, round(x - 8 * spc * floor((x - one) / (8 * spc) + 0.5), 4) AS set_one, round(one + floor(x + 0.5) * spc, 4) AS nudged,
    round(one + floor(floor((x - one) / spc + 0.5) - 8 * floor(floor((x - one) / spc + 0.5) / 8 + 0.5) + 0.5) * spc, 4) AS tapped,
    round(first, 3) AS option_a, CAST(((floor((x - round(first, 3)) / spc + 0.5) % 4) + 4) % 4 AS BIGINT) AS option,
    CAST(floor((least(greatest(floor(x), 1), 32) - 1) / 4) * 4 + 1 AS BIGINT) AS window_start, round(floor(least(1.25, greatest(0.25, x)) * 20 + 0.5) / 20, 4) AS speed FROM o""")
def grid_edits(spark, d):
    e = events(spark, d).select("event_id", (0.5 + (F.col("k") % 13) / 10.0).alias("spc"), (1.0 + (F.col("user_id") % 7) / 4.0).alias("one"), (F.col("value") / 10).alias("x"))
    one, spc, x = F.col("one"), F.col("spc"), F.col("x")
    win = C.window_at(F.floor(x), 4, F.lit(32).cast("bigint"))
    return e.select("event_id", F.round(C.set_one(one, spc, x), 4).alias("set_one"), F.round(C.nudge(one, spc, x), 4).alias("nudged"),
                    F.round(C.tap_on_one(one, spc, x), 4).alias("tapped"), C.bar_options(one, spc)[0].alias("option_a"),
                    C.option_of(x, one, spc).cast("bigint").alias("option"), win["start_count"].alias("window_start"),
                    F.round(C.clamp_speed(x), 4).alias("speed"))


@query("taps", f"""WITH {EV}, i AS (SELECT user_id, (t - {BASE}) / 3600 AS h, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS i FROM ev WHERE event_type = 'purchase'),
  g AS (SELECT user_id, count(*) AS n, (max(h) - min(h)) / (count(*) - 1) AS spc, avg(h) AS m, avg(i) AS a FROM i GROUP BY 1 HAVING count(*) >= 2)
  SELECT user_id, round(spc, 4) AS spc, round(m - a * spc, 4) AS one FROM g WHERE spc > 0""")
def taps(spark, d):
    out = grid.grid_from_taps(_beats(spark, d).filter("event_type = 'purchase'"), "user_id", "h", width_s=24.0)
    return out.select("user_id", F.round("spc", 4).alias("spc"), F.round("one", 4).alias("one"))


@query("label_score", f"""WITH {BEATS}, l AS (SELECT user_id, min((t - {BASE}) / 3600) AS label FROM ev WHERE event_type = 'signup' GROUP BY 1), j AS (SELECT *, round_even((phase - label) / spc, 0) AS k FROM ft JOIN l USING (user_id))
  SELECT user_id, CAST(((k + 2) % 4 + 4) % 4 - 2 AS BIGINT) AS phase_off, round((phase - (label + k * spc)) * 1000, 0) AS off_ms FROM j""")
def label_score(spark, d):
    b = _beats(spark, d)
    g, _ = grid.fit(b, "user_id", "h", width_s=24.0)
    lab = b.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("h").alias("label_s"))
    out = grid.label_score(g.withColumn("count_one_s", F.col("phase")), lab, "user_id")
    return out.select("user_id", "phase_off", F.round("off_ms", 0).alias("off_ms"))


@query("part_at_count", f"""WITH {EV}, p AS (SELECT user_id, min(event_id) AS part, CAST(floor((t - {BASE}) / 3600) AS BIGINT) AS start_count FROM ev WHERE event_type = 'signup' GROUP BY 1, 3),
  c AS (SELECT event_id, user_id, CAST(floor((t - {BASE}) / 3600) AS BIGINT) AS c FROM ev WHERE event_type = 'click'), f AS (SELECT user_id, arg_min(part, start_count) AS first FROM p GROUP BY 1)
  SELECT c.event_id, coalesce(p.part, f.first) AS part FROM c ASOF LEFT JOIN p ON p.user_id = c.user_id AND c.c >= p.start_count LEFT JOIN f ON f.user_id = c.user_id""")
def part_at_count(spark, d):
    e = _user(spark, d).withColumn("c", F.floor((F.col("t") - BASE) / 3600))
    parts = e.filter("event_type = 'signup'").groupBy("user_id", F.col("c").alias("start_count")).agg(F.min("event_id").alias("part_id"))
    out = grid.part_at(e.filter("event_type = 'click'").select("event_id", "user_id", "c"), parts, ["user_id"], "c", ["part_id"], width=24.0)
    return out.select("event_id", F.col("part.part_id").alias("part"))


@query("containing_span", f"""WITH {EV}, p AS (SELECT user_id, event_id AS pid, t AS a, t + 3600 * k AS b FROM ev WHERE event_type = 'signup'), c AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'click')
  SELECT c.event_id, CASE WHEN p.b > c.t THEN p.pid END AS parent FROM c ASOF LEFT JOIN p ON p.user_id = c.user_id AND c.t >= p.a""")
def containing_span(spark, d):
    e = _user(spark, d)
    par = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("pid"), F.col("t").alias("a"), (F.col("t") + 3600 * F.col("k")).alias("b"))
    out = grid.containing_span(e.filter("event_type = 'click'").select("event_id", "user_id", "t"), par, ["user_id"], "t", "a", "b", ["pid"], width=DAY)
    return out.select("event_id", F.col("parent.pid").alias("parent"))
