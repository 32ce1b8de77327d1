"""The composed analysis over the driver's events: a user's month as a dance, days as counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis
from .base import EV, events, query

DAY, BASE = 86400.0, 1704067200


def _level(name: str, parents: str, finest: int, lo: int, hi: int, pref: str, quantile: float) -> str:
    """SQL that cuts every parent span by a recursion over its candidates, each keeping its best total and its predecessor."""
    fits = f"q - x.q BETWEEN least({lo}, b - a) AND {hi} AND x.v IS NOT NULL"
    return f"""{name}c AS (SELECT key, quantile_cont(score, {quantile}) AS cost FROM sco WHERE lev <= {finest} AND (lev < 3 OR fast) GROUP BY 1),
  {name}q AS (SELECT x.key, x.parent, x.a, x.b, x.bpm, coalesce(c.cost, 0.35) AS cost, s.q, s.score, row_number() OVER (PARTITION BY x.key, x.a ORDER BY s.q) AS j
    FROM {parents} x JOIN sco s ON s.key = x.key AND s.q BETWEEN x.a AND x.b LEFT JOIN {name}c c ON c.key = x.key WHERE s.q IN (x.a, x.b) OR (s.lev <= {finest} AND (s.lev < 3 OR s.fast))),
  {name}d AS (SELECT key, parent, a, b, j, q, [{{'q': q, 'v': 0.0::DOUBLE, 'p': NULL::BIGINT}}] AS arr FROM {name}q WHERE j = 1
    UNION ALL SELECT key, parent, a, b, j, q, list_append(arr, {{'q': q, 'v': best.v + CASE WHEN q < b THEN score - cost ELSE 0 END, 'p': best.q}}) FROM (
      SELECT n.*, d.arr, list_sort(list_transform(list_filter(d.arr, lambda x: {fits.replace('q - x.q', 'n.q - x.q').replace('b - a', 'n.b - n.a')}), lambda x: {{'rank': round(x.v - 0.25 * abs(log2((n.q - x.q) / {pref}.0)), 9), 'q': x.q, 'v': x.v - 0.25 * abs(log2((n.q - x.q) / {pref}.0))}}), 'DESC')[1] AS best
      FROM {name}d d JOIN {name}q n ON n.key = d.key AND n.a = d.a AND n.j = d.j + 1)),
  {name}t AS (SELECT key, parent, a, b, arr, CASE WHEN arr[-1].v IS NULL THEN a ELSE arr[-1].p END AS cur, [b] AS cuts FROM {name}d WHERE q = b
    UNION ALL SELECT key, parent, a, b, arr, list_filter(arr, lambda x: x.q = cur)[1].p, list_prepend(cur, cuts) FROM {name}t WHERE cur IS NOT NULL),
  {name} AS (SELECT key, parent, cuts[i] AS a, cuts[i + 1] AS b, row_number() OVER (PARTITION BY key ORDER BY cuts[i]) - 1 AS step
    FROM (SELECT key, parent, cuts, unnest(range(1, len(cuts))) AS i FROM {name}t WHERE cur IS NULL)),
  {name}n AS (SELECT key, step AS parent, a, b, CASE WHEN key % 2 = 1 THEN 120 ELSE 100 END AS bpm FROM {name})"""


ANALYSE = f"""WITH RECURSIVE {EV},
  s AS (SELECT user_id AS key, t, (t - {BASE}) / 86400 AS beats, value, k, k % 5 <> 0 AS ok, value - 20 AS p, CAST(k AS DOUBLE) - 50 AS r, event_type, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
    t - lag(t) OVER w AS dt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)),
  lv AS (SELECT key, quantile_cont(value, 0.75) AS lvl, quantile_cont(sqrt(p * p + r * r), 0.5) + 1e-6 AS med FROM s WHERE ok GROUP BY 1),
  ct AS (SELECT key, CAST(floor(beats) AS BIGINT) AS c, avg(ok::INT) AS seen, round_even(avg(value) / (coalesce(max(lvl), 0) + 1e-9), 2) AS limb, round_even(avg(k / 100.0), 2) AS root, avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1 END) AS music
    FROM s LEFT JOIN lv USING (key) GROUP BY 1, 2),
  cw AS (SELECT *, CASE WHEN seen < 0.5 THEN 'not in frame' WHEN music < 0.2 THEN 'no music' WHEN limb < 0.5 AND root > 0.6 THEN 'walking' WHEN limb < 0.35 AND root < 0.6 THEN 'still' END AS why,
    row_number() OVER (PARTITION BY key ORDER BY c) - 1 AS j, count(*) OVER (PARTITION BY key) AS m FROM ct),
  pr AS (SELECT *, why IS NOT NULL AS idle, lead(why IS NULL) OVER w AS nx, lag(why IS NULL) OVER w AS pv FROM cw WINDOW w AS (PARTITION BY key ORDER BY j)),
  e1 AS (SELECT key, max(m) AS m, coalesce(min(j) FILTER (WHERE NOT idle AND nx), max(m)) AS l, max(j) FILTER (WHERE NOT idle AND pv) AS tj FROM pr GROUP BY 1),
  e2 AS (SELECT key, m, l, CASE WHEN tj > l THEN tj + 1 ELSE l END AS tl FROM e1),
  e3 AS (SELECT e2.*, count(*) FILTER (WHERE j < l AND why IN ('walking', 'still')) < 2 AND count(*) FILTER (WHERE j < l AND why NOT IN ('walking', 'still')) = 0 AS m0,
    count(*) FILTER (WHERE j >= tl AND why IN ('walking', 'still')) < 2 AND count(*) FILTER (WHERE j >= tl AND why NOT IN ('walking', 'still')) = 0 AS m1 FROM e2 JOIN pr USING (key) GROUP BY ALL),
  e4 AS (SELECT key, m, CASE WHEN l < m AND m0 THEN 0 ELSE l END AS l, tl, m1 FROM e3), e5 AS (SELECT key, m, l, CASE WHEN tl > l AND m1 THEN m ELSE tl END AS tl FROM e4),
  dance AS (SELECT key, 0 AS parent, 4 * min(c) FILTER (WHERE l = m OR j >= l) AS a, 4 * (max(c) FILTER (WHERE l = m OR j < tl) + 1) AS b, CASE WHEN key % 2 = 1 THEN 120 ELSE 100 END AS bpm FROM cw JOIN e5 USING (key, m) GROUP BY key),
  md AS (SELECT key, coalesce(greatest(2, round_even(43200 / quantile_cont(dt, 0.5), 0)), 2) AS w FROM s GROUP BY 1),
  st AS (SELECT x.key, x.i, CASE WHEN x.i > 0 AND x.i < x.n - 1 AND x.ok AND x.value <= min(y.value) FILTER (WHERE abs(y.i - x.i) <= 2)
      THEN greatest(0, (least(greatest(max(y.value) FILTER (WHERE y.i < x.i), 0), greatest(max(y.value) FILTER (WHERE y.i > x.i), 0)) - x.value) /
        (least(greatest(max(y.value) FILTER (WHERE y.i < x.i), 0), greatest(max(y.value) FILTER (WHERE y.i > x.i), 0)) + 1e-6)) ELSE 0 END AS stop
    FROM s x JOIN md USING (key) JOIN s y ON y.key = x.key AND abs(y.i - x.i) <= md.w GROUP BY x.key, x.i, x.n, x.ok, x.value),
  tv AS (SELECT key, i, n, ok, t, avg(p) OVER b AS a1, avg(r) OVER b AS a2, avg(p) OVER f AS b1, avg(r) OVER f AS b2 FROM s
    WINDOW b AS (PARTITION BY key ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY key ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
  cu AS (SELECT tv.key, t, greatest(stop, CASE WHEN i >= 3 AND i < n - 3 AND ok THEN (1 - (a1 * b1 + a2 * b2) / (sqrt(a1 * a1 + a2 * a2) * sqrt(b1 * b1 + b2 * b2) + 1e-9)) / 2
      * least(1, least(sqrt(a1 * a1 + a2 * a2), sqrt(b1 * b1 + b2 * b2)) / med) ELSE 0 END) AS cue FROM tv JOIN st USING (key, i) LEFT JOIN lv USING (key)),
  po AS (SELECT key, q, {BASE} + q * 21600 AS pos, CASE WHEN q % 16 = 0 THEN 0 WHEN q % 4 = 0 THEN 1 WHEN q % 2 = 0 THEN 2 ELSE 3 END AS lev,
    q % 3 = 0 AND EXISTS (SELECT 1 FROM s WHERE s.key = g.key AND floor(s.beats * 4) = g.q) AS fast FROM (SELECT key, unnest(range(a, b + 1)) AS q FROM dance) g),
  be AS (SELECT po.key, q, arg_max({{'cue': cue, 'off': t - pos}}, (cue, -t)) AS best FROM po JOIN cu ON cu.key = po.key AND abs(cu.t - po.pos) <= CASE WHEN lev < 3 THEN 21600 ELSE 10800 END GROUP BY 1, 2),
  sco AS (SELECT po.*, CASE WHEN best IS NULL THEN 0 WHEN lev = 3 THEN CASE WHEN fast THEN 0.9 ELSE 0 END ELSE best.cue END::DOUBLE AS score, best.off AS off FROM po LEFT JOIN be USING (key, q)),
  top AS (SELECT * FROM dance WHERE a < b), {_level('bg', 'top', 1, 4, 12, "CASE WHEN n.bpm >= 110 THEN 8 ELSE 4 END / 1", 0.65)},
  {_level('im', 'bgn', 2, 2, 8, '4', 0.5)}, {_level('ad', 'imn', 3, 1, 4, '2', 0.4)},
  ch AS (SELECT key, step, a, b, 0::BIGINT AS chunk, a AS start, ((b - a) / 4 >= 3 AND b % 16 IN (0, 2)) OR (b - a) / 4 >= 6 AS cl FROM bg WHERE step = 0
    UNION ALL SELECT n.key, n.step, n.a, n.b, ch.chunk + ch.cl::INT, CASE WHEN ch.cl THEN n.a ELSE ch.start END, ((n.b - CASE WHEN ch.cl THEN n.a ELSE ch.start END) / 4 >= 3 AND n.b % 16 IN (0, 2)) OR (n.b - CASE WHEN ch.cl THEN n.a ELSE ch.start END) / 4 >= 6
      FROM ch JOIN bg n ON n.key = ch.key AND n.step = ch.step + 1),
  al AS (SELECT key, 'beginner' AS level, step, NULL AS parent, chunk, a, b FROM ch UNION ALL SELECT im.key, 'intermediate', im.step, im.parent, chunk, im.a, im.b FROM im JOIN ch ON ch.key = im.key AND ch.step = im.parent
    UNION ALL SELECT ad.key, 'advanced', ad.step, ad.parent, chunk, ad.a, ad.b FROM ad JOIN im ON im.key = ad.key AND im.step = ad.parent JOIN ch ON ch.key = im.key AND ch.step = im.parent),
  fe AS (SELECT al.key, level, step, count(*) AS samples, avg(value) AS mean_energy, max(value) / (avg(value) + 1e-6) AS peakiness FROM al JOIN s ON s.key = al.key AND s.beats * 4 >= a AND s.beats * 4 <= b GROUP BY 1, 2, 3),
  q AS (SELECT al.*, coalesce(samples, 0) AS samples, mean_energy, peakiness, score AS end_cue, off FROM al LEFT JOIN fe USING (key, level, step) LEFT JOIN sco ON sco.key = al.key AND sco.q = al.b),
  z AS (SELECT key, level, quantile_cont(mean_energy, 0.2) AS lo, quantile_cont(peakiness, 0.75) AS hp, quantile_cont(peakiness, 0.3) AS lp FROM q WHERE mean_energy IS NOT NULL GROUP BY 1, 2)"""


@query("analyse", f"""{ANALYSE} SELECT q.key, level, step, parent, chunk, a, b, samples, round(mean_energy, 6) AS mean_energy, round(end_cue, 6) AS end_cue, round(off, 3) AS end_offset,
  CASE WHEN lo IS NOT NULL THEN CASE WHEN mean_energy <= lo THEN 'small / hold' WHEN peakiness >= hp AND end_cue >= 0.5 THEN 'sharp (hits and stops)' WHEN peakiness <= lp THEN 'smooth / even' ELSE '—' END END AS quality,
  a % 2 = 1 OR b % 2 = 1 AS sub_beat FROM q LEFT JOIN z USING (key, level)""")
def analyse(spark, d):
    steps, _ = _analysed(spark, d)
    return steps.select("key", "level", "step", "parent", "chunk", "a", "b", "samples", F.round("mean_energy", 6).alias("mean_energy"), F.round("end_cue", 6).alias("end_cue"), F.round("end_offset", 3).alias("end_offset"), "quality", "sub_beat")


def _analysed(spark, d):
    e = events(spark, d)
    k, v = F.col("k"), F.col("value")
    samples = e.select(F.col("user_id").alias("key"), "t", (k % 5 != 0).alias("ok"), v.alias("energy"), v.alias("limb"), (k / 100).alias("root"), F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("music"),
                       (v - 20).alias("p"), (k.cast("double") - 50).alias("r"))
    grids = samples.select("key").distinct().select("key", F.lit(float(BASE)).alias("one"), F.lit(DAY).alias("spc"), F.when(F.col("key") % 2 == 1, 120.0).otherwise(100.0).alias("bpm"))
    quarter = F.floor((F.col("t") - BASE) / 21600)
    fast = samples.select("key", quarter.alias("q")).where("q % 3 = 0").distinct()
    return analysis.analyse(samples, grids, "key", ["p", "r"], fast=fast, width_s=DAY)
