"""The remaining expressions and plans, each over a whole driver table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import counts as C, quat as Q
from ..operators import evalstats, grid, jobs, motion, retention, series
from .base import EV, LOG, event_log, events, query, table

BASE = 1704067200


@query("nearest_index", f"WITH {EV} SELECT event_id, CAST(CASE WHEN k = 0 THEN -1 WHEN floor((value - 5) * 0.5 + 0.5) < 0 THEN 0 WHEN floor((value - 5) * 0.5 + 0.5) < k THEN floor((value - 5) * 0.5 + 0.5) ELSE -1 END AS BIGINT) AS i FROM ev")
def nearest_index(spark, d):
    e = events(spark, d)
    return e.select("event_id", series.nearest_index(F.col("value"), F.lit(5.0), F.lit(0.5), F.col("k")).cast("bigint").alias("i"))


@query("retempo", f"WITH {EV} SELECT event_id, 2 * k - 1 AS doubled, CAST(floor((k + 1) / 2 + 0.5) AS BIGINT) AS halved, round(value / 2, 4) AS fast, round(value * 2, 4) AS slow FROM ev")
def retempo(spark, d):
    k, v = F.col("k"), F.col("value")
    return events(spark, d).select("event_id", C.retempo_count(k, True).alias("doubled"), C.retempo_count(k, False).alias("halved"),
                                   F.round(C.retempo_spc(v, True), 4).alias("fast"), F.round(C.retempo_spc(v, False), 4).alias("slow"))


@query("loop_steps", f"""WITH {EV}, l AS (SELECT event_id, k, least(floor(k / 8) * 8 + 1, 90) AS s, least(floor(k / 8) * 8 + 8, 90) AS e FROM ev)
  SELECT event_id, CAST(CASE WHEN e + 1 > 90 THEN s ELSE least(greatest(e + 1, 1), 90) END AS BIGINT) AS next_start, CAST(CASE WHEN s <= 1 THEN s ELSE greatest(1, s - 8) END AS BIGINT) AS prev_start,
    round(least(1, floor((0.5 + 0.1 * greatest(0, k % 9)) * 100 + 0.5) / 100), 4) AS speed FROM l""")
def loop_steps(spark, d):
    e = events(spark, d)
    total = F.lit(90).cast("bigint")
    loop = C.loop_at(F.floor(F.col("k") / 8) * 8 + 1, 8, total)
    return e.select("event_id", C.step_loop(loop, F.col("k"), 8, 1, total)["start_count"].alias("next_start"),
                    C.step_loop(loop, F.col("k"), 8, -1, total)["start_count"].alias("prev_start"), F.round(C.build_up_speed(F.col("k") % 9), 4).alias("speed"))


@query("owner_kept_counts", f"""WITH {EV}, g AS (SELECT event_id, k, 0.5 + (k % 13) / 10.0 AS spc, value / 40 AS fresh, value / 25 AS pick FROM ev),
  s AS (SELECT *, round_even((pick - fresh) / spc, 0) AS k0 FROM g), t AS (SELECT *, fresh + CASE WHEN fresh + k0 * spc < 0 THEN k0 + 1 ELSE k0 END * spc AS t FROM s)
  SELECT event_id, k % 2 = 0 AS kept_owner, round(CASE WHEN k % 2 <> 0 THEN fresh WHEN t <= 60 THEN t END, 6) AS count_one_s FROM t""")
def owner_kept_counts(spark, d):
    """Fresh proposals against stored ones; every second stored pick is the owner's."""
    e = events(spark, d)
    alts = F.expr("cast(null as array<struct<count_one_s:double,shift_counts:bigint,confidence:double>>)")
    spc = 0.5 + (F.col("k") % 13) / 10.0
    fresh = e.select("event_id", F.struct((F.col("value") / 40).alias("count_one_s"), spc.alias("seconds_per_count"), alts.alias("count_one_alternates")).alias("pc"), F.lit(60.0).alias("end_s"))
    stored = e.select("event_id", F.struct((F.col("value") / 25).alias("count_one_s"), F.when(F.col("k") % 2 == 0, "owner").otherwise("detector").alias("count_one_source")).alias("pc"))
    out = grid.preserve_owner_counts(fresh, stored, "event_id", "end_s")
    return out.select("event_id", "kept_owner", F.round("count_one_s", 6).alias("count_one_s"))


@query("purgeable", "SELECT o_orderkey AS item FROM orders WHERE epoch_us(o_orderdate) / 1e6 + 365 * 86400 <= 900000000")
def purgeable(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("quarantined_at"))
    return retention.purgeable(m, F.lit(900000000.0)).select("item")


@query("verified_copies", "SELECT o_orderkey AS item, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS verified FROM orders")
def verified_copies(spark, d):
    """Copies of every order; some never landed, some landed changed."""
    k = F.col("o_orderkey")
    dest = F.concat(F.lit("/q/"), k.cast("string"))
    sha = F.sha2(k.cast("string").cast("binary"), 256)
    plan = table(spark, d, "orders").select(k.alias("item"), dest.alias("dest"), sha.alias("sha256"))
    copies = plan.filter("item % 3 <> 0").select("dest", F.when(F.col("item") % 5 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return retention.verified(plan, copies).select("item", "verified")


@query("frame_projection", """WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) * 4 - 0.3 AS z FROM embeddings)
  SELECT vec_id, round(CASE WHEN -z > 1e-6 THEN 320 + 500 * x / -z END, 3) AS u, round(CASE WHEN -z > 1e-6 THEN 240 - 500 * y / -z END, 3) AS v, round(y - 0.01, 6) AS above FROM p""")
def frame_projection(spark, d):
    m = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    cam = F.struct(*[F.lit(x).alias(n) for n, x in (("fx", 500.0), ("fy", 500.0), ("cx", 320.0), ("cy", 240.0))], m.alias("m"))
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    p = Q.vec(v(0), v(1), v(2) * 4 - 0.3)
    up = Q.plane_distance(p, Q.vec(F.lit(0.0), F.lit(0.01), F.lit(0.0)), Q.vec(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    uv = Q.to_frame(cam, p)
    return table(spark, d, "embeddings").select("vec_id", F.round(uv["x"], 3).alias("u"), F.round(uv["y"], 3).alias("v"), F.round(up, 6).alias("above"))


@query("rect_box", """WITH p AS (SELECT label, unnest(range(0, 4)) AS j, embedding AS e FROM embeddings), r AS (SELECT label, 0.5 + CAST(e[j * 2 + 1] AS DOUBLE) AS x, 0.5 + CAST(e[j * 2 + 2] AS DOUBLE) AS y FROM p),
  b AS (SELECT label, min(x) AS x0, max(x + 0.1) AS x1, min(y) AS y0, max(y + 0.1) AS y1 FROM r GROUP BY 1)
  SELECT label, round(greatest(0, x0 - 0.15 * (x1 - x0)), 5) AS x0, round(greatest(0, y0 - 0.2 * (y1 - y0)), 5) AS y0, round(least(1, x1 + 0.15 * (x1 - x0)), 5) AS x1 FROM b""")
def rect_box(spark, d):
    v = lambda i: 0.5 + F.get("embedding", i).cast("double")
    r = table(spark, d, "embeddings").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    r = r.select("label", v(F.col("j") * 2).alias("x"), v(F.col("j") * 2 + 1).alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"))
    return motion.rect_box(r, ["label"]).select("label", *[F.round(f"box.{c}", 5).alias(c) for c in ("x0", "y0", "x1")])


@query("crop_size", """WITH g AS (SELECT label, list_sort(list(CAST(embedding[1] AS DOUBLE))) AS s FROM embeddings GROUP BY label, vec_id // 50) SELECT label, round(s[CAST(floor(0.9 * (len(s) - 1)) AS BIGINT) + 1], 6) AS side FROM g""")
def crop_size(spark, d):
    """The browser's quantile of the crop sides of fifty samples at a time."""
    g = table(spark, d, "embeddings").groupBy("label", F.floor(F.col("vec_id") / 50)).agg(F.collect_list(F.get("embedding", F.lit(0)).cast("double")).alias("w"))
    return g.select("label", F.round(series.crop_size(F.col("w")), 6).alias("side"))


@query("latest_labels", f"WITH {EV} SELECT user_id AS clip_id, arg_max(value, (t, event_id)) AS count_one_s FROM ev WHERE event_type = 'purchase' GROUP BY 1")
def latest_labels(spark, d):
    e = events(spark, d).filter("event_type = 'purchase'").select(F.col("user_id").alias("clip_id"), F.col("value").alias("count_one_s"), F.struct("t", "event_id").alias("at"))
    return jobs.latest_labels(e).select("clip_id", "count_one_s")


@query("noise_floor_gap", f"""WITH {EV}, q AS (SELECT event_type, quantile_cont(value, 0.5) AS m, max(value) AS x FROM ev WHERE k % 2 = 0 GROUP BY 1), f AS (SELECT event_type, quantile_cont(value, 0.5) AS m, max(value) AS x FROM ev WHERE k % 2 = 1 GROUP BY 1)
  SELECT event_type, round(q.m - f.m, 4) AS median, round(q.x - f.x, 4) AS max FROM q JOIN f USING (event_type)""")
def noise_floor_gap(spark, d):
    from ..operators.quantiles import exact_quantiles

    def stats(df):
        q = exact_quantiles(df, ["event_type"], "value", {"median": 0.5, "p90": 0.9, "p99": 0.99})
        return q.join(df.groupBy("event_type").agg(F.max("value").alias("max")), "event_type")

    e = events(spark, d)
    g = evalstats.noise_floor_gap(stats(e.filter("k % 2 = 0")), stats(e.filter("k % 2 = 1")), "event_type")
    return g.select("event_type", F.round("median", 4).alias("median"), F.round("max", 4).alias("max"))


@query("sent_batches", f"WITH {LOG} SELECT visitor, id, CAST(floor((row_number() OVER (PARTITION BY visitor ORDER BY t, id) - 1) / 20) AS BIGINT) AS batch FROM logx")
def sent_batches(spark, d):
    """Outgoing batches of twenty events per visitor, as the streaming sink numbers them."""
    from ..streaming.events import batch_ids
    return batch_ids(event_log(spark, d), ["visitor"], "t", "id", width_s=86400.0).select("visitor", "id", "batch")
