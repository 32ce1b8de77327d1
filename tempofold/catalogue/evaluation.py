"""Evaluation operators over documents and labels, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evalstats as ev, identity, series
from ..operators.quantiles import exact_quantiles
from .base import EV, events, query, table

DAY = 86400.0
BASE = 1704067200

SC = """sc AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality = 1 AS pos, l.toxic, (d.n_chars % 997) / 997.0 AS score,
  (d.doc_id * 7919 % 1009) / 1009.0 AS clip, (d.n_chars * 31 % 1013) / 1013.0 AS person, (d.doc_id * 13 % 101) / 1010.0 AS limb FROM documents d JOIN labels l USING (doc_id))"""


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    j = ev.labelled(docs, table(spark, d, "labels"), ["doc_id"])
    c, i = F.col("n_chars"), F.col("doc_id")
    return j.select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("pos"), "toxic", ((c % 997) / 997).alias("score"),
                    ((i * 7919 % 1009) / 1009).alias("clip"), ((c * 31 % 1013) / 1013).alias("person"), ((i * 13 % 101) / 1010).alias("limb"))


@query("auc", f"""WITH {SC} SELECT p.lang, max(np) AS n_pos, max(nn) AS n_neg, round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auc
  FROM sc p JOIN sc n ON p.lang = n.lang AND p.pos AND NOT n.pos JOIN (SELECT lang, count(*) FILTER (WHERE pos) AS np, count(*) FILTER (WHERE NOT pos) AS nn FROM sc GROUP BY 1) c ON c.lang = p.lang GROUP BY 1""")
def auc(spark, d):
    return ev.auc(_scored(spark, d), ["lang"], "score", "pos").filter("auc is not null").select("lang", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query("operating_point", f"""WITH {SC}, m AS (SELECT lang, min(score) AS m FROM sc WHERE pos GROUP BY 1)
  SELECT lang, round(max(m), 6) AS min_pos, count(*) AS n_neg, round(avg(CASE WHEN score < m THEN 1.0 WHEN m IS NULL THEN NULL ELSE 0 END), 6) AS neg_rejected FROM sc LEFT JOIN m USING (lang) WHERE NOT pos GROUP BY 1""")
def operating_point(spark, d):
    return ev.operating_point(_scored(spark, d), ["lang"], "score", "pos").select(
        "lang", F.round("min_pos", 6).alias("min_pos"), "n_neg", F.round("neg_rejected", 6).alias("neg_rejected"))


CONF = """SELECT lang, rule, round(tp / nullif(tp + fn, 0), 6) AS recall, fn AS false_rejects, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tn / nullif(tn + fp, 0), 6) AS neg_rejected FROM (
  SELECT lang, rule, count(*) FILTER (WHERE pos AND ok) AS tp, count(*) FILTER (WHERE pos AND NOT ok) AS fn, count(*) FILTER (WHERE NOT pos AND ok) AS fp, count(*) FILTER (WHERE NOT pos AND NOT ok) AS tn FROM {src} GROUP BY 1, 2)"""


def _conf(df):
    return df.select("lang", "rule", F.round("recall", 6).alias("recall"), "false_rejects", F.round("precision", 6).alias("precision"), F.round("neg_rejected", 6).alias("neg_rejected"))


@query("confusion_sweep", f"WITH {SC}, x AS (SELECT lang, pos, t.rule, score >= t.v AS ok FROM sc, (VALUES ('0.3', 0.3), ('0.4', 0.4), ('0.5', 0.5)) t(rule, v)) " + CONF.format(src="x"))
def confusion_sweep(spark, d):
    s = _scored(spark, d)
    return _conf(ev.confusion(s, ["lang"], ev.thresholds("score", [0.3, 0.4, 0.5]), F.col("pos")))


_SIGNAL = {"clip50": "clip < 0.5", "clip40": "clip < 0.4", "smolvlm15": "score < 0.15", "xclip20": "score < 0.2", "kinetics0.5": "score < 0.005", "nobody": "person < 0.3", "partial": "score < 0.15", "frozen": "limb < 0.02",
           "lite": "person < 0.3 OR limb < 0.02"}
_RULE = {"+".join(names): " OR ".join(_SIGNAL[n] for n in names) for names in ev.COMPARED}


@query("rule_sweep", f"WITH {SC}, x AS (" + " UNION ALL ".join(f"SELECT lang, pos, '{n}' AS rule, NOT ({r}) AS ok FROM sc" for n, r in _RULE.items()) + ") " + CONF.format(src="x"))
def rule_sweep(spark, d):
    s = _scored(spark, d).withColumns({c: F.col("score") for c in ("smolvlm", "xclip", "kinetics", "full_body")})
    s = s.withColumn("lite_person", F.col("person")).withColumn("lite_limb", F.col("limb"))
    return _conf(ev.sweep(s, ["lang"], ev.gate_rules(), F.col("pos")))


@query("gate_decisions", f"""WITH {SC} SELECT doc_id, array_to_string(list_filter([CASE WHEN clip < 0.4 THEN 'looks_like_something_else' END, CASE WHEN score < 0.1 THEN 'nothing_moves' END,
  CASE WHEN doc_id % 3 <> 0 AND person < 0.3 THEN 'no_person' END, CASE WHEN doc_id % 3 <> 0 AND person >= 0.3 AND limb < 0.02 THEN 'nobody_moves' END], lambda x: x IS NOT NULL), ',') AS reasons FROM sc""")
def gate_decisions(spark, d):
    s = _scored(spark, d)
    pose = F.col("doc_id") % 3 != 0
    r = ev.gate_reasons(F.col("clip"), F.col("score"), F.when(pose, F.col("person")), F.when(pose, F.col("limb")))
    return s.select("doc_id", F.array_join(r, ",").alias("reasons"))


@query("motion_score", f"""WITH {SC} SELECT doc_id, round(CASE WHEN person < 0.3 THEN 0 ELSE least(1, 0.6 * least(1, limb * 12) + 0.2 * greatest(0, least(1, score / 0.5)) + 0.2 * CASE WHEN n_chars % 20 >= 8 AND clip < 0.25 THEN 1 ELSE 0 END) * least(1, person / 0.6) END, 6) AS score FROM sc""")
def motion_score(spark, d):
    s = _scored(spark, d)
    m = ev.motion_score(F.col("person"), F.col("limb") * 12, F.col("score"), F.col("n_chars") % 20, F.col("clip"))
    return s.select("doc_id", F.round(m, 6).alias("score"))


@query("relabel", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'amb' WHEN quality = 1 THEN 'pos' ELSE 'neg' END AS label, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN quality = 1 THEN 'pos' ELSE 'neg' END END AS relabelled_from FROM labels""")
def relabel(spark, d):
    m = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("label"))
    return ev.relabel(m, m.filter("doc_id % 4 = 0").select("doc_id", F.lit("amb").alias("new_label")), "doc_id")


@query("lowest_scores", f"WITH {SC} SELECT round(score, 6) AS score, doc_id FROM sc WHERE pos ORDER BY sc.score, doc_id LIMIT 4")
def lowest_scores(spark, d):
    return ev.lowest(_scored(spark, d).filter("pos"), "score", "doc_id").select(F.round("score", 6).alias("score"), "doc_id")


@query("latency_percentiles", f"WITH {EV} SELECT event_type AS stage, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS median_s, round(quantile_cont(value, 0.9), 4) AS p90_s FROM ev GROUP BY 1")
def latency_percentiles(spark, d):
    q = exact_quantiles(events(spark, d), ["event_type"], "value", {"median_s": 0.5, "p90_s": 0.9}, count="n")
    return q.select(F.col("event_type").alias("stage"), F.col("n").cast("bigint").alias("n"), F.round("median_s", 4).alias("median_s"), F.round("p90_s", 4).alias("p90_s"))


@query("lag_summary", f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'click'), s AS (SELECT * FROM ev WHERE event_type = 'error'),
  m AS (SELECT p.event_id, p.user_id % 10 AS key, arg_min(p.t - s.t, (abs(p.t - s.t), s.t)) AS lag FROM p JOIN s ON p.user_id = s.user_id AND abs(p.t - s.t) <= 14400 GROUP BY 1, 2)
  SELECT key, count(*) AS matched, round(quantile_cont(lag, 0.25), 2) AS q1, round(quantile_cont(lag, 0.5), 2) AS median, round(quantile_cont(lag, 0.75), 2) AS q3 FROM m GROUP BY 1""")
def lag_summary(spark, d):
    e = events(spark, d)
    n = series.nearest(e.filter("event_type = 'click'").select("event_id", "user_id", "t"), e.filter("event_type = 'error'").select("user_id", "t"),
                       ["user_id"], "t", [], DAY, within_s=14400.0)
    lags = n.filter("hit is not null").select((F.col("user_id") % 10).alias("key"), (F.col("t") - F.col("hit.t")).alias("lag"))
    q = ev.lag_summary(lags, ["key"], "lag")
    return q.select("key", F.col("matched").cast("bigint").alias("matched"), *[F.round(c, 2).alias(c) for c in ("q1", "median", "q3")])


@query("beat_regularity", f"""WITH {EV}, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM ev),
  a AS (SELECT user_id, count(*) AS n_beats, stddev_pop(gap) AS s, quantile_cont(gap, 0.5) AS m FROM g GROUP BY 1)
  SELECT user_id, n_beats, round(CASE WHEN n_beats > 3 THEN s / m ELSE 9 END, 4) AS beat_cv, round(CASE WHEN n_beats > 3 THEN 60 / m ELSE 0 END, 6) AS bpm FROM a""")
def beat_regularity(spark, d):
    b = ev.beat_regularity(events(spark, d), "user_id", "t", width_s=DAY)
    return b.select("user_id", "n_beats", F.round("beat_cv", 4).alias("beat_cv"), F.round("bpm", 6).alias("bpm"))


@query("jitter", f"""WITH {EV}, p AS (SELECT user_id % 10 AS key, event_type AS joint, value, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY t, event_id) - 1 AS i FROM ev),
  s AS (SELECT key, i, abs(value - lag(value) OVER (PARTITION BY key, joint ORDER BY i)) AS st FROM p), f AS (SELECT key, i, avg(st) AS a, max(st) AS m FROM s WHERE st IS NOT NULL GROUP BY 1, 2)
  SELECT key, round(avg(a), 6) AS mean, round(avg(m), 6) AS max_mean, round(max(m) * 15, 4) AS worst_speed, round(quantile_cont(a, 0.9), 4) AS mean_p90, round(quantile_cont(m, 0.99), 4) AS max_p99 FROM f GROUP BY 1""")
def jitter(spark, d):
    e = events(spark, d).withColumn("key", F.col("user_id") % 10)
    x = series.indexed(e, ["key", "event_type"], "t", ["event_id"], DAY)
    j = ev.jitter(x, ["key"], "event_type", ["value"], 15.0)
    return j.select("key", *[F.round(c, 6 if c in ("mean", "max_mean") else 4).alias(c) for c in ("mean", "max_mean", "worst_speed", "mean_p90", "max_p99")])


@query("accent_retention", f"""WITH {EV}, s AS (SELECT user_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm,
    max(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
  q AS (SELECT user_id, quantile_cont(value, 0.75) AS thr FROM ev GROUP BY 1)
  SELECT user_id, count(*) AS peaks, round(avg(sm / greatest(value, 1e-9)), 4) AS kept_mean, round(min(sm / greatest(value, 1e-9)), 4) AS kept_min FROM s JOIN q USING (user_id)
  WHERE i >= 2 AND i < n - 2 AND value >= top AND value > thr GROUP BY 1""")
def accent_retention(spark, d):
    x = series.indexed(events(spark, d).select("event_id", "user_id", "t", "value"), ["user_id"], "t", ["event_id"], DAY, size="n")
    sm = series.moving_average(x, ["user_id"], "value", 1).select("user_id", "idx", F.col("smooth").alias("value"))
    out = ev.accent_retention(x, sm, series.peaks(x, ["user_id"], "value"), ["user_id"], "value")
    return out.select("user_id", "peaks", F.round("kept_mean", 4).alias("kept_mean"), F.round("kept_min", 4).alias("kept_min"))


@query("band_power", f"""WITH {EV}, s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS j FROM ev),
  r AS (SELECT user_id, j, value - avg(value) OVER (PARTITION BY user_id) AS x, count(*) OVER (PARTITION BY user_id) AS n FROM s),
  f AS (SELECT user_id, k, max(n) AS n, sum(x * cos(2 * pi() * ((k * j) % n) / n)) AS c, sum(x * sin(2 * pi() * ((k * j) % n) / n)) AS s FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM r) GROUP BY 1, 2)
  SELECT u.user_id, round(coalesce(sum((c * c + s * s)) FILTER (WHERE k * 15.0 / n <= 3), 0), 2) AS low, round(coalesce(sum(c * c + s * s) FILTER (WHERE k * 15.0 / n >= 5), 0), 2) AS high
  FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN f ON f.user_id = u.user_id GROUP BY 1""")
def band_power(spark, d):
    x = series.indexed(events(spark, d).select("event_id", "user_id", "t", "value"), ["user_id"], "t", ["event_id"], DAY)
    return ev.band_power(x, ["user_id"], "value", 15.0).select("user_id", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


@query("suppression_counts", f"WITH {EV} SELECT k, count(*) FILTER (WHERE event_type = 'error') AS n, round(count(*) FILTER (WHERE event_type = 'error') / (SELECT count(*) FROM ev), 6) AS share FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def suppression_counts(spark, d):
    e = events(spark, d).withColumn("suppressed", F.when(F.col("event_type") == "error", F.lit("low_confidence")))
    return ev.suppression_counts(e, "k").select("k", "n", F.round("share", 6).alias("share"))


@query("interpolation_error", f"""WITH {EV}, h AS (SELECT * FROM ev WHERE k % 2 = 1), s AS (SELECT * FROM ev WHERE k % 2 = 0),
  a AS (SELECT h.*, s.t AS ta, s.value AS va FROM h ASOF LEFT JOIN s ON h.user_id = s.user_id AND h.t >= s.t), b AS (SELECT a.*, s.t AS tb, s.value AS vb FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.t < s.t),
  e AS (SELECT event_type, abs(value - CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va ELSE va + (vb - va) * (t - ta) / (tb - ta) END) AS err FROM b)
  SELECT event_type, count(err) AS n, round(quantile_cont(err, 0.5), 4) AS median, round(quantile_cont(err, 0.9), 4) AS p90, round(max(err), 4) AS max FROM e GROUP BY 1""")
def interpolation_error(spark, d):
    e = events(spark, d).select("event_id", "user_id", "t", "value", "k", "event_type")
    out = ev.interpolation_error(e.filter("k % 2 = 1"), e.filter("k % 2 = 0").select("user_id", "t", "value"), ["user_id"], "event_type", "t", "value", DAY)
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in ("median", "p90", "max")])


NULLQ = f"""{EV}, rr AS (SELECT CAST(r AS BIGINT) AS r, 0.1 + 0.8 * (r * 0.6180339887498949 - floor(r * 0.6180339887498949)) AS sh FROM range(1, 201) z(r)),
  h AS (SELECT user_id % 4 AS u, r, t + sh * 14400 AS t FROM ev, rr WHERE event_type = 'click'), o AS (SELECT user_id % 4 AS u, t FROM ev WHERE event_type = 'view'),
  c AS (SELECT DISTINCT u, r, CAST(floor((t - {BASE}) / 14400) AS BIGINT) + z.z AS c FROM h, (VALUES (-1), (0), (1)) z(z)),
  p AS (SELECT u, r, c, j, {BASE} + (c + j / 4.0) * 14400 AS at FROM c, range(0, 4) x(j)),
  hs AS (SELECT DISTINCT p.u, p.r, p.c, p.j FROM p JOIN h ON h.u = p.u AND h.r = p.r AND abs(h.t - p.at) <= 1800), os AS (SELECT DISTINCT p.u, p.r, p.c, p.j FROM p JOIN o ON o.u = p.u AND abs(o.t - p.at) <= 1800),
  f AS (SELECT u, r, c FROM (SELECT u, r, c, j, 1 AS h, 0 AS o FROM hs UNION ALL SELECT u, r, c, j, 0, 1 FROM os) GROUP BY 1, 2, 3 HAVING sum(h) >= 3 AND sum(o) >= 3 AND bool_or(h = 1 AND j IN (1, 3))),
  n AS (SELECT k.u, rr.r, count(f.c) AS n FROM (SELECT DISTINCT user_id % 4 AS u FROM ev) k CROSS JOIN rr LEFT JOIN f ON f.u = k.u AND f.r = rr.r GROUP BY 1, 2)"""


@query("null_distribution", f"WITH {NULLQ} SELECT u AS key, count(*) AS replicates, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.95), 4) AS p95 FROM n GROUP BY 1")
def null_distribution(spark, d):
    e = events(spark, d).withColumn("key", F.col("user_id") % 4)
    grids = e.select("key").distinct().withColumn("one", F.lit(float(BASE))).withColumn("spc", F.lit(14400.0))
    hits, ons = [e.filter(F.col("event_type") == k).select("key", "t") for k in ("click", "view")]
    out = ev.null_distribution(grids, hits, ons, "key", "t", 1800.0, tol_frac=1 / 8)
    return out.select("key", "replicates", F.round("mean", 4).alias("mean"), F.round("p95", 4).alias("p95"))


@query("zero_shot", """WITH c AS (SELECT label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS m FROM embeddings, range(0, 64) r(i) GROUP BY 1, 2),
  p AS (SELECT label, list(m ORDER BY i) AS p FROM c GROUP BY 1), e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  z AS (SELECT vec_id, label, 10 * list_dot_product(v, p) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p))) AS z FROM e, p),
  s AS (SELECT vec_id, sum(exp(z)) FILTER (WHERE label < 3) / sum(exp(z)) AS s FROM z GROUP BY 1) SELECT vec_id % 20 AS clip, count(*) AS frames, round(avg(s), 5) AS score FROM s GROUP BY 1""")
def zero_shot(spark, d):
    e = table(spark, d, "embeddings")
    prompts = identity.label_centroids(e, "label", "embedding", 64).select("prompt", (F.col("label") < 3).alias("positive"))
    out = ev.zero_shot(e.withColumn("clip", F.col("vec_id") % 20), prompts, "clip", "embedding", scale=10.0)
    return out.select("clip", "frames", F.round("score", 5).alias("score"))


@query("stillness", """WITH f AS (SELECT label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
  d AS (SELECT label, list_sum(list_transform(range(1, 65), lambda i: abs(CAST(a[i] AS DOUBLE) - CAST(b[i] AS DOUBLE)))) / 64 AS d FROM f WHERE b IS NOT NULL)
  SELECT label, round(quantile_cont(d, 0.5), 5) AS still FROM d GROUP BY 1""")
def stillness(spark, d):
    from ..operators import ordered
    x = ordered.dense_index(table(spark, d, "embeddings"), ["label"], ["vec_id"], ordered.time_bucket("vec_id", 1e5))
    x = ordered.row_frames(x, ["label"], 1, lambda frame: {"prev": F.lag("embedding").over(frame(None, None))})
    x = x.filter("prev is not null").withColumn("diff", ev.frame_difference(F.col("embedding"), F.col("prev")))
    return ev.stillness(x, "label", "diff").select("label", F.round("still", 5).alias("still"))


@query("keypoint_motion", """WITH f AS (SELECT label, vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
  s AS (SELECT label, vec_id, unnest(range(0, 4)) AS j, a, b FROM f), v AS (SELECT label, vec_id, a, b, CASE WHEN abs(a[4 * j + 3]) > 0.03 AND abs(b[4 * j + 3]) > 0.03 THEN least(8, sqrt(power(CAST(a[4 * j + 1] AS DOUBLE) - b[4 * j + 1], 2) + power(CAST(a[4 * j + 2] AS DOUBLE) - b[4 * j + 2], 2)) * 8) END AS v FROM s),
  m AS (SELECT label, vec_id, any_value(a[64]) AS pr, avg(v) AS limb FROM v GROUP BY 1, 2)
  SELECT label, count(*) AS n_frames, round(avg(CASE WHEN pr > -0.1 THEN 1 ELSE 0 END), 5) AS person, round(avg(CASE WHEN limb > 0.5 THEN 1.0 WHEN limb IS NOT NULL THEN 0 END), 5) AS active, round(quantile_cont(limb, 0.5), 5) AS limb FROM m GROUP BY 1""")
def keypoint_motion(spark, d):
    from ..operators import ordered
    c = lambda i: F.get("embedding", F.lit(i)).cast("double")
    limbs = F.array(*[F.struct(c(4 * j).alias("x"), c(4 * j + 1).alias("y"), F.abs(c(4 * j + 2)).alias("conf")) for j in range(4)])
    x = table(spark, d, "embeddings").select("label", "vec_id", limbs.alias("limbs"), (F.get("embedding", F.lit(63)) > F.lit(-0.1).cast("double")).alias("present"))
    x = ordered.dense_index(x, ["label"], ["vec_id"], ordered.time_bucket("vec_id", 1e5))
    out = ev.keypoint_motion(x, "label", 8.0, min_conf=0.03)
    return out.select("label", "n_frames", *[F.round(n, 5).alias(n) for n in ("person", "active", "limb")])
