"""Motion operators. Embeddings play body samples: cells as joint rotations, root positions, points and hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import counts as C, quat as Q
from ..operators import contract, grid, identity, motion, ordered, series
from ..session import stored
from .base import EV, events, query, table

DAY = 86400.0
BASE = 1704067200
JOINTS = 15  # a binary tree: parent of j is (j - 1) / 2
PER_CLIP = 40  # vectors per stand-in clip


def _rows(spark, d):
    """One row per body sample: clip, sample index, time and the 64 cells."""
    e = ordered.dense_index(table(spark, d, "embeddings"), ["label"], ["vec_id"], ordered.time_bucket("vec_id", 1e5))
    clip = F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("idx") / PER_CLIP).cast("string"))
    return e.select(clip.alias("clip_id"), (F.col("idx") % PER_CLIP).cast("int").alias("sample_idx"), (F.col("vec_id") * 0.1).alias("t"), "vec_id",
                    F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _joints(spark, d):
    """Long joint samples: unit quaternion from four cells each, visibility from the fifth."""
    v = lambda i: F.get("v", i)
    x = _rows(spark, d).withColumn("joint_idx", F.explode(F.sequence(F.lit(0), F.lit(JOINTS - 1))))
    q = [v(4 * F.col("joint_idx") + i) for i in range(4)]
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    cell = v(4 * F.col("joint_idx") + 1)
    vis = F.when(cell > -0.1, "observed").when(cell > -0.2, "uncertain").otherwise("absent")
    return x.select("clip_id", F.lit(0).alias("person"), F.lit("p0").alias("person_id"), "sample_idx", "t", "vec_id", "joint_idx",
                    *[(c / n).alias(f"q{f}") for c, f in zip(q, "xyzw")], (vis == "observed").alias("observed"), F.lit(False).alias("interpolated"),
                    F.when(vis != "observed", "low_confidence").alias("suppressed"), vis.alias("visibility"))


def _roots(spark, d):
    v = lambda i: F.get("v", F.lit(i))
    return _rows(spark, d).select("clip_id", F.lit(0).alias("person"), "sample_idx", "t", "vec_id", v(60).alias("x"), v(61).alias("y"), (v(62) - 3).alias("z"),
                                  F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"), F.lit(1.0).alias("qw"),
                                  (v(63) > 0).alias("observed"), F.when(v(63) <= 0, "low_confidence").alias("suppressed"))


def _rig(spark, d):
    """The joint tree, one row per joint of the samples."""
    j = _joints(spark, d).select("joint_idx").distinct()
    parent = F.when(F.col("joint_idx") == 0, -1).otherwise(F.floor((F.col("joint_idx") - 1) / 2)).cast("int")
    return j.select("joint_idx", parent.alias("parent_idx"), Q.pack(Q.vec(F.lit(0.0), (F.col("joint_idx") + 1) * 0.1, F.lit(0.05))).alias("rest_t"),
                    Q.pack(Q.quat(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("rest_r"))


ROWS = f"""ix AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings),
  rw AS (SELECT label || '-' || (i // {PER_CLIP}) AS clip_id, i % {PER_CLIP} AS sample_idx, vec_id * 0.1 AS t, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM ix),
  jq AS (SELECT rw.clip_id, sample_idx, t, vec_id, j, v[4 * j + 1] AS a, v[4 * j + 2] AS b, v[4 * j + 3] AS c, v[4 * j + 4] AS w FROM rw, range(0, {JOINTS}) r(j)),
  js AS (SELECT clip_id, sample_idx, t, vec_id, j, a / n AS qx, b / n AS qy, c / n AS qz, w / n AS qw, CASE WHEN b > -0.1 THEN 'observed' WHEN b > -0.2 THEN 'uncertain' ELSE 'absent' END AS vis
    FROM (SELECT *, sqrt(a * a + b * b + c * c + w * w) AS n FROM jq)),
  rt AS (SELECT clip_id, sample_idx, t, vec_id, v[61] AS x, v[62] AS y, v[63] - 3 AS z, v[64] > 0 AS observed FROM rw)"""


@query("document_roundtrip", f"""WITH {ROWS} SELECT vec_id, CAST(count(*) AS BIGINT) AS joints, count(*) FILTER (WHERE vis = 'observed') AS observed, round(sum(round_even(qw, 6)), 6) AS sum_w FROM js GROUP BY 1""")
def document_roundtrip(spark, d):
    """Long tables to nested documents to JSON text, parsed again with the declared schema and flattened."""
    meta = _rows(spark, d).select("clip_id").distinct().select("clip_id", F.lit("1.0.0").alias("schema_version"), F.concat(F.lit("job_"), "clip_id").alias("job_id"))
    text = motion.build_documents(_joints(spark, d), _roots(spark, d), meta).select("clip_id", F.to_json("doc").alias("body"))
    docs = contract.parse_documents(text, "body")
    flat = motion.flatten_joints(docs)
    # Sample times come back from the document; they are the vectors' ids in tenths.
    return flat.groupBy(F.bround(F.col("t") * 10).cast("bigint").alias("vec_id")).agg(
        F.count("*").alias("joints"), F.count_if(F.col("visibility") == "observed").alias("observed"), F.round(F.sum("qw"), 6).alias("sum_w"))


def _documents(spark, d):
    """Nested documents with faults planted by clip."""
    rig = _rig(spark, d).agg(F.array_sort(F.collect_list(F.struct(F.col("joint_idx").alias("index"), F.col("parent_idx").alias("parent_index"), F.concat(F.lit("j"), F.col("joint_idx").cast("string")).alias("name")))).alias("_j"))
    lab = F.substring_index("clip_id", "-", 1).cast("int")
    times = _rows(spark, d).groupBy("clip_id").agg(F.max("t").alias("end_s"), F.min("t").alias("one_s"))
    meta = times.withColumn("_j", rig.scalar()).withColumn("lab", lab)
    bad = F.transform("_j", lambda j, i: F.struct(F.when((F.col("lab") == 2) & (i == 3), 99).otherwise(j["index"]).alias("index"), j["parent_index"], j["name"]))
    floor = F.struct(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("normal"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("point"))
    total = C.count_total(F.col("one_s"), F.lit(0.5), F.col("end_s")) + F.when(F.col("lab") == 4, 1).otherwise(0)
    parts = meta.select(
        "clip_id", F.when(F.col("lab") == 5, "0.9").otherwise("1.0.0").alias("schema_version"), F.concat(F.lit("job_"), "clip_id").alias("job_id"),
        F.struct(F.array_repeat(F.lit(0.0), 16).alias("camera_to_world")).alias("camera"),
        F.struct(F.when(F.col("lab") == 3, "grounded").otherwise("none").alias("status"), F.when(F.col("lab") == 6, floor).alias("floor_plane")).alias("grounding"),
        F.struct(F.col("one_s").alias("count_one_s"), F.lit(0.5).alias("seconds_per_count"), total.alias("count_total"), F.lit(0.5).alias("confidence")).alias("proposed_counts"),
        F.struct(bad.alias("joints")).alias("joint_hierarchy"))
    j = _joints(spark, d)
    quiet = (F.substring_index("clip_id", "-", 1) == "7") & (F.col("visibility") == "absent")
    j = j.withColumn("suppressed", F.when(~quiet, F.col("suppressed")))
    return motion.build_documents(j, _roots(spark, d), parts).select("clip_id", F.to_json("doc").alias("body"))


@query("document_violations", f"""WITH {ROWS}, c AS (SELECT DISTINCT clip_id, CAST(split_part(clip_id, '-', 1) AS INT) AS lab FROM rw), q AS (SELECT clip_id, count(*) AS n FROM js WHERE vis = 'absent' GROUP BY 1)
  SELECT clip_id, CAST(CASE lab WHEN 7 THEN coalesce(n, 0) WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS BIGINT) AS faults,
    CASE WHEN lab = 2 THEN 'joint_hierarchy.joints[3].index' WHEN lab = 3 THEN 'grounding grounded without a floor_plane' WHEN lab = 4 THEN 'proposed_counts.count_total'
      WHEN lab = 5 THEN 'schema_version' WHEN lab = 6 THEN 'grounding none with a floor_plane' WHEN lab = 7 AND n > 0 THEN 'absent without a reason' ELSE '' END AS first FROM c LEFT JOIN q USING (clip_id)""")
def document_violations(spark, d):
    v = contract.validate(_documents(spark, d), "body")
    first = F.coalesce(F.get("violations", F.lit(0)), F.lit(""))
    return v.select("clip_id", F.size("violations").cast("bigint").alias("faults"), F.when(first.endswith("absent without a reason"), "absent without a reason").otherwise(first).alias("first"))


@query("status_violations", """SELECT o_orderkey AS job_id, array_to_string(list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'state' END, CASE WHEN o_totalprice / 450000 > 1 THEN 'progress' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'error' END], lambda x: x IS NOT NULL), ',') AS broken FROM orders""")
def status_violations(spark, d):
    """Status JSON of every order parsed with the declared schema and checked."""
    k = F.col("o_orderkey")
    doc = F.to_json(F.struct(F.lit("1.0.0").alias("schema_version"), k.cast("string").alias("job_id"), F.when(k % 7 == 0, "odd").otherwise("failed").alias("state"),
                             F.lit("").alias("stage_message"), (F.col("o_totalprice") / 450000).alias("progress"), F.lit(0).alias("retry_count"),
                             F.when(k % 5 == 0, F.struct(F.lit("x").alias("code"), F.lit("").alias("message"), F.lit(True).alias("retryable"))).alias("error")))
    o = table(spark, d, "orders").select(k.alias("job_id"), doc.alias("body"))
    p = contract.parse_documents(o, "body", schemas.JOB_STATUS)
    return p.select("job_id", F.array_join(contract.status_violations(F.col("doc")), ",").alias("broken"))


@query("ancestor_closure", f"""WITH RECURSIVE c AS (SELECT j AS joint, j AS ancestor, 0 AS depth FROM range(0, {JOINTS}) r(j) UNION ALL SELECT joint, (ancestor - 1) // 2, depth + 1 FROM c WHERE ancestor > 0)
  SELECT CAST(joint AS INT) AS joint, CAST(ancestor AS INT) AS ancestor, depth FROM c""")
def ancestor_closure(spark, d):
    return motion.closure(_rig(spark, d))


FK = f"""WITH RECURSIVE {ROWS}, f AS (SELECT r.vec_id, 0::BIGINT AS j, x AS px, y AS py, z AS pz, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw FROM rt r
  UNION ALL SELECT vec_id, j, px + 2 * (qy * rz - qz * ry) * qw + 2 * (qy * (qx * ry - qy * rx) - qz * (qz * rx - qx * rz)) + rx,
    py + 2 * (qz * rx - qx * rz) * qw + 2 * (qz * (qy * rz - qz * ry) - qx * (qx * ry - qy * rx)) + ry,
    pz + 2 * (qx * ry - qy * rx) * qw + 2 * (qx * (qz * rx - qx * rz) - qy * (qy * rz - qz * ry)) + rz,
    qw * lx + qx * lw + qy * lz - qz * ly, qw * ly - qx * lz + qy * lw + qz * lx, qw * lz + qx * ly - qy * lx + qz * lw, qw * lw - qx * lx - qy * ly - qz * lz
  FROM (SELECT f.vec_id, s.j, px, py, pz, f.qx, f.qy, f.qz, f.qw, 0.0 AS rx, (s.j + 1) * 0.1 AS ry, 0.05 AS rz, s.qx AS lx, s.qy AS ly, s.qz AS lz, s.qw AS lw
    FROM f JOIN js s ON s.vec_id = f.vec_id AND s.j > 0 AND (s.j - 1) // 2 = f.j))"""


@query("forward_kinematics", FK + " SELECT vec_id, CAST(j AS INT) AS joint, round(px, 4) AS x, round(py, 4) AS y, round(pz, 4) AS z, round(qw, 4) AS qw FROM f")
def forward_kinematics(spark, d):
    fk = motion.forward_kinematics(_joints(spark, d), _roots(spark, d), _rig(spark, d), ["vec_id"])
    return fk.select("vec_id", "joint", *[F.round(F.col(f"p.{c}"), 4).alias(c) for c in "xyz"], F.round("q.w", 4).alias("qw"))


@query("local_rotations", f"""WITH {ROWS} SELECT a.vec_id, CAST(a.j AS INT) AS joint_idx, round_even(CASE WHEN b.j IS NULL THEN a.qw ELSE b.qw * a.qw + b.qx * a.qx + b.qy * a.qy + b.qz * a.qz END, 6) AS w,
  round_even(CASE WHEN b.j IS NULL THEN a.qx ELSE b.qw * a.qx - b.qx * a.qw - b.qy * a.qz + b.qz * a.qy END, 6) AS x FROM js a LEFT JOIN js b ON b.vec_id = a.vec_id AND a.j > 0 AND b.j = (a.j - 1) // 2""")
def local_rotations(spark, d):
    out = motion.local_rotations(_joints(spark, d), _rig(spark, d), ["vec_id"])
    return out.select("vec_id", "joint_idx", F.col("local.w").alias("w"), F.col("local.x").alias("x"))


def _bones(spark, d):
    r = _rig(spark, d).filter("joint_idx in (0, 2, 5, 9, 12)")
    return r.select(F.concat(F.lit("r"), F.col("joint_idx").cast("string")).alias("region"), F.col("joint_idx").alias("joint"))


@query("region_visibility", f"""WITH RECURSIVE {ROWS}, c AS (SELECT j AS joint, j AS a FROM (VALUES (0), (2), (5), (9), (12)) v(j) UNION ALL SELECT joint, (a - 1) // 2 FROM c WHERE a > 0)
  SELECT vec_id, 'r' || joint AS region, (['observed', 'uncertain', 'absent'])[max(CASE vis WHEN 'observed' THEN 1 WHEN 'uncertain' THEN 2 ELSE 3 END)] AS visibility FROM js JOIN c ON c.a = js.j GROUP BY 1, 2""")
def region_visibility(spark, d):
    return motion.chain_visibility(_joints(spark, d), _rig(spark, d), ["vec_id"], _bones(spark, d))


@query("owning_region", f"""WITH RECURSIVE c AS (SELECT j AS joint, j AS a, 0 AS d FROM range(0, {JOINTS}) r(j) UNION ALL SELECT joint, (a - 1) // 2, d + 1 FROM c WHERE a > 0)
  SELECT CAST(joint AS INT) AS joint, 'r' || arg_min(a, d) FILTER (WHERE a IN (0, 2, 5, 9, 12)) AS region FROM c GROUP BY 1""")
def owning_region(spark, d):
    return motion.owning_region(_rig(spark, d), _bones(spark, d))


def _camera():
    eye = F.array(*[F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)])
    return F.struct(*[F.lit(x).alias(n) for n, x in (("fx", 500.0), ("fy", 500.0), ("cx", 320.0), ("cy", 240.0), ("w", 640.0), ("h", 480.0))],
                    eye.alias("m"))


DANCE = f"""cv AS (SELECT clip_id, avg(CASE WHEN vis = 'observed' THEN 1 ELSE 0 END) AS cov FROM js GROUP BY 1),
  ds AS (SELECT clip_id, avg(CASE WHEN -z > 1e-6 THEN sqrt(power((320 + 500 * x / -z) / 640 - 0.5, 2) + power((240 - 500 * y / -z) / 480 - 0.5, 2)) / (sqrt(2) / 2) END) AS d FROM rt GROUP BY 1),
  sc AS (SELECT clip_id, cov, least(1, coalesce(d, 1)) AS d, cov - 0.5 * least(1, coalesce(d, 1)) AS s FROM cv JOIN ds USING (clip_id))"""


@query("score_dancers", f"WITH {ROWS}, {DANCE} SELECT clip_id, round(cov, 5) AS coverage, round(d, 5) AS centre_distance, round(s, 5) AS score FROM sc")
def score_dancers(spark, d):
    s = motion.score_dancers(_joints(spark, d), _roots(spark, d), _camera())
    return s.select("clip_id", *[F.round(c, 5).alias(c) for c in ("coverage", "centre_distance", "score")])


@query("default_dancer", f"""WITH {ROWS}, {DANCE} SELECT CAST(split_part(clip_id, '-', 2) AS INT) AS take, arg_max(split_part(clip_id, '-', 1)::INT, (s, -split_part(clip_id, '-', 1)::INT)) AS person FROM sc GROUP BY 1""")
def default_dancer(spark, d):
    """Labels as the dancers of one take."""
    who, take = F.substring_index("clip_id", "-", 1).cast("int"), F.substring_index("clip_id", "-", -1).cast("int")
    s = motion.score_dancers(_joints(spark, d), _roots(spark, d), _camera()).withColumn("person", who).withColumn("take", take)
    return motion.default_dancer(s, "take").select("take", "person")


@query("travel", f"WITH {ROWS} SELECT clip_id, round(sqrt(power(max(x) - min(x), 2) + power(max(z) - min(z), 2)), 5) AS extent, sqrt(power(max(x) - min(x), 2) + power(max(z) - min(z), 2)) > 0.7 AS travels, bool_or(observed) AS placed FROM rt GROUP BY 1")
def travel(spark, d):
    return motion.travel(_roots(spark, d), ["clip_id"], 0.7).select("clip_id", F.round("extent", 5).alias("extent"), "travels", "placed")


@query("dancer_box", f"""WITH {ROWS}, p AS (SELECT clip_id, (320 + 500 * x / -z) / 640 AS u, (240 - 500 * y / -z) / 480 AS v FROM rt WHERE -z > 1e-6),
  g AS (SELECT clip_id, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM p GROUP BY 1 HAVING max(u) > min(u)), h AS (SELECT *, (u1 - u0) * 0.15 + 0.02 AS px, (v1 - v0) * 0.1 + 0.02 AS py FROM g)
  SELECT clip_id, round(greatest(0, u0 - px), 5) AS x, round(least(1, u1 + px) - greatest(0, u0 - px), 5) AS width, round(least(1, v1 + py) - greatest(0, v0 - py), 5) AS height FROM h""")
def dancer_box(spark, d):
    uv = Q.to_frame_norm(_camera(), Q.vec(F.col("x"), F.col("y"), F.col("z")))
    p = _roots(spark, d).withColumn("_uv", uv).filter("_uv is not null").select("clip_id", F.col("_uv.x").alias("u"), F.col("_uv.y").alias("v"))
    return motion.dancer_box(p, ["clip_id"]).select("clip_id", *[F.round(c, 5).alias(c) for c in ("x", "width", "height")])


@query("first_well_observed", f"""WITH {ROWS}, s AS (SELECT clip_id, sample_idx, avg(CASE WHEN vis = 'observed' THEN 1 ELSE 0 END) AS sh FROM js GROUP BY 1, 2)
  SELECT clip_id, CAST(coalesce(min(sample_idx) FILTER (WHERE sh >= 0.95), arg_max(sample_idx, (sh, -sample_idx))) AS INT) AS sample_idx FROM s GROUP BY 1""")
def first_well_observed(spark, d):
    return motion.first_well_observed(motion.observed_share(_joints(spark, d), ["clip_id"]), ["clip_id"], 0.95)


@query("foot_contact", f"""WITH {ROWS}, h AS (SELECT vec_id, y + 0.05 AS a, z + 3 AS b, vec_id % 5 = 0 AS hid FROM rt)
  SELECT vec_id, CASE WHEN hid THEN 'unknown' WHEN a > 0.09 AND y2 > 0.06 THEN 'lifted' ELSE 'planted' END AS contact FROM (SELECT *, a - 0.02 AS y2 FROM h)""")
def foot_contact(spark, d):
    plane = F.struct(Q.pack(Q.vec(F.lit(0.0), F.lit(-0.05), F.lit(0.0))).alias("point"), Q.pack(Q.vec(F.lit(0.0), F.lit(1.0), F.lit(0.0))).alias("normal"))
    r = _roots(spark, d)
    c = motion.foot_contact(Q.vec(F.col("x"), F.col("y"), F.col("z")), Q.vec(F.col("x"), F.col("y") - 0.02, F.col("z")), plane, F.col("vec_id") % 5 != 0)
    return r.select("vec_id", c.alias("contact"))


@query("lead_track", "WITH g AS (SELECT l_orderkey AS clip, l_suppkey % 4 AS track, count(*) AS n, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2) SELECT clip, arg_max(track, (n, -o, -track)) AS track, max(n) AS frames FROM g GROUP BY 1")
def lead_track(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip"), (F.col("l_suppkey") % 4).alias("track"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 4).alias("o"))
    return motion.lead_track(li, "clip", "track", "o")


@query("sample_rate", f"WITH {ROWS} SELECT clip_id, round_even(1 / (max(t) FILTER (WHERE sample_idx = 1) - max(t) FILTER (WHERE sample_idx = 0)), 6) AS fps FROM rw GROUP BY 1")
def sample_rate(spark, d):
    return motion.sample_rate(_rows(spark, d), "clip_id", "t", "sample_idx")


@query("nonfinite", f"WITH {ROWS} SELECT clip_id, CAST(min(sample_idx) AS INT) AS first_bad, count(*) AS bad FROM rw WHERE vec_id % 9 = 4 GROUP BY 1")
def nonfinite(spark, d):
    """Square roots of negated squares: a NaN in every ninth sample."""
    x = _rows(spark, d).withColumn("g", F.when(F.col("vec_id") % 9 == 4, F.sqrt(-1 - F.get("v", F.lit(0)) * F.get("v", F.lit(0)))).otherwise(F.get("v", F.lit(0))))
    return motion.nonfinite(x, ["clip_id"], "sample_idx", ["g"])


@query("detections", """WITH f AS (SELECT DISTINCT l_suppkey AS clip_id, l_linenumber AS frame_idx FROM lineitem), t AS (SELECT DISTINCT l_suppkey AS clip_id, l_partkey % 3 AS track_id FROM lineitem),
  k AS (SELECT l_suppkey AS clip_id, l_linenumber AS frame_idx, l_partkey % 3 AS track_id, max(l_quantity) AS q FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2, 3)
  SELECT f.clip_id, CAST(f.frame_idx AS INT) AS frame_idx, t.track_id, round_even(CASE WHEN q / 50 >= 0.9 THEN q / 60 END, 3) AS x FROM f JOIN t USING (clip_id) LEFT JOIN k ON k.clip_id = f.clip_id AND k.frame_idx = f.frame_idx AND k.track_id = t.track_id""")
def detections(spark, d):
    """Suppliers as clips, line numbers as frames: dense (frame, track) rows with points kept above a score."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("clip_id"), F.col("l_linenumber").alias("frame_idx"), (F.col("l_partkey") % 3).alias("track_id"), "l_quantity")
    det = li.filter("l_quantity > 40").groupBy("clip_id", "frame_idx", "track_id").agg(F.max("l_quantity").alias("q"))
    dense = motion.densify_detections(li.select("clip_id", "frame_idx").distinct(), li.select("clip_id", "track_id").distinct(), det, "clip_id")
    kp = F.array(F.array(F.col("q"), F.col("q"), F.col("q") / 50))
    pts = motion.normalised_points(kp, F.lit(60), F.lit(60), min_score=0.9)
    return dense.select("clip_id", "frame_idx", "track_id", F.when(F.col("q").isNotNull(), F.get(pts, F.lit(0))[0]).alias("x"))


@query("subsample", f"""WITH {ROWS}, g AS (SELECT clip_id, count(*) AS n, CASE WHEN count(*) > 1 THEN (count(*) - 1) / greatest(1e-6, max(t) - min(t)) ELSE 0.5 END AS f FROM rw GROUP BY 1),
  k AS (SELECT *, greatest(1, round_even(f / 0.5, 0)) AS k FROM g) SELECT vec_id, round_even(f / k, 3) AS fps FROM rw JOIN k USING (clip_id) WHERE sample_idx % k = 0""")
def subsample(spark, d):
    return motion.subsample(_rows(spark, d), "clip_id", "sample_idx", "t", 0.5).select("vec_id", "fps")


@query("intrinsics", f"WITH {ROWS} SELECT clip_id, round(quantile_cont(abs(v[1]) * 1000 + 400, 0.5), 4) AS fx, 320.0::DOUBLE AS cx FROM rw GROUP BY 1")
def intrinsics(spark, d):
    x = _rows(spark, d).select("clip_id", (F.abs(F.get("v", F.lit(0))) * 1000 + 400).alias("focal"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return motion.intrinsics(x, "clip_id").select("clip_id", F.round("fx", 4).alias("fx"), "cx")


FEET = """ft AS (SELECT clip_id, vec_id, t, v[1] AS x, v[2] / 10 AS y, v[3] AS z, greatest(0, v[4] * 5) AS weight FROM rw)"""


def _feet(spark, d):
    v = lambda i: F.get("v", F.lit(i))
    return _rows(spark, d).select("clip_id", "vec_id", "t", v(0).alias("x"), (v(1) / 10).alias("y"), v(2).alias("z"), F.greatest(F.lit(0.0), v(3) * 5).alias("weight"))


@query("pooled_tracks", f"WITH {ROWS}, {FEET} SELECT clip_id, count(*) AS good FROM ft WHERE weight > 0.05 GROUP BY 1 HAVING count(*) >= 12")
def pooled_tracks(spark, d):
    return motion.pooled_tracks(_feet(spark, d), ["clip_id"])


@query("contact_coverage", f"WITH {ROWS}, {FEET}, s AS (SELECT clip_id, floor(t) AS s, bool_or(weight > 0.05) AS i, bool_or(vec_id % 4 <> 0) AS r FROM ft GROUP BY 1, 2) SELECT clip_id, round(count(*) FILTER (WHERE i AND r) / greatest(1, count(*) FILTER (WHERE r)), 5) AS coverage, count(*) FILTER (WHERE r) AS seconds FROM s GROUP BY 1")
def contact_coverage(spark, d):
    c = motion.contact_coverage(_feet(spark, d), "clip_id", F.col("weight") > 0.05, F.col("vec_id") % 4 != 0)
    return c.select("clip_id", F.round("coverage", 5).alias("coverage"), "seconds")


@query("gap_diagnostics", f"WITH {ROWS}, {FEET}, m AS (SELECT clip_id, floor(t) AS f, min(y) AS g FROM ft GROUP BY 1, 2) SELECT clip_id, round(quantile_cont(g, 0.5), 6) AS median, round(quantile_cont(g, 0.95), 6) AS p95, round(avg(CASE WHEN abs(g) <= 0.03 THEN 1 ELSE 0 END), 5) AS planted FROM m GROUP BY 1")
def gap_diagnostics(spark, d):
    g = motion.gap_diagnostics(_feet(spark, d).withColumn("f", F.floor("t")), "clip_id", ["f"], "y")
    return g.select("clip_id", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), F.round("planted", 5).alias("planted"))


@query("feet_slope", f"""WITH {ROWS}, {FEET}, s AS (SELECT clip_id, count(*) AS n, (covar_pop(x, x) + 0.01) * count(*) AS xx, (covar_pop(z, z) + 0.01) * count(*) AS zz, covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy FROM ft GROUP BY 1)
  SELECT clip_id, round(-(xy * zz - zy * xz) / (xx * zz - xz * xz), 5) AS ux, round(-(zy * xx - xy * xz) / (xx * zz - xz * xz), 5) AS uz FROM s WHERE n >= 3""")
def feet_slope(spark, d):
    return motion.feet_slope(_feet(spark, d), "clip_id").select("clip_id", F.round("ux", 5).alias("ux"), F.round("uz", 5).alias("uz"))


#: The draws, votes and refit again: every hypothesis meets every point of its clip.
PLANE = f"""WITH {ROWS}, {FEET}, cn AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY -ln((('0x' || substr(md5(clip_id || '|' || vec_id), 1, 8))::BIGINT + 1) / 4294967296.0) / weight) - 1 AS rn FROM ft WHERE weight > 0),
  ps AS (SELECT clip_id, list({{'x': x, 'y': y, 'z': z}} ORDER BY rn) AS pts, least(count(*), 1200) AS m FROM cn WHERE rn < 1200 GROUP BY 1 HAVING count(*) >= 3),
  tr AS (SELECT clip_id, h, pts[1 + CASE WHEN 3 * h < m THEN 3 * h ELSE ('0x' || substr(md5(h || '-0'), 1, 8))::BIGINT % m END] AS a, pts[1 + CASE WHEN 3 * h + 1 < m THEN 3 * h + 1 ELSE ('0x' || substr(md5(h || '-1'), 1, 8))::BIGINT % m END] AS b,
    pts[1 + CASE WHEN 3 * h + 2 < m THEN 3 * h + 2 ELSE ('0x' || substr(md5(h || '-2'), 1, 8))::BIGINT % m END] AS c FROM ps, range(0, 400) r(h)),
  nr AS (SELECT clip_id, h, a, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz FROM tr),
  pl AS (SELECT clip_id, h, a, nx * s AS nx, ny * s AS ny, nz * s AS nz FROM (SELECT *, CASE WHEN ny < 0 THEN -1 ELSE 1 END / sqrt(nx * nx + ny * ny + nz * nz) AS s FROM nr WHERE sqrt(nx * nx + ny * ny + nz * nz) >= 1e-9) WHERE ny * s >= cos(radians(25))),
  vo AS (SELECT pl.*, coalesce((SELECT sum(weight) FROM cn WHERE cn.clip_id = pl.clip_id AND abs((x - a.x) * nx + (y - a.y) * ny + (z - a.z) * nz) <= 0.03), 0) AS score FROM pl),
  bs AS (SELECT * FROM vo QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY round(score, 9) DESC, h) = 1),
  su AS (SELECT clip_id, sum(weight * x) / sum(weight) AS ox, sum(weight * y) / sum(weight) AS oy, sum(weight * z) / sum(weight) AS oz, sum(weight * x * x) / sum(weight) - ox * ox AS xx, sum(weight * y * y) / sum(weight) - oy * oy AS yy, sum(weight * z * z) / sum(weight) - oz * oz AS zz,
    sum(weight * x * y) / sum(weight) - ox * oy AS xy, sum(weight * x * z) / sum(weight) - ox * oz AS xz, sum(weight * y * z) / sum(weight) - oy * oz AS yz FROM cn JOIN bs USING (clip_id) WHERE abs((x - a.x) * nx + (y - a.y) * ny + (z - a.z) * nz) <= 0.03 GROUP BY 1),
  e1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM su), e2 AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM e1),
  e3 AS (SELECT *, q + 2 * p * cos(acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3)))) / 3 + 2 * pi() / 3) AS lo FROM e2),
  e4 AS (SELECT *, list_max([{{'n': sqrt(u.x ** 2 + u.y ** 2 + u.z ** 2), 'v': u}}, {{'n': sqrt(v.x ** 2 + v.y ** 2 + v.z ** 2), 'v': v}}, {{'n': sqrt(w.x ** 2 + w.y ** 2 + w.z ** 2), 'v': w}}]) AS best FROM (SELECT *,
    {{'x': xy * yz - xz * (yy - lo), 'y': xz * xy - (xx - lo) * yz, 'z': (xx - lo) * (yy - lo) - xy * xy}} AS u, {{'x': xy * (zz - lo) - xz * yz, 'y': xz * xz - (xx - lo) * (zz - lo), 'z': (xx - lo) * yz - xy * xz}} AS v,
    {{'x': (yy - lo) * (zz - lo) - yz * yz, 'y': yz * xz - xy * (zz - lo), 'z': xy * yz - (yy - lo) * xz}} AS w FROM e3)),
  fi AS (SELECT clip_id, ox, oy, oz, best.v.x * s AS nx, best.v.y * s AS ny, best.v.z * s AS nz FROM (SELECT *, CASE WHEN best.v.y < 0 THEN -1 ELSE 1 END / best.n AS s FROM e4))"""


@query("plane_fit", f"""{PLANE} SELECT clip_id, round(any_value(nx), 6) AS nx, round(any_value(ny), 6) AS ny, round(any_value(nz), 6) AS nz, round(sqrt(sum(weight * d * d) / sum(weight)), 6) AS rms_m, round(degrees(acos(any_value(ny))), 6) AS tilt_deg, count(*) AS inliers
  FROM (SELECT fi.*, weight, (x - ox) * nx + (y - oy) * ny + (z - oz) * nz AS d FROM fi JOIN cn USING (clip_id)) WHERE abs(d) <= 0.03 GROUP BY clip_id HAVING count(*) >= 3""")
def plane_fit(spark, d):
    """Random hypotheses seeded by the points' ids, votes by slices, the winner refitted."""
    f = motion.fit_plane(_feet(spark, d), "clip_id", tol=0.03, ids=["vec_id"])
    return f.select("clip_id", *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz", "rms_m", "tilt_deg")], "inliers")


@query("grounding_gates", f"""WITH {ROWS}, {FEET}, m AS (SELECT clip_id, avg(CASE WHEN weight > 0 THEN 1.0 ELSE 0 END) + 0.2 AS visible, count(*) FILTER (WHERE weight > 0) AS candidates, count(*) FILTER (WHERE weight > 0.2) AS inliers, stddev_pop(y) AS rms, abs(avg(x)) * 200 AS tilt, 0.5 + avg(abs(z)) AS cov FROM ft GROUP BY 1)
  SELECT clip_id, CASE WHEN visible < 0.6 THEN 'feet_not_visible_enough' WHEN candidates < 3 THEN 'no_contact_evidence' WHEN inliers < 12 THEN 'too_few_contacts' WHEN rms > 0.02 THEN 'fit_too_loose' WHEN tilt > 25 THEN 'implausible_tilt'
    WHEN cov < 0.6 THEN 'contacts_not_spread_over_clip' ELSE 'grounded' END AS reason FROM m""")
def grounding_gates(spark, d):
    m = _feet(spark, d).groupBy("clip_id").agg((F.avg((F.col("weight") > 0).cast("double")) + 0.2).alias("visible"), F.count_if(F.col("weight") > 0).alias("candidates"),
                                               F.lit(True).alias("has_plane"), F.count_if(F.col("weight") > 0.2).alias("inliers"), F.stddev_pop("y").alias("rms_m"),
                                               (F.abs(F.avg("x")) * 200).alias("tilt_deg"), (0.5 + F.avg(F.abs("z"))).alias("coverage"))
    return m.select("clip_id", motion.grounding_reason().alias("reason"))


@query("constant_bones", f"WITH {ROWS}, b AS (SELECT vec_id, split_part(clip_id, '-', 1) AS k, v[5] AS x, v[6] AS y, sqrt(v[5] * v[5] + v[6] * v[6]) AS len FROM rw), m AS (SELECT k, quantile_cont(len, 0.5) AS m FROM b GROUP BY 1) SELECT vec_id, round(abs(m - len), 6) AS correction, round(x * m / len, 6) AS x FROM b JOIN m USING (k)")
def constant_bones(spark, d):
    v = lambda i: F.get("v", F.lit(i))
    x = _rows(spark, d).select("vec_id", F.substring_index("clip_id", "-", 1).alias("k"), v(4).alias("x"), v(5).alias("y"))
    return motion.constant_bones(x, ["k"], ["x", "y"]).select("vec_id", F.round("correction", 6).alias("correction"), F.round("x", 6).alias("x"))


@query("constant_chain", f"""WITH RECURSIVE {ROWS}, p AS (SELECT clip_id, vec_id, j, v[4 * j + 1] AS x, v[4 * j + 2] AS y, v[4 * j + 3] AS z FROM rw, range(0, {JOINTS}) r(j)),
  o AS (SELECT c.clip_id, c.vec_id, c.j, c.x - coalesce(u.x, 0) AS x, c.y - coalesce(u.y, 0) AS y, c.z - coalesce(u.z, 0) AS z FROM p c LEFT JOIN p u ON u.vec_id = c.vec_id AND u.clip_id = c.clip_id AND c.j > 0 AND u.j = (c.j - 1) // 2),
  m AS (SELECT clip_id, j, quantile_cont(sqrt(x * x + y * y + z * z), 0.5) AS usual FROM o WHERE j > 0 GROUP BY 1, 2),
  s AS (SELECT o.*, usual, CASE WHEN usual IS NULL THEN 1 ELSE usual / sqrt(x * x + y * y + z * z) END AS k FROM o LEFT JOIN m USING (clip_id, j)),
  w AS (SELECT clip_id, vec_id, j, x, y, z FROM s WHERE j = 0 UNION ALL SELECT s.clip_id, s.vec_id, s.j, w.x + s.x * k, w.y + s.y * k, w.z + s.z * k FROM w JOIN s ON s.vec_id = w.vec_id AND s.clip_id = w.clip_id AND s.j > 0 AND (s.j - 1) // 2 = w.j)
  SELECT w.vec_id, CAST(w.j AS INT) AS joint, round(w.x, 6) AS x, round(w.y, 6) AS y, round(w.z, 6) AS z, round(sqrt((w.x - p.x) ** 2 + (w.y - p.y) ** 2 + (w.z - p.z) ** 2), 6) AS correction FROM w JOIN p USING (clip_id, vec_id, j)""")
def constant_chain(spark, d):
    """Fifteen joints of a binary tree placed by their cells: every bone at its usual length, end joints moved along."""
    x = _rows(spark, d).withColumn("joint_idx", F.explode(F.sequence(F.lit(0), F.lit(JOINTS - 1))))
    cell = lambda i: F.get("v", 4 * F.col("joint_idx") + i)
    samples = x.select("clip_id", "vec_id", "joint_idx", cell(0).alias("x"), cell(1).alias("y"), cell(2).alias("z"))
    rig = samples.select("joint_idx").distinct().withColumn("parent_idx", F.when(F.col("joint_idx") == 0, -1).otherwise(F.floor((F.col("joint_idx") - 1) / 2)).cast("int"))
    out = motion.constant_chain(samples, rig, ["clip_id"], ["vec_id"])
    return out.select("vec_id", F.col("joint_idx").alias("joint"), *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "correction")])


@query("track_links", f"""WITH {EV}, tr AS (SELECT user_id % 20 AS clip, user_id AS track_id, min(t) AS first_t, max(t) AS last_t, count(*) AS frames, arg_min(value, t) AS fx, arg_max(value, t) AS lx FROM ev GROUP BY 1, 2, CAST(ts AS DATE)),
  x AS (SELECT clip, CAST(track_id * 1000000000 + first_t AS BIGINT) AS id, first_t, last_t, frames, fx, lx FROM tr WHERE frames >= 2), j AS (SELECT s.clip, s.id AS b, e.id AS a, s.first_t - e.last_t AS gap FROM x s JOIN x e ON s.clip = e.clip AND s.id <> e.id AND e.last_t <= s.first_t AND s.first_t - e.last_t <= 43200 AND abs(e.lx - s.fx) <= 15)
  SELECT clip, b, arg_min(a, (gap, a)) AS a FROM j GROUP BY 1, 2""")
def track_links(spark, d):
    """Each user's day is a track fragment of one of twenty clips; value plays its position."""
    e = events(spark, d)
    tr = e.groupBy((F.col("user_id") % 20).alias("clip"), "user_id", F.to_date("ts").alias("day")).agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("frames"), F.min_by("value", "t").alias("first_x"), F.max_by("value", "t").alias("last_x"))
    tr = tr.withColumn("track_id", F.rint(F.col("user_id") * 1000000000 + F.col("first_t")).cast("bigint"))
    return motion.track_links(tr, "clip", 43200.0, 15.0, 2).select("clip", "b", "a")


def _span_sql(n: int, taken: str) -> str:
    """Spans of n rows that leave the path between their neighbours; none may touch a row of ``taken``."""
    dot = lambda a, b: f"({a}.qx * {b}.qx + {a}.qy * {b}.qy + {a}.qz * {b}.qz + {a}.qw * {b}.qw)"
    return f"""e{n} AS (SELECT a.clip_id, a.i + 1 AS start, m.i, m.vec_id, a.qw AS aw, b.qw AS bw, {dot('a', 'b')} AS ab, {dot('m', 'a')} AS qa, {dot('m', 'b')} AS qb, (m.t - a.t) / (b.t - a.t) AS u
    FROM r0 a JOIN r0 b ON b.clip_id = a.clip_id AND b.i = a.i + {n + 1} JOIN r0 m ON m.clip_id = a.clip_id AND m.i > a.i AND m.i < b.i),
  k{n} AS (SELECT *, CASE WHEN abs(ab) > 0.9995 THEN 1 - u ELSE sin((1 - u) * acos(least(1, abs(ab)))) / sin(acos(least(1, abs(ab)))) END AS ka,
    CASE WHEN abs(ab) > 0.9995 THEN u ELSE sin(u * acos(least(1, abs(ab)))) / sin(acos(least(1, abs(ab)))) END * CASE WHEN ab < 0 THEN -1 ELSE 1 END AS kb FROM e{n}),
  o{n} AS (SELECT *, degrees(2 * acos(least(1, abs(ka * qa + kb * qb) / sqrt(ka * ka + kb * kb + 2 * ka * kb * ab)))) AS off, degrees(2 * acos(least(1, abs(ab)))) AS gap FROM k{n}),
  h{n} AS (SELECT clip_id, start FROM o{n} WHERE NOT EXISTS (SELECT 1 FROM ({taken}) x WHERE x.clip_id = o{n}.clip_id AND x.i BETWEEN o{n}.start - 1 AND o{n}.start + {n}) GROUP BY 1, 2 HAVING min(off) > 60 AND max(gap) < min(off) / 2),
  t{n} AS (SELECT clip_id, i, arg_max((ka * aw + kb * bw) / sqrt(ka * ka + kb * kb + 2 * ka * kb * ab), start) AS w FROM o{n} JOIN h{n} USING (clip_id, start) GROUP BY 1, 2)"""


@query("orientation_detours", f"""WITH {ROWS}, r0 AS (SELECT clip_id, vec_id, t, qx, qy, qz, qw, row_number() OVER (PARTITION BY clip_id ORDER BY t) - 1 AS i FROM js WHERE j = 0),
  {_span_sql(1, "SELECT NULL AS clip_id, NULL AS i WHERE false")}, {_span_sql(2, "SELECT clip_id, i FROM t1")}, {_span_sql(3, "SELECT clip_id, i FROM t1 UNION ALL SELECT clip_id, i FROM t2")}
  SELECT r0.vec_id, CASE WHEN t1.i IS NOT NULL THEN 1 WHEN t2.i IS NOT NULL THEN 2 WHEN t3.i IS NOT NULL THEN 3 ELSE 0 END AS detour, round(coalesce(t1.w, t2.w, t3.w, r0.qw), 5) AS w
  FROM r0 LEFT JOIN t1 USING (clip_id, i) LEFT JOIN t2 USING (clip_id, i) LEFT JOIN t3 USING (clip_id, i)""")
def orientation_detours(spark, d):
    """Root rotations that jump away from the path between their neighbours and come back."""
    x = _joints(spark, d).filter("joint_idx = 0").withColumn("q", F.struct(*[F.col(f"q{c}").alias(c) for c in "xyzw"]))
    x = series.indexed(x.select("clip_id", "vec_id", "t", "q"), ["clip_id"], "t", width_s=1e4)
    o = motion.orientation_detours(x, ["clip_id"])
    return o.select("vec_id", "detour", F.round("repaired.w", 5).alias("w"))


CV = f"""WITH RECURSIVE {EV}, s AS (SELECT user_id, event_id, t, value AS z, row_number() OVER w AS i, t - lag(t) OVER w AS dt, abs(value - 2 * lag(value) OVER w + lag(value, 2) OVER w) AS d2,
    abs(value - 3 * lag(value) OVER w + 3 * lag(value, 2) OVER w - lag(value, 3) OVER w) AS d3 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
  n AS (SELECT user_id, greatest(1e-12, power(1.4826 * quantile_cont(d3, 0.5), 2) / 20) AS r, greatest(1e-12, power(1.4826 * quantile_cont(d2, 0.5) / power(quantile_cont(dt, 0.5), 2), 2)) AS q FROM s GROUP BY 1),
  f AS (SELECT s.user_id, i, event_id, z AS p, 0.0::DOUBLE AS v, r AS a, 0.0::DOUBLE AS b, q AS c FROM s JOIN n USING (user_id) WHERE i = 1
    UNION ALL SELECT user_id, i, event_id, pp + aa / (aa + r) * (z - pp), v + bb / (aa + r) * (z - pp), (1 - aa / (aa + r)) * aa, (1 - aa / (aa + r)) * bb, cc - bb / (aa + r) * bb FROM (
      SELECT s.user_id, s.i, s.event_id, s.z, n.r, f.v, f.p + f.v * s.dt AS pp, f.a + 2 * s.dt * f.b + s.dt * s.dt * f.c + n.q * power(s.dt, 4) / 4 AS aa,
        f.b + s.dt * f.c + n.q * power(s.dt, 3) / 2 AS bb, f.c + n.q * s.dt * s.dt AS cc FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1 JOIN n ON n.user_id = f.user_id))
  SELECT event_id, round(p, 3) AS filtered FROM f"""


@query("constant_velocity", CV)
def constant_velocity(spark, d):
    """The recursive filter over each user's values."""
    e = series.indexed(events(spark, d).select("event_id", "user_id", "t", "value"), ["user_id"], "t", ["event_id"], DAY)
    return motion.constant_velocity_filter(e, ["user_id"], "t", "value").select("event_id", F.round("filtered", 3).alias("filtered"))


def _scores(spark, d):
    """Quarter scores per user: the strongest event in each six-hour cell."""
    e = events(spark, d)
    q = F.floor((F.col("t") - BASE) / 21600)
    s = e.groupBy(F.col("user_id").alias("key"), q.alias("q")).agg(F.least(F.lit(1.0), F.max("value") / 100).alias("score"))
    return s.withColumn("level", C.metrical(F.col("q"))).withColumn("fast", F.pmod("q", F.lit(3)) == 0)


def _paths(name: str, spans: str, step: int, lo: int, hi: int, pref: int, quantile: float) -> str:
    """SQL that tries every set of cuts of every span and keeps the best, later cuts first on ties."""
    return f"""{name}c AS (SELECT key, quantile_cont(score, {quantile}) AS cost FROM sco WHERE q % {step} = 0 GROUP BY 1),
  {name}s AS (SELECT x.key, x.parent, x.a, x.b, coalesce(c.cost, 0.35) AS cost FROM {spans} x LEFT JOIN {name}c c USING (key)),
  {name}q AS (SELECT s.key, s.parent, s.a, s.b, s.cost, g.q, coalesce(sco.score, 0) AS score FROM (SELECT *, unnest(range(a, b + 1)) AS q FROM {name}s) g JOIN {name}s s ON s.key = g.key AND s.parent = g.parent AND s.a = g.a
    LEFT JOIN sco ON sco.key = g.key AND sco.q = g.q WHERE g.q = s.a OR g.q = s.b OR g.q % {step} = 0),
  {name}p AS (SELECT key, parent, a, b, cost, a AS last, [a] AS cuts, 0.0::DOUBLE AS v FROM {name}s
    UNION ALL SELECT p.key, p.parent, p.a, p.b, p.cost, n.q, list_prepend(n.q, p.cuts), p.v + CASE WHEN n.q < p.b THEN n.score - p.cost ELSE 0 END - 0.25 * abs(log2((n.q - p.last) / {pref}.0))
    FROM {name}p p JOIN {name}q n ON n.key = p.key AND n.parent = p.parent AND n.a = p.a AND n.q > p.last AND n.q - p.last <= {hi} AND n.q - p.last >= least({lo}, p.b - p.a)),
  {name}b AS (SELECT s.key, s.parent, s.a, s.b, coalesce(arg_max(p.cuts, (round(p.v, 9), p.cuts)), [s.b, s.a]) AS cuts FROM {name}s s LEFT JOIN {name}p p ON p.key = s.key AND p.parent = s.parent AND p.a = s.a AND p.last = s.b GROUP BY 1, 2, 3, 4),
  {name} AS (SELECT key, parent, cuts[i + 1] AS a, cuts[i] AS b FROM (SELECT *, unnest(range(1, len(cuts))) AS i FROM {name}b))"""


SEG = f"""WITH RECURSIVE {EV}, sco AS (SELECT user_id AS key, CAST(floor((t - {BASE}) / 21600) AS BIGINT) AS q, least(1, max(value) / 100) AS score FROM ev GROUP BY 1, 2),
  tops AS (SELECT DISTINCT key, q // 16 AS parent, q // 16 * 16 AS a, q // 16 * 16 + 16 AS b FROM sco), {_paths('bg', 'tops', 4, 4, 12, 8, 0.65)},
  inn AS (SELECT key, a AS parent, a, b FROM bg), {_paths('im', 'inn', 2, 2, 8, 4, 0.5)}
  SELECT key, 'beginner' AS level, a, b FROM bg UNION ALL SELECT key, 'intermediate', a, b FROM im"""


@query("segmentation", SEG)
def segmentation(spark, d):
    """Nested cuts, beginner then intermediate; the SQL side tries every set of cuts.

    Scores and the first cuts are each read several times, so both are written once.
    """
    s = stored(_scores(spark, d), "quarter-scores")
    top = s.select("key", F.floor(F.col("q") / 16).alias("parent")).distinct().select(
        "key", "parent", (F.col("parent") * 16).alias("a"), (F.col("parent") * 16 + 16).alias("b"), F.lit(0.5).alias("spc"), F.lit(120.0).alias("bpm"))
    first = stored(motion.segment(top, s, "key", "beginner"), "beginner-cuts")
    inner = first.select("key", F.col("a").alias("parent"), "a", "b", F.lit(0.5).alias("spc"), F.lit(120.0).alias("bpm"))
    second = motion.segment(inner, s, "key", "intermediate")
    return first.select("key", F.lit("beginner").alias("level"), "a", "b").unionByName(second.select("key", F.lit("intermediate").alias("level"), "a", "b"))


@query("cut_costs", f"""WITH {EV}, s AS (SELECT user_id AS key, CAST(floor((t - {BASE}) / 21600) AS BIGINT) AS q, least(1, max(value) / 100) AS score FROM ev GROUP BY 1, 2)
  SELECT key, round(quantile_cont(score, 0.5), 6) AS cost FROM s WHERE q % 2 = 0 GROUP BY 1""")
def cut_costs(spark, d):
    return motion.cut_costs(_scores(spark, d), "key", "intermediate").select("key", F.round("cost", 6).alias("cost"))


def _steps(spark, d):
    """Gaps between a user's occupied quarters as steps."""
    s = series.indexed(_scores(spark, d).withColumn("t", F.col("q").cast("double")), ["key"], "t", width_s=16.0)
    s = ordered.row_frames(s, ["key"], 1, lambda frame: {"b": F.lead("q").over(frame(None, None))}).filter("b is not null")
    return s.select("key", F.col("q").alias("a"), "b", "score")


STEPS = f"""{EV}, qs AS (SELECT user_id AS key, CAST(floor((t - {BASE}) / 21600) AS BIGINT) AS a, least(1, max(value) / 100) AS score FROM ev GROUP BY 1, 2),
  st AS (SELECT * FROM (SELECT key, a, lead(a) OVER (PARTITION BY key ORDER BY a) AS b, score FROM qs) WHERE b IS NOT NULL)"""


@query("level_stats", f"""WITH {STEPS}, l AS (SELECT key, max(b) AS lb FROM st GROUP BY 1) SELECT key, count(*) AS steps, round(quantile_cont((b - a) / 4, 0.5), 4) AS median_counts, CAST(round_even(100 * avg(CASE WHEN (b - a) / 4 BETWEEN 0.5 AND 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS in_range_pct,
  count(*) FILTER (WHERE b < lb AND b % 4 = 0) AS cuts_on_count, count(*) FILTER (WHERE b < lb AND b % 4 = 2) AS cuts_on_and FROM st JOIN l USING (key) GROUP BY 1""")
def level_stats(spark, d):
    lo, hi = motion.TARGET["intermediate"]
    s = motion.level_stats(_steps(spark, d), ["key"], F.lit(lo), F.lit(hi))
    return s.select("key", "steps", F.round("median_counts", 4).alias("median_counts"), "in_range_pct", "cuts_on_count", "cuts_on_and")


@query("label_quality", f"""WITH {STEPS}, q AS (SELECT key, quantile_cont(score, 0.2) AS lo, quantile_cont((b - a) * 1.0, 0.75) AS hp, quantile_cont((b - a) * 1.0, 0.3) AS lp FROM st GROUP BY 1)
  SELECT key, a, CASE WHEN score <= lo THEN 'small / hold' WHEN (b - a) >= hp AND score >= 0.5 THEN 'sharp (hits and stops)' WHEN (b - a) <= lp THEN 'smooth / even' ELSE '—' END AS quality FROM st JOIN q USING (key)""")
def label_quality(spark, d):
    s = _steps(spark, d).withColumn("mean_energy", F.col("score")).withColumn("peakiness", (F.col("b") - F.col("a")).cast("double")).withColumn("end_cue", F.col("score"))
    return motion.label_quality(s, ["key"]).select("key", "a", "quality")


@query("chunks", f"""WITH RECURSIVE {STEPS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY a) AS i FROM st),
  f AS (SELECT key, i, a, b, 0::BIGINT AS chunk, a AS start, ((b - a) / 4 >= 3 AND b % 16 IN (0, 2)) OR (b - a) / 4 >= 6 AS cl FROM n WHERE i = 1
    UNION ALL SELECT n.key, n.i, n.a, n.b, f.chunk + f.cl::INT, CASE WHEN f.cl THEN n.a ELSE f.start END, ((n.b - CASE WHEN f.cl THEN n.a ELSE f.start END) / 4 >= 3 AND n.b % 16 IN (0, 2)) OR (n.b - CASE WHEN f.cl THEN n.a ELSE f.start END) / 4 >= 6 FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1)
  SELECT key, chunk, a, b FROM f""")
def chunks(spark, d):
    return motion.chunks(_steps(spark, d), "key").select("key", "chunk", "a", "b")


@query("step_features", f"""WITH {EV}, s AS (SELECT user_id AS key, t, value AS energy, value / 20 AS sa, k / 20.0 AS sb, k / 100.0 AS x, value / 100 AS y, (100 - k) / 100.0 AS z FROM ev),
  m AS (SELECT key, quantile_cont(dt, 0.5) AS mdt FROM (SELECT key, t - lag(t) OVER (PARTITION BY key ORDER BY t) AS dt FROM s) GROUP BY 1),
  st AS (SELECT DISTINCT key, CAST(floor((t - {BASE}) / 86400) AS BIGINT) AS step FROM s), w AS (SELECT *, {BASE} + step * 86400 AS ta, {BASE} + (step + 1) * 86400 AS tb FROM st),
  j AS (SELECT w.key, w.step, s.* EXCLUDE (key) FROM w JOIN s ON s.key = w.key AND s.t >= ta AND s.t <= tb)
  SELECT j.key, step, count(*) AS samples, round(avg(energy), 6) AS mean_energy, round(max(energy) / (avg(energy) + 1e-6), 4) AS peakiness, round(arg_max(x, t) - arg_min(x, t), 4) AS dx,
    CASE WHEN sum(sa) >= sum(sb) THEN 'a' ELSE 'b' END AS lead, CASE WHEN min(y) - arg_min(y, t) < -0.1 THEN CASE WHEN arg_max(y, t) - arg_min(y, t) > 0.5 * (min(y) - arg_min(y, t)) THEN 'drop and up' ELSE 'drop' END WHEN max(y) - arg_min(y, t) > 0.1 THEN 'jump/rise' END AS level FROM j GROUP BY 1, 2""")
def step_features(spark, d):
    """A user's days as steps; event values play speeds and positions."""
    e = events(spark, d)
    k, v = F.col("k"), F.col("value")
    s = e.select(F.col("user_id").alias("key"), "t", v.alias("energy"), (v / 20).alias("speed_a"), (k / 20).alias("speed_b"), (k / 100).alias("x"), (v / 100).alias("y"), ((100 - k) / 100).alias("z"))
    st = s.select("key", F.floor((F.col("t") - BASE) / DAY).alias("step")).distinct()
    st = st.withColumn("ta", BASE + F.col("step") * F.lit(DAY)).withColumn("tb", F.col("ta") + DAY)
    f = motion.step_features(s, st, "key", ["a", "b"], DAY)
    return f.select("key", "step", "samples", F.round("mean_energy", 6).alias("mean_energy"), F.round("peakiness", 4).alias("peakiness"), F.round("dx", 4).alias("dx"),
                    F.col("most").alias("lead"), "level")


@query("counts_motion", f"""WITH {EV}, s AS (SELECT user_id % 10 AS key, CAST(floor((t - {BASE}) / 14400) AS BIGINT) AS c, 2 * pi() * (t - {BASE}) / 14400 AS ph, value, k, k % 5 <> 0 AS ok, event_type FROM ev), l AS (SELECT key, quantile_cont(value, 0.75) AS lvl FROM s WHERE ok GROUP BY 1),
  g AS (SELECT key, c, avg(ok::INT) AS seen, round_even(avg(value) / (max(lvl) + 1e-9), 2) AS limb, round_even(avg(k / 100.0), 2) AS root, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END) AS music FROM s JOIN l USING (key) GROUP BY 1, 2),
  m AS (SELECT g.key, g.c, count(*) AS n, avg(value) AS mean FROM g JOIN s ON s.key = g.key AND ok AND s.c BETWEEN g.c - 2 AND g.c + 2 GROUP BY 1, 2),
  p AS (SELECT m.key, m.c, max(n) AS n, sum((value - mean) ** 2) AS ss, sum((value - mean) * cos(ph)) ** 2 + sum((value - mean) * sin(ph)) ** 2 + sum((value - mean) * cos(2 * ph)) ** 2 + sum((value - mean) * sin(2 * ph)) ** 2 AS power
    FROM m JOIN s ON s.key = m.key AND ok AND s.c BETWEEN m.c - 2 AND m.c + 2 GROUP BY 1, 2)
  SELECT key, c, round(limb, 2) AS limb, CASE WHEN n > 8 AND ss > 0 THEN round_even(least(1, power * 2 / (n * ss)), 2) ELSE 0 END AS lock,
    CASE WHEN seen < 0.5 THEN 'not in frame' WHEN music < 0.2 THEN 'no music' WHEN limb < 0.5 AND root > 0.6 THEN 'walking' WHEN limb < 0.35 AND root < 0.6 THEN 'still' END AS why FROM g LEFT JOIN p USING (key, c)""")
def counts_motion(spark, d):
    e = events(spark, d)
    s = e.select((F.col("user_id") % 10).alias("key"), "t", F.col("value").alias("limb"), (F.col("k") / 100).alias("root"), (F.col("k") % 5 != 0).alias("ok"),
                 F.when(F.col("event_type") == "view", 1.0).otherwise(0.0).alias("music"))
    g = motion.counts_motion(s, "key", F.lit(float(BASE)), F.lit(14400.0))
    return g.select("key", "c", F.round("limb", 2).alias("limb"), "lock", "why")


@query("counts_music", f"""WITH {EV}, s AS (SELECT user_id % 10 AS key, t, CAST(floor((t - {BASE}) / 14400) AS BIGINT) AS c FROM ev WHERE event_type <> 'view'),
  u AS (SELECT user_id % 10 AS key, t, value / 50 AS v FROM ev WHERE event_type = 'view'), g AS (SELECT DISTINCT key, c, {BASE} + (c + 0.5) * 14400 AS mid FROM s),
  b AS (SELECT g.key, c, mid, max(u.t) FILTER (WHERE u.t <= mid) AS t0, arg_max(v, u.t) FILTER (WHERE u.t <= mid) AS v0, min(u.t) FILTER (WHERE u.t > mid) AS t1, arg_min(v, u.t) FILTER (WHERE u.t > mid) AS v1 FROM g JOIN u ON u.key = g.key GROUP BY 1, 2, 3)
  SELECT key, c, round(coalesce(v0 + (v1 - v0) * (mid - t0) / (t1 - t0), v0, v1), 6) AS music FROM b""")
def counts_music(spark, d):
    """Music read at each count's centre, between the loudness samples either side."""
    e = events(spark, d).withColumn("key", F.col("user_id") % 10)
    s = e.filter("event_type <> 'view'").select("key", "t", F.col("value").alias("limb"), (F.col("k") / 100).alias("root"), F.lit(True).alias("ok"))
    loud = e.filter("event_type = 'view'").select("key", "t", (F.col("value") / 50).alias("music"))
    g = motion.counts_motion(s, "key", F.lit(float(BASE)), F.lit(14400.0), music=loud, width_s=DAY)
    return g.select("key", "c", F.round("music", 6).alias("music"))


@query("practised", """WITH l AS (SELECT l_suppkey AS u, l_quantity / 2 AS a, l_quantity / 2 + l_linenumber AS b FROM lineitem), c AS (SELECT DISTINCT u, unnest(range(CAST(ceil(a) AS BIGINT), CAST(floor(b) AS BIGINT) + 1)) AS c FROM l WHERE l_done(u)),
  s AS (SELECT DISTINCT u, floor(a / 8) * 8 + 1 AS sa FROM l) SELECT s.u, CAST(sa AS BIGINT) AS a, count(c.c) = 8 AS done FROM s LEFT JOIN c ON c.u = s.u AND c.c BETWEEN sa AND sa + 7 GROUP BY 1, 2""".replace(" WHERE l_done(u)", ""))
def practised(spark, d):
    """Line items as loops a supplier practised; which of the touched eights are complete."""
    lo = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("u"), (F.col("l_quantity") / 2).alias("a"), (F.col("l_quantity") / 2 + F.col("l_linenumber")).alias("b"))
    done = motion.practised(lo, ["u"])
    spans = lo.select("u", (F.floor(F.col("a") / 8) * 8 + 1).alias("a")).distinct().withColumn("b", F.col("a") + 7)
    return motion.spans_done(done, spans, ["u"]).select("u", "a", "done")


@query("resolve_aliases", """WITH n AS (SELECT p_brand AS rig, p_partkey AS j, CASE p_partkey % 6 WHEN 0 THEN 'pelvis' WHEN 1 THEN 'body_world' WHEN 2 THEN 'l_wrist' WHEN 3 THEN 'c_head' WHEN 4 THEN 'other' ELSE 'left_wrist' END AS name FROM part),
  w AS (SELECT DISTINCT rig, c FROM n, (VALUES ('pelvis', 'body_world'), ('left_wrist', 'l_wrist'), ('head', 'c_head'), ('neck', 'c_neck')) v(c, a))
  SELECT w.rig, w.c AS canonical, arg_min(j, (CASE WHEN name = w.c THEN 0 ELSE 1 END, j)) AS joint FROM w LEFT JOIN n ON n.rig = w.rig AND (n.name = w.c OR n.name = CASE w.c WHEN 'pelvis' THEN 'body_world' WHEN 'left_wrist' THEN 'l_wrist' WHEN 'head' THEN 'c_head' ELSE 'c_neck' END) GROUP BY 1, 2""")
def resolve_aliases(spark, d):
    """Brands as rigs, parts as joints named by key."""
    names = F.element_at(F.array(*map(F.lit, ("pelvis", "body_world", "l_wrist", "c_head", "other", "left_wrist"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    j = table(spark, d, "part").select(F.col("p_brand").alias("rig"), F.col("p_partkey").alias("joint_idx"), names.alias("name"))
    some = {c: motion.ALIASES[c] for c in ("pelvis", "left_wrist", "head", "neck")}
    return motion.resolve_aliases(j, ["rig"], some)


@query("name_sides", """SELECT p_partkey AS joint, CASE p_partkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'left' END AS side, CASE p_partkey % 4 WHEN 0 THEN 'left,fore,arm' WHEN 1 THEN 'b,r,wrist' WHEN 2 THEN 'llower,arm' ELSE 'root' END AS tokens FROM part""")
def name_sides(spark, d):
    from ..functions import text
    n = F.concat(F.element_at(F.array(*map(F.lit, ("LeftForeArm_", "b_r_wrist.", "LLowerArm", "root:"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("joint"), text.name_side(n).alias("side"), F.array_join(text.name_tokens(n), ",").alias("tokens"))


@query("side_crop", f"WITH {ROWS}, s AS (SELECT vec_id, 320 + v[1] * 500 AS wx, 240 + v[2] * 500 AS wy, least(1.6 * sqrt(power(v[3] * 500, 2) + power(v[4] * 500, 2)), 480) AS side FROM rw) SELECT vec_id, round(greatest(0, least(wx - side / 2, 640 - side)) / 640, 5) AS x, round(side / 640, 5) AS width FROM s WHERE side > 0")
def side_crop(spark, d):
    v = lambda i: F.get("v", F.lit(i)) * 500
    wrist = F.struct((320 + v(0)).alias("x"), (240 + v(1)).alias("y"))
    elbow = F.struct((320 + v(0) + v(2)).alias("x"), (240 + v(1) + v(3)).alias("y"))
    c = motion.side_crop(wrist, elbow, F.lit(640.0), F.lit(480.0))
    return _rows(spark, d).select("vec_id", F.round(c["x"], 5).alias("x"), F.round(c["width"], 5).alias("width"))


@query("part_structure", f"""WITH {EV}, g AS (SELECT user_id AS k, min(value) AS one, 0.5 + (user_id % 5) / 10.0 AS spc, 60.0 + user_id % 30 AS end_s FROM ev GROUP BY 1, 3, 4),
  e AS (SELECT *, CAST(ceil(floor((one + 0.02) / spc) / 8) AS BIGINT) AS e FROM g), h AS (SELECT *, one - e * 8 * spc AS o2, greatest(1, CAST(floor((end_s - (one - e * 8 * spc)) / spc) AS BIGINT) + 1) AS total FROM e),
  p AS (SELECT user_id AS k, k % 70 + 0.25 AS raw, CASE WHEN k % 70 % 2 = 0 THEN 'Part 9' ELSE 'Solo ' || (k % 70) END AS name FROM ev), a AS (SELECT h.k, raw + 8 * e AS raw, 1 AS nw, p.name, total FROM p JOIN h USING (k) UNION ALL SELECT k, 1 + 8 * unnest(range(0, e)), 0, 'Part 1', total FROM h),
  r AS (SELECT k, CAST(floor(raw + 0.5) AS BIGINT) AS s, arg_min(name, (raw, nw)) AS name FROM a WHERE floor(raw + 0.5) BETWEEN 1 AND total GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) AS pos FROM (SELECT * FROM r UNION ALL SELECT k, 1, 'Part 1' FROM h WHERE k NOT IN (SELECT k FROM r)))
  SELECT k, CAST(pos AS BIGINT) AS position, CASE WHEN pos = 1 THEN 1 ELSE s END AS start_count, CASE WHEN regexp_matches(name, '^Part [0-9]+$') THEN 'Part ' || pos ELSE name END AS name FROM n""")
def part_structure(spark, d):
    e = events(spark, d)
    g = e.groupBy(F.col("user_id").alias("k")).agg(F.min("value").alias("one")).withColumn("spc", 0.5 + (F.col("k") % 5) / 10).withColumn("end_s", 60.0 + F.col("k") % 30)
    p = e.select(F.col("user_id").alias("k"), (F.col("k") % 70 + 0.25).alias("start_count"), F.when(F.col("k") % 70 % 2 == 0, "Part 9").otherwise(F.concat(F.lit("Solo "), (F.col("k") % 70).cast("string"))).alias("name")).distinct()
    return grid.normalise_parts(g, p, "k").withColumn("position", F.col("position").cast("bigint"))


@query("bar_rows", f"""WITH {EV}, g AS (SELECT event_id, 0.5 + (k % 13) / 10.0 AS spc, 1.0 + (user_id % 7) / 4.0 AS one FROM ev) SELECT event_id, CAST(j AS INT) AS option, round(one - floor(one / spc + 1e-6) * spc + j * spc, 3) AS at FROM g, range(0, 4) r(j)""")
def bar_rows(spark, d):
    e = events(spark, d).select("event_id", (0.5 + (F.col("k") % 13) / 10.0).alias("spc"), (1.0 + (F.col("user_id") % 7) / 4.0).alias("one"))
    return e.select("event_id", F.posexplode(C.bar_options(F.col("one"), F.col("spc"))).alias("option", "at"))
