"""Contract checks: one array of violations per document, all by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions import counts as C

SCHEMA_VERSION = "1.0.0"
JOB_STATES = ("queued", "processing", "succeeded", "failed")
VISIBILITIES = ("observed", "uncertain", "absent")
SUPPRESSIONS = ("out_of_frame", "occluded", "low_confidence")


def _each(rule: Column, text: Column | str) -> Column:
    return F.when(F.coalesce(rule, F.lit(False)), F.lit(text) if isinstance(text, str) else text)


def status_violations(doc: Column) -> Column:
    """Violations of a job-status document parsed with ``schemas.JOB_STATUS``."""
    err, c, m = doc["error"], doc["milestones"]["counts"], doc["milestones"]
    empty = lambda x: x.isNull() | (x == "")
    return F.array_compact(F.array(
        _each(doc["schema_version"].isNull() | (doc["schema_version"] != SCHEMA_VERSION), "schema_version"),
        _each(empty(doc["job_id"]), "job_id"),
        _each(doc["state"].isNull() | ~doc["state"].isin(*JOB_STATES), "state"),
        _each(doc["stage_message"].isNull(), "stage_message"),
        _each(doc["progress"].isNotNull() & ~doc["progress"].between(0.0, 1.0), "progress"),
        _each(doc["retry_count"].isNull() | (doc["retry_count"] < 0), "retry_count"),
        _each(err.isNotNull() & (empty(err["code"]) | empty(err["message"]) | err["retryable"].isNull()), "error"),
        _each(c.isNotNull() & (~(c["bpm"] > 0) | ~(c["seconds_per_count"] > 0) | ~c["confidence"].between(0.0, 1.0)), "milestones.counts"),
        _each(m["dancers"].isNotNull() & (m["dancers"] < 0), "milestones.dancers"),
        _each(m["frames_total"].isNotNull() & (m["frames_total"] < 1), "milestones.frames_total")))


def parse_documents(raw: DataFrame, text: str, schema=schemas.MOTION_RESULT) -> DataFrame:
    """Parse JSON text with a declared schema; text that does not fit gets ``parse_error``."""
    open_ = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE"})
    return raw.withColumn("doc", open_).withColumn("parse_error", F.col("doc").isNull() | (F.try_parse_json(text).isNull()))


def schema_violations(doc: Column) -> Column:
    """Required parts, enums and lengths that the declared schema alone cannot force."""
    joints = doc["joint_hierarchy"]["joints"]
    bad_joint = lambda j: (F.size(j["rotation"]) != 4) | j["provenance"]["observed"].isNull() | ~j["visibility"].isin(*VISIBILITIES)
    return F.array_compact(F.array(
        _each(doc["schema_version"].isNull() | (doc["schema_version"] != SCHEMA_VERSION), "schema_version"),
        _each(doc["job_id"].isNull() | (doc["job_id"] == ""), "job_id"),
        _each(doc["sample_times_s"].isNull() | (F.size(doc["sample_times_s"]) == 0), "sample_times_s"),
        _each(doc["grounding"].isNull() | ~doc["grounding"]["status"].isin("none", "grounded"), "grounding.status"),
        _each(joints.isNull() | (F.size(joints) == 0), "joint_hierarchy"),
        _each(F.size(doc["camera"]["camera_to_world"]) != 16, "camera_to_world"),
        _each(doc["persons"].isNull(), "persons"),
        _each(F.exists(doc["persons"], lambda p: F.exists(p["samples"], lambda s: F.exists(s["joints"], bad_joint))), "joint sample"),
        _each(doc["proposed_counts"].isNotNull() & (~(doc["proposed_counts"]["seconds_per_count"] > 0) | ~doc["proposed_counts"]["confidence"].between(0.0, 1.0)), "proposed_counts")))


def invariant_violations(doc: Column) -> Column:
    """Cross-field rules: order of times, array parity, joint positions, honest absence, floor iff grounded, count total."""
    times, persons, joints = doc["sample_times_s"], doc["persons"], doc["joint_hierarchy"]["joints"]
    n = F.size(times)
    none = F.array().cast("array<string>")
    steps = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(times, i) <= F.get(times, i - 1))
    order = F.transform(steps, lambda i: F.concat(F.lit("sample_times_s must be strictly increasing: index "), i.cast("string")))
    index = F.transform(F.filter(F.transform(joints, lambda j, i: F.struct(i.alias("i"), j["index"].alias("x"))), lambda r: r["i"] != r["x"]),
                        lambda r: F.concat(F.lit("joint_hierarchy.joints["), r["i"].cast("string"), F.lit("].index")))

    def person(p, i):
        at = F.concat(F.lit("persons["), i.cast("string"), F.lit("]."))
        lengths = F.array_compact(F.array(
            F.when(F.size(p["root_trajectory"]) != n, F.concat(at, F.lit("root_trajectory length"))),
            F.when(F.size(p["samples"]) != n, F.concat(at, F.lit("samples length"))),
            *[F.when(p["crop_rects"][r].isNotNull() & (F.size(p["crop_rects"][r]) != n), F.concat(at, F.lit(f"crop_rects.{r} length"))) for r in schemas.REGIONS]))
        short = F.filter(F.transform(p["samples"], lambda s, k: F.when(F.size(s["joints"]) != F.size(joints), F.concat(at, F.lit("samples["), k.cast("string"), F.lit("].joints length")))), lambda v: v.isNotNull())
        quiet = F.flatten(F.transform(p["samples"], lambda s, k: F.filter(F.transform(s["joints"], lambda j, m: F.when(
            (j["visibility"] == "absent") & j["provenance"]["suppressed"].isNull(),
            F.concat(at, F.lit("samples["), k.cast("string"), F.lit("].joints["), m.cast("string"), F.lit("] absent without a reason")))), lambda v: v.isNotNull())))
        return F.concat(lengths, short, quiet)

    g, pc = doc["grounding"], doc["proposed_counts"]
    floor = F.array_compact(F.array(
        _each((g["status"] == "none") & g["floor_plane"].isNotNull(), "grounding none with a floor_plane"),
        _each((g["status"] == "grounded") & g["floor_plane"].isNull(), "grounding grounded without a floor_plane"),
        _each(pc.isNotNull() & (pc["count_total"] != C.count_total(pc["count_one_s"], pc["seconds_per_count"], F.get(times, n - 1))), "proposed_counts.count_total")))
    return F.concat(F.when(n > 1, order).otherwise(none), F.coalesce(index, none), F.coalesce(F.flatten(F.transform(persons, person)), none), floor)


def validate(raw: DataFrame, text: str) -> DataFrame:
    """Parsed documents with every violation: the schema's first, the invariants only when it holds."""
    x = parse_documents(raw, text)
    x = x.withColumn("_schema", F.when(F.col("parse_error"), F.array(F.lit("not a document"))).otherwise(schema_violations(F.col("doc"))))
    return x.withColumn("violations", F.when(F.size("_schema") > 0, F.col("_schema")).otherwise(invariant_violations(F.col("doc")))).drop("_schema")
