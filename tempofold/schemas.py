"""Declared schemas of everything read or written; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STR, INT, BIG, DBL, BOOL, TS, DATE, BIN = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
                                           T.TimestampType(), T.DateType(), T.BinaryType())
DOUBLES, STRINGS = T.ArrayType(DBL), T.ArrayType(STR)

EVENT_LOG = _s(("id", BIG), ("occurred_at", TS), ("name", STR), ("clip_id", STR), ("job_id", STR), ("creator_token_id", STR),
               ("day_hash", BIN), ("country", STR), ("props", STR))
CLIENT_BATCH = _s(("body", STR), ("user_agent", STR), ("ip", STR), ("received_at", TS))
EVENT_DAILY = _s(("day", DATE), ("name", STR), ("detail", STR), ("n", BIG), ("visitors", BIG), ("seconds", T.DecimalType(38, 6)))
SALTS = _s(("day", DATE), ("salt", BIN))

ERROR = _s(("code", STR), ("message", STR), ("retryable", BOOL))
MILESTONE_COUNTS = _s(("bpm", DBL), ("count_one_s", DBL), ("seconds_per_count", DBL), ("confidence", DBL))
MILESTONES = _s(("counts", MILESTONE_COUNTS), ("dancers", INT), ("frames_done", INT), ("frames_total", INT))
JOB_STATUS = _s(("schema_version", STR), ("job_id", STR), ("state", STR), ("stage_message", STR), ("progress", DBL), ("error", ERROR),
                ("retry_count", INT), ("milestones", MILESTONES))
JOBS = _s(("job_id", STR), ("clip_id", STR), ("state", STR), ("stage_message", STR), ("progress", DBL), ("error", ERROR), ("retry_count", INT),
          ("created_at", TS), ("updated_at", TS))
LISTING = _s(("path", STR), ("mtime_s", DBL), ("bytes", BIG))
TOMBSTONES = _s(("clip_id", STR), ("reason", STR), ("relationship", STR), ("removed_at", DBL), ("quarantined", BOOL))
FINGERPRINT = _s(("sha256", STR), ("duration_s", DBL), ("frames", INT), ("ahash", STR), ("dhash", STR))

COUNT_LABEL = _s(("clip", STR), ("job_id", STR), ("count_one_s", DBL), ("raw", DBL), ("bpm", DBL), ("spc", DBL), ("method", STR),
                 ("labelled_at", STR), ("source", STR))
LABEL_FILE = _s(("labels", T.ArrayType(COUNT_LABEL)))
BEAT_TRACK = _s(("beats", DOUBLES), ("downbeats", DOUBLES), ("accents", DOUBLES))
GATE_RESULT = _s(("clip", STR), ("accept", BOOL), ("reasons", STRINGS),
                 ("scores", _s(("dance", DBL), ("still", DBL), ("nsfw", DBL), ("person", DBL), ("limb", DBL))), ("seconds", T.MapType(STR, DBL)))
CLIP_MANIFEST = _s(("id", STR), ("url", STR), ("title", STR), ("why", STR), ("rights", STR), ("notes", STR), ("duration_s", DBL), ("tests", STRINGS))
DETECTIONS = _s(("fps", DBL), ("width", INT), ("height", INT), ("times", DOUBLES),
                ("dancers", T.ArrayType(_s(("id", INT), ("points", T.ArrayType(T.ArrayType(DOUBLES)))))))

PROVENANCE = _s(("observed", BOOL), ("interpolated", BOOL), ("suppressed", STR))
RECT = _s(("x", DBL), ("y", DBL), ("width", DBL), ("height", DBL))
RECTS = T.ArrayType(RECT)
JOINT_SAMPLE = _s(("rotation", DOUBLES), ("provenance", PROVENANCE), ("visibility", STR))
ROOT_SAMPLE = _s(("position", DOUBLES), ("rotation", DOUBLES), ("provenance", PROVENANCE))
REGIONS = ("hands", "feet", "left_hand", "right_hand", "left_foot", "right_foot")
PERSON = _s(("person_id", STR), ("track_id", INT), ("animation", _s(("clip_id", STR), ("glb_asset_id", STR))), ("shape_params", _s(("source", STR))),
            ("root_trajectory", T.ArrayType(ROOT_SAMPLE)), ("samples", T.ArrayType(_s(("joints", T.ArrayType(JOINT_SAMPLE))))),
            ("crop_rects", _s(*[(r, RECTS) for r in REGIONS])))
JOINT = _s(("name", STR), ("index", INT), ("parent_index", INT), ("glb_node_name", STR), ("rest_rotation", DOUBLES), ("rest_translation", DOUBLES))
TEMPO_ALT = _s(("label", STR), ("seconds_per_count", DBL), ("bpm", DBL))
ONE_ALT = _s(("count_one_s", DBL), ("shift_counts", BIG), ("confidence", DBL))
PROPOSED_COUNTS = _s(("count_one_s", DBL), ("seconds_per_count", DBL), ("count_total", BIG), ("confidence", DBL), ("bpm", DBL),
                     ("alternates", T.ArrayType(TEMPO_ALT)), ("warnings", STRINGS), ("count_one_alternates", T.ArrayType(ONE_ALT)),
                     ("count_one_confidence", DBL), ("count_one_source", STR))
MOTION_RESULT = _s(
    ("schema_version", STR), ("job_id", STR),
    ("source_video", _s(("asset_id", STR), ("width_px", INT), ("height_px", INT), ("rotation_deg", INT), ("duration_s", DBL), ("fps_nominal", DBL), ("audio_offset_s", DBL))),
    ("sample_times_s", DOUBLES),
    ("camera", _s(("model", STR), ("intrinsics", _s(("fx", DBL), ("fy", DBL), ("cx", DBL), ("cy", DBL), ("reference_width_px", INT), ("reference_height_px", INT))), ("camera_to_world", DOUBLES))),
    ("grounding", _s(("status", STR), ("floor_plane", _s(("normal", DOUBLES), ("point", DOUBLES))))),
    ("proposed_counts", PROPOSED_COUNTS),
    ("joint_hierarchy", _s(("rotation_convention", STR), ("root_joint_index", INT), ("joints", T.ArrayType(JOINT)))),
    ("persons", T.ArrayType(PERSON)))
