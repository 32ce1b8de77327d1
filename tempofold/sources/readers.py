"""Readers with declared schemas. Each returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..operators import contract


def client_batches(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies as JSON lines: body, user_agent, ip, received_at."""
    return spark.read.schema(schemas.CLIENT_BATCH).json(path)


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """The event log; the ``day`` partition column prunes whole folders."""
    return spark.read.schema(T.StructType([*schemas.EVENT_LOG.fields, T.StructField("day", T.DateType())])).parquet(path)


def object_listing(spark: SparkSession, path: str) -> DataFrame:
    """Every stored object below ``path``: path, mtime_s, bytes. Contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), (F.unix_micros("modificationTime") / 1e6).alias("mtime_s"),
                        F.col("length").alias("bytes"))


def motion_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested motion documents (gzip JSON, one per file), keyed by the file's clip id."""
    docs = spark.read.schema(schemas.MOTION_RESULT).option("multiLine", True).json(path)
    cols = F.struct(*[F.col(c) for c in docs.columns])
    return docs.select(F.regexp_extract(F.input_file_name(), r"([^/.]+)\.[^/]*$", 1).alias("clip_id"), cols.alias("doc"))


def job_status(spark: SparkSession, path: str) -> DataFrame:
    """Job-status documents with their contract violations."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    parsed = contract.parse_documents(raw, "body", schemas.JOB_STATUS)
    bad = F.when(F.col("parse_error"), F.array(F.lit("not a document"))).otherwise(contract.status_violations(F.col("doc")))
    return parsed.select("file", "doc.*", bad.alias("violations"))


def count_labels(spark: SparkSession, path: str) -> DataFrame:
    """Owner labels from {"labels": [...]} files, one row per label."""
    return spark.read.schema(schemas.LABEL_FILE).option("multiLine", True).json(path).select(F.explode("labels").alias("l")).select("l.*")


def beat_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Recorded tracker output, a map clip -> {beats, downbeats, accents}, as one row per clip."""
    raw = spark.read.text(path, wholetext=True)
    # Entries are parsed one by one: a note beside the tracks must not spoil them.
    entries = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("clip", "_text"))
    return entries.select("clip", F.from_json("_text", schemas.BEAT_TRACK).alias("track")).filter("track.beats is not null").select("clip", "track.*")


def beats_long(tracks: DataFrame) -> dict[str, DataFrame]:
    """Beat tracks as long tables: beats (clip, t), downbeats (clip, t), accents (clip, i, accent)."""
    return {
        "beats": tracks.select("clip", F.explode("beats").alias("t")),
        "downbeats": tracks.select("clip", F.explode("downbeats").alias("t")),
        "accents": tracks.select("clip", F.posexplode("accents").alias("i", "accent")),
    }


def score_caches(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Per-clip score files, keyed by file name: (good rows, corrupt files reported, never fatal)."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^/.]*$", 1).alias("clip"), F.col("value").alias("text"))
    broken = F.try_parse_json("text").isNull()
    good = raw.filter(~broken).select("clip", F.from_json("text", schema).alias("s")).select("clip", "s.*")
    return good, raw.filter(broken)


def gate_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GATE_RESULT).json(path)


def clip_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation manifest as JSON lines."""
    return spark.read.schema(schemas.CLIP_MANIFEST).json(path)


def manifest_tests(manifest: DataFrame) -> DataFrame:
    """Clips per test tag."""
    return manifest.select("id", F.explode("tests").alias("test")).groupBy("test").agg(F.count("*").alias("clips"))


def probe_quarantine(clips: DataFrame, width: str = "stream_width") -> tuple[DataFrame, DataFrame]:
    """(usable clips, clips with no video stream)."""
    return clips.filter(F.col(width).isNotNull()), clips.filter(F.col(width).isNull())
