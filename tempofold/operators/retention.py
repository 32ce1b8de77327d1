"""Retention: who owns each stored object, what must go, what was left behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import jobs as J

# Object name endings.
TOMBSTONE = "removed.json"
DOCUMENT = "motion-result.json.gz"
ARCHIVE = "npz"
MANIFEST = "export-manifest.json"
TOUCH = "last-access.json"
PRESERVE_DAYS = 365


def owned(listing: DataFrame, path: str = "path") -> DataFrame:
    """Add owner clip_id and ``part`` (what is left of the name) to a flat listing.

    Ids hold no dot and no underscore, so the owner is parsed once per name and
    every later match is an equality, never a prefix comparison.
    """
    name = F.regexp_replace(F.col(path), "^/+", "")
    job = F.regexp_extract(name, r"^job_([^._]+)\.(.+)$", 1)
    track = F.regexp_extract(name, r"^([^._]+)_(track.*)$", 1)
    plain = F.regexp_extract(name, r"^([^._]+)\.(.+)$", 1)
    clip = F.when(job != "", job).when(track != "", track).when(plain != "", plain)
    part = (F.when(job != "", F.concat(F.lit("job."), F.regexp_extract(name, r"^job_[^._]+\.(.+)$", 1)))
            .when(track != "", F.regexp_extract(name, r"^[^._]+_(track.*)$", 1))
            .when(plain != "", F.regexp_extract(name, r"^[^._]+\.(.+)$", 1)))
    return listing.withColumn("clip_id", clip).withColumn("part", part)


def object_owner(keys: DataFrame, key: str = "key") -> DataFrame:
    """Owner of each delivery object: video/{id}., motion-result/{id}., glb/{id}_track."""
    pattern = r"^(?:(video|motion-result)/([^./_]+)\.|glb/([^./_]+)_track)"
    clip = F.coalesce(F.nullif(F.regexp_extract(key, pattern, 2), F.lit("")), F.nullif(F.regexp_extract(key, pattern, 3), F.lit("")))
    return keys.withColumn("clip_id", clip).withColumn("kind", F.when(clip.isNotNull(), F.split_part(F.col(key), F.lit("/"), F.lit(1))))


def asset_key(asset: Column) -> Column:
    """Storage key of an asset id; null when it names nothing stored."""
    return (F.when(asset.startswith("video:"), F.concat(F.lit("video/"), F.substring_index(asset, ":", -1), F.lit(".mp4")))
            .when(asset.startswith("audio:"), F.concat(F.lit("video/"), F.substring_index(asset, ":", -1), F.lit(".audio.m4a")))
            .when(asset.endswith(".glb"), F.concat(F.lit("glb/"), asset)))


def asset_clip(asset: Column) -> Column:
    return (F.when(asset.rlike("^(video|audio):"), F.regexp_replace(asset, "^(video|audio):", ""))
            .when(asset.endswith(".glb"), F.regexp_replace(asset, "_track(?!.*_track).*$", "")))


def superseded(keys: DataFrame, keep: DataFrame, key: str = "key") -> DataFrame:
    """Model and document versions not in the keep set; the video is never listed."""
    return object_owner(keys, key).filter(F.col("kind").isin("glb", "motion-result")).join(keep.select(key), key, "left_anti")


def not_removed(rows: DataFrame, tombstones: DataFrame, clip: str = "clip_id") -> DataFrame:
    return rows.join(tombstones.select(clip), clip, "left_anti")


def late_writes(listing: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """Removed lessons that something wrote to after removal: (clip_id, files)."""
    own = owned(listing)
    removed = own.filter(F.col("part") == TOMBSTONE).select("clip_id").distinct()
    left = own.filter(F.col("part") != TOMBSTONE).select("clip_id", "path")
    if uploads is not None:
        left = left.unionByName(owned(uploads).filter(F.col("part") == "mp4").select("clip_id", "path"))
    return left.join(removed, "clip_id", "left_semi").groupBy("clip_id").agg(F.count("*").alias("files"))


def orphan_audit(tombstones: DataFrame, stores: dict[str, DataFrame], kept: Sequence[str] = ("events",)) -> DataFrame:
    """For each removed lesson, rows surviving in every store, and whether any must go.

    Each store is (clip_id, ...) and is counted map-side before it is joined.
    ``kept`` stores are counted but do not make a lesson dirty.
    """
    out = tombstones.select("clip_id", "reason").distinct()
    for name, df in stores.items():
        out = out.join(df.groupBy("clip_id").agg(F.count("*").alias(name)), "clip_id", "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in stores})
    dirty = F.lit(0)
    for n in stores:
        if n not in kept:
            dirty = dirty + F.col(n)
    return out.withColumn("dirty", dirty > 0)


def listing_flags(listing: DataFrame) -> DataFrame:
    """One row per clip: which artifacts it has and when its build and touch files were written."""
    own = owned(listing).filter("clip_id is not null")
    has = lambda p: F.bool_or(F.col("part") == p)
    at = lambda p: F.max(F.when(F.col("part") == p, F.col("mtime_s")))
    return own.groupBy("clip_id").agg(
        has(TOMBSTONE).alias("removed"), has(DOCUMENT).alias("materialised"), has(ARCHIVE).alias("has_npz"), has(MANIFEST).alias("has_manifest"),
        has("job.job-meta.json").alias("has_meta"), at(MANIFEST).alias("manifest_s"), at(ARCHIVE).alias("npz_s"), at(TOUCH).alias("touch_s"),
        F.count_if(F.col("part") != TOMBSTONE).alias("files"))


def route_plan(listing: DataFrame, shaped: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Route of every lesson with an export manifest, or why it is skipped."""
    f = listing_flags(listing).filter("has_manifest")
    f = f.join(shaped.select("clip_id", F.lit(True).alias("_shaped")), "clip_id", "left").join(
        quarantined.select("clip_id", F.lit(True).alias("_q")), "clip_id", "left")
    known = F.coalesce("_shaped", F.lit(False)) | F.col("has_meta")
    route = (F.when(F.col("removed") & F.coalesce("_q", F.lit(False)), "skip: removed (quarantined)").when(F.col("removed"), "skip: removed")
             .when(F.col("has_npz") & known, "reexport").when(F.col("has_npz"), "skip: eval clip, surface already standard, npz kept")
             .when(F.col("materialised"), "swap").otherwise("skip: no npz and no stored MotionResult"))
    return f.select("clip_id", route.alias("route"))


def live_set(listing: DataFrame) -> DataFrame:
    """Clips with a document or an archive, minus removed ones, as set algebra on the owner table."""
    own = owned(listing)
    of = lambda p: own.filter(F.col("part") == p).select("clip_id")
    return of(DOCUMENT).union(of(ARCHIVE)).distinct().join(of(TOMBSTONE), "clip_id", "left_anti")


def reap_set(listing: DataFrame, expired: DataFrame) -> DataFrame:
    """Archives whose document exists, minus removed and expired clips."""
    own = owned(listing)
    of = lambda p: own.filter(F.col("part") == p).select("clip_id")
    return of(ARCHIVE).intersect(of(DOCUMENT)).join(of(TOMBSTONE), "clip_id", "left_anti").join(expired.select("clip_id"), "clip_id", "left_anti")


def sweep(listing: DataFrame, uploads: DataFrame, now_s: Column, dry_run: bool = False) -> DataFrame:
    """The day's actions: expire, reap_npz, resweep, keep. One grouped pass over the listing.

    A lesson's clock starts at its touch file, else its manifest, else its archive, else now.
    """
    f = listing_flags(listing.select("path", "mtime_s"))
    video = owned(uploads).filter(F.col("part") == "mp4").select("clip_id", F.lit(True).alias("_video")).distinct()
    f = f.join(video, "clip_id", "left")
    opened = F.coalesce("touch_s", "manifest_s", "npz_s", now_s)
    live = (F.col("materialised") | F.col("has_npz")) & ~F.col("removed")
    expired = live & J.is_expired(opened, now_s)
    action = F.array_compact(F.array(
        F.when(expired, "expire"), F.when(live & ~expired & F.col("has_npz") & F.col("materialised"), "reap_npz"),
        F.when(F.col("removed") & ((F.col("files") > 0) | F.coalesce("_video", F.lit(False))), "resweep"),
        F.when(live & ~expired, "keep")))
    age = F.bround((now_s - opened) / 86400, 1)
    return f.select("clip_id", F.explode(action).alias("action"), age.alias("age_days"), F.lit(dry_run).alias("dry_run"))


def deletion_plan(targets: DataFrame, results: DataFrame, uploads: DataFrame, objects: DataFrame, jobs: DataFrame,
                  index: DataFrame) -> DataFrame:
    """Every stored thing of the targeted clips as (clip_id, store, item); tombstones stay.

    The targets are the small side: their ids are hashed and the stores stream past them, where a merge
    would have each task sort its share of every store.
    """
    t = targets.select("clip_id").distinct()
    pick = lambda df, store, item: df.select("clip_id", F.lit(store).alias("store"), F.col(item).cast("string").alias("item")).join(t.hint("shuffle_hash"), "clip_id", "left_semi")
    return (pick(owned(results).filter(F.col("part") != TOMBSTONE), "results", "path")
            .unionByName(pick(owned(uploads).filter(F.col("part") == "mp4"), "uploads", "path"))
            .unionByName(pick(object_owner(objects), "objects", "key"))
            .unionByName(pick(jobs, "jobs", "job_id")).unionByName(pick(index, "index", "entry_id")))


def without_planned(table: DataFrame, plan: DataFrame, store: str, item: str) -> DataFrame:
    """Next snapshot of a table: the rows the plan does not delete."""
    gone = plan.filter(F.col("store") == store).select(F.col("item").alias("_item")).distinct()
    return table.join(gone, F.col(item).cast("string") == F.col("_item"), "left_anti")


def quarantine_plan(targets: DataFrame, files: DataFrame, kept: DataFrame) -> DataFrame:
    """Files to copy before deletion: (clip_id, source, dest, sha256).

    ``files``: clip_id, source, sha256. ``kept`` holds earlier copies (clip_id, source,
    path, sha256): the same bytes are skipped, other bytes under a taken name get a suffix.
    """
    todo = files.join(targets.select("clip_id"), "clip_id", "left_semi").join(
        kept.select("clip_id", "source", "sha256"), ["clip_id", "source", "sha256"], "left_anti")
    dest = F.concat(F.lit("/"), F.col("clip_id"), F.lit("/"), F.regexp_replace("source", ":/?", "/"))
    taken = kept.select(F.col("path").alias("dest"), F.lit(True).alias("_taken")).distinct()
    named = todo.withColumn("dest", dest).join(taken, "dest", "left")
    return named.select("clip_id", "source", F.when(F.col("_taken"), F.concat(F.col("dest"), F.lit("."), F.substring("sha256", 1, 12))).otherwise(
        F.col("dest")).alias("dest"), "sha256")


def verified(plan: DataFrame, copies: DataFrame) -> DataFrame:
    """Planned copies with whether the bytes that landed match; only true ones may lose their original."""
    return plan.join(copies.select("dest", F.col("sha256").alias("_got")), "dest", "left").withColumn(
        "verified", F.coalesce(F.col("_got") == F.col("sha256"), F.lit(False))).drop("_got")


def purgeable(manifests: DataFrame, now_s: Column) -> DataFrame:
    """Quarantined items whose preservation time is over, oldest first."""
    return manifests.filter(now_s >= F.col("quarantined_at") + PRESERVE_DAYS * 86400).orderBy("quarantined_at")


def new_fingerprints(index: DataFrame, files: DataFrame, known: DataFrame) -> DataFrame:
    """Blocklist entries to add: index entries and the source videos' own hashes, minus what it has."""
    return index.select("clip_id", "sha256").union(files.select("clip_id", "sha256")).distinct().exceptAll(known.select("clip_id", "sha256").distinct())


def write_tombstones(existing: DataFrame, removals: DataFrame) -> DataFrame:
    """Tombstones to append; an existing one is never rewritten, the earliest new one wins."""
    return removals.join(existing.select("clip_id"), "clip_id", "left_anti").groupBy("clip_id").agg(
        F.min_by(F.struct("reason", "removed_at"), "removed_at").alias("_r")).select("clip_id", "_r.*")
