"""Sinks. These are the only functions that start an action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import hashes

EVENT_COLUMNS = [f.name for f in schemas.EVENT_LOG.fields]


def as_log(rows: DataFrame) -> DataFrame:
    """Rows in event-log shape; columns they lack are null."""
    kinds = {f.name: f.dataType for f in schemas.EVENT_LOG.fields}
    have = set(rows.columns)
    return rows.select(*[F.col(n).cast(t) if n in have else F.lit(None).cast(t).alias(n) for n, t in kinds.items()])


def append_events(rows: DataFrame, path: str, files_per_day: int = 1) -> None:
    """Append accepted events partitioned by day.

    Rows are spread by (day, hash of id), so a busy day is written by several tasks.
    """
    log = as_log(rows).withColumn("day", F.to_date("occurred_at"))
    spread = log.repartition(F.col("day"), F.pmod(F.xxhash64("id"), F.lit(files_per_day)))
    spread.write.mode("append").partitionBy("day").parquet(path)


def job_created(jobs: DataFrame) -> DataFrame:
    """Server-side job_created events. ``jobs``: job_id, clip_id, day_hash, occurred_at, source, deduplicated, seconds."""
    props = F.to_json(F.struct("source", "deduplicated", F.bround("seconds", 2).alias("seconds")))
    return jobs.select("occurred_at", F.lit("job_created").alias("name"), "clip_id", "job_id", "day_hash", props.alias("props"))


def fold_old_days(spark: SparkSession, log_path: str, rolled_path: str, cutoff: str, dry_run: bool = False) -> int:
    """Roll up whole days before ``cutoff`` and drop their partitions; returns the rows folded.

    The roll-up is appended before anything is dropped, and exactly the files that
    were rolled up are dropped: a file that arrives in between stays for the next
    run. A crash in between is safe: the rerun's anti join adds nothing and the drop
    happens then.
    """
    from ..operators import events
    from .readers import event_log

    log = event_log(spark, log_path)
    old = log.filter(F.col("day") < F.lit(cutoff).cast("date"))
    n = old.count()
    if dry_run or n == 0:
        return n
    jvm = spark._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(rolled_path).getFileSystem(spark._jsc.hadoopConfiguration())
    existing = spark.read.schema(schemas.EVENT_DAILY).parquet(rolled_path) if fs.exists(fs_path(rolled_path)) else None
    rows = old.withColumn("visitor", F.hex("day_hash"))
    events.rollup(rows, F.lit(cutoff).cast("timestamp"), existing).write.mode("append").parquet(rolled_path)
    # The listing that ``old`` was read by, one name per file of the old days.
    for row in old.select("_metadata.file_path").distinct().toLocalIterator():
        fs.delete(fs_path(jvm.java.net.URI(row.file_path)), False)
    return n


def publish(versions: DataFrame, versions_path: str, pointer_path: str, key: str, data: str) -> None:
    """Write immutable versions first, then the pointer rows that name them."""
    named = versions.withColumn("version", hashes.content_version(F.col(data)))
    named.write.mode("append").parquet(versions_path)
    named.select(key, "version", F.current_timestamp().alias("at")).write.mode("append").parquet(pointer_path)


def latest_published(spark: SparkSession, versions_path: str, pointer_path: str, key: str) -> DataFrame:
    """The version each key's newest pointer names; a pointer never names a version that is not there."""
    last = spark.read.parquet(pointer_path).groupBy(key).agg(F.max_by("version", "at").alias("version"))
    return spark.read.parquet(versions_path).join(last, [key, "version"]).dropDuplicates([key])


def write_documents(docs: DataFrame, path: str) -> None:
    """Nested documents as gzip JSON lines."""
    docs.write.mode("overwrite").option("compression", "gzip").json(path)


def write_steps(steps: DataFrame, path: str) -> None:
    """Step rows as JSON, one object per step."""
    steps.write.mode("overwrite").json(path)


def record_dispatch(meta: DataFrame, path: str) -> None:
    """Append job -> clip mapping and credit at dispatch."""
    meta.select("job_id", "clip_id", "credit").write.mode("append").parquet(path)


def write_status(rows: DataFrame, path: str) -> None:
    """Status documents as text lines of JSON."""
    from ..operators.jobs import status_documents
    status_documents(rows).select(F.col("status").alias("value")).write.mode("overwrite").text(path)


def snapshot(table: DataFrame, path: str, partition: Column | None = None) -> None:
    """Write a new snapshot of a table; removals are rows it leaves out."""
    out = table if partition is None else table.withColumn("part", partition)
    writer = out.write.mode("overwrite")
    (writer.partitionBy("part") if partition is not None else writer).parquet(path)
