"""Exact deduplication as a stream over disk-backed keyed state.

State holds, per digest and without expiry, the smallest identifier, where its content lies (file and
row) and how many rows shared it. Hits are then checked byte for byte against the content that the
locator names; rows that only share a digest go through again under another digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Files of digests that one micro-batch takes.
FILES_PER_BATCH = 64
#: Digests with more than one row, up to which they may be broadcast to the scan that fetches contents.
BROADCAST_ROWS = 200_000
SIGNED = "doc_id long, digest string, text_sha256 string, file string, row long"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside in each
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, common.SPACES, " ")


def sha(text: Column, turn: int) -> Column:
    """The digest of a turn; turns after the first only see rows that collided before."""
    return F.sha2(text if not turn else F.concat(F.lit(f"{turn}\x1f"), text), 256)


def first_of() -> Column:
    """Order of rows of one digest: smallest id, nulls last, then place."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")


def keyed_state(spark: SparkSession, path: str, schema: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Fold the files under ``path`` into keyed state, micro-batch by micro-batch, until all are taken.

    Returns digest, first, n. The changed keys of each batch go to a folder of that batch, so a batch
    that is tried again overwrites its own output.
    """
    out = common.scratch(spark, "exact-classes")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        # The partial sums before the shuffle leave one row per digest and task: a hot digest is no hot task.
        state = stream.groupBy("digest").agg(F.min(first_of()).alias("first"), F.count(F.lit(1)).alias("n"))
        query = (state.writeStream.outputMode("update").option("checkpointLocation", common.scratch(spark, "exact-state"))
                 .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    shape = "digest string, first struct<none:boolean,doc_id:bigint,file:string,row:bigint>, n long"
    if not query.recentProgress or not any(p.numInputRows for p in query.recentProgress):
        return spark.createDataFrame([], shape)
    changed = spark.read.schema(shape).parquet(f"{out}/batch=*")
    # Counts only grow and the first row only falls: the last state of a digest has the largest count.
    return changed.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column, int], Column] = sha, files_per_batch: int = FILES_PER_BATCH,
            broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, file, row: one row per row of ``docs``.

    Null text is the empty text. Of equal texts the smallest doc_id stays; rows without an id come
    last; of rows with one id, exactly one stays, the first by place. No rows in, none out. Extra
    columns are not read.
    """
    spark = docs.sparkSession
    todo, done, turn = common.located(docs, id_col, text_col), None, 0
    while True:
        norm = normalised(F.col("text")) if not turn else F.col("text")
        rows = todo.select("doc_id", "file", "row", norm.alias("norm"))
        hashes = rows.select("doc_id", "norm", "file", "row", F.sha2("norm", 256).alias("text_sha256"))
        hashes = hashes.withColumn("digest", F.col("text_sha256") if digest is sha and not turn else digest(F.col("norm"), turn))
        path = common.scratch(spark, "exact-signed")
        hashes.select("doc_id", "digest", "text_sha256", "file", "row").write.parquet(path)
        signed = spark.read.schema(SIGNED).parquet(path)
        state = common.written(keyed_state(spark, path, SIGNED, files_per_batch), "exact-state-rows")
        wrong = common.written(_mismatched(hashes, state.where("n > 1"), broadcast_rows), "exact-mismatched")
        some = bool(wrong.take(1))
        if some:  # rows that share a digest and nothing else leave the class
            bad = wrong.select("file", "row", F.lit(True).alias("bad"))
            signed = signed.join(bad, ["file", "row"], "left_anti")
            state = state.join(wrong.groupBy("digest").agg(F.count(F.lit(1)).alias("less")), "digest", "left").select("digest", "first", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"))
        part = signed.join(state, "digest").select(
            "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("kept"),
            "text_sha256", "file", "row")
        done = part if done is None else done.unionAll(part)
        if not some:
            return done
        todo, turn = wrong.select("doc_id", "text", "file", "row"), turn + 1


def _mismatched(hashes: DataFrame, shared: DataFrame, broadcast_rows: int) -> DataFrame:
    """Rows of shared digests whose bytes differ from the content at the kept row's place."""
    keys = shared.select("digest", "first.file", "first.row").withColumnsRenamed({"file": "keep_file", "row": "keep_row"})
    if keys.count() <= broadcast_rows:
        keys = F.broadcast(keys)
    members = hashes.join(keys, "digest")
    kept = members.where("file = keep_file AND row = keep_row").select("digest", F.col("norm").alias("kept_norm"))
    rest = members.where("NOT (file = keep_file AND row = keep_row)")
    # Each hit meets the one kept content of its digest; adaptive execution splits a hot digest.
    return rest.join(kept, "digest").where("norm <> kept_norm").select("doc_id", F.col("norm").alias("text"), "file", "row", "digest")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. The locator is the join key, so repeated ids are no matter."""
    docs = common.backed(docs)
    return common.without(docs, classes(docs).where("NOT kept"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {"op5_exact_dedup": ORACLE}
