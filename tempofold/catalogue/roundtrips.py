"""Sources, sinks and streams: driver tables written through them and read back, compared with what SQL says they hold."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from ..operators import events as ev
from ..session import scratch
from ..sources import readers, sinks
from ..streaming import events as se
from .base import EV, LOG, event_log, events, query, table

STORE = "spark.sql.streaming.stateStore.providerClass"


def _fed(df: DataFrame, name: str, schema: str | None = None) -> DataFrame:
    """A stream over the rows of ``df``, by way of files."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.readStream.schema(schema or df.schema).parquet(path)


def _drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything the stream gives until its source is read, as a table; a batch that is tried again overwrites its own folder."""
    spark = stream.sparkSession
    out, before = scratch(spark, name), spark.conf.get(STORE, None)
    se.use_rocksdb(spark)
    try:
        query = (stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, f"{name}-state"))
                 .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


@query("event_log_append", f"WITH {LOG} SELECT CAST(d AS VARCHAR) AS day, name, count(*) AS n FROM logx GROUP BY 1, 2")
def event_log_append(spark, d):
    """The log appended in two halves, by day, and read back with its partition column."""
    path = scratch(spark, "event-log")
    for half in (0, 1):
        sinks.append_events(event_log(spark, d).filter(F.col("id") % 2 == half), path, files_per_day=2)
    return readers.event_log(spark, path).groupBy(F.col("day").cast("string").alias("day"), "name").agg(F.count("*").alias("n"))


@query("job_created_rows", f"""WITH {EV} SELECT event_id, 'job_created' AS name, 'job_' || (k % 20) AS job_id, k % 5 = 0 AS deduplicated, round(round_even(value, 2), 2) AS seconds, 'upload' AS source
  FROM ev WHERE event_type = 'signup'""")
def job_created_rows(spark, d):
    e = events(spark, d).filter("event_type = 'signup'")
    jobs = e.select(F.concat(F.lit("job_"), (F.col("k") % 20).cast("string")).alias("job_id"), F.col("event_id").cast("string").alias("clip_id"), F.lit(None).cast("binary").alias("day_hash"),
                    F.col("ts").alias("occurred_at"), F.lit("upload").alias("source"), (F.col("k") % 5 == 0).alias("deduplicated"), F.col("value").alias("seconds"))
    path = scratch(spark, "job-created")
    sinks.append_events(sinks.job_created(jobs), path)
    back = readers.event_log(spark, path)
    return back.select(F.col("clip_id").cast("bigint").alias("event_id"), "name", "job_id", F.get_json_object("props", "$.deduplicated").cast("boolean").alias("deduplicated"),
                       F.round(F.get_json_object("props", "$.seconds").cast("double"), 2).alias("seconds"), F.get_json_object("props", "$.source").alias("source"))


@query("gate_results", "SELECT vec_id, label < 3 AS accept, CASE WHEN label >= 3 THEN 'label' || label END AS reason, round(CAST(embedding[1] AS DOUBLE), 4) AS dance FROM embeddings")
def gate_results(spark, d):
    """Gate results as JSON lines, one per vector."""
    path, ok = scratch(spark, "gate-results"), F.col("label") < 3
    score = F.col("embedding")[0].cast("double")
    table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("clip"), ok.alias("accept"), F.when(ok, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.concat(F.lit("label"), F.col("label").cast("string")))).alias("reasons"),
        F.struct(score.alias("dance")).alias("scores")).write.json(path)
    r = readers.gate_results(spark, path)
    return r.select(F.col("clip").cast("bigint").alias("vec_id"), "accept", F.get("reasons", F.lit(0)).alias("reason"), F.round("scores.dance", 4).alias("dance"))


@query("manifest_tests", """SELECT test, count(*) AS clips FROM (SELECT page_id, unnest(list_filter([CASE WHEN page_id % 2 = 0 THEN 'timing' END, CASE WHEN length(html) > 3000 THEN 'long' END, 'all'], lambda x: x IS NOT NULL)) AS test FROM pages) GROUP BY 1""")
def manifest_tests(spark, d):
    """Pages as an evaluation manifest of JSON lines, and clips per test."""
    path = scratch(spark, "manifest")
    tests = F.array_compact(F.array(F.when(F.col("page_id") % 2 == 0, "timing"), F.when(F.length("html") > 3000, "long"), F.lit("all")))
    table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), "url", tests.alias("tests")).write.json(path)
    return readers.manifest_tests(readers.clip_manifest(spark, path))


@query("quarantined_clips", "SELECT doc_id, n_chars < 1000 AS quarantined FROM documents")
def quarantined_clips(spark, d):
    """Documents as clips; short ones have no video stream."""
    clips = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") >= 1000, F.col("n_chars")).alias("stream_width"))
    good, bad = readers.probe_quarantine(clips)
    return good.select("doc_id", F.lit(False).alias("quarantined")).unionByName(bad.select("doc_id", F.lit(True).alias("quarantined")))


@query("published_versions", "SELECT doc_id, substr(sha256(text), 1, 12) AS version FROM documents")
def published_versions(spark, d):
    """Each document published twice, first in lower case; the pointer names the later one."""
    versions, pointer = scratch(spark, "versions"), scratch(spark, "pointer")
    docs = table(spark, d, "documents").select("doc_id", "text")
    for rows in (docs.withColumn("text", F.concat(F.lower("text"), F.lit("."))), docs):
        sinks.publish(rows, versions, pointer, "doc_id", "text")
    return sinks.latest_published(spark, versions, pointer, "doc_id").select("doc_id", "version")


@query("step_rows", "SELECT l_suppkey AS lesson, l_linenumber AS step, count(*) AS samples, round(sum(l_quantity), 2) AS path_m FROM lineitem GROUP BY 1, 2")
def step_rows(spark, d):
    """A step table written as JSON objects and read back."""
    path = scratch(spark, "steps")
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("lesson"), F.col("l_linenumber").alias("step")).agg(F.count("*").alias("samples"), F.round(F.sum("l_quantity"), 2).alias("path_m"))
    sinks.write_steps(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("dispatch_records", "SELECT o_orderkey AS job_id, o_custkey AS clip_id, o_orderpriority AS credit FROM orders")
def dispatch_records(spark, d):
    """Dispatches appended in two halves; every job keeps its clip and credit."""
    path = scratch(spark, "dispatch")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("clip_id"), F.col("o_orderpriority").alias("credit"))
    for half in (0, 1):
        sinks.record_dispatch(o.filter(F.col("job_id") % 2 == half), path)
    return spark.read.schema(o.schema).parquet(path)


@query("salt_rotation", f"""WITH {EV}, x AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM ev), t AS (SELECT max(d) - 3 AS today FROM x)
  SELECT CAST(d AS VARCHAR) AS day, 32 AS bytes, user_old AS kept FROM (SELECT d, dayofmonth(d) % 2 = 0 AS user_old FROM x) CROSS JOIN t WHERE d >= today""")
def salt_rotation(spark, d):
    """Days of even date have a salt; days before the last four are dropped, the rest get a random one each."""
    days = events(spark, d).select(F.to_date("ts").alias("day")).distinct()
    have = days.filter(F.dayofmonth("day") % 2 == 0).withColumn("salt", F.unhex(F.sha2(F.col("day").cast("string"), 256)))
    today = days.agg((F.max("day") - F.expr("interval 3 days")).cast("date"))
    out = ev.rotate_salts(have, days, today.scalar())
    return out.select(F.col("day").cast("string").alias("day"), F.octet_length("salt").alias("bytes"), (F.col("salt") == F.unhex(F.sha2(F.col("day").cast("string"), 256))).alias("kept"))


INGEST = f"""WITH {EV}, b AS (SELECT *, k % 4 AS m FROM ev)
  SELECT event_id, CASE m WHEN 0 THEN 'tap_on_one' ELSE 'play_seconds' END AS name, CAST(ts AS DATE)::VARCHAR AS day FROM b WHERE m = 0 OR (m = 1 AND k BETWEEN 1 AND 30)"""


@query("stream_ingest", INGEST)
def stream_ingest(spark, d):
    """Client bodies as a stream of JSON lines: validated, hashed by the day's salt, appended to the log by day."""
    e, m = events(spark, d), F.col("k") % 4
    item = (F.when(m == 0, F.lit('{"name":"tap_on_one","lesson":"L')).when(m == 1, F.concat(F.lit('{"name":"play_seconds","props":{"seconds":'), F.col("k").cast("string"), F.lit('},"lesson":"L')))
            .otherwise(F.lit('{"name":"nothing","lesson":"L')))
    bodies = e.select(F.concat(F.lit("["), item, F.col("event_id").cast("string"), F.lit('"}]')).alias("body"), F.lit("agent").alias("user_agent"), F.lit("10.0.0.1").alias("ip"), F.col("ts").alias("received_at"))
    path, log = scratch(spark, "bodies"), scratch(spark, "stream-log")
    bodies.write.json(path)
    salts = e.select(F.to_date("ts").alias("day")).distinct().withColumn("salt", F.unhex(F.sha2(F.col("day").cast("string"), 256)))
    rows = se.ingest(se.client_batches(spark, path), salts)
    se.append_log(rows, log, scratch(spark, "stream-log-state"), {"availableNow": True}).awaitTermination()
    back = readers.event_log(spark, log).filter(F.octet_length("day_hash") == 32)
    return back.select(F.substring("job_id", 2, 40).cast("bigint").alias("event_id"), "name", F.col("day").cast("string").alias("day"))


@query("stream_capped", f"WITH {LOG} SELECT visitor, CAST(d AS VARCHAR) AS day, least(count(*), 3) AS n FROM logx GROUP BY 1, 2")
def stream_capped(spark, d):
    rows = se.capped(_fed(event_log(spark, d).select("visitor", "id", "occurred_at"), "cap-in"), 3, lateness="60 days")
    return _drained(rows, "cap").groupBy("visitor", F.to_date("occurred_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("stream_daily_counts", f"WITH {LOG} SELECT CAST(d AS VARCHAR) AS day, name, count(*) AS n FROM logx WHERE epoch(d) + 86400 <= (SELECT max(t) FROM logx) - 86400 GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    """Only days that the watermark has closed come out."""
    out = _drained(se.daily_counts(_fed(event_log(spark, d).select("name", "occurred_at"), "daily-in")), "daily")
    return out.select(F.col("day").cast("string").alias("day"), "name", "n")


@query("stream_finished_once", f"WITH {LOG} SELECT DISTINCT job_id, k % 3 AS retry_count FROM logx WHERE name = 'job_finished'")
def stream_finished_once(spark, d):
    done = event_log(spark, d).filter("name = 'job_finished'").select("job_id", (F.col("k") % 3).alias("retry_count"), "occurred_at")
    return _drained(se.finished_once(_fed(done, "finish-in"), "60 days"), "finish").select("job_id", "retry_count")


@query("stream_latest_status", "SELECT o_custkey AS job_id, max(o_orderkey % 3) AS retry_count, epoch(max(o_orderdate) FILTER (WHERE r = 1))::BIGINT AS at FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 DESC) AS r FROM orders) GROUP BY 1")
def stream_latest_status(spark, d):
    """A customer's orders as attempts at one job; the newest of the highest attempt stands."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), (F.col("o_orderkey") % 3).alias("retry_count"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    out = _drained(se.latest_status(_fed(rows, "status-in")), "status", "update")
    best = out.groupBy("job_id").agg(F.max(F.struct("retry_count", "updated_at")).alias("b"))
    return best.select("job_id", "b.retry_count", F.unix_seconds("b.updated_at").alias("at"))


@query("stream_live_rows", "SELECT l_orderkey AS clip_id, count(*) AS n FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1")
def stream_live_rows(spark, d):
    """Rows of removed orders never reach the table, however late they arrive."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip_id"), "l_linenumber")
    gone = table(spark, d, "orders").filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("clip_id"))
    path = scratch(spark, "live")
    se.append_live(_fed(rows, "live-in"), lambda: gone, path, scratch(spark, "live-state"), trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).groupBy("clip_id").agg(F.count("*").alias("n"))
