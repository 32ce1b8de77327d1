"""Registry of queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the DuckDB statement with the same columns."""
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver events with UTC timestamps, seconds and the JSON prop ``k``."""
    return (table(spark, sf_dir, "events")
            .withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("t", F.unix_micros("ts") / F.lit(1e6))
            .withColumn("k", F.get_json_object("props", "$.k").cast("bigint")))


# The same view for DuckDB.
EV = """ev AS (SELECT event_id, ts, epoch_us(ts) / 1e6 AS t, user_id, event_type, value, props,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver events dressed as the product's event log: name, job_id, visitor, props JSON.

    The driver's five types stand in for log names, ``k`` decides the variants.
    """
    e = events(spark, sf_dir)
    k, kind = F.col("k"), F.col("event_type")
    name = (F.when(kind == "signup", "job_created").when(kind == "error", "job_finished")
            .when((kind == "click") & (k % 4 != 3), "loop_created").when(kind == "click", "tap_on_one")
            .when((kind == "view") & (k < 90), "lesson_opened").when(kind == "view", "dispatch")
            .when(k < 95, "play_seconds").otherwise("removal"))
    n = F.col("name")

    def only(which: str, value) -> F.Column:
        return F.when(n == which, value)

    failed = only("job_finished", k >= 60)
    props = F.to_json(F.struct(
        F.when(n == "job_created", k % 5 == 0).alias("deduplicated"),
        F.when(n.isin("job_created", "play_seconds"), 1 + k % 30).alias("seconds"),
        only("job_finished", F.when(k < 60, "succeeded").otherwise("failed")).alias("state"),
        F.when(failed & (k % 3 == 0), "export_error").when(failed & (k % 3 == 1), "fetch_failed").alias("error_code"),
        only("job_finished", k % 3).alias("retry_count"),
        only("loop_created", F.element_at(F.array(*map(F.lit, ("drag", "count", "marker"))), (k % 3 + 1).cast("int"))).alias("via"),
        only("loop_created", k % 2 == 0).alias("snapped"),
        only("loop_created", (k % 8 + 0.5).cast("double")).alias("counts"),
        only("lesson_opened", F.when(k % 3 == 0, "").otherwise(
            F.concat(F.lit("site"), (k % 7).cast("string"), F.lit(".example.com")))).alias("ref")))
    return (e.withColumn("name", name).withColumn("props", props)
            .withColumn("job_id", F.concat(F.lit("job_"), (k % 20).cast("string")))
            .select(F.col("event_id").alias("id"), F.col("ts").alias("occurred_at"), "t", "name", "job_id",
                    F.col("user_id").cast("string").alias("visitor"), "props", "value", "k"))


LOG = EV + """, log AS (SELECT event_id AS id, ts AS occurred_at, t, k, value, CAST(user_id AS VARCHAR) AS visitor,
  'job_' || (k % 20) AS job_id, CAST(ts AS DATE) AS d,
  CASE WHEN event_type = 'signup' THEN 'job_created' WHEN event_type = 'error' THEN 'job_finished'
    WHEN event_type = 'click' AND k % 4 <> 3 THEN 'loop_created' WHEN event_type = 'click' THEN 'tap_on_one'
    WHEN event_type = 'view' AND k < 90 THEN 'lesson_opened' WHEN event_type = 'view' THEN 'dispatch'
    WHEN k < 95 THEN 'play_seconds' ELSE 'removal' END AS name FROM ev),
logx AS (SELECT *, name = 'job_created' AND k % 5 = 0 AS dedup, CASE WHEN k < 60 THEN 'succeeded' ELSE 'failed' END AS state,
  CASE WHEN k >= 60 AND k % 3 = 0 THEN 'export_error' WHEN k >= 60 AND k % 3 = 1 THEN 'fetch_failed' END AS error_code FROM log)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of 64 cells with their two hash words."""
    from ..functions import hashes
    cells = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", "embedding", hashes.ahash(cells).alias("aword"), hashes.ring_dhash(cells).alias("dword"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an upload, a re-encode of it with a few cells turned over, and some byte copies."""
    e = table(spark, sf_dir, "embeddings").withColumn("kind", F.explode(F.when(
        F.col("vec_id") % 10 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))))
    turned = F.transform("embedding", lambda x, i: F.when((i + F.col("vec_id")) % 21 == 0, -x).otherwise(x))
    from ..functions import hashes
    cells = F.when(F.col("kind") == 1, turned).otherwise(F.col("embedding"))
    e = e.withColumn("cells", cells)
    return e.select((F.col("vec_id") * 4 + F.col("kind")).alias("vec_id"), F.lit(None).cast("string").alias("sha256"),
                    (F.col("label") * 0.125 + F.when(F.col("kind") == 1, 0.25).otherwise(0.0)).alias("duration_s"),
                    F.array(hashes.ahash(F.col("cells"))).alias("ahash"), F.array(hashes.ring_dhash(F.col("cells"))).alias("dhash"))


def _bits(source: str) -> str:
    return f"""SELECT *, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) > list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE))) / 64 THEN '1' ELSE '0' END), '') AS BIT) AS abits,
  CAST(array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN embedding[(i + 1) % 64 + 1] > embedding[i + 1] THEN '1' ELSE '0' END), '') AS BIT) AS dbits
  FROM {source}"""


VEC = f"vec AS ({_bits('embeddings')})"
UPL = f"""raw AS (SELECT vec_id, label, kind, CASE WHEN kind = 1 THEN list_transform(range(0, 64), lambda i: CASE WHEN (i + vec_id) % 21 = 0 THEN -embedding[i + 1] ELSE embedding[i + 1] END) ELSE embedding END AS embedding
    FROM embeddings, range(0, 3) r(kind) WHERE kind < 2 OR vec_id % 10 = 0),
  bit AS ({_bits('raw')}), vec AS (SELECT vec_id * 4 + kind AS vec_id, label * 0.125 + CASE WHEN kind = 1 THEN 0.25 ELSE 0 END AS dur, abits, dbits FROM bit)"""
