"""The dispatch limiter over a stream: each batch is replayed from what the batches before it accepted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import limits
from ..operators.events import GLOBAL_DAY, IP_DAY, IP_HOUR


def decide_limits(attempts: DataFrame, out: str, checkpoint: str, address: str, t: str, tie: list[str], hour: int = IP_HOUR, day: int = IP_DAY, everybody: int = GLOBAL_DAY,
                  trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Write every attempt with its decision to ``out``; no key holds the state of the rule.

    The limits bound what is carried: the accepted attempts of a day, written beside the decisions under
    the number of their batch. A batch that runs again reads the same predecessor and writes the same
    folders anew, so nothing is counted twice. Times are those of arrival: a batch is not older than the
    one before it.
    """
    kept = T.StructType([attempts.schema[address], attempts.schema[t]])

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = spark.read.schema(kept).parquet(f"{out}/held/batch={number - 1}") if number else None
        done = limits.replay(rows, address, t, tie, hour, day, everybody, before)
        path = f"{out}/decisions/batch={number}"
        done.write.mode("overwrite").parquet(path)
        done = spark.read.schema(done.schema).parquet(path)
        accepted = done.where("accepted").select(address, t)
        accepted = accepted if before is None else accepted.unionByName(before)
        newest = done.agg(F.max(t).alias("newest"))
        held = accepted.join(F.broadcast(newest), F.col(t) > F.col("newest") - limits.DAY // 1_000_000)  # one row
        held.select(address, t).coalesce(1).write.mode("overwrite").parquet(f"{out}/held/batch={number}")

    return attempts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def limit_decisions(spark: SparkSession, attempts: T.StructType, out: str) -> DataFrame:
    """The attempts decided so far, with accepted, code and wait_s."""
    schema = T.StructType([*attempts.fields, T.StructField("accepted", T.BooleanType()), T.StructField("code", T.StringType()), T.StructField("wait_s", T.LongType())])
    return spark.read.schema(schema).parquet(f"{out}/decisions").drop("batch")
