"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits skewed join partitions and coalesces small ones; UTC
# makes every day cut the one the reference's salts and roll-ups use.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "256k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "tempofold", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local master, where
    driver and executors are one process, may go without: a cluster that names
    none is refused. Blocks written there outlive a lost executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="tempofold-checkpoint-")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path beside the checkpoints, in the folder that every executor shares; local masters may use their own disk."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.gettempdir()}/tempofold-scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a new table in the shared folder: lineage ends there, and a lost executor costs one task."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
