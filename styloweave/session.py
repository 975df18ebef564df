"""Session helpers: checkpointing and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
PINNED_ROWS = 10_000


def local_session(app: str = "styloweave", cores: str = "8", partitions: int = 8,
                  **conf) -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.maxPartitionBytes", "4m")  # small inputs, all cores
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors see: `spark.checkpoint.dir`.

    Where the session names none, a local session gets a temporary folder; elsewhere executors
    could not see one, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/work/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Computed once into a compressed table of the shared folder, and read from there; for what is read often."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the rows of `df`, as JSON text, have at most `max_bytes`; else the join shuffles.

    The check is one aggregation over the table; nothing but its total reaches the driver.
    """
    size = df.select(F.length(F.to_json(F.struct(*df.columns))).alias("n")).agg(F.sum("n")).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def pinned(df: DataFrame, max_rows: int = PINNED_ROWS) -> DataFrame:
    """A derived table that is used again: computed once, its lineage cut.

    Up to `max_rows` rows become a broadcast local table; more are checkpointed and left to
    shuffle joins. At most `max_rows + 1` rows reach the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return checkpointed(df)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
