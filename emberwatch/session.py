"""Session settings, table loading and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Partition counts are left to the cluster: AQE
# coalesces small shuffles and splits skewed join partitions at run time.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Batches sent to Python are bounded by bytes: ten thousand long texts are many times what a worker should hold.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


def build_session(app: str = "emberwatch", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Make a session created elsewhere usable: event time is UTC throughout."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table stored in fewer pieces than there are cores, dealt out by `key`; others are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="emberwatch-ckpt-"))
    else:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder all executors share before running iterative operators"
        )


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder under the checkpoint folder, which all executors share."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing a table to the checkpoint folder and reading it back.

    A lost executor costs a re-read, not a re-run. Unlike a row checkpoint, the
    table keeps its columns apart, so later steps read only what they use, and the
    planner knows its size when it chooses between join strategies.
    """
    path = scratch_path(df.sparkSession, "frame")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
