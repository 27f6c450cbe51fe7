"""Session helpers: one place for the Spark settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job assumes. AQE re-plans joins and coalesces small
# shuffle partitions at runtime; skew-join splitting handles hot repos.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages and files are wide rows: keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, app: str = "codecorpus",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions",
                 str(shuffle_partitions or (cores if str(cores).isdigit() else 8)))
    b = b.config("spark.driver.memory", "8g")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is. Only a local session without it (tests) gets a fresh scratch
    folder; elsewhere each machine would write to a folder of its own.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cur = tempfile.mkdtemp(prefix="codecorpus-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    spark.sparkContext.setCheckpointDir(cur)
    return cur


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir (stream state, staged tables)."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores before a costly step, where the input has
    fewer partitions than there are cores (a small table in one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table under the shared checkpoint folder and read
    back: what several later steps need is computed once and survives lost executors."""
    path = checkpoint_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
