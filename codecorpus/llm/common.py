"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.session import ensure_checkpoint_dir

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: ``bytes.split()`` without arguments cuts at exactly these six bytes.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor repeats the tasks of one step, not the
    steps before it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps already written.

    Shuffle files go when the driver collects the frames that made them; a
    job that writes a table after each step need not hold all of them.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def in_fold(doc_id: str | Column, modulus: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is 0; false for null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == 0, F.lit(False))


def labelled(labels: DataFrame, target: str, fold: int) -> DataFrame:
    """Usable labels of the training fold: one (doc_id, y) a document.

    Null ids and labels other than 0 and 1 are left out; a document labelled
    more than once takes its largest label.
    """
    return (labels.select("doc_id", F.col(target).cast("int").alias("y"))
            .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~in_fold("doc_id", fold))
            .groupBy("doc_id").agg(F.max("y").alias("y")))


def class_counts(lab: DataFrame) -> dict[int, int]:
    """Number of labels of each class (two rows)."""
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return {0: n.get(0, 0), 1: n.get(1, 0)}


def bounded_sample(lab: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` labels of each class, the same ones on every run."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return (lab.where("y = 0").orderBy(*order).limit(per_class)
            .unionByName(lab.where("y = 1").orderBy(*order).limit(per_class)))
