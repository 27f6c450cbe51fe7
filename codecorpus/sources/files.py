"""Versioned file tables.

A version is one folder of Parquet files sorted by (repo_id, path): a repo's
files lie together, so row-group statistics prune a repo's read; a hot repo is
split by path; the number of files follows the data, not the number of repos;
and columns keep their types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_files(df: DataFrame, table_dir: str, version: int) -> str:
    """Write a file table as version ``version`` (overwrite = idempotent on retry)."""
    out = f"{table_dir}/version={version}"
    key = ["repo_id", "path"]
    df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(out)
    return out


def read_version(spark: SparkSession, table_dir: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{table_dir}/version={version}")
