"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, bytes_per_task: int = 1 << 20) -> DataFrame:
    """``df`` over all cores if it is so small that its files would occupy few of them; larger tables are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_per_task else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; columns are pruned by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
