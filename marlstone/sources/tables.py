"""Readers for the Parquet tables of a data folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage: a checkpoint, a local one where the session has no checkpoint folder."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def tidy(df: DataFrame) -> None:
    """Let Spark drop shuffle files of finished steps now: it notices only when the driver collects garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
