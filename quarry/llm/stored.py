"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.sources.ops import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again.  Like a checkpoint this cuts
    the lineage and survives lost executors; the files are compressed, and
    what a later step doesn't use of them isn't read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
