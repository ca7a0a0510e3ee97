"""S1 read_table: declared source tables by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.schemas import DRIVER_TABLES


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def utc_timestamps(df: DataFrame) -> DataFrame:
    """Driver parquet stores wall-clock TIMESTAMP_NTZ; every operator works on UTC
    instants, so NTZ columns are reinterpreted in the (UTC) session zone."""
    cols = [F.col(f.name).cast("timestamp").alias(f.name)
            if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Read one declared table with its declared schema: no footer is opened to plan the read, a
    file that lacks a column gives nulls, columns that are not declared are not read. Column
    pruning is explicit so the parquet scan's ReadSchema carries only what the caller needs."""
    if name not in DRIVER_TABLES:
        raise ValueError(f"table {name} is not declared")
    df = spark.read.schema(DRIVER_TABLES[name]).parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return utc_timestamps(df)
