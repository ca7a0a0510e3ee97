"""Stored intermediate tables: typed clicks, click revenue, feature baseline.

The products these tables feed read them many times; they are written once per
application and input to the shared checkpoint folder and read back (narrow column
scans, no repeated JSON parse or interval join)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.session import checkpoint_dir

_paths: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table ``name`` of ``sf_dir``, written by ``build`` on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _paths:
        path = f"{checkpoint_dir(spark).rstrip('/')}/table-{name}-{uuid.uuid4().hex[:12]}"
        build().write.parquet(path)
        _paths[key] = path
    return spark.read.parquet(_paths[key])


def keyed(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], key: str = "click_id",
          buckets: int | None = None) -> DataFrame:
    """The stored table ``name`` of ``sf_dir`` with one row per ``key``, bucketed and sorted by
    it: a join or aggregation on the key moves no row of this side. (One row a key, so no
    bucket is hot; tables with many rows a key stay unbucketed, for the skew join to split.)"""
    ident = (spark.sparkContext.applicationId, sf_dir, f"keyed-{name}")
    if ident not in _paths:
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"{name}_{uuid.uuid4().hex[:12]}"
        path = f"{checkpoint_dir(spark).rstrip('/')}/keyed-{table}"
        # one file a bucket
        (build().repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table))
        _paths[ident] = table
    return spark.table(_paths[ident])
