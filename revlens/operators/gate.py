"""C1 as a gate: a table is published only if its assertions hold.

The candidate is written once, to a folder of its own; the row assertions are evaluated and
counted in that pass (observed metrics), rows that fail are kept apart. Uniqueness is
checked on the written keys. Only then a row naming the folder is appended to the table's
list of publications; readers take the newest. On a failure no row is appended, so the
target stays as it was, and the failing rows lie in the quarantine with the names of what
they fail."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST = "_published"


@dataclass
class Publication:
    published: bool
    rows: int
    failed: dict[str, int] = field(default_factory=dict)      # assertion -> rows that fail it


def publish(df: DataFrame, path: str, rows: dict[str, str], unique: dict[str, list[str]] | None = None, quarantine: str | None = None) -> Publication:
    """Publish ``df`` as the new content of the table at ``path`` if every row meets the SQL
    conditions ``rows`` (name -> condition; null is a failure) and the key columns
    ``unique`` (name -> columns) do not repeat. Else its failing rows are appended to
    ``quarantine`` (default: ``path``/_quarantine) with the column ``failed``."""
    if {"ok", "failed"} & set(df.columns):
        raise ValueError("the columns ok and failed are the gate's own")
    spark, path = df.sparkSession, path.rstrip("/")
    run = uuid.uuid4().hex[:12]
    folder = f"{path}/data-{run}"
    names = list(rows)
    failing = {n: ~F.coalesce(F.expr(rows[n]), F.lit(False)) for n in names}
    tags = F.array_compact(F.array(*[F.when(failing[n], F.lit(n)) for n in names])) if names else F.array().cast("array<string>")
    seen = Observation(f"gate-{run}")
    tagged = df.withColumn("failed", tags).withColumn("ok", F.size("failed") == 0)
    counts = [F.count_if(F.array_contains("failed", n)).alias(f"n{i}") for i, n in enumerate(names)]
    tagged.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.partitionBy("ok").parquet(folder)
    metrics = seen.get
    failed = {n: metrics[f"n{i}"] for i, n in enumerate(names) if metrics[f"n{i}"]}
    written = spark.read.schema(tagged.schema).parquet(folder)
    bad = [written.where("NOT ok").drop("ok")] if failed else []
    for name, keys in (unique or {}).items():
        again = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        total = again.agg(F.sum("_n")).first()[0]
        if total:
            failed[name] = total
            # null-safe: a null key repeats too
            k = again.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(keys)])
            same = F.lit(True)
            for i, c in enumerate(keys):
                same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
            bad.append(written.join(k, same, "left_semi").withColumn("failed", F.array(F.lit(name))).drop("ok"))
    if failed:
        out = bad[0]
        for b in bad[1:]:
            out = out.unionByName(b)
        out.withColumn("run", F.lit(run)).write.mode("append").parquet((quarantine or f"{path}/_quarantine").rstrip("/"))
        return Publication(False, metrics["rows"], failed)
    version = (newest_version(spark, path) or 0) + 1
    spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(folder).alias("folder"), F.lit(df.schema.json()).alias("schema")).coalesce(1).write.mode("append").parquet(f"{path}/{LIST}")
    return Publication(True, metrics["rows"])


def _listed(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{LIST}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema("version long, folder string, schema string").parquet(f"{path.rstrip('/')}/{LIST}")


def newest_version(spark: SparkSession, path: str) -> int | None:
    listed = _listed(spark, path)
    return None if listed is None else listed.agg(F.max("version")).first()[0]


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table's published content."""
    listed = _listed(spark, path)
    if listed is None:
        raise ValueError(f"nothing is published at {path}")
    newest = listed.agg(F.max_by(F.struct("folder", "schema"), "version")).first()[0]
    # with its schema: a table without rows has no file
    schema = T.StructType.fromJson(json.loads(newest.schema))
    return spark.read.schema(schema).parquet(newest.folder).select(*schema.names)
