"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators depend on for correct results (UTC instants, ANSI
# arithmetic) or for scale (AQE re-planning, skew-join splitting).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # also where splitting a hot click_id costs the aggregate above it a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "revlens", extra: dict | None = None, driver_memory: str | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's session
    and call :func:`configure` on it."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    for k, v in {**REQUIRED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    Uses the directory the cluster names in ``spark.checkpoint.dir``. Only when that
    is unset *and* the master is local (tests, the bench) a fresh scratch folder is
    created; on a cluster an unset directory is an error, never a machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="revlens-ckpt-", dir=os.environ.get("REVLENS_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf
