"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators count on. Skewed join keys are split by AQE at run
# time; lookups are broadcast only when measured small (operators/sizing.py).
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def cluster_settings(cores: int) -> dict[str, str]:
    """Settings for a cluster: three shuffle partitions per core, which AQE merges where small."""
    return {**RECOMMENDED, "spark.sql.shuffle.partitions": str(3 * cores)}


def local_session(name: str, cores: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and bench runs."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        **RECOMMENDED,
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    may go without it; on a cluster a machine-local folder would be invisible
    to the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="netvigil-")
    return f"{base.rstrip('/')}/netvigil/{label}-{uuid.uuid4().hex}"
