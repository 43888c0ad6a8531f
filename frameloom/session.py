"""Sessions and tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "frameloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and Arrow transfer; ``conf`` overrides.

    ``requireAllClusterKeysForCoPartition=false`` lets a window over (frame, y) reuse the
    partitioning that a join on (frame, y, x) made, which saves an exchange per row-local step.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. The path goes to Spark's reader as it is, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's URI that the driver and all executors reach, under the session's checkpoint folder. Only a local
    session, which has one machine, may leave that out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
