"""Session construction and the shared staging area used to cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGING_KEY = "spark.checkpoint.dir"


def build_session(app_name: str = "discloscope", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator here relies on.

    On a cluster the caller supplies master and sizing; locally ``master`` may be given.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, as named by ``spark.checkpoint.dir``.

    A machine-local folder is used only with a local master, where driver and
    executors are the same process.
    """
    shared = spark.conf.get(_STAGING_KEY, None)
    if shared:
        return shared
    master = spark.conf.get("spark.master", "local")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set {_STAGING_KEY} to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="discloscope-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set(_STAGING_KEY, local)
    return local


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the staging area and read it back.

    Cuts lineage in a way that survives the loss of executors, and the re-read is
    a Parquet scan, so later steps still prune columns and push filters.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
