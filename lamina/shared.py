"""The folder that all executors share, and tables kept there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a folder of our own."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or (held.get() if held.isDefined() else None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lamina-")
    if not held.isDefined():
        sc.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once; plans that use it don't contain its own, and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new mounted path in the shared folder."""
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    elif "://" in base:
        raise ValueError(f"this needs a mounted folder, not {base}")
    return f"{base}/{kind}-{uuid.uuid4().hex}"


#: Bytes of rows that Python gets at a time, in place of Spark's 64 MB; one row may be longer.
ARROW_BYTES = 4 << 20


def small_arrow_batches(df: DataFrame) -> DataFrame:
    """df, whose session now passes ARROW_BYTES at a time to Python unless it was set otherwise: ten thousand long values take hundreds of MB."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, str(ARROW_BYTES))
    return df
