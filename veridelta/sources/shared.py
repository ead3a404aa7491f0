"""A folder that driver and executors share, for results that must not be worked out twice."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Write below spark.checkpoint.dir and read back. Only where that is unset, as on one machine,
    a temporary folder is set. Shuffle files of the plan go as soon as nothing refers to it."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="veridelta-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/veridelta-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 200, size: int = 4 << 20) -> None:
    """Bound Arrow batches by rows and bytes, for the queries of this session that run from now on;
    smaller bounds stay."""
    for name, bound in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(key))[0]) <= bound:
            spark.conf.set(key, str(bound))


def give_back() -> None:
    """Return free memory of a Python worker to the machine: workers live on after their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
