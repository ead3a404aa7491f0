"""Helpers shared by the operators: tables, shared folders, tokens and hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What one Arrow batch carries to Python at most: rows, and bytes where texts are long.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes, for the queries of this session that run from now on
    (Spark reads both settings when a query runs, so they can't be restored here). Smaller bounds stay."""
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if not 0 < now <= bound:
            spark.conf.set(key, str(bound))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns, whatever their names, are not read."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: What the operator at work keeps in this Python worker between tasks.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """State that an operator keeps in a reused Python worker (caches, machines): one operator's at
    a time. A worker that turns to another operator drops it and returns the memory."""
    state = _kept.get(owner)
    if state is None:
        _kept.clear()
        give_back()
        state = _kept[owner] = {}
    return state


def give_back() -> None:
    """Return free memory to the machine: workers live on, and their peaks would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is unset and everything runs on one machine is a temporary folder set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veridelta-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/veridelta-{uuid.uuid4().hex}"


def stored(df: DataFrame, base: str, name: str) -> DataFrame:
    """Write df below base and read it back: cuts lineage, survives lost executors. Pass df without
    keeping it, and its shuffle files go as soon as it is written (see release)."""
    spark = df.sparkSession
    path, schema = f"{base}/{name}", df.schema
    df.write.mode("overwrite").parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more. It finds them
    when the JVM collects garbage, which on a quiet driver may be much later than the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, base: str, *names: str) -> None:
    """Delete what stored() wrote."""
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo mod; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod, F.lit(0))


def crc_of(value) -> int:
    return zlib.crc32(str(value).encode())


def map_arrow(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterable[dict | pa.RecordBatch]], keep: bool = False) -> DataFrame:
    """mapInArrow with a function from one batch to one dict of columns (or None). What the operator
    has kept in the worker goes with the task, unless it is dear to make again (keep)."""
    target, owner = pa_schema(schema, df.sparkSession), fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = kept(owner)
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in target], schema=target)
        if not keep:
            state.clear()
        give_back()

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def pa_schema(schema: str, spark: SparkSession | None = None) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def words_of(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text, A-Z lower-cased, as UTF-8. bytes.split() and
    bytes.lower() know exactly those white-space characters and those letters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound and then forgotten; values never change by it."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a permutation of the 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of every window of ``width`` entries of h, in order, modulo 2**64."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= _M
        out += h[j : n + j]
    return mixed(out)


def commonest(counts: DataFrame, c: str, at_most: int) -> DataFrame:
    """Rows with the greatest counts, at most so many: all of those at or above a limit that a
    histogram of the counts gives. Unlike a sorted top-k, no task gathers candidates of all others."""
    if at_most <= 0:
        return counts.limit(0)
    fine = F.floor(F.log2(F.col(c).cast("double")) * 64).cast("int")
    room, limit = at_most, None
    for r in counts.groupBy(fine.alias("bin")).count().orderBy(F.desc("bin")).collect():
        if r["count"] > room:
            break
        room, limit = room - r["count"], r["bin"]
    return counts.where(fine >= limit) if limit is not None else counts.limit(0)
