"""Helpers that the operators share: words, packed arrays, scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from pathlib import Path

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space and U+0009..U+000D (Java and Python syntax).
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 text; ``bytes.split`` parts at just the six ASCII white-space bytes."""
    return text.split() if text else []


def lower(col):
    """A-Z lower-cased, everything else left alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def fold(col, parts: int):
    """The crc32 of an id's decimal text, modulo ``parts``."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(parts)


_tables: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Without one named, a temporary folder serves local sessions, and only those."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _read(spark: SparkSession, schema, path: str) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    _tables[path] = (spark, path)
    out._plumbline_path = path
    return out


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later plans start from files, not from its lineage."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/plumbline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = _read(spark, df.schema, path)
    release(spark)
    return out


def written_apart(df: DataFrame, name: str, condition: str) -> tuple[DataFrame, DataFrame]:
    """As ``written``, of packed rows in two tables: where the condition is true, and where not. Each can be dropped."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/plumbline-{name}-{uuid.uuid4().hex}"
    df.withColumn("_yes", F.expr(condition)).write.partitionBy("_yes").option("compression", "uncompressed").parquet(path)
    jvm, found = spark.sparkContext._jvm, []
    files = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for side in ("true", "false"):
        there = files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_yes={side}"))
        found.append(_read(spark, df.schema, f"{path}/_yes={side}") if there else spark.createDataFrame([], df.schema))
    release(spark)
    return found[0], found[1]


def ranges_for(df: DataFrame, column: str, each: int) -> int:
    """How many ranges hold about ``each`` bytes of a column's texts: counted, whatever the session's settings."""
    size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return ranges_of(df.sparkSession, size, each)


def ranges_of(spark: SparkSession, size: int, each: int) -> int:
    """At least one range for each core, and never fewer than keep a range within its bytes."""
    return max(spark.sparkContext.defaultParallelism, -(-size // each))


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; its cleaner acts on what the JVM collects."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(*frames: DataFrame) -> None:
    """Deletes tables of ``written`` that no later plan reads."""
    for df in frames:
        found = _tables.pop(getattr(df, "_plumbline_path", ""), None)
        if found:
            _delete(*found)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear() -> None:
    """Deletes all tables of ``written``: for long sessions, once the results that read them are stored."""
    while _tables:
        _delete(*_tables.popitem()[1])


@atexit.register
def _drop_all() -> None:
    try:
        clear()
    except Exception:  # the session has ended before; its files stay
        return


def trim() -> None:
    """Returns freed memory to the system: a Python worker is reused, and its heap would stay at the largest task's size."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: larger arrays are mapped, and unmapped when they go
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        return


def slices(batches, rows: int = 400):
    """Arrow batches in parts of few rows: what a task makes of texts at a time stays small."""
    trim()
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one blob. Each is stored by byte planes, so that small numbers cost few bytes."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""
        head += [ord(a.dtype.kind), a.itemsize, len(a), len(raw)]
        body.append(raw)
    return np.array(head, np.int64).tobytes() + b"".join(body)


def unpack(blob: bytes) -> list[np.ndarray]:
    view = memoryview(blob)
    count = int(np.frombuffer(view[:8], np.int64)[0])
    at, out = 8 + 32 * count, []
    for kind, size, n, raw in np.frombuffer(view[8:at], np.int64).reshape(count, 4):
        dtype = np.dtype(f"{chr(kind)}{size}")
        if n:
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(view[at : at + raw]), np.uint8)
            out.append(np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(n))
        else:
            out.append(np.empty(0, dtype))
        at += raw
    return out


def distinct(a: np.ndarray) -> np.ndarray:
    """The sorted distinct values; sorting is many times faster than the hash table of ``np.unique``."""
    a = np.sort(a)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return a[new]


def deltas(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first from zero."""
    return np.diff(a, prepend=a.dtype.type(0)) if len(a) else a


def undeltas(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)
