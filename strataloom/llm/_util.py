"""Shared helpers of the corpus operators: table access, shared storage, byte tokenizing."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one run (one group of documents in one Python call) holds, about.
RUN_BYTES = 8 << 20
#: A small table is dealt to so many runs, so that it keeps more than a few tasks busy; none is less than the bytes.
SOME_RUNS, LEAST_BYTES = 48, 1 << 19

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = bytes(
    32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else (b + 32 if 65 <= b <= 90 else b) for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: the session's spark.checkpoint.dir.

    Where that is unset, a local run gets a folder of its own; on a cluster, whose machines
    share no local folder, it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="strataloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The table goes when the session's JVM ends in good order.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def words_of(text: bytes) -> list[bytes]:
    """Words of op6: A-Z lowered, runs of ASCII letters, digits and non-ASCII bytes."""
    return text.translate(_WORD).split()


def text_bytes(df: DataFrame, col: str = "text") -> DataFrame:
    """df with its text as UTF-8 bytes, null as empty."""
    return df.withColumn(col, F.coalesce(F.col(col).cast("binary"), F.lit(b"")))


def run_count(df: DataFrame, col: str, run_bytes: int) -> int:
    """How many runs of about run_bytes the column fills; one aggregate over the column."""
    n = df.agg(F.sum(F.octet_length(F.col(col))), F.count(F.lit(1))).first()
    size = int(n[0] or 0) + 16 * int(n[1])
    return max(1, -(-size // run_bytes), min(SOME_RUNS, size // LEAST_BYTES))


def planes(a: np.ndarray) -> bytes:
    """Little-endian bytes of a, first all lowest bytes, then the next: near-constant high bytes compress away."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1)


def split_test(col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 marks the held-out rows."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(step: Callable) -> Callable:
    """step, handing freed memory back to the system after each call.

    Spark keeps Python workers for later stages; each would hold on to the peak of its largest group.
    """

    def call(*args):
        try:
            return step(*args)
        finally:
            _release()

    call.__signature__ = inspect.signature(step)
    return call


def lean_batches(step: Callable) -> Callable:
    """The same for functions of an iterator of batches, once at the end."""

    def call(batches):
        try:
            yield from step(batches)
        finally:
            _release()

    return call
