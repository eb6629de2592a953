"""Shared pieces: scratch tables on the shared folder, word splitting over Arrow buffers and 64-bit hashing.

Words are maximal runs of characters other than space and ``\\t \\n \\v \\f \\r``; all of these are one byte in UTF-8, so splitting
works on the bytes and never decodes.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_REGEX = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that are worked on at once; the arrays derived from them take about ten times as much.
PIECE_BYTES = 1 << 20

#: Bytes of a task that writes a table of short rows, about.
TASK_BYTES = 32 << 20
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- scratch tables


_MADE: list[Scratch] = []


@atexit.register
def _clean() -> None:
    """Delete what this driver wrote to scratch; results may read it lazily until then."""
    for s in _MADE:
        try:
            s.drop("")
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


class Scratch:
    """Tables written to the folder that all executors share (``spark.checkpoint.dir``); they cut lineage and survive executors.

    They are deleted when the driver ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        small_batches(spark)
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            local = tempfile.mkdtemp(prefix="sparrowmill-")  # local mode only: the driver is the executor
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            root = "file://" + local
        self.root = f"{root.rstrip('/')}/sparrowmill-{name}-{uuid.uuid4().hex[:12]}"
        _MADE.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str, upto: int | None = None) -> DataFrame:
        """Write ``df`` and return the written table.

        ``upto``: a bound of the table's bytes.  If tasks of ``TASK_BYTES`` are fewer than the shuffle partitions, so many are made (but
        at least eight a core), since opening very many tiny files costs more than their rows."""
        p = self.path(name)
        if upto is not None:
            tasks = max(8 * self.spark.sparkContext.defaultParallelism, -(-upto // TASK_BYTES))
            if tasks < shuffle_partitions(self.spark):
                df = df.coalesce(tasks)
        df.write.mode("overwrite").parquet(p)
        return self.spark.read.schema(df.schema).parquet(p)

    def drop(self, *names: str) -> None:
        """Delete written tables that nothing reads any more."""
        jvm = self.spark._jvm
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n).rstrip("/"))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced, so that they don't pile up between stages.

    The driver's Python lets go of its plans first; the JVM's collector then finds them in one or two rounds."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def trim() -> None:
    """Give memory that a task has freed back to the system: Python workers stay for later tasks, and several of them share an executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes: a batch is held several times on its way to Python and back, in every core."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; batches of what is read are bounded from then on."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (xor-shift-multiply)."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, extended on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            one = np.ones(self.n, U)
            a, b = one.copy(), one.copy()
            a[1:], b[1:] = U(self.base), U(self.inv)
            self.fwd, self.back = np.multiply.accumulate(a), np.multiply.accumulate(b)
        return self.fwd[:n], self.back[:n]


BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
WORD_POWERS = Powers(0xC2B2AE3D27D4EB4F)
WORD_POWERS_2 = Powers(0x165667B19E3779F9)

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a piece of a column: byte positions, document number and, on demand, hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds = data, bounds  # each document ends with one added \n
        inside = np.empty(len(data) + 1, np.int8)
        inside[0] = 0
        inside[1:] = ~_WS[data]
        step = np.diff(inside)
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.starts, bounds)  # of each document, and the end
        self.counts = np.diff(self.first)
        self.n = len(self.starts)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, with A-Z lower-cased if asked."""
        d = _LOWER[self.data] if lower else self.data
        fwd, back = BYTE_POWERS.upto(len(d) + 1)
        total = np.zeros(len(d) + 1, U)
        np.cumsum((d.astype(U) + U(1)) * fwd[: len(d)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(U))


def windows(h: np.ndarray, n: int, powers: Powers = WORD_POWERS) -> np.ndarray:
    """Hash of each run of ``n`` consecutive hashes."""
    if len(h) < n:
        return np.zeros(0, U)
    fwd, back = powers.upto(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * fwd[: len(h)], out=total[1:])
    m = len(h) - n + 1
    return mix((total[n : n + m] - total[:m]) * back[:m])


def as_strings(col: pa.Array) -> pa.Array:
    """Large strings without nulls (a null text counts as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.large_string()), "")


def ended(texts: pa.Array, end: str) -> pa.Array:
    """Each text with ``end`` added."""
    return pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(end, pa.large_string()))


def ranges_of(texts: pa.Array, limit: int):
    """Yield (first row, number of rows) of consecutive rows with about ``limit`` bytes together, or one longer row."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(size + 1)
    at = 0
    while at < len(size):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to - at
        at = to


def pieces(texts: pa.Array, limit: int = PIECE_BYTES):
    """Yield (first row, number of rows, Words) so that a piece has about ``limit`` bytes, or one longer document."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for at, rows in ranges_of(texts, limit):
        joined = ended(as_strings(texts.slice(at, rows)), "\n")  # text + \n
        offs = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + rows + 1]
        raw = np.frombuffer(joined.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        yield at, rows, Words(raw, (offs - offs[0]).astype(np.int64))


def pack_u64(a: np.ndarray, width: int = 8) -> bytes:
    """Little-endian integers of ``width`` bytes each."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_u64(b: bytes, width: int = 8) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8")


def word_count(text) -> "F.Column":
    """Number of words of a text column; null counts 0.  JVM-side."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")
