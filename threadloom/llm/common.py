"""What the operators of this folder share: scratch tables, words, byte-level numpy kernels.

Words are always ``[^\\x20\\x09-\\x0D]+`` and only A-Z are lower-cased.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own_scratch: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder of the cluster (spark.checkpoint.dir); where that is unset, a temporary one if all runs on this machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_scratch.get(spark.sparkContext.applicationId)
    if not base:
        base = _own_scratch[spark.sparkContext.applicationId] = shared_folder(spark)
    return f"{base.rstrip('/')}/threadloom/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: a cut of the lineage that survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Frees the disk of finished jobs: shuffle files that no living plan needs, and the folders of the materialised tables ``done``.

    Only for tables whose results are themselves materialised: nothing can ask for them again, not even after a lost executor.
    """
    for df in done:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Gives the memory that a task has freed back to the machine: workers are used again, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- byte kernels -----------------------------------------------------------

LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_R = 0x9E3779B97F4A7C17
_R_INV = pow(_R, -1, 2**64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("r", ())) < n:
        for k, v in (("r", _R), ("i", _R_INV)):
            a = np.full(n, v, dtype=np.uint64)
            a[0] = 1
            _POWERS[k] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["r"][:n], _POWERS["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text, one row at least: bounds the kernels' memory."""
    if batch.num_rows == 0:
        return
    _, off = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words in order, and the row of each."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[LOWER_BYTES[data]] * power, out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(off, starts, side="right") - 1


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words of one text; a shorter text is one window; no words, none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    m = min(n, k)
    out = np.full(n - m + 1, m, np.uint64)
    for j in range(m):
        out = mix(out * np.uint64(_R) + words[j : n - m + 1 + j])
    return out
