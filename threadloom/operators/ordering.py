"""Buckets, rank correlation, seeded samples, request plans, encoding in batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_bucket(seconds: Column, edges: list[tuple[int, str]], beyond: str) -> Column:
    """Right-closed buckets of waits; a negative wait has none."""
    out = F.when(seconds < 0, F.lit(None).cast("string"))
    for top, label in edges:
        out = out.when(seconds <= top, label)
    return out.otherwise(beyond)


def spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks within groups. Ranks come from the counts of distinct values."""
    ranked = df.select(by, x, y)
    for c in (x, y):
        g = df.groupBy(by, c).agg(F.count(F.lit(1)).alias("k"))
        before = F.coalesce(F.sum("k").over(Window.partitionBy(by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.join(g.select(by, c, (before + (F.col("k") + 1) / 2).alias(f"rank_{c}")), [by, c])
    return ranked.groupBy(by).agg(F.round(F.corr(f"rank_{x}", f"rank_{y}"), 6).alias("spearman"))


def seeded_sample(df: DataFrame, by: str, key: str, once: list[str], seed: int, most: int) -> DataFrame:
    """The first ``most`` rows of each group in a hash order, of rows that come first in it with each of the fields ``once``."""
    h = df.select(by, key, *once, F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))).alias("h"))
    kept = None
    for c in once:
        first = h.groupBy(by, c).agg(F.min(F.struct("h", key)).alias("f")).select(by, F.col(f"f.{key}").alias(key))
        kept = first if kept is None else kept.intersect(first)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("h", key)).cast("long")
    return h.join(kept, [by, key], "left_semi").withColumn("rank", rank).where(F.col("rank") <= most).select(by, key, "rank")


def request_plan(ordered: DataFrame, n: str, budget: int) -> DataFrame:
    """Consecutive batches of an ordered stream whose sums stay within the budget; a batch has one row at least.

    Each batch begins where the one before ended, so the numbers (8 bytes a row) pass through the driver in order, a partition at a time.
    """
    out, first, row, total = [], 0, 0, 0
    for r in ordered.select(n).toLocalIterator():
        if row > first and total + r[0] > budget:
            out.append((len(out) + 1, first, row - first, total))
            first, total = row, 0
        total += r[0]
        row += 1
    if row > first:
        out.append((len(out) + 1, first, row - first, total))
    return ordered.sparkSession.createDataFrame(out, "batch long, first_row long, documents long, tokens long")


def hashing_encoder(size: int) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors from hashed words; in place of a model where none can be reached."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for i, t in enumerate(texts):
            for w in t.split() or [""]:
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                out[i, h % size] += 1 if h >> 63 else -1
        norm = np.sqrt((out**2).sum(1, keepdims=True))
        out[:, :1] += norm == 0
        return out / np.where(norm == 0, 1, norm)

    return encode


def encoded(df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray], budget: int = 100_000) -> DataFrame:
    """key, embedding: texts go to the encoder in batches of about ``budget`` characters."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= budget):
                    size += len(texts[end])
                    end += 1
                v = encoder(texts[at:end]).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), vectors], [key, "embedding"])
                at = end

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")
