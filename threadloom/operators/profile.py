"""Counts, bands, quantiles, field coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reports import digest


def field_coverage(df: DataFrame) -> DataFrame:
    """Per column: rows, missing, empty, usable, distinct usable values; one pass."""
    aggs = []
    for c in df.columns:
        s = F.col(f"`{c}`").cast("string")
        aggs += [F.count_if(s.isNull()).alias(f"{c}__missing"), F.count_if(s == "").alias(f"{c}__empty"), F.count_distinct(digest(F.when(s != "", s))).alias(f"{c}__distinct")]
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    parts = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col("__rows").alias("records"), *[F.col(f"`{c}__{k}`").alias(k) for k in ("missing", "empty", "distinct")]) for c in df.columns
    ])
    return row.select(F.explode(parts).alias("x")).select("x.field", "x.records", "x.missing", "x.empty", (F.col("x.records") - F.col("x.missing") - F.col("x.empty")).alias("usable"), F.col("x.distinct").alias("n_distinct"))


def quantiles(df: DataFrame, value: str, by: str, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Exact, linear between neighbours (type 7)."""
    return df.groupBy(by).agg(F.count(value).alias("n"), *[F.round(F.percentile(value, p), 6).alias(f"p{round(100 * p):02d}") for p in at])


def shares(df: DataFrame, group: str, item: str) -> DataFrame:
    n = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 9))


def completed(counts: DataFrame, key: str, levels: list[str]) -> DataFrame:
    """All levels, absent ones with 0, with running counts and shares."""
    dim = counts.sparkSession.createDataFrame(list(enumerate(levels)), f"ord int, {key} string")
    w, every = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.broadcast(dim).join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("ord", key, "n", F.sum("n").over(w).alias("cumulative"), F.round(F.try_divide(F.sum("n").over(w), F.sum("n").over(every)), 9).alias("cumulative_share"))


def daily_wide(df: DataFrame, time: str, kind: str, kinds: list[str]) -> DataFrame:
    out = df.groupBy(F.to_date(time).cast("string").alias("day")).pivot(kind, kinds).count().na.fill(0)
    return out.withColumn("total", sum((F.col(f"`{k}`") for k in kinds), F.lit(0)))


def duplicate_texts(df: DataFrame, text: str, within: str) -> DataFrame:
    return df.groupBy(F.md5(text).alias("text_md5")).agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct(within).alias("n_within")).where("occurrences > 1")


def fixed_bins(df: DataFrame, value: str, width: float, top: int) -> DataFrame:
    """Right-closed bins; zero is bin 0, values beyond the last edge fall into the last bin."""
    return df.groupBy(F.least(F.ceil(F.col(value) / width), F.lit(top)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def gini(counts: DataFrame, value: str) -> DataFrame:
    """Of grouped counts: equal values share one step, so ranks need a window over distinct values only."""
    g = counts.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.col("k") * before + F.col("k") * (F.col("k") + 1) / 2
    s = g.withColumn("r", ranks).agg(F.sum(F.col("v") * F.col("r")).alias("a"), F.sum(F.col("v") * F.col("k")).alias("t"), F.sum("k").alias("n"))
    return s.select("n", F.round(2 * F.col("a") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n"), 9).alias("gini"))


def average_ranks(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rank with averaged ties and minimum rank; windows run over distinct values."""
    g = df.groupBy(value).agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = g.select(value, (before + (F.col("k") + 1) / 2).alias("avg_rank"), (before + 1).alias("min_rank"))
    return df.select(key, value).join(g, value).select(key, value, "avg_rank", "min_rank")
