"""Comparing two labellings by their contingency table; -1 is noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(runs: DataFrame) -> DataFrame:
    return runs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _pairs(c):
    return c * (c - 1) / 2


def adjusted_rand(runs: DataFrame) -> DataFrame:
    """ARI of all rows (noise is a cluster) and of rows assigned in both; null where it is 0/0."""
    out = None
    for scope, part in (("all", runs), ("assigned", runs.where("a <> -1 AND b <> -1"))):
        t = contingency(part)
        cell = t.agg(F.sum(_pairs(F.col("n"))).alias("cell"), F.sum("n").alias("total"))
        row = t.groupBy("a").agg(F.sum("n").alias("m")).agg(F.sum(_pairs(F.col("m"))).alias("row"))
        col = t.groupBy("b").agg(F.sum("n").alias("m")).agg(F.sum(_pairs(F.col("m"))).alias("col"))
        one = cell.crossJoin(row).crossJoin(col)  # one row each
        expected = F.col("row") * F.col("col") / _pairs(F.col("total"))
        ari = F.try_divide(F.col("cell") - expected, (F.col("row") + F.col("col")) / 2 - expected)
        one = one.select(F.lit(scope).alias("scope"), F.col("total").alias("n"), F.round(ari, 9).alias("ari"))
        out = one if out is None else out.unionByName(one)
    return out


def best_match(runs: DataFrame) -> DataFrame:
    """Per cluster of a: the cluster of b with the largest Jaccard, ties to the smaller label; -1 and 0 if none meets it."""
    a = runs.where("a <> -1").groupBy("a").agg(F.count(F.lit(1)).alias("na"))
    b = runs.where("b <> -1").groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    met = contingency(runs.where("a <> -1 AND b <> -1")).join(a, "a").join(b, "b")
    met = met.withColumn("j", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    top = met.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("j"), "b"))).where("rn = 1").select("a", "b", "j")
    return a.join(top, "a", "left").select("a", "na", F.coalesce("b", F.lit(-1)).alias("b"), F.round(F.coalesce("j", F.lit(0.0)), 9).alias("jaccard"))


def transitions(runs: DataFrame) -> DataFrame:
    s = lambda c: F.when(F.col(c) == -1, "noise").otherwise("assigned")
    return runs.groupBy(s("a").alias("from_status"), s("b").alias("to_status")).agg(F.count(F.lit(1)).alias("n"))


def cluster_summary(runs: DataFrame) -> DataFrame:
    sizes = runs.where("a <> -1").groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    every = runs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == -1).alias("noise"))
    s = sizes.agg(F.count(F.lit(1)).alias("clusters"), F.min("m").alias("min_size"), F.round(F.percentile("m", 0.25), 6).alias("q1"), F.round(F.percentile("m", 0.5), 6).alias("median"), F.round(F.percentile("m", 0.75), 6).alias("q3"), F.max("m").alias("max_size"))
    return every.crossJoin(s).select("n", "clusters", "noise", F.round(100 * F.col("noise") / F.col("n"), 4).alias("noise_pct"), "min_size", "q1", "median", "q3", "max_size")


# --- many runs: (ref, cmp, a, b, n) for each pair of runs, and what follows from it ------------------


def pairwise(runs: DataFrame) -> DataFrame:
    """Contingency of every pair of runs, the smaller name the reference. Runs are few; each vector meets itself in them."""
    r = runs.select("doc_key", F.col("run_id").alias("ref"), F.col("cluster_label").alias("a"))
    c = runs.select("doc_key", F.col("run_id").alias("cmp"), F.col("cluster_label").alias("b"))
    return r.join(c, "doc_key").where("ref < cmp").groupBy("ref", "cmp", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def rand_index(cells: DataFrame, assigned: bool = False) -> DataFrame:
    """(ref, cmp, n, ari) of all rows, or of those assigned in both; null where it is 0/0."""
    part = cells.where("a <> -1 AND b <> -1") if assigned else cells
    key = ["ref", "cmp"]
    cell = part.groupBy(*key).agg(F.sum(_pairs(F.col("n"))).alias("cell"), F.sum("n").alias("total"))
    side = [part.groupBy(*key, c).agg(F.sum("n").alias("m")).groupBy(*key).agg(F.sum(_pairs(F.col("m"))).alias(f"s{c}")) for c in ("a", "b")]
    one = cell.join(side[0], key).join(side[1], key)
    expected = F.try_divide(F.col("sa") * F.col("sb"), _pairs(F.col("total")))
    return one.select(*key, F.col("total").alias("n"), F.round(F.try_divide(F.col("cell") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), 6).alias("ari"))


def status_agreement(cells: DataFrame) -> DataFrame:
    """Share of rows that are noise in both or assigned in both."""
    same = F.when((F.col("a") == -1) == (F.col("b") == -1), F.col("n")).otherwise(0)
    return cells.groupBy("ref", "cmp").agg(F.round(F.sum(same) / F.sum("n"), 6).alias("agreement"))


def best_matches(cells: DataFrame) -> DataFrame:
    """(ref, cmp, a, na, b, jaccard): best_match for every pair of runs."""
    key = ["ref", "cmp"]
    a = cells.where("a <> -1").groupBy(*key, "a").agg(F.sum("n").alias("na"))
    b = cells.where("b <> -1").groupBy(*key, "b").agg(F.sum("n").alias("nb"))
    met = cells.where("a <> -1 AND b <> -1").join(a, [*key, "a"]).join(b, [*key, "b"]).withColumn("j", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    top = met.groupBy(*key, "a").agg(F.max(F.struct("j", F.negative("b").alias("m"))).alias("x")).select(*key, "a", F.negative("x.m").alias("b"), F.col("x.j").alias("j"))
    return a.join(top, [*key, "a"], "left").select(*key, "a", "na", F.coalesce("b", F.lit(-1)).alias("b"), F.coalesce("j", F.lit(0.0)).alias("jaccard"))


def jaccard_summary(best: DataFrame) -> DataFrame:
    j = F.col("jaccard")
    q = [F.round(F.percentile(j, p), 6).alias(c) for p, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    pct = [F.round(100 * F.avg((j >= t).cast("double")), 4).alias(c) for t, c in ((0.5, "pct_ge_050"), (0.8, "pct_ge_080"))]
    return best.groupBy("ref", "cmp").agg(F.count(F.lit(1)).alias("n_ref_clusters"), *q, *pct)


def repeatability(cells: DataFrame) -> DataFrame:
    """One row a pair of runs: both ARIs, status agreement, median best Jaccard."""
    key = ["ref", "cmp"]
    out = rand_index(cells).select(*key, F.col("ari").alias("all_doc_ari")).join(rand_index(cells, True).select(*key, F.col("ari").alias("both_assigned_ari")), key, "left")
    return out.join(status_agreement(cells), key).join(jaccard_summary(best_matches(cells)).select(*key, F.col("median").alias("median_best_jaccard")), key, "left")


METRICS = ("all_doc_ari", "both_assigned_ari", "agreement", "median_best_jaccard")


def ranges(pairs: DataFrame) -> DataFrame:
    """min, median, max of each metric."""
    long = pairs.unpivot(["ref", "cmp"], list(METRICS), "metric", "value")
    return long.groupBy("metric").agg(F.min("value").alias("least"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.max("value").alias("most"))


def deviations(pairs: DataFrame) -> DataFrame:
    """Per metric: the run that deviates most (the smallest value) and least, the first by name of equal ones."""
    long = pairs.unpivot(["ref", "cmp"], list(METRICS), "metric", "value").where("value IS NOT NULL")
    most, least = F.min(F.struct("value", "cmp")).alias("x"), F.min(F.struct(F.negative("value").alias("v"), "cmp")).alias("y")
    return long.groupBy("metric").agg(most, least).select(
        "metric", F.col("x.cmp").alias("largest_run"), F.col("x.value").alias("largest_value"), F.col("y.cmp").alias("smallest_run"), F.negative("y.v").alias("smallest_value")
    )


def rand_matrix(pairs: DataFrame, runs: list[str]) -> DataFrame:
    """run and a column a run, symmetric, 1 on the diagonal."""
    one = pairs.select(F.col("ref").alias("run"), F.col("cmp").alias("other"), "ari")
    own = pairs.sparkSession.createDataFrame([(r, r, 1.0) for r in runs], "run string, other string, ari double")
    every = one.unionByName(one.select(F.col("other").alias("run"), F.col("run").alias("other"), "ari")).unionByName(own)
    return every.groupBy("run").pivot("other", runs).agg(F.first("ari"))
