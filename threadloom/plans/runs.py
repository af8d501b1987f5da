"""Clustering runs: summaries, repeatability and coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, clustering, stability
from ..operators.reports import rows
from ..sources import adapters as ad
from .base import query

BASELINES = ["B0", "B1", "B2", "B3", "B4"]
CELLS = ad.RUNS_SQL + """, cells AS (SELECT r.run_id AS ref, c.run_id AS cmp, r.cluster_label AS a, c.cluster_label AS b, count(*) AS n FROM runs r JOIN runs c ON r.doc_key = c.doc_key AND r.run_id < c.run_id GROUP BY ALL)"""


def _ari(name: str, where: str) -> str:
    return f""", {name}_t AS (SELECT * FROM cells WHERE {where}), {name} AS (SELECT c.ref, c.cmp, total AS n,
  round((cell - sa * sb / (total * (total - 1) / 2)) / nullif((sa + sb) / 2 - sa * sb / (total * (total - 1) / 2), 0), 6) AS ari
  FROM (SELECT ref, cmp, sum(n * (n - 1) / 2) AS cell, sum(n)::BIGINT AS total FROM {name}_t GROUP BY 1, 2) c
  JOIN (SELECT ref, cmp, sum(m * (m - 1) / 2) AS sa FROM (SELECT ref, cmp, a, sum(n) AS m FROM {name}_t GROUP BY 1, 2, 3) GROUP BY 1, 2) x ON x.ref = c.ref AND x.cmp = c.cmp
  JOIN (SELECT ref, cmp, sum(m * (m - 1) / 2) AS sb FROM (SELECT ref, cmp, b, sum(n) AS m FROM {name}_t GROUP BY 1, 2, 3) GROUP BY 1, 2) y ON y.ref = c.ref AND y.cmp = c.cmp)"""


ARI = CELLS + _ari("ari_all", "true") + _ari("ari_both", "a <> -1 AND b <> -1")
AGREE = """, agree AS (SELECT ref, cmp, round(sum(n) FILTER ((a = -1) = (b = -1)) / sum(n), 6) AS agreement FROM cells GROUP BY 1, 2)"""
BEST = """, ca AS (SELECT ref, cmp, a, sum(n) AS na FROM cells WHERE a <> -1 GROUP BY 1, 2, 3), cb AS (SELECT ref, cmp, b, sum(n) AS nb FROM cells WHERE b <> -1 GROUP BY 1, 2, 3),
jj AS (SELECT m.ref, m.cmp, m.a, m.b, n / (na + nb - n) AS j FROM cells m JOIN ca ON ca.ref = m.ref AND ca.cmp = m.cmp AND ca.a = m.a JOIN cb ON cb.ref = m.ref AND cb.cmp = m.cmp AND cb.b = m.b),
best AS (SELECT ca.ref, ca.cmp, ca.a, na::BIGINT AS na, coalesce(t.b, -1) AS b, coalesce(t.j, 0) AS jaccard FROM ca LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ref, cmp, a ORDER BY j DESC, b) AS rn FROM jj) t
  ON t.ref = ca.ref AND t.cmp = ca.cmp AND t.a = ca.a AND rn = 1),
js AS (SELECT ref, cmp, count(*) AS n_ref_clusters, round(quantile_cont(jaccard, 0.25), 6) AS q1, round(quantile_cont(jaccard, 0.5), 6) AS median, round(quantile_cont(jaccard, 0.75), 6) AS q3,
  round(100 * avg((jaccard >= 0.5)::INTEGER), 4) AS pct_ge_050, round(100 * avg((jaccard >= 0.8)::INTEGER), 4) AS pct_ge_080 FROM best GROUP BY 1, 2)"""
PAIRS = ARI + AGREE + BEST + """, pairs AS (SELECT ari_all.ref, ari_all.cmp, ari_all.ari AS all_doc_ari, ari_both.ari AS both_assigned_ari, agreement, js.median AS median_best_jaccard FROM ari_all
  LEFT JOIN ari_both USING (ref, cmp) JOIN agree USING (ref, cmp) LEFT JOIN js USING (ref, cmp)),
long AS (SELECT ref, cmp, unnest(['all_doc_ari', 'both_assigned_ari', 'agreement', 'median_best_jaccard']) AS metric, unnest([all_doc_ari, both_assigned_ari, agreement, median_best_jaccard]) AS value FROM pairs)"""
BASE_LIST = ", ".join(f"'{r}'" for r in BASELINES)


def _cells(spark, sf):
    return stability.pairwise(ad.runs(spark, sf))


def _baselines(df):
    return df.where(F.col("ref").isin(BASELINES) & F.col("cmp").isin(BASELINES))


@query(f"WITH {ad.RUNS_SQL} SELECT * FROM runs")
def c19_assignments_long(spark, sf):
    return ad.runs(spark, sf)


@query(f"WITH {ad.RUNS_SQL} SELECT doc_key, cluster_label, membership_probability, cluster_label = -1 AS unassigned FROM runs WHERE run_id = 'B0'")
def c04_labels(spark, sf):
    r = ad.runs(spark, sf).where("run_id = 'B0'")
    return r.select("doc_key", "cluster_label", "membership_probability", (F.col("cluster_label") == -1).alias("unassigned"))


@query(f"WITH {ad.RUNS_SQL} SELECT run_id, cluster_label, count(*) AS size, round(avg(membership_probability), 9) AS mean_probability, 1.0::DOUBLE AS persistence FROM runs WHERE cluster_label <> -1 GROUP BY 1, 2")
def c05_cluster_sizes(spark, sf):
    r = ad.runs(spark, sf).where("cluster_label <> -1")
    return r.groupBy("run_id", "cluster_label").agg(rows().alias("size"), F.round(F.avg("membership_probability"), 9).alias("mean_probability"), F.lit(1.0).alias("persistence"))


@query(f"""WITH {ad.RUNS_SQL}, f AS (SELECT run_id, count(*) AS n, count(DISTINCT doc_key) AS k, count(cluster_label) AS labelled, count(*) FILTER (membership_probability BETWEEN 0 AND 1) AS sound FROM runs GROUP BY 1), e AS (SELECT count(*) AS m FROM embeddings)
SELECT run_id, n = m AS all_rows, n = k AS one_label_each, n = labelled AS none_missing, n = sound AS probabilities_sound FROM f, e""")
def c07_completion(spark, sf):
    m = ad.read(spark, sf, "embeddings").agg(rows().alias("m"))
    f = ad.runs(spark, sf).groupBy("run_id").agg(rows().alias("n"), F.count_distinct("doc_key").alias("k"), F.count("cluster_label").alias("labelled"), F.count_if(F.col("membership_probability").between(0, 1)).alias("sound"))
    n = F.col("n")
    return f.crossJoin(F.broadcast(m)).select("run_id", (n == F.col("m")).alias("all_rows"), (n == F.col("k")).alias("one_label_each"), (n == F.col("labelled")).alias("none_missing"), (n == F.col("sound")).alias("probabilities_sound"))


@query(f"SELECT * REPLACE (min_dist::DOUBLE AS min_dist) FROM ({ad.values_sql(clustering.SPEC_ROWS)}) AS t(run_id, phase, changed, n_neighbors, n_components, min_dist, min_cluster_size, min_samples, selection, coordinates)")
def c09_run_specs(spark, sf):
    return clustering.spec_table(spark)


@query(f"WITH {CELLS}{BEST} SELECT ref, cmp, a, na, b, round(jaccard, 6) AS jaccard FROM best")
def c10_best_matches_of_runs(spark, sf):
    return stability.best_matches(_cells(spark, sf)).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {CELLS}{BEST} SELECT * FROM js")
def c11_jaccard_summary(spark, sf):
    return stability.jaccard_summary(stability.best_matches(_cells(spark, sf)))


@query(f"WITH {CELLS}{AGREE} SELECT * FROM agree")
def c12_status_agreement(spark, sf):
    return stability.status_agreement(_cells(spark, sf))


@query(f"WITH {ARI} SELECT ref, cmp, x.n AS n_all, x.ari AS ari_all, y.n AS n_both, y.ari AS ari_both FROM ari_all x LEFT JOIN ari_both y USING (ref, cmp)")
def l11_rand_of_runs(spark, sf):
    cells = _cells(spark, sf)
    x = stability.rand_index(cells).select("ref", "cmp", F.col("n").alias("n_all"), F.col("ari").alias("ari_all"))
    return x.join(stability.rand_index(cells, True).select("ref", "cmp", F.col("n").alias("n_both"), F.col("ari").alias("ari_both")), ["ref", "cmp"], "left")


@query(f"WITH {PAIRS} SELECT * FROM pairs WHERE ref IN ({BASE_LIST}) AND cmp IN ({BASE_LIST})")
def c15_repeatability(spark, sf):
    return stability.repeatability(_baselines(_cells(spark, sf)))


@query(f"WITH {PAIRS} SELECT metric, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS most FROM long WHERE ref IN ({BASE_LIST}) AND cmp IN ({BASE_LIST}) GROUP BY 1")
def c15_ranges(spark, sf):
    return stability.ranges(stability.repeatability(_baselines(_cells(spark, sf))))


@query(f"WITH {ARI}, s AS (SELECT ref AS run, cmp AS other, ari FROM ari_all UNION ALL SELECT cmp, ref, ari FROM ari_all UNION ALL SELECT unnest([{BASE_LIST}]) AS r, r, 1.0) SELECT run, "
       + ", ".join(f"max(ari) FILTER (other = '{r}') AS {r}" for r in BASELINES) + f" FROM s WHERE run IN ({BASE_LIST}) GROUP BY 1")
def c16_rand_matrix(spark, sf):
    return stability.rand_matrix(stability.rand_index(_baselines(_cells(spark, sf))), BASELINES)


@query(f"""WITH {PAIRS}, d AS (SELECT metric, cmp, value FROM long WHERE ref = 'B0' AND (starts_with(cmp, 'U_') OR starts_with(cmp, 'H_')) AND value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, cmp) AS lo, row_number() OVER (PARTITION BY metric ORDER BY value DESC, cmp) AS hi FROM d)
SELECT metric, any_value(cmp) FILTER (lo = 1) AS largest_run, any_value(value) FILTER (lo = 1) AS largest_value, any_value(cmp) FILTER (hi = 1) AS smallest_run, any_value(value) FILTER (hi = 1) AS smallest_value FROM r GROUP BY 1""")
def c20_deviations(spark, sf):
    changed = F.col("cmp").startswith("U_") | F.col("cmp").startswith("H_")
    return stability.deviations(stability.repeatability(_cells(spark, sf).where((F.col("ref") == "B0") & changed)))


@query(f"""WITH {CELLS}{AGREE}, x AS (SELECT ref, cmp, agreement FROM agree WHERE ref = 'B0') SELECT cmp, agreement, agreement = (SELECT min(agreement) FROM x) AS smallest, agreement = (SELECT max(agreement) FROM x) AS largest FROM x
QUALIFY row_number() OVER (ORDER BY agreement, cmp) = 1 OR row_number() OVER (ORDER BY agreement DESC, cmp) = 1""")
def w22_extreme_runs(spark, sf):
    return clustering.extremes(stability.status_agreement(_cells(spark, sf).where("ref = 'B0'")).select("cmp", "agreement"), "cmp", "agreement")


QUANTILES = (0, 0.01, 0.05, 0.1, 0.5, 1, 50, 99, 99.5, 99.9, 99.95, 99.99, 100)
XY = "xy AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _xy(spark, sf):
    e = ad.read(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(f"WITH {XY} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, {p}::DOUBLE AS pct, round(quantile_cont({a}, {p / 100}), 9) AS value FROM xy" for a in "xy" for p in QUANTILES))
def c17_coordinate_quantiles(spark, sf):
    return clustering.axis_quantiles(_xy(spark, sf), ["x", "y"], QUANTILES)


def _box(low: float, high: float) -> str:
    q = ", ".join(f"quantile_cont({a}, {p / 100}) AS {a}{i}" for a in "xy" for i, p in enumerate((low, high)))
    return f"(SELECT {q} FROM xy)"


@query(f"WITH {XY} " + " UNION ALL ".join(
    f"SELECT '{n}' AS viewport, count(*) FILTER (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS inside, count(*) FILTER (NOT (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)) AS outside FROM xy, {_box(a, b)}" for n, a, b in (("99.9", 0.05, 99.95), ("99", 0.5, 99.5))
))
def p20_viewports(spark, sf):
    return clustering.viewports(_xy(spark, sf), {"99.9": (0.05, 99.95), "99": (0.5, 99.5)})


@query(f"WITH {XY}, r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM xy) SELECT least(floor((x - x0) / (x1 - x0) * 20), 19)::INTEGER AS i, least(floor((y - y0) / (y1 - y0) * 20), 19)::INTEGER AS j, count(*) AS n FROM xy, r GROUP BY 1, 2")
def c18_density(spark, sf):
    return clustering.density(_xy(spark, sf), 20)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS neighbour, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS cosine
FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT vec_id, neighbour, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY vec_id ORDER BY round(s.cosine, 9) DESC, neighbour)::BIGINT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s.cosine, 9) DESC, neighbour) <= 15""")
def c01_nearest_neighbours(spark, sf):
    return clustering.nearest(ad.read(spark, sf, "embeddings"), "vec_id", "embedding", 15)


@query("")
def c02_layout_2d(spark, sf):
    return clustering.layout(ad.read(spark, sf, "embeddings"), "vec_id", "embedding", 2)


@query("")
def s13_keyed_coordinates(spark, sf):
    return clustering.layout(ad.read(spark, sf, "embeddings"), "vec_id", "embedding", 5)


@query("")
def c03_density_clusters(spark, sf):
    return clustering.density_clusters(ad.read(spark, sf, "embeddings"), "vec_id", "embedding", 10, 10)


@query("")
def c06_spanning_tree(spark, sf):
    return clustering.spanning_tree(ad.read(spark, sf, "embeddings"), "vec_id", "embedding", 10)


@query("SELECT doc_id, quality FROM (SELECT doc_id, coalesce(quality, (SELECT quantile_cont(quality, 0.5) FROM documents JOIN labels USING (doc_id)))::DOUBLE AS quality FROM documents LEFT JOIN labels USING (doc_id))")
def p21_imputed(spark, sf):
    d = ad.read(spark, sf, "documents").select("doc_id").join(ad.read(spark, sf, "labels"), "doc_id", "left")
    return clustering.imputed(d, "quality").select("doc_id", "quality")


@query("""SELECT CASE WHEN l.doc_id IS NULL THEN 'no labels row' WHEN quality IS NULL THEN 'value missing' ELSE 'observed' END AS reason, count(*) AS n, (l.doc_id IS NULL OR quality IS NULL)::INTEGER AS indicator FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1, 3""")
def p21_imputation_reasons(spark, sf):
    l = ad.read(spark, sf, "labels").withColumn("has", F.lit(True))
    d = ad.read(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left")
    reason = F.when(F.col("has").isNull(), "no labels row").when(F.col("quality").isNull(), "value missing").otherwise("observed")
    return d.groupBy(reason.alias("reason"), F.col("quality").isNull().cast("int").alias("indicator")).agg(rows().alias("n"))


@query("""WITH e AS (SELECT vec_id, embedding FROM embeddings), k AS (SELECT doc_id FROM documents), f AS (SELECT count(*) AS n, count(DISTINCT vec_id) AS u, count(*) FILTER (len(embedding) = 64) AS d, count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0) AS fin FROM e),
m AS (SELECT (SELECT count(*) FROM e ANTI JOIN k ON k.doc_id = e.vec_id) AS extra, (SELECT count(*) FROM k ANTI JOIN e ON e.vec_id = k.doc_id) AS missing)
SELECT 'one row a key' AS "check", (n - u)::VARCHAR AS detail, CASE WHEN n = u THEN 'pass' ELSE 'fail' END AS status FROM f UNION ALL SELECT 'dimension is 64', (n - d)::VARCHAR, CASE WHEN n = d THEN 'pass' ELSE 'fail' END FROM f
UNION ALL SELECT 'all finite', (n - fin)::VARCHAR, CASE WHEN n = fin THEN 'pass' ELSE 'fail' END FROM f UNION ALL SELECT 'no key outside the corpus', extra::VARCHAR, CASE WHEN extra = 0 THEN 'pass' ELSE 'fail' END FROM m
UNION ALL SELECT 'no key missing', missing::VARCHAR, CASE WHEN missing = 0 THEN 'pass' ELSE 'fail' END FROM m""")
def e07_vector_checks(spark, sf):
    e, k = ad.read(spark, sf, "embeddings"), ad.read(spark, sf, "documents").select("doc_id")
    return checks.vector_checks(e, "vec_id", "embedding", 64, k, "doc_id")
