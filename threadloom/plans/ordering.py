"""Buckets, ranks, samples, request plans and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering, threads
from ..operators.reports import rows
from ..sources import adapters as ad
from ..sources import provenance as pv
from .base import query
from .events import EVENTS, events

BUCKETS = [(3600, "<=1h"), (86400, "1h-1d"), (604800, "1d-1w")]


@query(f"""WITH {ad.REPLIES} SELECT CASE WHEN s < 0 THEN NULL WHEN s <= 3600 THEN '<=1h' WHEN s <= 86400 THEN '1h-1d' WHEN s <= 604800 THEN '1d-1w' ELSE '>1w' END AS bucket, count(*) AS n FROM (SELECT time - root_time AS s FROM replies) GROUP BY 1""")
def a13_time_buckets(spark, sf):
    return ad.replies(spark, sf).groupBy(ordering.time_bucket(F.col("time") - F.col("root_time"), BUCKETS, ">1w").alias("bucket")).agg(rows().alias("n"))


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS a, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS b FROM events)
SELECT event_type, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1""")
def a36_spearman(spark, sf):
    return ordering.spearman(ad.read(spark, sf, "events"), "event_type", "user_id", "value")


@query(f"""WITH {ad.REPLIES}, f AS (SELECT root, min(time) - any_value(root_time) AS s FROM replies GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (s < 0) AS negative, min(s) AS least, round(quantile_cont(s, 0.5), 6) AS median, max(s) AS most FROM f""")
def w02_elapsed(spark, sf):
    f = threads.first_replies(ad.replies(spark, sf))
    s = F.col("elapsed")
    return f.agg(rows().alias("n"), F.count_if(s < 0).alias("negative"), F.min(s).alias("least"), F.round(F.percentile(s, 0.5), 6).alias("median"), F.max(s).alias("most"))


@query("""WITH t AS (SELECT lang, doc_id, source, md5(text) AS f, md5(doc_id || ':7') AS h FROM documents WHERE n_chars BETWEEN 100 AND 5000), r AS (SELECT *, row_number() OVER (PARTITION BY lang, f ORDER BY h, doc_id) AS a, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS b FROM t)
SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rank FROM r WHERE a = 1 AND b = 1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) <= 5""")
def w08_seeded_sample(spark, sf):
    d = ad.read(spark, sf, "documents").where("n_chars BETWEEN 100 AND 5000").withColumn("form", F.md5("text"))
    return ordering.seeded_sample(d, "lang", "doc_id", ["form", "source"], 7, 5)


@query(f"""WITH RECURSIVE {EVENTS}, o AS (SELECT row_number() OVER (ORDER BY created_utc, doc_key) AS i, text_n_chars AS n FROM events_), g(i, batch, total) AS (SELECT i, 1, n FROM o WHERE i = 1 UNION ALL
SELECT o.i, CASE WHEN total + n > 5000 THEN batch + 1 ELSE batch END, CASE WHEN total + n > 5000 THEN n ELSE total + n END FROM g JOIN o ON o.i = g.i + 1)
SELECT batch::BIGINT AS batch, min(i) - 1 AS first_row, count(*) AS documents, max(total)::BIGINT AS tokens FROM g GROUP BY 1""")
def w18_request_plan(spark, sf):
    e = events(spark, sf).select("doc_key", "created_utc", F.col("text_n_chars").cast("long").alias("n"))
    return ordering.request_plan(e.orderBy("created_utc", "doc_key").select("n"), "n", 5000)


@query(f"WITH {EVENTS} SELECT count(*) AS n, count(*) AS right_size, count(*) AS unit FROM events_")
def e04_encoded(spark, sf):
    e = events(spark, sf).select("doc_key", F.when(F.coalesce("text", F.lit("")) == "", " ").otherwise(F.col("text")).alias("text"))
    v = ordering.encoded(e, "doc_key", "text", ordering.hashing_encoder(64))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return v.agg(rows().alias("n"), F.count_if(F.size("embedding") == 64).alias("right_size"), F.count_if(F.abs(norm - 1) < 1e-4).alias("unit"))


RATES = [(100, 5000, 10.0, 900, 45000), (0, 0, 0.0, 10, 10), (7, 70, 3.5, 0, 0)]


@query(f"SELECT n, round(n / nullif(s, 0), 6) AS documents_per_s, round(t / nullif(s, 0), 6) AS tokens_per_s, round(lt / nullif(t / nullif(s, 0), 0), 6) AS eta_by_tokens, round(ln_ / nullif(n / nullif(s, 0), 0), 6) AS eta_by_docs FROM ({ad.values_sql(RATES)}) AS x(n, t, s, ln_, lt)")
def e06_rates(spark, sf):
    out = [(r[0], *[None if v is None else round(v, 6) for v in pv.rates(*r).values()]) for r in RATES]
    return spark.createDataFrame(out, "n int, documents_per_s double, tokens_per_s double, eta_by_tokens double, eta_by_docs double")
