"""Names of all queries over the supplied tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import lists, profile, stability, text, threads
from ..sources import adapters as ad
from . import corpus, events, ordering, provenance, reports, runs, wordlists  # noqa: F401  register their queries
from .base import QUERIES, SQL, query

def _coverage_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) AS records, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER ({c}::VARCHAR = '') AS empty, "
        f"count(*) FILTER ({c}::VARCHAR <> '') AS usable, count(DISTINCT {c}) FILTER ({c}::VARCHAR <> '') AS n_distinct FROM {table}" for c in columns
    )


@query(_coverage_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def a04_field_coverage(spark, sf):
    return profile.field_coverage(ad.read(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT ts::DATE::VARCHAR AS day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + ", "
       + " + ".join(f"count(*) FILTER (event_type = '{k}')" for k in KINDS) + " AS total FROM events GROUP BY 1")
def a08_daily_wide(spark, sf):
    return profile.daily_wide(ad.read(spark, sf, "events"), "ts", "event_type", KINDS)


@query("SELECT hour(ts)::INTEGER AS hour, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def a09_hourly_activity(spark, sf):
    return ad.read(spark, sf, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT md5(text) AS text_md5, count(*) AS occurrences, count(DISTINCT source) AS n_within FROM documents GROUP BY text HAVING count(*) > 1")
def a10_duplicate_texts(spark, sf):
    return profile.duplicate_texts(ad.read(spark, sf, "documents"), "text", "source")


@query("SELECT occurrences, count(*) AS n_texts FROM (SELECT count(*) AS occurrences FROM documents GROUP BY text) GROUP BY 1")
def a11_frequency_of_frequencies(spark, sf):
    d = ad.read(spark, sf, "documents")
    return d.groupBy(F.md5("text").alias("m")).agg(F.count(F.lit(1)).alias("occurrences")).groupBy("occurrences").agg(F.count(F.lit(1)).alias("n_texts"))


@query("""SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 9) AS share FROM documents GROUP BY 1, 2""")
def a07_shares(spark, sf):
    return profile.shares(ad.read(spark, sf, "documents"), "lang", "source")


@query("""SELECT CASE WHEN n_chars <= -1 THEN NULL WHEN n_chars <= 500 THEN '0-500' WHEN n_chars <= 2000 THEN '501-2000' WHEN n_chars <= 8000 THEN '2001-8000' ELSE '8001+' END AS band,
  count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""")
def a12_length_bands(spark, sf):
    band = ft.right_closed(F.col("n_chars"), [-1, 500, 2000, 8000], ["0-500", "501-2000", "2001-8000", "8001+"])
    return ad.read(spark, sf, "documents").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


WAITS = ["before root", "<=1h", "1h-1d", "1d-1w", ">1w"]


@query(f"""WITH {ad.REPLIES}, b AS (SELECT CASE WHEN time - root_time < 0 THEN 0 WHEN time - root_time <= 3600 THEN 1 WHEN time - root_time <= 86400 THEN 2
  WHEN time - root_time <= 604800 THEN 3 ELSE 4 END AS ord FROM replies), c AS (SELECT ord, count(*) AS n FROM b GROUP BY 1),
d AS (SELECT unnest([0,1,2,3,4]) AS ord, unnest({WAITS!r}) AS wait), f AS (SELECT d.ord, wait, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (ord))
SELECT ord, wait, n, sum(n) OVER (ORDER BY ord)::BIGINT AS cumulative, round(sum(n) OVER (ORDER BY ord) / sum(n) OVER (), 9) AS cumulative_share FROM f""")
def a14_reply_time_bands(spark, sf):
    s = F.col("time") - F.col("root_time")
    wait = F.when(s < 0, WAITS[0]).when(s <= 3600, WAITS[1]).when(s <= 86400, WAITS[2]).when(s <= 604800, WAITS[3]).otherwise(WAITS[4])
    return profile.completed(ad.replies(spark, sf).groupBy(wait.alias("wait")).agg(F.count(F.lit(1)).alias("n")), "wait", WAITS)


@query("SELECT source, count(n_chars) AS n, " + ", ".join(f"round(quantile_cont(n_chars, {p}), 6) AS p{round(100 * p):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM documents GROUP BY 1")
def a19_quantiles(spark, sf):
    return profile.quantiles(ad.read(spark, sf, "documents"), "n_chars", "source")


@query("SELECT least(ceil((value / 100) / 0.02), 50)::INTEGER AS bin, count(*) AS n FROM events GROUP BY 1")
def a16_fixed_bins(spark, sf):
    return profile.fixed_bins(ad.read(spark, sf, "events").select((F.col("value") / 100).alias("v")), "v", 0.02, 50)


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM c)
SELECT count(*) AS n, round(2 * sum(n * i) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 9) AS gini FROM r""")
def a34_gini(spark, sf):
    return profile.gini(ad.read(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "n")


@query("""SELECT lang, round(-sum(p * log2(p + 1e-12)), 6) AS entropy FROM (SELECT lang, source, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS p FROM documents GROUP BY 1, 2) GROUP BY 1""")
def a35_entropy(spark, sf):
    p = profile.shares(ad.read(spark, sf, "documents"), "lang", "source")
    p = p.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    return p.groupBy("lang").agg(F.round(-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12)), 6).alias("entropy"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem GROUP BY 1")
def a36_correlation(spark, sf):
    return ad.read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"))


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS avg_rank,
  rank() OVER (ORDER BY n) AS min_rank FROM c""")
def w12_average_ranks(spark, sf):
    return profile.average_ranks(ad.read(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "n")


@query(f"""WITH {ad.REPLIES}, r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY time, author, line, part) AS rn, count(*) OVER (PARTITION BY root) AS n_replies,
  min(time) OVER (PARTITION BY root) AS t0 FROM replies), t AS (SELECT root, count(*) AS n_tied FROM r WHERE time = t0 GROUP BY 1)
SELECT root, author AS first_author, n_replies, n_tied, time - root_time AS elapsed FROM r JOIN t USING (root) WHERE rn = 1""")
def w01_first_replies(spark, sf):
    return threads.first_replies(ad.replies(spark, sf))


@query("""WITH c AS (SELECT occurrences, count(*) AS n_texts FROM (SELECT count(*) AS occurrences FROM documents GROUP BY text) GROUP BY 1)
SELECT occurrences, n_texts, round(sum(n_texts) OVER w / sum(n_texts) OVER (), 9) AS text_share, round(sum(occurrences * n_texts) OVER w / sum(occurrences * n_texts) OVER (), 9) AS row_share
FROM c WINDOW w AS (ORDER BY occurrences DESC)""")
def w03_concentration(spark, sf):
    return threads.concentration(ad.read(spark, sf, "documents").select(F.md5("text").alias("t")), "t")


@query("""SELECT md5(text) AS text_md5, count(*) AS occurrences, length(text) AS n_chars, CASE WHEN length(any_value(p)) > 60 THEN left(any_value(p), 60) || '...' ELSE any_value(p) END AS preview
FROM (SELECT text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS p FROM documents) GROUP BY text ORDER BY occurrences DESC, text LIMIT 300""")
def w05_top_texts(spark, sf):
    return threads.top_texts(ad.read(spark, sf, "documents"), "text", 300)


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\s\\x0B\\x{85}\\x{A0}\\x{2028}\\x{2029}]+'), lambda x: x <> '')) AS n FROM documents")
def t01_whitespace_tokens(spark, sf):
    return ad.read(spark, sf, "documents").select("doc_id", F.size(ft.whitespace_tokens(F.col("text"))).cast("long").alias("n"))


@query(f"WITH {ad.TOKENS}, c AS (SELECT doc_id, count(*) AS n, count(DISTINCT term) AS k FROM tokens GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS n_tokens, coalesce(k, 0) AS n_terms, round(coalesce(k, 0) / greatest(coalesce(n, 0), 1), 9) AS ttr FROM documents LEFT JOIN c USING (doc_id)")
def t24_type_token_ratio(spark, sf):
    return text.token_counters(ad.read(spark, sf, "documents"))


@query(f"""WITH {ad.TOKENS}, d AS (SELECT count(DISTINCT doc_id) AS n_docs FROM tokens) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n,
  CASE WHEN count(DISTINCT doc_id) < 5 THEN 'rare' WHEN count(DISTINCT doc_id) > 0.5 * any_value(n_docs) THEN 'common' ELSE 'kept' END AS reason FROM tokens, d GROUP BY 1""")
def t12_vocabulary(spark, sf):
    return text.vocabulary(text.term_counts(ad.read(spark, sf, "documents")))


@query(r"""SELECT md5(trim(regexp_replace(regexp_replace(lower(text), '(https?://|www\.)\S+', ' ', 'gi'), '[^\p{L}]+', ' ', 'g'))) AS form, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def t21_letters_only_copies(spark, sf):
    return ad.read(spark, sf, "documents").groupBy(F.md5(ft.letters_only(F.col("text"))).alias("form")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"""WITH {ad.LABELLINGS}, s AS (SELECT 'all' AS scope, a, b FROM labellings UNION ALL SELECT 'assigned', a, b FROM labellings WHERE a <> -1 AND b <> -1),
t AS (SELECT scope, a, b, count(*) AS n FROM s GROUP BY 1, 2, 3), c AS (SELECT scope, sum(n * (n - 1) / 2) AS cell, sum(n) AS total FROM t GROUP BY 1),
r AS (SELECT scope, sum(m * (m - 1) / 2) AS row_ FROM (SELECT scope, a, sum(n) AS m FROM t GROUP BY 1, 2) GROUP BY 1), k AS (SELECT scope, sum(m * (m - 1) / 2) AS col_ FROM (SELECT scope, b, sum(n) AS m FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT scope, total::BIGINT AS n, round((cell - row_ * col_ / (total * (total - 1) / 2)) / ((row_ + col_) / 2 - row_ * col_ / (total * (total - 1) / 2)), 9) AS ari FROM c JOIN r USING (scope) JOIN k USING (scope)""")
def c13_adjusted_rand(spark, sf):
    return stability.adjusted_rand(ad.labellings(spark, sf))


@query(f"""WITH {ad.LABELLINGS}, x AS (SELECT a, count(*) AS na FROM labellings WHERE a <> -1 GROUP BY 1), y AS (SELECT b, count(*) AS nb FROM labellings WHERE b <> -1 GROUP BY 1),
m AS (SELECT a, b, count(*) AS n FROM labellings WHERE a <> -1 AND b <> -1 GROUP BY 1, 2), j AS (SELECT a, b, n / (na + nb - n) AS j FROM m JOIN x USING (a) JOIN y USING (b)),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS rn FROM j) SELECT x.a, na, coalesce(t.b, -1) AS b, round(coalesce(j, 0), 9) AS jaccard FROM x LEFT JOIN t ON t.a = x.a AND rn = 1""")
def c10_best_match_jaccard(spark, sf):
    return stability.best_match(ad.labellings(spark, sf))


@query(f"""WITH {ad.LABELLINGS} SELECT CASE WHEN a = -1 THEN 'noise' ELSE 'assigned' END AS from_status, CASE WHEN b = -1 THEN 'noise' ELSE 'assigned' END AS to_status, count(*) AS n FROM labellings GROUP BY 1, 2""")
def c14_transitions(spark, sf):
    return stability.transitions(ad.labellings(spark, sf))


@query(f"""WITH {ad.LABELLINGS}, s AS (SELECT count(*) AS m FROM labellings WHERE a <> -1 GROUP BY a), e AS (SELECT count(*) AS n, count(*) FILTER (a = -1) AS noise FROM labellings)
SELECT any_value(n) AS n, count(*) AS clusters, any_value(noise) AS noise, round(100 * any_value(noise) / any_value(n), 4) AS noise_pct, min(m) AS min_size, round(quantile_cont(m, 0.25), 6) AS q1,
  round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(m, 0.75), 6) AS q3, max(m) AS max_size FROM s, e""")
def a29_cluster_summary(spark, sf):
    return stability.cluster_summary(ad.labellings(spark, sf))


@query("SELECT count(*) AS n, count(*) FILTER (len(embedding) = 64) AS right_size, count(*) FILTER (abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) - 1) < 1e-4) AS unit FROM embeddings")
def e08_unit_norms(spark, sf):
    norm = F.expr("aggregate(embedding, 0D, (s, x) -> s + cast(x AS double) * cast(x AS double))")
    return ad.read(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") == 64).alias("right_size"), F.count_if(F.abs(norm - 1) < 1e-4).alias("unit"))


@query(f"WITH {ad.LISTS} SELECT entry, count(DISTINCT list_id) AS n_lists, string_agg(DISTINCT list_id, ';' ORDER BY list_id) AS held_by FROM lists GROUP BY 1")
def a40_list_consensus(spark, sf):
    return lists.consensus(ad.lists(spark, sf))


@query(f"""WITH {ad.LISTS}, s AS (SELECT list_id, count(*) AS n FROM lists GROUP BY 1), b AS (SELECT x.list_id AS list_a, y.list_id AS list_b, count(*) AS shared FROM lists x JOIN lists y ON x.entry = y.entry AND x.list_id < y.list_id GROUP BY 1, 2)
SELECT list_a, list_b, p.n AS na, q.n AS nb, shared, round(shared / (p.n + q.n - shared), 9) AS jaccard, CASE WHEN shared = p.n AND shared = q.n THEN 'identical' WHEN shared = p.n THEN 'a in b' WHEN shared = q.n THEN 'b in a'
  WHEN shared / (p.n + q.n - shared) >= 0.9 THEN 'near-duplicate' ELSE 'distinct' END AS relation FROM b JOIN s p ON p.list_id = list_a JOIN s q ON q.list_id = list_b""")
def k07_pairwise_lists(spark, sf):
    return lists.pairwise(ad.lists(spark, sf))


@query(f"""WITH {ad.LISTS}, e AS (SELECT count(DISTINCT list_id) AS n_lists FROM lists GROUP BY entry), n AS (SELECT n_lists AS t, count(*) AS k FROM e WHERE n_lists >= 2 GROUP BY 1),
d AS (SELECT a.t, sum(b.k)::BIGINT AS size FROM n a JOIN n b ON b.t >= a.t GROUP BY 1)
SELECT x.t AS t1, x.size AS n1, y.t AS t2, y.size AS n2, z.t AS t3, z.size AS n3, round(abs(ln(y.size / x.size) - ln(2)) + abs(ln(z.size / x.size) - ln(4)), 9) AS objective
FROM d x JOIN d y ON x.t > y.t JOIN d z ON y.t > z.t ORDER BY objective, t1 DESC, t2 DESC, t3 DESC LIMIT 1""")
def k04_tier_thresholds(spark, sf):
    return lists.tiers(lists.consensus(ad.lists(spark, sf)))


@query("""SELECT doc_id, 'documents only' AS side FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'labels only' FROM labels ANTI JOIN documents USING (doc_id)""")
def j13_key_sets(spark, sf):
    d, l = (ad.read(spark, sf, t).select("doc_id") for t in ("documents", "labels"))
    return d.join(l, "doc_id", "left_anti").withColumn("side", F.lit("documents only")).unionByName(l.join(d, "doc_id", "left_anti").withColumn("side", F.lit("labels only")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
