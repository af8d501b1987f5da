"""Field profiles, distributions, representatives, chains and term reports, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, text
from ..operators.reports import rows
from ..sources import adapters as ad
from .base import query


@query(r"SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '...' ELSE t END AS preview FROM (SELECT doc_id, regexp_replace(text, '[\n\r\t]', ' ', 'g') AS t FROM documents)")
def p19_value_display(spark, sf):
    return ad.read(spark, sf, "documents").select("doc_id", reports.preview(F.col("text"), 80).alias("preview"))


@query("SELECT event_id, round((epoch_us(ts) / 1000000 - (SELECT epoch(min(ts)::DATE) FROM events)) / 86400, 6) AS day FROM events")
def p09_fractional_days(spark, sf):
    return reports.fractional_days(ad.read(spark, sf, "events"), "event_id", "ts")


@query("""SELECT count(*) AS n, count(*) FILTER (quality IS NOT DISTINCT FROM toxic) AS agree, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)""")
def p14_null_safe_agreement(spark, sf):
    d = ad.read(spark, sf, "documents").select("doc_id").join(ad.read(spark, sf, "labels"), "doc_id", "left")
    return d.agg(rows().alias("n"), F.count_if(F.col("quality").eqNullSafe(F.col("toxic"))).alias("agree"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@query("""SELECT d.day::VARCHAR AS day, k.kind, count(event_id) AS n FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events) d
CROSS JOIN (SELECT DISTINCT event_type AS kind FROM events) k LEFT JOIN events e ON e.ts::DATE = d.day AND e.event_type = k.kind GROUP BY 1, 2""")
def j17_completed_days(spark, sf):
    return reports.completed_days(ad.read(spark, sf, "events"), "ts", "event_type")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def a06_count_by_group(spark, sf):
    return ad.read(spark, sf, "documents").groupBy("lang", "source").agg(rows().alias("n"), F.sum("n_chars").alias("chars"))


@query(f"SELECT len(list_filter({reports.EDGES!r}, lambda e: e <= n_chars))::INTEGER AS bin, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def a15_geometric_bins(spark, sf):
    return reports.geometric_bins(ad.read(spark, sf, "documents"), "n_chars")


@query("SELECT floor(l_quantity / 10)::INTEGER AS quantity_bin, floor(l_extendedprice / 10000)::INTEGER AS price_bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a17_bins_2d(spark, sf):
    bin_ = lambda c, w: F.floor(F.col(c) / w).cast("int")
    return ad.read(spark, sf, "lineitem").groupBy(bin_("l_quantity", 10).alias("quantity_bin"), bin_("l_extendedprice", 10000).alias("price_bin")).agg(rows().alias("n"))


@query("""WITH b AS (SELECT least(greatest(ceil(value * 10), 0), 1001)::INTEGER AS i, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS total FROM b)
SELECT g.i, round(coalesce(sum(b.n), 0) / any_value(total), 9) AS share FROM (SELECT unnest(range(0, 1001))::INTEGER AS i) g CROSS JOIN t LEFT JOIN b ON b.i <= g.i GROUP BY 1""")
def a18_ecdf_grid(spark, sf):
    return reports.ecdf_grid(ad.read(spark, sf, "events").select((F.col("value") * 10).alias("v")), "v", 1000)


@query("SELECT source, min(n_chars) AS least, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS sd, max(n_chars) AS most FROM documents GROUP BY 1")
def a20_moments(spark, sf):
    return ad.read(spark, sf, "documents").groupBy("source").agg(
        F.min("n_chars").alias("least"), F.round(F.avg("n_chars"), 6).alias("mean"), F.round(F.stddev_samp("n_chars"), 6).alias("sd"), F.max("n_chars").alias("most")
    )


@query("""SELECT count(*) AS records, count(*) FILTER (isnan(value) OR isinf(value)) AS nonfinite, count(*) FILTER (value = 0) AS zero, count(*) FILTER (value < 0) AS negative, count(*) FILTER (value > 0) AS positive,
bool_and(value = floor(value)) AS all_integer, count(DISTINCT value) AS n_distinct, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM events""")
def a21_numeric_profile(spark, sf):
    return reports.numeric_profile(ad.read(spark, sf, "events"), "value")


@query("""WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), h AS (SELECT count(DISTINCT hour(ts)) AS hours, min(ts) AS first_at, max(ts) AS last_at FROM events)
SELECT any_value(first_at) AS first_at, any_value(last_at) AS last_at, (max(day) - min(day) + 1)::BIGINT AS days_in_range, count(*) AS days_with, (max(day) - min(day) + 1)::BIGINT - count(*) AS days_without,
min(n) AS least, round(quantile_cont(n, 0.5), 6) AS median, max(n) AS most, any_value(hours) AS hours FROM d, h""")
def a22_datetime_profile(spark, sf):
    return reports.datetime_profile(ad.read(spark, sf, "events"), "ts")


@query(r"""WITH v AS (SELECT text, count(*) AS k FROM documents GROUP BY 1) SELECT sum(k)::BIGINT AS records, coalesce(sum(k) FILTER (text = ''), 0)::BIGINT AS empty, coalesce(sum(k) FILTER (regexp_full_match(text, '\s+')), 0)::BIGINT AS blank,
coalesce(sum(k) FILTER (regexp_matches(text, '^\s|\s$')), 0)::BIGINT AS edge_blank, coalesce(sum(k) FILTER (contains(text, chr(10))), 0)::BIGINT AS with_newline,
count(*) FILTER (k = 1 AND text IS NOT NULL) AS once, count(*) FILTER (k > 1 AND text IS NOT NULL) AS repeated, min(length(text)) AS shortest, max(length(text)) AS longest FROM v""")
def a23_text_profile(spark, sf):
    return reports.text_profile(ad.read(spark, sf, "documents"), "text")


def _classes_sql(columns: list[str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c}) AS n_distinct FROM documents" for c in columns)
    return f"SELECT field, n_distinct, CASE WHEN n_distinct = 0 THEN 'none' WHEN n_distinct = 1 THEN 'constant' WHEN n_distinct <= 20 THEN 'low' ELSE 'high' END AS cardinality FROM ({each})"


@query(_classes_sql(["doc_id", "text", "lang", "source", "n_chars"]))
def a24_cardinality_classes(spark, sf):
    return reports.cardinality_classes(ad.read(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query("""WITH v AS (SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'n_chars', n_chars::VARCHAR, count(*) FROM documents WHERE n_chars IS NOT NULL GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY field) AS values_ FROM v)
SELECT field, value, n, rank::BIGINT AS rank FROM r WHERE values_ <= 20 OR rank <= 10""")
def a25_top_values(spark, sf):
    return reports.top_values(ad.read(spark, sf, "documents"), ["lang", "n_chars"])


@query("""WITH s AS (SELECT lang, l.doc_id IS NOT NULL AS inside FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)), t AS (SELECT count(*) AS n, count(*) FILTER (inside) AS m FROM s)
SELECT lang, count(*) AS n_all, count(*) FILTER (inside) AS n_subset, round(100 * count(*) FILTER (inside) / any_value(m) - 100 * count(*) / any_value(n), 6) AS points, round(count(*) FILTER (inside) / count(*), 9) AS retention
FROM s, t GROUP BY 1""")
def a27_coverage_retention(spark, sf):
    inside = ad.read(spark, sf, "labels").select("doc_id").distinct().withColumn("inside", F.lit(True))
    return reports.retention(ad.read(spark, sf, "documents").join(inside, "doc_id", "left").select("lang", F.coalesce("inside", F.lit(False)).alias("inside")), "lang")


@query("WITH g AS (SELECT embedding, count(*) AS k FROM embeddings GROUP BY 1) SELECT sum(k)::BIGINT AS n, count(*) AS n_unique, count(*) FILTER (k > 1) AS tied_groups, coalesce(sum(k) FILTER (k > 1), 0)::BIGINT AS rows_in_ties, max(k) AS largest FROM g")
def a28_vector_census(spark, sf):
    k = ad.read(spark, sf, "embeddings").groupBy("embedding").agg(rows().alias("k"))
    tied = F.when(F.col("k") > 1, F.col("k"))
    return k.agg(F.sum("k").alias("n"), rows().alias("n_unique"), F.count(tied).alias("tied_groups"), F.coalesce(F.sum(tied), F.lit(0)).alias("rows_in_ties"), F.max("k").alias("largest"))


@query("SELECT l_returnflag, round(min(l_discount), 6) AS least, round(avg(l_discount), 6) AS mean, round(max(l_discount), 6) AS most, count(*) FILTER (l_discount = 0) AS zeros, count(*) FILTER (l_discount = 1) AS ones FROM lineitem GROUP BY 1")
def a30_probability_summary(spark, sf):
    p = F.col("l_discount")
    return ad.read(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.min(p), 6).alias("least"), F.round(F.avg(p), 6).alias("mean"), F.round(F.max(p), 6).alias("most"), F.count_if(p == 0).alias("zeros"), F.count_if(p == 1).alias("ones")
    )


@query("SELECT source, count(DISTINCT lang) + (count(*) FILTER (lang IS NULL) > 0)::BIGINT AS n_langs FROM documents GROUP BY 1")
def a31_distinct_with_null(spark, sf):
    return ad.read(spark, sf, "documents").groupBy("source").agg((F.count_distinct("lang") + F.max(F.col("lang").isNull().cast("long"))).alias("n_langs"))


@query("""WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS i FROM c)
SELECT event_type, user_id AS top_author, n FROM r WHERE i = 1""")
def a32_top_author(spark, sf):
    c = ad.read(spark, sf, "events").groupBy("event_type", "user_id").agg(rows().alias("n"))
    best = F.max(F.struct("n", F.negative("user_id").alias("u"))).alias("b")
    return c.groupBy("event_type").agg(best).select("event_type", F.negative("b.u").alias("top_author"), F.col("b.n").alias("n"))


@query("SELECT l_shipdate::DATE::VARCHAR AS day, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS weighted FROM lineitem GROUP BY 1")
def a33_weighted_means(spark, sf):
    w = F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")
    return ad.read(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(F.round(w, 9).alias("weighted"))


@query(f"""WITH {ad.TOKENS}, c AS (SELECT doc_id, count(*) AS k FROM tokens GROUP BY 1), d AS (SELECT lang, coalesce(k, 0) AS k FROM documents LEFT JOIN c USING (doc_id))
SELECT lang, '1 all' AS stage, count(*) AS documents, sum(k)::BIGINT AS tokens FROM d GROUP BY 1 UNION ALL SELECT lang, '2 with tokens', count(*) FILTER (k > 0), coalesce(sum(k) FILTER (k > 0), 0)::BIGINT FROM d GROUP BY 1
UNION ALL SELECT lang, '3 at least 25', count(*) FILTER (k >= 25), coalesce(sum(k) FILTER (k >= 25), 0)::BIGINT FROM d GROUP BY 1""")
def a39_accounting(spark, sf):
    k = ad.tokens(spark, sf).groupBy("doc_id").agg(rows().alias("k"))
    d = ad.read(spark, sf, "documents").select("doc_id", "lang").join(k, "doc_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return reports.accounting(d, "lang", "k", {"1 all": 0, "2 with tokens": 1, "3 at least 25": 25})


@query("""WITH q AS (SELECT lang, unnest([5, 25, 50, 75, 95]) AS p, unnest([quantile_cont(n_chars, 0.05), quantile_cont(n_chars, 0.25), quantile_cont(n_chars, 0.5), quantile_cont(n_chars, 0.75), quantile_cont(n_chars, 0.95)]) AS target
FROM documents WHERE n_chars > 0 GROUP BY lang), r AS (SELECT d.lang, p, doc_id, n_chars, row_number() OVER (PARTITION BY d.lang, p ORDER BY round(abs(n_chars - target), 6), doc_id) AS rank FROM documents d JOIN q ON q.lang = d.lang WHERE n_chars > 0)
SELECT lang, p, rank::BIGINT AS rank, doc_id, n_chars FROM r WHERE rank <= 3""")
def w06_quantile_representatives(spark, sf):
    return reports.representatives(ad.read(spark, sf, "documents").where("n_chars > 0"), "lang", "n_chars", "doc_id", 3)


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS b FROM documents WHERE n_chars >= 25)
SELECT lang, doc_id, n_chars FROM t WHERE a = 1 AND b = 1""")
def w07_representative_documents(spark, sf):
    return reports.first_of_both(ad.read(spark, sf, "documents").where("n_chars >= 25").withColumn("form", F.md5("text")), "lang", "form", "source", "n_chars", "doc_id")


@query("""WITH n AS (SELECT lang, doc_id, n_chars, md5(lower(text)) AS form FROM documents WHERE text IS NOT NULL)
SELECT lang, doc_id, row_number() OVER (PARTITION BY lang, form ORDER BY n_chars DESC, doc_id) > 1 AS near_duplicate FROM n""")
def w09_lower_ranked_copies(spark, sf):
    d = ad.read(spark, sf, "documents").where("text IS NOT NULL").select("lang", "doc_id", "n_chars", F.md5(F.lower("text")).alias("form"))
    return reports.lower_ranked_copies(d, ["lang", "form"], "n_chars", "doc_id")


@query("""WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS run, sum(n) OVER (PARTITION BY event_type) AS total FROM d WINDOW w AS (PARTITION BY event_type ORDER BY n DESC, day))
SELECT event_type, any_value(day) FILTER (i = 1)::VARCHAR AS peak_day, sum(n) FILTER (i <= 3)::BIGINT AS top3, min(i) FILTER (2 * run >= total)::BIGINT AS days_to_half FROM r GROUP BY 1""")
def w15_peak_days(spark, sf):
    d = ad.read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(rows().alias("n"))
    return reports.peaks(d, "event_type", "day", "n")


@query(f"""WITH {ad.TOKENS}, c AS (SELECT term, count(*) AS n FROM tokens GROUP BY 1), r AS (SELECT n, row_number() OVER w AS i, sum(n) OVER w AS run, sum(n) OVER () AS total FROM c WINDOW w AS (ORDER BY n DESC, term))
SELECT any_value(total)::BIGINT AS total, round(sum(n) FILTER (i <= 10) / any_value(total), 9) AS top10, round(sum(n) FILTER (i <= 50) / any_value(total), 9) AS top50, round(sum(n) FILTER (i <= 200) / any_value(total), 9) AS top200,
min(i) FILTER (2 * run >= total)::BIGINT AS terms_to_half FROM r""")
def w16_term_mass(spark, sf):
    return reports.mass(ad.tokens(spark, sf).groupBy("term").agg(rows().alias("n")), "n")


@query("SELECT lang, count(DISTINCT source) AS n_sources, count(DISTINCT (source, n_chars)) AS n_pairs FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1")
def x04_distinct_pairs(spark, sf):
    d = ad.read(spark, sf, "documents").where("source IS NOT NULL AND n_chars IS NOT NULL").select("lang", "source", "n_chars").dropDuplicates()
    return d.groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), rows().alias("n_pairs"))


@query("SELECT count(*) AS n_in_both FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')")
def x02_authors_in_both(spark, sf):
    e = ad.read(spark, sf, "events")
    one, two = (e.where(F.col("event_type") == k).select("user_id") for k in ("click", "purchase"))
    return one.intersect(two).agg(rows().alias("n_in_both"))


@query("SELECT kind, count(*) AS n, count(n_chars) AS with_length FROM (SELECT 'document' AS kind, text, n_chars FROM documents UNION ALL BY NAME SELECT 'message' AS kind, text FROM conversations) GROUP BY 1")
def x01_union_by_name(spark, sf):
    d = ad.read(spark, sf, "documents").select(F.lit("document").alias("kind"), "text", "n_chars")
    both = d.unionByName(ad.read(spark, sf, "conversations").select(F.lit("message").alias("kind"), "text"), allowMissingColumns=True)
    return both.groupBy("kind").agg(rows().alias("n"), F.count("n_chars").alias("with_length"))


@query(f"""WITH {ad.LISTS}, s AS (SELECT list_id, count(*) AS n FROM lists GROUP BY 1), e AS (SELECT entry, min(n) AS least FROM lists JOIN s USING (list_id) GROUP BY 1)
SELECT list_id, any_value(n) AS n, count(*) FILTER (n = least) AS beyond_smaller FROM lists JOIN s USING (list_id) JOIN e USING (entry) GROUP BY 1""")
def x06_words_beyond_smaller_lists(spark, sf):
    return reports.beyond_smaller(ad.lists(spark, sf))


@query(f"WITH {ad.TOKENS} SELECT doc_id, term, count(*) AS n FROM tokens GROUP BY 1, 2")
def t13_document_terms(spark, sf):
    return text.term_counts(ad.read(spark, sf, "documents")).select("doc_id", F.inline("cells"))


@query(f"WITH {ad.TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM tokens GROUP BY 1 ORDER BY df DESC, term LIMIT 50")
def t17_top_terms(spark, sf):
    return text.vocabulary(text.term_counts(ad.read(spark, sf, "documents"))).select("term", "df").orderBy(F.desc("df"), "term").limit(50)


@query(f"""WITH {ad.TOKENS}, t AS (SELECT term, count(DISTINCT doc_id) AS df, bool_or(lang = 'en') AS a, bool_or(lang <> 'en') AS b FROM tokens WHERE lang IS NOT NULL GROUP BY 1)
SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'en only' ELSE 'others only' END AS origin, count(*) AS n_terms, count(*) FILTER (df = 1) AS once FROM t GROUP BY 1""")
def t18_vocabulary_origin(spark, sf):
    return reports.vocabulary_origin(ad.tokens(spark, sf).where("lang IS NOT NULL"), F.col("lang") == "en", "en only", "others only")
