"""Tokens, vocabularies, similarities and topic reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import corpus, text, topics
from ..operators.reports import rows
from ..sources import adapters as ad
from ..sources.scratch import cut, stored
from .base import query
from .events import events

STOP_LIST = ", ".join(f"'{w}'" for w in corpus.STOP)
#: Letter runs of the events' texts, step by step: raw (possessives on) and term (off).
ETOKENS = ad.EVENTS + r""", cleaned AS (SELECT doc_key, record_type, text, regexp_replace(replace(lower(text), chr(8217), ''''), '(https?://|www\.)\S+', ' ', 'gi') AS t FROM events_),
etokens AS (SELECT doc_key, record_type, raw, regexp_replace(raw, '''s$', '') AS term FROM (SELECT doc_key, record_type, unnest(regexp_extract_all(t, '(\p{L}+(?:''\p{L}+)*)', 1)) AS raw FROM cleaned)),
marked AS (SELECT doc_key, record_type, coalesce(regexp_replace(text, '^\s+|\s+$', '', 'g') IN ('[deleted]', '[removed]', '[ Removed by Reddit ]'), false) AS marker_only FROM events_),
candidates AS (SELECT e.doc_key, e.record_type, term, marker_only FROM etokens e JOIN marked USING (doc_key) WHERE length(term) >= 2 AND term NOT IN (""" + STOP_LIST + r""")),
vocab AS (SELECT term, count(DISTINCT doc_key) AS df, count(*) AS tf, CASE WHEN count(DISTINCT doc_key) < 5 THEN 'rare' WHEN count(DISTINCT doc_key) > 0.5 * (SELECT count(*) FROM marked WHERE NOT marker_only) THEN 'common' ELSE 'kept' END AS reason FROM candidates WHERE NOT marker_only GROUP BY 1),
counters AS (SELECT m.doc_key, m.record_type, marker_only, coalesce(letters, 0) AS n_letters, coalesce(short, 0) AS n_short, coalesce(stop, 0) AS n_stop, coalesce(candidate, 0) AS n_candidate, coalesce(modeled, 0) AS n_modeled FROM marked m
  LEFT JOIN (SELECT doc_key, count(*) AS letters, count(*) FILTER (length(term) < 2) AS short, count(*) FILTER (length(term) >= 2 AND term IN (""" + STOP_LIST + r""")) AS stop FROM etokens GROUP BY 1) USING (doc_key)
  LEFT JOIN (SELECT doc_key, count(*) AS candidate FROM candidates GROUP BY 1) USING (doc_key) LEFT JOIN (SELECT doc_key, count(*) AS modeled FROM candidates JOIN vocab USING (term) WHERE reason = 'kept' AND NOT marker_only GROUP BY 1) USING (doc_key))"""


def _counters(spark, sf):
    return corpus.counters(events(spark, sf).select("doc_key", "record_type", "text"))


@query(f"WITH {ETOKENS} SELECT doc_key, n_letters - n_short - n_stop AS n_left, n_stop FROM counters")
def t08_stopword_filter(spark, sf):
    c = corpus.token_steps(events(spark, sf).select("doc_key", "record_type", "text"))
    return c.select("doc_key", F.size("candidates").cast("long").alias("n_left"), F.col("n_stop"))


@query(f"WITH {ETOKENS} SELECT record_type, count(*) FILTER (marker_only) AS marker_documents, coalesce(sum(n_candidate) FILTER (marker_only), 0)::BIGINT AS tokens_in_them, coalesce(sum(n_candidate) FILTER (NOT marker_only), 0)::BIGINT AS tokens_left FROM counters GROUP BY 1")
def t09_marker_exclusion(spark, sf):
    c = corpus.token_steps(events(spark, sf).select("doc_key", "record_type", "text")).withColumn("n", F.size("candidates"))
    held = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0))
    return c.groupBy("record_type").agg(F.count_if("marker_only").alias("marker_documents"), held(F.col("marker_only")).alias("tokens_in_them"), held(~F.col("marker_only")).alias("tokens_left"))


@query(f"WITH {ETOKENS} SELECT doc_key, n_letters, n_short, n_stop, n_candidate, n_modeled, CASE WHEN marker_only THEN 0 ELSE n_candidate - n_modeled END AS n_rare, CASE WHEN marker_only THEN n_candidate ELSE 0 END AS n_excluded FROM counters")
def t10_token_counters(spark, sf):
    return _counters(spark, sf).select("doc_key", "n_letters", "n_short", "n_stop", "n_candidate", "n_modeled", "n_rare", "n_excluded")


@query(f"""WITH {ETOKENS} SELECT doc_key, CASE WHEN marker_only THEN 'not modeled: marker only' WHEN n_letters = 0 THEN 'not modeled: no letters' WHEN n_candidate = 0 THEN 'not modeled: short or stopwords' WHEN n_modeled = 0 THEN 'not modeled: outside the vocabulary'
  ELSE 'modeled' END AS model_status FROM counters""")
def p17_model_status(spark, sf):
    return _counters(spark, sf).select("doc_key", corpus.model_status().alias("model_status"))


@query(rf"""WITH {ETOKENS}, cased AS (SELECT unnest(regexp_extract_all(regexp_replace(replace(text, chr(8217), ''''), '(https?://|www\.)\S+', ' ', 'gi'), '(\p{{L}}+(?:''\p{{L}}+)*)', 1)) AS w FROM events_)
SELECT (SELECT count(DISTINCT w) FROM cased) AS distinct_cased, (SELECT count(DISTINCT raw) FROM etokens) AS distinct_folded, (SELECT count(DISTINCT term) FROM etokens) AS distinct_without_possessive, (SELECT count(*) FROM etokens WHERE ends_with(raw, '''s')) AS possessives,
  (SELECT sum(len(regexp_extract_all(t, '\S+')))::BIGINT FROM cleaned) AS whitespace_tokens, (SELECT sum(len(regexp_extract_all(t, '\S*\d\S*')))::BIGINT FROM cleaned) AS digit_tokens""")
def t11_steps_not_taken(spark, sf):
    return corpus.steps_not_taken(events(spark, sf).select("text"))


@query(f"WITH {ETOKENS} SELECT s.entry, count(c.raw) AS n_all, count(c.raw) FILTER (NOT marker_only) AS n_without_markers FROM (SELECT unnest([{STOP_LIST}]) AS entry) s LEFT JOIN (SELECT term, raw, marker_only FROM etokens JOIN marked USING (doc_key)) c ON c.term = s.entry GROUP BY 1")
def a38_stopword_occurrences(spark, sf):
    return corpus.occurrences(events(spark, sf).select("doc_key", "record_type", "text"), corpus.STOP)


ITEMS = ["of", "and", "is", "nosuchword"]


@query(f"""WITH {ETOKENS}, n AS (SELECT term, count(*) AS n FROM etokens GROUP BY 1), a AS (SELECT unnest([{STOP_LIST}]) AS item), b AS (SELECT unnest({ITEMS!r}) AS item), ra AS (SELECT item, coalesce(n, 0) AS n FROM a LEFT JOIN n ON term = item), rb AS (SELECT item, coalesce(n, 0) AS n FROM b LEFT JOIN n ON term = item)
SELECT coalesce(ra.item, rb.item) AS item, ra.n AS under_first, rb.n AS under_second, ra.item IS NOT NULL AND rb.item IS NOT NULL AS comparable FROM ra FULL JOIN rb ON ra.item = rb.item""")
def l24_two_conditions(spark, sf):
    e = events(spark, sf).select("doc_key", "record_type", "text")
    return corpus.conditions(corpus.occurrences(e, corpus.STOP), corpus.occurrences(e, ITEMS))


# --- similarity of comments and their submissions ---------------------------------------

WTOKENS = ad.EVENTS + r""", wtokens AS (SELECT doc_key, thread_id, is_thread_root, term FROM (SELECT doc_key, thread_id, is_thread_root, unnest(regexp_split_to_array(text, '[\s\x0B\x{85}\x{A0}\x{2028}\x{2029}]+')) AS term FROM events_) WHERE term <> ''),
wd AS (SELECT count(DISTINCT doc_key) AS n_docs FROM wtokens), wtf AS (SELECT doc_key, term, count(*) AS tf FROM wtokens GROUP BY 1, 2), wdf AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM wtf GROUP BY 1), ww AS (SELECT doc_key, term, tf, df, tf * ln(n_docs / df) AS w FROM wtf JOIN wdf USING (term), wd),
norms AS (SELECT doc_key, sqrt(sum(w * w)) AS norm FROM ww GROUP BY 1), wp AS (SELECT c.doc_key, s.doc_key AS other FROM events_ c JOIN events_ s ON s.doc_key = c.thread_id AND s.is_thread_root WHERE NOT c.is_thread_root),
shared AS (SELECT p.doc_key, p.other, a.term, a.tf AS count_comment, b.tf AS count_submission, a.w * b.w AS contribution FROM wp p JOIN ww a ON a.doc_key = p.doc_key JOIN ww b ON b.doc_key = p.other AND b.term = a.term),
sims AS (SELECT p.doc_key, p.other, CASE WHEN a.norm * b.norm > 0 THEN round(coalesce(dot, 0) / (a.norm * b.norm), 6) END AS cosine, CASE WHEN a.norm * b.norm > 0 THEN 'scored' ELSE 'no weight' END AS status
  FROM wp p LEFT JOIN (SELECT doc_key, other, sum(contribution) AS dot FROM shared GROUP BY 1, 2) x ON x.doc_key = p.doc_key AND x.other = p.other LEFT JOIN norms a ON a.doc_key = p.doc_key LEFT JOIN norms b ON b.doc_key = p.other),
lens AS (SELECT doc_key, count(*) AS n FROM wtokens GROUP BY 1)"""


def _wtokens(spark, sf):
    e = events(spark, sf).select("doc_key", "thread_id", "is_thread_root", "text")
    return e.select(F.col("doc_key").alias("doc_id"), F.explode(ft.whitespace_tokens(F.col("text"))).alias("term"))


def _pairs(spark, sf):
    e = events(spark, sf).select("doc_key", "thread_id", "is_thread_root")
    s = e.where("is_thread_root").select("thread_id", F.col("doc_key").alias("other"))
    return cut(e.where("NOT is_thread_root").join(s, "thread_id").select(F.col("doc_key").alias("doc_id"), "other"))


@query(f"WITH {WTOKENS} SELECT doc_key, other, cosine, status FROM sims")
def t15_cosine_with_root(spark, sf):
    return text.cosine_with(text.tf_idf(_wtokens(spark, sf)), _pairs(spark, sf)).withColumnRenamed("doc_id", "doc_key")


@query(f"""WITH {WTOKENS} SELECT doc_key, other, term, count_comment, count_submission, round(contribution, 6) AS contribution, round(contribution / sum(contribution) OVER (PARTITION BY doc_key), 6) AS share FROM shared WHERE contribution > 0
QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY round(contribution, 6) DESC, term) <= 10""")
def t16_shared_terms(spark, sf):
    return corpus.shared_terms(text.counted(_wtokens(spark, sf)), _pairs(spark, sf), 10).withColumnRenamed("doc_id", "doc_key")


@query(f"""WITH {WTOKENS} SELECT s.doc_key, other, cosine, status, title IS NOT NULL AS has_title, score, num_comments FROM sims s LEFT JOIN (SELECT doc_key AS k, title, score, num_comments FROM events_ WHERE is_thread_root) e ON e.k = s.other""")
def j07_similarity_attributes(spark, sf):
    s = text.cosine_with(text.tf_idf(_wtokens(spark, sf)), _pairs(spark, sf))
    e = events(spark, sf).where("is_thread_root").select(F.col("doc_key").alias("other"), F.col("title").isNotNull().alias("has_title"), "score", "num_comments")
    return s.join(e, "other", "left").select(F.col("doc_id").alias("doc_key"), "other", "cosine", "status", "has_title", "score", "num_comments")


_BANDS = " ".join(f"WHEN n <= {t} THEN '{b}'" for t, b in corpus.LENGTH_BANDS)


@query(f"""WITH {WTOKENS}, x AS (SELECT CASE {_BANDS} ELSE '201+' END AS band, cosine FROM sims JOIN lens USING (doc_key) WHERE cosine IS NOT NULL)
SELECT band, count(*) AS comments, round(avg((cosine = 0)::INTEGER), 9) AS share_zero, round(quantile_cont(cosine, 0.25), 6) AS p25, round(quantile_cont(cosine, 0.5), 6) AS median, round(avg(cosine), 6) AS mean, round(quantile_cont(cosine, 0.75), 6) AS p75, max(cosine) AS most FROM x GROUP BY 1""")
def t20_similarity_by_length(spark, sf):
    tokens = cut(_wtokens(spark, sf))
    return corpus.by_length(text.cosine_with(text.tf_idf(tokens), _pairs(spark, sf)), tokens.groupBy("doc_id").agg(rows().alias("n")))


@query(f"""WITH {WTOKENS}, q AS (SELECT unnest([5, 50, 95]) AS p, unnest([quantile_cont(cosine, 0.05), quantile_cont(cosine, 0.5), quantile_cont(cosine, 0.95)]) AS target FROM sims WHERE cosine > 0), r AS (SELECT p, doc_key, cosine, row_number() OVER (PARTITION BY p ORDER BY round(abs(cosine - target), 6), doc_key) AS rank
FROM sims, q WHERE cosine > 0) SELECT p, rank::BIGINT AS rank, doc_key, cosine FROM r WHERE rank <= 3""")
def j14_nearest_to_targets(spark, sf):
    s = text.cosine_with(text.tf_idf(_wtokens(spark, sf)), _pairs(spark, sf)).where("cosine > 0")
    return corpus.nearest_to(cut(s), "cosine", "doc_id", (5, 50, 95), 3).withColumnRenamed("doc_id", "doc_key")


@query(rf"""WITH {WTOKENS}, v AS (SELECT term, regexp_replace(term, '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g') AS bare, df FROM wdf)
SELECT count(*) AS terms, count(*) FILTER (df = 1) AS in_one_document, count(*) FILTER (regexp_matches(term, '^https?://')) AS addresses, count(*) FILTER (regexp_matches(term, '^[\p{{P}}\p{{S}}]|[\p{{P}}\p{{S}}]$')) AS edge_punctuation,
  count(*) FILTER (regexp_matches(term, '\p{{Lu}}')) AS with_upper_case, count(DISTINCT lower(term)) AS folded, count(DISTINCT bare) AS stripped, count(DISTINCT lower(bare)) AS both FROM v""")
def t19_vocabulary_what_if(spark, sf):
    return corpus.vocabulary_what_if(text.counted(_wtokens(spark, sf))[1])


WORDS = ["the", "der", "la", "is"]


@query(f"WITH {ad.TOKENS} SELECT w AS word, count(t.term) AS occurrences, count(DISTINCT doc_id) AS documents FROM (SELECT unnest({WORDS!r}) AS w) x LEFT JOIN tokens t ON t.term = w GROUP BY 1")
def t22_whole_words(spark, sf):
    return corpus.whole_words(ad.read(spark, sf, "documents"), WORDS)


@query(r"SELECT doc_id, CASE WHEN length(p) > 160 THEN left(p, 160) || '...' ELSE p END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM documents)")
def t23_previews(spark, sf):
    p = F.trim(F.regexp_replace("text", r"\s+", " "))
    return ad.read(spark, sf, "documents").select("doc_id", F.when(F.length(p) > 160, F.concat(F.substring(p, 1, 160), F.lit("..."))).otherwise(p).alias("preview"))


_TOKEN_BANDS = " ".join(f"WHEN n <= {t} THEN '{b}'" for t, b in topics.BANDS)


@query(f"""WITH {ad.TOKENS}, c AS (SELECT doc_id, lang, count(*) AS n FROM tokens GROUP BY 1, 2), b AS (SELECT lang, CASE {_TOKEN_BANDS} ELSE '100+' END AS band, count(*) AS docs FROM c GROUP BY 1, 2)
SELECT lang, band, docs, round(docs / sum(docs) OVER (PARTITION BY lang), 9) AS share FROM b""")
def t25_token_bands(spark, sf):
    c = corpus.sizes(ad.read(spark, sf, "documents")).where("n > 0").groupBy("lang", topics.token_band(F.col("n")).alias("band")).agg(rows().alias("docs"))
    return c.withColumn("share", F.round(F.col("docs") / F.sum("docs").over(Window.partitionBy("lang")), 9))


@query(f"""WITH {ad.TOKENS}, c AS (SELECT doc_id, lang, count(*) AS n FROM tokens GROUP BY 1, 2) SELECT lang, count(*) AS docs, sum(n)::BIGINT AS tokens, min(n) AS least, round(quantile_cont(n, 0.05), 6) AS p05, round(quantile_cont(n, 0.5), 6) AS median,
  round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most FROM c GROUP BY 1""")
def t25_length_summary(spark, sf):
    n = F.col("n")
    return corpus.sizes(ad.read(spark, sf, "documents")).where("n > 0").groupBy("lang").agg(
        rows().alias("docs"), F.sum(n).alias("tokens"), F.min(n).alias("least"), F.round(F.percentile(n, 0.05), 6).alias("p05"), F.round(F.percentile(n, 0.5), 6).alias("median"), F.round(F.avg(n), 6).alias("mean"),
        F.round(F.percentile(n, 0.95), 6).alias("p95"), F.max(n).alias("most"),
    )


@query("SELECT count(*) AS documents, 0::BIGINT AS differ FROM documents")
def t30_second_tokenizer(spark, sf):
    return corpus.second_path(ad.read(spark, sf, "documents"))


# --- topics --------------------------------------------------------------------------------


def _fit(k: int, m: int, name: str = "") -> str:
    a = topics.ALPHA_SUM / k
    return f""", asg{name} AS (SELECT doc_id, term, n, (length(term) + doc_id % {m}) % {k} AS k FROM cells), theta{name} AS (SELECT d.doc_id, ks.k, d.nd, (coalesce(a.n, 0) + {a}::DOUBLE) / (d.nd + {k} * {a}::DOUBLE) AS share FROM dlen d CROSS JOIN (SELECT unnest(range({k})) AS k) ks
  LEFT JOIN (SELECT doc_id, k, sum(n) AS n FROM asg{name} GROUP BY 1, 2) a ON a.doc_id = d.doc_id AND a.k = ks.k),
mass{name} AS (SELECT ks.k, coalesce(nk, 0) AS nk, coalesce(nk, 0) + (SELECT count(DISTINCT term) FROM cells) * 0.01::DOUBLE AS z FROM (SELECT unnest(range({k})) AS k) ks LEFT JOIN (SELECT k, sum(n) AS nk FROM asg{name} GROUP BY 1) USING (k)),
phi{name} AS (SELECT k, term, x.n, (x.n + 0.01::DOUBLE) / z AS p, 0.01::DOUBLE / z AS floor FROM (SELECT k, term, sum(n) AS n FROM asg{name} GROUP BY 1, 2) x JOIN mass{name} USING (k)),
dense{name} AS (SELECT m.k, t.term, coalesce(p.p, 0.01::DOUBLE / z) AS p FROM mass{name} m CROSS JOIN (SELECT DISTINCT term FROM cells) t LEFT JOIN phi{name} p ON p.k = m.k AND p.term = t.term),
top{name} AS (SELECT k, term, p, round(ln(p), 9) AS score, row_number() OVER (PARTITION BY k ORDER BY round(ln(p), 9) DESC, term) AS rank FROM phi{name}),
dom{name} AS (SELECT doc_id, nd, k, share, n_active FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, k) AS rn, count(*) FILTER (share >= 0.1) OVER (PARTITION BY doc_id) AS n_active FROM theta{name}) WHERE rn = 1)"""


CELLS = ad.TOKENS + ", cells AS (SELECT doc_id, term, count(*) AS n FROM tokens GROUP BY 1, 2), dlen AS (SELECT doc_id, sum(n) AS nd FROM cells GROUP BY 1)"
ONE, TWO = CELLS + _fit(6, 3), CELLS + _fit(6, 3) + _fit(4, 2, "2")


def _documents(spark, sf):
    return stored(text.term_counts(ad.read(spark, sf, "documents")), "documents")


def _sizes(docs):
    return docs.select("doc_id", F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("n"))


def model(spark, sf, k: int = 6, m: int = 3, docs=None) -> topics.Model:
    """A fit in place of a sampler's: a token's topic follows from its length and its document. docs: the documents' counts, where another fit has them."""
    topic = lambda c: ((F.length(c["term"]) + F.col("doc_id") % m) % k).cast("int")
    cells = F.transform("cells", lambda c: F.struct(c["term"].alias("term"), topic(c).alias("k"), c["n"].alias("n")))
    return topics.Model((_documents(spark, sf) if docs is None else docs).select("doc_id", cells.alias("cells")), k)


def two_models(spark, sf, k: int = 4, m: int = 2) -> tuple[topics.Model, topics.Model]:
    docs = _documents(spark, sf)
    return model(spark, sf, docs=docs), model(spark, sf, k, m, docs)


@query(f"WITH {ONE} SELECT doc_id, k::INTEGER AS k, round(share, 9) AS share FROM theta")
def l04_smoothed_theta(spark, sf):
    return model(spark, sf).theta.select("doc_id", "k", F.round("share", 9).alias("share"))


@query(f"WITH {ONE} SELECT k::INTEGER AS k, term, round(p, 12) AS p FROM phi")
def l04_smoothed_phi(spark, sf):
    return model(spark, sf).phi.select("k", "term", F.round("p", 12).alias("p"))


@query(f"""WITH {ONE}, x AS (SELECT c.doc_id, c.term, c.n, sum(t.share * d.p) AS p FROM cells c JOIN theta t ON t.doc_id = c.doc_id JOIN dense d ON d.k = t.k AND d.term = c.term GROUP BY 1, 2, 3)
SELECT round(sum(n * ln(p)), 3) AS loglik, sum(n)::BIGINT AS tokens, round(exp(-sum(n * ln(p)) / sum(n)), 6) AS perplexity FROM x""")
def l05_perplexity(spark, sf):
    return topics.perplexity(model(spark, sf))


@query(f"""WITH {ONE}, pw AS (SELECT term, sum(n) / (SELECT sum(n) FROM cells) AS pw FROM cells GROUP BY 1), s AS (SELECT k, term, round(ln(p), 9) AS a, round(0.6 * ln(p) + 0.4 * ln(p / pw), 9) AS b FROM phi JOIN pw USING (term))
SELECT 'probability' AS ranking, k::INTEGER AS k, term, row_number() OVER (PARTITION BY k ORDER BY a DESC, term) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY a DESC, term) <= 20
UNION ALL SELECT 'relevance', k::INTEGER, term, row_number() OVER (PARTITION BY k ORDER BY b DESC, term) FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY b DESC, term) <= 20""")
def l06_word_rankings(spark, sf):
    m = model(spark, sf)
    one, two = (topics.ranked_words(m, 20, w).select(F.lit(n).alias("ranking"), "k", "term", F.col("rank").cast("long").alias("rank")) for n, w in (("probability", 1.0), ("relevance", 0.6)))
    return one.unionByName(two)


@query(f"""WITH {ONE}, tt AS (SELECT k, rank, term FROM top WHERE rank <= 10), nd AS (SELECT count(*) AS d FROM dlen), h AS (SELECT DISTINCT doc_id, term FROM cells WHERE term IN (SELECT term FROM tt)), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
co AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM h x JOIN h y ON x.doc_id = y.doc_id GROUP BY 1, 2), p AS (SELECT a.k, coalesce(co.n, 0) AS n, fa.df AS da, fb.df AS db, d FROM tt a JOIN tt b ON a.k = b.k AND a.rank > b.rank JOIN df fa ON fa.term = a.term JOIN df fb ON fb.term = b.term
  LEFT JOIN co ON co.a = a.term AND co.b = b.term, nd)
SELECT k::INTEGER AS k, round(avg(ln((n + 1) / db)), 6) AS umass, round(avg(CASE WHEN n = 0 THEN -1 WHEN n >= d THEN 1 ELSE ln((n / d) / ((da / d) * (db / d))) / -ln(n / d) END), 6) AS npmi FROM p GROUP BY 1""")
def l07_coherence(spark, sf):
    return topics.coherence(model(spark, sf))


@query(f"WITH {ONE}, e AS (SELECT term, sum(p) AS s FROM dense GROUP BY 1) SELECT k::INTEGER AS k, round(avg(p / s), 6) AS exclusivity FROM top JOIN e USING (term) WHERE rank <= 10 GROUP BY 1")
def l08_exclusivity(spark, sf):
    return topics.exclusivity(model(spark, sf))


WORD_PAIRS = """, sq AS (SELECT k, sum(p * p) AS s FROM dense GROUP BY 1), wp AS (SELECT x.k AS a, y.k AS b, round(sum(x.p * y.p) / sqrt(any_value(p.s) * any_value(q.s)), 6) AS cosine, round(sum((x.p - y.p) * (ln(x.p) - ln(y.p))) / 2, 6) AS symmetric_kl
  FROM dense x JOIN dense y ON x.term = y.term AND x.k < y.k JOIN sq p ON p.k = x.k JOIN sq q ON q.k = y.k GROUP BY 1, 2)"""


@query(f"WITH {ONE}{WORD_PAIRS} SELECT round(avg(cosine), 6) AS mean_cosine, round(avg(symmetric_kl), 6) AS mean_symmetric_kl FROM wp")
def l09_separation(spark, sf):
    return topics.word_pairs(model(spark, sf)).agg(F.round(F.avg("cosine"), 6).alias("mean_cosine"), F.round(F.avg("symmetric_kl"), 6).alias("mean_symmetric_kl"))


@query("")
def l09_arun(spark, sf):
    return spark.createDataFrame([(topics.arun(model(spark, sf)),)], "arun double")


@query(f"WITH {ONE}{WORD_PAIRS} SELECT a::INTEGER AS a, b::INTEGER AS b, cosine, symmetric_kl FROM wp")
def l17_topic_word_pairs(spark, sf):
    return topics.word_pairs(model(spark, sf))


TOGETHER = """, co AS (SELECT x.k AS a, y.k AS b, round(corr(x.share, y.share), 6) AS correlation, round(count(*) FILTER (x.share >= 0.1 AND y.share >= 0.1) / count(*), 9) AS co_active FROM theta x JOIN theta y ON x.doc_id = y.doc_id AND x.k < y.k GROUP BY 1, 2)"""


@query(f"WITH {ONE}{TOGETHER} SELECT a::INTEGER AS a, b::INTEGER AS b, correlation, co_active FROM co")
def a37_co_activation(spark, sf):
    return topics.together(model(spark, sf))


@query("")
def l10_matched_topics(spark, sf):
    return topics.matched(*two_models(spark, sf, 6, 2))


TOPS = """, sa AS (SELECT k, list(term) AS w FROM top WHERE rank <= 20 GROUP BY 1), sb AS (SELECT k, list(term) AS w FROM top2 WHERE rank <= 20 GROUP BY 1)"""


@query(f"WITH {TWO}{TOPS} SELECT sa.k::INTEGER AS a, sb.k::INTEGER AS b, round(len(list_intersect(sa.w, sb.w)) / (len(sa.w) + len(sb.w) - len(list_intersect(sa.w, sb.w))), 6) AS jaccard FROM sa, sb")
def l12_shared_top_words(spark, sf):
    return topics.shared_top_words(*two_models(spark, sf))


@query(f"""WITH {ONE}, w AS (SELECT t.k, d.lang AS g, nd, share * nd AS w FROM theta t JOIN documents d USING (doc_id)) SELECT g AS "group", k::INTEGER AS k, count(*) AS docs, round(sum(w) / sum(nd), 9) AS token_share FROM w GROUP BY 1, 2
UNION ALL SELECT 'all', k::INTEGER, count(*), round(sum(w) / sum(nd), 9) FROM w GROUP BY 2""")
def l13_prevalence(spark, sf):
    return topics.prevalence(model(spark, sf), ad.read(spark, sf, "documents"), "lang")


@query(f"""WITH {ONE}, w AS (SELECT t.k, d.source AS g, nd, share * nd AS w FROM theta t JOIN documents d USING (doc_id)), p AS (SELECT g, k, sum(w) / sum(nd) AS s FROM w GROUP BY 1, 2) SELECT k::INTEGER AS k, round(min(s), 9) AS least, round(max(s), 9) AS most, count(*) AS groups FROM p GROUP BY 1""")
def m08_prevalence_range(spark, sf):
    p = topics.prevalence(model(spark, sf), ad.read(spark, sf, "documents"), "source").where("group <> 'all'")
    return p.groupBy("k").agg(F.min("token_share").alias("least"), F.max("token_share").alias("most"), rows().alias("groups"))


@query(f"WITH {ONE} SELECT CASE {_TOKEN_BANDS.replace('n <=', 'nd <=')} ELSE '100+' END AS band, least(floor(round(share, 9) / 0.05), 19)::INTEGER AS bin, count(*) AS docs, round(avg(n_active), 6) AS mean_active FROM dom GROUP BY 1, 2")
def l14_concentration(spark, sf):
    return topics.share_bins(model(spark, sf))


@query(f"WITH {ONE} SELECT doc_id, k::INTEGER AS dominant_topic, round(share, 9) AS share FROM dom")
def w10_dominant_topic(spark, sf):
    return topics.dominant(model(spark, sf)).select("doc_id", F.col("k").alias("dominant_topic"), F.round("share", 9).alias("share"))


@query(f"WITH {ONE}, s AS (SELECT k, round(sum(share * nd) / sum(nd), 9) AS token_share FROM theta GROUP BY 1) SELECT k::INTEGER AS k, token_share, row_number() OVER (ORDER BY token_share DESC, k) AS topic FROM s")
def w11_renumbered_topics(spark, sf):
    return topics.renumbered(model(spark, sf))


FITS = [(k, s, round(900 - 4 * k + 0.05 * k * k + 3 * s, 3), round(0.05 + 0.004 * k - 0.00006 * k * k + 0.001 * s, 5), round(0.4 + 0.003 * k, 4), round(0.95 - 0.002 * k - 0.003 * s, 4)) for k in (10, 20, 30, 40, 60) for s in (1, 2, 3)]


@query(f"""WITH f AS (SELECT topics, seed, perplexity::DOUBLE AS perplexity, npmi::DOUBLE AS npmi, exclusivity::DOUBLE AS exclusivity, cosine::DOUBLE AS cosine FROM ({ad.values_sql(FITS)}) AS t(topics, seed, perplexity, npmi, exclusivity, cosine)),
g AS (SELECT topics, count(*) AS n_fits, avg(perplexity) AS perplexity, avg(npmi) AS npmi, avg(exclusivity) AS exclusivity, avg(cosine) AS cosine, coalesce(stddev_samp(perplexity), 0) AS sd FROM f GROUP BY 1),
r AS (SELECT *, (rank() OVER (ORDER BY perplexity) + rank() OVER (ORDER BY npmi DESC) + rank() OVER (ORDER BY exclusivity DESC) + rank() OVER (ORDER BY cosine DESC) + (count(*) OVER (PARTITION BY perplexity) + count(*) OVER (PARTITION BY npmi) + count(*) OVER (PARTITION BY exclusivity) + count(*) OVER (PARTITION BY cosine) - 4) / 2) / 4 AS composite, (SELECT perplexity + sd FROM g ORDER BY perplexity, topics LIMIT 1) AS lim FROM g),
b AS (SELECT *, perplexity <= lim AS within, concat_ws('; ', CASE WHEN topics = (SELECT topics FROM r ORDER BY composite, topics LIMIT 1) THEN 'composite rank' END, CASE WHEN topics = (SELECT topics FROM r ORDER BY npmi DESC, topics LIMIT 1) THEN 'coherence' END,
  CASE WHEN topics = (SELECT min(topics) FROM r WHERE perplexity <= lim) THEN 'one standard error' END) AS basis FROM r)
SELECT topics, n_fits, round(perplexity, 6) AS perplexity, round(npmi, 6) AS npmi, round(exclusivity, 6) AS exclusivity, round(cosine, 6) AS cosine, round(composite, 6) AS composite, within, basis <> '' AS retained, basis FROM b""")
def l15_model_comparison(spark, sf):
    return topics.compared(spark.createDataFrame(FITS, "topics int, seed int, perplexity double, npmi double, exclusivity double, cosine double"))


@query(f"""WITH g AS (SELECT topics, avg(perplexity::DOUBLE) AS p, stddev_samp(perplexity::DOUBLE) AS sd FROM ({ad.values_sql(FITS)}) AS t(topics, seed, perplexity, npmi, exclusivity, cosine) GROUP BY 1)
SELECT min(topics) AS chosen, round((SELECT p + sd FROM g ORDER BY p, topics LIMIT 1), 6) AS threshold FROM g WHERE p <= (SELECT p + sd FROM g ORDER BY p, topics LIMIT 1)""")
def w14_one_standard_error(spark, sf):
    f = spark.createDataFrame(FITS, "topics int, seed int, perplexity double, npmi double, exclusivity double, cosine double")
    return corpus.one_standard_error(f, "topics", "perplexity")


ACROSS = """, s1 AS (SELECT k, sum(p * p) AS s FROM dense GROUP BY 1), s2 AS (SELECT k, sum(p * p) AS s FROM dense2 GROUP BY 1), ac AS (SELECT x.k AS a, y.k AS b, round(sum(x.p * y.p) / sqrt(any_value(s1.s) * any_value(s2.s)), 6) AS cosine FROM dense x JOIN dense2 y ON x.term = y.term JOIN s1 ON s1.k = x.k JOIN s2 ON s2.k = y.k GROUP BY 1, 2)"""


@query(f"""WITH {TWO}{ACROSS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY cosine DESC, a) AS rb FROM ac),
g AS (SELECT a, max(b) FILTER (ra = 1) AS best, max(cosine) FILTER (ra = 1) AS best_cosine, max(cosine) FILTER (ra = 2) AS second_cosine, bool_or(ra = 1 AND rb = 1) AS mutual, count(*) FILTER (cosine >= 0.5) AS n_05, count(*) FILTER (cosine >= 0.7) AS n_07, count(*) FILTER (cosine >= 0.8) AS n_08 FROM r GROUP BY 1)
SELECT a::INTEGER AS a, best::INTEGER AS best, best_cosine, second_cosine, mutual, n_05, n_07, n_08, CASE WHEN n_05 = 0 THEN 'none' WHEN n_05 = 1 AND best_cosine >= 0.8 THEN 'one, clear' WHEN n_05 = 1 THEN 'one, moderate' WHEN best_cosine >= 0.8 THEN 'split, one clear' ELSE 'split, moderate' END AS class FROM g""")
def l18_correspondence(spark, sf):
    return topics.correspondence(topics.across(*two_models(spark, sf)))


@query(f"WITH {TWO}{ACROSS} SELECT a::INTEGER AS a, b::INTEGER AS b, cosine FROM ac")
def m14_pair_correspondence(spark, sf):
    return topics.across(*two_models(spark, sf))


@query(f"WITH {TWO}, n AS (SELECT x.k AS a, y.k AS b, count(*) AS n FROM dom x JOIN dom2 y USING (doc_id) GROUP BY 1, 2) SELECT a::INTEGER AS a, b::INTEGER AS b, n, round(n / sum(n) OVER (PARTITION BY a), 9) AS row_share, round(n / sum(n) OVER (PARTITION BY b), 9) AS column_share FROM n")
def l18_dominant_crosstab(spark, sf):
    return topics.crosstab(*two_models(spark, sf))


@query(f"WITH {TWO}{ACROSS} SELECT b::INTEGER AS anchor, count(*) FILTER (cosine >= 0.9) AS copies, max(cosine) AS nearest FROM ac GROUP BY 1")
def l19_anchor_copies(spark, sf):
    p = topics.across(*two_models(spark, sf))
    return p.groupBy(F.col("b").alias("anchor")).agg(F.count_if(F.col("cosine") >= 0.9).alias("copies"), F.max("cosine").alias("nearest"))


@query(f"""WITH {ONE}, r AS (SELECT k, doc_id, share, row_number() OVER (PARTITION BY k ORDER BY round(share, 9) DESC, doc_id) AS rank FROM theta WHERE nd >= 25), t AS (SELECT doc_id, count(*) AS types, sum(n) AS n FROM cells GROUP BY 1),
h AS (SELECT r.k, r.doc_id, count(*) AS present FROM r JOIN cells USING (doc_id) JOIN top ON top.k = r.k AND top.term = cells.term AND top.rank <= 10 WHERE r.rank <= 5 GROUP BY 1, 2)
SELECT r.k::INTEGER AS k, r.rank AS rank, r.doc_id, round(types / greatest(n, 1), 9) AS ttr, coalesce(present, 0) AS top_words_present FROM r JOIN t USING (doc_id) LEFT JOIN h ON h.k = r.k AND h.doc_id = r.doc_id WHERE r.rank <= 5""")
def l20_representative_proxies(spark, sf):
    return corpus.proxies(model(spark, sf), 5, 25)


@query(f"""WITH {TWO}, a AS (SELECT (SELECT count(*) FROM mass) AS t, (SELECT count(DISTINCT k) FROM dom) AS d, (SELECT round(avg(share), 6) FROM dom) AS s, (SELECT round(max(x), 6) FROM (SELECT sum(share * nd) / sum(nd) AS x FROM theta GROUP BY k)) AS l),
b AS (SELECT (SELECT count(*) FROM mass2) AS t, (SELECT count(DISTINCT k) FROM dom2) AS d, (SELECT round(avg(share), 6) FROM dom2) AS s, (SELECT round(max(x), 6) FROM (SELECT sum(share * nd) / sum(nd) AS x FROM theta2 GROUP BY k)) AS l)
SELECT 'size' AS section, 'topics' AS item, a.t::DOUBLE AS first, b.t::DOUBLE AS second FROM a, b UNION ALL SELECT 'size', 'topics that dominate a document', a.d, b.d FROM a, b UNION ALL SELECT 'documents', 'mean dominant share', a.s, b.s FROM a, b UNION ALL SELECT 'topics', 'largest token share', a.l, b.l FROM a, b""")
def l21_comparison_summary(spark, sf):
    return corpus.summary_of_two(*two_models(spark, sf))


@query(rf"""WITH {ONE}, x AS (SELECT d.k, d.share, md5(trim(regexp_replace(regexp_replace(lower(text), '(https?://|www\.)\S+', ' ', 'gi'), '[^\p{{L}}]+', ' ', 'g'))) AS f, source FROM dom d JOIN documents USING (doc_id)), t AS (SELECT k, f, count(*) AS n FROM x GROUP BY 1, 2)
SELECT a.k::INTEGER AS k, docs, distinct_texts, round(repeated / docs, 9) AS repeated_share, largest, distinct_authors, at_least_half FROM (SELECT k, sum(n)::BIGINT AS docs, count(*) AS distinct_texts, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated, max(n) AS largest FROM t GROUP BY 1) a
JOIN (SELECT k, count(DISTINCT source) AS distinct_authors, count(*) FILTER (share >= 0.5) AS at_least_half FROM x GROUP BY 1) b USING (k)""")
def l22_narrowness(spark, sf):
    return topics.narrowness(model(spark, sf), ad.read(spark, sf, "documents"), F.md5(ft.letters_only(F.col("text"))), "source")


@query(f"""WITH {ONE}, s AS (SELECT term, sum(p) AS s FROM dense GROUP BY 1), b AS (SELECT k, term, p, row_number() OVER (PARTITION BY term ORDER BY p DESC, k) AS rn FROM phi)
SELECT w AS term, b.term IS NOT NULL AS in_vocabulary, b.k::INTEGER AS top_topic, round(p / s, 6) AS share_of_mass FROM (SELECT unnest({WORDS + ['nosuchword']!r}) AS w) x LEFT JOIN b ON b.term = w AND rn = 1 LEFT JOIN s ON s.term = w""")
def l22_partner_terms(spark, sf):
    return topics.term_terms(model(spark, sf), [*WORDS, "nosuchword"])


CLAIMS = [("languages", 4), ("sources", 20), ("vector size", 64)]


@query(f"""WITH f AS (SELECT 'languages' AS item, count(DISTINCT lang)::DOUBLE AS v FROM documents UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents UNION ALL SELECT 'vector size', avg(len(embedding)) FROM embeddings)
SELECT c.item, c.documented::DOUBLE AS documented, v AS recomputed, round(v) = c.documented AS agrees FROM ({ad.values_sql(CLAIMS)}) AS c(item, documented) JOIN f USING (item)""")
def l23_claims(spark, sf):
    d = ad.read(spark, sf, "documents").agg(F.count_distinct("lang").cast("double").alias("languages"), F.count_distinct("source").cast("double").alias("sources"))
    e = ad.read(spark, sf, "embeddings").agg(F.avg(F.size("embedding")).alias("vector size"))
    found = d.crossJoin(e).unpivot([], [F.col(f"`{i}`") for i, _ in CLAIMS], "item", "recomputed")  # one row each
    c = spark.createDataFrame([(i, float(v)) for i, v in CLAIMS], "item string, documented double")
    return c.join(found, "item").select("item", "documented", "recomputed", (F.round("recomputed") == F.col("documented")).alias("agrees"))


SIZES = CELLS + ", sized AS (SELECT doc_id, nd AS n FROM dlen), ho AS (SELECT doc_id FROM sized WHERE n >= 2 ORDER BY md5(doc_id || ':1'), doc_id LIMIT (SELECT floor(0.05 * count(*))::BIGINT FROM sized))"


@query(f"WITH {SIZES} SELECT doc_id, CASE WHEN ho.doc_id IS NULL THEN 'train' ELSE 'held-out' END AS split FROM sized LEFT JOIN ho USING (doc_id)".replace("ho.doc_id IS NULL", "h IS NULL").replace("LEFT JOIN ho USING (doc_id)", "LEFT JOIN (SELECT doc_id, true AS h FROM ho) USING (doc_id)"))
def l01_split(spark, sf):
    return topics.held_out(cut(_sizes(text.term_counts(ad.read(spark, sf, "documents")))))


HALVES = SIZES + """, o AS (SELECT doc_id, term, unnest(range(1, n + 1)) AS i FROM cells JOIN ho USING (doc_id)), pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || ':' || term || ':' || i || ':2'), term, i) AS place FROM o)"""


@query(f"WITH {HALVES} SELECT doc_id, term, count(*) FILTER (place % 2 = 1) AS n_a, count(*) FILTER (place % 2 = 0) AS n_b FROM pl GROUP BY 1, 2")
def l02_completion_halves(spark, sf):
    docs = _documents(spark, sf)
    held = topics.held_out(cut(_sizes(docs))).where("split = 'held-out'").select("doc_id")
    return topics.halves(docs.join(held, "doc_id", "left_semi").select("doc_id", F.inline("cells")))


@query(f"WITH {HALVES} SELECT (SELECT count(*) FROM sized) AS documents, (SELECT count(*) FROM ho) AS held_out, count(*) FILTER (place % 2 = 1) AS tokens_a, count(*) FILTER (place % 2 = 0) AS tokens_b FROM pl")
def m06_held_out_construction(spark, sf):
    docs = _documents(spark, sf)
    split = cut(topics.held_out(cut(_sizes(docs))))
    h = topics.halves(docs.join(split.where("split = 'held-out'"), "doc_id", "left_semi").select("doc_id", F.inline("cells"))).agg(F.sum("n_a").alias("tokens_a"), F.sum("n_b").alias("tokens_b"))
    return split.agg(rows().alias("documents"), F.count_if(F.col("split") == "held-out").alias("held_out")).crossJoin(h)  # one row each


@query("")
def l03_gibbs_fits(spark, sf):
    return topics.fits(_documents(spark, sf), [(5, 1), (5, 2)])


@query("SELECT 5::INTEGER AS topics, 1::INTEGER AS seed, true AS identical")
def l16_refit(spark, sf):
    d = _documents(spark, sf)
    x, y = (topics.fits(d, [(5, 1)]).groupBy("topics", "seed").agg(F.sum(F.xxhash64("doc_id", "term", "k", "n").cast("decimal(38,0)")).alias(s)) for s in ("x", "y"))
    return x.join(y, ["topics", "seed"]).select("topics", "seed", (F.col("x") == F.col("y")).alias("identical"))


# --- structural models: what is plain computation around them -----------------------------------


@query(f"""WITH {CELLS}, v AS (SELECT term, count(*) AS df FROM cells GROUP BY 1), k AS (SELECT c.* FROM cells c JOIN v USING (term) WHERE df >= 5), f AS (SELECT (SELECT count(*) FROM documents) AS "documents in source", (SELECT count(DISTINCT doc_id) FROM cells) AS "documents with tokens",
(SELECT count(DISTINCT doc_id) FROM k) AS "documents after conversion", (SELECT sum(n)::BIGINT FROM cells) AS "tokens", (SELECT sum(n)::BIGINT FROM k) AS "tokens after conversion", (SELECT count(*) FROM v) AS "terms", (SELECT count(DISTINCT term) FROM k) AS "terms after conversion", (SELECT count(*) FROM k) AS "cells")
SELECT stage, n FROM (UNPIVOT f ON COLUMNS(*) INTO NAME stage VALUE n)""")
def m01_conversion_accounting(spark, sf):
    return corpus.conversion(ad.read(spark, sf, "documents"), _documents(spark, sf), 5)


@query("SELECT count(*) AS rows_, count(*) AS rows_that_sum_to_1, 9::INTEGER AS columns FROM events")
def m02_spline_basis(spark, sf):
    return corpus.splines(ad.read(spark, sf, "events"), "ts", 5)


@query("""WITH l AS (SELECT 'lang' AS factor, lang AS level FROM documents WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'source', source FROM documents WHERE source IS NOT NULL GROUP BY 2), c AS (SELECT factor, level, row_number() OVER (ORDER BY factor, level) AS col FROM l)
SELECT doc_id, col::BIGINT AS col FROM documents JOIN c ON (factor = 'lang' AND level = lang) OR (factor = 'source' AND level = source)""")
def m03_sparse_design(spark, sf):
    return corpus.design(ad.read(spark, sf, "documents"), "doc_id", ["lang", "source"])


@query(f"WITH {ONE}, pw AS (SELECT term, sum(n) / (SELECT sum(n) FROM cells) AS pw FROM cells GROUP BY 1), s AS (SELECT k, term, round(ln(p / pw), 9) AS lift FROM phi JOIN pw USING (term) WHERE n >= 5) SELECT k::INTEGER AS k, term, round(lift, 6) AS lift FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY lift DESC, term) <= 10")
def m07_lift_labels(spark, sf):
    return corpus.lift_labels(model(spark, sf), 10, 5)


COEFFICIENTS = [(t, i, round(((i * 7 + len(t) * 3) % 11 - 5) / 10, 1) if (i + len(t)) % 3 else 0.0) for t in ("intercept", "author", "thread", "day") for i in range(12)]


@query(f"SELECT term, count(*) AS coefficients, count(*) FILTER (v <> 0) AS nonzero, round(count(*) FILTER (v <> 0) / count(*), 9) AS share_nonzero, max(abs(v))::DOUBLE AS largest FROM ({ad.values_sql(COEFFICIENTS)}) AS t(term, i, v) GROUP BY 1")
def m10_sparsity(spark, sf):
    c = spark.createDataFrame(COEFFICIENTS, "term string, i int, v double")
    return c.groupBy("term").agg(rows().alias("coefficients"), F.count_if(F.col("v") != 0).alias("nonzero"), F.round(F.count_if(F.col("v") != 0) / rows(), 9).alias("share_nonzero"), F.max(F.abs("v")).alias("largest"))


LOG = [(i, x) for i, x in enumerate(["Beginning Spectral Initialization", "Completed E-Step (12 seconds).", "Completed M-Step (3 seconds).", "Completed E-Step (9 seconds).", "Completed M-Step.", "Completed E-Step (8 seconds).", "Model Converged"])]


@query(f"""WITH l AS (SELECT * FROM ({ad.values_sql(LOG)}) AS t(line, s)), e AS (SELECT row_number() OVER (ORDER BY line) AS iteration, regexp_extract(s, '\\((\\d+) seconds\\)', 1)::DOUBLE AS estep FROM l WHERE starts_with(s, 'Completed E-Step')),
m AS (SELECT row_number() OVER (ORDER BY line) AS iteration, coalesce(nullif(regexp_extract(s, '\\((\\d+) seconds\\)', 1), '')::DOUBLE, 0) AS mstep FROM l WHERE starts_with(s, 'Completed M-Step')) SELECT iteration, estep, mstep FROM e FULL JOIN m USING (iteration)""")
def m11_fit_log(spark, sf):
    return corpus.fit_log(spark.createDataFrame(LOG, "line int, s string"))


BOUNDS = [(10, -7.1, 35), (20, -6.9, 50), (30, -6.85, 80)]


@query(f"SELECT topics, bound::DOUBLE AS bound, iterations, round(bound + list_sum(list_transform(range(1, topics + 1), lambda i: ln(i))), 6) AS lbound FROM ({ad.values_sql(BOUNDS)}) AS t(topics, bound, iterations)")
def m12_search_table(spark, sf):
    b = spark.createDataFrame(BOUNDS, "topics int, bound double, iterations int")
    return b.withColumn("lbound", F.round(F.col("bound") + F.expr("aggregate(sequence(1, topics), 0D, (s, i) -> s + ln(i))"), 6))


@query("SELECT row_number() OVER (ORDER BY t)::INTEGER AS chunk, t::INTEGER AS target FROM (SELECT unnest(range(57, 200, 20)) AS t UNION SELECT 200)")
def m13_chunk_plan(spark, sf):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(topics.planned_chunks(37, 200, 20))], "chunk int, target int")


@query(f"""WITH {ONE} SELECT 'one dominant topic a document' AS "check", CASE WHEN (SELECT count(*) FROM dom) = (SELECT count(*) FROM dlen) THEN 'pass' ELSE 'fail' END AS status UNION ALL SELECT 'shares sum to 1', CASE WHEN (SELECT bool_and(abs(s - 1) < 1e-9) FROM (SELECT sum(share) AS s FROM theta GROUP BY doc_id)) THEN 'pass' ELSE 'fail' END
UNION ALL SELECT 'tokens are those of the source', CASE WHEN (SELECT sum(n) FROM asg) = (SELECT count(*) FROM tokens) THEN 'pass' ELSE 'fail' END UNION ALL SELECT 'documents are those of the source', CASE WHEN (SELECT count(*) FROM dlen d ANTI JOIN documents USING (doc_id)) = 0 THEN 'pass' ELSE 'fail' END""")
def m15_linkage_checks(spark, sf):
    d = ad.read(spark, sf, "documents")
    return corpus.linkage_checks(model(spark, sf), corpus.sizes(d).select("n"), d)
