"""The canonical table of message events: its build, keys, joins and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, reports, threads
from ..operators.reports import rows
from ..sources import adapters as ad
from .base import query

EVENTS = ad.EVENTS
MARKER_LIST = ", ".join(f"'{m}'" for m in reports.MARKERS)
LABELLED = [*reports.MARKERS, "[ Removed by moderator ]", ""]


def events(spark, sf):
    return threads.canonical(ad.comments(spark, sf), ad.submissions(spark, sf))


@query(f"WITH {EVENTS} SELECT {', '.join('created_date_utc::VARCHAR AS created_date_utc' if c == 'created_date_utc' else c for c in threads.COLUMNS)} FROM events_")
def p02_canonical_events(spark, sf):
    return events(spark, sf).withColumn("created_date_utc", F.col("created_date_utc").cast("string"))


@query(f"WITH {EVENTS} SELECT record_type, count(*) AS n, count(DISTINCT doc_key) AS n_keys, min(doc_key) AS first_key, max(doc_key) AS last_key FROM events_ GROUP BY 1")
def p01_doc_keys(spark, sf):
    return events(spark, sf).groupBy("record_type").agg(rows().alias("n"), F.count_distinct("doc_key").alias("n_keys"), F.min("doc_key").alias("first_key"), F.max("doc_key").alias("last_key"))


@query(f"WITH {EVENTS} SELECT doc_key, thread_id, thread_id = doc_key AS own FROM events_")
def p03_thread_ids(spark, sf):
    return events(spark, sf).select("doc_key", "thread_id", (F.col("thread_id") == F.col("doc_key")).alias("own"))


@query(f"WITH {EVENTS} SELECT record_type, parent_kind, count(*) AS n FROM events_ GROUP BY 1, 2")
def p04_parent_kinds(spark, sf):
    return events(spark, sf).groupBy("record_type", "parent_kind").agg(rows().alias("n"))


@query(f"""WITH {EVENTS} SELECT CASE WHEN NOT coalesce(regexp_matches(parent_id, '^t[13]_[0-9a-z]+$'), false) THEN 'malformed' WHEN parent_id = thread_id THEN 'own submission'
  WHEN parent_id LIKE 't3!_%' ESCAPE '!' THEN 'other submission' WHEN parent_in_dataset THEN 'comment in sample' ELSE 'not in sample' END AS parent_class, count(*) AS n
FROM events_ WHERE NOT is_thread_root GROUP BY 1""")
def p05_parent_classes(spark, sf):
    return events(spark, sf).where("NOT is_thread_root").groupBy(threads.parent_class().alias("parent_class")).agg(rows().alias("n"))


@query(f"WITH {EVENTS} SELECT doc_key, md5(text) AS text_md5, coalesce(ends_with(text, ' '), false) AS trailing_blank, is_thread_root AND text = title || ' ' || selftext AS from_title FROM events_")
def p06_combined_text(spark, sf):
    made = F.col("is_thread_root") & (F.col("text") == F.concat("title", F.lit(" "), "selftext"))
    return events(spark, sf).select("doc_key", F.md5("text").alias("text_md5"), F.coalesce(F.col("text").endswith(" "), F.lit(False)).alias("trailing_blank"), made.alias("from_title"))


@query(f"WITH {EVENTS} SELECT doc_key, text_n_chars, strlen(text)::BIGINT AS n_bytes FROM events_")
def p07_code_points(spark, sf):
    return events(spark, sf).select("doc_key", "text_n_chars", F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"WITH {EVENTS} SELECT doc_key, strftime(created_datetime_utc, '%Y-%m-%d %H:%M:%S') AS at, created_date_utc::VARCHAR AS day, hour(created_datetime_utc)::INTEGER AS hour FROM events_")
def p08_epoch_times(spark, sf):
    at = F.col("created_datetime_utc")
    return events(spark, sf).select("doc_key", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("created_date_utc").cast("string").alias("day"), F.hour(at).alias("hour"))


@query(f"WITH {EVENTS} SELECT doc_key, substr(doc_key, 4) AS bare_id, regexp_replace(thread_id, '^t3_', '') AS bare_thread FROM events_")
def p10_bare_ids(spark, sf):
    return events(spark, sf).select("doc_key", F.expr("substring(doc_key, 4)").alias("bare_id"), F.regexp_replace("thread_id", "^t3_", "").alias("bare_thread"))


@query(f"""WITH {EVENTS} SELECT record_type, CASE WHEN body IS NULL AND NOT is_thread_root OR title IS NULL AND is_thread_root THEN 'missing' WHEN coalesce(body, title) = '' THEN 'empty'
  WHEN coalesce(body, title) IN ({MARKER_LIST}) THEN coalesce(body, title) ELSE 'text' END AS state, count(*) AS n FROM events_ GROUP BY 1, 2""")
def p11_text_states(spark, sf):
    t = F.coalesce("body", "title")
    state = F.when(t.isNull(), "missing").when(t == "", "empty").when(t.isin(*reports.MARKERS), t).otherwise("text")
    return events(spark, sf).groupBy("record_type", state.alias("state")).agg(rows().alias("n"))


@query(rf"WITH {EVENTS} SELECT record_type, count(*) FILTER (regexp_replace(text, '^[\s\x{{85}}\x{{A0}}]+|[\s\x{{85}}\x{{A0}}]+$', '', 'g') IN ({MARKER_LIST})) AS marker_only, count(*) AS n FROM events_ GROUP BY 1")
def p12_marker_only(spark, sf):
    return events(spark, sf).groupBy("record_type").agg(F.count_if(reports.marker_only(F.col("text"))).alias("marker_only"), rows().alias("n"))


@query(f"""WITH {EVENTS} SELECT record_type, count(*) FILTER (parent_kind IN ('submission')) AS to_submission, count(*) FILTER (author IN ('u1', '[deleted]')) AS by_some,
  count(*) FILTER (NOT coalesce(author IN ('u1', '[deleted]'), false)) AS by_others FROM events_ GROUP BY 1""")
def p13_null_safe_membership(spark, sf):
    member = lambda c, *x: F.coalesce(F.col(c).isin(*x), F.lit(False))
    return events(spark, sf).groupBy("record_type").agg(
        F.count_if(member("parent_kind", "submission")).alias("to_submission"), F.count_if(member("author", "u1", "[deleted]")).alias("by_some"), F.count_if(~member("author", "u1", "[deleted]")).alias("by_others")
    )


VALID = {
    "id": ("reddit_id", "^[0-9a-z]+$"), "thread": ("thread_id", "^t3_[0-9a-z]+$"), "parent": ("parent_id", "^t[13]_[0-9a-z]+$"), "group": ("subreddit_id", "^t5_[0-9a-z]+$"),
}


@query(f"WITH {EVENTS} " + " UNION ALL ".join(
    f"SELECT '{k}' AS field, count({c}) AS n, count(*) FILTER (NOT regexp_matches({c}, '{p}')) AS invalid, count(*) FILTER ({c} IS NULL) AS missing FROM events_" for k, (c, p) in VALID.items()
))
def p15_validity(spark, sf):
    return checks.validity(events(spark, sf), VALID)


@query(f"WITH {EVENTS} SELECT text AS value, count(*) AS n FROM events_ WHERE starts_with(text, '[') AND ends_with(text, ']') GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, value")
def p16_bracketed_values(spark, sf):
    t = F.col("text")
    return events(spark, sf).where(t.startswith("[") & t.endswith("]")).groupBy(t.alias("value")).agg(rows().alias("n")).where("n >= 2").orderBy(F.desc("n"), "value")


# --- joins -------------------------------------------------------------------


@query(f"WITH {EVENTS} SELECT thread_root_in_dataset, count(*) AS n, count(DISTINCT thread_id) AS n_threads FROM events_ GROUP BY 1")
def j01_root_presence(spark, sf):
    return events(spark, sf).groupBy("thread_root_in_dataset").agg(rows().alias("n"), F.count_distinct("thread_id").alias("n_threads"))


@query(f"WITH {EVENTS} SELECT record_type, parent_in_dataset, count(*) AS n FROM events_ GROUP BY 1, 2")
def j02_parent_presence(spark, sf):
    return events(spark, sf).groupBy("record_type", "parent_in_dataset").agg(rows().alias("n"))


@query(f"""WITH {EVENTS}, k AS (SELECT doc_key, record_type FROM events_) SELECT e.record_type, count(*) AS n, count(*) FILTER (thread_root_in_dataset <> (r.doc_key IS NOT NULL)) AS root_differs,
  count(*) FILTER (parent_in_dataset IS DISTINCT FROM CASE WHEN e.parent_id IS NOT NULL THEN p.doc_key IS NOT NULL END) AS parent_differs, count(*) FILTER (p.doc_key IS NOT NULL AND p.record_type IS DISTINCT FROM parent_kind) AS kind_differs
FROM events_ e LEFT JOIN k r ON r.doc_key = e.thread_id AND r.record_type = 'submission' LEFT JOIN k p ON p.doc_key = e.parent_id GROUP BY 1""")
def j03_flags_proven_again(spark, sf):
    return checks.flags_again(events(spark, sf))


@query(f"WITH {EVENTS} SELECT c.doc_key, s.doc_key AS submission_key, c.created_utc - s.created_utc AS seconds FROM events_ c JOIN events_ s ON s.doc_key = c.thread_id AND s.is_thread_root WHERE NOT c.is_thread_root")
def j04_comment_to_submission(spark, sf):
    e = events(spark, sf).select("doc_key", "thread_id", "created_utc", "is_thread_root")
    s = e.where("is_thread_root").select("thread_id", F.col("doc_key").alias("submission_key"), F.col("created_utc").alias("at"))
    return e.where("NOT is_thread_root").join(s, "thread_id").select("doc_key", "submission_key", (F.col("created_utc") - F.col("at")).alias("seconds"))


@query(f"WITH {EVENTS} SELECT c.doc_key, p.doc_key AS parent_key, p.author AS parent_author, c.created_utc - p.created_utc AS seconds FROM events_ c JOIN events_ p ON p.doc_key = c.parent_id AND NOT p.is_thread_root WHERE NOT c.is_thread_root")
def j05_reply_to_comment(spark, sf):
    e = events(spark, sf).where("NOT is_thread_root").select("doc_key", "parent_id", "author", "created_utc")
    p = e.select(F.col("doc_key").alias("parent_id"), F.col("author").alias("parent_author"), F.col("created_utc").alias("at"))
    return e.join(p, "parent_id").select("doc_key", F.col("parent_id").alias("parent_key"), "parent_author", (F.col("created_utc") - F.col("at")).alias("seconds"))


@query(f"""WITH {EVENTS} SELECT m.doc_key, s.author AS submission_author, s.text_n_chars AS submission_n_chars, p.author AS parent_author, p.created_utc AS parent_created
FROM events_ m LEFT JOIN events_ s ON s.doc_key = m.thread_id AND s.is_thread_root LEFT JOIN events_ p ON p.doc_key = m.parent_id AND NOT p.is_thread_root WHERE NOT m.is_thread_root""")
def j10_prefixed_attributes(spark, sf):
    return reports.with_origin(events(spark, sf))


@query(f"""WITH {EVENTS} SELECT c.doc_key, coalesce(s.score, 0) AS inherited_score, s.upvote_ratio AS inherited_ratio, s.doc_key IS NULL AS without FROM events_ c LEFT JOIN events_ s ON s.doc_key = c.thread_id AND s.is_thread_root WHERE NOT c.is_thread_root""")
def j11_inherited_attributes(spark, sf):
    e = events(spark, sf)
    s = e.where("is_thread_root").select("thread_id", F.col("score").alias("s"), F.col("upvote_ratio").alias("inherited_ratio"), F.lit(True).alias("has"))
    return e.where("NOT is_thread_root").select("doc_key", "thread_id").join(s, "thread_id", "left").select("doc_key", F.coalesce("s", F.lit(0)).alias("inherited_score"), "inherited_ratio", F.col("has").isNull().alias("without"))


@query(f"""WITH RECURSIVE {EVENTS}, chain(doc_key, top, up, steps) AS (SELECT doc_key, doc_key, parent_id, 0 FROM events_ WHERE NOT is_thread_root UNION ALL
SELECT c.doc_key, m.doc_key, m.parent_id, steps + 1 FROM chain c JOIN events_ m ON m.doc_key = c.up)
SELECT doc_key, steps::BIGINT AS steps, top, starts_with(top, 't3_') AS reached_root, up AS absent_parent FROM chain QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY steps DESC) = 1""")
def j18_chain_to_root(spark, sf):
    return reports.chain_to_root(events(spark, sf))


# --- summaries -----------------------------------------------------------------


@query(f"""WITH {EVENTS}, r AS (SELECT * FROM events_ WHERE is_thread_root),
c AS (SELECT thread_id, count(*) AS n_comments, count(DISTINCT author) + coalesce(max((author IS NULL)::BIGINT), 0) AS n_comment_authors, count(*) FILTER (parent_kind = 'submission') AS n_comments_replying_to_root,
  count(*) FILTER (parent_in_dataset) AS n_comments_parent_in_dataset, min(created_utc) AS first_comment_utc, max(created_utc) AS last_comment_utc FROM events_ WHERE NOT is_thread_root GROUP BY 1)
SELECT coalesce(r.thread_id, c.thread_id) AS thread_id, r.thread_id IS NOT NULL AS root_in_dataset, coalesce(n_comments, 0) + (r.thread_id IS NOT NULL)::BIGINT AS n_events, coalesce(n_comments, 0) AS n_comments,
  coalesce(n_comment_authors, 0) AS n_comment_authors, coalesce(n_comments_replying_to_root, 0) AS n_comments_replying_to_root, coalesce(n_comments_parent_in_dataset, 0) AS n_comments_parent_in_dataset,
  first_comment_utc, last_comment_utc, r.doc_key AS root_doc_key, r.author AS root_author, r.created_utc AS root_created_utc, r.score AS root_score, r.num_comments AS root_num_comments, r.upvote_ratio AS root_upvote_ratio
FROM r FULL JOIN c ON r.thread_id = c.thread_id""")
def a01_thread_summary(spark, sf):
    return threads.thread_summary(events(spark, sf))


@query(f"""WITH {EVENTS} SELECT author, count(*) AS n_events, count(*) FILTER (NOT is_thread_root) AS n_comments, count(*) FILTER (is_thread_root) AS n_submissions, count(DISTINCT thread_id) AS n_threads,
  min(created_utc) AS first_created_utc, max(created_utc) AS last_created_utc, count(DISTINCT created_date_utc) AS n_active_days FROM events_ GROUP BY 1""")
def a02_author_summary(spark, sf):
    return threads.author_summary(events(spark, sf))


_KIND = {"to a comment": "comment", "to a submission": "submission"}
_ONE = {
    "comments": "NOT is_thread_root", "submissions": "is_thread_root", "comments: submission present": "NOT is_thread_root AND thread_root_in_dataset", "comments: submission absent": "NOT is_thread_root AND NOT thread_root_in_dataset",
    "comments: parent present": "parent_in_dataset", "comments: parent absent": "NOT parent_in_dataset", "comments: no parent": "NOT is_thread_root AND parent_id IS NULL",
    "comments: to another form": "parent_kind = 'other'", "comments: to their own submission": "parent_kind = 'submission' AND parent_id = link_id",
    **{f"comments: {k}": f"parent_kind = '{v}'" for k, v in _KIND.items()}, **{f"comments: {k}, present": f"parent_kind = '{v}' AND parent_in_dataset" for k, v in _KIND.items()},
    **{f"comments: {k}, absent": f"parent_kind = '{v}' AND NOT parent_in_dataset" for k, v in _KIND.items()},
}
_TWO = {
    "threads": "count(*)", "threads with a comment": "count(*) FILTER (c > 0)", "threads: root present": "count(*) FILTER (s > 0)", "threads: root absent": "count(*) FILTER (s = 0)",
    "threads with a comment: root present": "count(*) FILTER (c > 0 AND s > 0)", "submissions with a comment": "coalesce(sum(s) FILTER (c > 0), 0)::BIGINT", "submissions without a comment": "coalesce(sum(s) FILTER (c = 0), 0)::BIGINT",
}
_THREE = {"authors": "count(*)", "authors of comments": "count(*) FILTER (c > 0)", "authors of submissions": "count(*) FILTER (s > 0)", "authors of both": "count(*) FILTER (c > 0 AND s > 0)"}


@query(f"WITH {EVENTS}, t AS (SELECT thread_id, count(*) FILTER (NOT is_thread_root) AS c, count(*) FILTER (is_thread_root) AS s FROM events_ GROUP BY 1), a AS (SELECT author, count(*) FILTER (NOT is_thread_root) AS c, count(*) FILTER (is_thread_root) AS s FROM events_ GROUP BY 1) "
       + " UNION ALL ".join([*(f"SELECT '{k}' AS item, count(*) FILTER ({v}) AS value FROM events_" for k, v in _ONE.items()), *(f"SELECT '{k}', {v} FROM t" for k, v in _TWO.items()), *(f"SELECT '{k}', {v} FROM a" for k, v in _THREE.items())]))
def a03_linkage_summary(spark, sf):
    return threads.linkage(events(spark, sf))


_MARKED = [("comment", "author"), ("comment", "body"), ("submission", "author"), ("submission", "title"), ("submission", "selftext"), ("submission", "url")]


@query(f"WITH {EVENTS} " + " UNION ALL ".join(
    f"SELECT '{t}' AS record_type, '{f}' AS field, '{m}' AS stored_value, count(*) FILTER ({f} = '{m}') AS n, count(*) AS n_records, round(100 * count(*) FILTER ({f} = '{m}') / count(*), 6) AS pct FROM events_ WHERE record_type = '{t}'"
    for t, f in _MARKED for m in LABELLED
))
def a05_marker_counts(spark, sf):
    return checks.marker_counts(events(spark, sf), _MARKED, LABELLED)


@query(f"WITH {EVENTS} SELECT created_date_utc::VARCHAR AS day, hour(created_datetime_utc)::INTEGER AS hour, record_type, count(*) AS n FROM events_ GROUP BY 1, 2, 3")
def a09_activity(spark, sf):
    return events(spark, sf).groupBy(F.col("created_date_utc").cast("string").alias("day"), F.hour("created_datetime_utc").alias("hour"), "record_type").agg(rows().alias("n"))


@query(f"WITH {EVENTS} SELECT doc_key, md5(text) AS text_md5 FROM events_ ORDER BY record_type, source_file, source_row_in_file, doc_key LIMIT 5")
def a26_first_values(spark, sf):
    return events(spark, sf).orderBy("record_type", "source_file", F.col("source_row_in_file").asc_nulls_last(), "doc_key").limit(5).select("doc_key", F.md5("text").alias("text_md5"))


@query(f"WITH {EVENTS} SELECT coalesce(record_type, 'all') AS record_type, coalesce(parent_kind, 'none') AS parent_kind, grouping(record_type, kind)::INTEGER AS level, count(*) AS n FROM (SELECT record_type, parent_kind, coalesce(parent_kind, 'none') AS kind FROM events_) GROUP BY ROLLUP (record_type, kind), parent_kind HAVING false UNION ALL "
       f"SELECT coalesce(record_type, 'all'), coalesce(kind, 'all'), grouping(record_type, kind)::INTEGER, count(*) FROM (SELECT record_type, coalesce(parent_kind, 'none') AS kind FROM events_) GROUP BY ROLLUP (record_type, kind)")  # fmt: skip
def a42_rollup(spark, sf):
    e = events(spark, sf).select("record_type", F.coalesce("parent_kind", F.lit("none")).alias("kind"))
    r = e.rollup("record_type", "kind").agg(rows().alias("n"), F.grouping_id().cast("int").alias("level"))
    return r.select(F.coalesce("record_type", F.lit("all")).alias("record_type"), F.coalesce("kind", F.lit("all")).alias("parent_kind"), "level", "n")


@query(f"""WITH {EVENTS}, f AS (SELECT count(*) AS d, count(DISTINCT doc_key) AS "distinct keys", count(*) FILTER (regexp_matches(reddit_id, '^[0-9a-z]+$')) AS "ids of base 36", count(DISTINCT reddit_id) AS "distinct bare ids",
  count(*) FILTER (length(reddit_id) <= 4) AS "ids of up to 4 characters", count(*) FILTER (parent_in_dataset) AS "parents present", count(*) FILTER (thread_root_in_dataset) AS "roots present" FROM events_)
SELECT measure, n, d AS denominator, round(100 * n / d, 6) AS pct FROM (UNPIVOT f ON COLUMNS(* EXCLUDE (d)) INTO NAME measure VALUE n)""")
def a44_identifier_structure(spark, sf):
    e = F.col("reddit_id")
    facts = {
        "distinct keys": F.count_distinct("doc_key"), "ids of base 36": F.count_if(e.rlike("^[0-9a-z]+$")), "distinct bare ids": F.count_distinct("reddit_id"), "ids of up to 4 characters": F.count_if(F.length(e) <= 4),
        "parents present": F.count_if("parent_in_dataset"), "roots present": F.count_if("thread_root_in_dataset"),
    }
    return checks.measures(events(spark, sf), facts)


def _provenance_sql() -> str:
    comment = "id parent_id link_id author body created_utc retrieved_on score subreddit subreddit_id raw_json".split()
    submission = "id title selftext url author created_utc retrieved_on score num_comments upvote_ratio subreddit subreddit_id raw_json".split()
    names = sorted({*comment, *submission, *threads.COLUMNS, "source_file", "source_row_in_file"})
    own = {*comment, "source_file", "source_row_in_file"}, {*submission, "source_file", "source_row_in_file"}
    return ad.values_sql([(n, n in own[0], n in own[1], n in threads.COLUMNS, "carried" if n in threads.COLUMNS and (n in own[0] or n in own[1]) else "derived" if n in threads.COLUMNS else "source only") for n in names])


@query(f"SELECT * FROM ({_provenance_sql()}) AS t(field, in_comments, in_submissions, in_events, origin)")
def a45_field_provenance(spark, sf):
    return checks.field_provenance(spark, {"in_comments": ad.comments(spark, sf).columns, "in_submissions": ad.submissions(spark, sf).columns, "in_events": list(threads.COLUMNS)})


@query(f"WITH {EVENTS}, f AS (SELECT count(*) FILTER (author IN (SELECT author FROM events_ WHERE NOT is_thread_root)) AS x FROM events_), c AS (SELECT (SELECT count(*) FROM (SELECT author FROM events_ WHERE is_thread_root EXCEPT SELECT author FROM events_ WHERE NOT is_thread_root)) AS n) SELECT 'submissions only' AS side, n FROM c UNION ALL SELECT 'comments only', (SELECT count(*) FROM (SELECT author FROM events_ WHERE NOT is_thread_root EXCEPT SELECT author FROM events_ WHERE is_thread_root))")
def x03_set_differences(spark, sf):
    e = events(spark, sf).select("author", "is_thread_root")
    s, c = e.where("is_thread_root").select("author"), e.where("NOT is_thread_root").select("author")
    one = s.subtract(c).agg(rows().alias("n")).select(F.lit("submissions only").alias("side"), "n")
    return one.unionByName(c.subtract(s).agg(rows().alias("n")).select(F.lit("comments only").alias("side"), "n"))


@query(f"""WITH {EVENTS}, d AS (SELECT 't3_v' || conv_id AS doc_key, count(*) AS n_turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1)
SELECT e.doc_key IS NOT NULL AS in_events, d.doc_key IS NOT NULL AS in_inventory, count(*) AS n, count(*) FILTER (abs(e.chars - d.chars) <= 1e-9) AS equal FROM
(SELECT thread_id AS doc_key, sum(length(coalesce(body, title)))::BIGINT AS chars FROM events_ GROUP BY 1) e FULL JOIN d ON d.doc_key = e.doc_key GROUP BY 1, 2""")
def j08_reconciliation(spark, sf):
    measured = events(spark, sf).groupBy(F.col("thread_id").alias("doc_key")).agg(F.sum(F.length(F.coalesce("body", "title"))).alias("value"))
    inventory = ad.read(spark, sf, "conversations").groupBy(F.concat(F.lit("t3_v"), F.col("conv_id").cast("string")).alias("doc_key")).agg(F.sum(F.length("text")).alias("value"))
    return checks.reconciled(measured, inventory, "doc_key", "value").select(F.col("in_left").alias("in_events"), F.col("in_right").alias("in_inventory"), "n", "equal")


@query(f"""WITH {EVENTS}, o AS (SELECT CASE WHEN turn = 0 THEN 't3_v' || conv_id ELSE 't1_v' || conv_id || 'c' || turn END AS doc_key, role || '_' || ((conv_id + turn) % 40) AS author, length(text) AS n FROM conversations)
SELECT (SELECT count(*) FROM events_ ANTI JOIN o USING (doc_key)) AS only_new, (SELECT count(*) FROM o ANTI JOIN events_ USING (doc_key)) AS only_old, count(*) AS shared,
  count(*) FILTER (e.author IS NOT DISTINCT FROM o.author) AS same_author, count(*) FILTER (length(coalesce(e.body, e.title)) IS NOT DISTINCT FROM o.n) AS same_length FROM events_ e JOIN o USING (doc_key)""")
def j09_agreement_with_earlier(spark, sf):
    c = ad.read(spark, sf, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    key = F.when(F.col("turn") == 0, F.concat(F.lit("t3_v"), conv)).otherwise(F.concat(F.lit("t1_v"), conv, F.lit("c"), turn))
    old = c.select(key.alias("doc_key"), F.concat_ws("_", "role", ((F.col("conv_id") + F.col("turn")) % 40).cast("string")).alias("author"), F.length("text").alias("length"))
    new = events(spark, sf).select("doc_key", "author", F.length(F.coalesce("body", "title")).alias("length"))
    return checks.agreement(new, old, "doc_key", ["author", "length"])


@query(f"""WITH {EVENTS}, t AS (SELECT doc_key, length(text) - length(replace(text, ' ', '')) + 1 AS n_tokens FROM events_ WHERE text <> '')
SELECT e.record_type, count(*) AS n, count(t.n_tokens) AS with_tokens, sum(t.n_tokens)::BIGINT AS tokens FROM events_ e LEFT JOIN t USING (doc_key) GROUP BY 1""")
def j12_token_counts_attached(spark, sf):
    e = events(spark, sf).select("doc_key", "record_type", "text")
    counts = e.where("text <> ''").select("doc_key", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_tokens"))
    joined = checks.attached(e.where("text <> ''").select("doc_key", "record_type"), counts, "doc_key", "n_tokens")
    every = e.groupBy("record_type").agg(rows().alias("n"))
    return every.join(joined.groupBy("record_type").agg(F.count("n_tokens").alias("with_tokens"), F.sum("n_tokens").alias("tokens")), "record_type", "left")


@query(f"""WITH {EVENTS}, f AS (SELECT count(*) AS n, count(DISTINCT doc_key) AS k, count(*) FILTER (doc_key <> CASE record_type WHEN 'comment' THEN 't1_' ELSE 't3_' END || reddit_id) AS bad,
  count(*) FILTER (record_type NOT IN ('comment', 'submission')) AS odd, count(*) FILTER (text IS NULL) AS blank, count(*) FILTER (num_comments IS NOT NULL AND NOT is_thread_root) AS foreign_ FROM events_),
s AS (SELECT (SELECT count(*) FROM comments) + (SELECT count(*) FROM submissions) AS n_source)
SELECT 'events equal source rows' AS "check", n || ' of ' || n_source AS detail, CASE WHEN n = n_source THEN 'pass' ELSE 'fail' END AS status FROM f, s
UNION ALL SELECT 'keys are unique', (n - k)::VARCHAR, CASE WHEN n = k THEN 'pass' ELSE 'fail' END FROM f UNION ALL SELECT 'keys follow the rule', bad::VARCHAR, CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END FROM f
UNION ALL SELECT 'types are known', odd::VARCHAR, CASE WHEN odd = 0 THEN 'pass' ELSE 'fail' END FROM f UNION ALL SELECT 'no text is missing', blank::VARCHAR, CASE WHEN blank = 0 THEN 'pass' ELSE 'fail' END FROM f
UNION ALL SELECT 'foreign fields are null', foreign_::VARCHAR, CASE WHEN foreign_ = 0 THEN 'pass' ELSE 'fail' END FROM f UNION ALL SELECT 'earlier artifact agrees', '', 'not applicable'""")
def s24_quality_checks(spark, sf):
    c, s = ad.comments(spark, sf), ad.submissions(spark, sf)
    return checks.event_checks(threads.canonical(c, s), c, s)


@query(f"""WITH {EVENTS}, r AS (SELECT doc_key, row_number() OVER (ORDER BY created_utc, doc_key) - 1 AS row FROM events_) SELECT doc_key, row::BIGINT AS row FROM r""")
def w17_stable_order(spark, sf):
    return reports.numbered(events(spark, sf).select("doc_key", "created_utc"), ["created_utc", "doc_key"]).select("doc_key", "row")


@query(f"""WITH {EVENTS}, r AS (SELECT doc_key, row_number() OVER (ORDER BY created_utc, doc_key) - 1 AS row, text_n_chars, created_utc FROM events_)
SELECT count(*) AS documents, max(row)::BIGINT AS last_row, sum(text_n_chars)::BIGINT AS chars, min(created_utc) AS first_utc, max(created_utc) AS last_utc, arg_min(doc_key, row) AS first_key, arg_max(doc_key, row) AS last_key FROM r""")
def e01_ordered_stream(spark, sf):
    r = reports.numbered(events(spark, sf).select("doc_key", "created_utc", "text_n_chars"), ["created_utc", "doc_key"])
    return r.agg(
        rows().alias("documents"), F.max("row").alias("last_row"), F.sum("text_n_chars").alias("chars"), F.min("created_utc").alias("first_utc"), F.max("created_utc").alias("last_utc"),
        F.min_by("doc_key", "row").alias("first_key"), F.max_by("doc_key", "row").alias("last_key"),
    )


@query(f"""WITH {EVENTS}, r AS (SELECT doc_key, row_number() OVER (ORDER BY created_utc, doc_key) - 1 AS row FROM events_) SELECT row::BIGINT AS row, doc_key, md5(text) AS text_md5 FROM r JOIN events_ USING (doc_key)""")
def e02_texts_in_row_order(spark, sf):
    e = events(spark, sf)
    order = reports.numbered(e.select("doc_key", "created_utc"), ["created_utc", "doc_key"]).select("doc_key", "row")
    return checks.attached(order, e.select("doc_key", F.md5("text").alias("text_md5")), "doc_key", "text_md5").select("row", "doc_key", "text_md5")


@query(f"WITH {EVENTS} SELECT doc_key, CASE WHEN coalesce(text, '') = '' THEN ' ' ELSE text END = ' ' AND coalesce(text, '') = '' AS substituted, length(CASE WHEN coalesce(text, '') = '' THEN ' ' ELSE text END)::INTEGER AS n_sent FROM events_")
def e03_empty_substitution(spark, sf):
    empty = F.coalesce("text", F.lit("")) == ""
    return events(spark, sf).select("doc_key", empty.alias("substituted"), F.length(F.when(empty, " ").otherwise(F.col("text"))).cast("int").alias("n_sent"))


@query(f"""WITH {EVENTS}, t AS (SELECT thread_id, count(*) AS n FROM events_ GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, thread_id) AS rank, sum(n) OVER () AS total FROM t)
SELECT unnest([4, 10, 100, 1000])::INTEGER AS k, unnest([round(sum(n) FILTER (rank <= 4) / any_value(total), 9), round(sum(n) FILTER (rank <= 10) / any_value(total), 9), round(sum(n) FILTER (rank <= 100) / any_value(total), 9), round(sum(n) FILTER (rank <= 1000) / any_value(total), 9)]) AS share FROM r""")
def w04_share_of_top(spark, sf):
    return reports.share_of_top(events(spark, sf).groupBy("thread_id").agg(rows().alias("n")), "n", [4, 10, 100, 1000])


@query(f"""WITH {EVENTS}, d AS (SELECT created_date_utc::VARCHAR AS day, count(*) AS n, sum(score)::BIGINT AS score FROM events_ GROUP BY 1)
SELECT day, n, round((n - lag(n) OVER w) / lag(n) OVER w, 9) AS relative_change, sum(n) OVER w::BIGINT AS cumulative, n - lag(n, 3) OVER w AS over_last_3, coalesce(n < lag(n) OVER w, false) AS falls FROM d WINDOW w AS (ORDER BY day)""".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT"))
def w19_trace(spark, sf):
    d = events(spark, sf).groupBy(F.col("created_date_utc").cast("string").alias("day")).agg(rows().alias("n"))
    return reports.trace(d, "day", "n", 3)


@query(f"""WITH {EVENTS}, d AS (SELECT created_date_utc::VARCHAR AS day, count(*) AS n FROM events_ GROUP BY 1), x AS (SELECT day, n - lag(n, 5) OVER (ORDER BY day) AS gain, coalesce(n < lag(n) OVER (ORDER BY day), false) AS falls FROM d)
SELECT (SELECT gain FROM x ORDER BY day DESC LIMIT 1) AS improvement_over_last_5, count(*) FILTER (falls) AS non_monotone_steps FROM x""")
def w20_last_checkpoints(spark, sf):
    d = events(spark, sf).groupBy(F.col("created_date_utc").cast("string").alias("day")).agg(rows().alias("n"))
    x = reports.trace(d, "day", "n", 5)
    return x.agg(F.max_by("over_last_5", "day").alias("improvement_over_last_5"), F.count_if("falls").alias("non_monotone_steps"))


@query(f"""WITH {EVENTS}, r AS (SELECT doc_key, row_number() OVER (ORDER BY created_utc, doc_key) AS i FROM events_) SELECT doc_key FROM r WHERE i % 25 = 1""")
def w21_every_nth(spark, sf):
    r = reports.numbered(events(spark, sf).select("doc_key", "created_utc"), ["created_utc", "doc_key"])
    return r.where("row % 25 = 0").select("doc_key")


@query(f"""WITH {EVENTS}, t AS (SELECT thread_id, count(*) AS n FROM events_ GROUP BY 1), r AS (SELECT thread_id, n, row_number() OVER (ORDER BY n DESC, thread_id) AS rank FROM t)
SELECT thread_id, n, rank::BIGINT AS rank, CASE WHEN rank <= 30 THEN 'above' ELSE 'below' END AS side FROM r WHERE rank BETWEEN 11 AND 50""")
def w23_boundary_window(spark, sf):
    t = events(spark, sf).groupBy("thread_id").agg(rows().alias("n"))
    return reports.boundary(t, "thread_id", "n", 30, 20)


@query(f"""WITH {EVENTS}, t AS (SELECT thread_id, count(*) AS n FROM events_ GROUP BY 1), v AS (SELECT (SELECT min(n) FROM t WHERE n >= 5) AS here, (SELECT max(n) FROM t WHERE n < 5) AS below)
SELECT thread_id, n, CASE WHEN n = here THEN 'at threshold' ELSE 'next below' END AS tied_group FROM t, v WHERE n = here OR n = below""")
def w24_tied_groups(spark, sf):
    t = events(spark, sf).groupBy("thread_id").agg(rows().alias("n"))
    return reports.tied_at(t, "thread_id", "n", 5)


@query(f"""WITH {EVENTS}, t AS (SELECT thread_id, count(*) AS n FROM events_ GROUP BY 1), r AS (SELECT thread_id, n, rank() OVER (ORDER BY n DESC) AS min_rank, count(*) OVER () AS total FROM t)
SELECT thread_id, n, min_rank::BIGINT AS min_rank, round(min_rank / total, 9) AS rank_share FROM r""")
def w13_rank_percentile(spark, sf):
    return reports.rank_share(events(spark, sf).groupBy("thread_id").agg(rows().alias("n")), "thread_id", "n")


@query(f"""WITH {EVENTS}, d AS (SELECT created_date_utc AS day, record_type, count(*) AS n FROM events_ GROUP BY 1, 2) SELECT day::VARCHAR AS day, coalesce(sum(n) FILTER (record_type = 'comment'), 0)::BIGINT AS comment,
  coalesce(sum(n) FILTER (record_type = 'submission'), 0)::BIGINT AS submission, sum(n)::BIGINT AS total FROM d GROUP BY 1""")
def a08_daily_by_type(spark, sf):
    from ..operators import profile

    return profile.daily_wide(events(spark, sf), "created_datetime_utc", "record_type", ["comment", "submission"])



