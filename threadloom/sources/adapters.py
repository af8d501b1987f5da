"""Shapes the supplied tables as threaded messages, corpora, activity, labellings and lists; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DAY0 = 1751328000
#: Rows that the supplied conversations lack: absent roots and parents, markers, missing and malformed values.
SUBMISSION_ROWS = [
    # id, title, selftext, author, created, score, num_comments, upvote_ratio
    ("fxa", "A", "", "u1", DAY0 + 10, 5, 4, 0.9),
    ("fxb", "B", "[removed]", "[deleted]", DAY0 + 20, -2, 1, 0.4),
    ("fxd", "[ Removed by Reddit ]", "", "[deleted]", DAY0 + 90000, 0, 0, 0.5),
    ("fxe", "E", "nobody answers", "u1", DAY0 + 180000, 1, 0, 1.0),
]
COMMENT_ROWS = [
    # id, parent_id, link_id, author, body, created, score
    ("fxc1", "t3_fxa", "t3_fxa", "u2", "hello\nworld", DAY0 + 60, 1),
    ("fxc2", "t1_fxc1", "t3_fxa", "u1", "", DAY0 + 120, 2),
    ("fxc3", "t1_zz", "t3_fxb", "[deleted]", "[deleted]", DAY0 + 180, 0),
    ("fxc4", "t3_fxq", "t3_fxq", "u3", "Anna’s https://x.co/a O'Brien 12", DAY0 + 240, -1),
    ("fxc5", "t1_fxc1", "t3_fxa", "u3", "Hello world", DAY0 + 120, 3),
    ("fxc6", "t3_fxb", "t3_fxa", None, "[removed]", DAY0 + 300, 1),
    ("fxc7", "x9_bad", "t3_fxa", None, " [deleted] ", DAY0 + 90060, 1),
    ("fxc8", None, "t3_fxb", "u4", "[ Removed by Reddit ]", DAY0 + 90120, 1),
    ("fxc9", "t1_fxc5", "t3_fxa", "u4", "[note]", DAY0 + 90180, 4),
    ("fxca", "t1_fxc9", "t3_fxa", "u4", "[note]", DAY0 + 5, 4),
]


def _literal(v) -> str:
    if v is None:
        return "NULL"
    return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if isinstance(v, str) else repr(v)


def values_sql(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)


def _origin(c: DataFrame, fixture: DataFrame) -> DataFrame:
    """Both kinds of rows with what they have in common; a conversation counts as a source file."""
    extra = {"subreddit": F.lit("talk"), "subreddit_id": F.lit("t5_talk"), "raw_json": F.lit(None).cast("string")}
    both = c.unionByName(fixture.withColumns({"source_file": F.lit("fixture"), "source_row_in_file": F.lit(None).cast("int")}), allowMissingColumns=True)
    return both.withColumns(extra).withColumn("retrieved_on", F.col("created_utc") + 86400)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn 0 of each conversation, all of its text as the title, and the fixture's rows."""
    conv = F.col("conv_id").cast("string")
    c = read(spark, sf_dir, "conversations").where("turn = 0").select(
        F.concat(F.lit("v"), conv).alias("id"), F.col("text").alias("title"), F.lit("").alias("selftext"), F.concat_ws("_", "role", (F.col("conv_id") % 40).cast("string")).alias("author"),
        (F.lit(DAY0) + F.col("conv_id") * 977 % 2592000).cast("long").alias("created_utc"), (F.col("conv_id") % 9 - 2).cast("long").alias("score"), (F.col("conv_id") % 7).cast("long").alias("num_comments"),
        (F.col("conv_id") % 50 / 100.0 + 0.5).alias("upvote_ratio"), F.concat(F.lit("conversations/"), conv).alias("source_file"), (F.col("turn") + 1).cast("int").alias("source_row_in_file"),
    )
    fixture = spark.createDataFrame(SUBMISSION_ROWS, "id string, title string, selftext string, author string, created_utc long, score long, num_comments long, upvote_ratio double")
    return _origin(c, fixture).withColumn("url", F.concat(F.lit("https://example.org/"), "id"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other turns, each an answer to the turn before, and the fixture's rows."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    before = F.concat(F.lit("t1_v"), conv, F.lit("c"), (F.col("turn") - 1).cast("string"))
    c = read(spark, sf_dir, "conversations").where("turn > 0").select(
        F.concat(F.lit("v"), conv, F.lit("c"), turn).alias("id"), F.when(F.col("turn") == 1, F.concat(F.lit("t3_v"), conv)).otherwise(before).alias("parent_id"),
        F.concat(F.lit("t3_v"), conv).alias("link_id"), F.concat_ws("_", "role", ((F.col("conv_id") + F.col("turn")) % 40).cast("string")).alias("author"), F.col("text").alias("body"),
        (F.lit(DAY0) + F.col("conv_id") * 977 % 2592000 + F.col("turn") * 600).cast("long").alias("created_utc"), ((F.col("conv_id") + F.col("turn")) % 9 - 2).cast("long").alias("score"),
        F.concat(F.lit("conversations/"), conv).alias("source_file"), (F.col("turn") + 1).cast("int").alias("source_row_in_file"),
    )
    fixture = spark.createDataFrame(COMMENT_ROWS, "id string, parent_id string, link_id string, author string, body string, created_utc long, score long")
    return _origin(c, fixture)


SOURCES = f"""submissions AS (
  SELECT *, created_utc + 86400 AS retrieved_on, 'talk' AS subreddit, 't5_talk' AS subreddit_id, 'https://example.org/' || id AS url, NULL::VARCHAR AS raw_json FROM (
    SELECT 'v' || conv_id AS id, text AS title, '' AS selftext, role || '_' || (conv_id % 40) AS author, ({DAY0} + conv_id * 977 % 2592000)::BIGINT AS created_utc, (conv_id % 9 - 2)::BIGINT AS score,
      (conv_id % 7)::BIGINT AS num_comments, (conv_id % 50) / 100.0::DOUBLE + 0.5::DOUBLE AS upvote_ratio, 'conversations/' || conv_id AS source_file, (turn + 1)::INTEGER AS source_row_in_file
    FROM conversations WHERE turn = 0
    UNION ALL SELECT id, title, selftext, author, created::BIGINT, score::BIGINT, nc::BIGINT, up::DOUBLE, 'fixture', NULL FROM ({values_sql(SUBMISSION_ROWS)}) AS t(id, title, selftext, author, created, score, nc, up))
), comments AS (
  SELECT *, created_utc + 86400 AS retrieved_on, 'talk' AS subreddit, 't5_talk' AS subreddit_id, NULL::VARCHAR AS raw_json FROM (
    SELECT 'v' || conv_id || 'c' || turn AS id, CASE WHEN turn = 1 THEN 't3_v' || conv_id ELSE 't1_v' || conv_id || 'c' || (turn - 1) END AS parent_id, 't3_v' || conv_id AS link_id,
      role || '_' || ((conv_id + turn) % 40) AS author, text AS body, ({DAY0} + conv_id * 977 % 2592000 + turn * 600)::BIGINT AS created_utc, ((conv_id + turn) % 9 - 2)::BIGINT AS score,
      'conversations/' || conv_id AS source_file, (turn + 1)::INTEGER AS source_row_in_file
    FROM conversations WHERE turn > 0
    UNION ALL SELECT id, parent_id, link_id, author, body, created::BIGINT, score::BIGINT, 'fixture', NULL FROM ({values_sql(COMMENT_ROWS)}) AS t(id, parent_id, link_id, author, body, created, score))
)"""

EVENTS = SOURCES + """, keyed AS (
  SELECT 't1_' || id AS doc_key, 'comment' AS record_type, id AS reddit_id, link_id AS thread_id, false AS is_thread_root, body AS text, * EXCLUDE (id) FROM comments
  UNION ALL BY NAME SELECT 't3_' || id AS doc_key, 'submission' AS record_type, id AS reddit_id, 't3_' || id AS thread_id, true AS is_thread_root, title || ' ' || selftext AS text, * EXCLUDE (id) FROM submissions
), events_ AS (
  SELECT k.*, make_timestamp(created_utc * 1000000) AS created_datetime_utc, make_timestamp(created_utc * 1000000)::DATE AS created_date_utc, r.doc_key IS NOT NULL AS thread_root_in_dataset,
    CASE WHEN k.parent_id LIKE 't1!_%' ESCAPE '!' THEN 'comment' WHEN k.parent_id LIKE 't3!_%' ESCAPE '!' THEN 'submission' WHEN k.parent_id IS NOT NULL THEN 'other' END AS parent_kind,
    CASE WHEN k.parent_id IS NOT NULL THEN p.doc_key IS NOT NULL END AS parent_in_dataset, length(k.text)::INTEGER AS text_n_chars
  FROM keyed k LEFT JOIN (SELECT DISTINCT doc_key FROM keyed WHERE is_thread_root) r ON r.doc_key = k.thread_id LEFT JOIN (SELECT DISTINCT doc_key FROM keyed) p ON p.doc_key = k.parent_id
)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are roots, lines are comments: root, author, reply time and root time in epoch seconds."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.unix_timestamp("o_orderdate").alias("root_time"))
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", F.unix_timestamp("l_shipdate").alias("time"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("root"), F.col("l_suppkey").alias("author"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "time", "root_time"
    )


REPLIES = """replies AS (
  SELECT o_orderkey AS root, l_suppkey AS author, l_linenumber AS line, l_partkey AS part,
    epoch(l_shipdate)::BIGINT AS time, epoch(o_orderdate)::BIGINT AS root_time
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def labellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one set of vectors: a with noise at every 7th, b with labels merged in pairs and noise at every 5th."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")).cast("long").alias("a"),
        F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.floor(F.col("label") / 2)).cast("long").alias("b"),
    )


LABELLINGS = """labellings AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END::BIGINT AS a,
    CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label // 2 END::BIGINT AS b
  FROM embeddings
)"""

#: How each run changes the supplied labels: noise at every n-th vector, and the label of the others.
RUNS = {
    "B0": (7, "label"), "B1": (5, "label"), "B2": (9, "(label + CASE WHEN vec_id % 11 = 0 THEN 1 ELSE 0 END) % 10"), "B3": (6, "(label + CASE WHEN vec_id % 3 = 0 THEN 5 ELSE 0 END) % 10"),
    "B4": (8, "(label * 3) % 10"), "U_few": (4, "label % 4"), "U_many": (10, "label * 2 + vec_id % 2"), "H_leaf": (3, "label * 3 + vec_id % 3"), "H_one": (2, "0"),
}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long assignments of all runs: doc_key, run_id, cluster_label, membership_probability; -1 is noise."""
    e = read(spark, sf_dir, "embeddings")
    cells = [f"struct('{r}' AS run_id, CAST(CASE WHEN vec_id % {n} = 0 THEN -1 ELSE {x} END AS bigint) AS cluster_label, CASE WHEN vec_id % {n} = 0 THEN 0D ELSE (vec_id % 101) / 100D END AS membership_probability)" for r, (n, x) in RUNS.items()]
    return e.select(F.concat(F.lit("t1_"), F.col("vec_id").cast("string")).alias("doc_key"), F.inline(F.array(*map(F.expr, cells))))


RUNS_SQL = "runs AS (" + " UNION ALL ".join(
    f"SELECT 't1_' || vec_id AS doc_key, '{r}' AS run_id, CASE WHEN vec_id % {n} = 0 THEN -1 ELSE {x} END::BIGINT AS cluster_label, CASE WHEN vec_id % {n} = 0 THEN 0 ELSE (vec_id % 101) / 100::DOUBLE END AS membership_probability FROM embeddings" for r, (n, x) in RUNS.items()
) + ")"

TOKEN = r"(\p{L}+(?:'\p{L}+)*)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, term) of each letter run of the lower-cased texts, possessives off, single letters out."""
    from ..functions.text import letter_runs

    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", F.explode(letter_runs(F.col("text"))).alias("term")).where(F.length("term") >= 2)


TOKENS = r"""tokens AS (
  SELECT doc_id, source, lang, term FROM (
    SELECT doc_id, source, lang, regexp_replace(unnest(regexp_extract_all(
      regexp_replace(replace(lower(text), chr(8217), ''''), '(https?://|www\.)\S+', ' ', 'gi'), '(\p{L}+(?:''\p{L}+)*)', 1)), '''s$', '') AS term
    FROM documents)
  WHERE length(term) >= 2
)"""


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a list of the terms that at least 3 of its documents hold."""
    from ..operators.text import term_counts

    t = term_counts(read(spark, sf_dir, "documents"), "source").select("doc_id", "source", F.inline("cells"))  # a row a document, list and term
    return t.groupBy(F.col("source").alias("list_id"), F.col("term").alias("entry")).agg(F.count("doc_id").alias("n")).where("n >= 3").select("list_id", "entry")


LISTS = TOKENS + """, lists AS (
  SELECT source AS list_id, term AS entry FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3
)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists with the families they descend from: family, its root, and whether a list is firm."""
    number = F.expr("CAST(substring(list_id, 4) AS int)")
    out = lists(spark, sf_dir).withColumn("k", number)
    return out.select("list_id", "entry", F.concat(F.lit("f"), (F.col("k") % 4).cast("string")).alias("family"), (F.col("k") < 4).alias("is_root"), (F.col("k") % 3 != 0).alias("firm"))


MEMBERS = LISTS + """, members AS (SELECT list_id, entry, 'f' || (substr(list_id, 4)::INTEGER % 4) AS family, substr(list_id, 4)::INTEGER < 4 AS is_root, substr(list_id, 4)::INTEGER % 3 <> 0 AS firm FROM lists)"""

#: Raw word lists as files have them: curly apostrophes, blanks, case, repeats, letters with combining marks.
RAW_LISTS = [
    (name, i + 1, e)
    for name, entries in {
        "alpha": ["The", "don’t", " of ", "the", "", "a  lot", "it's"],
        "beta": ["don't", "of", "the", "well-known", "a lot", "it's"],
        "delta": ["dont", "of", "the", "its", "a lot"],
        "epsilon": ["the", "of", "don't", "a lot", "it's"],
        "gamma": ["donʼt", "café", "café", "2nd", "12", "—", "the", "x"],
        "small": ["of", "the"],
    }.items()
    for i, e in enumerate(entries)
]


def raw_lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RAW_LISTS, "list_id string, position int, raw_entry string")


RAW = f"raw_lists AS (SELECT * FROM ({values_sql(RAW_LISTS)}) AS t(list_id, position, raw_entry))"
NORMAL = RAW + r""", steps AS (SELECT *, nfc_normalize(raw_entry) AS e1, regexp_replace(nfc_normalize(raw_entry), '[\x{2018}\x{2019}\x{02BC}\x{2032}]', '''', 'g') AS e2 FROM raw_lists),
steps4 AS (SELECT *, trim(e2) AS e3, regexp_replace(trim(e2), '\s+', ' ', 'g') AS e4, lower(regexp_replace(trim(e2), '\s+', ' ', 'g')) AS entry FROM steps),
entries AS (SELECT list_id, position, raw_entry, entry, concat_ws(';', CASE WHEN e1 <> raw_entry THEN 'nfc' END, CASE WHEN e2 <> e1 THEN 'apostrophe' END, CASE WHEN e3 <> e2 THEN 'trim' END, CASE WHEN e4 <> e3 THEN 'whitespace' END, CASE WHEN entry <> e4 THEN 'case' END) AS changes,
  CASE WHEN entry = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY list_id, entry ORDER BY position) > 1 THEN 'duplicate_within_list' ELSE '' END AS dropped FROM steps4),
classed AS (SELECT list_id, entry, position, CASE WHEN regexp_matches(entry, '\s') THEN 'multiword' WHEN regexp_full_match(entry, '[a-z]+') THEN 'word' WHEN regexp_full_match(entry, '[a-z]+(-[a-z]+)+') THEN 'hyphenated' WHEN regexp_full_match(entry, '[a-z'']+') THEN 'apostrophe'
  WHEN regexp_full_match(entry, '[0-9]+') THEN 'numeric' WHEN regexp_matches(entry, '[a-z]') AND regexp_matches(entry, '[0-9]') THEN 'alphanumeric' WHEN NOT regexp_matches(entry, '[a-z0-9]') THEN 'punctuation_or_symbol' ELSE 'other_characters' END AS entry_class
  FROM entries WHERE dropped = '')"""
