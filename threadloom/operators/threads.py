"""Canonical events, threads, authors, replies. Flags come from joins on distinct keys and never drop a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import digest

#: The canonical columns, in order.
COLUMNS = (
    "doc_key record_type reddit_id author created_utc created_datetime_utc created_date_utc retrieved_on subreddit subreddit_id thread_id is_thread_root thread_root_in_dataset link_id parent_id "
    "parent_kind parent_in_dataset score num_comments upvote_ratio url title selftext body text text_n_chars raw_json source_file source_row_in_file"
).split()
PREFIX = {"comment": "t1_", "submission": "t3_"}


def doc_key(record_type: Column, id_: Column) -> Column:
    """Prefix by type and the id; another type or a missing id is an error."""
    prefix = F.lit(None).cast("string")
    for kind, p in PREFIX.items():
        prefix = F.when(record_type == kind, p).otherwise(prefix)
    return F.coalesce(F.concat(prefix, id_), F.raise_error(F.lit("record without an id, or of an unknown type")).cast("string"))


def duplicate_ids(source: DataFrame) -> DataFrame:
    """Ids that occur more than once; empty for a sound source."""
    return source.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def canonical(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """One row a record, comments and submissions alike; fields of the other type are null.

    The flags are found over keys alone, so that texts travel once.
    """
    kind = F.lit("comment")
    c = comments.select(doc_key(kind, F.col("id")).alias("doc_key"), kind.alias("record_type"), F.col("id").alias("reddit_id"), F.col("link_id").alias("thread_id"), F.lit(False).alias("is_thread_root"), F.col("body").alias("text"), *[x for x in comments.columns if x != "id"])
    kind = F.lit("submission")
    key = doc_key(kind, F.col("id"))
    s = submissions.select(key.alias("doc_key"), kind.alias("record_type"), F.col("id").alias("reddit_id"), key.alias("thread_id"), F.lit(True).alias("is_thread_root"), F.concat("title", F.lit(" "), "selftext").alias("text"), *[x for x in submissions.columns if x != "id"])
    records = c.unionByName(s, allowMissingColumns=True)
    links = records.select("doc_key", "thread_id", "parent_id", "is_thread_root")
    roots = links.where("is_thread_root").select(F.col("doc_key").alias("thread_id"), F.lit(True).alias("root")).distinct()
    keys = links.select(F.col("doc_key").alias("parent_id"), F.lit(True).alias("parent")).distinct()
    flags = links.select("doc_key", "thread_id", "parent_id").join(roots, "thread_id", "left").join(keys, "parent_id", "left").select("doc_key", "root", "parent").distinct()
    parent = F.col("parent_id")
    at = F.timestamp_seconds("created_utc")
    out = records.join(flags, "doc_key").withColumns({
        "created_datetime_utc": at, "created_date_utc": F.to_date(at), "thread_root_in_dataset": F.col("root").isNotNull(),
        "parent_kind": F.when(parent.startswith("t1_"), "comment").when(parent.startswith("t3_"), "submission").when(parent.isNotNull(), "other"),
        "parent_in_dataset": F.when(parent.isNotNull(), F.col("parent").isNotNull()), "text_n_chars": F.length("text").cast("int"),
    })
    return out.select(*COLUMNS)


def values_of(c: str) -> Column:
    """Distinct values, a null counted as one."""
    return F.count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0))


def thread_summary(events: DataFrame) -> DataFrame:
    """Roots and per-thread counts of comments, joined in full, counts 0 where a side is absent."""
    fields = ("author", "created_utc", "score", "num_comments", "upvote_ratio")
    roots = events.where("is_thread_root").select("thread_id", F.col("doc_key").alias("root_doc_key"), *[F.col(c).alias(f"root_{c}") for c in fields])
    comments = events.where("NOT is_thread_root").groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("n_comments"), values_of("author").alias("n_comment_authors"), F.count_if(F.col("parent_kind") == "submission").alias("n_comments_replying_to_root"),
        F.count_if("parent_in_dataset").alias("n_comments_parent_in_dataset"), F.min("created_utc").alias("first_comment_utc"), F.max("created_utc").alias("last_comment_utc"),
    )
    counts = ("n_comments", "n_comment_authors", "n_comments_replying_to_root", "n_comments_parent_in_dataset")
    out = roots.join(comments, "thread_id", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    has = F.col("root_doc_key").isNotNull()
    return out.withColumns({"root_in_dataset": has, "n_events": F.col("n_comments") + has.cast("long")})


def parent_class() -> Column:
    """Five ordered classes of a comment's parent reference."""
    parent = F.col("parent_id")
    return (
        F.when(~F.coalesce(parent.rlike("^t[13]_[0-9a-z]+$"), F.lit(False)), "malformed").when(parent == F.col("thread_id"), "own submission")
        .when(parent.startswith("t3_"), "other submission").when(F.col("parent_in_dataset"), "comment in sample").otherwise("not in sample")
    )


def linkage(events: DataFrame) -> DataFrame:
    """26 facts in long form, from three groupings: events, threads, authors."""
    comment, kind, there = ~F.col("is_thread_root"), F.col("parent_kind"), F.coalesce("parent_in_dataset", F.lit(False))
    missing = F.coalesce(~F.col("parent_in_dataset"), F.lit(False))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    one = {
        "comments": n(comment), "submissions": n(~comment), "comments: submission present": n(comment & F.col("thread_root_in_dataset")), "comments: submission absent": n(comment & ~F.col("thread_root_in_dataset")),
        "comments: parent present": n(comment & there), "comments: parent absent": n(comment & missing), "comments: no parent": n(comment & F.col("parent_id").isNull()),
        "comments: to a comment": n(comment & (kind == "comment")), "comments: to a submission": n(comment & (kind == "submission")), "comments: to another form": n(comment & (kind == "other")),
        "comments: to a comment, present": n(comment & (kind == "comment") & there), "comments: to a comment, absent": n(comment & (kind == "comment") & missing),
        "comments: to a submission, present": n(comment & (kind == "submission") & there), "comments: to a submission, absent": n(comment & (kind == "submission") & missing),
        "comments: to their own submission": n(comment & (kind == "submission") & (F.col("parent_id") == F.col("link_id"))),
    }
    threads = events.groupBy("thread_id").agg(F.count_if(comment).alias("c"), F.count_if(~comment).alias("s"))
    two = {
        "threads": F.count(F.lit(1)), "threads with a comment": n(F.col("c") > 0), "threads: root present": n(F.col("s") > 0), "threads: root absent": n(F.col("s") == 0),
        "threads with a comment: root present": n((F.col("c") > 0) & (F.col("s") > 0)), "submissions with a comment": F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("s"))), F.lit(0)),
        "submissions without a comment": F.coalesce(F.sum(F.when(F.col("c") == 0, F.col("s"))), F.lit(0)),
    }
    authors = events.groupBy("author").agg(F.bool_or(comment).alias("c"), F.bool_or(~comment).alias("s"))
    three = {"authors": F.count(F.lit(1)), "authors of comments": n(F.col("c")), "authors of submissions": n(F.col("s")), "authors of both": n(F.col("c") & F.col("s"))}
    out = None
    for df, facts in ((events, one), (threads, two), (authors, three)):
        row = df.agg(*[v.cast("long").alias(k) for k, v in facts.items()]).unpivot([], [F.col(f"`{k}`") for k in facts], "item", "value")
        out = row if out is None else out.unionByName(row)
    return out


def first_replies(replies: DataFrame) -> DataFrame:
    """Per root: the first reply by (time, author, line, part), all replies, those at the earliest second, seconds to it."""
    by_second = replies.groupBy("root", "root_time", "time").agg(F.min(F.struct("author", "line", "part")).alias("f"), F.count(F.lit(1)).alias("n"))
    out = by_second.groupBy("root", "root_time").agg(F.min(F.struct("time", "f", "n")).alias("first"), F.sum("n").alias("n_replies"))
    return out.select("root", F.col("first.f.author").alias("first_author"), "n_replies", F.col("first.n").alias("n_tied"), (F.col("first.time") - F.col("root_time")).alias("elapsed"))


def author_summary(events: DataFrame) -> DataFrame:
    """Per author value, a null among them."""
    return events.groupBy("author").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(~F.col("is_thread_root")).alias("n_comments"), F.count_if("is_thread_root").alias("n_submissions"), values_of("thread_id").alias("n_threads"),
        F.min("created_utc").alias("first_created_utc"), F.max("created_utc").alias("last_created_utc"), F.count_distinct("created_date_utc").alias("n_active_days"),
    )


def concentration(texts: DataFrame, text: str) -> DataFrame:
    """Lorenz curve over exact texts: frequencies are grouped first, so the window runs over distinct frequencies only."""
    counts = texts.groupBy(text).agg(F.count(F.lit(1)).alias("occurrences")).groupBy("occurrences").agg(F.count(F.lit(1)).alias("n_texts"))
    w = Window.orderBy(F.desc("occurrences")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = F.col("occurrences") * F.col("n_texts")
    return counts.select(
        "occurrences", "n_texts", F.round(F.sum("n_texts").over(w) / F.sum("n_texts").over(every), 9).alias("text_share"), F.round(F.sum(rows).over(w) / F.sum(rows).over(every), 9).alias("row_share")
    )


def top_texts(df: DataFrame, text: str, most: int) -> DataFrame:
    """The commonest texts, ties in the texts' order. Counting needs digests alone; texts travel only for counts that may be among the first."""
    c = df.select(digest(F.col(text)).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("occurrences"))
    edge = c.orderBy(F.desc("occurrences")).limit(most).agg(F.min("occurrences").alias("least"))
    c = c.crossJoin(F.broadcast(edge)).where("occurrences >= least").select("d", "occurrences")  # one row
    t = df.select(digest(F.col(text)).alias("d"), F.col(text).alias("t")).join(c, "d").dropDuplicates(["d"]).orderBy(F.desc("occurrences"), "t").limit(most)
    one = F.trim(F.regexp_replace("t", r"\s+", " "))
    preview = F.when(F.length(one) > 60, F.concat(F.substring(one, 1, 60), F.lit("..."))).otherwise(one)
    return t.select(F.md5("t").alias("text_md5"), "occurrences", F.length("t").cast("long").alias("n_chars"), preview.alias("preview"))
