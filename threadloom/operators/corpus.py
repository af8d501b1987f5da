"""Token accounting, similarity reports and checks of a corpus and of models fitted on it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LETTERS, URL, letter_runs
from ..sources.scratch import cut
from . import topics
from .checks import check_rows
from .reports import marker_only, rows

#: A short list of function words of the four languages.
STOP = ["the", "of", "and", "to", "in", "der", "die", "und", "von", "le", "la", "les", "de", "et", "el", "los", "que", "y"]
#: Right edges of the bands of comment lengths.
LENGTH_BANDS = [(1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100"), (200, "101-200")]


def token_steps(docs: DataFrame) -> DataFrame:
    """Per document: its letter runs and what each step removes; within rows, without a shuffle. ``candidates`` is what is left."""
    w = docs.select("doc_key", "record_type", marker_only(F.col("text")).alias("marker_only"), F.coalesce(letter_runs(F.col("text")), F.array().cast("array<string>")).alias("runs"))
    long = F.filter("runs", lambda x: F.length(x) >= 2)
    left = F.filter(long, lambda x: ~x.isin(*STOP))
    n = lambda c: F.size(c).cast("long")
    return w.select("doc_key", "record_type", "marker_only", n("runs").alias("n_letters"), (n("runs") - n(long)).alias("n_short"), (n(long) - n(left)).alias("n_stop"), left.alias("candidates"))


def counters(docs: DataFrame, floor: int = 5, ceiling: float = 0.5) -> DataFrame:
    """The token counters of every document; the vocabulary comes from documents that are more than a marker."""
    steps = cut(token_steps(docs))
    live = steps.agg(F.count_if(~F.col("marker_only")).alias("live"))
    tokens = steps.where("NOT marker_only").select("doc_key", F.explode("candidates").alias("term")).groupBy("doc_key", "term").agg(rows().alias("n"))
    terms = tokens.groupBy("term").agg(rows().alias("df")).crossJoin(F.broadcast(live)).where((F.col("df") >= floor) & (F.col("df") <= ceiling * F.col("live"))).select("term")  # one row
    modeled = tokens.join(terms, "term").groupBy("doc_key").agg(F.sum("n").alias("m"))
    out = steps.join(modeled, "doc_key", "left").withColumn("n_candidate", F.size("candidates").cast("long")).withColumn("n_modeled", F.coalesce("m", F.lit(0)))
    rare = F.when(F.col("marker_only"), 0).otherwise(F.col("n_candidate") - F.col("n_modeled"))
    return out.withColumn("n_rare", rare).withColumn("n_excluded", F.when(F.col("marker_only"), F.col("n_candidate")).otherwise(0)).drop("candidates", "m")


def model_status() -> Column:
    return (
        F.when(F.col("marker_only"), "not modeled: marker only").when(F.col("n_letters") == 0, "not modeled: no letters").when(F.col("n_candidate") == 0, "not modeled: short or stopwords")
        .when(F.col("n_modeled") == 0, "not modeled: outside the vocabulary").otherwise("modeled")
    )


def steps_not_taken(docs: DataFrame) -> DataFrame:
    """What other rules would have given: distinct tokens with case, folded, without possessives; tokens between blanks, tokens with digits."""
    no_curl = F.replace(F.col("text"), F.lit("’"), F.lit("'"))
    clean = F.regexp_replace(F.lower(no_curl), URL, " ")
    rows_ = docs.select(
        F.regexp_extract_all(F.regexp_replace(no_curl, URL, " "), F.lit(LETTERS), F.lit(1)).alias("cased"), F.regexp_extract_all(clean, F.lit(LETTERS), F.lit(1)).alias("folded"),
        F.regexp_count(clean, F.lit(r"\S+")).alias("ws"), F.regexp_count(clean, F.lit(r"\S*\d\S*")).alias("digits"),
    )
    one = rows_.agg(F.sum("ws").cast("long").alias("whitespace_tokens"), F.sum("digits").cast("long").alias("digit_tokens"))
    cased = rows_.select(F.explode("cased").alias("w")).distinct().agg(rows().alias("distinct_cased"))
    folded = rows_.select(F.explode("folded").alias("w")).groupBy("w").agg(rows().alias("n"))
    bare = folded.groupBy(F.regexp_replace("w", "'s$", "").alias("b")).agg(rows().alias("k"), F.sum(F.when(F.col("w").endswith("'s"), F.col("n")).otherwise(0)).alias("p"))
    two = bare.agg(F.sum("k").alias("distinct_folded"), rows().alias("distinct_without_possessive"), F.sum("p").alias("possessives"))
    return one.crossJoin(cased).crossJoin(two)  # one row each


def occurrences(docs: DataFrame, entries: list[str]) -> DataFrame:
    """How often each entry of a list occurs as a token: in all documents, and in those that are more than a marker."""
    held = F.filter(letter_runs(F.col("text")), lambda w: w.isin(*entries))
    n = docs.select(marker_only(F.col("text")).alias("m"), F.explode(held).alias("entry")).groupBy("entry").agg(rows().alias("a"), F.count_if(~F.col("m")).alias("b"))
    every = docs.sparkSession.createDataFrame([(e,) for e in entries], "entry string")
    return every.join(n, "entry", "left").select("entry", F.coalesce("a", F.lit(0)).alias("n_all"), F.coalesce("b", F.lit(0)).alias("n_without_markers"))


def conditions(first: DataFrame, second: DataFrame) -> DataFrame:
    """The same items under two lists, side by side; comparable where both have them."""
    x, y = first.select(F.col("entry").alias("a"), F.col("n_all").alias("under_first")), second.select(F.col("entry").alias("b"), F.col("n_all").alias("under_second"))
    both = x.join(y, F.col("a") == F.col("b"), "full")
    return both.select(F.coalesce("a", "b").alias("item"), "under_first", "under_second", (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("comparable"))


# --- similarity -----------------------------------------------------------------


def shared_terms(counts: tuple[DataFrame, DataFrame], pairs: DataFrame, most: int) -> DataFrame:
    """The terms that contribute most to each pair's dot product, with counts and share; ties by term."""
    tf, df = counts
    w = cut(tf.join(df, "term").select("doc_id", "term", "tf", (F.col("tf") * F.ln(F.col("n_docs") / F.col("df"))).alias("w")))
    mine = pairs.join(w.select("doc_id", "term", F.col("tf").alias("count_comment"), F.col("w").alias("w1")), "doc_id")
    theirs = w.select(F.col("doc_id").alias("other"), "term", F.col("tf").alias("count_submission"), F.col("w").alias("w2"))
    s = mine.join(theirs, ["other", "term"]).withColumn("c", F.col("w1") * F.col("w2")).where("c > 0")
    of = Window.partitionBy("doc_id")
    s = s.withColumn("share", F.round(F.col("c") / F.sum("c").over(of), 6)).withColumn("contribution", F.round("c", 6)).withColumn("rank", F.row_number().over(of.orderBy(F.desc("contribution"), "term")))
    return s.where(F.col("rank") <= most).select("doc_id", "other", "term", "count_comment", "count_submission", "contribution", "share")


def by_length(similar: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cosines by band of the comment's length."""
    n, band = F.col("n"), None
    for top, label in LENGTH_BANDS:
        band = F.when(n <= top, label) if band is None else band.when(n <= top, label)
    x = similar.where("cosine IS NOT NULL").join(sizes, "doc_id").select(band.otherwise("201+").alias("band"), "cosine")
    q = lambda p, c: F.round(F.percentile("cosine", p), 6).alias(c)
    return x.groupBy("band").agg(rows().alias("comments"), F.round(F.avg((F.col("cosine") == 0).cast("int")), 9).alias("share_zero"), q(0.25, "p25"), q(0.5, "median"), F.round(F.avg("cosine"), 6).alias("mean"), q(0.75, "p75"), F.max("cosine").alias("most"))


def nearest_to(df: DataFrame, value: str, key: str, at: tuple[int, ...], most: int) -> DataFrame:
    """The rows nearest to each percentile, ties by key."""
    q = df.agg(F.array(*[F.struct(F.lit(p).alias("p"), F.percentile(value, p / 100).alias("target")) for p in at]).alias("q")).select(F.inline("q"))
    near = df.select(key, value).crossJoin(F.broadcast(q)).withColumn("gap", F.round(F.abs(F.col(value) - F.col("target")), 6))  # a row a percentile
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("p").orderBy("gap", key)).cast("long"))
    return best.where(F.col("rank") <= most).select("p", "rank", key, value)


def vocabulary_what_if(terms: DataFrame) -> DataFrame:
    """The vocabulary of exact strings, and what it would shrink to if case or edge punctuation were dropped."""
    t = F.col("term")
    v = terms.select("term", "df", F.regexp_replace(t, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "").alias("bare"))
    return v.agg(
        rows().alias("terms"), F.count_if(F.col("df") == 1).alias("in_one_document"), F.count_if(t.rlike("^https?://")).alias("addresses"), F.count_if(t.rlike(r"^[\p{P}\p{S}]|[\p{P}\p{S}]$")).alias("edge_punctuation"),
        F.count_if(t.rlike(r"\p{Lu}")).alias("with_upper_case"), F.count_distinct(F.lower(t)).alias("folded"), F.count_distinct("bare").alias("stripped"), F.count_distinct(F.lower("bare")).alias("both"),
    )


def whole_words(docs: DataFrame, words: list[str]) -> DataFrame:
    """Occurrences of words with no letter or apostrophe beside them, and documents that have them; one pass."""
    t = F.lower("text")
    n = [F.coalesce(F.regexp_count(t, F.lit(rf"(?<![\p{{L}}'])\Q{w}\E(?![\p{{L}}'])")), F.lit(0)).alias(f"n{i}") for i, w in enumerate(words)]
    row = docs.select(*n).agg(*[a for i in range(len(words)) for a in (F.sum(f"n{i}").cast("long").alias(f"s{i}"), F.count_if(F.col(f"n{i}") > 0).alias(f"d{i}"))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"s{i}").alias("occurrences"), F.col(f"d{i}").alias("documents")) for i, w in enumerate(words)])))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, lang, number of tokens of two letters or more; within rows."""
    return docs.select("doc_id", "lang", F.size(F.filter(F.coalesce(letter_runs(F.col("text")), F.array().cast("array<string>")), lambda w: F.length(w) >= 2)).cast("long").alias("n"))


def _letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


def _runs_by_hand(text: str | None) -> list[str]:
    """Letter runs without a pattern for them: characters in turn."""
    t = re.sub(r"(?i)(https?://|www\.)[^ \t\n\x0b\f\r]+", " ", (text or "").lower().replace("’", "'"))
    out = []
    for inside, group in groupby(t, lambda c: _letter(c) or c == "'"):
        if not inside:
            continue
        parts, run = "".join(group).split("'"), []
        for p in [*parts, ""]:
            if p:
                run.append(p)
            elif run:
                out.append("'".join(run))
                run = []
    return [w.removesuffix("'s") for w in out]


def second_path(docs: DataFrame) -> DataFrame:
    """Documents whose tokens differ between the expression and the hand-written tokenizer; a task holds the tokens of one document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = sum(_runs_by_hand(b.column(0)[i].as_py()) != (b.column(1)[i].as_py() or []) for i in range(b.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([differ], pa.int64())], ["documents", "differ"])

    n = docs.select("text", letter_runs(F.col("text")).alias("runs")).mapInArrow(run, "documents long, differ long")
    return n.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("differ"), F.lit(0)).alias("differ"))


# --- models -----------------------------------------------------------------------


def one_standard_error(fits: DataFrame, size: str, loss: str) -> DataFrame:
    """The smallest model whose mean loss is within one standard deviation (at the best) of the least; ties to the smaller."""
    g = fits.groupBy(size).agg(F.avg(loss).alias("p"), F.coalesce(F.stddev_samp(loss), F.lit(0.0)).alias("sd"))
    best = g.agg(F.min(F.struct("p", size, "sd")).alias("b")).select((F.col("b.p") + F.col("b.sd")).alias("limit"))
    near = g.crossJoin(F.broadcast(best)).where("p <= limit")  # one row
    return near.agg(F.min(size).alias("chosen"), F.round(F.max("limit"), 6).alias("threshold"))


def proxies(m: topics.Model, most: int, least_tokens: int) -> DataFrame:
    """k, rank, doc_id, type-token ratio and top words present, of the documents with the largest share of each topic."""
    r = m.theta.where(F.col("nd") >= least_tokens).withColumn("s", F.round("share", 9))
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("s"), "doc_id")).cast("long")).where(F.col("rank") <= most).select("k", "rank", "doc_id")
    r = F.broadcast(cut(r))  # topics x most rows
    held = m.docs.join(r.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.inline("cells")).groupBy("doc_id", "term").agg(F.sum("n").alias("n"))
    types = held.groupBy("doc_id").agg(F.round(rows() / F.greatest(F.sum("n"), F.lit(1)), 9).alias("ttr"))
    top = topics.ranked_words(m, 10).select("k", "term")
    present = held.join(r, "doc_id").join(top, ["k", "term"]).groupBy("k", "doc_id").agg(rows().alias("present"))
    return r.join(types, "doc_id").join(present, ["k", "doc_id"], "left").select("k", "rank", "doc_id", "ttr", F.coalesce("present", F.lit(0)).alias("top_words_present"))


def summary_of_two(a: topics.Model, b: topics.Model) -> DataFrame:
    """section, item, first, second of two fits."""

    def facts(m: topics.Model) -> DataFrame:
        d = topics.dominant(m).agg(F.count_distinct("k").cast("double").alias("d"), F.round(F.avg("share"), 6).alias("s"))
        largest = m.theta.groupBy("k").agg((F.sum(F.col("share") * F.col("nd")) / F.sum("nd")).alias("x")).agg(F.round(F.max("x"), 6).alias("l"))
        cells = (("size", "topics", F.lit(float(m.k))), ("size", "topics that dominate a document", F.col("d")), ("documents", "mean dominant share", F.col("s")), ("topics", "largest token share", F.col("l")))
        return d.crossJoin(largest).select(F.inline(F.array(*[F.struct(F.lit(x).alias("section"), F.lit(y).alias("item"), v.alias("v")) for x, y, v in cells])))  # one row each

    return facts(a).withColumnRenamed("v", "first").join(facts(b).withColumnRenamed("v", "second"), ["section", "item"])


#: So many of the most frequent terms tell of almost every document that it keeps a term.
TELLING = 1000


def conversion(docs: DataFrame, counts: DataFrame, floor: int) -> DataFrame:
    """stage, n: documents, tokens and terms that a conversion to kept terms enters with and leaves with. counts: doc_id and cells, a row a document; it is read several times."""
    terms = cut(counts.select("doc_id", F.inline("cells")).groupBy("term").agg(rows().alias("df"), F.sum("n").alias("n")))
    kept = F.col("df") >= floor
    often = [r.term for r in terms.where(kept).orderBy(F.desc("df"), "term").limit(TELLING).collect()]
    sure = F.arrays_overlap(F.transform("cells", lambda c: c["term"]), F.array(*map(F.lit, often)).cast("array<string>"))
    left = counts.where(~sure).select("doc_id", F.inline("cells")).join(terms.where(kept).select("term"), "term").select("doc_id").distinct().agg(F.count("doc_id").alias("d"))
    after = counts.agg(F.count(F.when(sure, F.col("doc_id"))).alias("s")).crossJoin(left).select((F.col("s") + F.col("d")).alias("documents after conversion"))
    a, d = docs.agg(rows().alias("documents in source")), counts.agg(F.count("doc_id").alias("documents with tokens"))
    total = lambda c, x: F.coalesce(F.sum(F.when(x, F.col(c))), F.lit(0)).cast("long")
    b = terms.agg(
        total("n", F.lit(True)).alias("tokens"), rows().alias("terms"), total("n", kept).alias("tokens after conversion"), F.count_if(kept).alias("terms after conversion"), total("df", kept).alias("cells"),
    )
    row = a.crossJoin(d).crossJoin(after).crossJoin(b)  # one row each
    return row.unpivot([], [F.col(f"`{x}`") for x in row.columns], "stage", "n")


def splines(df: DataFrame, time: str, knots: int) -> DataFrame:
    """How many rows' spline bases of their time sum to 1. Knots are percentiles, so each batch needs these few numbers alone."""
    at = df.select((F.unix_micros(F.col(time).cast("timestamp")) / 86400e6).alias("x"))
    row = at.agg(F.min("x"), F.max("x"), F.percentile("x", [i / (knots + 1) for i in range(1, knots + 1)])).first()
    low, high, inner = row[0], row[1], np.array(row[2])

    def run(batches):
        for b in batches:
            basis = topics.spline_basis_at(b["x"].to_numpy(), low, high, inner)
            yield pd.DataFrame({"sums": [int((np.abs(basis.sum(1) - 1) < 1e-9).sum())], "n": [len(b)], "columns": [basis.shape[1]]})

    made = at.mapInPandas(run, "sums long, n long, columns int")
    return made.agg(F.sum("n").alias("rows_"), F.sum("sums").alias("rows_that_sum_to_1"), F.max("columns").alias("columns"))


def design(df: DataFrame, key: str, factors: list[str]) -> DataFrame:
    """(key, col): the ones of a sparse design matrix; columns by factor, then level. Levels may be many: they are joined, not collected."""
    long = df.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors]))).where("level IS NOT NULL")
    levels = long.groupBy("factor", "level").agg(rows().alias("n"))
    at = F.row_number().over(Window.orderBy("factor", "level"))  # a row a level
    return long.join(levels.select("factor", "level", at.cast("long").alias("col")), ["factor", "level"]).select(key, "col")


def lift_labels(m: topics.Model, most: int, least: int) -> DataFrame:
    """k, term, lift: the terms whose probability in a topic exceeds their share most, of those seen often enough there."""
    total = m.mass.agg(F.sum("nk").alias("total"))
    pw = m.terms().crossJoin(F.broadcast(total)).select("term", (F.col("n") / F.col("total")).alias("pw"))  # one row
    s = m.phi.where(F.col("n") >= least).join(pw, "term").select("k", "term", F.round(F.ln(F.col("p") / F.col("pw")), 9).alias("x"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("x"), "term"))).where(F.col("rank") <= most)
    return r.select("k", "term", F.round("x", 6).alias("lift"))


def fit_log(lines: DataFrame) -> DataFrame:
    """iteration, estep, mstep: seconds from a log's lines; an M-step that reports none took 0."""
    seconds = F.regexp_extract("s", r"\((\d+) seconds\)", 1)
    w = Window.partitionBy("step").orderBy("line")  # a log's lines are few
    step = F.when(F.col("s").startswith("Completed E-Step"), "e").when(F.col("s").startswith("Completed M-Step"), "m")
    x = lines.withColumn("step", step).where("step IS NOT NULL").withColumn("iteration", F.row_number().over(w).cast("long")).withColumn("v", F.when(seconds == "", 0.0).otherwise(F.try_to_number(seconds, F.lit("999999")).cast("double")))
    return x.groupBy("iteration").agg(F.max(F.when(F.col("step") == "e", F.col("v"))).alias("estep"), F.max(F.when(F.col("step") == "m", F.col("v"))).alias("mstep"))


def linkage_checks(m: topics.Model, tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """Named checks that a fit belongs to its corpus. tokens: n, the number of each document's tokens."""
    per = m.theta.groupBy("doc_id").agg(F.sum("share").alias("s"))
    one = per.agg(rows().alias("docs"), F.bool_and(F.abs(F.col("s") - 1) < 1e-9).alias("sums"))
    two = topics.dominant(m).agg(rows().alias("dominants"))
    three = m.assigned.agg(F.sum("n").alias("assigned")).crossJoin(tokens.agg(F.sum("n").alias("tokens")))
    strangers = per.join(docs.select("doc_id"), "doc_id", "left_anti").agg(rows().alias("strangers"))
    none = F.lit("")
    row = one.crossJoin(two).crossJoin(three).crossJoin(strangers)  # one row each
    return check_rows(row, [
        ("one dominant topic a document", none, F.col("dominants") == F.col("docs")), ("shares sum to 1", none, F.col("sums")), ("tokens are those of the source", none, F.col("assigned") == F.col("tokens")),
        ("documents are those of the source", none, F.col("strangers") == 0),
    ]).select("check", "status")
