"""Vocabulary, TF-IDF, cosines over long (document, term) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import letter_runs
from ..sources.scratch import cut


def _run_lengths(w: Column) -> Column:
    """The different values of an array that is not empty, in order, with their counts."""

    def of(a: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (a[i] != a[i - 1]))
        return F.transform(F.array(first), lambda at: F.transform(at, lambda i, j: F.struct(a[i].alias("term"), (F.coalesce(F.try_element_at(at, j + 2), F.size(a)) - i).cast("long").alias("n"))))[0]

    return F.transform(F.array(F.sort_array(w)), of)[0]


def term_counts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, more, cells: a row a document (and value of the columns ``more``) that has tokens of two letters or more, its terms in order with their counts.

    Counted within rows; only documents whose id repeats are shuffled.
    """
    by = ["doc_id", *more]
    w = docs.select(*by, F.filter(letter_runs(F.col("text")), lambda x: F.length(x) >= 2).alias("w")).where(F.size("w") > 0)
    again = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again")))
    if again.isEmpty():
        return w.select(*by, _run_lengths(F.col("w")).alias("cells"))
    same = w["doc_id"].eqNullSafe(again["again"])
    one = w.join(again, same, "left_anti").select(*by, _run_lengths(F.col("w")).alias("cells"))
    long = w.join(again, same, "left_semi").select(*by, F.explode("w").alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(by_document(long, *more))


def by_document(cells: DataFrame, *more: str) -> DataFrame:
    """doc_id, more, cells of a long table (doc_id, term, n): each document's terms in order."""
    return cells.groupBy("doc_id", *more).agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("cells"))


def counted(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, tf) and (term, df, n, n_docs): both from one shuffle of tokens by document and term, which Spark reuses."""
    tf = tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    docs = tf.agg(F.count_distinct("doc_id").alias("n_docs"))
    return tf, tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n")).crossJoin(F.broadcast(docs))  # one row


def vocabulary(docs: DataFrame, floor: int = 5, ceiling: float = 0.5) -> DataFrame:
    """Terms with document frequency, count and why they are kept or not. docs: doc_id and cells, a row a document, read once: only sums by term are shuffled."""
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("n")))  # stands for the document itself
    terms = cut(docs.select("doc_id", F.inline(F.concat("cells", whole))).groupBy("term").agg(F.count("doc_id").alias("df"), F.sum("n").alias("n")))
    n_docs = F.broadcast(terms.where("term IS NULL").select(F.col("df").alias("n_docs")))  # one row
    reason = F.when(F.col("df") < floor, "rare").when(F.col("df") > ceiling * F.col("n_docs"), "common").otherwise("kept")
    return terms.where("term IS NOT NULL").crossJoin(n_docs).select("term", "df", "n", reason.alias("reason"))


def tf_idf(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, weight): count * ln(N / df), no smoothing."""
    tf, df = counted(tokens)
    return cut(tf.join(df, "term").select("doc_id", "term", (F.col("tf") * F.ln(F.col("n_docs") / F.col("df"))).alias("weight")))


def cosine_with(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, other, cosine, status) for each pair; null where a norm is 0."""
    norm = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    mine = pairs.join(weights, "doc_id")
    theirs = weights.select(F.col("doc_id").alias("other"), "term", F.col("weight").alias("w2"))
    dot = mine.join(theirs, ["other", "term"]).groupBy("doc_id", "other").agg(F.sum(F.col("weight") * F.col("w2")).alias("dot"))
    out = pairs.join(dot, ["doc_id", "other"], "left").join(norm, "doc_id", "left")
    out = out.join(norm.select(F.col("doc_id").alias("other"), F.col("norm").alias("norm2")), "other", "left")
    both = F.col("norm") * F.col("norm2")
    cosine = F.when(both > 0, F.round(F.coalesce("dot", F.lit(0.0)) / both, 6))
    return out.select("doc_id", "other", cosine.alias("cosine"), F.when(both > 0, "scored").otherwise("no weight").alias("status"))


def token_counters(docs: DataFrame) -> DataFrame:
    """Per document: letter tokens, distinct ones, type-token ratio; within rows, without a shuffle."""
    kept = F.filter(letter_runs(F.col("text")), lambda w: F.length(w) >= 2)
    n = docs.select("doc_id", F.coalesce(kept, F.array().cast("array<string>")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_terms"))
    return n.withColumn("ttr", F.round(F.col("n_terms") / F.greatest("n_tokens", F.lit(1)), 9))
