"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Defined results: null or empty text has no words, fails the base rule and is not kept; other columns
may be null or bear any name, as only id and text are read (``apply_rules`` adds no column).
Repeated rows give a row each. Duplicated 3-word windows are found by hash set and sort inside a row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be this by he at from or an have not "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de et un une du en dans que qui pour par sur pas au avec ce il "
    "el los las y del se por con una su para al lo como más"
).split()


class Rule(NamedTuple):
    """A text passes if low <= numerator / denominator <= high (a zero denominator passes)."""

    name: str
    numerator: str
    denominator: str | None
    low: float
    high: float


#: Thresholds after the public rules for web text (word counts, word lengths, symbols, stop words, lines).
RULES = (
    Rule("words", "n_words", None, 50, float("inf")),
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbol_words", "n_symbols", "n_words", 0, 0.20),
    Rule("stop_words", "n_stop", "n_words", 0.02, 1.0),
    Rule("bullet_lines", "n_bullets", "n_lines", 0, 0.90),
    Rule("ellipsis_lines", "n_ellipses", "n_lines", 0, 0.30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0, 0.50),
    Rule("repeated_words", "n_repeat_words", "n_words", 0, 0.50),
)


def measures(text: Column) -> dict[str, Column]:
    """The counts that rules may use, as expressions over names bound by ``project``."""
    words, lines = F.col("__words"), F.col("__lines")
    # words covered by a window that occurs again: sort windows with their places, keep those equal to a
    # neighbour, and count the union of the places they cover
    covered = F.expr(
        "size(array_distinct(flatten(transform("
        "filter(__sorted, (x, i) -> (i > 0 AND x.g = __sorted[i - 1].g) OR (i + 1 < size(__sorted) AND x.g = __sorted[i + 1].g)),"
        " x -> array(x.i, x.i + 1, x.i + 2)))))"
    )
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.col("__different") == F.size("__grams"), F.lit(0)).otherwise(covered).cast("long"),
        "n_stop": F.size(F.filter(words, lambda w: ascii_lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long"),
        "n_ellipses": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"),
    }


def compile_rules(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """One boolean expression per rule over the measures' names."""
    out = {}
    for r in rules:
        num = F.col(f"__{r.numerator}").cast("double")
        ratio = num if r.denominator is None else F.try_divide(num, F.col(f"__{r.denominator}").cast("double"))
        held = F.lit(True)
        if r.low > float("-inf"):
            held = held & (ratio >= r.low)
        if r.high < float("inf"):
            held = held & (ratio <= r.high)
        out[r.name] = F.coalesce(held, F.lit(True))
    return out


def project(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """carry columns as __c_<name>, the measures as __<name>, __base_failed, __kept and __failed_rules."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`").alias(f"__c_{c}") for c in carry], text.alias("__text"))
    df = df.select(
        "*",
        F.filter(F.split("__text", SPACE), lambda w: w != "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    # a space never occurs in a word, so joined words name a window exactly
    df = df.select(
        "*",
        F.expr(
            "CASE WHEN size(__words) < 3 THEN cast(array() AS array<string>) ELSE transform(slice(__words, 1, size(__words) - 2),"
            " (w, i) -> concat(w, ' ', __words[i + 1], ' ', __words[i + 2])) END"
        ).alias("__grams"),
    )
    df = df.select("*", F.size(F.array_distinct("__grams")).alias("__different"))
    df = df.select(
        "*",
        F.expr(
            "CASE WHEN __different = size(__grams) THEN cast(array() AS array<struct<g: string, i: int>>)"
            " ELSE sort_array(transform(__grams, (g, i) -> struct(g AS g, i AS i))) END"
        ).alias("__sorted"),
    )
    names = [f"__c_{c}" for c in carry]
    df = df.select(*names, *[v.alias(f"__{k}") for k, v in measures(F.col("__text")).items()])
    verdicts = compile_rules(rules)
    failed = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    kept = ~failed
    for v in verdicts.values():
        kept = kept & v
    broken = F.filter(F.array(*[F.when(~v, F.lit(k)) for k, v in verdicts.items()]), lambda x: x.isNotNull())
    return df.select("*", failed.alias("__base_failed"), kept.alias("__kept"), broken.alias("__failed_rules"))


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    out = project(docs, text_col, rules, tuple(docs.columns))
    # a filter would be pushed below the projections, its verdict spelt out in terms of the text again and again: a
    # row number in the condition holds it where it is
    out = out.withColumn("__row", F.monotonically_increasing_id()).where("__kept AND __row >= 0")
    return out.select(*[F.col(f"`__c_{c}`").alias(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = project(table(spark, sf_dir, "documents"), carry=("doc_id",))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
    return out.select(F.col("__c_doc_id").alias("doc_id"), *[F.col(f"__{c}").alias(c) for c in cols]).withColumn(
        "failed_rules", F.array_join("failed_rules", ",")
    )


def _broken(r: Rule) -> str:
    """SQL of a rule's name where a text breaks it."""
    ratio = r.numerator if r.denominator is None else f"{r.numerator} / {r.denominator}"
    bounds = [f"{ratio} < {r.low}"] * (r.low > 0) + [f"{ratio} > {r.high}"] * (r.high < float("inf"))
    given = "true" if r.denominator is None else f"{r.denominator} > 0"
    return f"CASE WHEN {given} AND ({' OR '.join(bounds)}) THEN '{r.name}' END"


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT doc_id, text, words, lines,
    list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS grams
  FROM w
), e AS (
  SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM e) WHERE n > 1
), cover AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id
), m AS (
  SELECT g.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines,
    len(list_filter(words, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({_STOPS}))) AS n_stop,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) AS n_bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_ellipses
  FROM g LEFT JOIN cover USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    list_filter([{', '.join(map(_broken, RULES))}], lambda x: x IS NOT NULL) AS broken
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(broken) = 0 AS kept, array_to_string(broken, ',') AS failed_rules
FROM v
"""
