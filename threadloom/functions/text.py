"""Text expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"(?i)(https?://|www\.)\S+"
LETTERS = r"(\p{L}+(?:'\p{L}+)*)"


def whitespace_tokens(text: Column) -> Column:
    """Runs without Unicode white space; case and punctuation stay."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def letter_runs(text: Column) -> Column:
    """Lower-cased letter runs with inner apostrophes; URLs out, final 's off."""
    clean = F.regexp_replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), URL, " ")
    return F.transform(F.regexp_extract_all(clean, F.lit(LETTERS), F.lit(1)), lambda w: F.when(w.endswith("'s"), F.left(w, F.length(w) - 2)).otherwise(w))


def letters_only(text: Column) -> Column:
    """A normal form for near copies: lower case, URLs out, all but letters one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), URL, " "), r"[^\p{L}]+", " "))


def right_closed(value: Column, breaks: list[float], labels: list[str]) -> Column:
    """Bands (b0, b1], (b1, b2], ...; the last is open above."""
    out = F.when(value <= breaks[0], F.lit(None).cast("string"))
    for top, label in zip(breaks[1:], labels, strict=False):
        out = out.when(value <= top, label)
    return out.otherwise(labels[-1]) if len(labels) == len(breaks) else out
