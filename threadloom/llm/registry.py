"""The queries of this folder and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "op1_warc",
    "op2_secret_scans",
    "op3_token_counts",
    "op4_chat_formatting",
    "op5_ngram_jaccard",
    "op6_decontamination",
    "op7_language_id",
    "op8_lm_scoring",
    "op9_packing",
    "op10_quality_rules",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: getattr(import_module(f"{__package__}.{n}"), n) for n in NAMES}


def oracle_sql() -> dict[str, str]:
    modules = {n: import_module(f"{__package__}.{n}") for n in NAMES}
    return {n: m.SQL for n, m in modules.items() if hasattr(m, "SQL")}
