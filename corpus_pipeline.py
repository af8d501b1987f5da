"""From raw documents to packed training sequences: quality rules, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import op2_secret_scans, op5_ngram_jaccard, op6_decontamination, op9_packing, op10_quality_rules
from threadloom.llm.common import materialise, release, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules. Null and empty texts fail them; rows that repeat are judged alike; nulls in other columns do not matter."""
    return op10_quality_rules.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8: that with the smallest id, of rows that share it one of the smallest hash of the text.

    Rows equal in id and text count as one document. A row without an id stays only if no row of its group has one. Null, empty and wordless texts are in no group; they all stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    keyed = docs.withColumn("__key", key)
    found = op5_ngram_jaccard.jaccard_components(keyed, "__key", "text", k=5, threshold=80)
    gone = materialise(found.where("__key <> component_id").select("__key").distinct(), "gone")
    if gone.count() <= op5_ngram_jaccard.BROADCAST_IDS:  # so the texts need no shuffle
        gone = F.broadcast(gone)
    left = keyed.join(gone, "__key", "left_anti")
    # rows equal in id and text: one of each, told by counts, so that only such rows move
    again = found.where("n_shingles > 0").groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key")
    again = materialise(again, "again")
    again = F.broadcast(again) if again.count() <= op5_ngram_jaccard.BROADCAST_IDS else again
    one = left.join(again, "__key", "left_semi").dropDuplicates(["__key"])
    return left.join(again, "__key", "left_anti").unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into, judged by their texts alone: null and empty texts stay, equal rows are judged alike. Without items all stay."""
    return op6_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text. Null and empty texts stay as they are, with n_chars null and 0."""
    out = op2_secret_scans.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 4096. A null or empty text is its end id; rows without an id, and rows that repeat one, are packed each for itself."""
    import public_tokenizers

    return op9_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: Tokenizers and similarity components are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        new = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            new = materialise(new, name.replace(" ", "_"))
        if n:  # what a stage has read is not read again: the last one has written its pieces
            release(spark, docs)
        docs = new
    return docs
