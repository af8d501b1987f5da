"""Benchmark decontamination by greedy string tiling.

Words are lower-cased (A-Z) with outer punctuation left on. Seeds: a benchmark item's runs of ``seed`` words. A text that
shares a seed with an item is a candidate pair; on it running Karp-Rabin greedy string tiling repeatedly marks the
longest matches that overlap no earlier ones, down to ``least`` words, so reordered passages are covered by several tiles. An
item leaks into a text if ``share`` percent of the item's words are covered (items under ``least`` words: all of them in one run).

Finding candidates: the benchmark's words and seeds go to all tasks if the benchmark has at most ``BROADCAST_WORDS`` words
(about 100 bytes each); beyond it the texts' runs are joined with the seeds by hash. Seeds are no longer than the tiles, so no pair that tiling
could flag is missed.

Null and empty texts leak nothing; null, empty or wordless items are in no text. Rows that repeat an id give a row each, as do
repeated items; ids may be null. Ties between equally long matches go to the first in the item, then in the text. Without items, or without texts, nothing leaks.
Texts are tiled whole, however long. ``leaks`` reads the id and text columns alone, ``decontaminate`` returns its rows' own columns, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, ascii_lower, materialise, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOWN = str.maketrans(UPPER, LOWER)
SEED, LEAST, SHARE = 4, 4, 60
BROADCAST_WORDS = 500_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(DOWN)) if text else []


def tiles(item: list[str], text: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in item, start in text, words) of greedy string tiling.

    Each round looks for matches of a length that falls from the longest possible: windows of that length are hashed (Karp-Rabin, a rolling
    hash of word numbers), equal hashes are compared and extended, and the longest extensions are marked first.
    """
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    a = [number[w] for w in item]
    b = [number.get(w, 0) for w in text]
    free_a, free_b = [True] * len(a), [x > 0 for x in b]
    out: list[tuple[int, int, int]] = []
    base, mod = 1_000_003, (1 << 61) - 1

    def rolled(seq: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
        top, h, run = pow(base, size, mod), 0, 0
        for i, x in enumerate(seq):
            if not free[i]:
                h = run = 0
                continue
            h, run = (h * base + x) % mod, run + 1
            if run > size:
                h = (h - seq[i - size] * top) % mod
            if run >= size:
                yield i - size + 1, h

    size = min(len(a), len(b))
    while size >= least:
        places = defaultdict(list)
        for j, h in rolled(b, free_b, size):
            places[h].append(j)
        found: list[tuple[int, int, int]] = []
        for i, h in rolled(a, free_a, size) if places else ():
            for j in places.get(h, ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k >= size:
                    found.append((-k, i, j))
        longest = size
        for k, i, j in sorted(found):
            k = -k
            if all(free_a[i : i + k]) and all(free_b[j : j + k]):
                free_a[i : i + k] = free_b[j : j + k] = [False] * k
                out.append((i, j, k))
                longest = max(longest, k)
        if longest > 2 * size:
            continue
        size = size - 1 if size <= 2 * least else max(least, size * 3 // 4)
    return out


def coverage(item: list[str], text: list[str], least: int = LEAST) -> tuple[int, int]:
    """(item's words covered, tiles)."""
    found = tiles(item, text, min(least, max(1, len(item))))
    return sum(k for _, _, k in found), len(found)


class Seeds:
    """The benchmark in a task: words, seeds, items."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int) -> None:
        self.items = items
        self.vocabulary = {w for _, words in items for w in words}
        self.by: dict[int, dict[tuple[str, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for n, (_, words) in enumerate(items):
            k = min(seed, len(words))
            for i in range(len(words) - k + 1):
                if k:
                    self.by[k][tuple(words[i : i + k])].add(n)
        self.by = {k: dict(v) for k, v in self.by.items()}

    def candidates(self, text: list[str]) -> set[int]:
        out: set[int] = set()
        inside = list(map(self.vocabulary.__contains__, text))
        if True not in inside:
            return out
        for k, seeds in self.by.items():
            run = 0
            for i, x in enumerate(inside):
                run = run + 1 if x else 0
                if run >= k and (got := seeds.get(tuple(text[i - k + 1 : i + 1]))):
                    out |= got
        return out


RESULT = "item_id long, item_words long, covered long, n_tiles long"


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    seed: int = SEED, least: int = LEAST, share: int = SHARE, broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """id, item_id, item_words, covered, n_tiles, coverage of every leak."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").alias("item_text")).where("item_text IS NOT NULL")
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    words = F.filter(F.split(ascii_lower(F.col("item_text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    size = items.select(F.sum(F.size(words)), F.sum(F.octet_length("item_text"))).first()
    schema = T.StructType([picked.schema["id"], *T.StructType.fromDDL(RESULT).fields])

    def flagged(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(columns)], [f.name for f in schema.fields])

    def judged(i, text: list[str], item: int, item_words: list[str]) -> Iterator[tuple]:
        covered, n = coverage(item_words, text, least)
        if 100 * covered >= share * len(item_words):
            yield i, item, len(item_words), covered, n

    if (size[0] or 0) <= broadcast_words and (size[1] or 0) <= 20 * broadcast_words:
        kept = [(r["item"], w) for r in items.collect() if (w := words_of(r["item_text"]))]
        shared = spark.sparkContext.broadcast((kept, min(seed, least)))
        cache: dict = {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = cache.get(0) or cache.setdefault(0, Seeds(*shared.value))
            for b in batches:
                rows = []
                for i, text in zip(b.column(0).to_pylist(), map(words_of, b.column(1).to_pylist()), strict=True):
                    for n in sorted(seeds.candidates(text)):
                        rows += judged(i, text, *seeds.items[n])
                yield flagged(rows, b.column(0).type)

        out = picked.mapInArrow(run, schema)
    else:
        k = min(seed, least)
        run_of = f"transform(sequence(0, greatest(0, size(ws) - {k})), i -> xxhash64(slice(ws, i + 1, {k})))"
        text_words = F.filter(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        own = items.select("item", "item_text", words.alias("ws")).where("size(ws) > 0").withColumn("no", F.monotonically_increasing_id())
        own = materialise(own, "items")  # so that the numbers stay
        # items under k words have runs of their own length; texts are asked for all lengths up to k
        by = own.select("no", F.least(F.size("ws"), F.lit(k)).alias("k"), F.explode(F.array_distinct(F.expr(run_of))).alias("h")).where("k > 0")
        asked = None
        numbered = picked.withColumn("row", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))  # what leaks into a row depends on its text alone
        for n in [r[0] for r in by.select("k").distinct().collect()]:  # at most k lengths
            grams = F.expr(f"CASE WHEN size(ws) < {n} THEN cast(array() AS array<bigint>) ELSE array_distinct(transform(sequence(0, size(ws) - {n}), i -> xxhash64(slice(ws, i + 1, {n})))) END")
            part = numbered.select("row", text_words.alias("ws")).select("row", F.lit(n).alias("k"), F.explode(grams).alias("h"))
            asked = part if asked is None else asked.unionByName(part)
        if asked is None:
            return spark.createDataFrame([], schema).withColumn("coverage", F.lit(0.0)).withColumnRenamed("id", id_col)
        pairs = asked.join(by, ["k", "h"]).select("row", "no").distinct()
        met = pairs.join(numbered, "row").join(own.select("no", "item", "item_text"), "no").select("id", "text", "item", "item_text")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for i, text, item, item_text in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                    rows += judged(i, words_of(text), item, words_of(item_text))
                yield flagged(rows, b.column(0).type)

        out = met.mapInArrow(check, schema)
    return out.withColumn("coverage", F.col("covered") / F.col("item_words")).withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that no item leaks into, with their own columns; rows with a null id stay if their text is clean too."""
    spark = docs.sparkSession
    most = options.get("broadcast_words", BROADCAST_WORDS)
    least, share, seed = options.get("least", LEAST), options.get("share", SHARE), options.get("seed", SEED)
    words = F.filter(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    given = benchmark.select(F.col(f"`{options.get('item_text_col', 'text')}`").alias("text")).where(F.col("text").isNotNull() & (F.size(words) > 0))
    size = given.select(F.sum(F.size(words)), F.sum(F.octet_length("text"))).first()
    if (size[0] or 0) > most or (size[1] or 0) > 20 * most:
        # what leaks into a row depends on its text alone, so rows are flagged by their texts' digests, whatever their ids
        keyed = docs.withColumn("__key", F.sha2(F.col(f"`{text_col}`").cast("binary"), 256))
        texts = keyed.select("__key", F.col(f"`{text_col}`").alias("text")).where("__key IS NOT NULL").dropDuplicates(["__key"])
        found = leaks(texts, benchmark, "__key", "text", **options).select("__key").distinct()
        return keyed.join(found, "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    items = [w for r in given.collect() if (w := words_of(r[0]))]
    shared = spark.sparkContext.broadcast(([(n, w) for n, w in enumerate(items)], min(seed, least)))
    cache: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = cache.get(0) or cache.setdefault(0, Seeds(*shared.value))
        for b in batches:
            k = b.schema.get_field_index(text_col)
            clean = []
            for text in map(words_of, b.column(k).to_pylist()):
                hit = any(100 * coverage(seeds.items[n][1], text, least)[0] >= share * len(seeds.items[n][1]) for n in sorted(seeds.candidates(text)))
                clean.append(not hit)
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
