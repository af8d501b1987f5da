"""Packing token sequences by minimum bin slack.

A document's ids (with the end id) fill whole windows from its start; the rest, shorter than a window, is an item.
Of items only the histogram of lengths is needed (at most ``window`` - 1 numbers, whatever the corpus): a plan on
the driver fills one window after another. Each starts with the longest remaining length; a bitset
subset-sum over the remaining multiset of lengths finds the total closest to the window, and walking back
through the bitsets gives the counts of the lengths that make it. A pattern is repeated as often as
its counts allow. A window whose total is a power of two needs no padding. Items are then dealt to the plan's places by
their rank within their length: ranks come from counts per (task, length), never from a sort of one length.

Where nothing fills the window exactly, the largest total that is a power of two and can be made is taken before the closest one. The ranks' sums over
tasks are Spark's; the driver gets one number a length.

Null or empty text is a document of the end id alone. Rows that repeat an id, or lack one, are documents of their own. Long texts are encoded whole.
An empty table gives no pieces. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table

WINDOW = 4096
MEMO = 600_000
#: What str.split() takes for white space and the vocabulary's pattern does not.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
BORDER = str.maketrans("\t\n\v\f\r", "     ")


class WordIds:
    """Ids of a text as little-endian bytes, word by word. The vocabulary drops white space, so a text's ids are its words' ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        # the vocabulary folds case; A-Z are folded first, so that fewer words are new. Not where a special string may be, which has a case of its own
        if "<|" not in text:
            text = text.encode().lower().decode()
        odd = any(c in text for c in ODD)
        words = text.translate(BORDER).split(" ") if odd else text.split()
        memo = self.memo
        fresh = set(words).difference(memo)
        if not fresh:
            return b"".join(map(memo.__getitem__, words))
        if len(memo) > MEMO:
            memo.clear()
            fresh = set(words)
        memo |= self.encode(list(fresh))
        out = b"".join(map(memo.__getitem__, words))
        for w in fresh:
            if len(w) > 64:
                del memo[w]
        return out

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Of distinct words, in one call; a token belongs to the word that its first character lies in."""
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        firsts = np.array([s for s, _ in e.offsets], np.int64)
        ends = np.cumsum(np.array([len(w) + 1 for w in words], np.int64))
        cut = np.searchsorted(firsts, ends)
        data, at, out = ids.tobytes(), 0, {}
        for w, k in zip(words, cut.tolist(), strict=True):
            out[w] = data[4 * at : 4 * k]
            at = k
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


# --- the plan ----------------------------------------------------------------


def padding(total: int, window: int) -> int:
    """A sequence's padding: none at a power of two."""
    return 0 if total & (total - 1) == 0 else window - total


def best_fill(counts: dict[int, int], first: int, window: int) -> tuple[int, list[tuple[int, int]]]:
    """(total, [(length, number)]): the multiset of lengths up to ``first`` that, with an item of that length, makes the sequence of least padding, of equal ones the longest."""
    room = window - first
    reach, full = 1, (1 << (room + 1)) - 1
    trail: list[tuple[int, int, int]] = []  # length, copies of this entry, bitset before it
    for n in sorted((k for k in counts if k <= min(first, room)), reverse=True):
        left, part = min(counts[n], room // n), 1
        while left > 0 and not reach >> room & 1:
            take = min(part, left)
            grown = (reach | reach << (n * take)) & full
            if grown != reach:
                trail.append((n, take, reach))
                reach = grown
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    powers = [(1 << k) - first for k in range(window.bit_length()) if first <= 1 << k <= window]
    ends = [t for t in (*powers, room, reach.bit_length() - 1) if reach >> t & 1]
    total = at = min(ends, key=lambda t: (padding(first + t, window), -t))
    used: dict[int, int] = {}
    for n, take, before in reversed(trail):
        if not before >> at & 1:  # the total needs this entry
            used[n] = used.get(n, 0) + take
            at -= n * take
    return total, list(used.items())


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """[(first sequence, repeats, [(length, number)])]."""
    counts, out, sequence = dict(histogram), [], 0
    while counts:
        n = max(counts)
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        _, rest = best_fill(counts, n, window)
        pattern: dict[int, int] = {n: 1}
        for k, v in rest:
            pattern[k] = pattern.get(k, 0) + v
        counts[n] = counts.get(n, 0) + 1
        times = min(counts[k] // v for k, v in pattern.items())
        for k, v in pattern.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
        out.append((sequence, times, sorted(pattern.items(), reverse=True)))
        sequence += times
    return out


class Places:
    """Where the item of a given length and rank goes."""

    def __init__(self, patterns: list) -> None:
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        given: dict[int, int] = {}
        for sequence, times, pattern in patterns:
            offset = 0
            for n, v in pattern:
                start = given.get(n, 0)
                spans.setdefault(n, []).append((start, v, sequence, offset))
                given[n] = start + v * times
                offset += n * v
        self.spans = {n: np.array(v, np.int64).T for n, v in spans.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(part) == 0:
                continue
            n = int(length[part[0]])
            start, v, first, at = self.spans[n]
            k = np.searchsorted(start, rank[part], side="right") - 1
            i = rank[part] - start[k]
            sequence[part] = first[k] + i // v[k]
            offset[part] = at[k] + i % v[k] * n
        return sequence, offset


PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """A row per piece with its task, and its rank in the task among pieces of its length."""
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = picked.schema["id"].dataType
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task = word_ids(vocabulary).ids, TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for b in batches:
            row, start, length, crc, total, rank = [], [], [], [], [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                data = ids_of(text) + tail
                n = len(data) // 4
                for s in range(0, n, window):
                    m = min(window, n - s)
                    row.append(r)
                    start.append(s)
                    length.append(m)
                    crc.append(zlib.crc32(data[4 * s : 4 * (s + m)]))
                    total.append(n)
                    rank.append(int(seen[m]))
                    seen[m] += 1
            own = b.column(0).take(pa.array(row, pa.int32()))
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total, rank)]
            yield pa.RecordBatch.from_arrays([own, *longs, pa.array([task] * len(row), pa.int32())], ["id", *PIECE_NAMES, "rank", "task"])

    return picked.mapInArrow(run, T.StructType([T.StructField("id", kind), *T.StructType.fromDDL(f"{PIECE}, rank long, task int").fields]))


PIECE_NAMES = ["start", "length", "ids_crc32", "doc_tokens"]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 2) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    # tasks and ranks must stay as they are once counted, so the pieces (numbers only) are written
    made = materialise(pieces(docs, vocabulary, id_col, text_col, window, end_id), "pieces")
    counted = made.groupBy("task", "length").agg((F.max("rank") + 1).alias("number"))
    before = F.coalesce(F.sum("number").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    ranked = made.join(counted.select("task", "length", before.alias("before")), ["task", "length"])
    ranked = ranked.select("id", *PIECE_NAMES, (F.col("rank") + F.col("before")).alias("rank"))
    sums = {r["length"]: r["number"] for r in counted.groupBy("length").agg(F.sum("number").alias("number")).collect()}  # at most window rows
    whole = sums.pop(window, 0)
    shared = spark.sparkContext.broadcast(Places(plan(sums, window)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for b in batches:
            own, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)
            part = own < window
            sequence[part], offset[part] = places.of(own[part], rank[part])
            sequence[part] += whole
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)], ["id", *PIECE_NAMES, "sequence_id", "offset"])

    schema = T.StructType([*made.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(deal, schema).withColumnRenamed("id", id_col)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
