"""Language-model scoring: a probabilistic suffix tree over words, whose root is the unigram base.

Training rows are all texts whose crc32(id as text) mod 7 is not 2. Every one of them is counted:

* level 0: all distinct words (and one end a text), by 64-bit hash. The root's law is the base, (c + 1) / (N + V + 1).
* level 1: all pairs of words that follow one another; a text starts after an end.
* level 2: all words that follow a pair.

A context s that occurs ``LEAST`` times or more (by level) has a law of its own for its entries, the words b seen after it ``ENTRY`` times or
more: P(b|s) = (c(s,b) + k P(b|parent)) / (N(s) + k), k the number of its entries and of all other occurrences (near the number of
different followers, as Witten and Bell have it); all other words share what is left, as bow(s) P(b|parent), so that the laws add up to 1. The divergence test: s stays if N(s) * KL, the log-likelihood that its law gains on the training
texts over its parent's, is more than ``GAIN`` nats, and if its own suffix stays. A text's score is the sum of log10 P(word | longest suffix state),
its end included.

In logs everything adds up: base + bow of the kept contexts + delta of the entries met, delta = log P(b|s) - log bow(s) - log P(b|parent).
So a text's score is a sum over keys, 64-bit hashes of its words, pairs and triples: a word adds its base and its bow, a pair its delta and its bow as a
context, a triple its delta. The keys' numbers are in distributed tables, whatever their count. The ``SHARED_WORDS`` most frequent words, the
``SHARED_STATES`` most frequent pairs that may be contexts and, for scoring, the ``SHARED_PAIRS`` most frequent pairs and triples are broadcast as well (at most 24 bytes each). Pairs of shared words are counted under one
packed number and get their words' counts from the broadcast; pairs with another word are counted by hash and joined with the words. Counts go to their sums in sorted blocks by bucket. Texts ask for the
keys that are not shared and that a Bloom filter of ``BLOOM`` bits lets pass, a task's in one sorted block for each bucket of keys; a bucket's values and the blocks
that ask for them meet in one task, the buckets in ``PASSES`` goes, so that only a part of what was asked is copied at a time. All this saves time and disk and does not change results.

A context's entries, its different followers, are learned together in one task.

Null texts are empty; an empty text is its end alone. Rows that repeat an id are scored each for itself; rows without one train. Without training
rows N and V are 0 and the tree is its root; an empty table gives no rows. Long texts are scored whole. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, mix, release, slices, table, text_bytes, trim, word_hashes

if TYPE_CHECKING:  # tasks without it are smaller
    import pandas as pd

LEAST, ENTRY, GAIN = (0, 8, 8), 2, 10.0
SHARED_WORDS, SHARED_STATES, SHARED_PAIRS, BLOOM = 1 << 21, 1 << 20, 1 << 20, 1 << 27
#: About how many values and asked keys a bucket has; in how many goes buckets are answered at most, and how many buckets make a go of their own worth it.
BUCKET, PASSES, LEAST_BUCKETS = 3_000_000, 8, 6
#: A pair of shared words is one number, the first's place shifted by so many bits.
PLACE = 21
#: The key of a text's end among the words' hashes.
END_KEY = 0


def trains(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 7 != 2, F.lit(True))


_INDEX: dict[int, tuple[np.ndarray, np.ndarray, int, int]] = {}


def position(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked number stands in sorted keys, -1 where it does not.

    Keys are hashes, so the first bits tell nearly where a key is; an index by them is kept for the arrays in use.
    """
    if not len(keys) or not len(asked):
        return np.full(len(asked), -1, np.int64)
    held = _INDEX.get(id(keys))
    if held is None or held[0] is not keys:
        bits = max(1, len(keys).bit_length() - 2)
        prefix = (keys >> (64 - bits)) + (1 << (bits - 1))
        start = np.searchsorted(prefix, np.arange((1 << bits) + 1)).astype(np.int32)
        while len(_INDEX) >= 2:
            _INDEX.pop(next(iter(_INDEX)))
        held = _INDEX[id(keys)] = keys, start, bits, int(np.diff(start).max())
    _, start, bits, most = held
    group = (asked >> (64 - bits)) + (1 << (bits - 1))
    at, end = start[group], start[group + 1]
    out = np.full(len(asked), -1, np.int64)
    left = np.flatnonzero(at < end)
    at, end, want = at[left], end[left], asked[left]
    for _ in range(most):
        if not len(left):
            break
        k = keys[at]
        hit = k == want
        out[left[hit]] = at[hit]
        on = np.flatnonzero((k < want) & (at + 1 < end))
        left, at, end, want = left[on], at[on] + 1, end[on], want[on]
    return out


def value_at(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values at these places, 0 at -1."""
    return np.where(at >= 0, values[at], 0) if len(values) else np.zeros(len(at), values.dtype)


def key_of(level: int, context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The keys of pairs (level 1: a word and the next) or triples (2: a pair and the pair of its last two words)."""
    x, y = context.astype(np.int64).view(np.uint64), last.astype(np.int64).view(np.uint64)
    return mix(mix(x + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15) + y).view(np.int64)


def symbols(b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words and ends of the texts in order: row and key; the word before and the pair; whether a triple ends there."""
    words, row = word_hashes(*text_bytes(b))
    key, of = np.full(len(words) + len(b), END_KEY, np.int64), np.empty(len(words) + len(b), np.int64)
    at = np.arange(len(words)) + row
    key[at], of[at] = words.view(np.int64), row
    of[np.searchsorted(row, np.arange(len(b)), side="right") + np.arange(len(b))] = np.arange(len(b))
    before = np.concatenate([[END_KEY], key[:-1]])
    return of, key, before, key_of(1, before, key), np.concatenate([[False], of[1:] == of[:-1]])


def bits_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in the Bloom filter."""
    h = mix(keys.astype(np.int64).view(np.uint64))
    return (h % np.uint64(BLOOM)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(BLOOM)).astype(np.int64)


def maybe(filter_: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter; none without one."""
    if filter_ is None:
        return np.zeros(len(keys), bool)
    one, two = bits_of(keys)
    return ((filter_[one >> 6] >> (one & 63)) & (filter_[two >> 6] >> (two & 63)) & 1).astype(bool)


@dataclass
class Words:
    """The most frequent words: sorted keys and counts; filters of the others that may be contexts and entries."""

    keys: np.ndarray
    n: np.ndarray
    contexts: np.ndarray | None
    entries: np.ndarray | None
    z: int

    def entry(self, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """s, its count and b (meaningless where the word is not held) of places of contexts and words."""
        return self.keys[place], self.n[place], np.append(self.keys, 0)[np.minimum(word, len(self.keys))]

    def law(self, word: np.ndarray) -> np.ndarray:
        """The base's log10 law of the words at these places."""
        return np.log10(np.append(self.n, 0)[np.minimum(word, len(self.n))] + 1.0) - np.log10(self.z)


@dataclass
class Tree:
    """What all tasks hold for scoring: of the most frequent words what each adds to the base and beyond it, of pairs and triples the latter; a filter of all other keys."""

    words: np.ndarray
    base: np.ndarray
    bow: np.ndarray
    keys: np.ndarray
    gain: np.ndarray
    others: np.ndarray | None


def planes(x: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The numbers between cuts, as bytes: the lowest of each, then the next ones, as far as any is not 0."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    x = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width]
    return pa.array([x[i:j].T.tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())


def numbers(data: bytes, size: int) -> np.ndarray:
    """What ``planes`` has written of so many numbers."""
    out = np.zeros((size, 8), np.uint8)
    at = np.frombuffer(data, np.uint8).reshape(-1, size)
    out[:, : len(at)] = at.T
    return out.reshape(-1).view(np.uint64)


#: Counted keys of a bucket: sorted numbers as steps from the first, b (empty where s says all), counts.
BLOCK = "bucket int, size int, first long, s binary, b binary, n binary"


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches, put together until they have ``most`` rows."""
    held: list[list[np.ndarray]] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append([c.to_numpy() for c in batch.columns])
        if held and (batch is None or sum(len(x[0]) for x in held) >= most):
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []


def dealt(value: np.ndarray, bucket: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Sorted numbers by bucket: their order and the cuts between buckets; of each bucket its number, its size, the first of its numbers and the steps from there on."""
    order = np.argsort(bucket.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
    size = np.bincount(bucket.astype(np.int64), minlength=parts)
    some = np.flatnonzero(size)
    cut = np.concatenate([[0], np.cumsum(size[some])])
    value = value[order]
    first = value[cut[:-1]]
    value[1:] -= value[:-1].copy()
    value[cut[:-1]] = 0
    return order, cut, [pa.array(some, pa.int32()), pa.array(size[some], pa.int32()), pa.array(first.view(np.int64)), planes(value, cut)]


def blocks_of(s: np.ndarray, n: np.ndarray, parts: int, key: np.ndarray | None = None, b: np.ndarray | None = None) -> pa.RecordBatch:
    """A block for each bucket. s: sorted numbers, their bucket is the remainder by parts and only the quotient is written; with b, the bucket is that of the key and s is written whole."""
    whole = s.view(np.uint64)
    value = whole if b is not None else whole // np.uint64(parts)
    bucket = key.view(np.uint64) % np.uint64(parts) if b is not None else whole - value * np.uint64(parts)
    order, cut, columns = dealt(value, bucket, parts)
    columns += [planes(b[order].view(np.uint64), cut) if b is not None else pa.array([b""] * (len(cut) - 1), pa.binary()), planes(n[order].view(np.uint64), cut)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BLOCK.split(", ")])


def dealt_keys(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """What ``dealt`` returns for keys in any order, whose bucket is the remainder by parts; their quotients are written."""
    order = np.argsort(key.view(np.uint64))
    whole = key.view(np.uint64)[order]
    value = whole // np.uint64(parts)
    by, cut, columns = dealt(value, whole - value * np.uint64(parts), parts)
    return order[by], cut, columns


def keys_of(bucket: int, size: int, first: int, data: bytes, parts: int) -> np.ndarray:
    """The keys of a block that ``dealt_keys`` has written."""
    value = np.cumsum(numbers(data, size)) + np.uint64(first % (1 << 64))
    return (value * np.uint64(parts) + np.uint64(bucket)).view(np.int64)


def runs(s: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Where equal neighbours begin."""
    new = s[1:] != s[:-1]
    return np.flatnonzero(np.concatenate([[True], new if b is None else new | (b[1:] != b[:-1])]))


def summed(picked: DataFrame, counted, every: bool = False) -> DataFrame:
    """(s, b, n) of those seen ENTRY times or more, or of all (every). counted(batch) gives numbers that are a key of their own (their b is -1) and (key, s, b) of others, whose key says which (s, b) it is.

    They are summed within tasks as far as a bounded memory allows and then over all, a bucket at a time. What goes there are blocks and no rows.
    """
    parts = 4 * int(picked.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1  # a bucket is held by a worker, so it is kept small; odd, as packed numbers end in places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[np.ndarray] = []
        far: list[tuple[np.ndarray, ...]] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            if sum(map(len, near)):
                s = np.concatenate(near).view(np.uint64)
                near.clear()
                s.sort()
                first = runs(s)
                yield blocks_of(s[first], np.diff(np.append(first, len(s))), parts)
            if sum(len(x[0]) for x in far):
                key, s, b = (np.concatenate(x) for x in zip(*far, strict=True))
                far.clear()
                order = np.argsort(key)
                first = runs(key[order])
                n, order = np.diff(np.append(first, len(key))), order[first]
                by = np.argsort(s[order].view(np.uint64))
                order = order[by]
                yield blocks_of(s[order], n[by], parts, key[order], b[order])

        for batch in batches:
            for x in slices(batch, 0, 1 << 20):
                one, other = counted(x)
                near.append(one)
                if other is not None:
                    far.append(other)
                if sum(map(len, near)) + 3 * sum(len(x[0]) for x in far) > 4_000_000:
                    yield from flushed()
        yield from flushed()
        trim()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a bucket."""
        near, far = [], []
        for batch in batches:
            for bucket, size, start, s, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = np.cumsum(numbers(s, size)) + np.uint64(start % (1 << 64))
                if b:
                    far.append((value.view(np.int64), numbers(b, size).view(np.int64), numbers(n, size).view(np.int64)))
                else:
                    near.append(((value * np.uint64(parts) + np.uint64(bucket)).view(np.int64), numbers(n, size).view(np.int64)))
        for held in (near, far):
            if not held:
                continue
            s, *b, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((b[0], s)) if b else np.argsort(s)
            s, b, n = s[order], b[0][order] if b else None, n[order]
            first = runs(s, b)
            n = np.add.reduceat(n, first)
            keep = slice(None) if every else np.flatnonzero(n >= ENTRY)
            s = s[first][keep]
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), -1) if b is None else b[first][keep]), pa.array(n[keep])], ["s", "b", "n"])
            del s, b, n, order, first, keep
        trim()

    return picked.mapInArrow(run, BLOCK).repartitionById(parts, F.col("bucket")).mapInArrow(total, "s long, b long, n long").coalesce(parts // 4)  # fewer files, the buckets of a task one after the other


def count_words(train: DataFrame) -> DataFrame:
    """(key, n): the words by hash, and the ends."""
    return summed(train, lambda x: (symbols(x.column(0))[1], None), every=True).select(F.col("s").alias("key"), "n")


def count_pairs(train: DataFrame, shared) -> DataFrame:
    """(s, b, n): the pairs seen ENTRY times or more whose words may be context and entry. Of two shared words s is their packed number and b is -1."""

    def counted(x: pa.RecordBatch) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        w = shared.value
        _, key, before, pair, _ = symbols(x.column(0))
        at = position(w.keys, key)
        first = np.concatenate([position(w.keys, np.array([END_KEY])), at[:-1]]) if len(at) else at
        context = value_at(w.n, first) >= LEAST[1]
        entry = value_at(w.n, at) >= ENTRY
        far = np.flatnonzero(first < 0)
        context[far] = maybe(w.contexts, before[far])
        far = np.flatnonzero(at < 0)
        entry[far] = maybe(w.entries, key[far])
        keep = context & entry
        packed = (first >= 0) & (at >= 0)
        near, far = np.flatnonzero(keep & packed), np.flatnonzero(keep & ~packed)
        return first[near] << PLACE | at[near], (pair[far], before[far], key[far])

    return summed(train, counted)


def law_rows(s: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, low: np.ndarray, level: int) -> pa.RecordBatch:
    """What ``learn`` writes for whole contexts; s is in runs. Only what is read again has a value."""
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(first, len(s)))
    each = lambda x: np.repeat(x, size)
    total = np.add.reduceat(n, first)
    # all that is no entry is taken for different words
    k = np.maximum(1, size + m[first] - total)
    law = np.power(10.0, low)
    p = np.log10((n + each(k) * law) / (m + each(k)))
    left, lower = (1 - np.add.reduceat(x, first) for x in (np.power(10.0, p), law))
    bow = np.log10(np.maximum(left, 1e-9) / np.maximum(lower, 1e-9))
    stays = np.log(10) * (np.add.reduceat(n * (p - low), first) + (m[first] - total) * bow) > GAIN
    kept, bows = each(stays), each(bow)
    of_context = np.ones(len(s), bool)  # where the context's own numbers are not
    of_context[first[stays]] = False
    columns = [
        pa.array(key_of(level, s, b)),
        pa.array(s, mask=of_context),
        pa.array(b, mask=n < LEAST[2]) if level == 1 else pa.nulls(len(s), pa.int64()),
        pa.array(n),
        pa.array(np.where(kept, p, low)) if level == 1 else pa.nulls(len(s), pa.float64()),
        pa.array(np.where(kept, p - low - bows, 0.0)),
        pa.array(bows, mask=of_context),
    ]
    out = pa.RecordBatch.from_arrays(columns, ["key", "s", "b", "n", "law", "delta", "bow"])
    return out if level == 1 else out.filter(pa.array(kept))


LAWS = "key long, s long, b long, n long, law double, delta double, bow double"


def learn(counts: DataFrame, shared, level: int) -> tuple[DataFrame, DataFrame]:
    """((s, bow) of the contexts that stay, (key, s, b, n, law, delta, bow) of all entries, on level 2 of contexts that stay): log10.

    s and bow are in one row of each context that stays; b is there for pairs that may be contexts, law for pairs.

    counts: g, y, n, low (the parent's law of b), m. A context that all tasks hold is a place: g is that place, shifted, and the last word's, or y is b
    where that word is not held (y is -1 else); m is null then. Any other context is a hash: g is -1, y is b, and s is a column.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = shared.value, []
        for batch in chain(batches, [None]):
            if batch is not None:
                at.append([batch.column(i).to_numpy() for i in range(4)])
            if not at or (batch is not None and sum(len(x[0]) for x in at) < 200_000):
                continue
            g, y, n, low = (np.concatenate(x) for x in zip(*at, strict=True))
            place = g >> PLACE
            cut = len(g) if batch is None else int(np.searchsorted(place, place[-1]))  # the last context may go on
            at = [[x[cut:] for x in (g, y, n, low)]] if cut < len(g) else []
            if cut:
                place, word = place[:cut], g[:cut] & ((1 << PLACE) - 1)
                s, m, b = held.entry(place, word)
                b = np.where(y[:cut] == -1, b, y[:cut])
                law = np.where(y[:cut] == -1, held.law(word), low[:cut]) if level == 1 else low[:cut]
                yield law_rows(s, b, n[:cut], m, law, level)
        trim()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = []
        for batch in chain(batches, [None]):
            if batch is not None:
                at.append([batch.column(i).to_numpy() for i in range(5)])
            if not at or (batch is not None and sum(len(x[0]) for x in at) < 200_000):
                continue
            s, b, n, m, low = (np.concatenate(x) for x in zip(*at, strict=True))
            cut = len(s) if batch is None else int(np.searchsorted(s, s[-1]))
            at = [[x[cut:] for x in (s, b, n, m, low)]] if cut < len(s) else []
            if cut:
                yield law_rows(s[:cut], b[:cut], n[:cut], m[:cut], low[:cut], level)

    held = counts.where("g >= 0").select("g", "y", "n", "low")
    held = held.repartition(F.shiftright("g", PLACE)).sortWithinPartitions("g", "y").mapInArrow(packed, LAWS)
    rest = counts.where("g < 0").select("s", F.col("y").alias("b"), "n", "m", "low")
    rest = rest.repartition("s").sortWithinPartitions("s").mapInArrow(hashed, LAWS)
    laws = materialise(held.unionByName(rest), "laws")
    contexts = materialise(laws.where("bow IS NOT NULL").select("s", "bow"), "contexts")
    release(counts.sparkSession)
    return contexts, laws


def places(keys: np.ndarray, s: pa.Array) -> pa.Array:
    """The place of each context that all tasks hold, shifted, with that of no word; -1 of others."""
    at = position(keys, s.to_numpy())
    return pa.array(np.where(at >= 0, (at << PLACE) | ((1 << PLACE) - 1), -1))


def pair_counts(pairs: DataFrame, table_: DataFrame, shared, z: int) -> DataFrame:
    """What ``learn`` takes, of counted pairs."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s, b, n, m, low = x.columns
            yield pa.RecordBatch.from_arrays([places(shared.value.keys, s), b, n, low, m, s], ["g", "y", "n", "low", "m", "s"])

    contexts = table_.where(F.col("n") >= LEAST[1]).select(F.col("key").alias("s"), F.col("n").alias("m"))
    root = table_.select(F.col("key").alias("b"), (F.log10(F.col("n") + 1.0) - float(np.log10(z))).alias("low"))
    others = pairs.where("b <> -1").join(contexts, "s").join(root, "b").select("s", "b", "n", "m", "low")
    none = F.lit(None).cast("long")
    inside = pairs.where("b = -1").select(F.col("s").alias("g"), F.col("b").alias("y"), "n", F.lit(0.0).alias("low"), none.alias("m"), none.alias("s"))
    return inside.unionByName(others.mapInArrow(place, "g long, y long, n long, low double, m long, s long"))


@dataclass
class States:
    """The pairs that may be contexts: the most frequent ones (sorted keys, their last words and counts), a filter of the others; a filter of all pairs; the shared words."""

    keys: np.ndarray
    last: np.ndarray
    n: np.ndarray
    others: np.ndarray | None
    pairs: np.ndarray | None
    words: np.ndarray

    def entry(self, place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """s, its count and b (meaningless where the word is not held) of places of contexts and words."""
        b = np.append(self.words, 0)[np.minimum(word, len(self.words))]
        return self.keys[place], self.n[place], key_of(1, self.last[place], b)


def count_level(train: DataFrame, states, level: int) -> DataFrame:
    """(s, b, n): the triples (s a pair, b the pair of its last two words) seen ENTRY times or more. Of a shared state and a shared word s is their packed number and b is -1."""

    def counted(x: pa.RecordBatch) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        t = states.value
        _, key, _, pair, third = symbols(x.column(0))
        end = np.flatnonzero(third)
        s, b = pair[end - 1], pair[end]
        at = position(t.keys, s)
        keep = np.flatnonzero(((at >= 0) | maybe(t.others, s)) & maybe(t.pairs, b))
        s, b, at = s[keep], b[keep], at[keep]
        word = position(t.words, key[end[keep]])
        packed = (at >= 0) & (word >= 0)
        near, far = np.flatnonzero(packed), np.flatnonzero(~packed)
        return at[near] << PLACE | word[near], (key_of(level, s[far], b[far]), s[far], b[far])

    return summed(train, counted)


#: Counted triples of a bucket, by their last two words: g as sorted steps, counts; of those that are not packed also b, m and s. Laws of a bucket.
TRIPLES = "bucket int, size int, first long, g binary, n binary, b binary, m binary, s binary"
LOWER = "bucket int, size int, first long, keys binary, law binary"


def triple_counts(triples: DataFrame, table_: DataFrame, laws: DataFrame, shared) -> DataFrame:
    """What ``learn`` takes, of counted triples. A triple's last two words follow one another as often as it occurs, so they are among the pairs: the parent's law is theirs.

    Triples and laws meet in blocks by bucket; the last two words of a packed triple are not sent, as its number has them.
    """
    parts = 4 * int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1  # as in summed

    def last_pair(code: np.ndarray) -> np.ndarray:
        return shared.value.entry(code >> PLACE, code & ((1 << PLACE) - 1))[2]

    def blocks(g: np.ndarray, b: np.ndarray, n: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(g.view(np.uint64))
        by, cut, columns = dealt(g[order].view(np.uint64), b[order].view(np.uint64) % np.uint64(parts), parts)
        order = order[by]
        columns += [planes(x[order].view(np.uint64), cut) for x in (n, *more)]
        columns += [pa.array([b""] * (len(cut) - 1), pa.binary())] * (3 - len(more))
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in TRIPLES.split(", ")])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, n in gathered(batches, 500_000):
            if len(g):
                yield blocks(g, last_pair(g), n)
        trim()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, b, n, m in gathered(batches, 500_000):
            if len(s):
                yield blocks(places(shared.value.keys, pa.array(s)).to_numpy(), b, n, b, m, s)
        trim()

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, law in gathered(batches, 500_000):
            if len(key):
                order, cut, columns = dealt_keys(key, parts)
                law = law[order]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([law[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], [x.split()[0] for x in LOWER.split(", ")])
        trim()

    def met(counted: pa.Table, given: pa.Table) -> pa.Table:
        blocks = given.to_pylist()
        keys = np.concatenate([np.zeros(0, np.int64), *(keys_of(x["bucket"], x["size"], x["first"], x["keys"], parts) for x in blocks)])
        law = np.frombuffer(b"".join(x["law"] for x in blocks), "<f8")
        order = np.argsort(keys)
        keys, law, out = keys[order], law[order], []
        for x in counted.to_pylist():
            g = (np.cumsum(numbers(x["g"], x["size"])) + np.uint64(x["first"] % (1 << 64))).view(np.int64)
            n, b, m, s = (numbers(x[c], x["size"]).view(np.int64) if x[c] else None for c in ("n", "b", "m", "s"))
            at = position(keys, last_pair(g) if b is None else b)
            y, m, s = (np.full(len(g), -1), np.zeros_like(g), np.zeros_like(g)) if b is None else (b, m, s)
            out.append([c[at >= 0] for c in (g, y, n)] + [law[at[at >= 0]], m[at >= 0], s[at >= 0]])
        _INDEX.pop(id(keys), None)
        trim()
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.float64 if i == 3 else np.int64) for i in range(6)]
        return pa.table(dict(zip(("g", "y", "n", "low", "m", "s"), columns, strict=True)))

    contexts = table_.select(F.col("key").alias("s"), F.col("n").alias("m"))
    others = triples.where("b <> -1").join(contexts, "s").select("s", "b", "n", "m").mapInArrow(hashed, TRIPLES)
    counted = triples.where("b = -1").select("s", "n").mapInArrow(packed, TRIPLES).unionByName(others)
    given = laws.select("key", "law").mapInArrow(lower, LOWER)
    return counted.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(met, "g long, y long, n long, low double, m long, s long")


def top(entries: DataFrame, by: str, most: int) -> int:
    """The least count that at most ``most`` entries have or exceed."""
    limit, held = 1 << 62, 0
    for n, k in sorted(((r[0], r[1]) for r in entries.groupBy(by).count().collect()), reverse=True):
        if held + k > most:
            break
        limit, held = n, held + k
    return limit


def by_key(df: DataFrame, *columns: str) -> list[np.ndarray]:
    got = df.toArrow()
    order = np.argsort(got["key"].to_numpy())
    return [got[c].to_numpy()[order] for c in ("key", *columns)]


def bloom(entries: DataFrame) -> np.ndarray | None:
    """The filter's bits, None if there are no entries: tasks send the places of theirs, sorted and compressed, by chunks of the filter; the chunks' bits come back, BLOOM of them in all."""
    chunk = BLOOM // 64

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flushed() -> pa.RecordBatch:
            at = np.unique(np.concatenate(held))
            held.clear()
            parts = np.split(at, np.searchsorted(at, np.arange(1, 64) * chunk))
            found = [(i, zlib.compress(np.diff(x, prepend=i * chunk).astype("<u4").tobytes(), 1)) for i, x in enumerate(parts) if len(x)]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], ["chunk", "data"])

        for b in batches:
            held += bits_of(b.column(0).to_numpy())
            if sum(map(len, held)) > 4_000_000:
                yield flushed()
        if held:
            yield flushed()

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        bits = np.zeros(chunk, bool)
        for data in part["data"]:
            bits[np.cumsum(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))] = True
        return pd.DataFrame({"chunk": part["chunk"][:1], "data": [np.packbits(bits, bitorder="little").tobytes()]})

    got, out = 0, np.zeros(BLOOM >> 6, np.int64)
    for r in entries.select("key").mapInArrow(places, "chunk int, data binary").groupBy("chunk").applyInPandas(merged, "chunk int, data binary").collect():
        out[r.chunk * chunk >> 6 : (r.chunk + 1) * chunk >> 6] = np.frombuffer(r.data, "<i8")
        got += 1
    return out if got else None


def grow(train: DataFrame, table_: DataFrame, words: Words, z: int) -> tuple[DataFrame, DataFrame]:
    """((key, n, base, gain) of all words, (key, n, gain) of all pairs and triples that add something). z: the base's denominator."""
    spark = train.sparkSession
    held = spark.sparkContext.broadcast(words)
    pairs = materialise(count_pairs(train, held), "pairs")
    release(spark)
    one, laws = learn(pair_counts(pairs, table_, held, z), held, 1)
    held.destroy()
    release(spark, pairs)
    states = laws.where(F.col("n") >= LEAST[2]).join(one.select(F.col("s").alias("b")), "b", "left_semi")
    states = materialise(states.select("key", "b", "n"), "states")
    least = top(states, "n", SHARED_STATES)
    held = States(*by_key(states.where(F.col("n") >= least), "b", "n"), bloom(states.where(F.col("n") < least)), bloom(laws), words.keys)
    held = spark.sparkContext.broadcast(held)
    triples = materialise(count_level(train, held, 2), "triples")
    release(spark)
    two, longer = learn(triple_counts(triples, states, laws, held), held, 2)
    held.destroy()
    release(spark, triples)
    triples = longer
    # only what occurs often enough can be a context
    often = table_.where(F.col("n") >= LEAST[1]).join(one.select(F.col("s").alias("key"), F.col("bow").alias("gain")), "key", "left").select("key", "n", F.coalesce("gain", F.lit(0.0)).alias("gain"))
    every = often.unionByName(table_.where(F.col("n") < LEAST[1]).select("key", "n", F.lit(0.0).alias("gain")))
    values0 = materialise(every.select("key", "n", F.log10(F.col("n") + 1.0).alias("base"), "gain"), "words")
    often = laws.where(F.col("n") >= LEAST[2]).join(two.select(F.col("s").alias("key"), F.col("bow").alias("own")), "key", "left").select("key", "n", (F.col("delta") + F.coalesce("own", F.lit(0.0))).alias("gain"))
    every = often.union(laws.where(F.col("n") < LEAST[2]).select("key", "n", F.col("delta").alias("gain"))).union(triples.select("key", "n", F.col("delta").alias("gain")))
    values = materialise(every.where("gain != 0"), "values")
    release(spark, one, laws, states, two, triples)
    return values0, values


# --- scores --------------------------------------------------------------------

ROWS = [
    ("held_out", "boolean"), ("row", "long"), ("n_tokens", "long"), ("known", "long"), ("base", "double"), ("gain", "double"),
    ("bucket", "int"), ("size", "int"), ("first", "long"), ("keys", "binary"), ("rows", "binary"),
]
NAMES = ["id", *[n for n, _ in ROWS]]


#: Values of a bucket: sorted keys as steps from the first, what they add beyond the base, and of words what they add to it.
VALUES = "bucket int, size int, first long, keys binary, gain binary, base binary"


def answered(asks: pd.DataFrame, given: pd.DataFrame, parts: int) -> pd.DataFrame:
    """What a bucket's values add to the rows that ask for them, summed by row: a block for each block of asked keys. given: blocks of values, those of words with their base."""
    import pandas as pd

    blocks = list(given.itertuples(index=False))
    keys = np.concatenate([np.zeros(0, np.int64), *(keys_of(x.bucket, x.size, x.first, x.keys, parts) for x in blocks)])
    gain = np.frombuffer(b"".join(x.gain for x in blocks), "<f8")
    known = np.concatenate([np.zeros(0, bool), *(np.full(x.size, len(x.base) > 0) for x in blocks)])
    base = np.concatenate([np.zeros(0), *(np.frombuffer(x.base, "<f8") if x.base else np.zeros(x.size) for x in blocks)])
    order = np.argsort(keys)
    keys, gain, base, known = keys[order], gain[order], base[order], known[order]
    out = []
    for x in asks.itertuples(index=False):
        at = position(keys, keys_of(x.bucket, x.size, x.first, x.keys, parts))
        row = numbers(x.rows, x.size).view(np.int64)[at >= 0]
        at = at[at >= 0]
        if not len(row):
            continue
        some, of = np.unique(row, return_inverse=True)
        n = np.bincount(of, known[at])
        words = n.any()
        out.append((x.row, some.astype("<u4").tobytes(), np.bincount(of, gain[at]).tobytes(), n.astype("<u4").tobytes() if words else b"", np.bincount(of, base[at]).tobytes() if words else b""))
    _INDEX.pop(id(keys), None)
    trim()
    return pd.DataFrame(out, columns=["first", "rows", "gain", "known", "base"])


def summed_up(blocks: pd.DataFrame) -> pd.DataFrame:
    """The answers to the rows that asked in one go, summed by row."""
    import pandas as pd

    parts = list(blocks.itertuples(index=False))
    rows = np.concatenate([np.frombuffer(x.rows, "<u4") for x in parts])
    some, of = np.unique(rows, return_inverse=True)
    column = lambda name, kind: np.concatenate([np.frombuffer(d, kind) if len(d := getattr(x, name)) else np.zeros(len(x.rows) // 4) for x in parts])
    known, base, gain = (np.bincount(of, column(n, k)) for n, k in (("known", "<u4"), ("base", "<f8"), ("gain", "<f8")))
    return pd.DataFrame({"row": parts[0].first + some.astype(np.int64), "more": known.astype(np.int64), "add": base, "delta": gain})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    train = docs.where(trains(id_col)).select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    counts = materialise(count_words(train), "words")
    release(spark)
    f = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, z = f["n"], f["n"] + f["v"] + 1
    least = top(counts, "n", SHARED_WORDS)
    far = counts.where(F.col("n") < least)
    words = Words(*by_key(counts.where(F.col("n") >= least), "n"), bloom(far.where(F.col("n") >= LEAST[1])), bloom(far.where(F.col("n") >= ENTRY)), z)
    values0, values = grow(train, counts, words, z)
    release(spark, counts)
    often = top(values, "n", SHARED_PAIRS)
    rest = values0.where(F.col("n") < least).select("key", F.lit(1).alias("known"), "base", "gain")
    rest = rest.unionByName(values.where(F.col("n") < often).select("key", F.lit(0).alias("known"), F.lit(0.0).alias("base"), "gain"))
    tree = Tree(*by_key(values0.where(F.col("n") >= least), "base", "gain"), *by_key(values.where(F.col("n") >= often), "gain"), bloom(rest))
    shared = spark.sparkContext.broadcast(tree)
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), (~trains(id_col)).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = picked.schema["id"]
    buckets = 1 + (rest.count() + total) // BUCKET

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The values, a block for each bucket, of words and of pairs and triples apart."""
        for key, known, base, gain in gathered(batches, 500_000):
            for words in (0, 1):
                at = np.flatnonzero(known == words)
                if len(at):
                    order, cut, columns = dealt_keys(key[at], buckets)
                    part = lambda x, at=at[order], cut=cut: pa.array([x[at[i:j]].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*columns, part(gain), part(base) if words else pa.array([b""] * (len(cut) - 1), pa.binary())], [x.split()[0] for x in VALUES.split(", ")])
        trim()

    given = materialise(rest.select("key", "known", "base", "gain").mapInArrow(in_blocks, VALUES), "given")
    release(spark, values0, values)

    def per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        task, done = np.int64(TaskContext.get().partitionId()) << 40, 0
        asked: list[tuple[np.ndarray, np.ndarray]] = []

        def blocks(ids: pa.DataType) -> pa.RecordBatch:
            """The keys asked for so far and the rows they are for, a block a bucket."""
            key, row = (np.concatenate(x) for x in zip(*asked, strict=True))
            asked.clear()
            order, cut, columns = dealt_keys(key, buckets)
            n = len(cut) - 1
            first = row.min()
            rows = planes((row[order] - first).view(np.uint64), cut)
            none = [pa.nulls(n, x) for x in (ids, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([*none[:2], pa.array(np.full(n, first)), *none[2:], *columns, rows], NAMES)

        for batch in batches:
            for b in slices(batch, 2, 1 << 20):
                n = b.num_rows
                of, key, _, pair, third = symbols(b.column(2))
                at = position(t.words, key)
                long, of2 = np.concatenate([pair, key_of(2, np.concatenate([[0], pair[:-1]])[third], pair[third])]), np.concatenate([of, of[third]])
                at2 = position(t.keys, long)
                ask, owner = np.concatenate([key[at < 0], long[at2 < 0]]), np.concatenate([of[at < 0], of2[at2 < 0]])
                wanted = maybe(t.others, ask)
                asked.append((ask[wanted], task + done + owner[wanted]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(task + done + np.arange(n)), pa.array(np.bincount(of, minlength=n).astype(np.int64)), pa.array(np.bincount(of, at >= 0, n).astype(np.int64)),
                     pa.array(np.bincount(of, value_at(t.base, at), n)), pa.array(np.bincount(of, value_at(t.bow, at), n) + np.bincount(of2, value_at(t.gain, at2), n)), *(pa.nulls(n, x) for x in (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    NAMES,
                )
                done += n
                if sum(len(k) for k, _ in asked) > 500_000:
                    yield blocks(b.column(0).type)
        if sum(len(k) for k, _ in asked):
            yield blocks(b.column(0).type)
        trim()

    schema = T.StructType([kind, *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in ROWS)).fields])
    rows = materialise(picked.mapInArrow(per_row, schema), "rows")
    shared.destroy()
    release(spark)
    asks = rows.where("bucket IS NOT NULL").select("bucket", "row", "size", "first", "keys", "rows")
    sums, passes = [], max(1, min(PASSES, buckets // LEAST_BUCKETS))
    for i in range(passes):
        part = F.col("bucket") % passes == i
        found = asks.where(part).groupBy("bucket").cogroup(given.where(part).groupBy("bucket"))
        found = found.applyInPandas(lambda a, g: answered(a, g, buckets), "first long, rows binary, gain binary, known binary, base binary")
        sums.append(materialise(found.groupBy("first").applyInPandas(summed_up, "row long, more long, add double, delta double"), "sums"))
        release(spark)
    release(spark, given)
    sums = reduce(DataFrame.unionByName, sums).groupBy("row").agg(*(F.sum(x).alias(x) for x in ("more", "add", "delta")))
    out = rows.where("bucket IS NULL").join(sums, "row", "left")
    base = F.col("base") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(z))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain") + F.coalesce("delta", F.lit(0.0))).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
