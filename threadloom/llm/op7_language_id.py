"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams (1 to 3, of letters
and the spaces between them) is fitted by logistic regression. Decoding weighs losses: the language
whose codeword has the least sum of log(1 + exp(-bit * margin)) wins, and its share of exp(-loss) is the score; where
the two best are close the row is flagged ambiguous. Up to 7 languages get the exhaustive code
(2^(k-1) - 1 bits), more get random codewords that differ in many bits.

Fitting uses a bounded sample of labelled rows: about ``per_language`` of each language and about ``most`` in all (32 KB each on the driver), whole texts, chosen by a hash
of the id. Everything else runs over all rows. Null texts and texts without a letter are ``und``, score 0. Rows
whose lang is null are never learned from. Ties between languages go to the first by name. Without any labelled row, as in an empty table, all is ``und``.
Rows that repeat an id, and rows without one (never held out), give a row each. Long texts are read whole. Columns other than id, text and lang are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, slices, table, text_bytes

BITS = 13
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are neither ASCII letters nor part of another letter count as one space.
_SHAPE = LOWER_BYTES.copy()
_SHAPE[:128][[not (97 <= b <= 122) for b in LOWER_BYTES[:128]]] = 32


def codewords(k: int) -> np.ndarray:
    """k rows of -1 and 1; columns are the bits."""
    if k <= 7:
        rows = np.array([(1, *c) for c in product((1, -1), repeat=k - 1)], np.int8)
        rows = rows[(rows == -1).any(1)]
        return rows.T if k > 1 else np.ones((1, 1), np.int8)
    rng, best, apart = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, 10 * int(np.ceil(np.log2(k)))))
        code = code[:, abs(code.sum(1 - 1)) < k]
        gap = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if gap > apart:
            best, apart = code, gap
    return best


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each place and each size of n-gram: [3, bytes]; those across two texts are bucket 0. And the texts' numbers of bytes."""
    s = _SHAPE[data].astype(np.uint32)
    n = len(s)
    out = np.zeros((3, n), np.uint32)
    first = np.zeros(n + 1, np.int64)
    first[off[1:-1]] = 1
    inner = np.cumsum(first)[:n] if n else np.zeros(0, np.int64)
    h = s.copy()
    out[0] = h * np.uint32(2654435761) >> np.uint32(32 - BITS)
    for k in (1, 2):
        g = np.zeros(n, np.uint32)
        if n > k:
            g[k:] = (s[k:] + s[k - 1 : n - 1] * np.uint32(257)) * np.uint32(2246822519)
            if k == 2:
                g[k:] = (g[k:] ^ (s[: n - 2] * np.uint32(3266489917))) * np.uint32(668265263)
            g[k:] = (g[k:] + np.uint32(k * 374761393)) * np.uint32(2654435761) >> np.uint32(32 - BITS)
            g[k:][inner[k:] != inner[:-k]] = 0
        out[k] = g
    return out, np.diff(off)


def margins(data: np.ndarray, off: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """[texts, bits]: the classifiers' margins, features being n-gram frequencies."""
    g, size = grams(data, off)
    rows, bits = len(size), weights.shape[1]
    total = np.zeros((rows, bits))
    if len(data):
        full = size > 0
        starts = off[:-1][full]
        for b in range(bits):
            w = weights[:, b]
            total[full, b] = np.add.reduceat(w[g[0]] + w[g[1]] + w[g[2]], starts, dtype=np.float64)
    return total / np.maximum(size, 1)[:, None] + bias


def fit(features: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of all bits at once (target -1, 1), scaled features, full-batch steps with momentum."""
    scale = np.sqrt((features**2).mean(0)) + 1e-5
    x = (features / scale).astype(np.float32) / np.sqrt(features.shape[1])
    w, b = np.zeros((x.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        z = x @ w + b
        g = -target / (1 + np.exp(target * z)) / len(x)
        vw, vb = 0.9 * vw - rate * (x.T @ g + 1e-5 * w), 0.9 * vb - rate * g.sum(0) * 0.05
        w, b = w + vw, b + vb
    return (w / scale[:, None] / np.sqrt(features.shape[1])).astype(np.float32), b


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, close: float) -> None:
        self.languages, self.code, self.weights, self.bias, self.close = languages, code, weights, bias, close

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language's number, score, ambiguous) of each text."""
        z = margins(data, off, self.weights, self.bias)
        loss = np.stack([np.logaddexp(0, -z * c).sum(1) for c in self.code], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        ranked = np.sort(share, 1)
        second = ranked[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return share.argmax(1), ranked[:, -1], ranked[:, -1] - second < self.close


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 300, most: int = 8000, close: float = 0.2) -> Model | None:
    """Fitted on the driver: the n-gram counts (2^13 numbers each) of per_language texts, or of fewer so that all languages' are about ``most``, whatever the corpus."""
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & ~held_out(id_col))
    known = known.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), (F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1 << 30)) / (1 << 30)).alias("place"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    per_language = max(1, min(per_language, most // len(languages)))
    rate = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, per_language / v))])
    sample = known.where(F.col("place") < rate[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                data, off = text_bytes(b.column(1))
                g, size = grams(data, off)
                rows = []
                for i in range(len(size)):
                    f = np.bincount(g[:, off[i] : off[i + 1]].ravel(), minlength=1 << BITS) / max(1, size[i])
                    rows.append(f.astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["lang", "f"])

    got = sample.mapInArrow(count, "lang string, f binary").orderBy(F.xxhash64("f"), "lang").limit(2 * per_language * len(languages)).collect()
    if not got:
        return None
    features = np.stack([np.frombuffer(r["f"], np.float32) for r in got])
    code = codewords(len(languages))
    target = code[[languages.index(r["lang"]) for r in got]].astype(np.float32)
    return Model(languages, code, *fit(features, target), close)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score, ambiguous of every row."""
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in slices(batch, 2):
                blank = np.array([t is None or not LETTER.search(t) for t in b.column(2).to_pylist()], bool)
                if m is None:
                    blank[:] = True
                    pick, score, unsure = np.zeros(b.num_rows, int), np.zeros(b.num_rows), blank.copy()
                    names = np.array(["und"], object)
                else:
                    pick, score, unsure = m.predict(*text_bytes(b.column(2)))
                    names = np.array(m.languages, object)
                lang = np.where(blank, "und", names[pick])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(lang.tolist(), pa.string()), pa.array(np.where(blank, 0.0, score)), pa.array(unsure | blank)],
                    ["id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    schema = T.StructType([picked.schema["id"], *T.StructType.fromDDL("held_out boolean, lang_pred string, score double, ambiguous boolean").fields])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs, "doc_id", "text", "lang"))
