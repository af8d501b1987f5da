"""Token counts by a byte-level BPE compiled to a deterministic transducer.

Three finite-state layers, each exact:

* a scanner cuts a text at special strings and then at *synchronising* places - a white-space character
  after another character - where every scanner state is reset, so that a chunk's state map is
  (open head, tokens emitted in between, open tail) and maps compose associatively;
* inside a segment the split pattern of the tokenizer cuts pre-tokens;
* ``TokenTransducer`` runs over a pre-token's bytes. Its state is an Aho-Corasick node over the vocabulary
  plus the last tokens of the open prefix's encodings; every transition carries the number of tokens that the
  prefix then has. The encoding of a prefix ends in the token t for which the encoding of what
  precedes t may stand before t, i.e. the merges leave the pair alone; that token is unique.
  Closed segments are memoised as macro transitions (bounded, then emptied).

A text is a cell and so in one task: its chunks' maps are reduced there by a prefix scan (a tree of
compositions), with no shuffle. Null and empty texts have 0 bytes and 0 tokens. Rows that repeat an id, or lack one, give a row each; an empty table gives none.
Long texts are counted whole, chunk by chunk. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White_Space of Unicode, which the split pattern's \s means.
WS = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEGMENT = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")
#: Fixed value: the split pattern of the public byte-level vocabularies.
PRE_TOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+"
)
CHUNK = 1 << 16
MEMO = 600_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenTransducer:
    """Deterministic; ``count`` gives what the transitions over a pre-token emit in all."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        to = byte_alphabet()
        enc = lambda s: bytes(map(to.__getitem__, s))
        self.ids = {enc(t): i for t, i in vocab.items() if all(c in to for c in t)}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of the merge that makes it, its two parts
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), r)
            self.made.setdefault(z, (r, x, y))
        self.fits: dict[int, bool] = {}
        self.reached: dict[int, bool] = {}
        self.nodes = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.nodes.add_word(t.decode("latin-1"), (i, len(t)))
        self.nodes.make_automaton()

    def stays_apart(self, x: int, y: int) -> bool:
        """Whether the merges leave the pair alone: walk back in time, undoing the later of the merges that made the
        two neighbours, and see whether they, or what they were then, would have merged across the border first."""
        rank, made, byte = self.rank, self.made, (-1, 0, 0)
        if (x, y) in rank:
            return False
        while True:
            (rx, _, xb), (ry, ya, _) = made.get(x, byte), made.get(y, byte)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x = xb
                if rank.get((x, y), rx) < rx:
                    return False
            else:  # of equal merges the left one is earlier
                y = ya
                if rank.get((x, y), ry + 1) <= ry:
                    return False

    def legal(self, t: int) -> bool:
        """Tokens that no merge sequence reaches never appear."""
        if t not in self.made:
            return True
        if (known := self.reached.get(t)) is None:
            rank, x, y = self.made[t]
            known = self.reached[t] = self.legal(x) and self.legal(y) and self.first_apart(x, y, rank)
        return known

    def first_apart(self, x: int, y: int, limit: int) -> bool:
        """As stays_apart, but the pair's own merge, of rank limit, is expected."""
        rank, made, byte = self.rank, self.made, (-1, 0, 0)
        while True:
            (rx, _, xb), (ry, ya, _) = made.get(x, byte), made.get(y, byte)
            if rx > limit or ry > limit:
                return False
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x = xb
                if rank.get((x, y), rx) < rx:
                    return False
            else:
                y = ya
                if rank.get((x, y), ry + 1) <= ry:
                    return False

    def run(self, word: bytes) -> tuple[list[int], list[int]]:
        """Before each byte and at the end: the last token of the prefix's encoding, the prefix's number of tokens."""
        last, count = [-1], [0]
        fits, done = self.fits, 0
        known, put, add = fits.get, last.append, count.append
        if len(fits) > 2 * MEMO:
            fits.clear()
        for at, (t, size) in self.nodes.iter(word.decode("latin-1")):  # the tokens that end there, longest first
            if at < done:
                continue
            start = at + 1 - size
            key = last[start] << 20 | t if start else -2 - t
            if (apart := known(key)) is None:
                apart = fits[key] = self.legal(t) and (not start or self.stays_apart(last[start], t))
            if apart:
                done = at + 1
                put(t)
                add(count[start] + 1)
        if done < len(word):
            raise ValueError("a byte without a token")
        return last, count

    def count(self, word: bytes) -> int:
        return self.run(word)[1][-1]


class CompiledCounter:
    """Counts of whole texts: special strings, chunk maps, their scan."""

    def __init__(self, spec: dict) -> None:
        self.transducer = TokenTransducer(spec["model"]["vocab"], spec["model"]["merges"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words: dict[str, int] = {}
        self.memo: dict[str, int] = {}

    def segment(self, s: str) -> int:
        """A closed segment's tokens (macro transition)."""
        n = 0
        for w in PRE_TOKEN.findall(s):
            if (k := self.words.get(w)) is None:
                if len(self.words) > MEMO:
                    self.words.clear()
                k = self.transducer.count(w.encode())
                if len(w) <= 64:
                    self.words[w] = k
            n += k
        return n

    def closed(self, segments: list[str]) -> int:
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, segments))
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        n = 0
        for s in segments:
            if (k := memo.get(s)) is None:
                k = self.segment(s)
                if len(s) <= 64:
                    memo[s] = k
            n += k
        return n

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, tokens, tail); tail None: the chunk holds no synchronising place and is all head.

        The head ends before the first place where white space follows another character within the chunk.
        A chunk that starts with white space keeps it in the head, as the character before is unknown.
        """
        parts = SEGMENT.findall(chunk)
        if len(parts) < 2:
            return chunk, 0, None
        return parts[0], self.closed(parts[1:-1]), parts[-1]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[2] is None:
            joined = self.chunk_map(a[0] + b[0])
            if b[2] is None:
                return joined
            if joined[2] is None:
                return a[0] + b[0], b[1], b[2]
            return joined[0], joined[1] + self.closed([joined[2]]) + b[1], b[2]
        middle = SEGMENT.findall(a[2] + b[0])
        if b[2] is None:
            return a[0], a[1] + self.closed(middle[:-1]), middle[-1] if middle else ""
        return a[0], a[1] + self.closed(middle) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> tuple:
        """The last entry of the prefix scan: a tree of compositions, log2(n) levels."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def plain(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.closed(SEGMENT.findall(text))
        head, n, tail = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return n + self.closed([x for x in (head, tail) if x])

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if self.special is None or not (found := self.special.findall(text)):
            return self.plain(text, chunk)
        return len(found) + sum(self.plain(x, chunk) for x in self.special.split(text) if x)


@lru_cache(maxsize=2)
def compiled(path: str) -> CompiledCounter:
    """One per worker process."""
    with open(path, encoding="utf-8") as f:
        return CompiledCounter(json.load(f))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every text. vocabulary: a path on every machine, as the library's package has it."""
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(vocabulary)
        for b in batches:
            counts = list(map(counter.count, b.column(1).to_pylist(), repeat(CHUNK)))
            size = pa.compute.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
