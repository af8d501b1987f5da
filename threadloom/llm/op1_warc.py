"""WARC: archives written and read back by boundary-chain verification.

Writing: a record per row; of equal payloads the row with the largest id is the response and the others are
revisits without a block, which name it. Payloads shuffle once, by digest, in a join that Spark may split where a digest is
hot. Archives go through Spark's own writer to the shared folder: a record is a line, whose end is the
last of the record's closing bytes.

Reading: Spark's text reader cuts archives at the magic ``WARC/1.0 CR LF`` (in parallel, by splits), true border or
not. Each task parses its candidates and emits (offset, successor's offset). Per archive, pointer jumping from
the file's start (next := next o next, about log2 n rounds) keeps the reachable candidates; magic inside a
payload is never reached and its bytes go back to the record around it. Only candidates that don't
end where the next one starts, and what follows them up to their end, carry their bytes to that step. A group there is one archive file: the writer bounds its
records (``per_file``).

Null payloads are empty. Rows with a null id are written without one and read back with null. Of rows
that repeat an id, all are responses or all are revisits, as the id is the largest of its payload or not.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, trim

MAGIC = b"WARC/1.0\r\n"
EMPTY = hashlib.sha1(b"").digest()
CLEAN = re.compile(r"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One record without its last byte (LF), which the line writer adds."""
    kind = "response" if refers is None else "revisit"
    block = payload if refers is None else b""
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {CLEAN.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def base32(sha: Column) -> Column:
    """The bare upper-case base32 of a SHA-1 in hexadecimal digits: ten of them are eight of base 32."""
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least: int = 0) -> DataFrame:
    """The ``record`` of every row (value), made by built-ins: no payload goes to a Python worker, whatever its size."""
    url = F.col(f"`{url_col}`") if url_col else F.lit(None).cast("string")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page"),
        url.alias("url"),
        F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.select("*", F.sha1("payload").alias("sha"))
    keeper = (
        pages.select(F.sha1(F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8")).alias("sha"), F.col(f"`{id_col}`").cast("long").alias("page"))
        .groupBy("sha")
        .agg(F.max("page").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha", "keeper")
    )
    size = F.octet_length("payload")
    joined = rows.join(keeper, "sha", "left")
    joined = joined.select("page", "url", "payload", "sha", F.when(~F.col("keeper").eqNullSafe(F.col("page")) & (size >= least), F.col("keeper")).alias("refers"))
    first = F.col("refers").isNull()
    uri = F.coalesce("url", F.lit(""))
    clean = uri
    for c in (*range(0x21), 0x7F):
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    whole = lambda c: c.cast("string")
    lines = [
        ("WARC-Type: ", F.when(first, "response").otherwise("revisit")),
        ("\r\nWARC-Record-ID: <urn:page:", F.coalesce(whole(F.col("page")), F.lit(""))),
        (">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: ", F.when(uri.rlike(CLEAN.pattern), clean).otherwise(uri)),
        ("\r\nWARC-Payload-Digest: sha1:", base32(F.col("sha"))),
        ("\r\nX-Payload-Length: ", whole(size)),
        ("", F.when(first, "").otherwise(F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), whole(F.col("refers")), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))),
        ("\r\nContent-Type: application/octet-stream\r\nContent-Length: ", F.when(first, whole(size)).otherwise("0")),
    ]
    head = F.concat(F.lit(MAGIC.decode()), *(x for text, value in lines for x in (F.lit(text), value)), F.lit("\r\n\r\n"))
    block = F.when(first, F.col("payload")).otherwise(F.lit(b""))
    return joined.select(F.concat(head.cast("binary"), block, F.lit(b"\r\n\r")).alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least: int = 0, per_file: int = 200_000) -> None:
    """Archives of all rows at path. least: smaller payloads are always responses."""
    made = records(pages, id_col, payload_col, url_col, least).select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


HEADER = re.compile(rb"^([^\r\n:]+):[ \t]*([^\r\n]*)\r$", re.M)
NAMES = {b"warc-type": "kind", b"warc-record-id": "page", b"warc-refers-to": "refers", b"warc-payload-digest": "digest", b"x-payload-length": "bytes"}


def parse(body: bytes) -> tuple[int, int, dict[str, bytes]] | None:
    """(header's bytes, block's bytes, fields) of what follows the magic, None if it is no record."""
    end = body.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k.lower(): v for k, v in HEADER.findall(body[: end + 1])}
    size = fields.get(b"content-length", b"")
    if not size.isdigit():
        return None
    return end + 4, int(size), {v: fields[k] for k, v in NAMES.items() if k in fields}


def reachable(offsets: np.ndarray, nexts: np.ndarray, start: int = 0) -> np.ndarray:
    """Which candidates the chain from start meets: pointer jumping over sorted offsets."""
    n = len(offsets)
    jump = np.searchsorted(offsets, nexts)
    jump = np.where((jump < n) & (offsets[np.minimum(jump, n - 1)] == nexts) & (nexts > offsets), jump, n)
    jump = np.append(jump, n)
    mark = np.zeros(n + 1, bool)
    mark[:n] = offsets == start
    while True:
        grown = mark.copy()
        grown[jump[np.flatnonzero(mark)]] = True
        if (grown == mark).all() and (jump == n).all():
            return mark[:n]
        mark, jump = grown, jump[jump]


ROW = "file string, block long, k int, size long, head int, length long, kind string, page string, refers string, digest string, payload_bytes long, sha string, body binary"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per segment between magics, in the file's order within (file, block)."""
    text = spark.read.option("lineSep", MAGIC.decode()).schema("value string").text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, k, at, cover = None, 0, 0, 0
        names = [x.split()[0] for x in ROW.split(", ")]
        for b in batches:
            out = {n: [] for n in names}
            for file, block, body in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                k, at, cover = (k + 1, at, cover) if (file, block) == place else (0, 0, 0)
                place = (file, block)
                got = parse(body)
                head, length, fields = got or (-1, -1, {})
                whole = got is not None and head + length + 4 == len(body)
                payload = body[head : head + length] if whole else b""
                row = {"file": file, "block": block, "k": k, "size": len(body), "head": head, "length": length}
                row |= {n: fields[n].decode("utf-8", "replace") if n in fields else None for n in ("kind", "page", "refers", "digest")}
                row["payload_bytes"] = int(fields["bytes"]) if fields.get("bytes", b"").isdigit() else None
                row["sha"] = digest_of(payload) if whole else None
                # bytes go along where a record that began before may reach; in a later block of a file that is not known
                if got is not None and not whole:
                    cover = max(cover, at + head + length + 4)
                row["body"] = body if body and (not whole or at < cover or block) else None
                at += len(body) + len(MAGIC)
                for n in names:
                    out[n].append(row[n])
            types = {"block": pa.int64(), "k": pa.int32(), "size": pa.int64(), "head": pa.int32(), "length": pa.int64(), "payload_bytes": pa.int64(), "body": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[n], types.get(n, pa.string())) for n in names], names)
        trim()

    return text.mapInArrow(run, ROW)


def _chain(part: pd.DataFrame) -> pd.DataFrame:
    """The true records of one archive."""
    part = part.sort_values(["block", "k"], kind="stable").reset_index(drop=True)
    size = part["size"].to_numpy(np.int64)
    start = np.cumsum(size + len(MAGIC)) - size - len(MAGIC) * 2  # of the magic before each segment
    offset = start
    head, length = part["head"].to_numpy(np.int64), part["length"].to_numpy(np.int64)
    good = np.flatnonzero((offset >= 0) & (head >= 0))
    nexts = offset + len(MAGIC) + head + length + 4
    keep = good[reachable(offset[good], nexts[good])] if len(good) else good
    kind, page, refers, digest, count, sha, body = (part[c].tolist() for c in ("kind", "page", "refers", "digest", "payload_bytes", "sha", "body"))
    number = re.compile(r"^<urn:page:(-?\d+)>$")
    rows = []
    for j, i in enumerate(keep.tolist()):
        mine = sha[i]
        if not isinstance(mine, str):  # magic within the block: put the segments together again
            stop = keep[j + 1] if j + 1 < len(keep) else len(part)
            data = MAGIC.join(_bytes(body[x]) for x in range(i, stop))
            mine = digest_of(data[int(head[i]) : int(head[i] + length[i])])
        page_m, ref_m = number.match(page[i] or ""), number.match(refers[i] or "")
        revisit = kind[i] == "revisit"
        said = (digest[i] or "").removeprefix("sha1:")
        rows.append((
            int(page_m[1]) if page_m else None,
            int(count[i]) if revisit else int(length[i]),
            said if revisit else mine,
            kind[i],
            int(ref_m[1]) if revisit and ref_m else None,
            revisit or said == mine,
        ))
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"])
    return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64", "digest_ok": "boolean"})


def _bytes(x) -> bytes:
    return x if isinstance(x, (bytes, bytearray)) else b""


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives at path."""
    return candidates(spark, path).groupBy("file").applyInPandas(_chain, RESULT)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path)


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      (('0x' || substr(h || '0000', 1 + (5 * k) // 4, 3))::BIGINT >> (7 - (5 * k) % 4)) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to,
  true AS digest_ok
FROM d
"""
