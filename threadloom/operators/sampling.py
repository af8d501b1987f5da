"""Topics of token occurrences by the reference's sampler: collapsed Gibbs sampling whose counts are those of the round before (WarpLDA).

As counts stand still within a round, all tokens are drawn at once, wherever they lie. A draw's random number follows from seed, round, document and place alone,
so a fit does not depend on how rows are dealt. The state lies in the shared folder in blocks of whole documents; the driver and each worker hold the counts of
terms that two documents or more have, and a term of one document is counted in its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_folder, removed, stored

ALPHA_SUM, BETA = 5.0, 0.01
#: Most rounds of a fit; it stops before where CHECK rounds improve the log-likelihood by less than this share (the reference's values).
MOST_ROUNDS, CHECK, TOLERANCE = 1000, 10, 1e-4
#: Tokens of a block and of one step within it, terms of a bucket of counts.
BLOCK, STEP, BUCKET = 1 << 18, 1 << 16, 1 << 16
#: Up to so many tokens a job is one task, as a round then takes less time than its start elsewhere; the topics are the same.
ONE_TASK = 2_000_000
#: Stands for a missing document id while a fit runs.
NO_ID = -(2**63)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _draws(ids: np.ndarray, lens: np.ndarray, seed: int, at: int) -> np.ndarray:
    """A number in [0, 1) for each token, from seed, round, document and place."""
    start = mixed(mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(seed % 2**64)) + np.uint64((at + 1) * 0x9E3779B97F4A7C15 % 2**64))
    place = np.arange(lens.sum(), dtype=np.uint64) - np.repeat((np.cumsum(lens) - lens).astype(np.uint64), lens)
    return (mixed(np.repeat(start, lens) + place * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def started(ids: np.ndarray, lens: np.ndarray, topics: int, seed: int) -> np.ndarray:
    return np.minimum((_draws(ids, lens, seed, 0) * topics).astype(np.int64), topics - 1).astype(np.min_scalar_type(max(1, topics - 1)))


def drawn(ids: np.ndarray, lens: np.ndarray, w: np.ndarray, z: np.ndarray, counts: np.ndarray, nk: np.ndarray, v: int, topics: int, seed: int, at: int, score: bool) -> tuple[np.ndarray, int]:
    """Each token's next topic, and the documents' log-likelihood under the counts in millionths. w: a row of ``counts``, or -1 - number of a term that this block alone has."""
    alpha, d = ALPHA_SUM / topics, np.repeat(np.arange(len(lens)), lens)
    nd = np.bincount(d * topics + z, minlength=len(lens) * topics).reshape(-1, topics)
    theta = ((nd + alpha) / (lens[:, None] + topics * alpha)).astype(np.float32)
    under = (nk + v * BETA).astype(np.float64)
    mine = w < 0
    own = -1 - w[mine]
    few = np.bincount(own * topics + z[mine], minlength=(own.max(initial=-1) + 1) * topics).reshape(-1, topics)
    few = ((few + BETA) / under).astype(np.float32)
    u, out, each = _draws(ids, lens, seed, at), np.empty_like(z), np.zeros(len(w)) if score else None
    for i in range(0, len(w), STEP):
        s = slice(i, i + STEP)
        here, p = mine[s], np.empty((len(w[s]), topics), np.float32)
        p[~here] = (counts[w[s][~here]] + BETA) / under
        p[here] = few[-1 - w[s][here]]
        p *= theta[d[s]]
        np.cumsum(p, axis=1, out=p)
        out[s] = np.minimum((p <= (u[s] * p[:, -1])[:, None]).sum(1), topics - 1)
        if score:
            each[s] = np.log(p[:, -1].astype(np.float64))
    if not score or not len(w):
        return out, 0
    return out, int(np.rint(np.bincount(d, each, minlength=len(lens)) * 1e6).astype(np.int64).sum())


def done(trace: list[int]) -> bool:
    return len(trace) > 1 and abs(trace[-2] / trace[-1] - 1) < TOLERANCE if trace and trace[-1] else bool(trace)


def gibbs(docs: np.ndarray, terms: np.ndarray, topics: int, seed: int, rounds: int = MOST_ROUNDS) -> np.ndarray:
    """A topic for each token occurrence of arrays in memory; the same input and seed give the same topics."""
    names, d = np.unique(docs, return_inverse=True)
    order = np.lexsort((terms, d))
    kinds, w = np.unique(terms, return_inverse=True)
    ids = names if names.dtype.kind in "iu" else np.arange(len(names))
    lens, w = np.bincount(d, minlength=len(names)), w[order]
    z, trace = started(ids, lens, topics, seed), []
    for at in range(1, rounds + 1):
        counts = np.bincount(w * topics + z, minlength=len(kinds) * topics).reshape(-1, topics)
        new, score = drawn(ids, lens, w, z, counts, counts.sum(0), len(kinds), topics, seed, at, at % CHECK == 0)
        if at % CHECK == 0:
            trace.append(score)
        z = new
        if at % CHECK == 0 and done(trace):
            break
    out = np.empty(len(d), np.int64)
    out[order] = z
    return out


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary, jobs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    known = vocabulary.value
    for b in batches:
        per = b.column(1).value_lengths().to_numpy()
        hashes, n = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
        cell = np.concatenate([[0], np.cumsum(per)])
        token = np.concatenate([[0], np.cumsum(n)])[cell]
        ids, a = b.column(0).to_numpy(), 0
        while a < len(ids):
            e = max(a + 1, int(np.searchsorted(token, token[a] + BLOCK, side="right")) - 1)
            h, m, lens = hashes[cell[a] : cell[e]], n[cell[a] : cell[e]], np.diff(token[a : e + 1])
            at = np.searchsorted(known, h)
            found = at < len(known)
            found[found] = known[at[found]] == h[found]
            w = np.where(found, at, 0)
            w[~found] = -1 - np.unique(h[~found], return_inverse=True)[1]
            z = [started(ids[a:e], lens, *j) for j in jobs]
            yield _row([ids[a:e], lens.astype(np.int32), np.repeat(w, m).astype(np.int32), *z])
            a = e
        del hashes, n


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")


def _row(arrays: list[np.ndarray], names: list[str] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names or ["ids", "lens", "w", *[f"z{j}" for j in range(len(arrays) - 3)]])


def _opened(b: pa.RecordBatch, i: int, jobs: list[tuple[int, int]]) -> tuple:
    got = [np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in ((0, np.int64), (1, np.int32), (2, np.int32))]
    return *got, [np.frombuffer(b.column(3 + j)[i].as_buffer(), np.min_scalar_type(max(1, k - 1))) for j, (k, _) in enumerate(jobs)]


def _changes(j: int, delta: np.ndarray, nk: np.ndarray, score: int) -> Iterator[tuple]:
    """(job, bucket, places, changes) of what a task changed; bucket -1: changes of the topics' totals, and the score."""
    yield j, -1, np.zeros(0, np.int32).tobytes(), np.append(nk, score).astype(np.int64).tobytes()
    flat = delta.reshape(-1)
    width = BUCKET * delta.shape[1]
    for bucket in range(0, -(-len(flat) // width)):
        part = flat[bucket * width : (bucket + 1) * width]
        at = np.flatnonzero(part)
        if len(at):
            yield j, bucket, at.astype(np.int32).tobytes(), part[at].astype(np.int32).tobytes()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of equal job and bucket in one."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for i in range(b.num_rows):
            key = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
            change = np.frombuffer(b.column(3)[i].as_buffer(), np.int64 if key[1] < 0 else np.int32)
            if key[1] < 0:
                sums[key] = sums.get(key, 0) + change
                continue
            at = np.frombuffer(b.column(2)[i].as_buffer(), np.int32)
            have = sums.setdefault(key, np.zeros(0, np.int32))
            if len(at) and at[-1] >= len(have):
                sums[key] = have = np.concatenate([have, np.zeros(at[-1] + 1 - len(have), np.int32)])
            have[at] += change  # places of one task differ
    for (j, bucket), x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([bucket], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["job", "bucket", "change"])


def fits(docs: DataFrame, jobs: list[tuple[int, int]], rounds: int = MOST_ROUNDS) -> DataFrame:
    """topics, seed, doc_id, term, k, n of each job (topics, seed). docs: doc_id and cells, a row a document, its terms in order; it is read several times."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["n"])), F.lit(0)).alias("n")).first()["n"]
    if total <= ONE_TASK:
        return _fits_by_task(docs, jobs, rounds)
    terms = docs.select(F.inline("cells")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = stored(terms.select(F.xxhash64("term").alias("h"), "df"), "terms")
    v = terms.count()
    if terms.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count():
        raise ValueError("two terms share a hash of 64 bits")
    known = np.sort(terms.where("df > 1").select("h").toPandas()["h"].to_numpy(np.int64))
    vocabulary, open_jobs, places = spark.sparkContext.broadcast(known), list(range(len(jobs))), len(known)
    fields = ["ids", "lens", "w", *[f"z{j}" for j in range(len(jobs))]]
    schema = ", ".join(f"{c} binary" for c in fields)
    path = new_folder(spark, "topics")
    hashes = docs.select(_id(), F.transform("cells", lambda c: F.xxhash64(c["term"])).alias("hashes"), F.transform("cells", lambda c: c["n"].cast("long")).alias("ns"))
    hashes.mapInArrow(lambda b: _blocks(b, vocabulary, jobs), schema).write.parquet(path)
    counts, totals, traces = [np.zeros((places, k), np.int32) for k, _ in jobs], [np.zeros(k, np.int64) for k, _ in jobs], [[] for _ in jobs]
    many = max(1, min(spark.sparkContext.defaultParallelism, -(-places // BUCKET) * len(jobs)))
    for at in range(rounds + 1):  # round 0 counts what the blocks start with
        score = at > 0 and at % CHECK == 0
        shared = spark.sparkContext.broadcast((counts, totals))
        now, last = list(open_jobs), path
        path = new_folder(spark, "topics")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, now=now, at=at, score=score) -> Iterator[pa.RecordBatch]:
            have, sums = shared.value
            delta, nks, scores = {j: np.zeros((places, jobs[j][0]), np.int32) for j in now}, {j: np.zeros(jobs[j][0], np.int64) for j in now}, dict.fromkeys(now, 0)
            none = pa.nulls(1, pa.binary())
            for b in batches:
                for i in range(b.num_rows):
                    ids, lens, w, zs = _opened(b, i, jobs)
                    for j in now:
                        k, seed = jobs[j]
                        new, got = drawn(ids, lens, w, zs[j], have[j], sums[j], v, k, seed, at, score) if at else (zs[j], 0)
                        scores[j] += got
                        known_ = w >= 0
                        flat = delta[j].reshape(-1)
                        if at:
                            moved = known_ & (new != zs[j])
                            np.subtract.at(flat, w[moved] * k + zs[j][moved], 1)
                            nks[j] -= np.bincount(zs[j], minlength=k)
                        else:
                            moved = known_
                        np.add.at(flat, w[moved] * k + new[moved], 1)
                        nks[j] += np.bincount(new, minlength=k)
                        zs[j] = new
                    if at:
                        row = _row([ids, lens, w, *zs])
                        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), none, none, *row.columns], ["job", "bucket", "at", "change", *row.schema.names])
            for j in now:
                for job, bucket, where, change in _changes(j, delta[j], nks[j], scores[j]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([job], pa.int32()), pa.array([bucket], pa.int32()), pa.array([where], pa.binary()), pa.array([change], pa.binary()), *[none] * len(fields)], ["job", "bucket", "at", "change", *fields]
                    )

        state = spark.read.schema(schema).parquet(last) if at < 2 else spark.read.parquet(last).where("job IS NULL").select(*fields)
        state.mapInArrow(run, f"job int, bucket int, at binary, change binary, {schema}").write.parquet(path)
        changes = spark.read.parquet(path).where("job IS NOT NULL").select("job", "bucket", "at", "change").repartition(many, "job", "bucket").mapInArrow(_summed, "job int, bucket int, change binary")
        for r in changes.toLocalIterator():
            if r.bucket < 0:
                x = np.frombuffer(r.change, np.int64)
                totals[r.job] += x[:-1]
                if score:
                    traces[r.job].append(int(x[-1]))
            else:
                x = np.frombuffer(r.change, np.int32)
                counts[r.job].reshape(-1)[r.bucket * BUCKET * jobs[r.job][0] :][: len(x)] += x
        shared.destroy()
        if at == 0:  # the blocks as they were
            removed(spark, path)
            path = last
        else:
            removed(spark, last)
        if score:
            open_jobs = [j for j in open_jobs if not done(traces[j])]
            if not open_jobs:
                break
    return _told(docs, spark.read.parquet(path), jobs, fields)


def _fits_by_task(docs: DataFrame, jobs: list[tuple[int, int]], rounds: int) -> DataFrame:
    every = docs.select(_id(), F.inline("cells")).crossJoin(F.broadcast(docs.sparkSession.createDataFrame(jobs, "topics int, seed int")))  # a row a job

    def run(part: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(part["term"], sort=True)
        topics, seed, ids, n = int(part["topics"].iat[0]), int(part["seed"].iat[0]), part["doc_id"].to_numpy(np.int64), part["n"].to_numpy()
        z = gibbs(np.repeat(ids, n), np.repeat(code, n), topics, seed, rounds)
        many = np.bincount(np.repeat(np.arange(len(n)), n) * topics + z, minlength=len(n) * topics)
        key = np.flatnonzero(many)
        at = key // topics
        return pd.DataFrame({"topics": topics, "seed": seed, "doc_id": ids[at], "term": names[code[at]], "k": (key % topics).astype(np.int32), "n": many[key]})

    out = every.groupBy("topics", "seed").applyInPandas(run, "topics int, seed int, doc_id long, term string, k int, n long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def _told(docs: DataFrame, state: DataFrame, jobs: list[tuple[int, int]], fields: list[str]) -> DataFrame:
    """The cells of each document by topic, from the blocks."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, lens, _, zs = _opened(b, i, jobs)
                end = np.cumsum(lens)
                cut = [[z[e - n : e].tobytes() for e, n in zip(end, lens, strict=True)] for z in zs]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(c, pa.binary()) for c in cut]], ["id", *fields[3:]])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.concatenate([[0], np.cumsum(b.column(1).value_lengths().to_numpy())])
            terms, n = b.column(1).flatten(), b.column(2).flatten().to_numpy()
            token, ids, a = np.concatenate([[0], np.cumsum(n)])[cell], b.column(0).to_numpy(), 0
            while a < len(ids):
                e = max(a + 1, int(np.searchsorted(token, token[a] + BLOCK, side="right")) - 1)
                part, own, of = slice(cell[a], cell[e]), terms.slice(cell[a], cell[e] - cell[a]), np.repeat(ids[a:e], np.diff(cell[a : e + 1]))
                at = np.repeat(np.arange(len(of)), n[part])
                for j, (k, seed) in enumerate(jobs):
                    z = np.frombuffer(b"".join(b.column(3 + j).slice(a, e - a).to_pylist()), np.min_scalar_type(max(1, k - 1)))
                    many = np.bincount(at * k + z, minlength=len(of) * k)
                    key = np.flatnonzero(many)
                    data = [pa.array(np.full(len(key), k, np.int32)), pa.array(np.full(len(key), seed, np.int32)), pa.array(of[key // k]), own.take(pa.array(key // k)), pa.array((key % k).astype(np.int32)), pa.array(many[key].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(data, ["topics", "seed", "doc_id", "term", "k", "n"])
                a = e

    if "job" in state.columns:
        state = state.where("job IS NULL")
    z = state.select(*fields).mapInArrow(single, "id long, " + ", ".join(f"{c} binary" for c in fields[3:]))
    c = docs.select(_id(), F.transform("cells", lambda c: c["term"]).alias("terms"), F.transform("cells", lambda c: c["n"].cast("long")).alias("ns"))
    both = c.join(z, c["doc_id"] == z["id"]).select("doc_id", "terms", "ns", *fields[3:])
    out = both.mapInArrow(long, "topics int, seed int, doc_id long, term string, k int, n long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
