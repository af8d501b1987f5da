"""Jaccard self-join of texts over word n-grams by a token-group matrix.

Two texts link when ``threshold`` <= 100 * |A n B| / |A u B| over their sets of distinct shingles. Result: the
size of each text's set and its component, the smallest id reachable by links. Steps, all exact:

1. Texts with equal sets are one class, known by 64 bits of its set's digest; the smallest id stands for it.
2. Parts: a set is dealt by hash into more parts than two linked sets of its size can differ in shingles. So some parts
   with shingles in them, a known number at least, are the same in both; a class that has fewer parts in common with others links with nothing. Sizes are
   grouped into levels, each with a number of parts of its own; a set takes part in the levels of all sizes it could link with.
3. The survivors' shingles are counted; those with p = n - ceil(t n) + 1 shingles of their own leave too. Each of the others keeps its p
   rarest shingles (the prefix), of which linked sets share one.
4. Groups: within each prefix shingle the most typical set (whose shingles are the most frequent) is the leader; sets that
   link with a leader join its component, so that similar documents are together, however many.
5. Token-group matrix: a component, cut into blocks of bounded size, is a group; the matrix holds its token union. Components that
   share a prefix shingle and whose sizes and places of it leave room for a link meet, the smaller asks the larger: its sets are queries, bounded by their overlap with each group's union,
   and only qualifying groups are opened: their members are compared with the query, exactly.
6. Components of all links.

Hot shingles: counts use partial aggregation; sets of one component never meet in (5), and joins on components are salted. Copies are
never paired (1), near copies meet leaders and groups instead of one another (4, 5).

Shingles are 64-bit hashes of words. Null, empty and wordless texts have 0 shingles, and their own id as component. Rows
that repeat an id give a row each, by their own texts. Rows with a null id link with nothing and have a null component. Ids may be
of any type with an order. Columns other than id and text are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, mix, release, shingle_hashes, slices, table, text_bytes, word_hashes

#: Ids up to this number may be sent to all tasks as a set (8 bytes each).
BROADCAST_IDS = 1_000_000
GROUP, SALTS = 64, 16


def least_overlap(n: np.ndarray | int, threshold: int) -> np.ndarray | int:
    """ceil(threshold / 100 * n): what a set of n must share with a linked one, at least."""
    return -(-n * threshold // 100)


@lru_cache(maxsize=4096)
def level(size: int) -> int:
    """The number of the level that sets of this size are at."""
    at, high = 0, 1
    while high < size:
        at, high = at + 1, above(high)
    return at


def above(high: int) -> int:
    """The largest size of the level after the one whose largest size is ``high``."""
    return max(high + 1, high * 8 // 5)


@lru_cache(maxsize=4096)
def parts_of(at: int, threshold: int) -> tuple[int, int]:
    """(largest size, parts) of a level; 0 parts where linked sets differ nowhere."""
    high = 1
    for _ in range(at):
        high = above(high)
    differ = apart(high, high, threshold)
    return high, differ + 3 + differ // 8 if differ else 0


def apart(size: int, other: int, threshold: int) -> int:
    """In how many shingles linked sets of these sizes differ at most: n + m - 2 i, where i >= t (n + m) / (1 + t)."""
    return (size + other) * (100 - threshold) // (100 + threshold)


def part_keys(s: np.ndarray, threshold: int) -> tuple[np.ndarray, list[int | None]]:
    """Keys of the parts of a sorted set, and how many of them a linked set that differs has at least, by level (mod 16, as in the keys' last bits).

    Of a set's parts with shingles in them, at most ``apart`` differ from a linked set's, and that one tells the others too. Where
    this leaves none, empty parts are told as well: then one of all parts is in common.
    """
    out, need = [np.zeros(0, np.uint64)], [None] * 16
    with np.errstate(over="ignore"):
        sums = None
        for at in range(level(len(s)), level(100 * len(s) // threshold) + 1) if len(s) else ():
            high, parts = parts_of(at, threshold)
            if parts == 0:
                continue
            if sums is None:
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
            number = np.bincount(((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), minlength=parts)
            ends = np.cumsum(number)
            key = mix(sums[ends] - sums[ends - number] + mix(np.arange(parts, dtype=np.uint64) + np.uint64(at << 40)))
            key = key & ~np.uint64(15) | np.uint64(at & 15)
            told = np.flatnonzero(number)
            differ = apart(len(s), min(high, 100 * len(s) // threshold), threshold)
            need[at & 15] = max(1, len(told) - differ)
            out.append(key[told] if len(told) > differ else key)
    return np.concatenate(out), need


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: int, whole: bool) -> DataFrame:
    """id, n, s (64 bits of the set's digest), and tokens: all of the set (whole), or the keys of its parts and ``need``."""
    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                words, row = word_hashes(*text_bytes(b.column(1)))
                border = np.searchsorted(row, np.arange(b.num_rows + 1))
                n, sig, tokens, need = [], [], [], []
                for i in range(b.num_rows):
                    s = np.unique(shingle_hashes(words[border[i] : border[i + 1]], k))
                    n.append(len(s))
                    sig.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                    keys, least = (s, None) if whole else part_keys(s, threshold)
                    tokens.append(keys)
                    need.append(least)
                ends = np.cumsum([0, *map(len, tokens)])
                flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
                columns = [b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(need, pa.list_(pa.int32()))], ["id", "n", "s", "tokens", "need"])

    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), *T.StructType.fromDDL("n long, s long, tokens array<long>, need array<int>").fields])
    return picked.mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b), the component its smallest id: labels spread along links and along labels until none changes."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        met = labels.join(near, labels["id"] == near["a"]).select("id", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        step = met.join(jump, "new", "left").select("id", F.coalesce(F.least("far", "new"), "new").alias("label"), (F.coalesce(F.least("far", "new"), "new") != F.col("old")).alias("moved"))
        step = materialise(step, "labels")
        labels = step.select("id", "label")
        if not step.where("moved").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that link, their sets compared in full."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("i", F.size(F.array_intersect("ta", "tb")).cast("long"))
    return both.where(100 * F.col("i") >= threshold * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def possible(x: str, y: str, threshold: int):
    """Whether sizes and the numbers of shingles that no other set has (u) leave room for a link."""
    n, m, u, v = F.col(f"n{x}"), F.col(f"n{y}"), F.col(f"u{x}"), F.col(f"u{y}")
    most = F.least(n - u, m - v)
    return 100 * most >= threshold * (n + m - most)


def links_of(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, s of every row; links between classes)."""
    spark = docs.sparkSession
    base = materialise(shingle_sets(docs, id_col, text_col, k, threshold, whole=False), "parts")
    size = materialise(base.select("id", "n", "s"), "sizes")
    # 2: parts that two different sets have
    some = base.where("s IS NOT NULL AND id IS NOT NULL")
    part = some.select("s", F.explode("tokens").alias("t"))
    shared = materialise(part.groupBy("t").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y").select("t"), "shared")
    met = part.join(shared, "t", "left_semi").groupBy("s", F.col("t").bitwiseAND(15).cast("int").alias("at")).agg(F.count(F.lit(1)).alias("c"))
    need = some.groupBy("s").agg(F.count(F.lit(1)).alias("copies"), F.first("need").alias("need"))
    alive = met.join(need, "s").where(F.col("c") >= F.col("copies") * F.get("need", F.col("at"))).select("s").distinct()
    alive = materialise(alive, "alive")
    release(spark, base, shared)
    if alive.limit(1).count() == 0:
        return size, spark.createDataFrame([], "a long, b long")
    # 3: the survivors' whole sets, read from their texts again: of each class those of its smallest id
    ids = materialise(size.where("id IS NOT NULL").join(alive, "s").groupBy("s").agg(F.min("id").alias("__id")).select("__id").distinct(), "ids")
    left = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    left = left.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "__id", "left_semi")
    p = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    sets = shingle_sets(left, "__id", "__text", k, threshold, whole=True).select(F.col("s").alias("id"), "n", "tokens").where("id IS NOT NULL")
    sets = materialise(sets.join(alive.withColumnRenamed("s", "id"), "id", "left_semi").dropDuplicates(["id"]), "sets")
    posting = sets.select("id", "n", F.explode("tokens").alias("t"))
    often = posting.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    seen = posting.join(often, "t")
    chosen = seen.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "t"))).alias("list"), F.sum("c").alias("typical"))
    chosen = chosen.withColumn("u", F.col("n") - F.size("list")).withColumn("keep", (p - F.col("u")).cast("int")).where("keep > 0")
    prefix = chosen.select("id", "n", "u", "typical", F.posexplode(F.slice("list", 1, F.col("keep"))).alias("i", "x"))
    # after: how many shingles of the set come from this one on, in the common order (own ones first); at the first
    # shingle that two sets share, both numbers bound their overlap
    prefix = materialise(prefix.select("id", "n", "u", "typical", (F.col("n") - F.col("u") - F.col("i")).alias("after"), F.col("x.t").alias("t")), "prefix")
    release(spark)
    # 4: leaders
    leader = prefix.groupBy("t").agg(F.max(F.struct("typical", F.negative("id").alias("m"), "n", "u")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1")
    leader = leader.select("t", F.negative("l.m").alias("b"), F.col("l.n").alias("nb"), F.col("l.u").alias("ub"))
    star = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("u").alias("ua"), "t").join(leader, "t")
    star = star.where("a <> b").where(possible("a", "b", threshold)).select("a", "b").distinct()
    first = materialise(verified(star, sets, threshold), "star")
    release(spark)
    label = components(first)
    # 5: groups of other components. The sizes of components are joined by (component, salt), as one may hold a third of all sets
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    number_of = label.groupBy("component").agg(F.count(F.lit(1)).alias("m")).withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    sized = label.withColumn("salt", salt).join(number_of, ["component", "salt"]).select("id", "component", "m")
    member = prefix.select("id", "n", "u").distinct().join(sized, "id", "left").select("id", "n", "u", F.coalesce("component", "id").alias("comp"), F.coalesce("m", F.lit(1)).alias("m"))
    member = materialise(member.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("m") / GROUP)).cast("int")), "members")
    placed = prefix.select("id", "t", "after").join(member, "id")
    matrix = placed.groupBy("t", "comp", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("after").alias("most"))
    # of two linked sets the smaller one has room for a set of its own size after the first shingle that they share, so
    # components meet only where one has such a set; then the smaller component asks the larger, of equal ones the one with the larger label
    spare = (100 + threshold) * F.col("after") >= 2 * threshold * F.col("n")
    have = placed.groupBy("t", "comp", "m").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("after").alias("most"), F.bool_or(spare).alias("spare"))
    have = materialise(have, "have")
    told = have.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.bool_or("spare").alias("any")).where("c > 1 AND any").select("t")
    have = have.join(told, "t")
    x, y = (have.select("t", *[F.col(c).alias(f"{c}{i}") for c in ("comp", "m", "low", "high", "most", "spare")]) for i in (1, 2))
    fits = (100 * F.col("high1") >= threshold * F.col("low2")) & (100 * F.col("high2") >= threshold * F.col("low1")) & (F.col("low1") <= F.col("high2"))
    fits = fits & ((100 + threshold) * F.least("most1", "most2") >= threshold * (F.col("low1") + F.col("low2")))
    asked = x.where("spare1").join(y, "t").where((F.col("comp1") != F.col("comp2")) & fits)
    asks = (F.col("m1") < F.col("m2")) | ((F.col("m1") == F.col("m2")) & (F.col("comp1") > F.col("comp2")))
    asked = asked.select("t", F.when(asks, F.col("comp1")).otherwise(F.col("comp2")).alias("cq"), F.when(asks, F.col("comp2")).otherwise(F.col("comp1")).alias("comp")).distinct()
    query = placed.select(F.col("id").alias("q"), F.col("n").alias("nq"), F.col("after").alias("aq"), F.col("comp").alias("cq"), "t")
    near = (100 * F.col("high") >= threshold * F.col("nq")) & (100 * F.col("nq") >= threshold * F.col("low"))
    room = (100 + threshold) * F.least("aq", "most") >= threshold * (F.col("nq") + F.col("low"))
    met = query.join(asked, ["t", "cq"]).join(matrix, ["t", "comp"]).where(near & room).select("q", "nq", "comp", "block").distinct()
    met = materialise(met, "met")
    release(spark)
    wanted = met.select("comp", "block").distinct()
    unions = member.join(wanted, ["comp", "block"]).join(sets.select("id", "tokens"), "id")
    unions = unions.groupBy("comp", "block").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"))
    open_ = met.join(unions, ["comp", "block"]).join(sets.select(F.col("id").alias("q"), "tokens"), "q")
    open_ = open_.where(100 * F.size(F.array_intersect("tokens", "union")) >= threshold * F.col("nq")).select("q", "comp", "block")
    one = member.select(F.col("id").alias("q"), F.col("n").alias("nq"), F.col("u").alias("uq"))
    two = member.select(F.col("id").alias("m"), F.col("n").alias("nm"), F.col("u").alias("um"), "comp", "block")
    pairs = open_.join(one, "q").join(two, ["comp", "block"]).where(possible("q", "m", threshold))
    pairs = pairs.select(F.least("q", "m").alias("a"), F.greatest("q", "m").alias("b")).distinct()
    second = materialise(verified(pairs, sets, threshold), "cross")
    release(spark, sets, prefix, member, met, have)
    return size, first.union(second)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80) -> DataFrame:
    """id, n_shingles, component_id of every row."""
    size, links = links_of(docs, id_col, text_col, k, threshold)
    rep = size.where("s IS NOT NULL AND id IS NOT NULL").groupBy("s").agg(F.min("id").alias("rep"))
    named = materialise(rep.join(components(links).withColumnRenamed("id", "s"), "s", "left"), "classes")
    # most classes are alone; of the others the component's smallest id is joined by (component, salt)
    salt = F.pmod(F.xxhash64("s"), F.lit(SALTS))
    smallest = named.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    smallest = smallest.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    linked = named.where("component IS NOT NULL").withColumn("salt", salt).join(smallest, ["component", "salt"]).select("s", "least")
    several = size.where("s IS NOT NULL AND id IS NOT NULL").groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("rep")).where("c > 1").select("s", "rep")
    told = several.join(linked, "s", "full").select("s", F.coalesce("least", "rep").alias("least"))
    out = size.join(materialise(told, "told"), "s", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, threshold=90)
