"""Chat formatting by quotation linking.

A message's lines start with quote marks (``>``, any depth, blanks between); lines without are its own words. Runs of
lines of equal depth are passages. A quoted passage is normalised (marks, case, white space) and hashed; so are all earlier messages'
own passages, as a whole and line by line, in the same conversation. A join by (conversation, hash) links a quotation to the original: the latest
earlier message that has it. A message replies to what its shallowest linked quotation quotes, or, without one, to the message before it.
The result is one row per message with its own text, without quotes, its reply and its place in the
reply tree: depth, ``thread`` (the first message of its chain) and ``position``, the place in pre-order, a message before its replies and replies by turn.
The conversation is its rows by position; a row per message keeps conversations of any length out of a single task's memory. "The latest
before" is found in one pass over rows sorted by range (``behind``), so that no quotation meets more than one original.

Rows with null conv_id or turn are kept, linked with nothing, and have no position. Null and empty texts have no passages. Of rows that repeat (conv_id, turn)
each is a row of the result; links name turns. Equal passages at several earlier turns: the latest counts. A text of quotes alone has an empty own text. An empty
table gives no rows. Texts are read whole, one at a time. conv_id may be of any type with an order, turn is a whole number. Only conv_id, turn, role and text are read
and returned; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, table

MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
BLANK = re.compile(r"\s+")


def passages(text: str | None) -> list[tuple[int, str]]:
    """(depth, text) of runs of lines of one depth, marks removed."""
    out: list[tuple[int, list[str]]] = []
    for line in (text or "").split("\n"):
        m = MARK.match(line)
        depth = m[1].count(">") if m else 0
        body = line[m.end() :] if m else line
        if out and out[-1][0] == depth:
            out[-1][1].append(body)
        else:
            out.append((depth, [body]))
    return [(d, "\n".join(x)) for d, x in out]


def normal(passage: str) -> str:
    return BLANK.sub(" ", passage).strip().lower()


def digest(passage: str) -> str | None:
    s = normal(passage)
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest() if s else None


def keys_of(text: str | None) -> tuple[str, list[str], list[tuple[int, str]]]:
    """(own text, hashes under which others may quote it, (depth, hash) of what it quotes)."""
    parts = passages(text)
    own = [p for d, p in parts if d == 0]
    body = "\n".join(own).strip("\n") if len(parts) > 1 or any(d for d, _ in parts) else "\n".join(own)
    given = {digest(body)} | {digest(p) for p in own}
    if any("\n" in p for p in own):
        given |= {digest(line) for p in own for line in p.split("\n")}
    quotes = [(d, h) for d, p in parts if d for h in ([digest(p)] if "\n" not in p else [digest(p), *map(digest, p.split("\n"))]) if h]
    return body, sorted(x for x in given if x), quotes


def parse(messages: DataFrame) -> DataFrame:
    picked = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    conv = messages.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [keys_of(t) for t in b.column(3).to_pylist()]
            quotes = [[{"depth": d, "hash": h} for d, h in r[2]] for r in rows]
            kind = pa.list_(pa.struct([("depth", pa.int32()), ("hash", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array(quotes, kind)],
                ["conv_id", "turn", "role", "own", "keys", "quotes"],
            )

    return picked.mapInArrow(run, f"conv_id {conv}, turn long, role string, own string, keys array<string>, quotes array<struct<depth: int, hash: string>>")


def behind(rows: DataFrame) -> DataFrame:
    """The same rows with ``last``: the value of the last row before it, in the order (at, kind), of the same conv_id and grp that has one.

    rows: conv_id, grp string, at long, kind int, value long. Sorted by range, not by group, so a group of any size is shared by many tasks;
    what a partition's first group has before it is told by the partitions before.
    """
    spark = rows.sparkSession
    sort = ["conv_id", "grp", "at", "kind"]
    n, conv_type = int(spark.conf.get("spark.sql.shuffle.partitions")), rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.select(*sort, "value").repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = group = value = part = kind = None
        for b in batches:
            last, unknown, kind = [], [], b.column(0).type
            conv, grp, _, _, given, parts = (c.to_pylist() for c in b.columns)
            for g, v in zip(zip(conv, grp, strict=True), given, strict=True):
                if g != group:
                    group, value, first = g, None, first or g
                last.append(value)
                unknown.append(value is None and g == first)
                value = value if v is None else v
            part = parts[-1] if parts else part
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(last, pa.int64()), pa.array(unknown, pa.bool_())], [*b.schema.names, "last", "open"])
        if group is not None:  # the partition's end: what the next one has before it
            end = [[group[0]], [group[1]], [None], [None], [value], [part], [None], [None]]
            types = [kind, pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(end, types, strict=True)], [*b.schema.names, "last", "open"])

    got = materialise(dealt.mapInArrow(run, f"conv_id {conv_type}, grp string, at long, kind int, value long, part int, last long, open boolean"), "behind")
    state, told = None, []
    for r in got.where("open IS NULL").orderBy("part").collect():
        told.append((r.part, *state) if state else (r.part, None, None, None))
        group = (r.conv_id, r.grp)
        state = (*group, state[2] if r.value is None and state and state[:2] == group else r.value)
    told = F.broadcast(spark.createDataFrame(told, f"part int, t_conv {conv_type}, t_grp string, more long"))
    out = got.where("open IS NOT NULL").join(told, "part", "left")
    same = F.col("open") & (F.col("t_conv") == F.col("conv_id")) & (F.col("t_grp") == F.col("grp"))
    return out.select(*sort, F.coalesce("last", F.when(same, F.col("more"))).alias("last"))


def ends(nodes: DataFrame) -> DataFrame:
    """(conv_id, at, n, top): n summed along each node's chain of pointers, top of its end. nodes: conv_id, at, to, n, top.

    Pointer jumping: a round doubles how far pointers reach, and only those that have not met their end go on to the next.
    """
    spark = nodes.sparkSession
    settled, going = [], materialise(nodes, "nodes")
    while going.where("to IS NOT NULL").limit(1).count():
        every = reduce(DataFrame.union, settled, going)
        up = every.select("conv_id", F.col("at").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"), F.col("top").alias("higher"))
        on = going.where("to IS NOT NULL").join(up, ["conv_id", "to"], "left")
        new = materialise(on.select("conv_id", "at", F.col("far").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("higher", "top").alias("top")), "nodes")
        release(spark)
        settled.append(going.where("to IS NULL"))
        going = new
    return reduce(DataFrame.union, settled, going).select("conv_id", "at", "n", "top")


def positions(reply: DataFrame) -> DataFrame:
    """conv_id, turn, position (0, 1, ...) in the pre-order of each conversation's tree. reply: conv_id, turn, reply_to; one root a conversation.

    An Euler tour, ranked by pointer jumping: each message is entered (step 2 * turn) and left (2 * turn + 1); a step is followed by the first reply's
    or the next sibling's entry, or by the leaving of the message or its parent. Entries that follow a step give the rank.
    """
    kids = reply.where("reply_to IS NOT NULL")
    # the next sibling is the last one before in the order of falling turns
    later = behind(kids.select("conv_id", F.col("reply_to").cast("string").alias("grp"), F.negative("turn").alias("at"), F.lit(0).alias("kind"), F.col("turn").alias("value")))
    later = later.select("conv_id", F.negative("at").alias("turn"), F.col("last").alias("sibling"))
    child = kids.groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    node = reply.join(child, ["conv_id", "turn"], "left").join(later, ["conv_id", "turn"], "left")
    enter, leave = F.col("turn") * 2, F.col("turn") * 2 + 1
    steps = node.select("conv_id", F.explode(F.array(
        F.struct(enter.alias("step"), F.coalesce(F.col("child") * 2, leave).alias("to"), F.when(F.col("child").isNull(), 0).otherwise(1).cast("long").alias("n")),
        F.struct(leave.alias("step"), F.coalesce(F.col("sibling") * 2, F.col("reply_to") * 2 + 1).alias("to"), F.when(F.col("sibling").isNull(), 0).otherwise(1).cast("long").alias("n")),
    )).alias("s")).select("conv_id", F.col("s.step").alias("at"), "s.to", "s.n", F.lit(0).cast("long").alias("top"))
    steps = ends(steps)
    entered = steps.where("at % 2 = 0").select("conv_id", F.expr("at div 2").alias("turn"), "n")
    return entered.join(entered.groupBy("conv_id").agg(F.max("n").alias("most")), "conv_id").select("conv_id", "turn", (F.col("most") - F.col("n")).alias("position"))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own words), n_quotes, n_linked, reply_to, depth, thread, position of every message."""
    base = materialise(parse(messages), "messages")
    turns = base.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    quoted = base.where("size(quotes) > 0").select("conv_id", "turn", F.explode("quotes").alias("q"))
    quoted = quoted.select("conv_id", "turn", F.col("q.depth").alias("level"), F.col("q.hash").alias("hash")).distinct()
    wanted = quoted.select("conv_id", "hash").distinct()
    given = base.select("conv_id", F.col("turn").alias("source"), F.explode("keys").alias("hash")).join(wanted, ["conv_id", "hash"], "left_semi")
    # a quotation comes before what its own turn gives, so that it meets earlier turns only
    asked = quoted.select("conv_id", "turn", "hash").distinct().select("conv_id", F.col("hash").alias("grp"), F.col("turn").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("value"))
    offered = given.where("source IS NOT NULL").distinct().select("conv_id", F.col("hash").alias("grp"), F.col("source").alias("at"), F.lit(1).alias("kind"), F.col("source").alias("value"))
    met = behind(asked.union(offered)).where("kind = 0 AND last IS NOT NULL").select("conv_id", F.col("at").alias("turn"), F.col("grp").alias("hash"), F.col("last").alias("source"))
    met = quoted.join(met, ["conv_id", "turn", "hash"])
    best = met.groupBy("conv_id", "turn").agg(F.min(F.struct("level", F.negative("source").alias("m"))).alias("b"), F.count_distinct("hash").alias("n_linked"))
    best = best.select("conv_id", "turn", F.negative("b.m").alias("quoted"), "n_linked")
    before = behind(turns.select("conv_id", F.lit("").alias("grp"), F.col("turn").alias("at"), F.lit(0).alias("kind"), F.col("turn").alias("value")))
    before = before.select("conv_id", F.col("at").alias("turn"), F.col("last").alias("before"))
    reply = before.join(best, ["conv_id", "turn"], "left").select("conv_id", "turn", "n_linked", F.coalesce("quoted", "before").alias("reply_to"))
    reply = materialise(reply, "replies")
    up = F.col("reply_to")
    tree = ends(reply.select("conv_id", F.col("turn").alias("at"), up.alias("to"), up.isNotNull().cast("long").alias("n"), F.coalesce(up, "turn").alias("top")))
    tree = tree.select("conv_id", F.col("at").alias("turn"), F.col("n").alias("depth"), F.col("top").alias("thread"))
    place = tree.join(reply, ["conv_id", "turn"]).join(positions(reply), ["conv_id", "turn"]).select("conv_id", "turn", "n_linked", "reply_to", "depth", "thread", "position")
    out = base.join(place, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("thread", "turn").alias("thread"), "position",
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))
