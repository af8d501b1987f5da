"""Profiles, distributions, chains, representatives and term reports over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Texts that stand for a removed one.
MARKERS = ["[deleted]", "[removed]", "[ Removed by Reddit ]"]
#: Left edges of the geometric bins, between integers.
EDGES = sorted({round(10 ** (k / 20)) - 0.5 for k in range(131)})


def rows() -> Column:
    return F.count(F.lit(1))


def digest(value: Column) -> Column:
    """16 bytes for a value of any length, so that texts need not travel to be told apart."""
    return F.unhex(F.md5(value.cast("string")))


def preview(text: Column, most: int) -> Column:
    """One line of at most ``most`` code points, an ellipsis where it was cut."""
    t = F.regexp_replace(text, r"[\n\r\t]", " ")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def fractional_days(df: DataFrame, key: str, time: str) -> DataFrame:
    """Days since the first date's midnight (UTC)."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    origin = df.agg(F.unix_micros(F.date_trunc("day", F.min(time).cast("timestamp"))).alias("o"))
    return df.crossJoin(F.broadcast(origin)).select(key, F.round((at / 1000000 - F.col("o") / 1000000) / 86400, 6).alias("day"))  # one row


def marker_only(text: Column) -> Column:
    """Whether a text is a marker, white space around it aside."""
    return F.coalesce(F.regexp_replace(text, r"(?U)^\s+|\s+$", "").isin(*MARKERS), F.lit(False))


def with_origin(events: DataFrame) -> DataFrame:
    """Comments with their submission's and their parent comment's fields, null where absent."""
    e = events.select("doc_key", "thread_id", "parent_id", "author", "text_n_chars", "created_utc", "is_thread_root")
    s = e.where("is_thread_root").select(F.col("doc_key").alias("thread_id"), F.col("author").alias("submission_author"), F.col("text_n_chars").alias("submission_n_chars"))
    c = e.where("NOT is_thread_root")
    p = c.select(F.col("doc_key").alias("parent_id"), F.col("author").alias("parent_author"), F.col("created_utc").alias("parent_created"))
    return c.select("doc_key", "thread_id", "parent_id").join(s, "thread_id", "left").join(p, "parent_id", "left").select("doc_key", "submission_author", "submission_n_chars", "parent_author", "parent_created")


def chain_to_root(events: DataFrame) -> DataFrame:
    """Per comment: steps up to the last ancestor that exists, that ancestor, whether it is a root, and the absent parent above it.

    Pointer jumping, so chains of any length take about log2 of it rounds; a chain that has no end is an error.
    """
    node = cut(events.select("doc_key", "parent_id", "parent_in_dataset", "is_thread_root"))
    there = F.coalesce("parent_in_dataset", F.lit(False))
    walk = node.select("doc_key", F.when(there, F.col("parent_id")).alias("at"), there.cast("long").alias("steps"), F.when(there, F.col("parent_id")).otherwise(F.col("doc_key")).alias("top"))
    for _ in range(node.count().bit_length() + 1):
        if walk.where("at IS NOT NULL").limit(1).count() == 0:
            break
        up = walk.select(F.col("doc_key").alias("at"), F.col("at").alias("far"), F.col("steps").alias("more"), F.col("top").alias("higher"))
        walk = cut(walk.join(up, "at", "left").select("doc_key", F.col("far").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("higher", "top").alias("top")))
    else:
        raise ValueError("parents form a cycle")
    end = node.select(F.col("doc_key").alias("top"), F.col("is_thread_root").alias("reached_root"), F.col("parent_id").alias("absent_parent"))
    comments = node.where("NOT is_thread_root").select("doc_key")
    return walk.select("doc_key", "steps", "top").join(comments, "doc_key", "left_semi").join(end, "top").select("doc_key", "steps", "top", "reached_root", "absent_parent")


def numbered(df: DataFrame, order: list[str], width: int = 3600) -> DataFrame:
    """``row``, from 0, in a global order whose first column is a number: rows are ranked within ranges of it, ranges by their counts."""
    ranged = df.withColumn("__range", F.floor(F.col(order[0]) / width))
    n = ranged.groupBy("__range").agg(rows().alias("__n"))
    start = n.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.join(start, "__range").withColumn("row", F.col("__start") + inside - 1).drop("__range", "__start")


def by_count(counts: DataFrame, n: str) -> DataFrame:
    """Distinct counts from the largest: how many rows have each (k), rows and mass above it, both totals."""
    g = counts.groupBy(n).agg(rows().alias("k"))
    above, every = Window.orderBy(F.desc(n)).rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = F.col(n) * F.col("k")
    return g.select(
        n, "k", F.coalesce(F.sum("k").over(above), F.lit(0)).alias("above"), F.coalesce(F.sum(size).over(above), F.lit(0)).alias("run"), F.sum("k").over(every).alias("rows"), F.sum(size).over(every).alias("total")
    )


def share_of_top(counts: DataFrame, n: str, most: list[int]) -> DataFrame:
    """Share of the mass that the k largest hold."""
    g = by_count(counts, n)
    held = [F.struct(F.lit(m).alias("k"), F.round(F.sum(F.col(n) * F.greatest(F.lit(0), F.least("k", F.lit(m) - F.col("above")))) / F.max("total"), 9).alias("share")) for m in most]
    return g.agg(F.array(*held).alias("x")).select(F.inline("x"))


def rank_share(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Minimum rank by falling count, and its share of all rows."""
    g = by_count(counts, n).select(n, (F.col("above") + 1).alias("min_rank"), F.round((F.col("above") + 1) / F.col("rows"), 9).alias("rank_share"))
    return counts.select(key, n).join(g, n).select(key, n, "min_rank", "rank_share")


def trace(df: DataFrame, step: str, value: str, last: int) -> DataFrame:
    """A series of few steps: relative change, running sum, gain over the last steps, whether it falls."""
    w = Window.orderBy(step)
    before = F.lag(value).over(w)
    return df.select(
        step, value, F.round((F.col(value) - before) / before, 9).alias("relative_change"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"),
        (F.col(value) - F.lag(value, last).over(w)).alias(f"over_last_{last}"), F.coalesce(F.col(value) < before, F.lit(False)).alias("falls"),
    )


def boundary(counts: DataFrame, key: str, n: str, cut_at: int, around: int) -> DataFrame:
    """The rows around a rank cut, by falling count, ties by key."""
    best = counts.orderBy(F.desc(n), key).limit(cut_at + around)
    ranked = best.select(key, n, F.row_number().over(Window.orderBy(F.desc(n), key)).cast("long").alias("rank")).where(F.col("rank") > cut_at - around)
    return ranked.withColumn("side", F.when(F.col("rank") <= cut_at, "above").otherwise("below"))


def tied_at(counts: DataFrame, key: str, n: str, threshold: int) -> DataFrame:
    """Rows whose count is the smallest at or above a threshold, or the largest below it."""
    edge = counts.agg(F.min(F.when(F.col(n) >= threshold, F.col(n))).alias("at"), F.max(F.when(F.col(n) < threshold, F.col(n))).alias("below"))
    near = counts.crossJoin(F.broadcast(edge)).where((F.col(n) == F.col("at")) | (F.col(n) == F.col("below")))  # one row
    return near.select(key, n, F.when(F.col(n) == F.col("at"), "at threshold").otherwise("next below").alias("tied_group"))


def completed_days(df: DataFrame, time: str, kind: str) -> DataFrame:
    """A count for each day of the range and each kind, absent ones 0; the grid is days x kinds."""
    days = df.agg(F.explode(F.sequence(F.to_date(F.min(time)), F.to_date(F.max(time)), F.expr("interval 1 day"))).alias("day"))
    n = df.groupBy(F.to_date(time).alias("day"), F.col(kind).alias("kind")).agg(rows().alias("n"))
    grid = days.crossJoin(n.select("kind").distinct())
    return grid.join(n, ["day", "kind"], "left").select(F.col("day").cast("string").alias("day"), "kind", F.coalesce("n", F.lit(0)).alias("n"))


def geometric_bins(df: DataFrame, value: str) -> DataFrame:
    """Left-closed bins; the number is how many edges lie at or below the value."""
    edges = F.array(*map(F.lit, EDGES))
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(rows().alias("k")).groupBy(F.size(F.filter(edges, lambda e: e <= F.col(value))).alias("bin")).agg(F.sum("k").alias("n"))


def ecdf_grid(df: DataFrame, value: str, steps: int) -> DataFrame:
    """Share of values at or below each whole number 0..steps; sums run over the grid, not over rows."""
    n = df.where(F.col(value).isNotNull()).groupBy(F.least(F.greatest(F.ceil(value), F.lit(0)), F.lit(steps + 1)).cast("int").alias("i")).agg(rows().alias("n"))
    grid = df.sparkSession.range(steps + 2).select(F.col("id").cast("int").alias("i")).join(n, "i", "left")
    run, every = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.coalesce(F.sum("n").over(run), F.lit(0)) / F.sum("n").over(every)
    return grid.select("i", F.round(share, 9).alias("share")).where(F.col("i") <= steps)


def numeric_profile(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    at = [F.round(F.percentile(v, p), 6).alias(c) for p, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return df.agg(
        rows().alias("records"), F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("nonfinite"), F.count_if(v == 0).alias("zero"), F.count_if(v < 0).alias("negative"),
        F.count_if(v > 0).alias("positive"), F.bool_and(v == F.floor(v)).alias("all_integer"), F.count_distinct(v).alias("n_distinct"), *at,
    )


def datetime_profile(df: DataFrame, time: str) -> DataFrame:
    """Hours are a bit set, so that one aggregation by day serves for everything."""
    day = df.groupBy(F.to_date(time).alias("day")).agg(rows().alias("n"), F.min(time).alias("a"), F.max(time).alias("b"), F.bit_or(F.expr(f"shiftleft(1, hour({time}))")).alias("h"))
    span = F.datediff(F.max("day"), F.min("day")).cast("long") + 1
    return day.agg(
        F.min("a").alias("first_at"), F.max("b").alias("last_at"), span.alias("days_in_range"), rows().alias("days_with"), (span - rows()).alias("days_without"), F.min("n").alias("least"),
        F.round(F.percentile("n", 0.5), 6).alias("median"), F.max("n").alias("most"), F.bit_count(F.bit_or("h")).cast("long").alias("hours"),
    )


def text_profile(df: DataFrame, text: str) -> DataFrame:
    """Facts are taken before the shuffle; only digests and small numbers travel."""
    t = F.col(text)
    facts = df.select(
        F.sha2(t, 256).alias("d"), F.length(t).cast("long").alias("size"), (t == "").alias("empty"), t.rlike(r"^\s+$").alias("blank"), t.rlike(r"^\s|\s\z").alias("edge"), t.contains("\n").alias("newline")
    )
    v = facts.groupBy("d", "size", "empty", "blank", "edge", "newline").agg(rows().alias("k"))
    held = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("k"))), F.lit(0))
    return v.agg(
        F.sum("k").alias("records"), held("empty").alias("empty"), held("blank").alias("blank"), held("edge").alias("edge_blank"), held("newline").alias("with_newline"),
        F.count_if((F.col("k") == 1) & F.col("d").isNotNull()).alias("once"), F.count_if((F.col("k") > 1) & F.col("d").isNotNull()).alias("repeated"), F.min("size").alias("shortest"), F.max("size").alias("longest"),
    )


def cardinality_classes(df: DataFrame) -> DataFrame:
    n = df.agg(*[F.count_distinct(digest(F.col(f"`{c}`"))).alias(c) for c in df.columns]).unpivot([], df.columns, "field", "n_distinct")
    size = F.col("n_distinct")
    return n.withColumn("cardinality", F.when(size == 0, "none").when(size == 1, "constant").when(size <= 20, "low").otherwise("high"))


def top_values(df: DataFrame, columns: list[str], few: int = 20, most: int = 10) -> DataFrame:
    """All values of a field with at most ``few``, else the ``most`` commonest; ties by value."""
    out = None
    for c in columns:
        n = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("value")).agg(rows().alias("n"))
        best = n.orderBy(F.desc("n"), "value").limit(few + 1)
        ranked = best.select(F.lit(c).alias("field"), "value", "n", F.row_number().over(Window.orderBy(F.desc("n"), "value")).cast("long").alias("rank"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("m"))
        ranked = ranked.where((F.col("m") <= few) | (F.col("rank") <= most)).drop("m")
        out = ranked if out is None else out.unionByName(ranked)
    return out


def retention(df: DataFrame, by: str) -> DataFrame:
    """Counts of all rows and of those inside, difference of their shares in points, share retained."""
    g = df.groupBy(by).agg(rows().alias("n_all"), F.count_if("inside").alias("n_subset"))
    every = Window.partitionBy(F.lit(1))
    points = 100 * F.col("n_subset") / F.sum("n_subset").over(every) - 100 * F.col("n_all") / F.sum("n_all").over(every)
    return g.select(by, "n_all", "n_subset", F.round(points, 6).alias("points"), F.round(F.col("n_subset") / F.col("n_all"), 9).alias("retention"))


def accounting(df: DataFrame, by: str, size: str, stages: dict[str, int]) -> DataFrame:
    """Rows and sizes that reach each stage, all in one pass."""
    aggs = []
    for least in stages.values():
        inside = F.when(F.col(size) >= least, F.col(size))
        aggs += [F.count(inside), F.coalesce(F.sum(inside), F.lit(0))]
    row = df.groupBy(by).agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)])
    parts = F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"a{2 * i}").alias("documents"), F.col(f"a{2 * i + 1}").alias("tokens")) for i, s in enumerate(stages)])
    return row.select(by, F.inline(parts))


def representatives(df: DataFrame, by: str, value: str, key: str, most: int, at: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """The ``most`` rows nearest to each percentile, ties by key. Rows meet targets of their group only: a few numbers, broadcast."""
    q = df.groupBy(by).agg(F.array(*[F.struct(F.lit(p).alias("p"), F.percentile(value, p / 100).alias("target")) for p in at]).alias("q")).select(by, F.inline("q"))
    near = df.select(by, key, value).join(q, by).withColumn("gap", F.round(F.abs(F.col(value) - F.col("target")), 6))
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy(by, "p").orderBy("gap", key)).cast("long"))
    return best.where(F.col("rank") <= most).select(by, "p", "rank", key, value)


def first_of_both(df: DataFrame, by: str, form: str, author: str, value: str, key: str) -> DataFrame:
    """Rows that come first (largest value, then smallest key) both with their form and with their author."""
    order = F.max(F.struct(value, F.negative(key).alias("k"))).alias("best")
    one = df.groupBy(by, form).agg(order).select(by, F.negative("best.k").alias(key))
    two = df.groupBy(by, author).agg(order).select(by, F.negative("best.k").alias(key))
    both = one.join(two, [one[by].eqNullSafe(two[by]), one[key] == two[key]], "left_semi").withColumnRenamed(by, "__by")
    return df.select(by, key, value).join(both, [F.col(by).eqNullSafe(F.col("__by")), df[key] == both[key]], "left_semi")


def lower_ranked_copies(df: DataFrame, same: list[str], value: str, key: str) -> DataFrame:
    """Whether a row of the same form ranks higher: the best of each form is an aggregate, not a sorted group."""
    best = df.groupBy(*same).agg(F.max(F.struct(value, F.negative(key).alias("k"))).alias("best"))
    left = best.select(*[F.col(c).alias(f"__{c}") for c in same], F.negative("best.k").alias("__k"))
    return df.join(left, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same], "left").select(same[0], key, (F.col(key) != F.col("__k")).alias("near_duplicate"))


def peaks(df: DataFrame, by: str, day: str, n: str) -> DataFrame:
    """Peak day, the three largest days' sum, and how many of the largest days hold half."""
    w = Window.partitionBy(by).orderBy(F.desc(n), day)
    r = df.withColumn("i", F.row_number().over(w)).withColumn("run", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum(n).over(Window.partitionBy(by)))
    return r.groupBy(by).agg(
        F.min(F.when(F.col("i") == 1, F.col(day))).cast("string").alias("peak_day"), F.sum(F.when(F.col("i") <= 3, F.col(n))).alias("top3"), F.min(F.when(2 * F.col("run") >= F.col("total"), F.col("i"))).cast("long").alias("days_to_half")
    )


def mass(counts: DataFrame, n: str) -> DataFrame:
    """Shares of the commonest 10, 50, 200 and how many hold half. Equal counts are one row, so the window runs over distinct counts only."""
    g = by_count(counts, n)
    top = lambda m: F.round(F.sum(F.col(n) * F.greatest(F.lit(0), F.least("k", F.lit(m) - F.col("above")))) / F.max("total"), 9).alias(f"top{m}")
    need = F.ceil((F.col("total") / 2 - F.col("run")) / F.col(n))
    half = F.min(F.when((need >= 1) & (need <= F.col("k")), F.col("above") + need))
    return g.agg(F.max("total").alias("total"), top(10), top(50), top(200), half.alias("terms_to_half"))


def beyond_smaller(lists: DataFrame) -> DataFrame:
    """Per list: entries that no smaller list holds."""
    size = lists.groupBy("list_id").agg(rows().alias("n"))
    sized = lists.join(size, "list_id")
    least = sized.groupBy("entry").agg(F.min("n").alias("least"))
    return sized.join(least, "entry").groupBy("list_id").agg(F.max("n").alias("n"), F.count_if(F.col("n") == F.col("least")).alias("beyond_smaller"))


def vocabulary_origin(tokens: DataFrame, first: Column, one: str, two: str) -> DataFrame:
    t = tokens.groupBy("term", "doc_id").agg(F.bool_or(first).alias("a"), F.bool_or(~first).alias("b"))
    t = t.groupBy("term").agg(rows().alias("df"), F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    origin = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), one).otherwise(two)
    return t.groupBy(origin.alias("origin")).agg(rows().alias("n_terms"), F.count_if(F.col("df") == 1).alias("once"))
