"""Consensus of word lists; a list's size and the number of lists are small, entries may be many."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import cut
from .reports import by_count


def consensus(lists: DataFrame) -> DataFrame:
    """Entries with the number of lists that hold them and these lists' names."""
    return lists.groupBy("entry").agg(F.count_distinct("list_id").alias("n_lists"), F.array_join(F.array_sort(F.collect_set("list_id")), ";").alias("held_by"))


def pairwise(lists: DataFrame) -> DataFrame:
    """Jaccard and set relation of all pairs of lists that share an entry."""
    size = lists.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    # an entry names each pair of the lists that hold it; lists are few
    held = lists.groupBy("entry").agg(F.array_sort(F.collect_set("list_id")).alias("held")).where(F.size("held") > 1)
    pairs = F.flatten(F.transform("held", lambda x, i: F.transform(F.slice("held", i + 2, F.size("held")), lambda y: F.struct(x.alias("list_a"), y.alias("list_b")))))
    both = held.groupBy("held").agg(F.count(F.lit(1)).alias("k")).select("k", F.inline(pairs)).groupBy("list_a", "list_b").agg(F.sum("k").alias("shared"))
    both = both.join(size.select(F.col("list_id").alias("list_a"), F.col("n").alias("na")), "list_a").join(size.select(F.col("list_id").alias("list_b"), F.col("n").alias("nb")), "list_b")
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    relation = (
        F.when((F.col("shared") == F.col("na")) & (F.col("shared") == F.col("nb")), "identical").when(F.col("shared") == F.col("na"), "a in b")
        .when(F.col("shared") == F.col("nb"), "b in a").when(j >= 0.9, "near-duplicate").otherwise("distinct")
    )
    return both.select("list_a", "list_b", "na", "nb", "shared", F.round(j, 9).alias("jaccard"), relation.alias("relation"))


def tiers(entries: DataFrame) -> DataFrame:
    """Three count thresholds t1 > t2 > t3 >= 2 whose cumulative sizes come nearest to 1 : 2 : 4; the first of the best."""
    n = entries.where("n_lists >= 2").groupBy("n_lists").agg(F.count(F.lit(1)).alias("k"))
    d = n.alias("a").join(n.alias("b"), F.col("b.n_lists") >= F.col("a.n_lists")).groupBy(F.col("a.n_lists").alias("t")).agg(F.sum("b.k").alias("size"))
    x, y, z = (d.select(F.col("t").alias(f"t{i}"), F.col("size").alias(f"n{i}")) for i in (1, 2, 3))
    every = x.join(y, F.col("t1") > F.col("t2")).join(z, F.col("t2") > F.col("t3"))  # thresholds: at most one per list
    loss = F.abs(F.ln(F.col("n2") / F.col("n1")) - F.ln(F.lit(2.0))) + F.abs(F.ln(F.col("n3") / F.col("n1")) - F.ln(F.lit(4.0)))
    return every.withColumn("objective", F.round(loss, 9)).orderBy("objective", F.desc("t1"), F.desc("t2"), F.desc("t3")).limit(1)


# --- entries ------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def composed(s: pd.Series) -> pd.Series:
    """Unicode normal form C, which has no built-in."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def normalised(raw: DataFrame) -> DataFrame:
    """list_id, position, raw_entry, entry, what changed, why dropped."""
    e = raw.withColumn("e1", composed("raw_entry")).withColumn("e2", F.regexp_replace("e1", "[‘’ʼ′]", "'")).withColumn("e3", F.regexp_replace("e2", r"(?U)^\s+|\s+$", ""))
    e = e.withColumn("e4", F.regexp_replace("e3", r"(?U)\s+", " ")).withColumn("entry", F.lower("e4"))
    steps = (("raw_entry", "e1", "nfc"), ("e1", "e2", "apostrophe"), ("e2", "e3", "trim"), ("e3", "e4", "whitespace"), ("e4", "entry", "case"))
    changes = F.concat_ws(";", *[F.when(F.col(a) != F.col(b), name) for a, b, name in steps])
    again = F.row_number().over(Window.partitionBy("list_id", "entry").orderBy("position")) > 1
    return e.select("list_id", "position", "raw_entry", "entry", changes.alias("changes"), F.when(F.col("entry") == "", "empty").when(again, "duplicate_within_list").otherwise("").alias("dropped"))


def entry_class(e: Column) -> Column:
    return (
        F.when(e.rlike(r"(?U)\s"), "multiword").when(e.rlike("^[a-z]+$"), "word").when(e.rlike("^[a-z]+(-[a-z]+)+$"), "hyphenated").when(e.rlike("^[a-z']+$"), "apostrophe").when(e.rlike("^[0-9]+$"), "numeric")
        .when(e.rlike("[a-z]") & e.rlike("[0-9]"), "alphanumeric").when(~e.rlike("[a-z0-9]"), "punctuation_or_symbol").otherwise("other_characters")
    )


def kept(entries: DataFrame) -> DataFrame:
    """What is left of each list, with classes."""
    return entries.where("dropped = ''").select("list_id", "position", "entry", entry_class(F.col("entry")).alias("entry_class"))


def producible(e: Column, least: int = 2) -> Column:
    """Whether the letter-run tokenizer can make a token of an entry, and where it would be removed."""
    return (
        F.when(~e.rlike(r"^\p{L}+(?:'\p{L}+)*$"), "no: other characters").when(e.endswith("'s"), "no: possessive").when(F.length(e) < least, "yes, but too short").otherwise("yes")
    )


def list_summary(entries: DataFrame, classes: list[str]) -> DataFrame:
    """Per list: raw and unique entries, what was dropped and changed, unique entries by class."""
    a = entries.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col("dropped") == "").alias("n_unique"), F.count_if(F.col("dropped") == "duplicate_within_list").alias("n_duplicates"),
        *[F.count_if(F.col("changes").contains(c)).alias(f"n_{c}_changed") for c in ("case", "apostrophe", "trim")],
    )
    b = kept(entries).groupBy("list_id").pivot("entry_class", classes).count().na.fill(0)
    return a.join(b.select("list_id", *[F.col(c).alias(f"n_{c}") for c in classes]), "list_id", "left")


def relations(lists: DataFrame) -> DataFrame:
    """Every pair of a few lists: set sizes, differences, relation; pairs that share nothing too."""
    sets = lists.groupBy("list_id").agg(F.collect_set("entry").alias("s"))
    a, b = sets.select(F.col("list_id").alias("list_a"), F.col("s").alias("sa")), sets.select(F.col("list_id").alias("list_b"), F.col("s").alias("sb"))
    p = a.join(F.broadcast(b), F.col("list_a") < F.col("list_b"))  # lists are few, and each is a row
    shared, na, nb = F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb")
    j = shared / (na + nb - shared)
    relation = F.when((shared == na) & (shared == nb), "identical").when(shared == na, "a_subset_of_b").when(shared == nb, "b_subset_of_a").when(j >= 0.9, "near_duplicate").otherwise("distinct")
    words = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), " ")
    return p.select("list_a", "list_b", na.alias("size_a"), nb.alias("size_b"), shared.alias("shared"), F.round(j, 4).alias("jaccard"), relation.alias("relation"), words("sa", "sb").alias("only_in_a"), words("sb", "sa").alias("only_in_b"))


def equality_levels(entries: DataFrame) -> DataFrame:
    """Every pair of lists: equal as raw sequences, raw multisets, raw sets, normalised sets, and after apostrophes are stripped."""
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c])
    live = F.when(F.col("dropped") == "", F.col("entry"))
    sets = entries.groupBy("list_id").agg(
        order("raw_entry").alias("seq"), F.array_sort(F.collect_list("raw_entry")).alias("bag"), F.array_sort(F.collect_set("raw_entry")).alias("raw_set"), F.array_sort(F.collect_set(live)).alias("norm"),
        F.array_sort(F.collect_set(F.replace(live, F.lit("'"), F.lit("")))).alias("plain"), F.array_sort(F.collect_set(F.when(live.rlike("^[a-z]+$"), live))).alias("words"),
    )
    levels = {"raw_sequence": "seq", "raw_multiset": "bag", "raw_set": "raw_set", "normalised_set": "norm", "without_apostrophes": "plain", "words_only": "words"}
    a, b = (sets.select(F.col("list_id").alias(f"list_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in levels.values()]) for s in "ab")
    return a.join(F.broadcast(b), F.col("list_a") < F.col("list_b")).select("list_a", "list_b", *[(F.col(f"{c}_a") == F.col(f"{c}_b")).alias(k) for k, c in levels.items()])  # lists are few


def nested(lists: DataFrame, chain: list[str]) -> DataFrame:
    """A chain of snapshots: size, added and removed against the one before, whether the next holds all of it."""
    sets = lists.where(F.col("list_id").isin(chain)).groupBy("list_id").agg(F.collect_set("entry").alias("s"))
    at = sets.withColumn("step", F.array_position(F.array(*map(F.lit, chain)), F.col("list_id")).cast("int"))
    w = Window.orderBy("step")  # a row a snapshot
    x = at.select("step", "list_id", "s", F.lag("s").over(w).alias("before"), F.lead("s").over(w).alias("after"))
    less = lambda a, b: F.size(F.array_except(a, b))
    none = F.array().cast("array<string>")
    return x.select(
        "step", "list_id", F.size("s").alias("n"), less("s", F.coalesce("before", none)).alias("added"), F.when(F.col("before").isNotNull(), less("before", "s")).alias("removed"),
        F.when(F.col("after").isNotNull(), less("s", "after") == 0).alias("subset_of_next"),
    )


# --- consensus -------------------------------------------------------------------


def word_stats(members: DataFrame) -> DataFrame:
    """Per entry: lists, distinct lists (equal sets count once), families that hold it in any or in all of their lists, family roots."""
    of_list = members.groupBy("list_id", "family").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("entry")), "\n"), 256).alias("set_hash"))
    first = of_list.groupBy("set_hash").agg(F.min("list_id").alias("list_id")).select("list_id", F.lit(1).alias("counts"))
    families = of_list.groupBy("family").agg(F.count(F.lit(1)).alias("of_family"))
    m = members.join(F.broadcast(first), "list_id", "left")  # a row a list
    by = m.groupBy("entry", "family").agg(F.count(F.lit(1)).alias("n"), F.count("counts").alias("d"), F.count_if("is_root").alias("r"))
    by = by.join(F.broadcast(families), "family").withColumn("every", F.col("n") == F.col("of_family"))  # a row a family
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return by.groupBy("entry").agg(
        F.sum("n").alias("n_lists"), F.sum("d").alias("n_distinct_lists"), F.count(F.lit(1)).alias("n_families_any"), F.count_if("every").alias("n_families_all"), F.sum("r").alias("n_family_roots"),
        names("family").alias("families_any"), names(F.when(F.col("every"), F.col("family"))).alias("families_all"),
    )


def tiered(entries: DataFrame) -> DataFrame:
    """Entries with their tier (1 to 3, null beyond) by the chosen thresholds."""
    t = tiers(entries).select("t1", "t2", "t3")
    n = F.col("n_lists")
    out = entries.crossJoin(F.broadcast(t))  # one row
    return out.withColumn("tier", F.when(n >= F.col("t1"), 1).when(n >= F.col("t2"), 2).when(n >= F.col("t3"), 3)).drop("t1", "t2", "t3")


def tier_summary(entries: DataFrame) -> DataFrame:
    """tier, threshold, cumulative size, ratio to the first."""
    t = tiers(entries)
    cells = [F.struct(F.lit(i).alias("tier"), F.col(f"t{i}").alias("threshold"), F.col(f"n{i}").alias("cumulative_size"), F.round(F.col(f"n{i}") / F.col("n1"), 2).alias("size_ratio")) for i in (1, 2, 3)]
    return t.select(F.inline(F.array(*cells)))


def master(entries: DataFrame) -> DataFrame:
    """Rank by falling number of lists, then entry: entries of one count are ranked among themselves, counts by their sizes."""
    g = entries.groupBy("n_lists").agg(F.count(F.lit(1)).alias("k"))
    above = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("n_lists")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a count, at most one a list
    g = g.select("n_lists", above.alias("above"))
    return entries.join(F.broadcast(g), "n_lists").select("entry", "n_lists", (F.col("above") + F.row_number().over(Window.partitionBy("n_lists").orderBy("entry"))).alias("rank"))


def larger(lists: DataFrame) -> DataFrame:
    """Per list: smaller lists, the most similar of them (ties by name), its Jaccard, and what each has beyond the other."""
    sets = lists.groupBy("list_id").agg(F.collect_set("entry").alias("s"))
    b = sets.select(F.col("list_id").alias("smaller"), F.col("s").alias("t"))
    p = sets.join(F.broadcast(b), F.size("t") < F.size("s"), "left")  # lists are few, and each is a row
    shared = F.size(F.array_intersect("s", "t"))
    p = p.withColumn("j", shared / (F.size("s") + F.size("t") - shared)).withColumn("more", F.size(F.array_except("s", "t"))).withColumn("less", F.size(F.array_except("t", "s")))
    best = F.min(F.when(F.col("smaller").isNotNull(), F.struct(F.negative("j").alias("v"), "smaller", "more", "less"))).alias("x")
    g = p.groupBy("list_id").agg(F.max(F.size("s")).alias("size"), F.count("smaller").alias("n_smaller"), best)
    return g.select("list_id", "size", "n_smaller", F.col("x.smaller").alias("most_similar_smaller"), F.round(F.negative("x.v"), 4).alias("jaccard"), F.col("x.more").alias("n_beyond"), F.col("x.less").alias("n_lacking"))


def family_review(members: DataFrame, least: float = 0.5) -> DataFrame:
    """Per list: largest similarity within its family and outside, and what to look at."""
    p = pairwise(members.select("list_id", "entry"))
    j = p.select(F.col("list_a").alias("x"), F.col("list_b").alias("y"), "jaccard").unionByName(p.select(F.col("list_b").alias("x"), F.col("list_a").alias("y"), "jaccard"))
    fam = members.select("list_id", "family").distinct()
    j = j.join(fam.select(F.col("list_id").alias("y"), F.col("family").alias("fy")), "y")
    g = fam.join(j, F.col("list_id") == F.col("x"), "left").groupBy("list_id", "family").agg(
        F.max(F.when(F.col("fy") == F.col("family"), F.col("jaccard"))).alias("within"), F.max(F.when(F.col("fy") != F.col("family"), F.col("jaccard"))).alias("outside")
    )
    alone = F.col("within").isNull()
    flag = F.when(alone & (F.col("outside") >= least), "similar to another family").when(~alone & (F.col("outside") > F.col("within")), "closer to another family").when(~alone & (F.col("within") < least), "far from its family").otherwise("")
    return g.select("list_id", "family", F.round("within", 4).alias("within"), F.round("outside", 4).alias("outside"), flag.alias("flag"))


def coverage(lists: DataFrame, aggregate: str) -> DataFrame:
    """Per list: how much of it an aggregate list holds."""
    a = lists.where(F.col("list_id") == aggregate).select("entry", F.lit(True).alias("inside"))
    return lists.where(F.col("list_id") != aggregate).join(a, "entry", "left").groupBy("list_id").agg(
        F.count(F.lit(1)).alias("size"), F.count("inside").alias("n_inside"), F.round(F.count("inside") / F.count(F.lit(1)), 4).alias("share_inside")
    )


def subset_effect(members: DataFrame) -> DataFrame:
    """Per entry: lists that hold it, firm ones among them, rank shares by both, and whether it is left without a firm list."""
    n = members.groupBy("entry").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("firm").alias("n_firm"))
    a, b = by_count(n, "n_all"), by_count(n.where("n_firm > 0"), "n_firm")
    a = a.select("n_all", F.round((F.col("above") + 1) / F.col("rows"), 4).alias("share_all"))
    b = b.select("n_firm", F.round((F.col("above") + 1) / F.col("rows"), 4).alias("share_firm"))
    out = n.join(F.broadcast(a), "n_all").join(F.broadcast(b), "n_firm", "left")  # a row a count, at most one a list
    return out.select("entry", "n_all", "n_firm", (F.col("n_firm") == 0).alias("provisional_only"), "share_all", "share_firm", F.round(F.col("share_firm") - F.col("share_all"), 4).alias("change"))


def staircase(entries: DataFrame) -> DataFrame:
    """Per count of lists: entries, cumulative entries, whether it is a threshold, ratio to the first tier, and the objective if the widest tier were cut there."""
    g = entries.groupBy("n_lists").agg(F.count(F.lit(1)).alias("n_words"))
    run = F.sum("n_words").over(Window.orderBy(F.desc("n_lists")).rowsBetween(Window.unboundedPreceding, 0))  # a row a count, at most one a list
    t = tiers(entries).select("t1", "t2", "t3", F.col("n1").alias("s1"), F.col("n2").alias("s2"))
    out = g.withColumn("cumulative", run).crossJoin(F.broadcast(t))  # one row
    what_if = F.abs(F.ln(F.col("s2") / F.col("s1")) - F.ln(F.lit(2.0))) + F.abs(F.ln(F.col("cumulative") / F.col("s1")) - F.ln(F.lit(4.0)))
    return out.select(
        "n_lists", "n_words", "cumulative", F.col("n_lists").isin(F.col("t1"), F.col("t2"), F.col("t3")).alias("is_threshold"), F.round(F.col("cumulative") / F.col("s1"), 3).alias("ratio"),
        F.when((F.col("n_lists") < F.col("t2")) & (F.col("n_lists") >= 2), F.round(what_if, 6)).alias("objective_if_widest"),
    )


#: How well a link to a parent list is founded, from the weakest.
BASES = ["similarity", "near_identity", "exact_identity", "documented", "root"]


def lineage(links: DataFrame) -> DataFrame:
    """Per list: its root, links up to it, the weakest basis among them, and how much judgment that takes. links: list_id, parent (null for a root), basis.

    A chain that has no end is an error.
    """
    rank = F.array_position(F.array(*map(F.lit, BASES)), F.col("basis"))
    node = cut(links.withColumn("weakest", F.when(F.col("parent").isNull(), len(BASES)).otherwise(rank)))
    walk = node.select("list_id", F.col("parent").alias("at"), F.coalesce("parent", "list_id").alias("root"), F.col("parent").isNotNull().cast("int").alias("depth"), "weakest")
    for _ in range(node.count().bit_length() + 1):
        if walk.where("at IS NOT NULL").limit(1).count() == 0:
            break
        up = walk.select(F.col("list_id").alias("at"), F.col("at").alias("far"), F.col("root").alias("r"), F.col("depth").alias("more"), F.col("weakest").alias("w"))
        walk = cut(walk.join(up, "at", "left").select("list_id", F.col("far").alias("at"), F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.least("weakest", F.coalesce("w", "weakest")).alias("weakest")))
    else:
        raise ValueError("parents form a cycle")
    basis = F.element_at(F.array(*map(F.lit, BASES)), F.col("weakest").cast("int"))
    judgment = F.element_at(F.array(*map(F.lit, ["high", "medium", "low", "none", "none"])), F.col("weakest").cast("int"))
    return walk.select("list_id", "root", "depth", basis.alias("weakest_basis"), judgment.alias("judgment"))


def joined_by_average(distances: dict[tuple[str, str], float], names: list[str]) -> list[tuple[int, str, str, float, int]]:
    """(step, a, b, height, size) of average-linkage clustering; a cluster is named by its smallest member. For few lists."""
    size = dict.fromkeys(names, 1)
    d = {frozenset(k): v for k, v in distances.items()}
    out = []
    while len(size) > 1:
        pair = min(d, key=lambda k: (d[k], sorted(k)))
        a, b = sorted(pair)
        out.append((len(out) + 1, a, b, d.pop(pair), size[a] + size[b]))
        for c in size:
            if c not in pair:
                x, y = d.pop(frozenset((a, c))), d.pop(frozenset((b, c)))
                d[frozenset((a, c))] = (x * size[a] + y * size[b]) / (size[a] + size[b])
        size[a] += size.pop(b)
    return out


def hierarchy(lists: DataFrame) -> DataFrame:
    """Average linkage of few lists on 1 - Jaccard."""
    names = sorted(r[0] for r in lists.select("list_id").distinct().collect())
    near = {(r.list_a, r.list_b): 1 - r.jaccard for r in pairwise(lists).collect()}
    every = {(a, b): near.get((a, b), 1.0) for i, a in enumerate(names) for b in names[i + 1 :]}
    return lists.sparkSession.createDataFrame(joined_by_average(every, names), "step int, a string, b string, height double, size int")
