"""Reports over a fitted document-topic model: counts of (document, term, topic), and what follows from them.

``theta`` and ``phi`` are smoothed counts. phi holds observed (topic, term) cells alone; any other term has its topic's ``floor``.
"""

from __future__ import annotations

from functools import cached_property
from itertools import pairwise as neighbours

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, stored
from .sampling import ALPHA_SUM, BETA, fits, gibbs  # noqa: F401  fits are asked for here

SPLIT_SEED = 1


class Model:
    """The tables of a fit, made as they are asked for. docs: doc_id and cells (term, k, n), a row a document; it is read several times."""

    def __init__(self, docs: DataFrame, topics: int) -> None:
        self.k = topics
        self.docs = docs
        self.assigned = docs.select("doc_id", F.inline("cells"))
        self.topics = docs.sparkSession.range(topics).select(F.col("id").cast("int").alias("k"))

    @cached_property
    def shares(self) -> DataFrame:
        """doc_id, nd, shares: a row a document, its tokens and its smoothed share of each topic. Summed before the shuffle, as a document's cells are in one row."""
        alpha = ALPHA_SUM / self.k
        own = [F.coalesce(F.sum(F.when(F.col("k") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(self.k)]
        d = self.assigned.groupBy("doc_id").agg(F.sum("n").alias("nd"), *own)
        return stored(d.select("doc_id", "nd", F.array(*[(F.col(f"n{i}") + alpha) / (F.col("nd") + self.k * alpha) for i in range(self.k)]).alias("shares")), "shares")

    @cached_property
    def theta(self) -> DataFrame:
        return self.shares.select("doc_id", "nd", F.posexplode("shares").alias("k", "share")).select("doc_id", "k", "nd", "share")

    @cached_property
    def sums(self) -> DataFrame:
        """k, term, n."""
        return stored(self.assigned.groupBy("k", "term").agg(F.sum("n").alias("n")), "sums")

    @cached_property
    def mass(self) -> DataFrame:
        v = self.sums.agg(F.count_distinct("term").alias("v"))
        mass = self.topics.join(self.sums.groupBy("k").agg(F.sum("n").alias("nk")), "k", "left").crossJoin(F.broadcast(v))  # one row
        return cut(mass.select("k", F.coalesce("nk", F.lit(0)).alias("nk"), (F.coalesce("nk", F.lit(0)) + F.col("v") * BETA).alias("z")).withColumn("floor", BETA / F.col("z")))

    @cached_property
    def phi(self) -> DataFrame:
        return self.sums.join(F.broadcast(self.mass), "k").select("k", "term", "n", ((F.col("n") + BETA) / F.col("z")).alias("p"), "floor")  # a row a topic

    def terms(self) -> DataFrame:
        return self.sums.groupBy("term").agg(F.sum("n").alias("n"))

    def wide(self, prefix: str = "p") -> DataFrame:
        """A row a term: its probability in each topic."""
        floors = {r.k: r.floor for r in self.mass.collect()}  # topics are few
        w = self.phi.groupBy("term").agg(*[F.max(F.when(F.col("k") == i, F.col("p"))).alias(f"x{i}") for i in range(self.k)])
        return w.select("term", *[F.coalesce(f"x{i}", F.lit(floors[i])).alias(f"{prefix}{i}") for i in range(self.k)])


#: Terms whose probabilities every executor holds: the most frequent, which most tokens are of. Others are joined.
FREQUENT = 100_000


def perplexity(m: Model) -> DataFrame:
    """loglik, tokens, perplexity over all cells: sum of n ln(sum over k of theta phi). A cell carries its document's shares, so cells of frequent terms do not move."""
    n = m.terms().orderBy(F.desc("n"), "term").limit(FREQUENT)
    wide = stored(m.wide().join(n.select("term", F.lit(True).alias("often")), "term", "left"), "wide")
    cells = m.docs.join(m.shares.select("doc_id", "shares"), "doc_id").select("shares", F.inline("cells"))
    p = sum(F.col("shares")[i] * F.col(f"p{i}") for i in range(m.k))
    here = cells.join(F.broadcast(wide.where("often").drop("often")), "term", "left").withColumn("ln", F.ln(p))
    rare = lambda c: F.when(F.col("p0").isNull(), F.col(c)).alias(c)
    # one row for the cells of frequent terms, the others as they are
    few = here.select(rare("term"), rare("shares"), rare("n").alias("each"), "n", "ln").groupBy("term", "shares", "each").agg(F.sum(F.col("n") * F.col("ln")).alias("often"), F.sum("n").alias("n"))
    few = few.join(wide.where("often IS NULL").drop("often"), "term", "left")
    s = few.agg(F.sum(F.coalesce("often", F.col("n") * F.ln(p))).alias("ll"), F.sum("n").alias("tokens"))
    return s.select(F.round("ll", 3).alias("loglik"), "tokens", F.round(F.exp(-F.col("ll") / F.col("tokens")), 6).alias("perplexity"))


def ranked_words(m: Model, most: int, weight: float = 1.0) -> DataFrame:
    """k, rank, term, score: by probability (weight 1) or by relevance, weight ln p + (1 - weight) ln(p / share of the term)."""
    if weight == 1:  # the share of the term has no part in it
        s = m.phi.select("k", "term", "p", F.round(F.ln("p"), 9).alias("score"))
    else:
        total = m.mass.agg(F.sum("nk").alias("total"))
        t = m.terms().crossJoin(F.broadcast(total)).select("term", (F.col("n") / F.col("total")).alias("pw"))  # one row
        score = weight * F.ln("p") + (1 - weight) * F.ln(F.col("p") / F.col("pw"))
        s = m.phi.join(t, "term").select("k", "term", "p", F.round(score, 9).alias("score"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), "term"))).where(F.col("rank") <= most)
    return r.select("k", "rank", "term", "score", "p")


def coherence(m: Model, most: int = 10) -> DataFrame:
    """k, umass, npmi over the pairs of the top words, from the documents that hold them: these are counted by which top words of a topic they hold, so that pairs are made once."""
    top = cut(ranked_words(m, most).select("k", "rank", "term"))
    words: dict[int, list[tuple[int, str]]] = {}
    for r in top.collect():  # topics x most words
        words.setdefault(r.k, []).append((r.rank, r.term))
    every = sorted({w for ws in words.values() for _, w in ws})
    held = m.docs.select(F.array_intersect(F.transform("cells", lambda c: c["term"]), F.array(*map(F.lit, every)).cast("array<string>")).alias("held"))
    bit = lambda rank, w: F.when(F.array_contains("held", w), 1 << rank).otherwise(0)
    masks = [F.struct(F.lit(k).alias("k"), sum((bit(rank, w) for rank, w in ws), F.lit(0)).cast("long").alias("mask")) for k, ws in sorted(words.items())]
    g = cut(held.select(F.inline(F.array(*masks) if masks else F.expr("CAST(array() AS array<struct<k: int, mask: bigint>>)"))).groupBy("k", "mask").agg(F.count(F.lit(1)).alias("docs")))
    a, b = top.select("k", F.col("rank").alias("ra")), top.select("k", F.col("rank").alias("rb"))
    has = lambda c: F.expr(f"(shiftright(mask, {c}) & 1) = 1")
    of = lambda x: F.coalesce(F.sum(F.when(x, F.col("docs"))), F.lit(0))
    p = a.join(b, "k").where("ra > rb").join(g, "k").groupBy("k", "ra", "rb").agg(of(has("ra") & has("rb")).alias("both"), of(has("ra")).alias("da"), of(has("rb")).alias("db"), F.sum("docs").alias("docs"))
    n, d = F.col("both"), F.col("docs")
    npmi = F.when(n == 0, -1.0).when(n >= d, 1.0).otherwise(F.ln((n / d) / ((F.col("da") / d) * (F.col("db") / d))) / -F.ln(n / d))
    return p.groupBy("k").agg(F.round(F.avg(F.ln((n + 1) / F.col("db"))), 6).alias("umass"), F.round(F.avg(npmi), 6).alias("npmi"))


def exclusivity(m: Model, most: int = 10) -> DataFrame:
    """k, mean share of the top words' probability that the topic holds."""
    floors, top = m.mass.agg(F.sum("floor").alias("floors")), cut(ranked_words(m, most))
    asked = F.broadcast(top.select("term").distinct())  # topics x most words
    every = m.phi.join(asked, "term").groupBy("term").agg(F.sum(F.col("p") - F.col("floor")).alias("more")).crossJoin(F.broadcast(floors)).select("term", (F.col("more") + F.col("floors")).alias("every"))  # one row
    return top.join(every, "term").groupBy("k").agg(F.round(F.avg(F.col("p") / F.col("every")), 6).alias("exclusivity"))


def word_pairs(m: Model) -> DataFrame:
    """a, b (topics, a < b), cosine and symmetric KL of their word distributions; one pass over terms."""
    ks = [(a, b) for a in range(m.k) for b in range(a + 1, m.k)]
    p = lambda i: F.col(f"p{i}")
    sums = [F.sum(p(a) * p(b)).alias(f"d{a}_{b}") for a, b in ks] + [F.sum(p(i) * p(i)).alias(f"s{i}") for i in range(m.k)]
    sums += [F.sum((p(a) - p(b)) * (F.ln(p(a)) - F.ln(p(b))) / 2).alias(f"l{a}_{b}") for a, b in ks]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"d{a}_{b}") / F.sqrt(F.col(f"s{a}") * F.col(f"s{b}")), 6).alias("cosine"), F.round(f"l{a}_{b}", 6).alias("symmetric_kl")) for a, b in ks]
    return m.wide().agg(*sums).select(F.inline(F.array(*cells)))


def arun(m: Model) -> float:
    """Divergence of the singular values of phi (from its Gram matrix, topics x topics) and the topics' shares."""
    row = m.wide().agg(*[F.sum(F.col(f"p{a}") * F.col(f"p{b}")).alias(f"g{a}_{b}") for a in range(m.k) for b in range(m.k)]).first()
    gram = np.array([[row[f"g{a}_{b}"] for b in range(m.k)] for a in range(m.k)])
    x = np.sqrt(np.maximum(np.linalg.eigvalsh(gram)[::-1], 1e-300))
    y = np.array([r.nk for r in m.mass.orderBy("k").collect()], float)
    x, y = x / x.sum(), np.maximum(y / y.sum(), 1e-300)
    return float((x * np.log(x / y)).sum() + (y * np.log(y / x)).sum())


def across(m: Model, other: Model) -> DataFrame:
    """a (topic of m), b (of the other), cosine of their word distributions; terms of both vocabularies."""
    both = m.wide("p").join(other.wide("q"), "term")
    sums = [F.sum(F.col(f"p{a}") * F.col(f"q{b}")).alias(f"d{a}_{b}") for a in range(m.k) for b in range(other.k)]
    sums += [F.sum(F.col(f"p{a}") ** 2).alias(f"s{a}") for a in range(m.k)] + [F.sum(F.col(f"q{b}") ** 2).alias(f"t{b}") for b in range(other.k)]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"d{a}_{b}") / F.sqrt(F.col(f"s{a}") * F.col(f"t{b}")), 6).alias("cosine")) for a in range(m.k) for b in range(other.k)]
    return both.agg(*sums).select(F.inline(F.array(*cells)))


def correspondence(pairs: DataFrame) -> DataFrame:
    """Per topic a: best and second-best b, whether the choice is mutual, counterparts at 0.5, 0.7, 0.8, and a class. Topics are few."""
    w, v = Window.partitionBy("a").orderBy(F.desc("cosine"), "b"), Window.partitionBy("b").orderBy(F.desc("cosine"), "a")
    r = pairs.withColumn("ra", F.row_number().over(w)).withColumn("rb", F.row_number().over(v))
    first = F.col("ra") == 1
    g = r.groupBy("a").agg(
        F.max(F.when(first, F.col("b"))).alias("best"), F.max(F.when(first, F.col("cosine"))).alias("best_cosine"), F.max(F.when(F.col("ra") == 2, F.col("cosine"))).alias("second_cosine"),
        F.bool_or(first & (F.col("rb") == 1)).alias("mutual"), *[F.count_if(F.col("cosine") >= t / 10).alias(f"n_0{t}") for t in (5, 7, 8)],
    )
    clear = F.col("best_cosine") >= 0.8
    label = F.when(F.col("n_05") == 0, "none").when((F.col("n_05") == 1) & clear, "one, clear").when(F.col("n_05") == 1, "one, moderate").when(clear, "split, one clear").otherwise("split, moderate")
    return g.withColumn("class", label)


def shared_top_words(m: Model, other: Model, most: int = 20) -> DataFrame:
    """a, b, Jaccard of the top words."""
    tops = [x.groupBy("k").agg(F.collect_set("term").alias("w")) for x in (ranked_words(m, most), ranked_words(other, most))]
    x, y = tops[0].select(F.col("k").alias("a"), F.col("w").alias("x")), tops[1].select(F.col("k").alias("b"), F.col("w").alias("y"))
    return x.crossJoin(F.broadcast(y)).select("a", "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))  # topics x topics


def dominant(m: Model) -> DataFrame:
    """doc_id, nd, k, share: the topic of the largest share, ties to the first; within rows."""
    best = F.array_max("shares")
    return m.shares.select("doc_id", "nd", (F.array_position("shares", best) - 1).cast("int").alias("k"), best.alias("share"), F.size(F.filter("shares", lambda s: s >= 0.1)).cast("long").alias("n_active"))


def prevalence(m: Model, docs: DataFrame, by: str) -> DataFrame:
    """Token-weighted share of each topic by a field of the documents, and over all (null)."""
    w = m.theta.join(docs.select("doc_id", F.col(by).alias("group")), "doc_id").select("k", F.col("group"), "nd", (F.col("share") * F.col("nd")).alias("w"))
    one = w.groupBy("group", "k").agg(F.sum("w").alias("w"), F.sum("nd").alias("n"), F.count(F.lit(1)).alias("docs"))
    all_ = w.groupBy("k").agg(F.sum("w").alias("w"), F.sum("nd").alias("n"), F.count(F.lit(1)).alias("docs")).withColumn("group", F.lit("all"))
    return one.unionByName(all_).select("group", "k", "docs", F.round(F.col("w") / F.col("n"), 9).alias("token_share"))


def renumbered(m: Model) -> DataFrame:
    """k, token_share, topic: numbers from 1 by falling share, ties by k."""
    s = m.theta.groupBy("k").agg((F.sum(F.col("share") * F.col("nd")) / F.sum("nd")).alias("s")).select("k", F.round("s", 9).alias("token_share"))
    return s.withColumn("topic", F.row_number().over(Window.orderBy(F.desc("token_share"), "k")).cast("long"))  # topics are few


BANDS = [(1, "1"), (4, "2-4"), (9, "5-9"), (24, "10-24"), (49, "25-49"), (99, "50-99")]


def token_band(n: Column) -> Column:
    out = None
    for top, label in BANDS:
        out = F.when(n <= top, label) if out is None else out.when(n <= top, label)
    return F.when(n >= 1, out.otherwise("100+"))


def share_bins(m: Model) -> DataFrame:
    """Documents by length band and by bin of the dominant topic's share (0.05 wide, the last open)."""
    d = dominant(m).select(token_band(F.col("nd")).alias("band"), F.least(F.floor(F.round(F.col("share"), 9) / 0.05), F.lit(19)).cast("int").alias("bin"), "n_active")
    return d.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("n_active"), 6).alias("mean_active"))


def together(m: Model, least: float = 0.1) -> DataFrame:
    """a, b: correlation of two topics' shares over documents, and the share of documents in which both are active."""
    wide = m.theta.groupBy("doc_id").agg(*[F.max(F.when(F.col("k") == i, F.col("share"))).alias(f"s{i}") for i in range(m.k)])
    ks = [(a, b) for a in range(m.k) for b in range(a + 1, m.k)]
    s = lambda i: F.col(f"s{i}")
    row = wide.agg(F.count(F.lit(1)).alias("n"), *[F.corr(s(a), s(b)).alias(f"c{a}_{b}") for a, b in ks], *[F.count_if((s(a) >= least) & (s(b) >= least)).alias(f"t{a}_{b}") for a, b in ks])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{a}_{b}", 6).alias("correlation"), F.round(F.col(f"t{a}_{b}") / F.col("n"), 9).alias("co_active")) for a, b in ks])))


def crosstab(m: Model, other: Model) -> DataFrame:
    """Documents by their dominant topics in two fits, with row and column shares."""
    d = dominant(m).select("doc_id", F.col("k").alias("a")).join(dominant(other).select("doc_id", F.col("k").alias("b")), "doc_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    share = lambda c: F.round(F.col("n") / F.sum("n").over(Window.partitionBy(c)), 9)
    return d.select("a", "b", "n", share("a").alias("row_share"), share("b").alias("column_share"))  # topics x topics


def narrowness(m: Model, docs: DataFrame, form: Column, author: str) -> DataFrame:
    """Per dominant topic: documents, distinct texts and authors, share of documents whose text repeats, size of the commonest text."""
    d = dominant(m).select("doc_id", "k", "share").join(docs.select("doc_id", form.alias("form"), F.col(author).alias("author")), "doc_id")
    t = d.groupBy("k", "form").agg(F.count(F.lit(1)).alias("n"))
    texts = t.groupBy("k").agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("distinct_texts"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"), F.max("n").alias("largest"))
    authors = d.groupBy("k").agg(F.count_distinct("author").alias("distinct_authors"), F.count_if(F.col("share") >= 0.5).alias("at_least_half"))
    return texts.join(authors, "k").select("k", "docs", "distinct_texts", F.round(F.col("repeated") / F.col("docs"), 9).alias("repeated_share"), "largest", "distinct_authors", "at_least_half")


def term_terms(m: Model, terms: list[str]) -> DataFrame:
    """Chosen terms: whether the vocabulary has them, their topic of largest probability and its share of the term's mass."""
    ask = m.docs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    floors = m.mass.agg(F.sum("floor").alias("floors"))
    best = F.max(F.struct("p", F.negative("k").alias("m"))).alias("x")
    g = m.phi.join(F.broadcast(ask), "term").groupBy("term").agg(best, F.sum(F.col("p") - F.col("floor")).alias("more")).crossJoin(F.broadcast(floors))  # one row
    g = g.select("term", F.negative("x.m").alias("top_topic"), F.round(F.col("x.p") / (F.col("more") + F.col("floors")), 6).alias("share_of_mass"))
    return ask.join(g, "term", "left").select("term", F.col("top_topic").isNotNull().alias("in_vocabulary"), "top_topic", "share_of_mass")


# --- splits -------------------------------------------------------------------------


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else F.lit(str(p)) for p in parts]))


def held_out(sizes: DataFrame, share: float = 0.05, seed: int = SPLIT_SEED) -> DataFrame:
    """doc_id, split: floor(share * documents) of those with two tokens or more are held out, the first in a hash order."""
    total = int(np.floor(share * sizes.count()))
    chosen = sizes.where("n >= 2").select("doc_id").orderBy(_hash("doc_id", seed), "doc_id").limit(total).withColumn("split", F.lit("held-out"))
    return sizes.select("doc_id").join(chosen, "doc_id", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


def halves(cells: DataFrame, seed: int = SPLIT_SEED + 1) -> DataFrame:
    """doc_id, term, n_a, n_b: each document's token occurrences in a hash order, dealt to two halves in turn."""
    one = cells.select("doc_id", "term", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(_hash("doc_id", "term", "i", seed), "term", "i"))
    return one.withColumn("place", place).groupBy("doc_id", "term").agg(F.count_if(F.col("place") % 2 == 1).alias("n_a"), F.count_if(F.col("place") % 2 == 0).alias("n_b"))


def assignment(gain: np.ndarray) -> list[int]:
    """The column for each row that makes the sum of a square matrix largest (Hungarian method by shortest augmenting paths)."""
    n = len(gain)
    cost = gain.max(initial=0) - gain
    row, column, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j] = True
            free = np.flatnonzero(~used)
            slack = cost[match[j] - 1, free - 1] - row[match[j]] - column[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j
            nxt = free[least[free].argmin()]
            delta = least[nxt]
            row[match[used]] += delta
            column[used] -= delta
            least[~used] -= delta
            j = int(nxt)
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], int(way[j])
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def matched(m: Model, other: Model) -> DataFrame:
    """topic_a, topic_b, cosine of the one-to-one matching with the largest sum of cosines, and whether each is its row's best."""
    got = across(m, other).collect()
    c = np.zeros((m.k, other.k))
    for r in got:
        c[r.a, r.b] = r.cosine
    to = assignment(c)
    rows = [(a, b, float(c[a, b]), bool(c[a, b] >= c[a].max())) for a, b in enumerate(to)]
    return m.docs.sparkSession.createDataFrame(rows, "topic_a int, topic_b int, cosine double, is_row_best boolean")


def compared(fits: DataFrame) -> DataFrame:
    """Per number of topics: means over seeds, ranks with averaged ties, composite rank, the choices that are retained and why. fits: topics, seed, perplexity, npmi, exclusivity, cosine."""
    g = fits.groupBy("topics").agg(F.count(F.lit(1)).alias("n_fits"), *[F.avg(c).alias(c) for c in ("perplexity", "npmi", "exclusivity", "cosine")], F.coalesce(F.stddev_samp("perplexity"), F.lit(0.0)).alias("sd"))
    ranks = {}
    for c, order in (("perplexity", F.asc), ("npmi", F.desc), ("exclusivity", F.desc), ("cosine", F.desc)):
        w = Window.orderBy(order(c))  # a row a number of topics
        ranks[c] = F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    g = g.withColumn("composite", sum(ranks.values()) / 4)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.min(F.struct("perplexity", "topics", "sd")).over(every)
    g = g.withColumn("limit", best["perplexity"] + best["sd"])
    g = g.withColumn("within", F.col("perplexity") <= F.col("limit"))
    first = F.min(F.struct("composite", "topics")).over(every)["topics"]
    coherent = F.min(F.struct(F.negative("npmi").alias("v"), "topics")).over(every)["topics"]
    smallest = F.min(F.when(F.col("within"), F.col("topics"))).over(every)
    why = F.concat_ws("; ", F.when(F.col("topics") == first, "composite rank"), F.when(F.col("topics") == coherent, "coherence"), F.when(F.col("topics") == smallest, "one standard error"))
    return g.withColumn("basis", why).select("topics", "n_fits", *[F.round(c, 6).alias(c) for c in ("perplexity", "npmi", "exclusivity", "cosine", "composite")], "within", (F.col("basis") != "").alias("retained"), "basis")


def planned_chunks(now: int, ceiling: int, chunk: int) -> list[int]:
    """Iterations at which a continued fit stops: every ``chunk``, and at the ceiling."""
    return [*range(now + max(1, chunk), ceiling, max(1, chunk)), ceiling] if now < ceiling else []


def spline_basis_at(x: np.ndarray, low: float, high: float, inner: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-spline basis with given inner knots; rows sum to 1 from low to high."""
    t = np.concatenate([[low] * (degree + 1), inner, [high] * (degree + 1)])
    y = np.minimum(x, high)
    b = np.stack([((y >= a) & (y < c) | ((y == high) & (c == high) & (a < c))).astype(float) for a, c in neighbours(t)], 1)
    for d in range(1, degree + 1):
        parts = []
        for i in range(len(t) - d - 1):
            left = (y - t[i]) / (t[i + d] - t[i]) * b[:, i] if t[i + d] > t[i] else np.zeros(len(y))
            right = (t[i + d + 1] - y) / (t[i + d + 1] - t[i + 1]) * b[:, i + 1] if t[i + d + 1] > t[i + 1] else np.zeros(len(y))
            parts.append(left + right)
        b = np.stack(parts, 1)
    return b
