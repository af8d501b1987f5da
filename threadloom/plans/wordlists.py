"""Word lists: normal forms, classes, relations, consensus, tiers and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists
from ..operators.reports import rows
from ..sources import adapters as ad
from ..sources.scratch import cut
from .base import query

CLASSES = ["word", "multiword", "hyphenated", "apostrophe", "numeric", "alphanumeric", "punctuation_or_symbol", "other_characters"]
CONSENSUS = ad.MEMBERS + """, e AS (SELECT entry, count(*) AS n_lists FROM members GROUP BY 1), v AS (SELECT n_lists AS t, count(*) AS k FROM e WHERE n_lists >= 2 GROUP BY 1), d AS (SELECT a.t, sum(b.k)::BIGINT AS size FROM v a JOIN v b ON b.t >= a.t GROUP BY 1),
th AS (SELECT x.t AS t1, x.size AS n1, y.t AS t2, y.size AS n2, z.t AS t3, z.size AS n3 FROM d x JOIN d y ON x.t > y.t JOIN d z ON y.t > z.t
  ORDER BY round(abs(ln(y.size / x.size) - ln(2)) + abs(ln(z.size / x.size) - ln(4)), 9), x.t DESC, y.t DESC, z.t DESC LIMIT 1)"""
PAIRS = ad.MEMBERS + """, s AS (SELECT list_id, family, count(*) AS n FROM members GROUP BY 1, 2), sh AS (SELECT x.list_id AS a, y.list_id AS b, count(*) AS shared FROM members x JOIN members y ON x.entry = y.entry AND x.list_id <> y.list_id GROUP BY 1, 2),
pj AS (SELECT a, b, p.family AS fa, q.family AS fb, p.n AS na, q.n AS nb, shared, shared / (p.n + q.n - shared) AS j FROM sh JOIN s p ON p.list_id = a JOIN s q ON q.list_id = b)"""


def _entries(spark):
    return lists.normalised(ad.raw_lists(spark))


def _members(spark, sf):
    return cut(ad.members(spark, sf))


@query(f"WITH {ad.NORMAL} SELECT * FROM entries")
def t26_normalised_entries(spark, sf):
    return _entries(spark)


@query(f"WITH {ad.NORMAL} SELECT list_id, entry, entry_class FROM classed")
def t27_entry_classes(spark, sf):
    return lists.kept(_entries(spark)).select("list_id", "entry", "entry_class")


@query(f"WITH {ad.NORMAL} SELECT DISTINCT list_id, replace(entry, '''', '') AS plain, regexp_full_match(replace(entry, '''', ''), '[a-z]+') AS is_word FROM classed")
def t28_further_normal_forms(spark, sf):
    plain = F.replace("entry", F.lit("'"), F.lit(""))
    return lists.kept(_entries(spark)).select("list_id", plain.alias("plain"), plain.rlike("^[a-z]+$").alias("is_word")).distinct()


@query(rf"""WITH {ad.NORMAL} SELECT list_id, entry, CASE WHEN NOT regexp_full_match(entry, '\p{{L}}+(?:''\p{{L}}+)*') THEN 'no: other characters' WHEN ends_with(entry, '''s') THEN 'no: possessive' WHEN length(entry) < 2 THEN 'yes, but too short' ELSE 'yes' END AS producible FROM classed""")
def t29_producible_entries(spark, sf):
    return lists.kept(_entries(spark)).select("list_id", "entry", lists.producible(F.col("entry")).alias("producible"))


@query(f"""WITH {ad.NORMAL}, a AS (SELECT list_id, count(*) AS n_raw, count(*) FILTER (dropped = '') AS n_unique, count(*) FILTER (dropped = 'duplicate_within_list') AS n_duplicates, count(*) FILTER (contains(changes, 'case')) AS n_case_changed,
  count(*) FILTER (contains(changes, 'apostrophe')) AS n_apostrophe_changed, count(*) FILTER (contains(changes, 'trim')) AS n_trim_changed FROM entries GROUP BY 1) SELECT a.*, """
       + ", ".join(f"(SELECT count(*) FROM classed c WHERE c.list_id = a.list_id AND entry_class = '{c}') AS n_{c}" for c in CLASSES) + " FROM a")
def k01_list_summary(spark, sf):
    return lists.list_summary(_entries(spark), CLASSES)


SETS = ad.NORMAL + ", sets AS (SELECT list_id, list(DISTINCT entry) AS s FROM classed GROUP BY 1)"


@query(f"""WITH {SETS}, p AS (SELECT a.list_id AS list_a, b.list_id AS list_b, a.s AS sa, b.s AS sb, len(list_intersect(a.s, b.s)) AS x FROM sets a JOIN sets b ON a.list_id < b.list_id)
SELECT list_a, list_b, len(sa)::INTEGER AS size_a, len(sb)::INTEGER AS size_b, x::INTEGER AS shared, round(x / (len(sa) + len(sb) - x), 4) AS jaccard,
  CASE WHEN x = len(sa) AND x = len(sb) THEN 'identical' WHEN x = len(sa) THEN 'a_subset_of_b' WHEN x = len(sb) THEN 'b_subset_of_a' WHEN x / (len(sa) + len(sb) - x) >= 0.9 THEN 'near_duplicate' ELSE 'distinct' END AS relation,
  array_to_string(list_sort(list_filter(sa, lambda e: NOT list_contains(sb, e))), ' ') AS only_in_a, array_to_string(list_sort(list_filter(sb, lambda e: NOT list_contains(sa, e))), ' ') AS only_in_b FROM p""")
def k02_claimed_equalities(spark, sf):
    return lists.relations(lists.kept(_entries(spark)))


@query(f"""WITH {SETS} SELECT a.list_id AS list_a, b.list_id AS list_b, CASE WHEN len(list_intersect(a.s, b.s)) = len(a.s) AND len(a.s) = len(b.s) THEN 'identical' WHEN len(list_intersect(a.s, b.s)) = len(a.s) THEN 'a_subset_of_b'
  WHEN len(list_intersect(a.s, b.s)) = len(b.s) THEN 'b_subset_of_a' WHEN len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.9 THEN 'near_duplicate' ELSE 'distinct' END AS relation
FROM sets a JOIN sets b ON a.list_id < b.list_id""")
def x05_set_relations(spark, sf):
    return lists.relations(lists.kept(_entries(spark))).select("list_a", "list_b", "relation")


@query(f"""WITH {ad.NORMAL}, l AS (SELECT list_id, list(raw_entry ORDER BY position) AS seq, list(raw_entry ORDER BY raw_entry) AS bag, list_sort(list(DISTINCT raw_entry)) AS rs FROM entries GROUP BY 1),
n AS (SELECT list_id, list_sort(list(DISTINCT entry)) AS norm, list_sort(list(DISTINCT replace(entry, '''', ''))) AS plain, list_sort(coalesce(list(DISTINCT entry) FILTER (regexp_full_match(entry, '[a-z]+')), [])) AS words FROM classed GROUP BY 1), s AS (SELECT * FROM l JOIN n USING (list_id))
SELECT a.list_id AS list_a, b.list_id AS list_b, a.seq = b.seq AS raw_sequence, a.bag = b.bag AS raw_multiset, a.rs = b.rs AS raw_set, a.norm = b.norm AS normalised_set, a.plain = b.plain AS without_apostrophes, a.words = b.words AS words_only FROM s a JOIN s b ON a.list_id < b.list_id""")
def k15_equality_levels(spark, sf):
    return lists.equality_levels(_entries(spark))


CHAIN = ["small", "epsilon", "beta"]


@query(f"""WITH {SETS}, c AS (SELECT list_position({CHAIN!r}, list_id)::INTEGER AS step, list_id, s, lag(s) OVER w AS b, lead(s) OVER w AS a FROM sets WHERE list_id IN ('small', 'epsilon', 'beta') WINDOW w AS (ORDER BY list_position({CHAIN!r}, list_id)))
SELECT step, list_id, len(s)::INTEGER AS n, len(list_filter(s, lambda e: NOT list_contains(coalesce(b, []), e)))::INTEGER AS added, CASE WHEN b IS NOT NULL THEN len(list_filter(b, lambda e: NOT list_contains(s, e)))::INTEGER END AS removed,
  CASE WHEN a IS NOT NULL THEN len(list_filter(s, lambda e: NOT list_contains(a, e))) = 0 END AS subset_of_next FROM c""")
def x07_nested_snapshots(spark, sf):
    return lists.nested(lists.kept(_entries(spark)), CHAIN)


@query(f"""WITH {SETS} SELECT a.list_id AS list_a, b.list_id AS list_b FROM sets a JOIN sets b ON a.list_id < b.list_id""")
def j16_all_pairs_of_lists(spark, sf):
    return lists.relations(lists.kept(_entries(spark))).select("list_a", "list_b")


@query(f"""WITH {ad.MEMBERS}, h AS (SELECT list_id, family, md5(string_agg(entry, chr(10) ORDER BY entry)) AS x FROM members GROUP BY 1, 2), r AS (SELECT min(list_id) AS list_id FROM h GROUP BY x), f AS (SELECT family, count(*) AS m FROM h GROUP BY 1),
b AS (SELECT entry, family, count(*) AS n, count(*) FILTER (list_id IN (SELECT list_id FROM r)) AS d, count(*) FILTER (is_root) AS k FROM members GROUP BY 1, 2)
SELECT entry, sum(n)::BIGINT AS n_lists, sum(d)::BIGINT AS n_distinct_lists, count(*) AS n_families_any, count(*) FILTER (n = m) AS n_families_all, sum(k)::BIGINT AS n_family_roots, string_agg(family, ';' ORDER BY family) AS families_any,
  coalesce(string_agg(family, ';' ORDER BY family) FILTER (n = m), '') AS families_all FROM b JOIN f USING (family) GROUP BY 1""")
def a40_word_stats(spark, sf):
    return lists.word_stats(_members(spark, sf))


@query(f"WITH {ad.MEMBERS} SELECT entry, string_agg(DISTINCT family, ';' ORDER BY family) AS families FROM members GROUP BY 1")
def a41_family_strings(spark, sf):
    return ad.members(spark, sf).groupBy("entry").agg(F.array_join(F.array_sort(F.collect_set("family")), ";").alias("families"))


def _counts(spark, sf):
    return cut(_members(spark, sf).groupBy("entry").agg(rows().alias("n_lists")))


@query(f"WITH {CONSENSUS} SELECT entry, n_lists, CASE WHEN n_lists >= t1 THEN 1 WHEN n_lists >= t2 THEN 2 WHEN n_lists >= t3 THEN 3 END::INTEGER AS tier FROM e LEFT JOIN th ON true")
def k05_tiers(spark, sf):
    return lists.tiered(_counts(spark, sf))


@query(f"WITH {CONSENSUS} SELECT unnest([1, 2, 3])::INTEGER AS tier, unnest([t1, t2, t3]) AS threshold, unnest([n1, n2, n3]) AS cumulative_size, unnest([1.0, round(n2 / n1, 2), round(n3 / n1, 2)])::DOUBLE AS size_ratio FROM th")
def k05_tier_summary(spark, sf):
    return lists.tier_summary(_counts(spark, sf))


@query(f"WITH {CONSENSUS} SELECT entry, n_lists, row_number() OVER (ORDER BY n_lists DESC, entry) AS rank FROM e")
def k06_master_order(spark, sf):
    return lists.master(_counts(spark, sf))


@query(f"""WITH {PAIRS}, b AS (SELECT a, b, j, na - shared AS more, nb - shared AS less, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS rn FROM pj WHERE nb < na)
SELECT s.list_id, s.n::INTEGER AS size, (SELECT count(*) FROM s o WHERE o.n < s.n) AS n_smaller, b.b AS most_similar_smaller, round(j, 4) AS jaccard, more::INTEGER AS n_beyond, less::INTEGER AS n_lacking FROM s LEFT JOIN b ON b.a = s.list_id AND rn = 1""")
def k08_larger_lists(spark, sf):
    return lists.larger(_members(spark, sf).select("list_id", "entry"))


@query("")
def k09_hierarchy(spark, sf):
    return lists.hierarchy(_members(spark, sf).select("list_id", "entry"))


@query(f"""WITH {PAIRS}, g AS (SELECT s.list_id, s.family, max(j) FILTER (fb = fa) AS w, max(j) FILTER (fb <> fa) AS o FROM s LEFT JOIN pj ON pj.a = s.list_id GROUP BY 1, 2), h AS (SELECT list_id, family, round(w, 9) AS w, round(o, 9) AS o FROM g)
SELECT list_id, family, round(w, 4) AS within, round(o, 4) AS outside, CASE WHEN w IS NULL AND o >= 0.5 THEN 'similar to another family' WHEN w IS NOT NULL AND o > w THEN 'closer to another family' WHEN w IS NOT NULL AND w < 0.5 THEN 'far from its family' ELSE '' END AS flag FROM h""")
def k10_family_review(spark, sf):
    return lists.family_review(_members(spark, sf))


@query(f"WITH {ad.MEMBERS} SELECT list_id, count(*) AS size, count(*) FILTER (entry IN (SELECT entry FROM members WHERE list_id = 'src0')) AS n_inside, round(count(*) FILTER (entry IN (SELECT entry FROM members WHERE list_id = 'src0')) / count(*), 4) AS share_inside FROM members WHERE list_id <> 'src0' GROUP BY 1")
def k11_aggregate_coverage(spark, sf):
    return lists.coverage(_members(spark, sf).select("list_id", "entry"), "src0")


@query(f"""WITH {ad.MEMBERS}, n AS (SELECT entry, count(*) AS n_all, count(*) FILTER (firm) AS n_firm FROM members GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY n_all DESC) AS ra, count(*) OVER () AS ca FROM n),
f AS (SELECT entry, rank() OVER (ORDER BY n_firm DESC) AS rf, count(*) OVER () AS cf FROM n WHERE n_firm > 0)
SELECT entry, n_all, n_firm, n_firm = 0 AS provisional_only, round(ra / ca, 4) AS share_all, round(rf / cf, 4) AS share_firm, round(round(rf / cf, 4) - round(ra / ca, 4), 4) AS change FROM r LEFT JOIN f USING (entry)""")
def k12_subset_effect(spark, sf):
    return lists.subset_effect(_members(spark, sf))


@query(f"""WITH {CONSENSUS}, g AS (SELECT n_lists, count(*) AS n_words FROM e GROUP BY 1), c AS (SELECT *, (sum(n_words) OVER (ORDER BY n_lists DESC))::BIGINT AS cumulative FROM g)
SELECT n_lists, n_words, cumulative, n_lists IN (t1, t2, t3) AS is_threshold, round(cumulative / n1, 3) AS ratio, CASE WHEN n_lists < t2 AND n_lists >= 2 THEN round(abs(ln(n2 / n1) - ln(2)) + abs(ln(cumulative / n1) - ln(4)), 6) END AS objective_if_widest FROM c, th""")
def k13_staircase(spark, sf):
    return lists.staircase(_counts(spark, sf))


#: A small register of list parents, with the basis of each link.
LINKS = [("a", None, "root"), ("b", "a", "documented"), ("c", "b", "near_identity"), ("d", "c", "documented"), ("e", "a", "exact_identity"), ("f", "e", "similarity"), ("g", None, "root"), ("h", "g", "documented")]


@query(f"""WITH RECURSIVE l AS (SELECT * FROM ({ad.values_sql(LINKS)}) AS t(list_id, parent, basis)), w(list_id, top, up, depth, weakest) AS (SELECT list_id, list_id, parent, 0, 5 FROM l
UNION ALL SELECT w.list_id, l.list_id, l.parent, depth + 1, least(weakest, list_position({lists.BASES!r}, (SELECT basis FROM l x WHERE x.list_id = w.top))) FROM w JOIN l ON l.list_id = w.up)
SELECT list_id, top AS root, depth::INTEGER AS depth, {lists.BASES!r}[weakest] AS weakest_basis, ['high', 'medium', 'low', 'none', 'none'][weakest] AS judgment FROM w WHERE up IS NULL""")
def k14_lineage(spark, sf):
    return lists.lineage(spark.createDataFrame(LINKS, "list_id string, parent string, basis string"))


@query(f"""WITH {CONSENSUS}, t AS (SELECT entry, n_lists, CASE WHEN n_lists >= t1 THEN 1 WHEN n_lists >= t2 THEN 2 WHEN n_lists >= t3 THEN 3 END AS tier, row_number() OVER (ORDER BY n_lists DESC, entry) AS rank FROM e, th)
SELECT k.tier_table::INTEGER AS tier_table, rank, entry AS word, n_lists AS number_of_lists FROM t JOIN (SELECT unnest([1, 2, 3]) AS tier_table) k ON tier <= tier_table""")
def k16_curation_tables(spark, sf):
    c = _counts(spark, sf)
    t = lists.tiered(c).where("tier IS NOT NULL").join(lists.master(c).select("entry", "rank"), "entry")
    return t.select(F.explode(F.sequence(F.col("tier"), F.lit(3))).alias("tier_table"), "rank", F.col("entry").alias("word"), F.col("n_lists").alias("number_of_lists"))
