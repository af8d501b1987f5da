"""Operators that SQL does not express, by brute force on small inputs."""

import json
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF

from threadloom.operators import blocks as blk
from threadloom.operators import clustering, corpus, lists, ordering, sampling, text, topics
from threadloom.plans import corpus as corpus_plans
from threadloom.plans import registry
from threadloom.sources import adapters as ad
from threadloom.sources import provenance as pv


def blobs(seed=0):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.2, (30, 3)) for c in (0, 4, 9)] + [rng.uniform(-20, 20, (6, 3))])


def test_spanning_tree_brute_force():
    x, samples = blobs()[:40], 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, samples - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    group, total = list(range(len(x))), 0.0
    for a, b in sorted(((i, j) for i in range(len(x)) for j in range(i)), key=lambda p: reach[p]):
        if group[a] != group[b]:
            total += reach[a, b]
            group = [group[a] if g == group[b] else g for g in group]
    tree = clustering.reach_tree(x, samples)
    assert len(tree) == len(x) - 1 and np.isclose(sum(e[2] for e in tree), total)


def test_spanning_tree_in_blocks(spark, monkeypatch):
    x = np.concatenate([blobs(2), blobs(2)[:7]])  # and copies
    df = spark.createDataFrame([(3 * i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<double>")
    want = [e[2] for e in clustering.reach_tree(x, 5)]
    labels = clustering.clusters_of(clustering.reach_tree(x, 5), len(x), 10)[0].tolist()
    for size in (11, 60, 5000):
        monkeypatch.setattr(blk, "TREE_BLOCK", size)
        got = clustering.spanning_tree(df, "k", "v", 5).orderBy("step").collect()
        assert len({r.from_key for r in got} | {r.to_key for r in got}) == len(x) and np.allclose([r.distance for r in got], want)
        assert [r.cluster_label for r in clustering.density_clusters(df, "k", "v", 10, 5).orderBy("k").collect()] == labels
    assert clustering.spanning_tree(df.limit(1), "k", "v", 5).count() == 0 and clustering.density_clusters(df.limit(0), "k", "v", 10, 5).count() == 0


def test_more_vectors_than_a_limit(spark):
    df = spark.range(20_001).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    assert clustering.spanning_tree(df, "id", "v", 3).count() == 20_000


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (90, 4)), np.tile(rng.normal(0, 1, (1, 4)), (80, 1)), np.zeros((2, 4))])  # many copies, vectors without a length
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<double>")
    u = x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-300)
    s = np.round(u @ u.T, 9)
    want = {(i, n + 1, j) for i in range(len(x)) for n, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:3])}
    for size in (13, 100, 4096):
        monkeypatch.setattr(blk, "NEAR_BLOCK", size)
        assert {(r.k, r.rank, r.neighbour) for r in clustering.nearest(df, "k", "v", 3).collect()} == want


def test_layout_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(5 * i, [float(v) for v in r]) for i, r in enumerate(blobs(3))], "k long, v array<double>")
    one = clustering.layout(df, "k", "v", 2, 5, 8, seed=3).orderBy("k").collect()
    monkeypatch.setattr(clustering, "AT_ONCE", 300)
    two = clustering.layout(df, "k", "v", 2, 5, 8, seed=3).orderBy("k").collect()
    assert len(one) == 96 and np.allclose(np.array(one, float), np.array(two, float))


def test_density_clusters(spark):
    x = blobs()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<double>")
    got = sorted(clustering.density_clusters(df, "k", "v", 10, 5).collect())
    labels = [r.cluster_label for r in got]
    assert [set(labels[i : i + 30]) - {-1} for i in (0, 30, 60)] == [{0}, {1}, {2}]
    assert all((r.membership_probability == 0) == (r.cluster_label == -1) for r in got) and labels[90:].count(-1) >= 4
    again = clustering.clusters_of(clustering.reach_tree(x, 5), len(x), 10)[0]
    assert labels == again.tolist()
    assert set(clustering.clusters_of(clustering.reach_tree(x[:5], 2), 5, 10)[0]) == {-1} and len(clustering.clusters_of([], 0, 3)[0]) == 0


def test_neighbours_and_layout(spark):
    x = blobs(1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<float>")
    got = {}
    for r in clustering.nearest(df, "k", "v", 5).collect():
        got.setdefault(r.k, []).append((r.rank, r.neighbour))
    u = x.astype(np.float32).astype(float)
    u /= np.sqrt((u**2).sum(1, keepdims=True))
    s = np.round(u @ u.T, 9)
    for i, near in got.items():
        want = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:5]
        assert [j for _, j in sorted(near)] == want
    one, two = (clustering.layout(df, "k", "v", 2, 5, 20, seed=3).orderBy("k").collect() for _ in range(2))
    assert one == two and len(one) == len(x) and np.isfinite([[r.c0, r.c1] for r in one]).all()


def test_assignment_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 4, 6):
        for _ in range(20):
            g = rng.random((n, n))
            to = topics.assignment(g)
            assert sorted(to) == list(range(n))
            assert np.isclose(g[range(n), to].sum(), max(g[range(n), p].sum() for p in permutations(range(n))))


def test_gibbs_separates_and_repeats():
    rng = np.random.default_rng(2)
    docs = np.repeat(np.arange(40), 30)
    terms = np.array([f"{'ab'[d % 2]}{w}" for d, w in zip(docs, rng.integers(0, 15, len(docs)), strict=True)])
    z = topics.gibbs(docs, terms, 2, 1, 40)
    assert (z == topics.gibbs(docs, terms, 2, 1, 40)).all()
    own = [np.bincount(z[docs % 2 == k], minlength=2) for k in (0, 1)]
    assert min(o.max() / o.sum() for o in own) > 0.9 and own[0].argmax() != own[1].argmax()


def test_fits_equal_one_process(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = np.repeat(np.arange(60), 25)
    terms = np.array([f"{'ab'[d % 2]}{w}" if w else f"only{d}" for d, w in zip(docs, rng.integers(0, 15, len(docs)), strict=True)])
    long = spark.createDataFrame([(int(d), str(w)) for d, w in zip(docs, terms, strict=True)], "doc_id long, term string").groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    monkeypatch.setattr(sampling, "BUCKET", 7)
    jobs, got, rounds = [(2, 1), (3, 5)], {}, 12
    for parts, one_task in ((1, 0), (5, 0), (2, 10**6)):
        monkeypatch.setattr(sampling, "ONE_TASK", one_task)
        for r in topics.fits(text.by_document(long).repartition(parts).localCheckpoint(), jobs, rounds).collect():
            got.setdefault(parts, {})[r.topics, r.seed, r.doc_id, r.term, r.k] = r.n
    want = {}
    for k, seed in jobs:
        for d, w, z in zip(docs.tolist(), terms.tolist(), topics.gibbs(docs, terms, k, seed, rounds).tolist(), strict=True):
            want[k, seed, d, w, z] = want.get((k, seed, d, w, z), 0) + 1
    assert got[1] == want and got[5] == want and got[2] == want
    assert sampling.MOST_ROUNDS == 1000 and topics.fits(text.by_document(long.limit(0)), jobs).count() == 0


def test_queries_fit_to_the_end(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(topics, "fits", lambda docs, jobs, rounds_=None, **more: rounds.append((jobs, rounds_, more)) or spark.createDataFrame([], "topics int, seed int, doc_id long, term string, k int, n long"))
    for q in ("l03_gibbs_fits", "l16_refit"):
        registry.queries()[q](spark, SF)
    assert rounds == [([(5, 1), (5, 2)], None, {}), ([(5, 1)], None, {}), ([(5, 1)], None, {})]


def test_term_counts_of_repeated_ids(spark):
    d = spark.createDataFrame([(1, "b a b's a"), (2, "cc bb cc"), (2, "bb dd"), (None, "ee ff"), (None, "ee"), (3, "x"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: [tuple(c) for c in r.cells] for r in text.term_counts(d).collect()}
    assert got == {2: [("bb", 2), ("cc", 2), ("dd", 1)], None: [("ee", 2), ("ff", 1)]}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_counted_within_rows(spark):
    assert "Exchange" not in _plan(registry.queries()["t13_document_terms"](spark, SF))
    d = ad.read(spark, SF, "documents")
    m = corpus_plans.model(spark, SF)
    assert "Exchange" not in _plan(m.assigned)
    for df in (text.term_counts(d), m.docs):
        assert "Join" not in _plan(df)
    assert "doc_id" not in "".join(x for x in _plan(ad.lists(spark, SF)).splitlines() if "Exchange" in x)
    plan = _plan(corpus.second_path(d))
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan  # the second tokenizer's tokens are not gathered in batches


def test_frequent_terms_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(d, f"t{w}", k, 1 + (d + w) % 3) for d in range(9) for w in range(12) for k in (0, 1) if (d * w + k) % 4 < 2], "doc_id long, term string, k int, n long")
    docs = docs.groupBy("doc_id").agg(F.collect_list(F.struct("term", "k", "n")).alias("cells"))
    got = topics.perplexity(topics.Model(docs, 2)).first()
    counts = {}
    for r in docs.collect():
        for c in r.cells:
            counts[r.doc_id, c.term, c.k] = counts.get((r.doc_id, c.term, c.k), 0) + c.n
    total = lambda f: sum(n for x, n in counts.items() if f(*x))
    v = len({w for _, w, _ in counts})
    share = lambda d, k: (total(lambda a, b, c: (a, c) == (d, k)) + 2.5) / (total(lambda a, b, c: a == d) + 5)
    p = lambda w, k: (total(lambda a, b, c: (b, c) == (w, k)) + 0.01) / (total(lambda a, b, c: c == k) + v * 0.01)
    want = sum(n * np.log(sum(share(d, k) * p(w, k) for k in (0, 1))) for (d, w, _), n in counts.items())
    assert np.isclose(got.loglik, want, atol=2e-3) and got.tokens == sum(counts.values())
    before = registry.queries()["m01_conversion_accounting"](spark, SF).collect()
    monkeypatch.setattr(topics, "FREQUENT", 3)
    monkeypatch.setattr(corpus, "TELLING", 1)
    assert topics.perplexity(topics.Model(docs, 2)).first() == got and sorted(registry.queries()["m01_conversion_accounting"](spark, SF).collect()) == sorted(before)


def test_average_linkage_brute_force():
    rng = np.random.default_rng(5)
    names = list("abcdefg")
    d = {(x, y): float(rng.random()) for i, x in enumerate(names) for y in names[i + 1 :]}
    groups, got = [[x] for x in names], lists.joined_by_average(d, names)
    mean = lambda p, q: np.mean([d[min(x, y), max(x, y)] for x in p for y in q])
    for _, a, b, height, size in got:
        pairs = [(mean(p, q), p, q) for i, p in enumerate(groups) for q in groups[i + 1 :]]
        h, p, q = min(pairs, key=lambda x: x[0])
        assert np.isclose(h, height) and {min(p), min(q)} == {a, b} and len(p) + len(q) == size
        groups = [g for g in groups if g not in (p, q)] + [p + q]
    assert len(groups) == 1


def test_spline_basis():
    x = np.linspace(-1, 3, 50)
    b = topics.spline_basis_at(x, -1.0, 3.0, np.quantile(x, [0.25, 0.5, 0.75]))
    assert b.shape == (50, 7) and np.allclose(b.sum(1), 1) and (b >= 0).all() and np.isclose(b[0, 0], 1) and np.isclose(b[-1, -1], 1)


def test_request_plan_brute_force(spark):
    rng = np.random.default_rng(6)
    sizes = [int(x) for x in rng.integers(0, 12, 80)] + [50]
    got = ordering.request_plan(spark.createDataFrame(list(enumerate(sizes)), "i long, n long").orderBy("i"), "n", 20).collect()
    want, batch = [], []
    for n in sizes:
        if batch and sum(batch) + n > 20:
            want.append(batch)
            batch = []
        batch.append(n)
    want.append(batch)
    assert [(r.documents, r.tokens) for r in got] == [(len(b), sum(b)) for b in want] and ordering.request_plan(spark.createDataFrame([], "n long"), "n", 5).count() == 0


def test_provenance(spark, tmp_path):
    side = pv.sidecar("abc", {"source": ("x.parquet", "def")}, {"k": 1}, rows=3)
    pv.verified("abc", side)
    with pytest.raises(ValueError, match="sidecar"):
        pv.verified("abd", side)
    assert json.loads(side)["inputs"] == [{"role": "source", "name": "x.parquet", "sha256": "def"}]
    keys = {pv.run_key({"a": "1"}, {"s": s}, "code", {"v": "1"}) for s in (1, 2)}
    assert len(keys) == 2 and pv.run_key({"a": "1"}, {"s": 1}, "code", {"v": "1"}) in keys
    saved = {}
    step = lambda state, i: [*state, i]
    save = lambda done, state: saved.update(x=(done, state))
    assert pv.resumed(step, [], topics.planned_chunks(0, 10, 4), lambda: saved.get("x"), save) == list(range(10))
    saved["x"] = (4, list(range(4)))
    assert pv.resumed(step, [], [4, 8, 10], lambda: saved.get("x"), save) == list(range(10))
    m = pv.Measured()
    assert m.run("work", lambda: 5) == 5 and m.stages[0][0] == "work" and m.stages[0][2] > 0
    assert "| rows | 3 |" in pv.report({"title": "T", "counts": {"rows": 3}}) and pv.environment(spark)["pyspark"]
    with pytest.raises(ValueError, match="contract"):
        pv.assert_schema(spark.range(1), {"id": "string"})
    f = pv.footer_facts(spark, "t", _written(spark, tmp_path)).collect()
    assert sum(r.n_rows for r in f) == 10 and all(r.n_columns == 2 and r.created_by for r in f)
    v = np.arange(12).reshape(3, 4)
    assert (pv.npy_array(pv.npy_bytes(v, "F")) == v).all() and pv.npy_array(pv.npy_bytes(v, "F")).flags["F_CONTIGUOUS"]
    changed = pv.round_trip(spark.range(3), spark.range(1, 4), "id").first()
    assert changed.same_names and changed.n_differ == 2


def _written(spark, tmp_path) -> str:
    path = f"file://{tmp_path}/t"
    pv.write_parquet(spark.range(10).withColumn("x", F.lit("a")), path)
    return path
