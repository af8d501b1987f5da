"""Each query against its SQL twin on the smallest tables, and inline cases that these lack."""

import hashlib
import math

import duckdb
import pytest
from conftest import SF

from pyspark.sql import functions as F

from threadloom.functions import text as ft
from threadloom.operators import checks, reports, stability, threads
from threadloom.plans import registry
from threadloom.sources import adapters as ad
from threadloom.sources import provenance as pv

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.8g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(flat(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.oracle_sql():  # no SQL: tests/test_operators.py has these
        assert got[1]
        return
    r = db.sql(registry.oracle_sql()[name])
    assert got == rows(list(r.columns), r.fetchall())


@pytest.fixture(scope="module")
def in_parts(db, tmp_path_factory):
    """The tables of provenance as folders of three parts."""
    out = tmp_path_factory.mktemp("parts")
    for t in ("documents", "events", "labels", "orders"):
        (out / f"{t}.parquet").mkdir()
        n = db.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] // 3 + 1
        for i in range(3):
            db.execute(f"COPY (SELECT * FROM {t} LIMIT {n} OFFSET {i * n}) TO '{out}/{t}.parquet/part-{i}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["s01_source_rows", "s02_source_order", "s17_file_hashes", "s18_sidecar_verification", "s19_provenance_sidecar"])
def test_folders_match_sql(spark, db, in_parts, name):
    df = registry.queries()[name](spark, in_parts)
    r = db.sql(registry.oracle_sql()[name])
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(list(r.columns), r.fetchall())


def test_folder_hash_changes(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name, text in (("t/a", "1"), ("t/b", "2"), ("one", "1")):
        (tmp_path / name).write_text(text)
    before = pv.file_hashes(spark, f"{tmp_path}/t").first()
    assert (before.file, before.n_bytes) == ("t", 2) and pv.file_hashes(spark, f"{tmp_path}/one").first().sha256 == hashlib.sha256(b"1").hexdigest()
    (tmp_path / "t/b").write_text("3")
    assert pv.file_hashes(spark, f"{tmp_path}/t").first().sha256 != before.sha256


def fixture(spark):
    """The fixture's records alone, without the supplied conversations."""
    return threads.canonical(ad.comments(spark, SF).where("source_file = 'fixture'"), ad.submissions(spark, SF).where("source_file = 'fixture'"))


def test_threads_fixture(spark):
    e = fixture(spark)
    assert e.columns == threads.COLUMNS and len(threads.COLUMNS) == 29
    flags = {r.doc_key: (r.thread_root_in_dataset, r.parent_in_dataset, r.parent_kind) for r in e.collect()}
    assert len(flags) == 14 and flags["t1_fxc4"] == (False, False, "submission") and flags["t1_fxc3"] == (True, False, "comment") and flags["t3_fxa"] == (True, None, None)
    assert flags["t1_fxc7"] == (True, False, "other") and flags["t1_fxc8"] == (True, None, None)
    texts = {r.doc_key: r.text for r in e.collect()}
    assert texts["t3_fxa"] == "A " and texts["t3_fxb"] == "B [removed]" and texts["t1_fxc2"] == ""
    s = {r.thread_id: r for r in threads.thread_summary(e).collect()}
    assert (s["t3_fxa"].n_comments, s["t3_fxa"].n_comment_authors, s["t3_fxa"].n_comments_replying_to_root) == (7, 5, 2)  # five: a null author is a value
    assert s["t3_fxq"].root_in_dataset is False and s["t3_fxq"].n_events == 1 and s["t3_fxq"].root_author is None
    classes = {r.parent_class: r.n for r in e.where("NOT is_thread_root").groupBy(threads.parent_class().alias("parent_class")).count().withColumnRenamed("count", "n").collect()}
    assert classes == {"malformed": 2, "own submission": 2, "other submission": 1, "comment in sample": 4, "not in sample": 1}


def test_source_errors(spark):
    c, s = ad.comments(spark, SF).where("source_file = 'fixture'"), ad.submissions(spark, SF).where("source_file = 'fixture'")
    with pytest.raises(Exception, match="without an id"):
        threads.canonical(c.withColumn("id", F.lit(None).cast("string")), s).collect()
    assert threads.duplicate_ids(c.union(c)).count() == c.count() and threads.duplicate_ids(c).count() == 0
    failed = checks.discrepancies(checks.event_checks(threads.canonical(c, s), c.limit(3), s)).collect()
    assert [r.check for r in failed] == ["events equal source rows"]


def test_chains(spark):
    n = 300
    rows = [(f"t1_{i}", f"t1_{i - 1}" if i else "t3_r", True, False) for i in range(n)] + [("t3_r", None, None, True), ("t1_x", "t1_gone", False, False)]
    got = {r.doc_key: r for r in reports.chain_to_root(spark.createDataFrame(rows, "doc_key string, parent_id string, parent_in_dataset boolean, is_thread_root boolean")).collect()}
    assert got["t1_299"].steps == 300 and got["t1_299"].top == "t3_r" and got["t1_299"].reached_root and got["t1_x"].absent_parent == "t1_gone" and got["t1_x"].steps == 0
    loop = [("t1_a", "t1_b", True, False), ("t1_b", "t1_a", True, False)]
    with pytest.raises(ValueError, match="cycle"):
        reports.chain_to_root(spark.createDataFrame(loop, "doc_key string, parent_id string, parent_in_dataset boolean, is_thread_root boolean"))


def test_letter_runs_fixture(spark):
    df = spark.createDataFrame([(ad.COMMENT_ROWS[3][4],), ("a b \U0001f600",)], "t string")
    got = df.select(ft.letter_runs(F.col("t")).alias("x"), ft.whitespace_tokens(F.col("t")).alias("w"), F.length("t").alias("n")).collect()
    assert got[0].x == ["anna", "o'brien"] and got[1].w == ["a", "b", "\U0001f600"] and got[1].n == 5


def test_constant_labelling(spark):
    df = spark.createDataFrame([(i, 1, 1) for i in range(3)], "id long, a long, b long")
    assert {r.ari for r in stability.adjusted_rand(df).collect()} == {None}
