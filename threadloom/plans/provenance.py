"""Sources, schemas, files that are written and read back, hashes."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from ..operators import checks
from ..sources import adapters as ad
from ..sources import provenance as pv
from .base import query

TABLES = ["documents", "events", "labels", "orders"]
TABLE_LIST = ", ".join(f"'{t}'" for t in TABLES)


@query("SELECT doc_id, 'documents.parquet' AS source_file, row_number() OVER () AS source_row_in_file FROM documents")
def s01_source_rows(spark, sf):
    d = pv.source_records(spark, [f"{sf}/documents.parquet"])
    pv.assert_schema(d, {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"})
    return d.select("doc_id", "source_file", "source_row_in_file")


@query("SELECT doc_id, row_number() OVER () AS source_row_in_file FROM documents ORDER BY source_row_in_file LIMIT 20")
def s02_source_order(spark, sf):
    return pv.in_source_order(pv.source_records(spark, [f"{sf}/documents.parquet"])).select("doc_id", "source_row_in_file").limit(20)


@query("SELECT lang, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def s03_projection(spark, sf):
    return ad.read(spark, sf, "documents").select("lang", "n_chars").groupBy("lang").agg(F.sum("n_chars").alias("chars"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*)::INTEGER FROM duckdb_columns() WHERE table_name = '{t}') AS n_columns" for t in TABLES))
def s04_footer_facts(spark, sf):
    out = None
    for t in TABLES:
        f = pv.footer_facts(spark, t, f"{sf}/{t}.parquet").groupBy("name").agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"))
        out = f if out is None else out.unionByName(f)
    return out


def _listings(spark, sf):
    out = None
    for t in TABLES:
        x = pv.schema_listing(spark, t, ad.read(spark, sf, t))
        out = x if out is None else out.unionByName(x)
    return out


@query(f"SELECT table_name AS name, column_name AS field, column_index::INTEGER AS position FROM duckdb_columns() WHERE table_name IN ({TABLE_LIST})")
def s05_declared_schema(spark, sf):
    return _listings(spark, sf).select("name", "field", "position")


@query(f"SELECT column_name AS field, count(*) AS n_tables, count(DISTINCT data_type) AS n_types, string_agg(table_name, ';' ORDER BY table_name) AS tables FROM duckdb_columns() WHERE table_name IN ({TABLE_LIST}) GROUP BY 1")
def s06_schema_summary(spark, sf):
    return pv.schema_summary(_listings(spark, sf))


@query("""WITH m AS (SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2)
SELECT 'documents' AS kind, source AS path, count(*) AS n_members, sum(n)::BIGINT AS rows, min(chars) AS least_chars, max(chars) AS most_chars FROM m GROUP BY 2""")
def s07_manifest(spark, sf):
    m = ad.read(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"))
    lines = m.groupBy(F.lit("documents").alias("kind"), F.col("source").alias("path")).agg(F.collect_list(F.struct("rows", "lang", "chars")).alias("members"))  # a few languages each
    path = pv.new_path(spark, "manifest")
    lines.write.json(path)
    return pv.manifest(spark, path)


CSV_ROWS = [(-1, None, "plain"), (-2, "", " edge blanks "), (-3, "a,b", 'quo"te'), (-4, "NULL", ""), (-5, "x", None)]


@query(f"SELECT doc_id, lang, source FROM documents UNION ALL SELECT * FROM ({ad.values_sql(CSV_ROWS)}) AS t(doc_id, lang, source)")
def s08_csv_read(spark, sf):
    d = ad.read(spark, sf, "documents").select("doc_id", "lang", "source").unionByName(spark.createDataFrame(CSV_ROWS, "doc_id long, lang string, source string"))
    path = pv.new_path(spark, "csv")
    pv.write_csv(d, path)
    return pv.read_csv(spark, path, d.schema)


@query(f"SELECT true AS same_names, true AS same_types, count(*) + {len(CSV_ROWS)} AS n_before, count(*) + {len(CSV_ROWS)} AS n_after, 0::BIGINT AS n_differ FROM documents")
def s09_csv_round_trip(spark, sf):
    d = ad.read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").unionByName(spark.createDataFrame(CSV_ROWS, "doc_id long, lang string, source string"), allowMissingColumns=True)
    path = pv.new_path(spark, "csv")
    pv.write_csv(d, path)
    return pv.round_trip(d, pv.read_csv(spark, path, d.schema), "doc_id")


@query("SELECT codec, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents, (SELECT unnest(['zstd', 'gzip', 'snappy', 'uncompressed']) AS codec) GROUP BY 1")
def s10_parquet_codecs(spark, sf):
    d, out = ad.read(spark, sf, "documents"), None
    for codec in ("zstd", "gzip", "snappy", "uncompressed"):
        path = pv.new_path(spark, codec)
        pv.write_parquet(d.select("doc_id", "n_chars"), path, codec)
        x = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).select(F.lit(codec).alias("codec"), "n", "chars")
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT true AS same_names, true AS same_types, count(*) AS n_before, count(*) AS n_after, 0::BIGINT AS n_differ FROM documents")
def s11_parquet_round_trip(spark, sf):
    d, path = ad.read(spark, sf, "documents"), pv.new_path(spark, "round-trip")
    pv.write_parquet(d, path)
    return pv.round_trip(d, spark.read.parquet(path), "doc_id")


@query("SELECT count(*) AS rows_, 64::BIGINT AS columns, true AS equal, true AS row_major FROM embeddings")
def s12_matrix_files(spark, sf):
    v = np.array([r[0] for r in ad.read(spark, sf, "embeddings").orderBy("vec_id").select("embedding").collect()], np.float32)  # a matrix file is written by one process
    back = pv.npy_array(pv.npy_bytes(v))
    return spark.createDataFrame([(*map(int, back.shape), bool((back == v).all()), bool(back.flags["C_CONTIGUOUS"]))], "rows_ long, columns long, equal boolean, row_major boolean")


FILES = [
    ("lines", "the\nof\n\n and \n"), ("bar", "the   | article\nof\n| comment only\n"), ("quoted", "frozenset(['the', \"of\", 'and'])"), ("comma", "the, of ,and"), ("yaml", "words:\n  - the\n  - of\n"), ("html", "<html><pre>the <b>of</b>\nand</pre></html>"),
]


@query("SELECT unnest(['lines', 'lines', 'lines', 'bar', 'bar', 'quoted', 'quoted', 'quoted', 'comma', 'comma', 'comma', 'yaml', 'yaml', 'html', 'html', 'html']) AS format, unnest(['the', 'of', 'and', 'the', 'of', 'the', 'of', 'and', 'the', 'of', 'and', 'the', 'of', 'the', 'of', 'and']) AS entry")
def s16_list_parsers(spark, sf):
    f = spark.createDataFrame(FILES, "format string, content string")
    return f.select("format", F.explode(pv.parsed(F.col("content"), F.col("format"))).alias("entry"))


@query(f"SELECT unnest([{TABLE_LIST}]) || '.parquet' AS file, true AS unchanged")
def s17_file_hashes(spark, sf):
    out = None
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        before = spark.createDataFrame(pv.file_hashes(spark, path).collect(), "file string, n_bytes long, sha256 string")
        ad.read(spark, sf, t).count()
        x = pv.unchanged(before, pv.file_hashes(spark, path))
        out = x if out is None else out.unionByName(x)
    return out


@query(f"SELECT unnest([{TABLE_LIST}]) || '.parquet' AS file, true AS verified")
def s18_sidecar_verification(spark, sf):
    out = []
    for t in TABLES:
        for r in pv.file_hashes(spark, f"{sf}/{t}.parquet").collect():
            side = pv.sidecar(r.sha256, {"source": (r.file, r.sha256)}, {"table": t})
            pv.verified(r.sha256, side)
            out.append((r.file, True))
    return spark.createDataFrame(out, "file string, verified boolean")


@query("SELECT 'documents.parquet' AS name, 'source' AS role, count(*) AS rows_, 5::BIGINT AS n_columns FROM documents")
def s19_provenance_sidecar(spark, sf):
    d = ad.read(spark, sf, "documents")
    h = pv.file_hashes(spark, f"{sf}/documents.parquet").first()
    side = json.loads(pv.sidecar(h.sha256, {"source": (h.file, h.sha256)}, {}, rows=d.count(), columns=d.columns, seed=1, notes="none"))
    return spark.createDataFrame([(side["inputs"][0]["name"], side["inputs"][0]["role"], side["rows"], len(side["columns"]))], "name string, role string, rows_ long, n_columns long")


@query("SELECT 'pass' AS status, 3::BIGINT AS n UNION ALL SELECT 'fail', 1 UNION ALL SELECT 'not applicable', 1")
def s24_check_statuses(spark, sf):
    one = spark.range(1)
    found = [("a", F.lit(1), F.lit(True)), ("b", F.lit(2), F.lit(True)), ("c", F.lit(3), F.lit(True)), ("d", F.lit(4), F.lit(False)), ("e", F.lit(""), None)]
    return checks.check_rows(one, found).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
