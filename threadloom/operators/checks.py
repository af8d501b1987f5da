"""Checks and reconciliations: each a small table of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .reports import rows


def validity(df: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Per field: values, those that a pattern refuses, nulls; one pass."""
    aggs = []
    for name, (c, p) in patterns.items():
        aggs += [F.count(c).alias(f"{name}__n"), F.count_if(F.coalesce(~F.col(c).rlike(p), F.lit(False))).alias(f"{name}__bad"), F.count_if(F.col(c).isNull()).alias(f"{name}__null")]
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"{n}__n").alias("n"), F.col(f"{n}__bad").alias("invalid"), F.col(f"{n}__null").alias("missing")) for n in patterns])
    return df.agg(*aggs).select(F.inline(cells))


def flags_again(events: DataFrame) -> DataFrame:
    """Both presence flags and the kind of parent, proven by left joins of their own."""
    keys = events.select(F.col("doc_key").alias("k"), F.col("record_type").alias("kind"))
    root = keys.where("kind = 'submission'").select(F.col("k").alias("thread_id"), F.lit(True).alias("r"))
    parent = keys.select(F.col("k").alias("parent_id"), F.col("kind").alias("p"))
    e = events.select("record_type", "thread_id", "parent_id", "parent_kind", "thread_root_in_dataset", "parent_in_dataset").join(root, "thread_id", "left").join(parent, "parent_id", "left")
    there = F.when(F.col("parent_id").isNotNull(), F.col("p").isNotNull())
    return e.groupBy("record_type").agg(
        rows().alias("n"), F.count_if(F.col("thread_root_in_dataset") != F.col("r").isNotNull()).alias("root_differs"), F.count_if(~F.col("parent_in_dataset").eqNullSafe(there)).alias("parent_differs"),
        F.count_if(F.col("p").isNotNull() & ~F.col("p").eqNullSafe(F.col("parent_kind"))).alias("kind_differs"),
    )


def marker_counts(events: DataFrame, fields: list[tuple[str, str]], markers: list[str]) -> DataFrame:
    """Per type and field: how often each marker is stored, and its share of the type's records."""
    aggs = {(t, f, m): F.count_if((F.col("record_type") == t) & F.coalesce(F.col(f) == m, F.lit(False))) for t, f in fields for m in markers}
    types = sorted({t for t, _ in fields})
    row = events.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs.values())], *[F.count_if(F.col("record_type") == t).alias(f"n_{t}") for t in types])
    cells = F.array(*[F.struct(F.lit(t).alias("record_type"), F.lit(f).alias("field"), F.lit(m).alias("stored_value"), F.col(f"c{i}").alias("n"), F.col(f"n_{t}").alias("n_records")) for i, (t, f, m) in enumerate(aggs)])
    return row.select(F.inline(cells)).withColumn("pct", F.round(F.try_divide(100 * F.col("n"), F.col("n_records")), 6))


def measures(df: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """measure, n, denominator (all rows), pct."""
    row = df.agg(rows().alias("d"), *[v.alias(k) for k, v in facts.items()]).unpivot(["d"], [F.col(f"`{k}`") for k in facts], "measure", "n")
    return row.select("measure", "n", F.col("d").alias("denominator"), F.round(F.try_divide(100 * F.col("n"), F.col("d")), 6).alias("pct"))


def field_provenance(spark: SparkSession, schemas: dict[str, list[str]]) -> DataFrame:
    """One row a field name: which artifacts have it; the last artifact carries, derives or lacks it."""
    *sources, last = schemas
    found = []
    for name in sorted({c for v in schemas.values() for c in v}):
        inside = [name in schemas[k] for k in schemas]
        origin = "source only" if not inside[-1] else "carried" if any(inside[:-1]) else "derived"
        found.append((name, *inside, origin))
    return spark.createDataFrame(found, "field string, " + ", ".join(f"{k} boolean" for k in (*sources, last)) + ", origin string")


def reconciled(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys on either side or both, and how many agree within the tolerance."""
    one, two = left.select(F.col(key).alias("a"), F.col(value).alias("x")), right.select(F.col(key).alias("b"), F.col(value).alias("y"))
    both = one.join(two, F.col("a") == F.col("b"), "full")
    equal = F.count_if(F.abs(F.col("x") - F.col("y")) <= tolerance)
    return both.groupBy(F.col("a").isNotNull().alias("in_left"), F.col("b").isNotNull().alias("in_right")).agg(rows().alias("n"), equal.alias("equal"))


def agreement(new: DataFrame, old: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys on one side only, shared ones, and how many shared rows agree in each field, nulls equal."""
    renamed = old.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = new.join(renamed, F.col(key) == F.col("__key"), "full")
    shared = F.col(key).isNotNull() & F.col("__key").isNotNull()
    return both.agg(
        F.count_if(F.col("__key").isNull()).alias("only_new"), F.count_if(F.col(key).isNull()).alias("only_old"), F.count_if(shared).alias("shared"),
        *[F.count_if(shared & F.col(f).eqNullSafe(F.col(f"__{f}"))).alias(f"same_{f}") for f in fields],
    )


def attached(df: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """df with the value of each key; a key without one is an error."""
    out = df.join(values.select(key, value, F.lit(True).alias("__has")), key, "left")
    missing = F.raise_error(F.concat(F.lit("no value for "), F.col(key))).cast(values.schema[value].dataType)
    return out.withColumn(value, F.when(F.col("__has").isNotNull(), F.col(value)).otherwise(missing)).drop("__has")


def check_rows(df: DataFrame, found: list[tuple[str, Column, Column | None]]) -> DataFrame:
    """check, detail, status of each (name, detail, passed); passed None means that the check does not apply."""
    cells = [
        F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail"), (F.lit("not applicable") if ok is None else F.when(ok, "pass").otherwise("fail")).alias("status")) for name, detail, ok in found
    ]
    return df.select(F.inline(F.array(*cells)))


def discrepancies(checks: DataFrame) -> DataFrame:
    return checks.where("status = 'fail'")


def event_checks(events: DataFrame, comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """Named checks of the canonical table against its sources."""
    rule = F.concat(F.when(F.col("record_type") == "comment", "t1_").otherwise("t3_"), F.col("reddit_id"))
    one = events.agg(
        rows().alias("n"), F.count_distinct("doc_key").alias("k"), F.count_if(F.col("doc_key") != rule).alias("bad"), F.count_if(~F.col("record_type").isin("comment", "submission")).alias("odd"),
        F.count_if(F.col("text").isNull()).alias("blank"), F.count_if(F.col("num_comments").isNotNull() & ~F.col("is_thread_root")).alias("foreign"),
    )
    source = comments.select("id").unionByName(submissions.select("id")).agg(rows().alias("n_source"))
    n, zero = F.col("n"), lambda c: (F.col(c), F.col(c) == 0)
    return check_rows(one.crossJoin(source), [  # one row each
        ("events equal source rows", F.concat(n.cast("string"), F.lit(" of "), F.col("n_source").cast("string")), n == F.col("n_source")), ("keys are unique", n - F.col("k"), n == F.col("k")),
        ("keys follow the rule", *zero("bad")), ("types are known", *zero("odd")), ("no text is missing", *zero("blank")), ("foreign fields are null", *zero("foreign")), ("earlier artifact agrees", F.lit(""), None),
    ])


def vector_checks(vectors: DataFrame, key: str, vector: str, size: int, corpus: DataFrame, corpus_key: str) -> DataFrame:
    """Named checks of a vector table: keys, dimension, finite values, the corpus it should cover."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    one = vectors.agg(rows().alias("n"), F.count_distinct(key).alias("u"), F.count_if(F.size(vector) == size).alias("d"), F.count_if(finite).alias("f"))
    mine, theirs = vectors.select(F.col(key).alias("k")), corpus.select(F.col(corpus_key).alias("k"))
    extra = mine.join(theirs, "k", "left_anti").agg(rows().alias("extra"))
    missing = theirs.join(mine, "k", "left_anti").agg(rows().alias("missing"))
    n = F.col("n")
    return check_rows(one.crossJoin(extra).crossJoin(missing), [  # one row each
        ("one row a key", n - F.col("u"), n == F.col("u")), (f"dimension is {size}", n - F.col("d"), n == F.col("d")), ("all finite", n - F.col("f"), n == F.col("f")),
        ("no key outside the corpus", F.col("extra"), F.col("extra") == 0), ("no key missing", F.col("missing"), F.col("missing") == 0),
    ])
