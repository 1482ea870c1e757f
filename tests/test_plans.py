"""What plans must hold, so that no task grows with the tables, and that other ways give the same results."""

import math

from pyspark.sql import functions as F

from lodestrata.functions import canonical as C
from lodestrata.operators import dependencies as D
from lodestrata.operators import queue as K
from lodestrata.operators import search as S
from lodestrata.queries import nested as N
from lodestrata.queries import references as R

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_intervals_shuffle_no_change(spark):
    keys, ranges = N._keys(N._changes(spark, SMALL)), N._ranges(spark, SMALL)
    few = D.touched_intervals(keys, ranges)
    assert "SortMergeJoin" not in plan_of(few) and "hashpartitioning" not in plan_of(few)
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(few) == pairs(D.touched_intervals(keys, ranges, few=0))


def test_plain_shapes_meet_no_python(spark):
    rows = spark.sql("SELECT named_struct('a', 1L, 'l', array(1.5D)) AS x, named_struct('l', array(1.5D), 'a', 1L) AS y")
    kind = lambda c: rows.schema[c].dataType
    out = rows.select(C.structurally_equal(F.col("x"), kind("x"), F.col("y"), kind("y")).alias("same"))
    assert "Python" not in plan_of(out) and out.first().same


def test_equality_of_shapes_that_text_does_not_tell(spark):
    nan = "CAST('NaN' AS DOUBLE)"
    values = [
        "parse_json('1')", "CAST(1L AS VARIANT)", "CAST(1.0D AS VARIANT)", "CAST(1.0F AS VARIANT)", "CAST(-0.0D AS VARIANT)", "CAST(0.0D AS VARIANT)", f"CAST({nan} AS VARIANT)", "CAST('NaN' AS VARIANT)", "CAST(NULL AS VARIANT)", "parse_json('null')",
        f"to_variant_object(array(CAST({nan} AS VARIANT), CAST('NaN' AS VARIANT)))", f"to_variant_object(array(CAST('NaN' AS VARIANT), CAST({nan} AS VARIANT)))", "parse_json('1.5')", "CAST(1.5D AS VARIANT)", "parse_json('{\"a b\":1}')",
        "CAST(X'61' AS VARIANT)", "CAST('YQ==' AS VARIANT)", "parse_json('[]')", "parse_json('{}')", "parse_json('[1,[null]]')",
    ]
    one = spark.sql(" UNION ALL ".join(f"SELECT {k} AS k, {v} AS v" for k, v in enumerate(values)))
    pairs = one.crossJoin(one.select(F.col("k").alias("k2"), F.col("v").alias("w")))
    kind = one.schema["v"].dataType
    plain = C.canonical(F.col("v"), kind) == C.canonical(F.col("w"), kind)
    for r in pairs.select("k", "k2", C.structurally_equal(F.col("v"), kind, F.col("w"), kind).alias("mine"), plain.alias("theirs")).collect():
        assert r.mine == r.theirs, (values[r.k], values[r.k2])


def test_projection_deals_rows_to_tasks(spark):
    remote, local, dirty = (spark.range(a, b).select("id", F.lit(x).alias("x")) for a, b, x in ((0, 60, "r"), (30, 90, "l"), (40, 70, "d")))
    out = K.projection(remote, local.union(local), dirty, "id", task_rows=10)
    assert out.rdd.getNumPartitions() >= math.ceil(120 / 10)
    assert sorted(map(tuple, out.collect())) == sorted([(k, "r") for k in range(40)] + [(k, "l") for k in range(40, 70)])


def test_texts_of_one_file_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").coalesce(1)
    monkeypatch.setattr(S, "TASK_BYTES", 20_000)
    index = S.SearchIndex(spark, (tmp_path / "ix").as_uri(), "text", "doc_id").add(docs)
    tasks = {r[0] for r in index.rows().select(F.input_file_name()).distinct().collect()}
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert len(tasks) > total // 20_000 // 2


def test_references_are_read_once(spark):
    assert plan_of(R.missing_nested_refs(spark, SMALL)).count("Generate explode") == 2  # the references, and the ids that are missing
