"""Truth tables of the filter tree and the total order."""

import itertools

import pytest

from lodestrata.functions import expr as E
from lodestrata.functions.ordering import order_key, sort_columns
from lodestrata.operators.schema import quarantine, validated
from lodestrata.types import TableSpec, v

VALUES = [None, -1.0, 0.0, 2.5, float("inf"), float("nan")]
RANK = {id(x): i for i, x in enumerate(VALUES)}
OPS = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


@pytest.mark.parametrize("op", OPS)
def test_comparisons_follow_the_total_order(spark, op):
    pairs = list(itertools.product(VALUES, VALUES))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    got = {r.i: r.x for r in df.select("i", E.compile_node(E.Node(op, (E.field("a"), E.field("b")))).alias("x")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == OPS[op](RANK[id(a)], RANK[id(b)]), (op, a, b)


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("k", range(len(VALUES)))
def test_comparisons_with_a_constant(spark, op, k):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(VALUES)], "i int, a double")
    for left in (True, False):
        args = (E.field("a"), E.lit(VALUES[k])) if left else (E.lit(VALUES[k]), E.field("a"))
        kept = {r.i for r in df.where(E.conjunction([E.Node(op, args)], df.schema)).collect()}
        assert kept == {i for i in range(len(VALUES)) if (OPS[op](i, k) if left else OPS[op](k, i))}


@pytest.mark.parametrize(
    ("node", "want"),
    [
        (E.eq(E.add(E.field("age"), 10), 40), True), (E.eq(E.sub(E.field("age"), 5), 25), True), (E.eq(E.mul(E.field("age"), 2), 60), True),
        (E.eq(E.div(E.field("age"), 3), 10), True), (E.eq(E.mod(E.field("age"), 7), 2), True), (E.gt(E.field("age"), 30), False), (E.gte(E.field("age"), 30), True),
        (E.and_(), True), (E.or_(), False), (E.not_(E.field("age")), True), (E.not_(E.field("yes")), False), (E.and_(E.field("yes"), E.lit(1)), False),
        (E.field("age"), True), (E.field("none"), False), (E.field("empty"), False), (E.field("zero"), False), (E.field("sub.x"), True), (E.eq(E.field("sub.y"), None), True),
        (E.gt(E.div(1, E.field("zero")), 1e300), True), (E.eq(E.mod(-7, 3), -1), True), (E.lit(float("nan")), False),
    ],
)
def test_nodes(spark, node, want):
    df = spark.sql("SELECT 30 AS age, true AS yes, CAST(NULL AS INT) AS none, '' AS empty, 0.0D AS zero, named_struct('x', 'a', 'y', CAST(NULL AS INT)) AS sub")
    assert df.where(E.conjunction([node], df.schema)).count() == int(want)


def test_unknown_operator():
    with pytest.raises(NotImplementedError):
        E.compile_node(E.Node("like", ()))


def test_pushdown(spark, tmp_path):
    spark.range(10).selectExpr("id", "CAST(id AS DOUBLE) AS x").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for node in (E.lt(E.field("x"), 3.0), E.gte(E.field("x"), 3.0), E.eq(E.field("x"), 3.0)):
        plan = df.where(E.conjunction([node], df.schema))._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan


def test_mixed_order(spark):
    df = spark.sql("SELECT * FROM VALUES (0, parse_json('null')), (1, parse_json('7')), (2, parse_json('1.5')), (3, parse_json('true')), (4, parse_json('\"a\"')), (5, parse_json('[1]')), (6, parse_json('{\"a\":1}')), (7, NULL) AS t(i, x)")
    assert [r.i for r in df.orderBy(order_key(df.x)).collect()] == [7, 0, 1, 2, 3, 4, 5, 6]


def test_nulls_sort_first_and_last(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "a int")
    assert [r.a for r in df.orderBy(*sort_columns(["a"])).collect()] == [None, 1, 2]
    assert [r.a for r in df.orderBy(*sort_columns(["a"], True)).collect()] == [2, 1, None]


def test_validators(spark):
    spec = TableSpec("people", fields={"name": v.string(), "age": v.optional(v.number()), "tags": v.array(v.union(v.literal("a"), v.literal("b"))), "home": v.object(city=v.string())}).checked()
    df = spark.sql("SELECT * FROM VALUES ('1', 'ann', 3.0D, array('a'), named_struct('city', 'x')), ('2', NULL, 1.0D, array('a'), named_struct('city', 'x')), ('3', 'bob', NULL, array('a', 'c'), named_struct('city', 'x')), ('4', 'cy', NULL, array(), named_struct('city', CAST(NULL AS STRING))) AS t(_id, name, age, tags, home)")
    found = {r._id: r._problem for r in validated(df, spec).collect()}
    assert found == {"1": None, "2": "name: missing required field", "3": "tags[]: matches no member of the union", "4": "home.city: missing required field"}
    good, bad = quarantine(df, spec)
    assert (good.count(), bad.count()) == (1, 3)
    assert "_problem" not in good.columns


@pytest.mark.parametrize("spec", [TableSpec("1x"), TableSpec("t", indexes={"i": ("a", "a")}), TableSpec("t", vectors={"v": ("e", 1, ())}), TableSpec("t", fields={"a": v.any()}, indexes={"i": ("b",)})])
def test_bad_declarations(spec):
    with pytest.raises(ValueError):
        spec.checked()
