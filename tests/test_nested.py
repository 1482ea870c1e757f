"""Keys and JSON form of values of any shape, and dependencies, against plain versions."""

import math
import random
from decimal import Decimal
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import canonical as C
from lodestrata.operators import dependencies as D
from lodestrata.plans.query import Dependency, eq, gt, gte, lt, lte


def compare(a, b):
    """The total order by its rules, value by value."""

    def rank(v):
        if v is None:
            return 1
        if isinstance(v, bool):
            return 5
        if isinstance(v, int):
            return 2
        if isinstance(v, (float, Decimal)):
            return 4 if math.isnan(v) else 3
        return {str: 6, bytes: 7, list: 8, dict: 9}[type(v)]

    if rank(a) != rank(b):
        return -1 if rank(a) < rank(b) else 1
    if a is None or rank(a) == 4:
        return 0
    if isinstance(a, str):
        a, b = a.encode(), b.encode()
    if isinstance(a, dict):
        a, b = ([[k, v] for k, v in sorted(x.items(), key=lambda kv: kv[0].encode())] for x in (a, b))
    if isinstance(a, list):
        for x, y in zip(a, b, strict=False):
            if c := compare(x, y):
                return c
        return (len(a) > len(b)) - (len(a) < len(b))
    return (a > b) - (a < b)


def values(rng, depth=3):
    texts = ["", "a", "\x00", "\x00a", "\x01", "\x02", "ab", "é", "\U0001f600", "\uffee"]
    kinds = [lambda: None, lambda: rng.choice([0, 1, -1, 2**63 - 1, -(2**63), 255, 256]), lambda: rng.choice([0.0, -0.0, 1.5, -1.5, 1e300, -1e300, 5e-324, math.inf, -math.inf, math.nan]), lambda: rng.random() < 0.5, lambda: rng.choice(texts), lambda: rng.choice(texts).encode() + rng.choice([b"", b"\x00", b"\xff"])]
    if depth:
        kinds += [lambda: [values(rng, depth - 1) for _ in range(rng.randint(0, 3))], lambda: {rng.choice(texts[1:]): values(rng, depth - 1) for _ in range(rng.randint(0, 3))}] * 2
    return rng.choice(kinds)()


def test_key_bytes_keep_the_order():
    rng = random.Random(3)
    drawn = [values(rng) for _ in range(400)]
    keys = [C.key_bytes(v) for v in drawn]
    for i in range(400):
        for j in range(i):
            assert compare(drawn[i], drawn[j]) == (keys[i] > keys[j]) - (keys[i] < keys[j]), (drawn[i], drawn[j])
    assert sorted(drawn, key=C.key_bytes)[:1] == sorted(drawn, key=cmp_to_key(compare))[:1]
    with pytest.raises(TypeError):
        C.key_bytes(object())


def test_keys_end_by_themselves():
    rng = random.Random(4)
    pairs = [(values(rng, 1), values(rng, 1)) for _ in range(300)]
    joined = [C.key_bytes(a) + C.key_bytes(b) for a, b in pairs]
    for i in range(300):
        for j in range(i):
            want = compare(pairs[i][0], pairs[j][0]) or compare(pairs[i][1], pairs[j][1])
            assert want == (joined[i] > joined[j]) - (joined[i] < joined[j])


NESTED = "n long, x double, b boolean, s string, y binary, l array<struct<p string, q array<int>>>, m map<string, double>, d decimal(10, 2)"


def test_typed_keys_are_the_plain_ones(spark):
    rng = random.Random(5)
    pick = lambda *v: rng.choice([None, *v])
    rows = [(pick(0, -5, 2**62), pick(0.0, -0.0, math.nan, -2.5, math.inf), pick(True, False), pick("", "a\x00b", "\x01", "é"), pick(b"", b"\x00\xff\x01", b"q"),
             pick([], [("k", [1, None]), None], [(None, [])]), pick({}, {"b": 1.0, "a": None}), pick(Decimal("1.25"))) for _ in range(60)]
    kind = T.StructType.fromDDL(NESTED)
    df = spark.createDataFrame(rows, kind).select(F.struct("*").alias("v"))
    for r in df.select("v", C.sort_key(F.col("v"), kind).alias("k"), C.canonical(F.col("v"), kind).alias("c")).collect():
        plain = r.v.asDict(recursive=True)
        plain = {k: bytes(x) if isinstance(x, bytearray) else x for k, x in plain.items()}
        assert bytes(r.k) == C.key_bytes(plain)
        assert r.c == C.canonical_text(plain)
    assert bytes(spark.range(1).select(C.sort_key(F.lit(None).cast("string"), T.StringType()).alias("k")).first().k) == C.MISSING
    with pytest.raises(TypeError):
        C.sort_key(F.current_date(), T.DateType())


def test_variant_keys(spark):
    texts = ['{"b":[1,2.5,null],"a":"x"}', '{"a":"x","b":[1,2.5]}', "[]", "[1]", "null", "true", '"t"', "1", "1.5", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.parse_json("t").alias("v"))
    got = [r.t for r in df.orderBy(C.sort_key(F.col("v"), T.VariantType())).collect()]
    assert got == [None, "null", "1", "1.5", "true", '"t"', "[]", "[1]", '{"a":"x","b":[1,2.5]}', '{"b":[1,2.5,null],"a":"x"}']


def test_json_form_round_trip():
    rng = random.Random(6)
    for _ in range(500):
        v = values(rng)
        back = C.parsed(C.canonical_text(v))
        assert compare(v, back) == 0 and C.canonical_text(back) == C.canonical_text(v)
    assert [C.js_number(x) for x in (1.0, -2.5, 1e21, 1.5e-7, 1e-6, 123456789012345680.0, -1e-9, 0.00001)] == ["1", "-2.5", "1e+21", "1.5e-7", "0.000001", "123456789012345680", "-1e-9", "0.00001"]
    assert C.canonical_text(0.0) != C.canonical_text(-0.0) and C.canonical_text(1) != C.canonical_text(1.0)
    for bad in ('{"$other":"AA=="}', '{"$x":1,"y":2}', '{"$integer":"AA=="}'):
        with pytest.raises(ValueError):
            C.parsed(bad)
    with pytest.raises(ValueError):
        C.canonical_text({"$a": 1})


# Dependencies

CHANGE = "change long, tbl string, before struct<u: long, s: string>, after struct<u: long, s: string>"


def holds(bound, row):
    c = compare(row[bound.field], bound.value) if row[bound.field] is not None and bound.value is not None else (row[bound.field] is not None) - (bound.value is not None)
    return {"eq": c == 0, "gt": c > 0, "gte": c >= 0, "lt": c < 0, "lte": c <= 0}[bound.op]


def test_dependencies_against_all_pairs(spark):
    rng = random.Random(8)
    num = lambda: rng.choice([rng.randint(-5, 5), rng.randint(-(2**63), 2**63 - 1), 2**63 - 1, -(2**63), None])
    text = lambda: rng.choice(["", "a", "b", "a\x00", "ab"])
    row = lambda: rng.choice([None, (num(), text()), (num(), text())])
    changes = [(i, rng.choice("xy"), row(), row()) for i in range(300)]
    low, high = (lambda f, v: rng.choice([gt, gte])(f, v)), (lambda f, v: rng.choice([lt, lte])(f, v))
    some = lambda: rng.choice([v for v in (num() for _ in range(50)) if v is not None])
    deps = []
    for sub in range(90):
        tbl = rng.choice("xy")
        kind = rng.choice(["u>", "u<", "u", "u<>", "su", "s", "scan", "search", "point"])
        bounds = {"u>": (low("u", some()),), "u<": (high("u", some()),), "u": (eq("u", some()),), "u<>": (low("u", some()), high("u", some())), "su": (eq("s", text()), low("u", some())), "s": (low("s", text()), high("s", text()))}.get(kind, ())
        deps.append((sub, Dependency("range" if bounds else kind, tbl, bounds, rng.randint(0, 299) if kind == "point" else None)))
    df = spark.createDataFrame(changes, CHANGE)
    df = df.withColumns({f"id_{side}": F.when(F.col(side).isNotNull(), F.col("change").cast("string")) for side in ("before", "after")})
    kinds = {f.name: f.dataType for f in df.schema["before"].dataType}
    watched = {D.watched_of(d.bounds, d.table) for _, d in deps if d.kind == "range"}
    keys = None
    for tbl in "xy":
        part = D.changed_keys(df.where(F.col("tbl") == tbl), tbl, sorted(watched, key=str), kinds)
        keys = part if keys is None else keys.unionByName(part)
    want = set()
    for change, tbl, before, after in changes:
        rows = [dict(zip("us", r, strict=True)) for r in (before, after) if r is not None]
        for sub, d in deps:
            if d.table == tbl and (not rows or d.kind in D.WHOLE or (d.kind == "point" and d.id == change) or (d.kind == "range" and any(all(holds(b, r) for b in d.bounds) for r in rows))):
                want.add((change, sub))
    table = D.dependency_rows(spark, deps)
    got = [tuple(r) for r in D.touched(df, keys, table).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    assert {r.sub for r in D.fired(df, keys, table).collect()} == {s for _, s in want}
    one = df.where("change = 0 AND before IS NOT NULL OR change = 1 AND after IS NOT NULL")
    ids = {r.change for r in one.collect()}
    assert {r.sub for r in D.fired(one, keys.join(one.select("change"), "change", "left_semi"), table).collect()} == {s for c, s in want if c in ids}


def test_nothing_watched_and_empty_ranges(spark):
    df = spark.createDataFrame([(1, "x", (1, "a"), None)], CHANGE).withColumn("id_before", F.lit("1")).withColumn("id_after", F.lit(None).cast("string"))
    kinds = {f.name: f.dataType for f in df.schema["before"].dataType}
    with pytest.raises(ValueError):
        D.changed_keys(df, "y", [D.Watched("x", ("u",))], kinds)
    deps = D.dependency_rows(spark, [(1, Dependency("range", "x", (gt("u", 5), lt("u", 3)))), (2, Dependency("range", "x", (gte("u", 1), lte("u", 1))))])
    keys = D.changed_keys(df, "x", [D.Watched("x", ("u",))], kinds)
    assert [tuple(r) for r in D.touched(df, keys, deps).collect()] == [(1, 2)]
    assert D.touched(df, keys, deps.limit(0)).collect() == []
