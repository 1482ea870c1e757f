"""Live documents and pulls against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import nested_ids as N
from lodestrata.operators import sync as S
from lodestrata.sources.store import Store
from lodestrata.streaming import live
from lodestrata.types import TableSpec, v


def plain_live(updates, keep, budget):
    """States and tails after one update at a time."""
    docs = {}
    for doc, _, kind, ops in updates:
        if kind == "delete":
            docs.pop(doc, None)
            continue
        state = docs.setdefault(doc, {"seq": -1, "known": {}, "bytes": 0, "tail": []})
        state["seq"] += 1
        fresh = {(c, k): x for c, k, x in sorted(set(ops)) if k > state["known"].get(c, -1)}
        for c, k in fresh:
            state["known"][c] = max(k, state["known"].get(c, -1))
        size = sum(len(x.encode()) for x in fresh.values())
        state["bytes"] += size
        if fresh:
            state["tail"].append((state["seq"], size))
        kept, total = [], 0
        for seq, n in reversed(state["tail"]):
            total += n
            if len(kept) == keep or total > budget:
                break
            kept.append((seq, n))
        state["tail"] = kept[::-1]
    return {(d, s["seq"], s["bytes"]) for d, s in docs.items()}, {(d, *x) for d, s in docs.items() for x in s["tail"]}


@pytest.mark.parametrize("batches", [1, 3])
def test_live_documents(spark, tmp_path, batches):
    """However updates are cut into batches, and if a batch comes twice, states and tails are those of one update at a time."""
    rng = random.Random(batches)
    updates, clocks = [], {}
    for n in range(60):
        doc = rng.choice("abc")
        if rng.random() < 0.12:
            updates.append((doc, n, "delete", []))
            continue
        ops = []
        for client in rng.sample(["x", "y", "z"], rng.randint(0, 2)):
            clocks[client] = clocks.get(client, 0) + 1
            ops.append((client, clocks[client], "v" * rng.randint(0, 9)))
        ops += rng.sample([o for d, _, _, past in updates if d == doc for o in past] or [("q", 1, "first")], 1)
        updates.append((doc, n, "upsert", ops))
    store = Store(spark, (tmp_path / "s").as_uri(), live.TABLES)
    size = -(-len(updates) // batches)
    for k in range(batches):
        part = spark.createDataFrame([("c", *u) for u in updates[k * size : (k + 1) * size]], live.UPDATE)
        assert live.record_updates(store, part, k, keep=4, budget=25)
        assert not live.record_updates(store, part, k, keep=4, budget=25)
    states, tails = plain_live(updates, 4, 25) if batches > 1 else (plain_live(updates, 10**6, 10**6)[0], None)
    assert {(r.doc, r.seq, r.bytes) for r in store.read("states").collect()} == states
    got = {(r.doc, r.seq, r.byte_length) for r in store.read("tail").collect()}
    assert got == tails if tails is not None else len(got) <= 12


def test_differences_since_a_vector(spark):
    ops = spark.createDataFrame([("d", "x", 1), ("d", "x", 3), ("d", "y", 1), ("e", "x", 9), (None, "x", 1)], "doc string, client string, clock long")
    mine = spark.createDataFrame([("d", "x", 1), ("e", "x", 9)], "doc string, client string, clock long")
    assert {tuple(r) for r in S.beyond(ops, mine).collect()} == {("d", "x", 3), ("d", "y", 1), (None, "x", 1)}
    assert S.beyond(ops, S.state_vectors(ops)).where("doc IS NOT NULL").collect() == []
    assert S.merged(ops, ops, mine).count() == 5


def test_answers(spark):
    local = spark.createDataFrame([("keep", 1), ("diff", 5), ("gone", 2), ("silent", 3)], "doc string, seq long")
    rows = [("keep", False, True, False, 4), ("diff", False, False, True, 2), ("gone", True, False, False, 9), ("new", False, True, False, 7), ("unknown", False, False, True, 7)]
    answer = spark.createDataFrame(rows, "doc string, deleted boolean, has_document boolean, has_diff boolean, seq long")
    assert {tuple(r) for r in S.answer_actions(local, answer).collect()} == {("keep", "keep", 4), ("diff", "diff", None), ("gone", "delete", None), ("silent", "keep", None), ("new", "insert", 7)}
    ops = spark.createDataFrame([], "doc string, client string, clock long, field string, value string, delta string, member string, ts long, pos long")
    docs = spark.createDataFrame([("new",), ("keep",)], "doc string")
    out, _ = S.apply_answer(local, ops, answer, docs, ops, {}, full=True)
    assert {tuple(r) for r in out.collect()} == {("new", 7), ("keep", 4)}


# Ids in nested values


def test_references_by_declaration(spark):
    spec = TableSpec("t").with_field("a", v.array(v.object(b=v.record(v.array(v.id("x"))), c=v.optional(v.id("y"))))).with_field("u", v.union(v.id("x"), v.array(v.id("y")))).with_field("free", v.union(v.id("x"), v.string()))
    rows = [
        ("1", '{"a":[{"b":{"k":["p","q"],"l":[]},"c":"r"},{"b":null},5],"u":"p","free":"none","other":"p"}'),
        ("2", '{"a":"p","u":["r","s"]}'), ("3", '{"u":["r"]}'), ("4", '{"u":7,"a":[{"c":9}]}'), ("5", "null"), ("6", None), ("7", '{"u":"zz"}'),
    ]
    docs = spark.createDataFrame(rows, "k string, j string").select("k", F.parse_json("j").alias("doc"))
    refs = N.row_references(docs, "k", "doc", spec)
    got = {(r.k, r.path, r.tbl, r.id) for r in refs.where("id IS NOT NULL").collect()}
    assert got == {("1", ".a.0.b.k.0", "x", "p"), ("1", ".a.0.b.k.1", "x", "q"), ("1", ".a.0.c", "y", "r"), ("1", ".u", "x", "p"), ("2", ".u.0", "y", "r"), ("2", ".u.1", "y", "s"), ("3", ".u.0", "y", "r"), ("7", ".u", "x", "zz")}
    known = spark.createDataFrame([("x", "p"), ("y", "r")], "tbl string, id string")
    # A union whose other member takes no offence at a value of another kind is satisfied.
    assert {tuple(r) for r in N.missing_nested(refs, known, "k").collect()} == {("1", "x", "q")}
    strict = TableSpec("t").with_field("u", v.union(v.id("x"), v.id("y")))
    refs = N.row_references(docs, "k", "doc", strict)
    assert {tuple(r) for r in N.missing_nested(refs, known, "k").collect()} == {("7", "x", "zz"), ("7", "y", "zz")}
    with pytest.raises(ValueError):
        N.row_references(docs, "k", "doc", TableSpec("t").with_field("u", v.union(v.id("x"), v.array(v.union(v.id("x"), v.id("y"))))))


def test_translated_json():
    text = '{"_id":"a","name":"a","ownerId":["a",{"name":"a","tagIds":["b",["a"]]}],"n":1.50,"m":{"x":"a"},"z":null}'
    assert N.json_strings(text) == ["a", "b"]
    assert N.json_translated(text, {"a": "A"}) == '{"_id":"A","name":"a","ownerId":["A",{"name":"a","tagIds":["b",["A"]]}],"n":1.50,"m":{"x":"a"},"z":null}'
    assert N.json_translated('["a","c"]', {"a": "A"}) == '["A","c"]' and N.json_strings('{"x":"a"}', frozenset({"x"})) == ["a"]


def test_circles_end_and_wait(spark):
    """a and b wait for each other, c for nothing, d for c, e for something that isn't there."""
    spec = TableSpec("t").with_field("to", v.array(v.id("t")))
    rows = [("a", ["b"]), ("b", ["a", "c"]), ("c", []), ("d", ["c", "l"]), ("e", ["none"]), ("f", ["e", "d"]), ("alone", ["a"])]
    docs = spark.createDataFrame(rows, "id string, `to` array<string>").select("id", F.to_variant_object(F.struct("to")).alias("doc"))
    start, local = (spark.createDataFrame([("t", x) for x in ids], "tbl string, id string") for ids in (["a", "d", "f", "gone"], ["l"]))
    found, edges = N.reach(start, {"t": (docs, "id", "doc", spec)}, local)
    assert {r.id for r in found.collect()} == set("abcdef") and edges.count() == 8
    assert {r.id for r in N.accepted(found, edges, local).collect()} == {"c", "d"}
