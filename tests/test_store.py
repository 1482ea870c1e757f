"""Tables under a manifest: versions, buckets, folds, and writers at the same time."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.search import SearchIndex
from lodestrata.operators.vector import VectorIndex
from lodestrata.sources.store import Conflict, Manifests, Store, Table
from lodestrata.streaming import feeds
from lodestrata.types import TableSpec

SHAPE = "id long, v string, _deleted boolean"


def at_once(*jobs):
    """Runs them together; raises what any of them raised."""
    failed = []

    def run(job):
        try:
            job()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    if failed:
        raise failed[0]


def test_manifests_are_never_overwritten(spark, tmp_path):
    m = Manifests(spark, (tmp_path / "m").as_uri())
    assert m.newest() == (-1, {})
    m.publish(0, {"a": "ü"})
    with pytest.raises(Conflict):
        m.publish(0, {"a": 2})
    m.publish(1, {"b": 1})
    assert m.newest() == (1, {"b": 1}) and m.read(0) == {"a": "ü"}


def test_random_commits_against_a_dictionary(spark, tmp_path):
    """Upserts and deletes over many versions, with folds between, equal a plain dictionary; old versions stay readable until they are vacuumed."""
    rng = random.Random(3)
    store = Store(spark, (tmp_path / "s").as_uri(), {"t": Table(("id",), buckets=4)}, fold_share=1.0, most_deltas=2)
    live, seen = {}, []
    assert store.read("t") is None
    for step in range(7):
        ids = rng.sample(range(40), rng.randint(1, 12))
        rows = [(i, f"{step}-{i}", rng.random() < 0.3) for i in ids] + ([(None, f"null {step}", False)] if step % 2 else [])
        assert store.commit({"t": spark.createDataFrame(rows, SHAPE)})
        for i, v, gone in rows:
            live.pop(i, None) if gone else live.__setitem__(i, v)
        seen.append((store.manifests.newest()[0], dict(live)))
        assert dict(map(tuple, store.read("t").collect())) == live
    version, was = seen[-2]
    assert dict(map(tuple, store.read("t", version).collect())) == was
    store.fold("t", every=True)
    assert dict(map(tuple, store.read("t").collect())) == live
    assert store.vacuum() > 0 and dict(map(tuple, store.read("t").collect())) == live
    with pytest.raises(ValueError):
        store.commit({"t": spark.range(1)})
    with pytest.raises(ValueError):
        Store(spark, store.path, {"t": Table(("id",), buckets=8)}).commit({"t": spark.createDataFrame([], SHAPE)})


def test_batches_count_once_and_tables_change_together(spark, tmp_path):
    store = Store(spark, (tmp_path / "s").as_uri(), {"t": Table(("id",)), "side": Table(("id",))})
    rows = lambda *x: spark.createDataFrame([(i, v, False) for i, v in x], SHAPE)
    assert store.commit({"t": rows((1, "a")), "side": rows((1, "A"))}, "w", 0)
    assert not store.commit({"t": rows((1, "b")), "side": rows((1, "B"))}, "w", 0)
    both = lambda: (store.read("t").first().v, store.read("side").first().v)
    assert both() == ("a", "A")
    count = lambda old, batch: batch.select("id", F.lit("first" if old is None or old.isEmpty() else "again").alias("v"), F.lit(False).alias("_deleted"))
    assert store.update("t", rows((5, "x")), count, "w", 1) and not store.update("t", rows((5, "x")), count, "w", 1)
    assert store.update("t", rows((5, "x")), count, "other", 0)
    assert dict(map(tuple, store.read("t").collect())) == {1: "a", 5: "again"}


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    """Blind commits and counts made from what is there, by four writers each."""
    store = Store(spark, (tmp_path / "s").as_uri(), {"t": Table(("id",), buckets=4), "n": Table(("id",), buckets=2)})
    rows = lambda k: spark.createDataFrame([(100 * k + i, f"{k}", False) for i in range(20)], SHAPE)
    ones = spark.createDataFrame([(i,) for i in range(6)], "id long")

    def merge(old, batch):
        add = batch.withColumn("n", F.lit(1))
        return add if old is None else old.unionByName(add).groupBy("id").agg(F.sum("n").cast("int").alias("n"))

    at_once(*[lambda k=k: store.commit({"t": rows(k)}) for k in range(4)], *[lambda: store.update("n", ones, merge) for _ in range(4)])
    assert store.read("t").count() == 80
    assert {tuple(r) for r in store.read("n").collect()} == {(i, 4) for i in range(6)}


def test_a_small_batch_writes_a_small_share(spark, tmp_path):
    store = Store(spark, (tmp_path / "s").as_uri(), {"t": Table(("id",), buckets=8)})
    shape = lambda ids: ids.select("id", F.sha2(F.col("id").cast("string"), 512).alias("v"))
    store.commit({"t": shape(spark.range(20_000))})
    store.commit({"t": shape(spark.range(0, 20_000, 100))})
    state = store.manifests.newest()[1]["tables"]["t"]
    by_folder = {}
    for chain in state["files"].values():
        for folder, n, _ in chain:
            by_folder[folder] = by_folder.get(folder, 0) + n
    assert sorted(by_folder.values()) == [200, 20_000] and store.read("t").count() == 20_000
    for _ in range(6):
        store.commit({"t": shape(spark.range(0, 20_000, 7))})
    assert all(len(chain) <= 5 for chain in store.manifests.newest()[1]["tables"]["t"]["files"].values()) and store.read("t").count() == 20_000


def test_indexes_with_four_writers(spark, tmp_path):
    texts = SearchIndex(spark, (tmp_path / "words").as_uri(), "text", "doc_id")
    spec = TableSpec("e", id="id", creation="id").vector_index("by_v", "v", 2, "label")
    vectors = VectorIndex(spark, (tmp_path / "vectors").as_uri(), spec, "by_v")
    assert vectors.remove(spark.createDataFrame([(1,)], "id long")).segments() == []
    doc = lambda k: spark.createDataFrame([(k, f"word{k} common")], "doc_id long, text string")
    vec = lambda k: spark.createDataFrame([(k, "a", [1.0, float(k)])], "id long, label string, v array<double>")
    at_once(*[lambda k=k: texts.add(doc(k)) for k in range(4)], *[lambda k=k: vectors.add(vec(k)) for k in range(4)])
    assert {r.doc_id for r in texts.docs().collect()} == set(range(4)) and texts.segments() == [0, 1, 2, 3]
    assert {r.id for r in vectors.live().collect()} == set(range(4))
    assert {r.id for r in vectors.remove(spark.createDataFrame([(2,)], "id long")).live().collect()} == {0, 1, 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_of_rows_in_any_order(spark, tmp_path, seed):
    """Late rows join and swallow sessions: batches in random order give the sessions of all rows at once."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), rng.randint(0, 3000)) for _ in range(120)]
    shape = "user_id long, s long"
    for k in range(0, 120, 30):
        spark.createDataFrame(rows[k : k + 30], shape).select("user_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = {tuple(r) for r in feeds.session_counts(spark, str(tmp_path / "in"), schema, "60 seconds", 1).collect()}
    want = set()
    for user in (1, 2, None):
        run = []
        for s in [*sorted(s for u, s in rows if u == user), 10**9]:
            if run and s - run[-1] >= 60:
                want.add((user, run[0] * 1_000_000, len(run)))
                run = []
            run.append(s)
    assert got == want
