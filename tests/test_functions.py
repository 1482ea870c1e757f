"""Schedules, rich text, seeded ids, table order, tails, storage, streams."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import cron as C
from lodestrata.functions.scalars import plain_text, query_tokens, seeded_uuid, uuid_of
from lodestrata.operators import aggregates as A
from lodestrata.operators import references as R
from lodestrata.operators import search as T
from lodestrata.operators import vector as V
from lodestrata.operators import windows as W
from lodestrata.queries.search import DOCS, VECTORS
from lodestrata.sources.store import Store, Table
from lodestrata.sources.tables import decode_json, read_table, write_table
from lodestrata.streaming import feeds
from lodestrata.types import TableSpec, v


def at(text):
    return int(dt.datetime.fromisoformat(text + "+00:00").timestamp() * 1000)


@pytest.mark.parametrize(
    ("text", "now", "want"),
    [
        ("*/15 * * * *", "2024-01-01T00:00", "2024-01-01T00:15"), ("0 9 * * mon-fri", "2024-01-05T09:00", "2024-01-08T09:00"), ("30 2 31 * *", "2024-01-31T02:30", "2024-03-31T02:30"),
        ("0 0 13 * fri", "2024-01-01T00:00", "2024-01-05T00:00"), ("0 0 29 feb *", "2024-02-01T00:00", "2024-02-29T00:00"), ("@weekly", "2024-01-01T00:00", "2024-01-07T00:00"), ("5,10-12/2 3 * * 7", "2024-01-01T00:00", "2024-01-07T03:05"),
    ],
)
def test_cron(text, now, want):
    assert C.Cron(text).after(at(now)) == at(want)


def test_cron_limits():
    assert C.Cron("0 0 30 feb *").after(at("2024-01-01T00:00")) is None
    for bad in ("* * * *", "60 * * * *", "* * * * 8", "*/0 * * * *"):
        with pytest.raises(ValueError):
            C.Cron(bad).after(0)
    assert C.interval_after(1000, 300, 1950) == 2200 and C.interval_after(1000, 300, 10) == 1000
    assert C.Cron("0 0 31 * *").after(at("2024-03-31T01:00")) == at("2024-05-31T00:00")


def test_fires_minute_by_minute():
    """Whole columns give what trying minute after minute gives."""
    import datetime as dt
    import random

    import numpy as np

    rng = random.Random(5)
    for text in ("7 3,15 * * *", "*/20 0 1,31 * *", "0 12 29 2 *", "30 6 13 * 5", "59 23 * 12 0", "0 0 * * 7"):
        minutes, hours, days, months, week, any_day, any_week = C.Cron(text).fields()
        starts = [rng.randint(27_000_000, 30_000_000) for _ in range(12)]
        got = C.fires(text, np.array(starts, np.int64)).tolist()
        for start, found in zip(starts, got, strict=True):
            want = -1
            for day in range(start // 1440, start // 1440 + 368):
                date = dt.date(1970, 1, 1) + dt.timedelta(days=day)
                a, b = date.day in days, (date.weekday() + 1) % 7 in week
                if date.month in months and (b if any_day and not any_week else a if any_week else a or b):
                    later = [m for h in hours for x in minutes if (m := day * 1440 + 60 * h + x) > start]
                    if later:
                        want = min(later)
                        break
            assert found == (want if want < start + 1 + 366 * 1440 else -1)


def test_rich_text():
    tree = {"type": "doc", "content": [{"type": "paragraph", "content": [{"text": "a"}, {"type": "hardBreak"}, {"text": "b"}]}, {"type": "paragraph"}, {"type": "paragraph"}, {"type": "paragraph", "content": [{"text": "c"}]}]}
    assert plain_text(tree) == "a\nb\n\nc"
    assert plain_text(None) == ""


def test_seeded_ids():
    assert seeded_uuid(1) == seeded_uuid(1) != seeded_uuid(2) and seeded_uuid(7)[14] == "4"


def test_seeded_ids_as_columns(spark):
    seeds = [0, 1, 7, 15, 2**31, 2**32 - 1, 2**32 + 5, 123456789012, -3, None]
    got = spark.createDataFrame([(x,) for x in seeds], "seed long").select("seed", uuid_of(F.col("seed")).alias("id")).collect()
    assert {r["seed"]: r["id"] for r in got} == {x: None if x is None else seeded_uuid(x) for x in seeds}


def test_query_tokens():
    assert query_tokens("Héllo, wörld_42! " + "x" * 40) == ["héllo", "wörld", "42", "x" * 32]
    assert len(query_tokens("a " * 30)) == 16


def test_table_order():
    assert R.table_order({"issues": {"projects"}, "comments": {"issues"}, "projects": set()}) == ["projects", "issues", "comments"]
    assert R.table_order({"a": {"b"}, "b": {"a"}}) == ["a", "b"]
    assert R.root_tables({"a": {"b"}, "b": set()}) == ["b"]


def test_zero_tail_deletes_nothing(spark):
    df = spark.createDataFrame([(1, i, 10) for i in range(4)], "k int, seq int, bytes int")
    assert W.keep_newest(df, ["k"], "seq", 0).count() == 4 and W.keep_within(df, ["k"], "seq", "bytes", 0, 1).count() == 4
    assert {r.seq for r in W.keep_within(df, ["k"], "seq", "bytes", 3, 20).collect()} == {2, 3}


def test_monotone_times(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 5.0), (2, 4.0), (3, 9.0), (4, 9.0)], "i int, t double")
    got = [round(r.creation_time, 4) for r in W.monotone_times(df, "t", [F.col("i")]).orderBy("i").collect()]
    assert got == [5.0, 5.001, 5.002, 9.0, 9.001]


def test_search_plans():
    with pytest.raises(ValueError):
        T.plan_search(DOCS, "by_text", "body", "x")
    with pytest.raises(ValueError):
        T.plan_search(DOCS, "by_text", "text", "x", {"n_chars": 1})
    with pytest.raises(ValueError):
        T.plan_search(DOCS, "none", "text", "x")
    assert T.plan_search(DOCS, "by_text", "text", " ,!") is None


def test_search_example(spark):
    df = spark.createDataFrame([("a", "hello world", 1), ("b", "help me please", 2), ("c", "goodbye world", 3), ("d", None, 4)], "doc_id string, text string, n_chars int")
    found = lambda q: [r.doc_id for r in T.search(df, T.plan_search(DOCS, "by_text", "text", q), "doc_id", "n_chars").collect()]
    assert sorted(found("hel")) == ["a", "b"] and found("world hel") == ["a"] and found("") == []


def test_min_span(spark):
    df = spark.sql("SELECT array(named_struct('pos', 0, 'g', 0), named_struct('pos', 3, 'g', 1), named_struct('pos', 4, 'g', 0), named_struct('pos', 9, 'g', 2)) AS p")
    assert df.select(T.min_span(F.col("p"), 2).alias("s"), T.min_span(F.col("p"), 3).alias("u")).first() == (2, 7)


def test_vector_plans():
    q = [1.0] * 64
    for bad in (dict(vector=q[:3]), dict(vector=["a"] * 64), dict(vector=q, limit=0), dict(vector=q, limit=300), dict(vector=q, limit=True), dict(vector=q, condition=V.eq(V.field("x"), 1)), dict(vector=q, condition=V.and_(V.eq(V.field("label"), 1)))):
        with pytest.raises(ValueError):
            V.plan_vector(VECTORS, "by_embedding", **bad)


def test_vector_order(spark):
    spec = TableSpec("t", id="id").vector_index("v", "e", 2)
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.8, 0.2]), ("d", [2.0, 0.0]), ("e", [1.0]), ("f", None), ("g", [0.0, 0.0]), ("h", [None, 1.0])], "id string, e array<float>")
    assert [r.id for r in V.vector_search(df, V.plan_vector(spec, "v", [1.0, 0.0]), "id").collect()] == ["a", "d", "c", "b", "g"]


def test_tables_round_trip(spark, tmp_path):
    spec = TableSpec("t").with_field("x", v.number()).with_field("tags", v.array(v.string())).index("by_x", "x")
    df = spark.createDataFrame([("i", 1.0, 2.0, ["a"])], spec.schema())
    for kind in ("parquet", "json", "orc"):
        write_table(df, str(tmp_path / kind), spec, kind)
        assert read_table(spark, str(tmp_path / kind), spec, kind).collect() == df.collect()
    docs = spark.createDataFrame([(1, '{"_id":"i","_creationTime":1.0,"x":2.0,"tags":["a"]}')], "row int, data string")
    assert decode_json(docs, "data", spec).drop("row").collect() == df.collect()


def test_deferred_stream(spark, tmp_path):
    """A row whose references are there passes; one that waits in vain is dropped after its last try."""
    spark.createDataFrame([(1, True, "x"), (2, False, "y")], "id long, ready boolean, payload string").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = feeds.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = feeds.deferred(rows, "id", "ready", tries=1, first_ms=1).writeStream.format("memory").queryName("deferred_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        end, got = time.time() + 60, []
        while time.time() < end and len(got) < 2:
            time.sleep(1)
            got = sorted(tuple(r) for r in spark.table("deferred_rows").collect())
    finally:
        q.stop()
    assert got == [(1, "x", "resolved"), (2, "y", "dropped")]


def test_migrations_recover(spark):
    from lodestrata.operators.schema import migrate_recovering

    df, seen = spark.range(4), []
    steps = {2: lambda x: x.withColumn("a", F.col("id") * 2), 3: lambda x: x.withColumn("b", F.raise_error(F.lit("no"))), 5: lambda x: x.withColumn("c", F.lit(1))}

    def by(action):
        return lambda error, version, target: (seen.append((version, target)), action)[1]

    kept, version = migrate_recovering(df, 1, steps, by("retry"))
    assert version == 2 and sorted(r.a for r in kept.collect()) == [0, 2, 4, 6]
    gone, version = migrate_recovering(df, 1, steps, by("reset"))
    assert version == 5 and gone.columns == ["id", "a"] and gone.count() == 0
    own, version = migrate_recovering(df, 1, steps, by(lambda x: x.select("id")))
    assert version == 5 and own.count() == 4 and seen == [(2, 5)] * 3
    whole, version = migrate_recovering(df, 3, steps, by("keep"))
    assert version == 5 and whole.columns == ["id", "c"] and len(seen) == 3
    with pytest.raises(ValueError):
        migrate_recovering(df, 1, steps, by("other"))
    with pytest.raises(ValueError):
        migrate_recovering(df, 9, steps, by("keep"), target=5)


def _until(rows, name, n, checkpoint, seconds=90):
    """The rows of a running stream, once there are n of them."""
    q = rows.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(processingTime="300 milliseconds").start()
    try:
        end, got = time.time() + seconds, []
        while time.time() < end and len(got) < n:
            time.sleep(0.5)
            got = sorted(tuple(r) for r in rows.sparkSession.table(name).collect())
        return got
    finally:
        q.stop()


def test_deferred_rows_wait_up_to_eight_times(spark, tmp_path):
    """A reference that comes after some waits counts; without it the row goes after the eighth."""
    shape = "id long, ready boolean, payload string"
    spark.createDataFrame([(1, False, "late"), (2, False, "never")], shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = feeds.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    waiting = feeds.deferred(rows, "id", "ready", tries=8, first_ms=25, most_ms=1000)

    def later():
        time.sleep(3)
        spark.createDataFrame([(1, True, None)], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    import threading

    thread = threading.Thread(target=later)
    thread.start()
    started = time.time()
    got = _until(waiting, "deferred_eight", 2, str(tmp_path / "cp"))
    thread.join()
    assert got == [(1, "late", "resolved"), (2, "never", "dropped")] and time.time() - started > (25 + 50 + 100 + 200 + 400 + 800 + 1000) / 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_first_seen_until_a_grace_is_over(spark, tmp_path, seed):
    """Batches in order of time give what one walk over all signals gives; a batch that comes twice, and a late signal, change nothing."""
    import random

    rng, grace = random.Random(seed), 3000
    rows = sorted(((rng.choice(["a", "b", None]), rng.randint(0, 40_000)) for _ in range(90)), key=lambda r: r[1])
    store = Store(spark, (tmp_path / "s").as_uri(), feeds.SIGNALS)
    part = lambda x: spark.createDataFrame(x, "key string, at long")
    for k in range(3):
        assert feeds.first_seen(store, part(rows[30 * k : 30 * k + 30]), k, grace)
    assert not feeds.first_seen(store, part([("a", 99_999)]), 2, grace) and feeds.first_seen(store, part([("a", 1), (None, 2)]), 3, grace)
    last, want = {}, set()
    for key, at_ms in rows:
        if key not in last or at_ms >= last[key] + grace:
            last[key] = at_ms
            want.add((key, at_ms))
    assert {tuple(r) for r in store.read("passed").collect()} == want


def test_register_resolvers_see_counted_entries(spark):
    """A hot document's entries never meet in one frame; a resolver gets a row for each distinct value."""
    ops = spark.range(6000).select(F.lit(7).alias("doc"), F.col("id").alias("pos"), (F.col("id") % 50).alias("ts"), F.when(F.col("id") < 2500, "b").when(F.col("id") < 5000, "a").otherwise("c").alias("value"))
    ops = ops.union(spark.sql("SELECT 8, 1L, 5L, 'x'"))
    told = A.resolve_registers(ops, lambda rows: f"{len(rows)}:{','.join(rows['value'])}:{rows['n'].sum() if 'n' in rows else 0}")
    assert {tuple(r) for r in told.collect()} == {(7, "3:b,a,c:6000"), (8, "1:x:1")}
    rule = A.resolve_registers(ops, F.min_by("value", F.struct(-F.col("n"), "value")))
    assert {tuple(r) for r in rule.collect()} == {(7, "a"), (8, "x")} and "Pandas" not in rule._jdf.queryExecution().executedPlan().toString()


def test_hourly_counts_keep_old_rows_of_later_batches(spark, tmp_path):
    import os

    times = [["2025-03-01 10:59:59.999999", "2025-03-01 10:00:00"], ["2021-03-01 10:30:00", "1969-12-31 23:30:00", None], ["2025-03-01 10:10:00", "2021-03-01 10:31:00"], ["2021-03-01 10:32:00"]]
    for k, at_times in enumerate(times):
        df = spark.createDataFrame([(x, "view") for x in at_times], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        for f in (tmp_path / "events").glob("*.parquet"):
            if not f.name.startswith("done"):
                os.utime(f.rename(f.with_name(f"done-{k}-{f.name}")), (1e9 + k, 1e9 + k))
    got = {(r.hour_s, r.event_type, r.n) for r in feeds.hourly_counts(spark, str(tmp_path / "events"), df.schema, 1).collect()}
    hour = lambda text: at(text) // 1000
    assert got == {(hour("2025-03-01T10:00"), "view", 3), (hour("2021-03-01T10:00"), "view", 3), (-3600, "view", 1), (None, "view", 1)}


def test_change_stream(spark, tmp_path):
    log = spark.createDataFrame([("a", 0, "upsert"), ("b", 1, "upsert"), ("a", 2, "delete"), ("c", 3, "upsert")], "id string, seq long, kind string")
    log.repartition(4, "id").write.parquet(str(tmp_path / "log"))
    store = Store(spark, (tmp_path / "live").as_uri(), {"live": Table(("id",))})
    rows = feeds.stream(spark, str(tmp_path / "log"), log.schema, 1)
    feeds.into_store(rows, store, "live", feeds.change_sink("id"), str(tmp_path / "cp")).awaitTermination()
    assert {r.id for r in store.read("live").collect()} == {"b", "c"}


def test_percentiles_of_odd_values(spark):
    """Infinities, NaN, one value, nulls, negative numbers: the element at floor(p * n) of the sorted values."""
    import random

    from lodestrata.operators.aggregates import exact_percentiles

    rng = random.Random(7)
    inf = float("inf")
    kinds = {None: [rng.random() for _ in range(500)] + [1e12], "a": [rng.gauss(0, 100) for _ in range(3000)], "b": [5.0] * 40, "c": [inf, -inf, 1.0, 2.0, float("nan")], "d": [0.0] * 99 + [1e9], "e": [-3.0], "f": [inf, inf]}
    rows = [(k, v) for k, vs in kinds.items() for v in vs] + [("a", None), ("g", None)]
    ps = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    out = {r.k: r for r in exact_percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", ps, partitions=7).collect()}
    assert set(out) == set(kinds)
    for k, vs in kinds.items():
        ordered = sorted(vs, key=lambda x: (x != x, x))
        for name, p in ps.items():
            want, got = ordered[min(len(vs) - 1, int(len(vs) * p))], out[k][name]
            assert got == want or (got != got and want != want)
        assert out[k].n == len(vs)


def test_percentiles_share_out_a_heavy_tail(spark):
    """One value far from all others doesn't put the rest into one partition."""
    from lodestrata.operators import aggregates

    rows = spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 7, 1e12).otherwise(F.col("id") * 0.01).alias("v"))
    dealt = rows.groupBy("k", "v").count().repartitionByRange(50, "k", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 50 and max(r["count"] for r in dealt) < 3 * 20_000 / 50
    (r,) = aggregates.exact_percentiles(rows, "k", "v", {"p50": 0.5, "p100": 1.0}, partitions=50).collect()
    assert (r.n, r.p100) == (20_000, 1e12) and abs(r.p50 - 100) < 0.02


def test_search_index_follows_adds_removes_and_normal_forms(spark, tmp_path):
    from lodestrata.operators.search import SearchIndex

    df = spark.createDataFrame([(1, "the ﬁle"), (2, "Ｆｉｌｅ two"), (3, None), (4, "other")], "doc_id long, text string")
    index = SearchIndex(spark, (tmp_path / "ix").as_uri(), "text", "doc_id").add(df)
    words = lambda x: {(r.term, r.doc_id, r.pos) for r in x.postings().collect()}
    assert words(index) == {("the", 1, 0), ("file", 1, 1), ("file", 2, 0), ("two", 2, 1), ("other", 4, 0)}
    index.add(spark.createDataFrame([(2, "new"), (5, "")], df.schema)).remove(spark.createDataFrame([(4,)], "doc_id long"))
    lengths = lambda x: {(r.doc_id, r.len) for r in x.docs().collect()}
    assert words(index) == {("the", 1, 0), ("file", 1, 1), ("new", 2, 0)} and lengths(index) == {(1, 2), (2, 1), (3, 0), (5, 0)}
    index.add(spark.createDataFrame([(4, "back again")], df.schema))
    whole = index.compact()
    assert words(whole) == words(index) and lengths(whole) == lengths(index) and len(whole.segments()) == 1


def test_rows_to_operations_and_back(spark):
    rows = spark.createDataFrame([(1, "a", 2.5, ["x", "y", "x", None]), (2, None, 0.0, []), (3, "c", None, None)], "doc long, name string, votes double, tags array<string>")
    ops = A.encode_rows(rows, {"name": "register", "votes": "counter", "tags": "set"}, "doc", F.lit(4))
    got = sorted(((r.doc, r.field, r.value, r.delta, r.member, r.ts) for r in ops.collect()), key=str)
    assert got == sorted([(1, "name", "a", None, None, 4), (1, "votes", None, "2.5", None, 4), (1, "tags", None, None, "x", 4), (1, "tags", None, None, "y", 4), (1, "tags", None, None, "null", 4), (2, "name", None, None, None, 4), (3, "name", "c", None, None, 4)], key=str)
    back = {r.doc: (r.name, r.votes, r.tags) for r in A.materialise(ops, {"name": "register", "votes": "counter", "tags": "set"}).collect()}
    assert back == {1: ("a", 2.5, ["null", "x", "y"]), 2: (None, 0.0, []), 3: ("c", 0.0, [])}


def test_folded_nulls_count(spark):
    local = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "doc int, name string, n int")
    folded = spark.createDataFrame([(1, None)], "doc int, name string")
    assert sorted(map(tuple, A.merge_folded(local, folded, "doc", ["name"]).collect())) == [(1, None, 5), (2, "b", 6)]


def test_payload_ahead_of_its_ref(spark):
    from lodestrata.operators.queue import migrate_payloads

    entries = spark.createDataFrame([("a", "{}", "1", 3), ("b", "", "1", 9)], "ref string, args string, local_result string, payload_version int")
    assert migrate_payloads(entries.where("ref = 'b'"), {}).first().payload_version == 9
    with pytest.raises(Exception, match="newer than 2"):
        migrate_payloads(entries, {"a": (2, {})}).collect()


def test_vector_index_hides_what_was_replaced(spark, tmp_path):
    spec = TableSpec("v", id="id").vector_index("by_v", "v", 2, "kind")
    index = V.VectorIndex(spark, tmp_path.as_uri() + "/v", spec, "by_v")
    index.add(spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [0.0, 2.0]), (3, "a", [1.0, 1.0]), (4, "a", None)], "id int, kind string, v array<float>"))
    index.add(spark.createDataFrame([(1, "a", [1.0])], "id int, kind string, v array<float>"))  # too short
    index.remove(spark.createDataFrame([(2,)], "id int"))
    index.add(spark.createDataFrame([(3, "b", [0.0, 1.0]), (5, "a", [3.0, 4.0])], "id int, kind string, v array<float>"))
    for x in (index, index.compact()):
        assert [(r.id, round(r._score, 6)) for r in x.search([0.0, 1.0]).collect()] == [(3, 1.0), (5, 0.8)]
        assert [r.id for r in x.search([0.0, 1.0], condition=V.eq(V.field("kind"), "a")).collect()] == [5]


def test_streams_over_several_batches(spark, tmp_path):
    schema = "ts timestamp_ntz, user_id long, event_type string"
    at_hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    for k, hours in enumerate([[700, 700.5], [0, 0.25, 5], [1, 701]]):  # the second file is old
        spark.createDataFrame([(at_hour(h), 7, "a") for h in hours], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05 * (k < 2))
    path, shape = f"file://{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema
    windows = {(r.start_s - 1704067200) / 3600: r.n for r in feeds.window_counts(spark, path, shape, "6 hours", files_per_batch=1).collect()}
    sessions = sorted(r.n for r in feeds.session_counts(spark, path, shape, "2 hours", 1).collect())
    assert windows == {0: 4, 696: 3} and sessions == [1, 3, 3]
