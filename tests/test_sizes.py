"""Queries against their SQL on tables whose keys reach further than those of the smallest ones."""

import pytest
from pyspark.sql import functions as F
from tests.oracle import connect, difference

from lodestrata.queries import QUERIES, SQL, live

SMALL = "/root/testdata/sf0.001"
KEYS = {"events": "event_id", "orders": "o_orderkey"}


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """Each table twice, the second time with keys from 1,000,000 on."""
    folder = tmp_path_factory.mktemp("twice")
    for name, key in KEYS.items():
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        rows.unionByName(rows.withColumn(key, F.col(key) + 1000000)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["upsert", "apply_changes", "insert"])
def test_keys_of_another_origin(spark, twice, name):
    assert difference(QUERIES[name](spark, twice), connect(twice), SQL[name]) == ""


def test_batches_of_many_files(spark, monkeypatch):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").count()
    monkeypatch.setattr(live, "FILE_ROWS", rows // 3)
    assert difference(QUERIES["live_tail"](spark, SMALL), connect(SMALL), SQL["live_tail"]) == ""
