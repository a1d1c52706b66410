"""The feature store: batches, filters, what is read, and what is not there yet."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pairwise.sources import store as stores
from pairwise.sources.store import Store, extend_store

SCHEMA = "k string, n bigint, v array<double>"


def compute(todo):
    return todo.select("k", F.length("k").cast("long").alias("n"), F.array(F.lit(1.5)).alias("v"))


def keys(spark, names):
    return spark.createDataFrame([(x,) for x in names], "k string")


def opened(spark, path):
    return Store(spark, str(path), spark.createDataFrame([], SCHEMA).schema, "k")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=80), st.lists(st.integers(0, 2**64 - 1), max_size=80))
def test_a_filter_holds_its_keys(own, others):
    own, others = np.array(own, np.uint64), np.array(others, np.uint64)
    assert stores.may_hold(stores.bloom_filter(own), own).all()
    if not len(own):
        assert not stores.may_hold(stores.bloom_filter(own), others).any()


def test_a_filter_passes_few_strangers():
    rng = np.random.default_rng(1)
    own, others = rng.integers(0, 1 << 64, (2, 20_000), np.uint64)
    assert stores.may_hold(stores.bloom_filter(own), others).mean() < 0.01


def test_rows_without_a_manifest_are_not_there(spark, tmp_path):
    extend_store(keys(spark, ["a", "b"]), str(tmp_path), "k", compute)
    store = opened(spark, tmp_path)
    committed = store.commit
    store.commit = lambda batch: None  # the run dies between the rows and the manifest
    store.append(compute(keys(spark, ["c"])))
    assert "c" in {r.k for r in spark.read.parquet(f"{tmp_path}/data").collect()}
    again = opened(spark, tmp_path)
    assert sorted(r.k for r in again.features().collect()) == ["a", "b"]
    assert again.known(keys(spark, ["a", "c"])).collect() == [("a",)]
    store.commit = committed
    assert sorted(r.k for r in extend_store(keys(spark, ["c", "d"]), str(tmp_path), "k", compute).collect()) == list("abcd")


def test_a_part_of_a_manifest_does_not_count(spark, tmp_path):
    extend_store(keys(spark, [f"k{i}" for i in range(50)]), str(tmp_path), "k", compute)
    whole = spark.read.parquet(f"{tmp_path}/manifest")
    rows = whole.withColumn("batch", F.lit("000009-half")).filter("bucket > 0").collect()
    spark.createDataFrame(rows, whole.schema).write.mode("append").parquet(f"{tmp_path}/manifest")
    assert len(opened(spark, tmp_path).batches) == 1


def test_runs_at_the_same_time_leave_each_key_once(spark, tmp_path):
    extend_store(keys(spark, ["a"]), str(tmp_path), "k", compute)
    one, other = opened(spark, tmp_path), opened(spark, tmp_path)
    one.append(compute(keys(spark, ["b", "c"])))
    other.append(compute(keys(spark, ["b", "d"])))
    both = opened(spark, tmp_path)
    assert not both.is_serial()
    assert sorted(r.k for r in both.features().collect()) == list("abcd")
    later = extend_store(keys(spark, ["b", "e"]), str(tmp_path), "k", compute)
    assert sorted(r.k for r in later.collect()) == list("abcde")


def test_only_batches_that_may_hold_a_key_are_read(spark, tmp_path):
    for k in range(4):
        extend_store(keys(spark, [f"{k}-{i}" for i in range(40)]), str(tmp_path), "k", compute)
    store = opened(spark, tmp_path)
    assert len(store.batches) == 4
    names = sorted(store.batches)
    read = []
    rows = store.rows
    store.rows = lambda batches=None: read.append(batches) or rows(batches)
    assert sorted(r.k for r in store.known(keys(spark, ["2-3", "2-7"])).collect()) == ["2-3", "2-7"]
    assert names[2] in read[0] and len(read[0]) < 4
    read.clear()
    assert store.known(keys(spark, [])).count() == 0 and not read


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_the_stored_side_is_not_shuffled(spark, tmp_path, limit):
    extend_store(keys(spark, [f"k{i}" for i in range(200)]), str(tmp_path), "k", compute)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        store = opened(spark, tmp_path)
        plan = store.known(keys(spark, ["k1", "new"]))._jdf.queryExecution().executedPlan().toString()
        # above the scan of the store: a filter, a projection, a sort, and the join
        lines = plan[: plan.index("pairwise_store_")].splitlines()
        above = lines[max(i for i, line in enumerate(lines) if "Join" in line) :]
        assert "Join" in above[0] and not any("Exchange" in line for line in above)
        assert "ReadSchema: struct<k:string>" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_store_of_another_session(spark, tmp_path):
    """A new session knows no table; the folder is enough."""
    extend_store(keys(spark, ["a", "b"]), str(tmp_path), "k", compute)
    for table in spark.catalog.listTables():
        if table.name.startswith("pairwise_store_"):
            spark.sql(f"DROP TABLE {table.name}")
    assert sorted(r.k for r in extend_store(keys(spark, ["b", "c"]), str(tmp_path), "k", compute).collect()) == list("abc")


def test_nothing_to_store(spark, tmp_path):
    assert extend_store(keys(spark, []), str(tmp_path), "k", compute).count() == 0
    assert extend_store(keys(spark, ["a"]), str(tmp_path), "k", compute).count() == 1
