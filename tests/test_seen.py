"""The key index of the stored table: same answers as the scan of the table, and
a stored side that is neither shuffled nor read whole."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from postline.operators import joins, seen, state
from postline.session import scratch_path
from postline.sources import tables as tb

ROW = "id long, title string, company string, url string"


def new_folder(spark, name):
    return scratch_path(spark, f"test_{name}_{uuid.uuid4().hex}")


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("literals", [seen.MAX_LITERALS, 0])
@pytest.mark.parametrize("fallback", [False, True])
def test_index_answers_like_the_table(spark, monkeypatch, literals, fallback):
    monkeypatch.setattr(seen.KeyIndex.known, "__defaults__", (literals,))
    store = spark.createDataFrame([(1, "Dev", "Acme", "https://a/1"), (2, " QA ", "ÀCME", "https://a/2"), (3, "", "Acme", ""), (4, None, None, None),
                                   (5, "ab", "c", "https://a/5"), (6, "Late", "Co", "https://a/6")], ROW)
    batch = spark.createDataFrame([(11, "x", "y", "https://a/1?utm_source=z"), (12, "dev ", " ACME", "https://b"), (13, "a", "bc", "https://c"),
                                   (14, "", "Acme", ""), (15, None, "Acme", None), (16, "qa", "àcme", "https://d"), (17, "late", "CO", "https://e"),
                                   (18, "z", "z", "https://a/6"), (19, "new", "new", "https://n")], ROW)
    index = seen.write_index(store.where("id < 6"), new_folder(spark, "index"), recent=store.where("id = 6"), buckets=3)
    assert rows(joins.drop_seen(batch, None, fallback, index)) == rows(joins.drop_seen(batch, store, fallback))
    assert rows(joins.is_processed(batch, None, fallback, index).select("id", "seen_by")) == rows(joins.is_processed(batch, store, fallback).select("id", "seen_by"))
    assert index.largest_id().__class__ is F.lit(1).__class__ and spark.range(1).select(index.largest_id()).first()[0] == 6


def test_stored_side_is_not_shuffled_and_buckets_are_pruned(spark):
    store, batch = tb.store_and_batch(spark, SF_SMALL)
    index = seen.write_index(store, new_folder(spark, "index"), buckets=16)
    few = index.known(batch.select(seen.url_key(F.col("url")).alias("key")).limit(3))
    p = plan(few)
    chosen = re.search(r"SelectedBucketsCount: (\d+) out of 16", p)
    assert chosen and int(chosen[1]) <= 3 and "PushedFilters: [In(key" in p
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = index.known(batch.select(seen.url_key(F.col("url")).alias("key")), max_literals=0)
        p = plan(many)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = p.split("== Initial Plan ==")[0].splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "Bucketed: true" in line)
    above = []                                            # the operators between the scan and the join
    while "ShuffledHashJoin" not in lines[scan - 1 - len(above)]:
        above.append(lines[scan - 1 - len(above)])
    assert not any(re.search("Exchange|Sort", line) for line in above), above


def test_index_is_read_by_another_session(spark):
    store, batch = tb.store_and_batch(spark, SF_SMALL)
    index = seen.write_index(store, new_folder(spark, "index"))
    spark.sql(f"DROP TABLE {index.table}")
    again = seen.KeyIndex(spark, index.path)
    assert again.buckets == index.buckets and again.max_id == store.agg(F.max("id")).first()[0]
    assert rows(joins.drop_seen(batch, None, index=again).select("id")) == rows(joins.drop_seen(batch, store).select("id"))


def test_index_of_an_empty_table(spark):
    store = spark.createDataFrame([], ROW)
    index = seen.write_index(store, new_folder(spark, "index"))
    batch = spark.createDataFrame([(1, "a", "b", "https://a")], ROW)
    assert joins.drop_seen(batch, None, index=index).count() == 1 and index.max_id == 0
    assert joins.drop_seen(batch.limit(0), None, index=index).count() == 0


def test_store_index_covers_versions_and_inserts(spark):
    root = new_folder(spark, "store")
    first = spark.createDataFrame([(1, "a", "b", "https://a", "To Apply")], ROW + ", stage string")
    state.write_version(first, root)
    keys = spark.createDataFrame([("uhttps://a",), ("uhttps://b",), ("uhttps://c",)], "key string")
    assert rows(state.key_index(spark, root).known(keys)) == [("uhttps://a",)]
    state.write_delta(spark.createDataFrame([(9, "c", "d", "https://b", "To Apply")], first.schema), root, "inserts", "x")
    index = state.key_index(spark, root)
    assert rows(index.known(keys)) == [("uhttps://a",), ("uhttps://b",)] and spark.range(1).select(index.largest_id()).first()[0] == 9
    table, folded = state.read_snapshot(spark, root)
    state.write_version(table, root, folded=folded)
    assert rows(state.key_index(spark, root).known(keys)) == [("uhttps://a",), ("uhttps://b",)]
