"""The command-line entry points on a small store."""

import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from postline.__main__ import main
from postline.operators import state
from postline.session import scratch_path
from postline.sources import tables as tb
from postline.sources.mail import render_rfc822


def test_commands_version_the_store(spark, capsys):
    base = scratch_path(spark, f"cli_{uuid.uuid4().hex}")
    store, batch = tb.store_and_batch(spark, SF_SMALL)
    store.drop("stage", "sub_stage", "location").write.parquet(f"{base}/legacy")
    batch.select(F.lit("linkedin").alias("site"), F.lit("q").alias("query"), F.col("id").cast("int").alias("position"),
                 "title", "company", "url", "location", F.concat_ws(" ", "title", F.lit("student role")).alias("description"),
                 F.col("id").alias("seq")).write.parquet(f"{base}/postings")
    s = f"{base}/store"
    assert main(["init", "--store", s, "--jobs", f"{base}/legacy"]) == 0
    n0 = state.read_latest(spark, s).count()
    assert main(["cycle", "--store", s, "--postings", f"{base}/postings"]) == 0
    out = capsys.readouterr().out
    assert "Job Search Scan Completed" in out
    after = state.read_latest(spark, s)
    assert after.count() > 0 and set(after.columns) >= {"id", "title", "company", "url", "stage", "ai_summary"}
    from postline.__main__ import CYCLED
    assert state.has_marker(spark, s, CYCLED)          # the next cycle is incremental
    assert main(["cycle", "--store", s, "--postings", f"{base}/postings"]) == 0
    again = state.read_latest(spark, s)
    assert main(["cycle", "--store", s, "--postings", f"{base}/postings", "--full"]) == 0
    assert rows(state.read_latest(spark, s), "id", "stage") == rows(again, "id", "stage")
    for cmd in ("recheck", "geo", "cleanup"):
        assert main([cmd, "--store", s]) == 0
        assert not state.has_marker(spark, s, CYCLED)  # changed since: the next cycle is a full one
    assert main(["top", "--store", s, "--k", "3", "--outbox", f"{base}/outbox"]) == 0
    assert spark.read.parquet(f"{base}/outbox").count() == 1
    assert main(["stats", "--store", s, "--out", f"{base}/groups"]) == 0
    from postline.operators import dedup
    assert spark.read.parquet(f"{base}/groups").count() == dedup.duplicate_groups(state.read_latest(spark, s)).count()
    # mail: messages addressed to companies of the stored jobs
    msgs = tb.messages(spark, SF_SMALL).limit(50)
    render_rfc822(msgs).write.parquet(f"{base}/inbox")
    before = len(state._versions(spark, s))
    assert main(["mail", "--store", s, "--inbox", f"{base}/inbox", "--checkpoint", f"{base}/ck"]) == 0
    assert main(["mail", "--store", s, "--inbox", f"{base}/inbox", "--checkpoint", f"{base}/ck"]) == 0
    assert len(state._versions(spark, s)) == before              # a delta, no new version
    assert len(state._deltas(spark, s, "updates")) == 1          # the replay found nothing new
    assert n0 > 0


def test_scratch_tables_are_dropped(spark):
    from postline.session import drop_scratch, scratch_tables, written
    w = written(spark.range(10), "probe")
    assert w.count() == 10 and scratch_tables()
    path = scratch_tables()[-1]
    drop_scratch(spark)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) and not scratch_tables()


def test_next_version_skips_a_crashed_write(spark):
    base = scratch_path(spark, f"versions_{uuid.uuid4().hex}")
    df = spark.createDataFrame([(1, "To Apply")], "id long, stage string")
    state.write_version(df, base)
    fs, p = state._fs(spark, f"{base}/v=000002/part-crashed")          # a half-written version 2
    fs.create(p, False).close()
    assert state.write_version(df, base, marker="_applied_x").endswith("v=000003")
    assert state._versions(spark, base) == [1, 3] and state.has_marker(spark, base, "_applied_x")
    state.write_version(df, base)
    assert not state.has_marker(spark, base, "_applied_x")                # of the newest version
    assert state.read_latest(spark, base).count() == 1
