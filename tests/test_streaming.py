"""Batch = stream: the streaming forms give the batch operators' answers,
also when the input arrives over several micro-batches, and a replayed
run does not apply anything twice."""

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from postline.operators import dedup, reports, state
from postline.plans import cycle
from postline.session import scratch_path
from postline.sources import tables as tb
from postline.streaming import streams


def _split_by_time(df, parts, path):
    """Write ``df`` as ``parts`` files in time order (one per micro-batch)."""
    lo, hi = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    span = (hi - lo + 1) / parts
    w = df.withColumn("_b", F.floor((F.unix_micros("ts") - F.lit(lo)) / F.lit(span)))
    for b in range(parts):
        w.where(F.col("_b") == b).drop("_b").coalesce(1).write.mode("append").parquet(path)


def _shuffled(df, parts, path):
    """Write ``df`` as ``parts`` files (one per micro-batch), each with rows of all times."""
    for b in range(parts):
        df.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == b).coalesce(1).write.mode("append").parquet(path)


def test_breaker_state_over_late_micro_batches(spark):
    a = tb.attempts(spark, SF_SMALL)
    now = F.lit(a.agg(F.max("ts")).first()[0])
    base = scratch_path(spark, f"test_breaker_{uuid.uuid4().hex}")
    _shuffled(a, 4, f"{base}/in")
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    streams.seed_table(spark.createDataFrame([], streams.BREAKER_STATE), f"{base}/state")
    streams.breaker_stream(spark, stream, f"{base}/state", f"{base}/ck")
    st = state.read_latest(spark, f"{base}/state")
    assert rows(streams.breaker_open(st, now)) == rows(reports.breaker_state(a, now))
    failures = st.where("not success").groupBy("site").agg(F.count("*").alias("n"))
    want = dedup.trailing_failures(a).where("trailing_failures > 0").select("site", "trailing_failures")
    assert rows(failures) == rows(want)          # nothing but what still counts is kept
    # a second run over the same checkpoint finds nothing new and changes nothing
    streams.breaker_stream(spark, stream, f"{base}/state", f"{base}/ck")
    assert rows(state.read_latest(spark, f"{base}/state")) == rows(st)


def test_ingest_stream_equals_batch_ingest(spark):
    store, batch = tb.store_and_batch(spark, SF_SMALL)
    postings = batch.select(F.col("id").alias("seq"), "title", "company", "url", "location",
                            F.concat_ws(" ", F.col("title"), F.lit("position")).alias("description"))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    base = scratch_path(spark, f"test_ingest_{uuid.uuid4().hex}")
    postings.write.parquet(f"{base}/in")
    streams.seed_table(store, f"{base}/store")
    streams.ingest_stream(spark, f"{base}/in", f"{base}/store", f"{base}/ck", postings.schema, now=now)
    streamed = state.read_latest(spark, f"{base}/store")
    batch_store = cycle.ingest(store, postings, now)["store"]
    cols = ("id", "url", "stage", "ai_summary")
    assert rows(streamed, *cols) == rows(batch_store, *cols)


def _bytes(spark, path):
    fs, p = state._fs(spark, path)
    return fs.getContentSummary(p).getLength()


def test_ingest_writes_deltas_and_replays_nothing(spark):
    """Three files, a micro-batch each: equal to three batch ingests in turn; the
    seed (partitioned by stage) is not written again, and a lost checkpoint's replay of an applied batch does nothing."""
    store, batch = tb.store_and_batch(spark, SF_SMALL)
    postings = batch.select(F.col("id").alias("seq"), "title", "company", "url", "location",
                            F.concat_ws(" ", F.col("title"), F.lit("position")).alias("description"))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    base = scratch_path(spark, f"test_delta_{uuid.uuid4().hex}")
    root = state.write_version(store, f"{base}/store").rpartition("/")[0]
    seed = _bytes(spark, f"{root}/v=000001")
    want = store
    for k in (1, 3, 5):
        part = postings.where(F.col("seq") % 6 == k)
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        want = cycle.ingest(want, part, now)["store"]
    streams.ingest_stream(spark, f"{base}/in", root, f"{base}/ck", postings.schema, now=now, files_per_batch=1)
    cols = ("id", "url", "stage")
    got = state.read_latest(spark, root)
    assert rows(got, *cols) == rows(want, *cols)
    assert state._versions(spark, root) == [1] and _bytes(spark, f"{root}/v=000001") == seed
    assert len(state._deltas(spark, root, "inserts")) == 3
    streams.ingest_stream(spark, f"{base}/in", root, f"{base}/ck", postings.schema, now=now, files_per_batch=1)
    assert rows(state.read_latest(spark, root), *cols) == rows(want, *cols)
    with pytest.raises(ValueError):                                         # it must say which deltas it holds
        state.write_version(state.read_latest(spark, root), root)
    table, folded = state.read_snapshot(spark, root)
    state.write_version(table, root, folded=folded)                         # compaction
    assert all(state.has_delta(spark, root, "inserts", name.rpartition("/")[2]) for name in folded)
    assert state._deltas(spark, root, "inserts") == [] and rows(state.read_latest(spark, root), *cols) == rows(want, *cols)


def test_deltas_written_during_a_compaction_stay(spark):
    """A delta that lands between the read and the write of the next version, of either
    kind, is in force on top of it, once; a replay of its batch finds it."""
    root = scratch_path(spark, f"test_between_{uuid.uuid4().hex}")
    schema = "id long, title string, company string, url string, stage string, sub_stage string"
    row = lambda i, stage="To Apply": spark.createDataFrame([(i, f"t{i}", "c", f"u{i}", stage, None)], schema)
    update = lambda i, stage: spark.createDataFrame([(i, 1, stage, None)], "id long, seq long, new_stage string, new_sub_stage string")
    state.write_version(row(1).unionByName(row(2)), root)
    state.write_delta(row(3), root, "inserts", "a")
    state.write_delta(update(1, "Applied"), root, "updates", "a")
    table, folded = state.read_snapshot(spark, root)
    state.write_delta(row(4), root, "inserts", "b")
    state.write_delta(update(2, "Declined"), root, "updates", "b")
    state.write_version(table, root, folded=folded)
    want = [(1, "Applied"), (2, "Declined"), (3, "To Apply"), (4, "To Apply")]
    assert rows(state.read_latest(spark, root), "id", "stage") == want
    assert state.has_delta(spark, root, "inserts", "a") and state.has_delta(spark, root, "inserts", "b")
    table, folded = state.read_snapshot(spark, root)
    assert folded == ["inserts/b", "updates/b"]
    state.write_delta(update(1, "Declined"), root, "updates", "c")            # a later update wins over the version's
    state.write_version(table, root, folded=folded)
    assert rows(state.read_latest(spark, root), "id", "stage") == [(1, "Declined"), *want[1:]]
    assert state._deltas(spark, root, "inserts") == [] and len(state._deltas(spark, root, "updates")) == 1


def test_mail_stream_over_micro_batches_equals_batches(spark):
    from postline.sources.mail import render_rfc822
    jobs = tb.mail_jobs(spark, SF_SMALL).withColumn("sub_stage", F.lit(None).cast("string"))
    msgs = tb.messages(spark, SF_SMALL)
    base = scratch_path(spark, f"test_mail_{uuid.uuid4().hex}")
    want = jobs
    cut = msgs.agg(F.expr("percentile(seq, 0.5)")).first()[0]
    for part in (msgs.where(F.col("seq") <= cut), msgs.where(F.col("seq") > cut)):
        render_rfc822(part).coalesce(1).write.mode("append").parquet(f"{base}/raw")
        want = state.apply_updates(want, cycle.mail_updates(part, want))
    streams.seed_table(jobs, f"{base}/jobs")
    raw = spark.readStream.schema("seq bigint, content binary").option("maxFilesPerTrigger", 1).parquet(f"{base}/raw")
    streams.mail_updates_stream(spark, "", f"{base}/jobs", f"{base}/ck", raw=raw)
    assert rows(state.read_latest(spark, f"{base}/jobs"), "id", "stage", "sub_stage") == rows(want, "id", "stage", "sub_stage")
    assert len(state._deltas(spark, f"{base}/jobs", "updates")) == 2


def test_mail_from_files_with_errors(spark, tmp_path):
    """.eml files: numbered by arrival; what can't be parsed or applied goes to the error table."""
    import os
    jobs = spark.createDataFrame([(1, "acme", "To Apply", None), (2, "beta corp", "To Apply", None)], "id long, company string, stage string, sub_stage string")
    jobs = jobs.withColumn("date_found", F.lit("2024-01-01").cast("timestamp"))
    mails = {"b": ("hr@acme.com", "Subject: hi\r\n", "unfortunately"), "a": ("hr@acme.com", "Subject: hi\r\n", "x" * 3000 + " hr screen"),
             "c": ("x@beta.com", "", "no subject"), "d": ("x@beta.com", "Subject: odd\r\n", "offer")}
    for k, (name, (sender, subject, body)) in enumerate(mails.items()):
        path = tmp_path / f"{name}.eml"
        path.write_text(f"From: {sender}\r\n{subject}Content-Type: text/plain\r\n\r\n{body}")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    (tmp_path / "note.txt").write_text("no mail")
    from postline.sources import mail
    read = mail.parse_messages(mail.read_messages(spark, str(tmp_path))).orderBy("seq").collect()
    assert [(r.seq, (r.body or "")[:3], r.error is None) for r in read] == [(1, "unf", True), (2, "xxx", True), (3, "", False), (4, "off", True)]
    assert len(read[2].error) > 5

    def classifier(subject, body, company):
        if subject == "odd":
            return {"is_relevant_update": True, "new_stage": "Hired!!", "new_sub_stage": None}
        return {"is_relevant_update": True, "new_stage": "Declined" if "unfort" in body else "In Process", "new_sub_stage": None}

    base = scratch_path(spark, f"test_eml_{uuid.uuid4().hex}")
    streams.seed_table(jobs, f"{base}/jobs")
    streams.mail_updates_stream(spark, "", f"{base}/jobs", f"{base}/ck", classifier, raw=mail.read_messages_stream(spark, str(tmp_path)))
    assert rows(state.read_latest(spark, f"{base}/jobs"), "id", "stage") == [(1, "In Process"), (2, "To Apply")]
    errors = state.read_deltas(spark, f"{base}/jobs", "errors").orderBy("seq").collect()
    assert [e.seq for e in errors] == [3, 4] and "Hired!!" in errors[1].error


def test_messages_are_dealt_by_rows(spark, tmp_path):
    """Messages of one small file are parsed by several tasks, in the stream and in its replay (names
    may be null, keys repeat)."""
    from postline.plans import registry
    from postline.sources import mail
    n = 2 * mail.MESSAGES_PER_TASK + 1000
    events = spark.range(n).select((F.col("id") - F.when(F.col("id") % 100 == 99, 1).otherwise(0)).alias("event_id"), F.lit("view").alias("event_type"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    names = F.when(F.col("id") != 7, F.format_string("part %d", "id"))
    spark.range(10).select(F.col("id").alias("p_partkey"), names.alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    want = [(k, f"part-{k % 10}@mail.com", "update" if k % 2 else f"part {k % 10}") for k in (i - (i % 100 == 99) for i in range(n)) if k % 10 != 7]
    s4 = registry.s4(spark, str(tmp_path))
    assert len(s4.inputFiles()) == 3 and rows(s4) == sorted(want)
    s5 = registry.s5(spark, str(tmp_path))
    assert max(r["count"] for r in s5.groupBy(F.spark_partition_id()).count().collect()) <= mail.MESSAGES_PER_TASK
    assert rows(s5, "seq", "sender", "subject") == sorted(want)


def test_hourly_metrics_stream_equals_batch_with_late_rows(spark):
    a = tb.attempts(spark, SF_SMALL)
    base = scratch_path(spark, f"test_metrics_{uuid.uuid4().hex}")
    _shuffled(a, 4, f"{base}/in")
    for _ in range(2):
        stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        streams.cycle_metrics_stream(spark, stream, f"{base}/out", f"{base}/ck")
    got = streams.read_cycle_metrics(spark, f"{base}/out").select(F.col("w.start").alias("h"), "site", "attempts", "successes")
    want = a.groupBy(F.date_trunc("hour", "ts").alias("h"), "site").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"))
    assert rows(got) == rows(want, "h", "site", "attempts", "successes")


def test_incremental_cycle_equals_full_cycle(spark):
    """Second cycle over the output of a first one: incremental == full."""
    store, batch = tb.store_and_batch(spark, SF_SMALL)
    # empty companies skip the seen check's title test (both must be set), so
    # later batches add rows to existing (title, '') groups: touched groups
    blank = F.when(F.col("id") % 8 <= 3, F.lit("")).otherwise(F.col("company"))
    store, batch = store.withColumn("company", blank), batch.withColumn("company", blank)
    kinds = F.array(*[F.lit(k) for k in ("student position", "entry level role", "junior developer", "position")])
    posts = batch.select(F.col("id").alias("seq"), "title", "company", "url", "location",
                         F.concat_ws(" ", "title", F.element_at(kinds, (F.floor(F.col("id") / 2) % 4 + 1).cast("int")))
                         .alias("description"))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    first = cycle.run_cycle(store, posts.where(F.col("seq") % 4 == 1), now)["store"]
    second = posts.where(F.col("seq") % 4 == 3)
    full = cycle.run_cycle(first, second, now)
    inc = cycle.run_cycle(first, second, now, incremental=True)
    cols = ("id", "title", "url", "stage", "ai_summary")
    assert rows(inc["store"], *cols) == rows(full["store"], *cols)
    summary = inc["summary"].first().asDict()
    assert summary == full["summary"].first().asDict()
    assert summary["duplicates_removed"] > 0 and summary["new_matches"] > 0      # groups were really touched
    assert inc["message"].first()[0] == full["message"].first()[0]


def test_stream_dedup_across_late_micro_batches(spark):
    e = tb.read(spark, SF_SMALL, "events")
    arr = e.withColumn("n", F.lit(e.count())).selectExpr(*tb.ARRIVALS, "CAST(ts AS TIMESTAMP) AS ts", "event_id AS id")
    base = scratch_path(spark, f"test_dedup_{uuid.uuid4().hex}")
    _shuffled(arr, 3, f"{base}/in")
    stream = spark.readStream.schema(arr.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    streams.run_available_now(streams.stream_dedup(stream).writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/ck")
    out = spark.read.parquet(f"{base}/out")
    assert rows(out.select("url")) == rows(arr.select("url").distinct())      # each URL passed once, over 3 batches


def test_dedup_stream_passes_each_key_once_without_state(spark):
    """Twenty micro-batches of repeated, late and missing keys; a replay from the start changes nothing."""
    base = scratch_path(spark, f"test_passed_{uuid.uuid4().hex}")
    assert streams.read_passed(spark, f"{base}/out") is None
    keys = [[f"u{(b * 7 + i * 3) % 23 if b < 18 else i % 3}" if i else None for i in range(12)] for b in range(20)]
    for b, part in enumerate(keys):
        spark.createDataFrame([(k, b) for k in part], "url string, batch_no int").coalesce(1).write.mode("append").parquet(f"{base}/in")
    want = sorted({k or "" for part in keys for k in part})
    first = {k: min(b for b, part in enumerate(keys) if k in part) for k in {k for part in keys for k in part}}
    for ck in ("ck", "ck", "ck_again"):
        stream = spark.readStream.schema("url string, batch_no int").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        streams.dedup_stream(spark, stream, f"{base}/out", f"{base}/{ck}", buckets=5)
        got = streams.read_passed(spark, f"{base}/out").collect()
        assert sorted(r.url or "" for r in got) == want and all(r.batch_no == first[r.url] for r in got)
    fs, p = state._fs(spark, f"{base}/ck/state")
    assert not fs.exists(p)


def test_metrics_are_summed_up_every_few_batches(spark):
    a = tb.attempts(spark, SF_SMALL)
    base = scratch_path(spark, f"test_sums_{uuid.uuid4().hex}")
    _shuffled(a, 10, f"{base}/in")
    for ck in ("ck", "ck_again"):
        stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        streams.cycle_metrics_stream(spark, stream, f"{base}/out", f"{base}/{ck}", compact_every=4)
        read = streams._metric_folders(spark, f"{base}/out")
        assert [p.rpartition("/")[2] for p in read] == ["sum=000008", "v=000009", "v=000010"]
        got = streams.read_cycle_metrics(spark, f"{base}/out").select(F.col("w.start").alias("h"), "site", "attempts", "successes", "jobs_found")
        want = streams.cycle_metrics(a).select(F.col("w.start").alias("h"), "site", "attempts", "successes", "jobs_found")
        assert rows(got) == rows(want)


def test_cache_stream_equals_batch(spark):
    """The cache after any micro-batch is that of all attempts so far, in at most two versions; J6 reads it."""
    from postline.functions import urls
    from postline.operators import joins
    a = tb.attempts(spark, SF_SMALL)
    base = scratch_path(spark, f"test_cache_{uuid.uuid4().hex}")
    streams.seed_table(spark.createDataFrame([], streams.CACHE), f"{base}/cache")
    empty = spark.createDataFrame([], streams.CACHE)
    for part in range(3):
        _shuffled(a.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) == part), 2, f"{base}/in")
        stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        streams.result_cache_stream(spark, stream, f"{base}/cache", f"{base}/ck", keep=20)
        seen = a.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)) <= part)
        assert rows(state.read_latest(spark, f"{base}/cache")) == rows(streams.merge_cache(empty, seen, keep=20))
    assert len(state._versions(spark, f"{base}/cache")) <= 2
    now = F.lit(a.agg(F.max("ts")).first()[0])
    cache = state.read_latest(spark, f"{base}/cache")
    tasks = a.select("site", "query").distinct().withColumn("task_key", urls.task_key(F.col("site"), F.col("query")))
    fresh = [r[0] for r in cache.where(F.col("expiry") > now).select("task_key").collect()]
    results = tasks.join(cache, "task_key").select("site", "query", "fetched_at")
    to_fetch, reused = joins.skip_fresh(tasks.drop("task_key"), results, now)
    assert to_fetch.count() == tasks.where(~F.col("task_key").isin(fresh)).count() and reused.count() == len(fresh) > 0


def test_continuous_ingest_picks_up_new_files(spark):
    store, batch = tb.store_and_batch(spark, SF_SMALL)
    postings = batch.select(F.col("id").alias("seq"), "title", "company", "url", "location",
                            F.concat_ws(" ", F.col("title"), F.lit("position")).alias("description"))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    base = scratch_path(spark, f"test_cont_{uuid.uuid4().hex}")
    streams.seed_table(store, f"{base}/store")
    postings.where(F.col("seq") % 4 == 1).write.parquet(f"{base}/in/part1")
    q = streams.ingest_stream(spark, f"{base}/in/*", f"{base}/store", f"{base}/ck", postings.schema, now=now,
                              every="1 second")
    try:
        q.processAllAvailable()
        postings.where(F.col("seq") % 4 == 3).write.parquet(f"{base}/in/part2")
        q.processAllAvailable()
    finally:
        q.stop()
    streamed = state.read_latest(spark, f"{base}/store")
    batch_store = cycle.ingest(cycle.ingest(store, postings.where(F.col("seq") % 4 == 1), now)["store"],
                               postings.where(F.col("seq") % 4 == 3), now)["store"]
    assert rows(streamed, "id", "url", "stage") == rows(batch_store, "id", "url", "stage")
