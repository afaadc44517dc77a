"""Structured Streaming forms of the pipeline.

The batch operators are reused unchanged: a stream either applies them
per row or hands each micro-batch to ``foreachBatch`` (T1 ingest, T2 dedup, T3
mail updates, T4 breaker state, T5 hourly metrics).  T1, T2, T3 and T5 write what
the micro-batch adds; T4 rewrites its own small state, whose size a horizon bounds.

Exactly-once with a non-transactional table: what a micro-batch writes is a
folder named after it.  A replayed batch (after a driver or executor loss) finds
its folder complete and does nothing, or writes the same again; an interrupted write leaves a folder
without ``_SUCCESS``, which readers skip and the replay overwrites.

No row is dropped for being late: T2 looks keys up in all it has passed, T4 keeps what a
late success could change (within its horizon, if it has one), T5 adds partial counts up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postline import rules
from postline.functions import urls
from postline.operators import reports, state
from postline.plans import cycle
from postline.session import drop_scratch, remember_scratch, scratch_path, written
from postline.sources import mail


def run_available_now(writer, checkpoint: str) -> None:
    """Process everything available, then stop (the ``--single`` run of the
    hourly cycle; use ``trigger(processingTime='1 hour')`` for the loop)."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_stream(writer, checkpoint: str, every: str | None = None):
    """``every=None``: process what is available and stop.  Otherwise start
    a continuous query with a processing-time trigger (the hourly cycle is
    ``every='1 hour'``) and return it; the caller stops or awaits it."""
    if every is None:
        run_available_now(writer, checkpoint)
        return None
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def _version_path(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/v={batch_id + 1:06d}"


def _done(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _base_version(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The newest complete version written before micro-batch ``batch_id``."""
    vs = [v for v in state._versions(spark, root) if v <= batch_id]
    if not vs:
        raise RuntimeError(f"no seed version under {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/v={vs[-1]:06d}")


def seed_table(df: DataFrame, root: str) -> str:
    """Write version 0 (the table before the stream starts)."""
    path = f"{root.rstrip('/')}/v=000000"
    df.write.mode("overwrite").parquet(path)
    return path


# ---------------------------------------------------------------------------
# Ingest stream
# ---------------------------------------------------------------------------
def ingest_stream(spark: SparkSession, postings_path: str, store_root: str, checkpoint: str,
                  schema, now: Column | None = None, scorer: Callable | None = None, every: str | None = None,
                  files_per_batch: int | None = None):
    """New posting files -> in-batch admission, seen check, pre-filter,
    scoring, routing and append (``cycle.ingest``).  Each micro-batch writes
    its inserted rows as a delta of the store (``state.read_latest`` reads them).  Known
    postings are found in the version's key index and the deltas since; the
    store itself isn't read."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    tag = _stream_tag(checkpoint)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if state.has_delta(spark, store_root, "inserts", f"{tag}-{batch_id:09d}"):
            return                                             # replayed batch: already applied
        stamp = F.current_timestamp() if now is None else now
        step = cycle.ingest(None, batch, stamp, scorer, state.key_index(spark, store_root))
        state.write_delta(step["inserted"], store_root, "inserts", f"{tag}-{batch_id:09d}")
        drop_scratch(spark)           # the batch's lineage cuts are no longer read

    return run_stream(reader.parquet(postings_path).writeStream.foreachBatch(per_batch), checkpoint, every)


# ---------------------------------------------------------------------------
# Stream dedup
# ---------------------------------------------------------------------------
PASSED_BUCKETS = 16


def stream_dedup(stream: DataFrame, key: str = "url") -> DataFrame:
    """T2 as a streaming operator: a posting is passed on the first time its key is seen, and never
    again.  The state is one entry a key, kept for good (in RocksDB, see
    ``session.SESSION_DEFAULTS``); ``dedup_stream`` needs none."""
    return stream.dropDuplicates([key])


def dedup_stream(spark: SparkSession, stream: DataFrame, out_path: str, checkpoint: str, key: str = "url",
                 buckets: int = PASSED_BUCKETS, every: str | None = None):
    """T2 with a sink: passes each key once, without any streaming state.  What was passed is the
    sink's own table, one folder a micro-batch and hash bucket of the key; a micro-batch is
    reduced to one row a key, and keys that earlier micro-batches passed are looked up in
    the buckets that it hits.  Nothing is forgotten, so nothing is passed twice or lost however late it
    comes; a replayed micro-batch replaces its own folder and looks only at earlier ones.  Keys are compared as
    text; rows without a key are one key."""
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("_key", name).dropDuplicates(["_key"]).withColumn("bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
        keyed = written(keyed, "dedup_batch")
        target = f"{out_path.rstrip('/')}/batch={batch_id}"
        passed = _passed(spark, out_path, batch_id)
        if passed is not None:
            hit = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]        # as many as buckets at most
            old = passed.where(F.col("bucket").isin(hit)).select(name.alias("_key")).join(keyed.select("_key"), "_key", "left_semi")
            keyed = keyed.join(old, "_key", "left_anti")
        keyed.drop("_key").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        drop_scratch(spark)

    return run_stream(stream.writeStream.foreachBatch(per_batch), checkpoint, every)


def _passed(spark: SparkSession, out_path: str, before: int | None = None) -> DataFrame | None:
    """What complete micro-batches (earlier than ``before``) have passed."""
    fs, path = state._fs(spark, out_path)
    if not fs.exists(path):
        return None
    names = [st.getPath().getName() for st in fs.listStatus(path)]
    ids = sorted(int(n[6:]) for n in names if n.startswith("batch=") and _done(spark, f"{out_path.rstrip('/')}/{n}"))
    # a micro-batch that passed nothing has no files, and so no schema
    paths = [f"{out_path.rstrip('/')}/batch={i}" for i in ids if before is None or i < before]
    paths = [p for p in paths if any(st.getPath().getName().startswith("bucket=") for st in fs.listStatus(state._fs(spark, p)[1]))]
    return spark.read.option("basePath", out_path).parquet(*paths) if paths else None


def read_passed(spark: SparkSession, out_path: str) -> DataFrame | None:
    """Everything that ``dedup_stream`` has passed (None before its first posting)."""
    found = _passed(spark, out_path)
    return None if found is None else found.drop("batch", "bucket")


# ---------------------------------------------------------------------------
# Mail -> stage updates
# ---------------------------------------------------------------------------
def read_message_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """S4 over a table of raw messages (seq, content): every file of the
    table is delivered once; the query checkpoint plays the UNSEEN flag."""
    return spark.readStream.schema("seq bigint, content binary").parquet(path)


def _stream_tag(checkpoint: str) -> str:
    return hashlib.md5(checkpoint.encode("utf-8")).hexdigest()[:12]


def mail_updates_stream(spark: SparkSession, raw_path: str, jobs_root: str, checkpoint: str,
                        classifier: Callable | None = None, every: str | None = None, raw: DataFrame | None = None):
    """Each micro-batch of raw messages is parsed (S5), matched against a
    snapshot of the active jobs taken once per batch (J3), classified (X2),
    fanned out (J4), reduced to the last update per job (A4) and written as a delta of
    updates, which readers lay over the table (S8).  Messages that can't be parsed
    and classifications that may not be applied go to the delta ``errors`` (seq, error).
    ``raw`` replaces the message table, e.g. by ``mail.read_messages_stream``."""
    raw = read_message_table_stream(spark, raw_path) if raw is None else raw
    tag = _stream_tag(checkpoint)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        name = f"{tag}-{batch_id:09d}"
        if state.has_delta(spark, jobs_root, "updates", name):
            return
        jobs = state.read_latest(spark, jobs_root)
        if "seq" not in batch.columns:
            batch = mail.number_messages(batch, batch_id)
        parsed = written(mail.parse_messages(mail.dealt(batch)), "parsed")
        updates, invalid = cycle.mail_outcomes(parsed.where(F.col("error").isNull()), jobs, classifier)
        errors = parsed.where(F.col("error").isNotNull()).select("seq", "error").unionByName(
            invalid.select("seq", F.concat(F.lit("classification not applied: "), F.to_json("classification")).alias("error")))
        state.write_delta(errors, jobs_root, "errors", name)
        state.write_delta(updates, jobs_root, "updates", name)      # last: it marks the batch as applied
        drop_scratch(spark)

    return run_stream(raw.writeStream.foreachBatch(per_batch), checkpoint, every)


# ---------------------------------------------------------------------------
# T4: breaker state per site
# ---------------------------------------------------------------------------
BREAKER_STATE = "site string, ts timestamp, id bigint, success boolean, n bigint"


def merge_breaker_state(old: DataFrame, batch: DataFrame, horizon_seconds: int | None = None, threshold: int = rules.BREAKER_THRESHOLD,
                        recovery_seconds: int = rules.BREAKER_RECOVERY_SECONDS) -> DataFrame:
    """The state after one more micro-batch: per site the last success (by time, then id)
    and the failures after it.  Attempts may
    come in any order and more than once; what an earlier or later success does to
    them is decided by their time, not by their batch.

    With a horizon, failures older than a site's newest attempt by more than it are
    settled: one row a site (``n`` of them, ``ts`` of the last) stands for them all, so a
    site that never succeeds keeps one horizon of failures, however long it fails.  The counts are
    exact as long as no attempt comes later than the horizon.  One that does: a failure counts on; a
    success clears what it is not older than, and settled failures after it keep the earlier ones alive."""
    rows = batch.select("site", "ts", "id", "success", F.lit(None).cast("bigint").alias("n"))
    every = old.unionByName(rows, allowMissingColumns=True).dropDuplicates(["site", "ts", "id", "success", "n"])
    order = F.struct(F.col("ts"), F.col("id"))
    last = every.where("success").groupBy("site").agg(F.max(order).alias("_last"))
    kept = every.join(last, "site", "left").where(F.col("_last").isNull() | F.when(F.col("n").isNotNull(), F.col("ts") > F.col("_last.ts"))
                                                  .otherwise(order >= F.col("_last"))).drop("_last")
    if horizon_seconds is None:
        return kept
    edge = kept.groupBy("site").agg((F.max("ts") - F.make_dt_interval(secs=F.lit(horizon_seconds))).alias("_edge"))
    kept = written(kept.join(edge, "site").withColumn("_old", F.col("n").isNull() & ~F.col("success") & (F.col("ts") < F.col("_edge"))), "breaker_kept")
    before = kept.where("n is not null").select("site", "n", F.unix_micros("ts").alias("b"))
    counts = reports.breaker_counts(kept.where("_old").select("site", "ts", "id", "success"), threshold, recovery_seconds, before)
    settled = counts.select("site", F.col("last_failure_ts").alias("ts"), F.lit(None).cast("bigint").alias("id"), F.lit(False).alias("success"),
                            F.col("trailing_failures").alias("n"))
    return kept.where("n is null and not _old").drop("_edge", "_old").unionByName(settled)


def breaker_stream(spark: SparkSession, attempts: DataFrame, state_root: str, checkpoint: str, horizon_seconds: int | None = None) -> None:
    """T4: keeps what decides each site's breaker as a versioned table, the two newest
    versions of it."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        target = _version_path(state_root, batch_id)
        if _done(spark, target):
            return
        old = _base_version(spark, state_root, batch_id)
        merge_breaker_state(old, batch, horizon_seconds).write.mode("overwrite").parquet(target)
        drop_scratch(spark)
        _drop_versions(spark, state_root, batch_id)

    run_available_now(attempts.writeStream.foreachBatch(per_batch), checkpoint)


def _drop_versions(spark: SparkSession, root: str, batch_id: int) -> None:
    """Versions before the one that a replay of the micro-batch reads."""
    for v in state._versions(spark, root):
        if v < batch_id:
            fs, path = state._fs(spark, f"{root.rstrip('/')}/v={v:06d}")
            fs.delete(path, True)


def breaker_open(st: DataFrame, now: Column, threshold: int = rules.BREAKER_THRESHOLD,
                 recovery_seconds: int = rules.BREAKER_RECOVERY_SECONDS) -> DataFrame:
    """G7 over the streamed state."""
    settled = st.where("n is not null").select("site", "n", F.unix_micros("ts").alias("b"))
    counts = reports.breaker_counts(st.where("n is null").drop("n"), threshold, recovery_seconds, settled)
    return reports.breaker_check(counts, now, threshold, recovery_seconds)


# ---------------------------------------------------------------------------
# T5: attempts per site per hour
# ---------------------------------------------------------------------------
def cycle_metrics(attempts: DataFrame) -> DataFrame:
    """T5: attempts, successes and postings found per site per tumbling hour."""
    return (attempts.groupBy(F.window("ts", "1 hour").alias("w"), "site")
            .agg(F.count(F.lit(1)).cast("bigint").alias("attempts"),
                 F.count_if(F.col("success")).cast("bigint").alias("successes"),
                 F.coalesce(F.sum("jobs_found"), F.lit(0)).cast("bigint").alias("jobs_found")))


COUNTS = ("attempts", "successes", "jobs_found")


def cycle_metrics_stream(spark: SparkSession, attempts: DataFrame, out_path: str, checkpoint: str, compact_every: int = 8) -> None:
    """T5 sink: every micro-batch writes the counts of its own rows, in a folder of its own;
    late rows are so merged into their hour as corrections.  Every ``compact_every`` micro-batches all counts so far are
    added up into one table (``sum=<n>``), and readers start from the newest: what they read
    follows the hours, plus a bounded number of micro-batches."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        cycle_metrics(batch).write.mode("overwrite").parquet(_version_path(out_path, batch_id))
        if batch_id % compact_every == compact_every - 1:
            _summed(spark, out_path, batch_id + 1).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/sum={batch_id + 1:06d}")

    run_available_now(attempts.writeStream.foreachBatch(per_batch), checkpoint)


def _metric_folders(spark: SparkSession, out_path: str, upto: int | None = None) -> list[str]:
    """The newest complete sum (before ``upto``, if given) and the micro-batches after it."""
    fs, path = state._fs(spark, out_path)
    sums = [int(st.getPath().getName()[4:]) for st in fs.listStatus(path) if st.getPath().getName().startswith("sum=")]
    sums = [n for n in sums if (upto is None or n < upto) and _done(spark, f"{out_path.rstrip('/')}/sum={n:06d}")]
    start = max(sums, default=0)
    batches = [v for v in state._versions(spark, out_path) if v > start and (upto is None or v <= upto)]
    return [f"{out_path.rstrip('/')}/sum={start:06d}"] * bool(start) + [f"{out_path.rstrip('/')}/v={v:06d}" for v in batches]


def _summed(spark: SparkSession, out_path: str, upto: int | None = None) -> DataFrame:
    parts = spark.read.parquet(*_metric_folders(spark, out_path, upto))
    return parts.groupBy("w", "site").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTS])


def read_cycle_metrics(spark: SparkSession, out_path: str) -> DataFrame:
    """The counts of all micro-batches added up; late rows count in their hour."""
    return _summed(spark, out_path)


# ---------------------------------------------------------------------------
# Result cache (K5, J6) over a stream of attempts
# ---------------------------------------------------------------------------
CACHE = "task_key string, fetched_at timestamp, expiry timestamp"


def merge_cache(old: DataFrame, attempts: DataFrame, keep: int = rules.CACHE_MAX_ENTRIES, ttl_seconds: int = rules.CACHE_TTL_SECONDS) -> DataFrame:
    """The cache (task_key, fetched_at, expiry) after more attempts: the last success of each task, and of
    these the newest ``keep`` by expiry.  Both are the same whether attempts come at once or in parts, in any order."""
    done = attempts.where("success").select(urls.task_key(F.col("site"), F.col("query")).alias("task_key"), F.col("ts").alias("fetched_at"))
    last = old.select("task_key", "fetched_at").unionByName(done).groupBy("task_key").agg(F.max("fetched_at").alias("fetched_at"))
    return reports.evict_cache(last.withColumn("expiry", F.col("fetched_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))), keep)


def result_cache_stream(spark: SparkSession, attempts: DataFrame, root: str, checkpoint: str, keep: int = rules.CACHE_MAX_ENTRIES) -> None:
    """K5 over a stream: a versioned table of at most ``keep`` rows, which J6 (``joins.skip_fresh``) reads."""
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        target = _version_path(root, batch_id)
        if not _done(spark, target):
            merge_cache(_base_version(spark, root, batch_id), batch, keep).coalesce(1).write.mode("overwrite").parquet(target)
            _drop_versions(spark, root, batch_id)

    run_available_now(attempts.writeStream.foreachBatch(per_batch), checkpoint)


def stream_scratch(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh (data, checkpoint) folder pair in the shared checkpoint folder."""
    import uuid
    base = remember_scratch(scratch_path(spark, f"stream_{name}_{uuid.uuid4().hex}"))
    return f"{base}/data", f"{base}/checkpoint"
