"""Table state changes (S7-S9, S11) and versioned writes.

There is no transactional table format in this environment, so a table is
a folder of versions (``v=000001`` ...); every change writes a new version
next to the old one and readers take the highest complete version.  A
failed job leaves at most an incomplete folder without ``_SUCCESS``,
which readers skip.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postline import rules
from postline.functions import urls
from postline.functions.evaluation import truncate_text
from postline.operators import dedup, seen
from postline.operators.seen import KeyIndex


def append_new(jobs: DataFrame | None, batch: DataFrame, now: Column, index: KeyIndex | None = None) -> DataFrame:
    """Rows to insert: canonical URL, URL conflicts (with stored rows or
    earlier batch rows) silently skipped, ``date_found`` stamped, new ids
    continuing after the stored maximum in arrival order.  Rows without a
    title, company or URL are left out first: the table forbids them.  With an
    ``index`` of the stored keys, ``jobs`` is not read."""
    b = batch.where(F.col("title").isNotNull() & F.col("company").isNotNull() & F.col("url").isNotNull())
    b = b.withColumn("url", urls.normalize_url(F.col("url")))
    if index is None:
        # stored URLs restricted to the batch's URLs first (bounded by the batch)
        known = jobs.select("url").join(b.select("url").distinct(), "url", "left_semi").distinct()
        b = b.join(known, "url", "left_anti")
        # the stored maximum is a scalar subquery: evaluated once, no join
        max_id = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    else:
        key = seen.url_key(F.col("url"))
        known = index.known(b.select(key.alias("key")))
        b = b.withColumn("_ku", key).join(known.withColumnRenamed("key", "_ku"), "_ku", "left_anti").drop("_ku")
        max_id = index.largest_id()
    # first arrival per URL wins (a conflicting later insert is ignored)
    b = dedup.keep_best(b, ["url"], [F.col("seq")])
    from postline.operators.reports import global_positions
    numbered = global_positions(b.withColumn("_all", F.lit(1)), ["_all"], [F.col("seq")], out="_n").drop("_all")
    return numbered.select(
        (max_id + F.col("_n")).alias("id"), "title", "company", "url",
        now.alias("date_found"), "ai_summary", F.coalesce(F.col("stage"), F.lit("To Apply")).alias("stage"),
        F.lit(None).cast("string").alias("sub_stage"),
        F.coalesce(F.col("location"), F.lit(rules.NOT_SPECIFIED)).alias("location"))


def apply_updates(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Keyed update of stage and sub_stage; an update without a sub-stage
    clears it (NULL is a real new value, so no coalesce)."""
    u = updates.select("id", F.col("new_stage").alias("_ns"), F.col("new_sub_stage").alias("_nss"),
                       F.lit(True).alias("_hit"))
    j = jobs.join(u, "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return (j.withColumn("stage", F.when(hit, F.col("_ns")).otherwise(F.col("stage")))
            .withColumn("sub_stage", F.when(hit, F.col("_nss")).otherwise(F.col("sub_stage")))
            .drop("_ns", "_nss", "_hit"))


def evolve_schema(old: DataFrame) -> DataFrame:
    """Add stage / sub_stage / location when missing.  A new stage
    column is backfilled Irrelevant for legacy summaries (LIKE ignores ASCII
    case in SQLite, hence ilike); NULL summaries stay To Apply."""
    out = old
    if "stage" not in out.columns:
        s = F.col("ai_summary")
        legacy = s.ilike("Irrelevant:%") | s.ilike('%"is_relevant": false%')
        out = out.withColumn("stage", F.when(F.coalesce(legacy, F.lit(False)), F.lit("Irrelevant")).otherwise(F.lit("To Apply")))
    if "sub_stage" not in out.columns:
        out = out.withColumn("sub_stage", F.lit(None).cast("string"))
    if "location" not in out.columns:
        out = out.withColumn("location", F.lit(rules.NOT_SPECIFIED))
    return out


# ---------------------------------------------------------------------------
# Versioned table folders
# ---------------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, root: str, complete_only: bool = True) -> list[int]:
    """Version numbers under ``root``: complete ones (with ``_SUCCESS``), or
    every folder when choosing the next number (a crashed write leaves an
    incomplete folder that must not be reused)."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and (not complete_only or fs.exists(
                spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))):
            out.append(int(name[2:]))
    return sorted(out)


def has_marker(spark: SparkSession, root: str, marker: str) -> bool:
    """Whether the newest complete version carries ``marker`` (see ``write_version``)."""
    vs = _versions(spark, root)
    if not vs:
        return False
    fs, p = _fs(spark, f"{root.rstrip('/')}/v={vs[-1]:06d}/{marker}")
    return fs.exists(p)


def read_snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, list[str]] | None:
    """The newest complete version with its deltas (inserted rows added, then the last
    update of each id laid over, S8), and the names of the deltas it holds."""
    vs = _versions(spark, root)
    if not vs:
        return None
    base = spark.read.parquet(f"{root.rstrip('/')}/v={vs[-1]:06d}")
    paths = {kind: _deltas(spark, root, kind) for kind in FOLDED}
    if paths["inserts"]:
        base = base.unionByName(spark.read.parquet(*paths["inserts"]).drop("_n"), allowMissingColumns=True)
    if paths["updates"]:
        updates = spark.read.parquet(*paths["updates"])
        last = updates.groupBy("id").agg(F.max(F.struct("_n", "seq", "new_stage", "new_sub_stage")).alias("u"))
        base = apply_updates(base, last.select("id", "u.new_stage", "u.new_sub_stage"))
    return base, [_delta_name(kind, p) for kind in FOLDED for p in paths[kind]]


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The table of ``read_snapshot``."""
    found = read_snapshot(spark, root)
    return None if found is None else found[0]


def write_version(df: DataFrame, root: str, partition_by: str | None = "stage", marker: str | None = None, folded: list[str] | None = None) -> str:
    """Write ``df`` as the next version; partitioned by stage so
    S1's stage predicate prunes folders.  The data are written beside and renamed
    to the version's folder, so two writers never mix files in one version.  ``marker`` is
    a file in it (its name starts with '_', which readers ignore).

    ``folded`` names the deltas that ``df`` holds (``read_snapshot``).  The version
    records them; every other delta, also one that is written meanwhile, stays in force on top
    of it.  Without it the table may have no deltas."""
    spark = df.sparkSession
    vs = _versions(spark, root, complete_only=False)
    if folded is None:
        folded = []
        if any(_deltas(spark, root, kind) for kind in FOLDED):
            raise ValueError(f"{root} has deltas: pass the names that read_snapshot gave")
    done = _folded(spark, root) | set(folded)
    target = f"{root.rstrip('/')}/v={(vs[-1] + 1 if vs else 1):06d}"
    made = f"{root.rstrip('/')}/_writing_{uuid.uuid4().hex}"
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(made)
    for name, text in ((marker, ""), (FOLDED_FILE, "\n".join(sorted(done)))):
        if name:
            fs, p = _fs(spark, f"{made}/{name}")
            out = fs.create(p, False)
            out.write(bytearray(text.encode("utf-8")))
            out.close()
    fs, p = _fs(spark, target)
    if fs.exists(p) or not fs.rename(_fs(spark, made)[1], p):
        raise RuntimeError(f"another job wrote {target}")
    return target


# Deltas: what micro-batches add to the table.  The bytes written follow the batch,
# not the table; ``write_version`` of a snapshot compacts, also beside running streams.
# A delta is a folder ``d/<kind>/<tag>``; the tag names the stream and its
# micro-batch, so a replayed batch is found by its path.
FOLDED = ("inserts", "updates")          # kinds that a version takes in
FOLDED_FILE = "_folded"                  # the names of those that it and earlier versions took in


def _delta_name(kind: str, path: str) -> str:
    return f"{kind}/{path.rstrip('/').rpartition('/')[2]}"


def _folded(spark: SparkSession, root: str) -> set[str]:
    vs = _versions(spark, root)
    if not vs:
        return set()
    fs, p = _fs(spark, f"{root.rstrip('/')}/v={vs[-1]:06d}/{FOLDED_FILE}")
    if not fs.exists(p):
        return set()
    stream = fs.open(p)
    try:
        return set(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split())
    finally:
        stream.close()


def _deltas(spark: SparkSession, root: str, kind: str) -> list[str]:
    """Folders of complete deltas that the newest version doesn't hold."""
    fs, path = _fs(spark, f"{root.rstrip('/')}/d/{kind}")
    if not fs.exists(path):
        return []
    done = _folded(spark, root) if kind in FOLDED else set()
    found = [st.getPath().toString() for st in fs.listStatus(path)]
    return sorted(p for p in found if _delta_name(kind, p) not in done and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_deltas(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    paths = _deltas(spark, root, kind)
    return spark.read.parquet(*paths) if paths else None


def has_delta(spark: SparkSession, root: str, kind: str, tag: str) -> bool:
    fs, done = _fs(spark, f"{root.rstrip('/')}/d/{kind}/{tag}/_SUCCESS")
    return fs.exists(done)


def write_delta(df: DataFrame, root: str, kind: str, tag: str) -> None:
    """Later deltas win: ``_n`` is the time of writing."""
    df.withColumn("_n", F.lit(time.time_ns() // 1000)).write.mode("overwrite").parquet(f"{root.rstrip('/')}/d/{kind}/{tag}")


def key_index(spark: SparkSession, root: str) -> KeyIndex:
    """The keys of the newest version as an index (written beside the version when first
    asked for), with the inserts since as its recent rows."""
    version = _versions(spark, root)[-1]
    path = f"{root.rstrip('/')}/k={version:06d}"
    fs, done = _fs(spark, f"{path}/_meta/_SUCCESS")
    if not fs.exists(done):
        made = f"{root.rstrip('/')}/_writing_{uuid.uuid4().hex}"
        written = seen.write_index(spark.read.parquet(f"{root.rstrip('/')}/v={version:06d}"), made)
        spark.sql(f"DROP TABLE {written.table}")             # the files stay
        if not fs.rename(_fs(spark, made)[1], _fs(spark, path)[1]) and not fs.exists(done):
            raise RuntimeError(f"another job writes {path}")
    inserts = read_deltas(spark, root, "inserts")
    return KeyIndex(spark, path, None if inserts is None else inserts.select("url", "title", "company", "id"))


def outbox_sink(messages: DataFrame, path: str, batch: str, limit: int | None = None) -> str:
    """Rendered messages as rows for an external sender.  Each batch is a
    folder of its own, overwritten when the batch is delivered again, so a replay doubles
    nothing.  ``limit`` is the sender's message length (P24), none by default."""
    text = F.col("message") if limit is None else truncate_text(F.col("message"), limit, rules.TRUNCATION_SUFFIX)
    target = f"{path.rstrip('/')}/batch={batch}"
    messages.withColumns({"message": text, "created_at": F.current_timestamp()}).write.mode("overwrite").parquet(target)
    return target
