"""Counts, crawl health, rankings and rendered messages (G2-G8, K1-K5,
F14-F16).

Rankings that must number *every* row of a big group (K1, K2) use
``global_positions``: a range-partitioned sort plus per-partition offsets,
so the numbering is spread over all tasks instead of one task per group.
Top-k reports (K3, K4, K5) are ``orderBy().limit()``, planned as
TakeOrderedAndProject (each task keeps k rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postline import rules
from postline.functions import evaluation as ev
from postline.operators.dedup import trailing_failures, dedup_by_url
from postline.session import written


def global_positions(df: DataFrame, group_cols: list[str], order_cols: list[Column], out: str = "position",
                     num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row inside its group under ``order_cols``.

    Rows are range-partitioned by (group, order) and sorted inside each
    partition; a row's position is its index inside the partition plus the
    number of rows of the same group in earlier partitions.  The offset
    table has one row per (partition, group) present -- for the few-group
    rankings it serves (board columns, one stage, one batch) that is
    bounded by the partition count; AQE broadcasts it after measuring it.
    The numbered rows are written to the shared checkpoint folder once.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group_cols] + list(order_cols)
    s = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    s = s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    # the partition ids and row ids are only consistent within one
    # computation (range bounds come from sampling): write them once and
    # derive both the offsets and the positions from that copy
    s = written(s, "positions")
    stats = s.groupBy("_pid", *group_cols).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    wprev = W.partitionBy(*group_cols).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(wprev), F.lit(0)))
    joined = s.join(stats.select("_pid", *group_cols, "_first", "_off"), ["_pid", *group_cols])
    return joined.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint")) \
        .drop("_pid", "_mid", "_first", "_off")


def jobs_by_stage(jobs: DataFrame, stage: str) -> DataFrame:
    """K1: one stage, newest first (ties by id), with the position."""
    one = jobs.where(F.col("stage") == stage)
    return global_positions(one, ["stage"], [F.col("date_found").desc(), F.col("id")])


def kanban_board(jobs: DataFrame, score: Column | None = None) -> DataFrame:
    """K2: the four board columns; inside a column score desc, then date
    desc, then id.  Irrelevant is not shown."""
    s = ev.parse_score(F.col("ai_summary")) if score is None else score
    b = jobs.where(F.col("stage").isin(rules.BOARD_STAGES)).withColumn("score", s)
    return global_positions(b, ["stage"], [F.col("score").desc(), F.col("date_found").desc(), F.col("id")])


def top_jobs(jobs: DataFrame, k: int = 5) -> DataFrame:
    """K3: To Apply rows, deduplicated by URL (A2), best k by score, ties by id."""
    s = jobs.where(F.col("stage") == "To Apply").withColumn("score", ev.parse_score(F.col("ai_summary")))
    return dedup_by_url(s).orderBy(F.col("score").desc(), F.col("id")).limit(k)


def top_new_matches(matches: DataFrame, k: int = 3) -> DataFrame:
    """K4: best k new matches by score, ties by arrival."""
    return matches.orderBy(F.col("score").desc(), F.col("id")).limit(k)


def evict_cache(results: DataFrame, keep: int) -> DataFrame:
    """K5: the newest ``keep`` cache entries by expiry."""
    return results.orderBy(F.col("expiry").desc(), F.col("task_key")).limit(keep)


def stage_counts(jobs: DataFrame) -> DataFrame:
    """Rows per stage."""
    return jobs.groupBy("stage").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def score_tiers(matches: DataFrame, score: str = "score") -> DataFrame:
    """Counts of 95+, 85-94 and 70-84."""
    s = F.col(score)
    return matches.agg(
        F.count_if(s >= 95).cast("bigint").alias("tier_95"),
        F.count_if((s >= 85) & (s < 95)).cast("bigint").alias("tier_85"),
        F.count_if((s >= 70) & (s < 85)).cast("bigint").alias("tier_70"))


def scan_summary(scanned: DataFrame, matches: DataFrame, duplicates_removed: DataFrame,
                 geo_filtered: DataFrame, jobs_after: DataFrame) -> DataFrame:
    """One row of cycle KPIs.  Every input is reduced to one
    (metric, value) row and the rows are pivoted into columns (no join)."""
    parts = [
        scanned.agg(F.lit("total_scanned").alias("metric"), F.count(F.lit(1)).cast("bigint").alias("value")),
        matches.agg(F.lit("new_matches").alias("metric"), F.count(F.lit(1)).cast("bigint").alias("value")),
        duplicates_removed.select(F.lit("duplicates_removed").alias("metric"), F.col("removed").cast("bigint").alias("value")),
        geo_filtered.select(F.lit("geo_filtered").alias("metric"), F.col("geo_filtered").cast("bigint").alias("value")),
        jobs_after.agg(F.lit("total_to_apply").alias("metric"),
                       F.count_if(F.col("stage") == "To Apply").cast("bigint").alias("value")),
    ]
    t = score_tiers(matches)
    for name in ("tier_95", "tier_85", "tier_70"):
        parts.append(t.select(F.lit(name).alias("metric"), F.col(name).alias("value")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    names = ["total_scanned", "new_matches", "duplicates_removed", "geo_filtered", "total_to_apply",
             "tier_95", "tier_85", "tier_70"]
    return long.groupBy().pivot("metric", names).agg(F.first("value"))


def scrape_totals(attempts: DataFrame) -> DataFrame:
    """Tasks succeeded, tasks, postings found."""
    return attempts.agg(F.count_if(F.col("success")).cast("bigint").alias("tasks_succeeded"),
                        F.count(F.lit(1)).cast("bigint").alias("tasks"),
                        F.coalesce(F.sum("jobs_found"), F.lit(0)).cast("bigint").alias("jobs_found"))


def _requests(attempts: DataFrame) -> DataFrame:
    """Attempts that count as requests: cache hits and open-circuit results
    return before any metric is recorded."""
    a = attempts
    if "circuit_open" in a.columns:
        a = a.where(~F.coalesce(F.col("circuit_open"), F.lit(False)))
    return a.where(F.coalesce(F.col("error"), F.lit("")) != "cache_hit")


def site_metrics(attempts: DataFrame) -> DataFrame:
    """Per-site request metrics (F17 guards the ratios)."""
    a = _requests(attempts)
    ok = F.col("success")
    order = F.struct(F.col("ts"), F.col("id"))
    base = a.groupBy("site").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_requests"),
        F.count_if(ok).cast("bigint").alias("successful_requests"),
        F.coalesce(F.sum(F.when(ok, F.col("jobs_found"))), F.lit(0)).cast("bigint").alias("total_jobs_found"),
        F.coalesce(F.sum(F.when(ok, F.col("response_time_ms"))), F.lit(0.0)).alias("total_response_time"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success"),
        F.max_by(F.col("error"), F.when(~ok, order)).alias("last_fail_reason"))
    tf = trailing_failures(a).select("site", F.col("trailing_failures").alias("failures_in_a_row"), "last_failure_ts")
    m = base.join(tf, "site")
    # avg_response_ms divides success time by all requests, as the reference
    # reports it (Q14); avg_success_ms is the mean time of successful requests
    return (m.withColumn("success_rate", ev.guarded_ratio(F.col("successful_requests"), F.col("total_requests"), 1.0))
            .withColumn("avg_response_ms", ev.guarded_ratio(F.col("total_response_time"), F.col("total_requests"), 0.0))
            .withColumn("avg_success_ms", ev.guarded_ratio(F.col("total_response_time"), F.col("successful_requests"), 0.0)))


def health_label(failures_in_a_row: Column, success_rate: Column) -> Column:
    return (F.when(failures_in_a_row >= rules.CIRCUIT_OPEN_AT, F.lit("circuit_open"))
            .when(failures_in_a_row >= rules.FAILING_AT, F.lit("failing"))
            .when(success_rate < rules.DEGRADED_BELOW, F.lit("degraded"))
            .otherwise(F.lit("healthy")))


def health_report(metrics: DataFrame) -> DataFrame:
    """Health label per site; rate in percent and mean time to one
    decimal (half-even, as Python's round on these values)."""
    return metrics.select(
        "site", health_label(F.col("failures_in_a_row"), F.col("success_rate")).alias("health"),
        F.bround(F.col("success_rate") * 100, 1).alias("success_rate"),
        F.bround(F.col("avg_response_ms"), 1).alias("avg_response_ms"),
        "total_requests", F.col("total_jobs_found").alias("jobs_found"))


def breaker_counts(attempts: DataFrame, threshold: int = rules.BREAKER_THRESHOLD,
                   recovery_seconds: int = rules.BREAKER_RECOVERY_SECONDS, settled: DataFrame | None = None) -> DataFrame:
    """The failure count that every site's breaker holds after all its attempts
    (site, trailing_failures, last_failure_ts).

    Each attempt first asks whether the breaker is open; a count at the threshold
    whose last failure is more than ``recovery`` seconds old restarts at 0.  A success sets
    it to 0.  So only failures after the last success count, and of these the gaps of more than the
    window matter.  They are reduced (partial aggregate) to one row for each site
    and window-long time slot: within a slot no gap is that long.  The slots of a
    site, whose number is bounded by the time spanned and not by its attempts, are folded in
    order.

    ``settled`` (site, n, b: one row a site at most) gives counts to begin with, and the time of their last
    failure in microseconds."""
    last_ok = attempts.groupBy("site").agg(F.max(F.when(F.col("success"), F.struct("ts", "id"))).alias("_ok"))
    after = F.col("_ok").isNull() | (F.struct("ts", "id") > F.col("_ok"))
    failed = attempts.where(~F.col("success")).join(last_ok, "site").where(after)
    width = max(1, int(recovery_seconds * 1_000_000))
    slots = failed.groupBy("site", F.floor(F.unix_micros("ts") / width).alias("_slot")).agg(
        F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b"), F.count(F.lit(1)).alias("n"))
    per_site = slots.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("a", "b", "n"))).alias("_slots"))

    def step(s, x):
        restart = (s["n"] >= threshold) & (x["a"] - s["b"] > recovery_seconds * 1_000_000)
        return F.struct((F.when(restart, F.lit(0).cast("bigint")).otherwise(s["n"]) + x["n"]).alias("n"), F.greatest(s["b"], x["b"]).alias("b"))

    zero = F.lit(0).cast("bigint")
    last = attempts.groupBy("site").agg(F.max(F.when(~F.col("success"), F.unix_micros("ts"))).alias("_last"))
    if settled is None:
        every = last.join(per_site, "site", "left").withColumns({"_n": zero, "_b": F.lit(None).cast("bigint")})
    else:
        begin = settled.select("site", F.col("n").alias("_n"), F.col("b").alias("_b"))
        every = last.join(per_site, "site", "left").join(begin, "site", "full").withColumn("_n", F.coalesce("_n", zero))
    slots = F.coalesce("_slots", F.array().cast(per_site.schema["_slots"].dataType))
    count = F.aggregate(slots, F.struct(F.col("_n").alias("n"), F.coalesce("_b", zero).alias("b")), step)["n"]
    return every.select("site", count.cast("bigint").alias("trailing_failures"), F.timestamp_micros(F.greatest("_last", "_b")).alias("last_failure_ts"))


def breaker_state(attempts: DataFrame, now: Column, threshold: int = rules.BREAKER_THRESHOLD,
                  recovery_seconds: int = rules.BREAKER_RECOVERY_SECONDS) -> DataFrame:
    """(site, trailing_failures, is_open) after a check at ``now``: open iff
    the count has reached the threshold and the last failure is no more than
    ``recovery`` seconds old; a count at the threshold whose last failure is older is reset to 0."""
    return breaker_check(breaker_counts(attempts, threshold, recovery_seconds), now, threshold, recovery_seconds)


def breaker_check(state: DataFrame, now: Column, threshold: int = rules.BREAKER_THRESHOLD,
                  recovery_seconds: int = rules.BREAKER_RECOVERY_SECONDS) -> DataFrame:
    """What a check at ``now`` finds of the counts (site, trailing_failures, last_failure_ts)."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_failure_ts"))) / 1e6
    reached = F.col("trailing_failures") >= threshold
    is_open = F.coalesce(reached & (age <= recovery_seconds), F.lit(False))
    count = F.when(reached & ~is_open, F.lit(0).cast("bigint")).otherwise(F.col("trailing_failures"))
    return state.select("site", count.alias("trailing_failures"), is_open.alias("is_open"))


# ---------------------------------------------------------------------------
# Rendering (F14-F16); inputs are bounded (one row, or a top-k)
# ---------------------------------------------------------------------------
# FIXED VALUES -- the message layouts of F14 and F16 below (labels, emoji,
# line breaks, defaults) must equal the reproduced messages; they are kept
# inline in their natural order.
def render_job_message(jobs: DataFrame) -> DataFrame:
    """the single-match message per row."""
    js = F.col("ai_summary")
    text = F.concat(
        F.lit("\U0001F916 *New Job Match!*\n\n*"), F.col("title"), F.lit("* at "), F.col("company"),
        F.lit("\n\U0001F4CD "), ev.json_text(js, "location", rules.NOT_SPECIFIED),
        F.lit(" | \U0001F3AF Score: "), ev.json_text(js, "match_score", "None"),
        F.lit("/100\n✨ "), ev.json_text(js, "key_features", "N/A"),
        F.lit("\n\nSummary: "), ev.json_text(js, "summary", "None"),
        F.lit("\n\nApply here: "), F.col("url"))
    return jobs.select("id", text.alias("message"))


def render_top_jobs(top: DataFrame, dashboard_link: str = "") -> DataFrame:
    """F16: numbered list of the top jobs (input already limited, K3), whole; a
    sender's length limit is the outbox's (``state.outbox_sink``)."""
    js = F.col("ai_summary")
    summary = ev.json_text(js, "summary", "")
    feats = ev.json_text(js, "key_features", "")
    w = W.orderBy(F.col("score").desc(), F.col("id"))
    item = F.concat(
        F.lit("*"), F.col("rank").cast("string"), F.lit(". "), F.coalesce(F.col("title"), F.lit("Unknown")), F.lit("*\n"),
        F.lit("   @ "), F.coalesce(F.col("company"), F.lit("Unknown")), F.lit("\n"),
        F.lit("   Score: "), F.col("score").cast("string"), F.lit("/100 | "), ev.json_text(js, "location", rules.NOT_SPECIFIED),
        F.lit("\n"),
        F.when(ev.json_truthy(js, "summary"), F.concat(F.lit("   "), summary, F.lit("\n"))).otherwise(F.lit("")),
        F.when(ev.json_truthy(js, "key_features"), F.concat(F.lit("   "), feats, F.lit("\n"))).otherwise(F.lit("")),
        F.lit("   Apply: "), F.coalesce(F.col("url"), F.lit("")), F.lit("\n\n"))
    ranked = top.withColumn("rank", F.row_number().over(w)).withColumn("_item", item)
    msg = ranked.agg(F.count(F.lit(1)).alias("n"),
                     F.expr("listagg(_item, '') WITHIN GROUP (ORDER BY rank)").alias("_body"))
    text = F.concat(F.lit("*Top "), F.col("n").cast("string"), F.lit(" Job Matches*\n\n"), F.coalesce(F.col("_body"), F.lit("")),
                    F.lit(f"Dashboard: {dashboard_link}" if dashboard_link else ""))
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return msg.select(stripped.alias("message"))


# FIXED VALUES -- scan summary message text (labels in display order)
SUMMARY_HEAD = "\U0001F50D *Job Search Scan Completed!* \U0001F916\n\n\U0001F4CA *Scan Statistics:*\n"
SUMMARY_KPIS = [
    ("total_scanned", "• \U0001F310 Total Scanned on Web: "),
    ("new_matches", "• \U0001F3AF New Matches (Score ≥ 70): "),
    ("duplicates_removed", "• \U0001F9F9 Duplicates Cleaned: "),
    ("geo_filtered", "• \U0001F5FA️ Overseas Jobs Filtered: "),
    ("total_to_apply", "• \U0001F4BC Total 'To Apply' in Dashboard: "),
]
SUMMARY_TIER_HEAD = "\n\U0001F31F *Score Breakdown (New Matches):*\n"
SUMMARY_TIERS = [
    ("tier_95", "• \U0001F3C6 95-100 (Student / Internship): "),
    ("tier_85", "• \U0001F947 85-94 (No Experience Required): "),
    ("tier_70", "• ⭐️ 70-84 (Junior / 1-2 Yrs Exp): "),
]
SUMMARY_PICKS_HEAD = "\n\U0001F680 *Top Picks From This Scan:*\n"
PICK_LOCATION = "\n     \U0001F4CD Location: "
PICK_SCORE = " | \U0001F3AF Score: "
PICK_FEATURES = "     ✨ "
PICK_LINK = "     \U0001F517 "
SUMMARY_LINK = "\n\U0001F4F1 *View Kanban Dashboard:*\n"


def render_scan_summary(summary: DataFrame, top3: DataFrame, dashboard_link: str = "") -> DataFrame:
    """KPI block, tier block, top-3 block and link, stripped.
    ``summary`` is G4's one row; ``top3`` is K4's output (score, title, company,
    url, ai_summary)."""
    js = F.col("ai_summary")
    feats = ev.json_text(js, "key_features", "")
    w = W.orderBy(F.col("score").desc(), F.col("id"))
    item = F.concat(
        F.lit("  "), F.col("rank").cast("string"), F.lit(". *"), F.col("title"), F.lit("* @ "), F.col("company"),
        F.lit(PICK_LOCATION), ev.json_text(js, "location", "N/A"),
        F.lit(PICK_SCORE), F.col("score").cast("string"), F.lit("/100\n"),
        F.when(ev.json_truthy(js, "key_features"), F.concat(F.lit(PICK_FEATURES), feats, F.lit("\n"))).otherwise(F.lit("")),
        F.lit(PICK_LINK), F.col("url"), F.lit("\n"))
    picks = (top3.withColumn("rank", F.row_number().over(w)).withColumn("_item", item)
             .agg(F.expr("listagg(_item, '') WITHIN GROUP (ORDER BY rank)").alias("_picks")))
    parts = [F.lit(SUMMARY_HEAD)]
    for col, label in SUMMARY_KPIS:
        parts += [F.lit(label), F.col(col).cast("string"), F.lit("\n")]
    parts.append(F.lit(SUMMARY_TIER_HEAD))
    for col, label in SUMMARY_TIERS:
        parts += [F.lit(label), F.col(col).cast("string"), F.lit("\n")]
    head = F.concat(*parts)
    # the picks block is one value: a scalar subquery, no join
    one = summary.withColumn("_picks", picks.scalar())
    top_block = F.when(F.coalesce(F.col("_picks"), F.lit("")) != "",
                       F.concat(F.lit(SUMMARY_PICKS_HEAD), F.col("_picks"))).otherwise(F.lit(""))
    link = F.lit(f"{SUMMARY_LINK}{dashboard_link}" if dashboard_link else "")
    msg = F.concat(head, top_block, link)
    return one.select(F.regexp_replace(msg, r"(?U)^\s+|\s+$", "").alias("message"))
