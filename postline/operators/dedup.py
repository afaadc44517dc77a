"""Dedup, survivorship and sequence operators.

Survivorship (A1, A2, A4) is a keyed ``min``/``max`` over an ordering
struct that carries the whole row.  Spark plans it as a sort-based aggregate with a
map-side partial step, so a hot key (company 'Unknown', url '') is reduced
to one row per map task before anything is shuffled -- no task ever holds
a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postline import rules
from postline.functions import evaluation as ev
from postline.session import written


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def norm_key(c: Column, ascii_only: bool = False) -> Column:
    """lower + trim (spaces) entity key.  ``ascii_only`` lowers A-Z only,
    as SQLite's LOWER does (Q4); the default lowers all of Unicode."""
    if ascii_only:
        return F.translate(F.trim(c), _UPPER, _UPPER.lower())
    return F.lower(F.trim(c))


def stage_rank(stage: Column, ranks: dict | None = None) -> Column:
    ranks = rules.STAGE_RANK if ranks is None else ranks
    s = F.coalesce(stage, F.lit("Irrelevant"))
    expr = None
    for name, r in ranks.items():
        expr = F.when(s == name, F.lit(r)) if expr is None else expr.when(s == name, F.lit(r))
    return expr.otherwise(F.lit(1))


def keep_best(df: DataFrame, keys: list, order: list[Column], size_col: str | None = None) -> DataFrame:
    """Per key, the row that is smallest under ``order`` (a list of Columns,
    compared left to right).  Partial aggregation keeps hot keys cheap.
    With ``size_col`` the group's row count is added in the same aggregation."""
    cols = df.columns
    best = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*cols).alias("_row")))
    aggs = [best.alias("_best")] + ([F.count(F.lit(1)).alias(size_col)] if size_col else [])
    out = df.groupBy(*keys).agg(*aggs)
    return out.select("_best._row.*", *([size_col] if size_col else []))


def dedup_postings(jobs: DataFrame, ranks: dict | None = None, size_col: str | None = None) -> DataFrame:
    """A1: one row per (lower(trim(title)), lower(trim(company))): highest
    stage rank, then highest score, then lowest id.  Returns the survivors
    (with the group size in ``size_col`` when given: G10 = sum(size - 1))."""
    keyed = jobs.withColumn("_t", norm_key(F.col("title"))).withColumn("_c", norm_key(F.col("company")))
    order = [-stage_rank(F.col("stage"), ranks), -ev.parse_score(F.col("ai_summary")), F.col("id")]
    return keep_best(keyed, ["_t", "_c"], order, size_col).drop("_t", "_c")


def dedup_losers(jobs: DataFrame, survivors: DataFrame) -> DataFrame:
    """The rows A1 removes."""
    return jobs.join(survivors.select("id"), "id", "left_anti")


def keep_rows(jobs: DataFrame, survivors: DataFrame) -> DataFrame:
    """S9 for survivorship: only the surviving rows stay, by one semi join."""
    return jobs.join(survivors.select("id"), "id", "left_semi")


def delete_rows(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs without the given ids."""
    return jobs.join(ids.select("id"), "id", "left_anti")


def dedup_removed_count(jobs: DataFrame) -> DataFrame:
    """Rows removed by A1 = rows - groups."""
    g = jobs.groupBy(norm_key(F.col("title")), norm_key(F.col("company"))).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("removed"))


def dedup_by_url(df: DataFrame, score: str = "score") -> DataFrame:
    """A2: per URL the highest score, ties to the lowest id."""
    return keep_best(df, ["url"], [-F.col(score), F.col("id")])


def cap_per_task(postings: DataFrame, cap: int) -> DataFrame:
    """A3: the first ``cap`` cards of each (site, query) in page order.
    Catalyst plans the rank filter as a WindowGroupLimit on both sides of
    the shuffle, so at most ``cap`` rows per task and key cross it."""
    w = W.partitionBy("site", "query").orderBy("position")
    return postings.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def latest_update_per_job(updates: DataFrame) -> DataFrame:
    """A4: per job id the update with the highest sequence number."""
    best = F.max(F.struct("seq", "new_stage", "new_sub_stage"))
    return updates.groupBy("id").agg(best.alias("_u")).select(
        "id", F.col("_u.seq").alias("seq"), F.col("_u.new_stage").alias("new_stage"),
        F.col("_u.new_sub_stage").alias("new_sub_stage"))


def _order_key(ts: str = "ts", id_col: str = "id") -> Column:
    return F.struct(F.col(ts).alias("ts"), F.col(id_col).alias("id"))


def trailing_failures(attempts: DataFrame) -> DataFrame:
    """A5: per site, failures after the last success (all failures if none),
    plus the time of the last failure.

    Two partial aggregations and a join on the per-site summary (one row
    per site; AQE broadcasts it when its measured size allows)."""
    last_ok = attempts.groupBy("site").agg(F.max(F.when(F.col("success"), _order_key())).alias("_last_ok"))
    tagged = attempts.join(last_ok, "site")
    after = F.col("_last_ok").isNull() | (_order_key() > F.col("_last_ok"))
    return tagged.groupBy("site").agg(
        F.count_if(~F.col("success") & after).cast("bigint").alias("trailing_failures"),
        F.max(F.when(~F.col("success"), F.col("ts"))).alias("last_failure_ts"),
        F.max(F.col("_last_ok").isNotNull()).alias("has_success"))


def failure_runs(attempts: DataFrame, threshold: int = rules.BREAKER_THRESHOLD) -> DataFrame:
    """Runs of consecutive failures per site: start, end, length and the
    time the run reached ``threshold`` (NULL if it never did).

    A failure's run number is the count of successes before it.  Attempts are
    range-partitioned by site and time once; running counts inside a partition plus the
    counts of earlier partitions give the run, so a site holding a large share of
    all attempts is spread over many tasks instead of one window partition."""
    order = [F.col("ts"), F.col("id")]
    n = int(attempts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one range sort; the copy keeps the partitions (range bounds are sampled anew in each computation)
    rows = attempts.select("site", "ts", "id", "success").repartitionByRange(n, "site", *order).withColumn("_pid", F.spark_partition_id())
    rows = written(rows, "failure_runs")
    inside = W.partitionBy("_pid", "site").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    counted = rows.withColumn("_f", F.count_if(~F.col("success")).over(inside)).withColumn("_s", F.count_if("success").over(inside))
    # what earlier partitions hold of the site: one row a partition and site
    parts = rows.groupBy("_pid", "site").agg(F.count_if(~F.col("success")).alias("_pf"), F.count_if("success").alias("_ps"))
    before = W.partitionBy("site").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_pid", "site", F.coalesce(F.sum("_pf").over(before), F.lit(0)).alias("_of"),
                         F.coalesce(F.sum("_ps").over(before), F.lit(0)).alias("_os"))
    fails = (counted.where(~F.col("success")).join(parts, ["_pid", "site"])
             .select("site", (F.col("_s") + F.col("_os")).alias("run_no"), "ts", (F.col("_f") + F.col("_of")).alias("_f")))
    runs = fails.groupBy("site", "run_no").agg(
        F.min("ts").alias("run_start"), F.max("ts").alias("run_end"),
        F.count(F.lit(1)).cast("bigint").alias("run_length"), F.min("_f").alias("_f0"))
    # the failure that reached the threshold: the run's threshold-th one
    reached = (fails.join(runs.select("site", "run_no", "_f0"), ["site", "run_no"])
               .where(F.col("_f") == F.col("_f0") + (threshold - 1))
               .select("site", "run_no", F.col("ts").alias("opened_at")))
    return runs.drop("_f0").join(reached, ["site", "run_no"], "left")


def duplicate_groups(jobs: DataFrame) -> DataFrame:
    """G1: members of every (title, company) group with more than one row,
    with the group size; one row per member (no per-group list is built)."""
    keyed = jobs.withColumn("norm_title", norm_key(F.col("title"))).withColumn("norm_company", norm_key(F.col("company")))
    sizes = keyed.groupBy("norm_title", "norm_company").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)
    return keyed.join(sizes, ["norm_title", "norm_company"]).select("norm_title", "norm_company", "cnt", "id", "stage")


# ---------------------------------------------------------------------------
# Greedy in-batch admission
# ---------------------------------------------------------------------------
def _log_round(r: int) -> None:
    import os
    if os.environ.get("POSTLINE_TRACE"):
        print(f"admit_batch round {r}", flush=True)


CONTRACT_AFTER = 3       # rounds before forced chains are contracted


def _with_firsts(undecided: DataFrame) -> DataFrame:
    """The undecided items with the first item of their URL group (mu) and title group (mt); partial
    aggregates, so a hot key reaches the shuffle as one row per task."""
    mu = undecided.groupBy("u").agg(F.min("seq").alias("mu"))
    mt = undecided.where(F.col("tk").isNotNull()).groupBy("tk").agg(F.min("seq").alias("mt"))
    return undecided.join(mu, "u").join(mt, "tk", "left").select("seq", "u", "tk", "mu", F.coalesce("mt", "seq").alias("mt"))


def _forced(placed: DataFrame) -> DataFrame:
    """Items with exactly one undecided item before them in their two groups: first in one,
    second in the other.  Such an item is admitted if and only if the one before it (``at``) is not."""
    second_u = placed.where("seq != mu").groupBy("u").agg(F.min("seq").alias("su"))
    second_t = placed.where("seq != mt").groupBy("tk").agg(F.min("seq").alias("st"))
    by_u = placed.where("seq != mu and seq = mt").join(second_u.select(F.col("su").alias("seq")), "seq", "left_semi").select("seq", F.col("mu").alias("at"))
    by_t = placed.where("seq != mt and seq = mu").join(second_t.select(F.col("st").alias("seq")), "seq", "left_semi").select("seq", F.col("mt").alias("at"))
    return by_u.unionByName(by_t).withColumn("odd", F.lit(True))


def _chase(links: DataFrame, spend) -> DataFrame:
    """Where chains of forced items (seq, at, odd) end, by pointer doubling: each step halves
    the links left.  ``odd``: an odd number of links, so the item is decided against its end."""
    steps = written(links.join(links.select(F.col("seq").alias("at"), F.lit(True).alias("more")), "at", "left")
                    .select("seq", "at", "odd", F.coalesce("more", F.lit(False)).alias("open")), "admit_chains")
    while not steps.where("open").isEmpty():
        spend()
        ahead = steps.select(F.col("seq").alias("at"), F.col("at").alias("next"), F.col("odd").alias("flip"), F.col("open").alias("more"))
        moved = steps.where("open").join(ahead, "at").select("seq", F.col("next").alias("at"), (F.col("odd") != F.col("flip")).alias("odd"), F.col("more").alias("open"))
        steps = written(steps.where("not open").unionByName(moved), "admit_chains")
    return steps.drop("open")


def admit_batch(batch: DataFrame, seq: str = "seq", max_rounds: int | None = None) -> DataFrame:
    """The items a sequential loop would admit: an item is admitted when
    no earlier *admitted* item shares its URL or its (title, company) key.

    Round scheme (exact): among undecided items, those first by ``seq`` in
    both their URL group and their title group are admitted; undecided items
    whose group begins with a newly admitted one are rejected.  The globally first
    undecided item is admitted every round, so the loop ends.  Batches that are not done
    after ``CONTRACT_AFTER`` rounds hold chains, where each item waits for the one before it; from
    then on, items that wait for a single other one are decided together, by
    pointer doubling along their chains, so a chain of n links takes about log n steps.
    Each round's admitted and undecided sets are written to the shared checkpoint folder
    and read back, so plans stay the same size however many rounds run and
    a lost executor never replays earlier rounds.  ``max_rounds`` bounds rounds and doubling steps together.
    """
    tkey = F.concat_ws("\u0001", norm_key(F.col("title")), norm_key(F.col("company")))
    has_t = (F.coalesce(F.col("title"), F.lit("")) != "") & (F.coalesce(F.col("company"), F.lit("")) != "")
    # a NULL url never equals anything: give each its own key
    ukey = F.coalesce(F.col("url"), F.concat(F.lit("\u0002"), F.col(seq).cast("string")))
    undecided = written(batch.select(F.col(seq).alias("seq"), ukey.alias("u"), F.when(has_t, tkey).alias("tk")), "admit_items")
    news: list[DataFrame] = []
    rounds = 0

    def spend():
        nonlocal rounds
        rounds += 1
        _log_round(rounds)
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError("admission did not converge within max_rounds")

    while True:
        spend()
        placed = written(_with_firsts(undecided), "admit_placed")
        new = placed.where("seq = mu and seq = mt").select("seq")
        gone = None
        if len(news) >= CONTRACT_AFTER:
            ends = _chase(_forced(placed), spend).join(new.select(F.col("seq").alias("at")), "at", "left_semi")
            ends = written(ends, "admit_forced")
            new, gone = written(new.unionByName(ends.where("not odd").select("seq")), "admit_new"), ends.where("odd").select("seq")
        news.append(new)
        rest = placed
        for key, first in (("u", "mu"), ("tk", "mt")):
            if gone is None:
                # only the first of a group can be new
                rest = rest.join(new.select(F.col("seq").alias(first)), first, "left_anti")
            else:
                taken = placed.join(new, "seq", "left_semi").where(F.col(key).isNotNull()).select(key).distinct()
                rest = rest.join(taken, key, "left_anti")
        if gone is not None:
            rest = rest.join(gone, "seq", "left_anti")
        undecided = written(rest.select("seq", "u", "tk"), "admit_rest")
        # the size of what is left (parquet footers) decides termination
        if undecided.count() == 0:
            break
    admitted = news[0]
    for n in news[1:]:
        admitted = admitted.unionByName(n)
    return batch.join(admitted.withColumnRenamed("seq", seq), seq, "left_semi")
