"""Composite jobs: recheck (X3), the scan cycle (X4) and the mail update
flow (section 3.2), built from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline import rules
from postline.functions import evaluation as ev
from postline.functions import urls
from postline.operators import dedup, filters, joins, reports, state
from postline.operators.seen import KeyIndex
from postline.plans import scoring
from postline.session import written


def recheck(jobs: DataFrame, scorer: Callable | None = None, strip_prior_reason: bool = False) -> DataFrame:
    """To Apply + Irrelevant rows are rebuilt from their stored
    evaluation (P22), pre-filtered (P11), the rest re-scored (X1) and routed
    (P15).  Returns (id, stage, ai_summary) for every rechecked row; rows
    whose stored location is not text are skipped (left unchanged)."""
    # a stored location that is not text makes the rebuilt posting unusable:
    # such rows are left as they are
    s = jobs.where(F.col("stage").isin("To Apply", "Irrelevant") & ~ev.non_string_field(F.col("ai_summary"), "location"))
    s = s.select("id", "title", "company", "url",
                 ev.recheck_location(F.col("ai_summary")).alias("location"),
                 ev.recheck_input(F.col("ai_summary"), strip_prior_reason).alias("description"))
    s = filters.pre_filter(s)
    rejected = s.where(F.col("is_rejected")).select(
        "id", F.lit("Irrelevant").alias("stage"),
        ev.rejected_evaluation(F.col("reject_reason"), F.col("location")).alias("ai_summary"))
    scored = scoring.score_postings(s.where(~F.col("is_rejected")), scorer)
    e = F.col("evaluation")
    routed = scored.select("id", ev.route_by_score(e["is_relevant"], e["match_score"]).alias("stage"),
                           scoring.evaluation_json(e).alias("ai_summary"))
    return rejected.unionByName(routed)


def ingest(store: DataFrame | None, postings: DataFrame, now: Column, scorer: Callable | None = None, index: KeyIndex | None = None) -> dict:
    """The per-posting part of X4: in-batch admission (A6), seen check (J1),
    pre-filter (P11), rejected evaluation (P16) or score + route (X1, P15),
    append (S7).  Returns the new store and the cycle's new matches.

    Only batch-sized data is materialised: the postings left after the
    seen check (read by both branches), the inserted rows (read by the new
    store and by the matches) and, with a user scorer, its output (so every
    posting is scored once).  With an ``index`` of the stored keys the store itself
    is not read; then it may be left out, and the result has none."""
    # the seen check and the insert both compare canonical URLs, so a later
    # posting whose URL differs only by tracking parameters is a repeat
    canonical = postings.withColumn("url", F.coalesce(urls.normalize_url(F.col("url")), F.lit("")))
    admitted = dedup.admit_batch(canonical)
    # batch-sized and read by several branches below: written once
    if index is not None:
        admitted = written(admitted, "admitted")      # its keys are fetched first
    fresh = written(joins.drop_seen(admitted, store, index=index), "fresh")
    pf = filters.pre_filter(fresh)
    rejected = pf.where(F.col("is_rejected")).select(
        "seq", "title", "company", "url", "location",
        ev.rejected_evaluation(F.col("reject_reason"), F.col("location")).alias("ai_summary"),
        F.lit("Irrelevant").alias("stage"), F.lit(0).alias("score"))
    scored = scoring.score_postings(pf.where(~F.col("is_rejected")), scorer)
    if scorer is not None:
        scored = written(scored, "scored")  # one (paid) evaluation per posting
    e = F.col("evaluation")
    routed = scored.select("seq", "title", "company", "url", "location",
                           scoring.evaluation_json(e).alias("ai_summary"),
                           ev.route_by_score(e["is_relevant"], e["match_score"]).alias("stage"),
                           e["match_score"].alias("score"))
    outcomes = joins.union_outcomes(rejected, routed)
    inserted = written(state.append_new(store, outcomes, now, index), "inserted")
    # routed To Apply rows are exactly the inserted To Apply rows
    matches = inserted.where(F.col("stage") == "To Apply").withColumn("score", ev.parse_score(F.col("ai_summary")))
    new_store = None if store is None else store.unionByName(inserted)
    return {"admitted": admitted, "outcomes": outcomes, "inserted": inserted, "store": new_store, "matches": matches}


def run_cycle(store: DataFrame, postings: DataFrame, now: Column, scorer: Callable | None = None,
              dashboard_link: str = "", incremental: bool = False) -> dict:
    """Ingest, then dedup (A1) -> demote (P14) -> geo filter (P13) in
    this order, then the KPI row (G4) and the summary message (F15).

    The store after ingest is read once (dedup also counts each group, which
    gives G10); the cycle's result is materialised once and every KPI is
    read from it, so no pass over the whole store is repeated.

    ``incremental``: the store is the result of an earlier cycle, so every
    (title, company) group in it has one row and demotion and the geo filter
    have already been applied to it (both are row-local and idempotent).
    Then only the groups that received new rows can change: the store is
    semi-joined to the new rows' keys, dedup / demotion / geo filter run on
    those groups alone, and the untouched rows are carried over as they are.
    Same result as the full cycle; the work is bounded by the touched groups
    instead of the whole store."""
    step = ingest(store, postings, now, scorer)
    if incremental:
        t, c = dedup.norm_key(F.col("title")), dedup.norm_key(F.col("company"))
        keys = step["inserted"].select(t.alias("_t"), c.alias("_c")).distinct()
        keyed = store.withColumn("_t", t).withColumn("_c", c)
        touched = keyed.join(keys, ["_t", "_c"], "left_semi").drop("_t", "_c")
        untouched = keyed.join(keys, ["_t", "_c"], "left_anti").drop("_t", "_c")
        work = touched.unionByName(step["inserted"])
    else:
        untouched, work = None, step["store"]
    deduped = dedup.dedup_postings(work, size_col="_group_n")
    demoted = filters.demote_low_scores(deduped).drop("demoted")
    final = written(filters.apply_geo_filter(demoted), "cycle_store")
    removed = final.agg(F.coalesce(F.sum(F.col("_group_n") - 1), F.lit(0)).cast("bigint").alias("removed"))
    geo_count = final.agg(F.count_if(F.col("geo_reason").isNotNull()).cast("bigint").alias("geo_filtered"))
    new_store = final.drop("_group_n", "geo_reason")
    if untouched is not None:
        new_store = untouched.unionByName(new_store)
    summary = reports.scan_summary(postings, step["matches"], removed, geo_count, new_store)
    top3 = reports.top_new_matches(step["matches"])
    message = reports.render_scan_summary(summary, top3, dashboard_link)
    return {"store": new_store, "summary": summary, "message": message, "matches": step["matches"]}


def valid_classification(c: Column) -> Column:
    """A classification that may be applied: known stage, known (or no)
    sub-stage (Q18: the classifier's output is not trusted)."""
    return (c["new_stage"].isin(rules.STAGES)
            & (c["new_sub_stage"].isNull() | c["new_sub_stage"].isin(rules.SUB_STAGES)))


def mail_outcomes(messages: DataFrame, jobs: DataFrame, classifier: Callable | None = None,
                  active_stages: list[str] | None = None, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Section 3.2 as one job: J3 -> X2 -> P21 -> J4 -> A4.  Returns the
    updates (id, seq, new_stage, new_sub_stage) to apply with S8, and the relevant
    classifications that name no known stage (for an error table; none of
    them without ``validate``).

    Every job of a company receives the same messages, so the last relevant
    message per company decides each of its jobs (A4): the messages are
    reduced per company (partial max) before the fan-out join (J4), which
    then yields one row per job instead of messages x jobs.  ``active_stages``
    defaults to To Apply + In Process (Applied is not tracked, Q16).  A user
    classifier's output is written once, since both results read it."""
    active = filters.active_jobs(jobs, active_stages)
    companies = joins.company_index(active)
    matched = joins.match_company(messages, companies)
    with_text = matched.join(messages.select("seq", "subject", "body"), "seq")
    classified = scoring.classify_messages(with_text, classifier)
    relevant = filters.relevant_updates(classified).select("seq", "company_key", "classification")
    if classifier is not None:
        relevant = written(relevant, "classified")
    valid = F.coalesce(valid_classification(F.col("classification")), F.lit(False)) if validate else F.lit(True)
    latest = latest_per_company(relevant.where(valid))
    fanned = joins.fan_out_updates(latest, active)
    updates = fanned.select("id", "seq", "new_stage", "new_sub_stage")
    return updates, relevant.where(~valid)


def latest_per_company(relevant: DataFrame) -> DataFrame:
    """The last relevant message of each company (company_key, seq, new_stage,
    new_sub_stage): a partial max, so its number is bounded by the companies."""
    c = F.col("classification")
    return relevant.groupBy("company_key").agg(
        F.max(F.struct(F.col("seq"), c["new_stage"].alias("new_stage"), c["new_sub_stage"].alias("new_sub_stage"))).alias("_u")
    ).select("company_key", "_u.*")


def mail_updates(messages: DataFrame, jobs: DataFrame, classifier: Callable | None = None,
                 active_stages: list[str] | None = None, validate: bool = True) -> DataFrame:
    """The updates of ``mail_outcomes``."""
    return mail_outcomes(messages, jobs, classifier, active_stages, validate)[0]
