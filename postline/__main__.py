"""Command-line entry points over a versioned jobs table.

    python -m postline init    --store DIR --jobs PARQUET
    python -m postline cycle   --store DIR --postings PATH [--link URL] [--incremental]
    python -m postline recheck --store DIR
    python -m postline geo     --store DIR
    python -m postline cleanup --store DIR
    python -m postline stats   --store DIR
    python -m postline top     --store DIR [--k 5] [--outbox DIR]
    python -m postline mail    --store DIR --inbox DIR --checkpoint DIR

Every command that changes the table writes the next version of ``--store``
(partitioned by stage); readers always take the newest complete version.
Only one-row results (messages, counts) and ``show()`` previews reach the
driver.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import functions as F

from postline import rules
from postline.operators import dedup, filters, reports, state
from postline.plans import cycle
from postline.session import drop_scratch, get_session
from postline.sources import tables as tb
from postline.streaming import streams


def _latest(spark, store):
    return _snapshot(spark, store)[0]


def _snapshot(spark, store):
    """The table and the deltas it holds; deltas that streams write from now on stay on top of the next version."""
    found = state.read_snapshot(spark, store)
    if found is None:
        raise SystemExit(f"no table under {store}; run 'init' first")
    return found


def cmd_init(spark, a):
    old = spark.read.parquet(a.jobs)
    print(state.write_version(state.evolve_schema(old), a.store))


CYCLED = "_cycled"      # marks a version that a finished cycle wrote


def cmd_cycle(spark, a):
    """Only a store that a finished cycle wrote, and nothing has changed since, may
    be cycled incrementally; such a store is, unless ``--full`` is given."""
    store, folded = _snapshot(spark, a.store)
    incremental = not a.full and state.has_marker(spark, a.store, CYCLED) and not folded
    postings = tb.scan_postings(spark, a.postings)
    out = cycle.run_cycle(store, postings, F.current_timestamp(), dashboard_link=a.link or "", incremental=incremental)
    print(state.write_version(out["store"], a.store, marker=CYCLED, folded=folded))
    print(out["message"].first()["message"])


def cmd_recheck(spark, a):
    jobs, folded = _snapshot(spark, a.store)
    rechecked = cycle.recheck(jobs)
    updated = (jobs.join(rechecked.select("id", F.col("stage").alias("_s"), F.col("ai_summary").alias("_a")), "id", "left")
               .withColumn("stage", F.coalesce(F.col("_s"), F.col("stage")))
               .withColumn("ai_summary", F.coalesce(F.col("_a"), F.col("ai_summary"))).drop("_s", "_a"))
    print(state.write_version(updated, a.store, folded=folded))


def cmd_geo(spark, a):
    jobs, folded = _snapshot(spark, a.store)
    print(state.write_version(filters.apply_geo_filter(jobs).drop("geo_reason"), a.store, folded=folded))


def cmd_cleanup(spark, a):
    jobs, folded = _snapshot(spark, a.store)
    kept = filters.demote_low_scores(dedup.dedup_postings(jobs)).drop("demoted")
    print(state.write_version(kept, a.store, folded=folded))


def cmd_stats(spark, a):
    jobs = _latest(spark, a.store)
    reports.stage_counts(jobs).orderBy("stage").show(truncate=False)
    groups = dedup.duplicate_groups(jobs).orderBy(F.col("cnt").desc(), "norm_title", "norm_company", "id")
    groups.write.mode("overwrite").parquet(a.out)
    print(f"duplicate groups: {a.out}")


def cmd_top(spark, a):
    top = reports.top_jobs(_latest(spark, a.store), a.k)
    msg = reports.render_top_jobs(top)
    if a.outbox:
        state.outbox_sink(msg, a.outbox, datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f"), rules.MESSAGE_LIMIT)
    print(msg.first()["message"])


def cmd_mail(spark, a):
    streams.mail_updates_stream(spark, a.inbox, a.store, a.checkpoint)
    print(state.read_latest(spark, a.store).groupBy("stage").count().orderBy("stage").collect())


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="python -m postline")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("init", "cycle", "recheck", "geo", "cleanup", "stats", "top", "mail"):
        sp = sub.add_parser(name)
        sp.add_argument("--store", required=True)
        if name == "init":
            sp.add_argument("--jobs", required=True)
        if name == "cycle":
            sp.add_argument("--postings", required=True)
            sp.add_argument("--link", default="")
            sp.add_argument("--full", action="store_true",
                            help="recompute all groups, also when the store is the output of an earlier cycle")
        if name == "stats":
            sp.add_argument("--out", required=True, help="folder for the duplicate report (all groups)")
        if name == "top":
            sp.add_argument("--k", type=int, default=5)
            sp.add_argument("--outbox", default=None)
        if name == "mail":
            sp.add_argument("--inbox", required=True)
            sp.add_argument("--checkpoint", required=True)
    a = p.parse_args(argv)
    spark = get_session(a.master)
    try:
        globals()[f"cmd_{a.cmd}"](spark, a)
    finally:
        drop_scratch(spark)             # every result has been written or printed
    return 0


if __name__ == "__main__":
    sys.exit(main())
