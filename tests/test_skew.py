"""Hot keys: one site / group holding most rows, spread over several range
partitions, gives the same answers as a plain Python loop."""

import random
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postline.operators import dedup, reports


def _attempts(spark, outcomes):
    t0 = datetime(2024, 1, 1)
    rows = [(i, site, t0 + timedelta(seconds=i), ok) for i, (site, ok) in enumerate(outcomes)]
    return spark.createDataFrame(rows, "id long, site string, ts timestamp, success boolean")


def runs_model(outcomes, threshold):
    """(site, run_no) -> (length, index of the threshold-th failure)."""
    out, succ, cur = {}, {}, {}
    for i, (site, ok) in enumerate(outcomes):
        if ok:
            succ[site] = succ.get(site, 0) + 1
            continue
        key = (site, succ.get(site, 0))
        n, opened = out.get(key, (0, None))
        n += 1
        out[key] = (n, i if n == threshold else opened)
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "hot", "a", "b"]), st.booleans()), min_size=30,
                max_size=200))
def test_failure_runs_with_a_hot_site(spark, outcomes):
    df = _attempts(spark, outcomes)
    got = {(r.site, r.run_no): (r.run_length, r.opened_at) for r in dedup.failure_runs(df, threshold=3).collect()}
    t0 = datetime(2024, 1, 1)
    want = {k: (n, None if i is None else t0 + timedelta(seconds=i)) for k, (n, i) in runs_model(outcomes, 3).items()}
    assert got == want


def test_positions_of_a_group_spanning_partitions(spark):
    rnd = random.Random(7)
    rows = [(i, "hot" if rnd.random() < 0.8 else rnd.choice(["x", "y"]), rnd.randint(0, 50)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = {r.id: r.position for r in reports.global_positions(df, ["g"], [F.col("v").desc(), F.col("id")],
                                                              num_partitions=16).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        members = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        want.update({r[0]: i + 1 for i, r in enumerate(members)})
    assert got == want


def test_survivor_and_trailing_failures_with_a_hot_key(spark):
    rnd = random.Random(3)
    outcomes = [("hot" if rnd.random() < 0.7 else "cold", rnd.random() < 0.4) for _ in range(400)]
    df = _attempts(spark, outcomes)
    got = {r.site: r.trailing_failures for r in dedup.trailing_failures(df).collect()}
    want = {}
    for site, ok in outcomes:
        want[site] = 0 if ok else want.get(site, 0) + 1
    assert got == want
    best = dedup.keep_best(df, ["site"], [F.col("success").cast("int"), -F.col("id")]).collect()
    for r in best:                       # the last failure of each site
        assert r.id == max(i for i, (s, ok) in enumerate(outcomes) if s == r.site and not ok)
