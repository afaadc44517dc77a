"""The breaker (G7) against a replay of every attempt, one after another."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from conftest import rows
from postline.operators import reports
from postline.streaming import streams

T0 = datetime(2024, 1, 1)


def replay(log, now, threshold, recovery):
    """(count, open) after each site's attempts in order of (time, id) and a check at ``now``."""
    out = {}
    for site in {a[0] for a in log}:
        count, last = 0, None

        def is_open(t):
            nonlocal count
            if count < threshold:
                return False
            if t - last > timedelta(seconds=recovery):
                count = 0
                return False
            return True

        for _, ts, _, ok in sorted((a for a in log if a[0] == site), key=lambda a: (a[1], a[2])):
            is_open(ts)
            if ok:
                count = 0
            else:
                count, last = count + 1, ts
        out[site] = (count, is_open(now))
        if not out[site][1]:
            out[site] = (count, False)
    return sorted((s, c, o) for s, (c, o) in out.items())


def _frame(spark, log):
    return spark.createDataFrame(log, "site string, ts timestamp, id long, success boolean")


def test_reset_between_attempts(spark):
    log = [("s", T0 + timedelta(seconds=t), i, False) for i, t in enumerate((0, 1, 2, 3, 4, 1000))]
    now = T0 + timedelta(seconds=1001)
    got = reports.breaker_state(_frame(spark, log), F.lit(now.replace(tzinfo=timezone.utc)))
    assert rows(got) == [("s", 1, False)]


def test_matches_replay_on_random_logs(spark):
    r = random.Random(3)
    log = []
    for site in range(40):
        t = 0.0
        for i in range(r.randint(1, 60)):
            t += r.choice([0, 0.5, 3, 40, 99.9, 100, 100.1, 101, 500])
            log.append((f"s{site}", T0 + timedelta(seconds=t), site * 1000 + i, r.random() < 0.15))
    end = max(a[1] for a in log)
    for now in (end, end + timedelta(seconds=150)):
        lit = F.lit(now.replace(tzinfo=timezone.utc))
        want = replay(log, now, 5, 100)
        assert rows(reports.breaker_state(_frame(spark, log), lit, 5, 100)) == want
    # the streamed state gives the same, in whatever order the batches come
    r.shuffle(log)
    state = spark.createDataFrame([], streams.BREAKER_STATE)
    for k in range(0, len(log), 400):
        state = streams.merge_breaker_state(state, _frame(spark, log[k:k + 400]))
    assert rows(streams.breaker_open(state, lit, 5, 100)) == want


def test_state_with_a_horizon_stays_small_and_exact(spark):
    """Attempts up to 300 s late, a dead site among them: 20 batches give the replay's answer,
    and the dead site's state doesn't grow after the first ones."""
    r = random.Random(5)
    log = []
    for site in range(6):
        t = 0.0
        for i in range(400):
            t += r.choice([1, 7, 30, 101, 120])
            log.append((f"s{site}", T0 + timedelta(seconds=t), site * 1000 + i, site > 0 and r.random() < 0.05 * site))
    arrival = {a[2]: a[1] + timedelta(seconds=r.uniform(0, 300)) for a in log}
    log.sort(key=lambda a: arrival[a[2]])
    end = max(a[1] for a in log)
    now = F.lit(end.replace(tzinfo=timezone.utc))
    state, sizes = spark.createDataFrame([], streams.BREAKER_STATE), []
    for k in range(0, len(log), 120):
        part = log[k:k + 120] + log[max(0, k - 5):k]              # some come twice
        state = streams.written(streams.merge_breaker_state(state, _frame(spark, part), 600, 5, 100), "test_state")
        sizes.append(state.where("site = 's0'").count())
        if k in (600, 1200):
            seen = log[:k + 120]
            at = max(a[1] for a in seen)
            lit = F.lit(at.replace(tzinfo=timezone.utc))
            assert rows(streams.breaker_open(state, lit, 5, 100)) == replay(seen, at, 5, 100)
    assert rows(streams.breaker_open(state, now, 5, 100)) == replay(log, end, 5, 100)
    assert len(sizes) == 20 and max(sizes[10:]) <= 60 and state.where("n is not null").groupBy("site").count().where("count > 1").count() == 0


def test_attempts_beyond_the_horizon(spark):
    """A success later than the horizon clears what it isn't older than; a failure counts on."""
    log = [("s", T0 + timedelta(seconds=10 * i), i, False) for i in range(4)] + [("s", T0 + timedelta(seconds=1000), 9, False)]
    state = streams.merge_breaker_state(spark.createDataFrame([], streams.BREAKER_STATE), _frame(spark, log), 100, 50, 10_000)
    now = F.lit((T0 + timedelta(seconds=1000)).replace(tzinfo=timezone.utc))
    count = lambda more: rows(streams.breaker_open(streams.merge_breaker_state(state, _frame(spark, more), 100, 50, 10_000), now, 50, 10_000))
    assert count([]) == [("s", 5, False)]
    assert count([("s", T0 + timedelta(seconds=40), 20, True)]) == [("s", 1, False)]
    assert count([("s", T0 + timedelta(seconds=15), 20, True)]) == [("s", 5, False)]      # within the settled ones: they stay
    assert count([("s", T0 + timedelta(seconds=15), 20, False)]) == [("s", 6, False)]
