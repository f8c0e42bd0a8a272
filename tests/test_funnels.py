"""Funnels against every attempt tried by itself."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import funnels as N



def steps():
    return [F.col("event") == x for x in "abcd"]


def brute(events, limit, steps=4):
    """Steps done by the best attempt; events: (t, step)."""
    events, best = sorted(events), 0
    for at, (start, s) in enumerate(events):
        if s:
            continue
        done = 1
        for t, x in events[at + 1 :]:
            if t - start <= limit and x == done:
                done += 1
        best = max(best, done)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_summaries_combine(seed):
    """Any way of cutting a stream into ranges, and of bracketing them, gives what all attempts give."""
    rng = random.Random(seed)
    events = sorted((rng.randrange(60), rng.randrange(4)) for _ in range(rng.randrange(1, 60)))
    limit = rng.randrange(1, 40)
    cuts = sorted(rng.randrange(len(events) + 1) for _ in range(rng.randrange(6)))
    parts = []
    for low, high in zip([0, *cuts], [*cuts, len(events)]):
        part = N.Summary(4, limit)
        for t, s in events[low:high]:
            part.add(s, t)
        parts.append(part)
    while len(parts) > 1:
        at = rng.randrange(len(parts) - 1)
        parts[at : at + 2] = [parts[at].then(parts[at + 1])]
    assert parts[0].done == brute(events, limit)


def test_progress(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1, 2, 3, 4, None]), rng.choice("abcde"), rng.randrange(200)) for _ in range(400)] + [(9, "b", 1), (10, "e", 1)]
    df = spark.createDataFrame(rows, "user_id long, event string, m int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60))
    want = {}
    for who, event, t in rows:
        if event != "e":
            want.setdefault(who, []).append((t, "abcd".index(event)))
    got = {r.user_id: r.done for r in N.funnel_progress(df, steps(), 0.1).collect()}
    assert got == {who: brute(e, 6) for who, e in want.items()}


def test_attempts_restart(spark):
    """A search on day 1, then a search and a result within an hour on day 5."""
    at = lambda d, h: 86_400 * d + 3600 * h
    rows = [(1, "a", at(1, 0)), (1, "a", at(5, 0)), (1, "b", at(5, 1)), (2, "a", at(1, 0)), (2, "b", at(2, 1)), (3, "b", at(1, 0)), (3, "a", at(1, 0))]
    df = spark.createDataFrame(rows, "user_id long, event string, s long").select("user_id", "event", F.timestamp_seconds("s").alias("ts"), F.lit(False).alias("internal"))
    assert {r.step: r.users for r in N.funnel(df, steps(), 24).collect()} == {1: 3, 2: 2, 3: 0, 4: 0}
    assert N.funnel(df.limit(0), steps(), 24).collect() == []


def test_a_bot(spark):
    """A million events of one person lie in many ranges and combine."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("bot").alias("user_id"), F.when(F.col("id") == n - 1, "c").when(F.col("id") == n // 3, "b").when(F.col("id") % 1000 == 0, "a").otherwise("d").alias("event"), F.timestamp_seconds("id").alias("ts"))
    df = df.unionByName(df.limit(1).withColumn("user_id", F.lit("other")))
    # b comes 333 s after the last start before it, c 666,666 s later
    assert {r.user_id: r.done for r in N.funnel_progress(df, steps(), 100).collect()} == {"bot": 2, "other": 1}
    assert {r.user_id: r.done for r in N.funnel_progress(df, steps(), 186).collect()} == {"bot": 3, "other": 1}
