"""Limits by address, as batches of a stream, against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from larder.streaming import limits as M
from larder.streaming import streams as R

SPAN = 86_400
EVENTS = "id long, ip_hash string, created_at timestamp"
VOTES = "id long, email string, city string, country string, region string, is_custom boolean, ip_hash string, created_at timestamp"


def when(t):
    return F.timestamp_seconds(F.lit(1_700_000_000) + t)


def delivered(spark, folder, rows, schema, n):
    """One more file of rows; `created_at` in seconds."""
    df = spark.createDataFrame(rows, schema.replace("timestamp", "long")).withColumn("created_at", when(F.col("created_at")))
    df.coalesce(1).write.parquet(str(folder / f"delivery-{n}"))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(str(folder / "delivery-*"))


def plain(rows, held, most, span):
    """Verdicts of rows (id, key, t) in their order; held: key to accepted times."""
    out = {}
    for i, k, t in rows:
        out[i] = sum(x > t - span for x in held.setdefault(k, [])) < most
        held[k] += [t] * out[i]
    return out


def test_rate_limit_goes_on(spark, tmp_path):
    """Three deliveries, one with late rows and a null key, into one home; then nothing new."""
    rng, held, want = random.Random(3), {}, {}
    home, folder = f"file://{tmp_path}/home", tmp_path / "in"
    for n, (low, high) in enumerate([(0, 9000), (6000, 20_000), (30_000, 33_000)]):
        rows = [(n * 1000 + i, rng.choice(["a", "b", "c", None]), rng.randrange(low, high)) for i in range(400)]
        want |= plain(sorted(rows, key=lambda r: (r[2], r[0])), held, 5, 3600)
        delivered(spark, folder, rows, EVENTS, n)
        got = {r.id: r.allowed for r in M.rate_limit(stream(spark, folder, EVENTS), most=5, home=home).collect()}
        assert got == want
    assert {r.id: r.allowed for r in M.rate_limit(stream(spark, folder, EVENTS), most=5, home=home).collect()} == want


def test_a_batch_done_again_changes_nothing(spark, tmp_path):
    home = f"file://{tmp_path}/home"
    batch = lambda n: spark.range(n * 100, n * 100 + 60).select("id", F.lit("a").alias("ip_hash"), when(F.col("id") * 30).alias("created_at"))
    read = lambda: sorted(map(tuple, M._table(spark, f"{home}/verdicts", M._VERDICTS).collect()))
    for k in (0, 1):
        M.limit_batch(batch(k), k, home, "ip_hash", 5, 3600)
    once = read()
    M.limit_batch(batch(1), 1, home, "ip_hash", 5, 3600)
    assert read() == once and len(once) == 120


def test_a_hot_key_is_walked_in_pieces(spark):
    """Half a million rows of one address against a plain walk; no frame holds more than a batch."""
    n = 500_000
    rows = spark.range(n).select(F.lit("hot").alias("key"), ((F.col("id") * 7919) % n).alias("at"), "id", F.lit(None).cast("string").alias("mark"))
    held = spark.createDataFrame([("hot", [-10, -3600])], "key string, times array<long>")
    out = M._walked(rows, held, 15, 3600)
    times = [t for (t,) in out.filter("verdict = 'accepted'").select("at").collect()]
    want, kept = [], [-10]
    for t in range(n):
        kept = [x for x in kept if x > t - 3600]
        if len(kept) < 15:
            kept.append(t)
            want.append(t)
    assert sorted(times) == want and out.filter("verdict is null").first().times == want[-15:]


def test_refused_votes_can_come_again(spark, tmp_path):
    home, folder = f"file://{tmp_path}/home", tmp_path / "in"
    vote = lambda i, who, t, ip="x", city="Dublin": (i, who, city, None, "Europe", True, ip, t)
    run = lambda: {r.id: r.verdict for r in M.vote_ingest(stream(spark, folder, VOTES), home, most=2)[1].collect()}
    delivered(spark, folder, [vote(1, "a", 10), vote(2, "b", 20), vote(3, "c", 30), vote(4, "A", 40), vote(5, "d", 50, "y")], VOTES, 0)
    first = {1: "accepted", 2: "accepted", 3: "refused", 4: "repeat", 5: "accepted"}
    assert run() == first
    delivered(spark, folder, [vote(6, "c", 4 * SPAN), vote(7, "b", 4 * SPAN, "y"), vote(8, "c", 4 * SPAN + 1, "z", "dublin")], VOTES, 1)
    assert run() == first | {6: "accepted", 7: "repeat", 8: "repeat"} == run()
    accepted = M.vote_ingest(stream(spark, folder, VOTES), home, most=2)[0]
    assert sorted(r.id for r in accepted.collect()) == [1, 2, 5, 6]


def test_a_lost_vote_gives_its_place_back(spark, tmp_path):
    """Address y spends one of its two places on a vote that x had before; its third vote then fits."""
    home = f"file://{tmp_path}/home"
    rows = [(1, "p", "x", 10), (2, "p", "y", 20), (3, "q", "y", 30), (4, "r", "y", 40), (5, "s", "y", 50)]
    batch = spark.createDataFrame(rows, "id long, email string, ip_hash string, t long").select("id", "email", F.lit("C").alias("city"), F.lit(None).cast("string").alias("country"), "ip_hash", when(F.col("t")).alias("created_at"), F.lit(None).cast("string").alias("error"))
    for _ in range(2):  # the second time is a replay
        M.vote_batch(batch, 0, home, most=2)
        told = {r.id: r.verdict for r in M._table(spark, f"{home}/told", M._TOLD).collect()}
        assert told == {1: "accepted", 2: "repeat", 3: "accepted", 4: "accepted", 5: "refused"}


@pytest.mark.parametrize("seed", [1, 2])
def test_votes_keep_the_rules(spark, tmp_path, seed):
    """Each vote once; no address over its limit; nothing refused without cause; a verdict for every vote."""
    rng = random.Random(seed)
    home = f"file://{tmp_path}/home"
    rows = [(i, f"p{rng.randrange(40)}", rng.choice("uvwxyz"), rng.randrange(3 * SPAN)) for i in range(500)]
    at = {i: t for i, _, _, t in rows}
    for k in range(2):
        part = [r for r in rows if r[0] % 2 == k]
        batch = spark.createDataFrame(part, "id long, email string, ip_hash string, t long").select("id", "email", F.lit("C").alias("city"), F.lit("L").alias("country"), "ip_hash", when(F.col("t")).alias("created_at"), F.lit(None).cast("string").alias("error"))
        M.vote_batch(batch, k, home, most=3)
    told = {r.id: r.verdict for r in M._table(spark, f"{home}/told", M._TOLD).collect()}
    assert set(told) == set(at)
    good = [r for r in rows if told[r[0]] == "accepted"]
    assert len({r[1] for r in good}) == len(good)
    for i, who, ip, t in rows:
        if told[i] == "accepted":
            # whatever the order they were let in, the last of them saw the others
            assert sum(x[2] == ip and t - SPAN < x[3] <= t for x in good) <= 3
        elif told[i] == "repeat":
            assert who in {x[1] for x in good}
        else:
            assert sum(x[2] == ip and x[3] > t - SPAN for x in good) >= 3


def test_checks(spark, tmp_path):
    home, folder = f"file://{tmp_path}/home", tmp_path / "in"
    cities = spark.createDataFrame([("Dublin", "Ireland", "Europe")], "city string, country string, region string")
    ip = "0123456789abcdef"
    rows = [
        (1, " Me@X.ie ", " dublin", "Ireland", "Europe", False, ip, 1), (2, "me@x.ie", "Dublin", "Ireland", "Europe", False, ip, 2), (3, "me@x.ie", "Cork", "Ireland", "Europe", False, ip, 3),
        (4, "me@x.ie", "Cork", "Ireland", "Europe", True, ip, 4), (5, "x", "Dublin", "Ireland", "Europe", False, ip, 5), (6, None, "Dublin", "Ireland", "Europe", False, ip, 6), (7, "you@x.ie", "Dublin", "Ireland", "Europe", False, "1.2.3.4", 7),
    ]
    delivered(spark, folder, rows, VOTES, 0)
    accepted, told = M.vote_ingest(stream(spark, folder, VOTES), home, cities=cities)
    assert {r.id: r.verdict for r in told.collect()} == {1: "accepted", 2: "repeat", 3: "invalid: not listed", 4: "accepted", 5: "invalid: email", 6: "invalid: email", 7: "invalid: ip_hash"}
    assert sorted((r.email, r.city, r.country) for r in accepted.collect()) == [("me@x.ie", "Cork", None), ("me@x.ie", "Dublin", "Ireland")]


def test_times_alone(spark):
    assert R.accepted([1, 2, 3], [], 2, 10)[0] == [True, True, False]
