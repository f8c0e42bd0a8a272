"""Streams in append mode: what waits for the watermark comes out, what is late does not."""

from pyspark.sql import functions as F

from larder.streaming import streams as R

EVENTS = "id long, event string, outcome string, user_id long, ts timestamp"
ATTEMPTS = "id long, anon_id string, url string, created_at timestamp"
HOUR, DAY_ONE = 3600, 1_699_999_200


def deliver(spark, folder, n, rows, schema, at):
    df = spark.createDataFrame(rows, schema.replace("timestamp", "long")).withColumn(at, F.timestamp_seconds(F.col(at) + DAY_ONE))
    df.coalesce(1).write.parquet(str(folder / f"delivery-{n}"))


def read(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(str(folder / "delivery-*"))


def test_late_rows_stay_out_of_windows(spark, tmp_path):
    """The second delivery's watermark acts from the third on; the raw table has the late row."""
    view = lambda i, t: (i, "results_viewed", "thin" if i % 2 else "menu", 1, t)
    deliver(spark, tmp_path, 0, [view(1, 10), view(2, 20), view(3, HOUR + 10)], EVENTS, "ts")
    r = R.Replay(R.thin_share, (read(spark, tmp_path, EVENTS), "ts", {"event": "results_viewed"}))
    assert r.run().collect() == []
    deliver(spark, tmp_path, 1, [view(4, 5 * HOUR)], EVENTS, "ts")
    r.run()
    deliver(spark, tmp_path, 2, [view(5, 30), view(6, 5 * HOUR + 1)], EVENTS, "ts")
    closed = {row.at: (row.thin, row.n) for row in r.close().select(F.unix_seconds("hour").alias("at"), "thin", "n").collect()}
    assert closed == {DAY_ONE: (1, 2), DAY_ONE + HOUR: (1, 1), DAY_ONE + 5 * HOUR: (0, 2)}
    assert spark.read.schema(EVENTS).parquet(str(tmp_path / "delivery-*")).filter("id = 5").count() == 1


def test_close_lets_all_out(spark, tmp_path):
    deliver(spark, tmp_path, 0, [(1, "search_submitted", None, 1, 10), (2, "results_viewed", "menu", 1, 40), (3, "search_submitted", None, None, 10 * HOUR)], EVENTS, "ts")
    got = R.replay_closed(R.sessions, (read(spark, tmp_path, EVENTS), "ts"))
    assert sorted((r.user_id or 0, r.n, r.abandoned) for r in got.collect()) == [(0, 1, True), (1, 2, False)]


def test_unmatched_searches_come_out(spark, tmp_path):
    d, a = tmp_path / "d", tmp_path / "a"
    deliver(spark, d, 0, [(1, "x", "u", 0), (2, "y", "u", 0), (3, None, "u", 0), (4, "x", "v", 9 * HOUR)], ATTEMPTS, "created_at")
    deliver(spark, a, 0, [(11, "x", "u", 100), (12, "x", "u", HOUR), (13, "x", "u", HOUR + 1), (14, None, "u", 5), (15, "y", "u", -1)], ATTEMPTS, "created_at")
    r = R.Replay(R.search_join, (read(spark, d, ATTEMPTS), "created_at"), (read(spark, a, ATTEMPTS), "created_at", R.NO_MATCH))
    assert {tuple(x) for x in r.run().collect()} >= {(1, 11), (1, 12)}
    assert sorted((x.discover_id, x.analyze_id or 0) for x in r.close().collect()) == [(1, 11), (1, 12), (2, 0), (3, 0), (4, 0)]
