"""Tables written piece by piece: once each, and only what is touched."""

import os

from pyspark.sql import functions as F

from larder.operators import spend as S
from larder.sources import sinks as K

USAGE = "id long, url string, restaurant_id long, source string, tokens_in long, tokens_out long, cache_write_tokens long, cache_read_tokens long, cost_usd decimal(10,6), created_at timestamp"


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def usage(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id long").select(
        "id", F.lit(None).cast("string").alias("url"), F.lit(1).cast("long").alias("restaurant_id"), F.lit(None).cast("string").alias("source"),
        F.when(F.col("id") % 5 != 0, F.col("id")).otherwise(0).alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"), F.lit(None).cast("long").alias("cache_write_tokens"),
        F.lit(None).cast("long").alias("cache_read_tokens"), F.lit(0).cast("decimal(10,6)").alias("cost_usd"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20_000).alias("created_at"),
    )
    return df


def test_ledger_is_written_once(spark, tmp_path):
    src, out, cp = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    stream = lambda: spark.readStream.schema(USAGE).parquet(str(src / "d-*"))
    read = lambda: sorted(r.id for r in K.read_parts(spark, out, f"{USAGE}, date date, batch long, part date").collect())
    assert read() == []
    usage(spark, range(20)).write.parquet(str(src / "d-0"))
    S.append_usage_stream(stream(), out, cp)
    want = [i for i in range(20) if i % 5]
    assert read() == want
    S.append_usage_stream(stream(), out, cp)  # nothing new
    usage(spark, range(20, 30)).write.parquet(str(src / "d-1"))
    S.append_usage_stream(stream(), out, cp)
    assert read() == [i for i in range(30) if i % 5]
    # the batch is done again after a loss, over what it had written in part
    K.append_batch(S.ledger_rows(usage(spark, range(20, 30))).withColumn("part", F.col("date")), 1, out, "part")
    assert read() == [i for i in range(30) if i % 5]
    assert {r.source for r in K.read_parts(spark, out, f"{USAGE}, date date, batch long, part date").collect()} == {"product"}


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    out = f"file://{tmp_path}/table"
    rows = lambda pairs: spark.createDataFrame(pairs, "id long, v string, seq long")
    schema = "id long, v string, seq long, bucket int"
    read = lambda: {r.id: r.v for r in K.read_parts(spark, out, schema).collect()}
    K.upsert_table(rows([(i, "a", 1) for i in range(300)] + [(None, "null", 1)]), out, ["id"], "seq", 16)
    assert read() == {i: "a" for i in range(300)} | {None: "null"}
    before = files(tmp_path / "table")
    K.upsert_table(rows([(7, "b", 2), (7, "c", 3), (1000, "new", 1), (None, "other", 2)]), out, ["id"], "seq", 16)
    assert read() == {i: "a" for i in range(300)} | {7: "c", 1000: "new", None: "other"}
    after = files(tmp_path / "table")
    same = {f for f in before if after.get(f) == before[f]}
    assert 0 < len(before) - len(same) <= 3
    K.upsert_table(rows([]), out, ["id"], "seq", 16)
    K.upsert_table(rows([(7, "b", 2), (7, "c", 3), (1000, "new", 1), (None, "other", 2)]), out, ["id"], "seq", 16)  # again
    assert read() == {i: "a" for i in range(300)} | {7: "c", 1000: "new", None: "other"} and K.read_parts(spark, out, schema).count() == 302


def test_prune_drops_days_and_the_edge(spark, tmp_path):
    out = f"file://{tmp_path}/table"
    schema = "id long, created_at timestamp, date date, batch long"
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600)  # by the hour, from 2024-01-01
    rows = spark.range(96).select("id", F.when(F.col("id") != 50, at).alias("created_at"), F.to_date(at).alias("date"))
    for k in range(4):
        K.append_batch(rows.filter(F.col("id") % 4 == k), k, out)
    K.append_batch(rows.filter("id in (48, 49)").withColumn("id", F.col("id") + 1000), 9, out)
    before = files(tmp_path / "table")
    K.prune_table(spark, out, schema, "2024-01-03 06:00:00")
    left = sorted(r.id for r in K.read_parts(spark, out, schema).collect())
    assert left == [50, *range(54, 96)]
    after = files(tmp_path / "table")
    kept = [f for f in before if "date=2024-01-04" in f]
    assert kept and all(after[f] == before[f] for f in kept) and not any("date=2024-01-0" + d in f for f in after for d in "12")
    K.prune_table(spark, out, schema, "2024-01-03 06:00:00")
    assert K.read_parts(spark, out, schema).count() == len(left)
    assert K.drop_days(spark, f"file://{tmp_path}/none", "2024-01-01") == []
