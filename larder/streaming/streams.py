"""The write-time rules as streams, and their replay over files.

Windows carry a watermark of ten minutes; late rows stay in the raw tables and are left out of the windows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.scratch import scratch

LATE = "10 minutes"


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives its result: all rows of append or update, the last state of complete."""
    spark = stream.sparkSession
    out = scratch(spark, "stream")
    _run(stream, out, scratch(spark, "checkpoint"), mode)
    read = spark.read.schema(f"{_ddl(stream)}, batch bigint").parquet(out)
    if mode == "complete":
        read = read.filter(F.col("batch") == F.lit(read.agg(F.max("batch")).first()[0]))
    return read.drop("batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _run(stream: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    """What the stream has not given yet goes to out, each batch under its number, so that one done again is there once."""

    def keep(df: DataFrame, k: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={k}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


#: A time behind all others.
END = "2999-01-01 00:00:00"


class Replay:
    """A stream in append mode, delivery by delivery, and closed at its end.

    In append mode a window or an unmatched row comes out only when the watermark has passed it, so the last ones need something
    behind them. `close` delivers a row far in the future to each source, empty but for its time, and then another: the first
    moves the watermark, the second lets it act. Neither ever comes out itself.
    """

    def __init__(self, build, *sources: tuple):
        """build makes the stream of the sources; each is a stream, its time column and, where build looks at some rows only, the
        values by which it takes the last row for one of them."""
        self.spark = sources[0][0].sparkSession
        self.out, self.checkpoint = scratch(self.spark, "stream"), scratch(self.spark, "checkpoint")
        self.ends, opened = [], []
        for stream, at, *like in sources:
            folder = scratch(self.spark, "end")
            last = {at: END} | (like[0] if like else {})
            columns = [F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema]
            self.ends.append((folder, self.spark.range(1).select(*columns)))
            self.spark.range(0).select(*columns).write.parquet(folder)
            opened.append(stream.unionByName(self.spark.readStream.schema(stream.schema).parquet(folder)))
        self.stream = build(*opened)

    def run(self) -> DataFrame:
        """All rows that have come out so far, after what the sources have by now."""
        _run(self.stream, self.out, self.checkpoint, "append")
        return self.spark.read.schema(f"{_ddl(self.stream)}, batch bigint").parquet(self.out).drop("batch")

    def close(self) -> DataFrame:
        """All rows, those included that waited for the watermark."""
        self.run()
        for _ in range(2):
            for folder, end in self.ends:
                end.write.mode("append").parquet(folder)
            rows = self.run()
        return rows


def replay_closed(build, *sources: tuple) -> DataFrame:
    """The whole result of a stream in append mode over what its sources have."""
    return Replay(build, *sources).close()


def attempts_by_hour(attempts: DataFrame) -> DataFrame:
    """Outcomes and error codes by hour. attempts: created_at, outcome, error_code."""
    return attempts.withWatermark("created_at", LATE).groupBy(F.window("created_at", "1 hour").alias("w"), "outcome", "error_code").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "outcome", "error_code", "n")


def success_ratio(events: DataFrame, below: float = 0.6) -> DataFrame:
    """Share of searches that showed a menu, over a day, moved by the hour; low marks an alert."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", "24 hours", "1 hour").alias("w")).agg(F.count_if((F.col("event") == "results_viewed") & (F.col("outcome") == "menu")).alias("ok"), F.count_if(F.col("event") == "search_submitted").alias("searches"))
    return w.select(F.col("w.start").alias("start"), "ok", "searches", F.try_divide("ok", "searches").alias("ratio")).withColumn("low", F.coalesce(F.col("ratio") < below, F.lit(False)))


def thin_share(events: DataFrame) -> DataFrame:
    w = events.filter("event = 'results_viewed'").withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count_if(F.col("outcome") == "thin").alias("thin"), F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("hour"), "thin", "n")


def spend_by_hour(log: DataFrame) -> DataFrame:
    w = log.withWatermark("created_at", LATE).groupBy(F.window("created_at", "1 day").alias("w"), "source").agg(F.sum("cost_usd").alias("cost"), F.count_if(F.col("restaurant_id").isNull() & F.col("url").isNull()).alias("unattributed"))
    return w.select(F.col("w.start").alias("day"), "source", "cost", "unattributed")


def report_flags(reports: DataFrame, at: int = 3) -> DataFrame:
    """Dishes with their running report count, flagged from `at` on; update mode."""
    return reports.groupBy("dish_id").agg(F.count("*").alias("reports")).withColumn("flagged", F.col("reports") >= at)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions of users; abandoned: searched and never saw a result."""
    w = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event") == "search_submitted").alias("searches"), F.count_if(F.col("event").isin("results_viewed", "error_shown")).alias("ends"))
    return w.select("user_id", F.col("w.start").alias("start"), "n", ((F.col("searches") > 0) & (F.col("ends") == 0)).alias("abandoned"))


def search_join(discover: DataFrame, analyze: DataFrame, within: str = "1 hour") -> DataFrame:
    """Discover attempts with the analyze attempts of the same person and url that follow in time."""
    d = discover.selectExpr("id as discover_id", "anon_id", "url", "created_at as at").withWatermark("at", LATE)
    a = analyze.selectExpr("id as analyze_id", "anon_id as anon", "url as u", "created_at as then").withWatermark("then", LATE)
    return d.join(a, F.expr(f"anon_id = anon and url = u and then >= at and then <= at + interval {within}"), "leftOuter").select("discover_id", "analyze_id")


#: For the last row of the analyze attempts: those without a person or url never reach the join, and so move no watermark.
NO_MATCH = {"anon_id": "", "url": ""}


def distinct_views(events: DataFrame) -> DataFrame:
    """One results_viewed a user and result within the watermark."""
    return events.filter("event = 'results_viewed'").withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["user_id", "domain"])


def accepted(times: list[int], held: list[int], most: int, span: int) -> tuple[list[bool], list[int]]:
    """Which of the times (seconds, in order) are let through, at most so many accepted ones in any span behind; what is held."""
    verdicts = []
    for t in times:
        held = [h for h in held if h > t - span]
        verdicts.append(len(held) < most)
        if verdicts[-1]:
            held.append(t)
    return verdicts, held


def rate_limit_batch(events: DataFrame, key: str = "ip_hash", most: int = 15, span: int = 3600) -> DataFrame:
    """events: key, id, created_at. Adds allowed: fewer than `most` accepted ones of the key in the last `span` seconds. Each key's
    rows are walked in order of time, one by one, with its last accepted times in hand."""

    def run(frames):
        now, held = None, []
        for pdf in frames:
            allowed = []
            for k, at in zip(pdf[key].tolist(), pdf["at"].tolist()):
                if k != now:
                    now, held = k, []
                (verdict,), held = accepted([at], held, most, span)
                allowed.append(verdict)
            yield pd.DataFrame({"id": pdf["id"], key: pdf[key], "allowed": allowed})

    rows = events.select(key, "id", F.unix_seconds("created_at").alias("at"))
    return rows.repartition(key).sortWithinPartitions(key, "at", "id").mapInPandas(run, f"id bigint, {key} string, allowed boolean")
