"""Telemetry: search attempts and product events turned into sessions, trends, funnels, retention and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.misc import attempt_outcome, error_code
from larder.functions.urls import url_domain
from larder.sources.sinks import append_stream

from .funnels import funnel  # noqa: F401


def build_attempts(raw: DataFrame) -> DataFrame:
    """Attempts with domain, error_code and outcome."""
    given = F.col("outcome") if "outcome" in raw.columns else F.lit(None).cast("string")
    code = F.when(~F.col("success"), error_code(F.col("error_message")))
    return raw.withColumns({"domain": url_domain(F.col("url")), "error_code": code, "outcome": attempt_outcome(given, F.col("success"), F.col("dish_count"))})


def append_attempts_stream(raw: DataFrame, path: str, checkpoint: str) -> None:
    """Adds the attempts that the stream `raw` has not given yet to a table by date, each row once."""
    append_stream(raw, path, checkpoint, lambda df: build_attempts(df).withColumn("date", F.to_date("created_at")))


def search_sessions(attempts: DataFrame) -> DataFrame:
    """Each analyze attempt with the latest earlier discover attempt of the same person and url. Unknown people stay unpaired."""
    before = W.partitionBy("anon_id", "url").orderBy("created_at", F.when(F.col("stage") == "discover", 0).otherwise(1), "id").rowsBetween(W.unboundedPreceding, -1)
    seen = F.when(F.col("stage") == "discover", F.struct("id", "created_at"))
    columns = ["id", "anon_id", "url", "created_at", "stage"]
    known = attempts.filter("anon_id is not null").select(*columns).withColumn("d", F.last(seen, True).over(before)).filter("stage = 'analyze'")
    others = attempts.filter("anon_id is null and stage = 'analyze'").select(*columns)
    found = known.select("id", F.col("d.id").alias("discover_id"), (F.unix_micros("created_at") - F.unix_micros("d.created_at")).alias("gap_us"))
    return found.unionByName(others.select("id", F.lit(None).cast("bigint").alias("discover_id"), F.lit(None).cast("bigint").alias("gap_us")))


def search_tiles(attempts: DataFrame) -> DataFrame:
    """Outcomes of analyze attempts: one row."""
    rows = attempts.filter("stage = 'analyze'")
    is_ = lambda x: F.count_if(F.coalesce(F.col("outcome") == x, F.lit(False)))
    return rows.agg(is_("menu").alias("menu"), is_("thin").alias("thin"), F.count_if(~F.col("success")).alias("failed"))


def recent_searches(attempts: DataFrame, n: int = 200) -> DataFrame:
    return attempts.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def daily_users(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct users by day; approximate: as a mergeable sketch, for roll-ups."""
    rows = events.filter("not internal").groupBy(F.to_date("ts").alias("day"))
    return rows.agg(F.hll_sketch_agg("user_id").alias("users")) if approximate else rows.agg(F.count_distinct("user_id").alias("users"))


def trend(events: DataFrame, event: str, breakdown: str | None = None) -> DataFrame:
    """Events by day, of other than internal users, optionally by a property."""
    keys = [F.to_date("ts").alias("day")] + [F.col(breakdown)] * (breakdown is not None)
    return events.filter((F.col("event") == event) & ~F.col("internal")).groupBy(*keys).agg(F.count("*").alias("n"))


def daily_ratio(events: DataFrame, part: Column, whole: Column) -> DataFrame:
    """Share of events by day that one condition makes of another; null where there is nothing to share."""
    rows = events.filter("not internal").groupBy(F.to_date("ts").alias("day"))
    return rows.agg(F.count_if(part).alias("part"), F.count_if(whole).alias("whole")).withColumn("ratio", F.try_divide("part", "whole"))


def histogram(events: DataFrame, prop: str, bins: int) -> DataFrame:
    """Counts in bins of equal width between the least and the greatest value."""
    values = events.filter(F.col(prop).isNotNull()).select(F.col(prop).cast("double").alias("v"))
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))))
    return values.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def retention(events: DataFrame, event: str, weeks: int = 9) -> DataFrame:
    """(cohort, offset, users): people by the week of their first event, and in which later weeks they came again."""
    week = F.date_trunc("week", "ts").cast("date")
    visits = events.filter((F.col("event") == event) & ~F.col("internal")).select("user_id", week.alias("week")).distinct()
    cohort = visits.withColumn("cohort", F.min("week").over(W.partitionBy("user_id")))
    return cohort.withColumn("offset", (F.datediff("week", "cohort") / 7).cast("int")).filter(F.col("offset") < weeks).groupBy("cohort", "offset").agg(F.count("*").alias("users"))


def domain_outcomes(events: DataFrame) -> DataFrame:
    return events.groupBy("domain").agg(F.count_if(F.col("event") == "search_submitted").alias("searches"), F.count_if((F.col("event") == "results_viewed") & (F.col("outcome") == "menu")).alias("successes"), F.count_if(F.col("event") == "error_shown").alias("failures"))


def error_breakdown(events: DataFrame) -> DataFrame:
    return events.filter("event = 'error_shown'").groupBy("code", "surface").agg(F.count("*").alias("n"))


def voice(reports: DataFrame, feedback: DataFrame) -> DataFrame:
    """What people report, by kind."""
    a = reports.groupBy(F.lit("dish").alias("about"), F.col("issue_type").alias("kind")).agg(F.count("*").alias("n"))
    return a.union(feedback.groupBy(F.lit("restaurant"), "feedback_type").agg(F.count("*")))


def alerts(events: DataFrame, spike: int = 20, success: float = 0.6, thin: float = 0.4) -> DataFrame:
    """(kind, at, value): hours with many errors; days of low success or many thin results."""
    hours = events.filter("event = 'error_shown'").groupBy(F.date_trunc("hour", "ts").alias("at")).agg(F.count("*").cast("double").alias("value")).filter(F.col("value") >= spike)
    days = events.groupBy(F.date_trunc("day", "ts").alias("at")).agg(
        F.try_divide(F.count_if((F.col("event") == "results_viewed") & (F.col("outcome") == "menu")), F.count_if(F.col("event") == "search_submitted")).alias("ok"),
        F.try_divide(F.count_if((F.col("event") == "results_viewed") & (F.col("outcome") == "thin")), F.count_if(F.col("event") == "results_viewed")).alias("thin"),
    )
    low = days.filter(F.col("ok") < success).select(F.lit("success"), "at", F.col("ok"))
    return hours.select(F.lit("errors").alias("kind"), "at", "value").union(low).union(days.filter(F.col("thin") > thin).select(F.lit("thin"), "at", F.col("thin")))


def trailing_count(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Events of a key in the trailing seconds, this one included."""
    return events.withColumn("recent", F.count("*").over(W.partitionBy(key).orderBy(F.unix_seconds(at)).rangeBetween(-seconds, 0)))


def first_events(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The first event of each key."""
    return events.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("ts", "id"))).filter("_n = 1").drop("_n")


def prune(rows: DataFrame, as_of: Column, days: int = 180, at: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(kept, gone): rows younger and older than so many days."""
    old = F.coalesce(F.col(at) < as_of - F.expr(f"INTERVAL '{days}' DAY"), F.lit(False))
    return rows.filter(~old), rows.filter(old)
