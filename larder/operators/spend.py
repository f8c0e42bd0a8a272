"""Spend: reports over the usage ledger and over restaurants' last analyses. Money is decimal throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.misc import usage_cost
from larder.sources.sinks import append_stream


def _sum(c: str, digits: int) -> Column:
    return F.round(F.sum(c), digits)


def _avg(c: str, digits: int) -> Column:
    return F.round(F.sum(c) / F.count(c), digits)


def spend_total(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def spend_by_week(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("week", "created_at").cast("date").alias("week")).agg(F.count("*").alias("calls"), _sum("cost_usd", 4).alias("cost"))


def spend_current(restaurants: DataFrame) -> DataFrame:
    return restaurants.filter("status = 'done' and cost_usd is not null").agg(F.count("*").alias("n"), _sum("cost_usd", 4).alias("cost"), F.sum("tokens_in").alias("tokens_in"))


def spend_by_day(restaurants: DataFrame, as_of: Column) -> DataFrame:
    """The 30 days before as_of."""
    recent = restaurants.filter(F.col("last_scraped_at").isNotNull() & (F.col("last_scraped_at") >= as_of - F.expr("INTERVAL '30' DAY")) & (F.col("last_scraped_at") <= as_of))
    return recent.groupBy(F.to_date("last_scraped_at").alias("day")).agg(F.count("*").alias("n"), _sum("cost_usd", 4).alias("cost"))


def spend_by_model(restaurants: DataFrame) -> DataFrame:
    return restaurants.filter("model_used is not null and cost_usd is not null").groupBy("model_used").agg(F.count("*").alias("n"), _sum("cost_usd", 4).alias("cost"), F.sum("cost_usd").alias("exact"))


def cache_rate(restaurants: DataFrame) -> DataFrame:
    return restaurants.agg(F.count("*").alias("n"), F.count("cost_usd").alias("with_cost"), F.count_if(F.col("cost_usd").isNull()).alias("without_cost"))


def cost_projection(restaurants: DataFrame, sizes: tuple[int, ...] = (100, 500, 2000)) -> DataFrame:
    """The mean analysis cost carried on to so many restaurants."""
    mean = restaurants.filter("cost_usd is not null").agg(F.sum("cost_usd").alias("s"), F.count("*").alias("n"))
    return mean.select(*(F.round(F.col("s") * k / F.col("n"), 2).alias(f"for_{k}") for k in sizes))


def status_counts(restaurants: DataFrame) -> DataFrame:
    return restaurants.groupBy("status").agg(F.count("*").alias("n"))


def unattributed_spend(log: DataFrame, grain: str = "hour") -> DataFrame:
    """Calls that name neither restaurant nor url, by hour or day."""
    return log.filter("restaurant_id is null and url is null").groupBy(F.date_trunc(grain, "created_at").alias("at")).agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"))


def spend_by_source(log: DataFrame, rolled_up: bool = False) -> DataFrame:
    month = F.date_trunc("month", "created_at").cast("date").alias("month")
    rows = log.select("source", month, "cost_usd")
    keyed = rows.rollup("month", "source") if rolled_up else rows.groupBy("month", "source")
    return keyed.agg(F.count("*").alias("calls"), F.sum("cost_usd").alias("cost"))


def reconcile(log: DataFrame, reported: DataFrame, grain: str = "hour") -> DataFrame:
    """reported: run_id, started, ended, cost. What the ledger holds of each run's window, and the difference.

    A run is laid out as the hours (or days) of its window, so calls and runs meet in an equi-join and the bounds are checked
    there; a run without calls, or without bounds, has an empty ledger.
    """
    hours = F.sequence(F.date_trunc(grain, "started"), F.col("ended"), F.expr(f"INTERVAL '1' {grain}"))
    laid = reported.withColumn("_at", F.explode_outer(F.when(F.col("started") <= F.col("ended"), hours)))
    calls = log.select("created_at", F.col("cost_usd").alias("_cost"), F.date_trunc(grain, "created_at").alias("_hour"))
    inside = laid.join(calls, (F.col("_at") == F.col("_hour")) & (F.col("created_at") >= F.col("started")) & (F.col("created_at") < F.col("ended")), "left")
    return inside.groupBy("run_id", "cost").agg(F.coalesce(F.sum("_cost"), F.lit(0)).alias("ledger")).withColumn("gap", F.col("ledger") - F.col("cost"))


def spend_today(log: DataFrame, attempts: DataFrame, reports: DataFrame, feedback: DataFrame, as_of: Column) -> DataFrame:
    """One row: spend and error rate since midnight of as_of, and open feedback."""
    since = F.date_trunc("day", as_of)
    cost = log.filter((F.col("created_at") >= since) & (F.col("created_at") <= as_of)).agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("spend"))
    tries = attempts.filter((F.col("created_at") >= since) & (F.col("created_at") <= as_of)).agg((F.count_if(~F.col("success")) / F.nullif(F.count("*"), F.lit(0))).alias("error_rate"))
    waiting = reports.filter("status = 'open'").select("id").union(feedback.filter("status = 'open'").select("id")).agg(F.count("*").alias("open_feedback"))
    return cost.crossJoin(tries).crossJoin(waiting)  # one row each


def with_cost(log: DataFrame, prices: DataFrame, default: tuple[float, float] = (3.0, 15.0)) -> DataFrame:
    """log with `cost`. prices: model_used, price_in, price_out per million tokens; other models cost the default. A model that is
    listed twice costs what its dearer row says."""
    once = prices.groupBy("model_used").agg(F.max(F.struct("price_in", "price_out")).alias("_p")).select("model_used", "_p.price_in", "_p.price_out")
    known = log.join(once, "model_used", "left")
    money = lambda c, d: F.coalesce(c, F.lit(d)).cast("decimal(8,4)")
    plain = F.col("tokens_in") - F.col("cache_write_tokens") - F.col("cache_read_tokens")
    cost = usage_cost(F.greatest(plain, F.lit(0)), F.col("tokens_out"), F.col("cache_write_tokens"), F.col("cache_read_tokens"), money("price_in", default[0]), money("price_out", default[1]))
    return known.withColumn("cost", cost.cast("decimal(12,6)")).drop("price_in", "price_out")


def sum_usage(usage: DataFrame, *keys: str) -> DataFrame:
    """Calls folded by key: models joined by `+` in order, tokens and cost summed."""
    return usage.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "model_used"))), lambda x: x["model_used"]), "+").alias("models"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost"))


def top_expensive(restaurants: DataFrame, n: int = 20) -> DataFrame:
    return restaurants.filter("cost_usd is not null").orderBy(F.desc("cost_usd"), "id").limit(n).select("id", "name", "cost_usd", "model_used")


def ledger_rows(usage: DataFrame) -> DataFrame:
    """Rows fit for the ledger: those that cost or read something, source and cache tokens filled in, by date."""
    used = usage.filter("coalesce(cost_usd, 0) <> 0 or coalesce(tokens_in, 0) <> 0 or coalesce(tokens_out, 0) <> 0")
    return used.withColumns({"source": F.coalesce("source", F.lit("product")), "cache_write_tokens": F.coalesce("cache_write_tokens", F.lit(0)), "cache_read_tokens": F.coalesce("cache_read_tokens", F.lit(0)), "date": F.to_date("created_at")})


def append_usage(usage: DataFrame, path: str) -> None:
    ledger_rows(usage).write.mode("append").partitionBy("date").parquet(path)


def append_usage_stream(usage: DataFrame, path: str, checkpoint: str, by: str = "day") -> None:
    """Adds what the stream `usage` has not given yet to a ledger in partitions `part` of a day, week or month, each row once."""
    append_stream(usage, path, checkpoint, lambda df: ledger_rows(df).withColumn("part", F.to_date(F.date_trunc(by, "created_at"))), "part")
