"""The golden set: verdicts, accuracy, confusion, coverage, corrections, and the inbox of reports and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.misc import MIN_DISHES, feedback_action
from larder.functions.urls import url_normalize

LABELS = ["vegan", "vegetarian", "neither", "unknown"]


def dish_accuracy(eval_dishes: DataFrame) -> DataFrame:
    """One row: dishes with a first guess, correct ones, share, and unsafe ones (a veg guess on a dish that is neither)."""
    scored = eval_dishes.filter("ai_original is not null")
    n, ok = F.count("*"), F.count_if(F.col("ai_original") == F.col("expected"))
    return scored.agg(n.alias("scored"), ok.alias("correct"), F.try_divide(ok * 100, n).alias("pct"), F.count_if((F.col("expected") == "neither") & F.col("ai_original").isin("vegan", "vegetarian")).alias("unsafe"))


def confusion(eval_dishes: DataFrame) -> DataFrame:
    """Rows: what it is; columns: what was guessed first. Empty cells are 0."""
    spark = eval_dishes.sparkSession
    rows = spark.createDataFrame([(x,) for x in LABELS], "expected string")
    counts = eval_dishes.filter("ai_original is not null").groupBy("expected").pivot("ai_original", LABELS).agg(F.count(F.lit(1)))
    return rows.join(counts, "expected", "left").na.fill(0, LABELS)


def eval_live(cases: DataFrame, restaurants: DataFrame) -> DataFrame:
    """(case_id, restaurant_id): by url, else by canonical url, both without regard to case; the smallest id."""
    named = restaurants.select("id", F.explode(F.array(F.struct(F.lit(1).alias("level"), F.lower("url").alias("u")), F.struct(F.lit(2).alias("level"), F.lower("canonical_url").alias("u")))).alias("k")).select("id", "k.level", "k.u")
    hits = cases.select(F.col("id").alias("case_id"), F.lower("url").alias("u")).join(named, "u")
    best = hits.groupBy("case_id").agg(F.min(F.struct("level", "id")).getField("id").alias("restaurant_id"))
    return cases.select(F.col("id").alias("case_id")).join(best, "case_id", "left")


def eval_coverage(eval_dishes: DataFrame, live: DataFrame) -> DataFrame:
    """live: case_id, name. Golden dishes that are still on the live menu."""
    key = F.lower(F.trim("name")).alias("_k")
    return eval_dishes.withColumn("_k", key).join(live.select("case_id", key).distinct(), ["case_id", "_k"], "left_semi").drop("_k")


def score_cases(cases: DataFrame, eval_dishes: DataFrame, live: DataFrame) -> DataFrame:
    still = eval_coverage(eval_dishes, live).groupBy("case_id").agg(F.count("*").alias("still_live"))
    unsafe = (F.col("expected") == "neither") & F.col("ai_original").isin("vegan", "vegetarian")
    scored = eval_dishes.groupBy("case_id").agg(F.count("*").alias("total"), F.count("ai_original").alias("scored"), F.count_if(F.col("ai_original") == F.col("expected")).alias("correct"), F.array_sort(F.collect_list(F.when(unsafe, F.trim("name")))).alias("unsafe"))
    out = cases.select(F.col("id").alias("case_id")).join(scored, "case_id", "left").join(still, "case_id", "left").fillna(0, ["total", "scored", "correct", "still_live"])
    return out.withColumn("pct", F.try_divide(F.col("correct") * 100, "scored"))


def discovery_accuracy(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: reviewed cases, and those without a missed menu or a spurious or duplicate candidate."""
    reviewed = cases.filter("menus_reviewed_at is not null")
    clean = reviewed.filter("coalesce(trim(missed_menus), '') = ''").join(candidates.filter("verdict <> 'correct'").select(F.col("case_id").alias("id")), "id", "left_anti")
    return reviewed.agg(F.count("*").alias("reviewed")).crossJoin(clean.agg(F.count("*").alias("clean"))).withColumn("pct", F.try_divide(F.col("clean") * 100, "reviewed"))  # one row each


def correction_log(cases: DataFrame, eval_dishes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(case_id, kind, detail): misread dishes, unsafe ones first in kind, and what discovery got wrong."""
    wrong = eval_dishes.filter("ai_original is not null and ai_original <> expected")
    kind = F.when((F.col("expected") == "neither") & F.col("ai_original").isin("vegan", "vegetarian"), "1 unsafe").otherwise("2 misread")
    a = wrong.select("case_id", kind.alias("kind"), F.concat_ws(" ", F.trim("name"), "ai_original", F.lit("->"), "expected").alias("detail"))
    b = candidates.filter("verdict <> 'correct'").select("case_id", F.concat(F.lit("3 "), F.col("verdict")), "label")
    c = cases.filter("trim(missed_menus) <> ''").select("id", F.lit("4 missed"), F.trim("missed_menus"))
    return a.union(b).union(c)


def feedback_inbox(reports: DataFrame, feedback: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Reports and feedback under one schema, with the action each leads to and the restaurant's name if it still is there."""
    a = reports.select(F.lit("dish").alias("about"), "id", "restaurant_id", F.col("issue_type").alias("kind"), "dish_id", "created_at", "status")
    b = feedback.select(F.lit("restaurant").alias("about"), "id", "restaurant_id", F.col("feedback_type").alias("kind"), "created_at", "status")
    names = restaurants.select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant"))
    return a.unionByName(b, allowMissingColumns=True).join(names, "restaurant_id", "left").withColumn("action", feedback_action(F.col("kind")))


def restaurant_feedback(inbox: DataFrame, restaurant_id) -> DataFrame:
    return inbox.filter(F.col("restaurant_id") == restaurant_id)


def review_badges(restaurants: DataFrame, dishes: DataFrame, cases: DataFrame, reports: DataFrame, feedback: DataFrame) -> DataFrame:
    """(id, menus_reviewed, reviewed_dishes, live_dishes, open_feedback)."""
    live = dishes.filter("deleted_at is null").groupBy("restaurant_id").agg(F.count("*").alias("live_dishes"), F.count_if("human_verified").alias("reviewed_dishes"))
    waiting = reports.filter("status = 'open'").select("restaurant_id").union(feedback.filter("status = 'open'").select("restaurant_id")).groupBy("restaurant_id").agg(F.count("*").alias("open_feedback"))
    keys = cases.filter("menus_reviewed_at is not null").select(url_normalize(F.col("url")).alias("u")).distinct()
    urls = restaurants.select("id", F.explode(F.array("url", "canonical_url")).alias("x")).filter("x is not null").select("id", url_normalize(F.col("x")).alias("u"))
    reviewed = urls.join(keys, "u", "left_semi").select("id").distinct().withColumn("menus_reviewed", F.lit(True))
    on = lambda df: df.withColumnRenamed("restaurant_id", "id")
    out = restaurants.select("id").join(reviewed, "id", "left").join(on(live), "id", "left").join(on(waiting), "id", "left")
    return out.select("id", F.coalesce("menus_reviewed", F.lit(False)).alias("menus_reviewed"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("reviewed_dishes", "live_dishes", "open_feedback")))


def dish_counts(dishes: DataFrame) -> DataFrame:
    return dishes.filter("deleted_at is null").groupBy("restaurant_id").agg(F.count("*").alias("live"), F.count_if("human_verified").alias("verified"))


def fetch_failures(restaurants: DataFrame, dishes: DataFrame) -> DataFrame:
    rows = restaurants.join(dish_counts(dishes).withColumnRenamed("restaurant_id", "id"), "id", "left").fillna(0, ["live"])
    return rows.filter((F.col("status").isin("error", "no_menu")) | ((F.col("status") == "done") & (F.col("live") == 0))).select("id", "status", "live")


def low_dish(restaurants: DataFrame, dishes: DataFrame, below: int = MIN_DISHES) -> DataFrame:
    rows = restaurants.join(dish_counts(dishes).withColumnRenamed("restaurant_id", "id"), "id")
    return rows.filter((F.col("status") == "done") & (F.col("live") > 0) & (F.col("live") < below)).select("id", "live")


def hallucinated(dishes: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Dishes the model made up: soft-deleted ones of its own, with their restaurant."""
    gone = dishes.filter("deleted_at is not null and origin = 'ai'").select(F.col("id").alias("dish_id"), "restaurant_id", F.col("name").alias("dish"))
    return gone.join(restaurants.select(F.col("id").alias("restaurant_id"), "name", "url"), "restaurant_id", "left")


def report_activity(dishes: DataFrame, restaurants: DataFrame, n: int = 50) -> DataFrame:
    rows = dishes.filter("raw_reports > 0").select(F.col("id").alias("dish_id"), "restaurant_id", F.col("name").alias("dish"), "raw_reports").orderBy(F.desc("raw_reports"), "dish_id").limit(n)
    return rows.join(restaurants.select(F.col("id").alias("restaurant_id"), "name"), "restaurant_id")


def first_guess(verdicts: DataFrame) -> DataFrame:
    """verdicts: case_id, name, seq, ai_guess, expected. One golden row a dish: last answer, first guess, never overwritten."""
    key = F.lower(F.trim("name"))
    w = W.partitionBy("case_id", key)
    rows = verdicts.withColumns({"ai_original": F.first("ai_guess", True).over(w.orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "_n": F.row_number().over(w.orderBy(F.desc("seq")))})
    return rows.filter("_n = 1").select("case_id", "name", "expected", "ai_original")


def upsert_verdicts(candidates: DataFrame) -> DataFrame:
    """The last verdict of every (case, label), labels without regard to case."""
    w = W.partitionBy("case_id", F.lower("label")).orderBy(F.desc("id"))
    return candidates.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def eval_export(eval_dishes: DataFrame, candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """Dishes, candidates and missed menus as rows of one table."""
    a = eval_dishes.select(F.lit("dish").alias("kind"), "case_id", F.col("name").alias("what"), F.col("expected").alias("verdict"))
    b = candidates.select(F.lit("menu").alias("kind"), "case_id", F.col("label").alias("what"), "verdict")
    c = cases.filter("trim(missed_menus) <> ''").select(F.lit("missed").alias("kind"), F.col("id").alias("case_id"), F.col("missed_menus").alias("what"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


def ensure_cases(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: url. Rows for urls that no case has yet, without regard to case."""
    have = cases.select(F.lower("url").alias("_u"))
    return wanted.withColumn("_u", F.lower("url")).join(have, "_u", "left_anti").groupBy("_u").agg(F.min("url").alias("url")).select("url")
