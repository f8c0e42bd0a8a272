"""Identity: which url belongs to which restaurant, duplicates and their survivors, guide membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.misc import MIN_DISHES
from larder.functions.urls import url_dedup_key, url_looks_like, url_normalize


def match_restaurants(incoming: DataFrame, restaurants: DataFrame) -> DataFrame:
    """incoming: url. Every distinct url with the id of the restaurant it means, or null.

    The key of a restaurant's url or canonical url decides; failing that, the normalised url does. The smallest id wins.
    """
    urls = F.explode(F.array_distinct(F.array_compact(F.array("url", "canonical_url")))).alias("u")
    known = restaurants.select("id", urls)
    keyed = lambda u: F.explode(F.array(F.struct(F.lit(1).alias("level"), url_dedup_key(u).alias("key")), F.struct(F.lit(2).alias("level"), url_normalize(u).alias("key")))).alias("k")
    by_key = known.select("id", keyed(F.col("u"))).groupBy("k.level", "k.key").agg(F.min("id").alias("id"))
    asked = incoming.select("url").distinct()
    hits = asked.select("url", keyed(F.col("url"))).select("url", "k.level", "k.key").join(by_key, ["level", "key"])
    best = hits.groupBy("url").agg(F.min(F.struct("level", "id")).getField("id").alias("restaurant_id"))
    return asked.join(best, "url", "left")


def survivors(restaurants: DataFrame, dishes: DataFrame) -> DataFrame:
    """(id, dedup_key, keep_id): of restaurants of one key, the one that is done, has most live dishes, was read last, stays."""
    live = dishes.filter("deleted_at is null").groupBy("restaurant_id").agg(F.count("*").alias("live"))
    rows = restaurants.join(live.withColumnRenamed("restaurant_id", "id"), "id", "left").withColumn("dedup_key", url_dedup_key(F.col("url")))
    order = [F.desc(F.col("status") == "done"), F.desc(F.coalesce("live", F.lit(0))), F.desc_nulls_last("last_scraped_at"), F.col("id")]
    return rows.select("id", "dedup_key", F.first("id").over(W.partitionBy("dedup_key").orderBy(*order)).alias("keep_id"))


def moved_memberships(featured: DataFrame, kept: DataFrame) -> DataFrame:
    """Guide rows after duplicates have gone: each survivor once a city, at the best place of its group."""
    rows = featured.join(kept.select(F.col("id").alias("restaurant_id"), "keep_id"), "restaurant_id")
    return rows.groupBy(F.col("keep_id").alias("restaurant_id"), "city").agg(F.min("display_order").alias("display_order"), F.min("hidden").alias("hidden"))


def distinct_urls(urls: DataFrame) -> DataFrame:
    """urls: ord, url. The first spelling of every key."""
    rows = urls.filter(F.trim("url") != "").withColumn("dedup_key", url_dedup_key(F.trim("url")))
    return rows.groupBy("dedup_key").agg(F.min(F.struct("ord", "url")).alias("f")).select("dedup_key", "f.ord", "f.url")


def batch_add(urls: DataFrame, restaurants: DataFrame) -> DataFrame:
    """What a list of urls leads to: created, existing or invalid; and whether an analysis is due."""
    rows = distinct_urls(urls)
    found = match_restaurants(rows.select("url"), restaurants).join(restaurants.select(F.col("id").alias("restaurant_id"), "status"), "restaurant_id", "left")
    result = F.when(~url_looks_like(F.col("url")), "invalid").when(F.col("restaurant_id").isNotNull(), "existing").otherwise("created")
    out = rows.join(found, "url", "left").withColumn("result", result)
    return out.select("ord", "url", "result", F.when(F.col("result") != "invalid", F.col("restaurant_id")).alias("restaurant_id"), (F.col("result") != "invalid").__and__(F.coalesce(F.col("status") != "done", F.lit(True))).alias("needs_analysis"))


def by_guide(restaurants: DataFrame, featured: DataFrame, inside: bool = True) -> DataFrame:
    """Restaurants in some guide, or in none."""
    return restaurants.join(featured.select(F.col("restaurant_id").alias("id")), "id", "left_semi" if inside else "left_anti")


def with_live_dishes(restaurants: DataFrame, dishes: DataFrame) -> DataFrame:
    return restaurants.join(dishes.filter("deleted_at is null").select(F.col("restaurant_id").alias("id")), "id", "left_semi")


def next_order(existing: DataFrame, added: DataFrame, key: str, order: str = "display_order", by: str = "ord") -> DataFrame:
    """added rows with an order that goes on after the key's greatest one."""
    last = existing.groupBy(key).agg(F.max(order).alias("_last"))
    return added.join(last, key, "left").withColumn(order, F.coalesce("_last", F.lit(-1)) + F.row_number().over(W.partitionBy(key).orderBy(by))).drop("_last")


def guide_cleanup(featured: DataFrame, restaurants: DataFrame, dishes: DataFrame) -> DataFrame:
    """Guide rows whose restaurant is not done or has too few dishes, with the reason."""
    live = dishes.filter("deleted_at is null").groupBy("restaurant_id").agg(F.count("*").alias("live"))
    rows = featured.join(restaurants.select(F.col("id").alias("restaurant_id"), "status"), "restaurant_id").join(live, "restaurant_id", "left").fillna(0, ["live"])
    reason = F.when(F.col("status") != "done", F.concat(F.lit("status "), F.col("status"))).when(F.col("live") < MIN_DISHES, F.concat(F.lit("only "), F.col("live").cast("string"), F.lit(" dishes")))
    return rows.select("restaurant_id", "city", reason.alias("reason")).filter("reason is not null")


def feature_passed(batch: DataFrame, featured: DataFrame, restaurants: DataFrame, dishes: DataFrame) -> DataFrame:
    """batch: restaurant_id, city, ord. Those fit for the guide with the place they get, the others with a reason."""
    live = dishes.filter("deleted_at is null").groupBy("restaurant_id").agg(F.count("*").alias("live"))
    rows = batch.join(restaurants.select(F.col("id").alias("restaurant_id"), "status"), "restaurant_id").join(live, "restaurant_id", "left").fillna(0, ["live"])
    reason = F.when(F.col("status") != "done", F.col("status")).when(F.col("live") < MIN_DISHES, F.concat(F.lit("only "), F.col("live").cast("string"), F.lit(" dishes")))
    rows = rows.withColumn("reason", reason)
    fresh = rows.filter("reason is null").join(featured.select("restaurant_id", "city"), ["restaurant_id", "city"], "left_anti")
    placed = next_order(featured, fresh.select("restaurant_id", "city", "ord", "reason"), "city").select("restaurant_id", "city", "display_order", "reason")
    return placed.unionByName(rows.filter("reason is not null").select("restaurant_id", "city", F.lit(None).cast("int").alias("display_order"), "reason"))


def apply_membership(featured: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: seq, restaurant_id, city, change in add, remove, hide, show. The last change of a row holds; new rows go to the end."""
    last = changes.withColumn("_n", F.row_number().over(W.partitionBy("restaurant_id", "city").orderBy(F.desc("seq")))).filter("_n = 1").drop("_n")
    both = featured.join(last.select("restaurant_id", "city", "change"), ["restaurant_id", "city"], "left").filter("change is null or change <> 'remove'")
    kept = both.withColumn("hidden", F.when(F.col("change") == "hide", True).when(F.col("change") == "show", False).otherwise(F.col("hidden"))).drop("change")
    new = last.filter("change <> 'remove'").join(featured.select("restaurant_id", "city"), ["restaurant_id", "city"], "left_anti").withColumn("hidden", F.col("change") == "hide")
    placed = next_order(featured, new, "city", by="seq").select(*kept.columns)
    return kept.unionByName(placed)


def status_updates(restaurants: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes: seq, id, status, reason. The last outcome of each restaurant sets its status and clears or sets the reason."""
    last = outcomes.groupBy("id").agg(F.max(F.struct("seq", "status", "reason")).alias("o"))
    rows = restaurants.join(last, "id", "left")
    return rows.withColumns({"status": F.coalesce("o.status", "status"), "no_menu_reason": F.when(F.col("o").isNull(), F.col("no_menu_reason")).when(F.col("o.status") == "no_menu", F.col("o.reason")), "no_menu_confirmed_at": F.when(F.col("o").isNull(), F.col("no_menu_confirmed_at"))}).drop("o")


def cascade_delete(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """tables: (frame) by name, keyed by restaurant_id. What stays of each once the restaurants in gone (restaurant_id) went."""
    return {name: df.join(gone.select("restaurant_id"), "restaurant_id", "left_anti") for name, df in tables.items()}


def restaurant_page(restaurants: DataFrame, city: str | None = None, search: str | None = None, after: tuple | None = None, size: int = 25, offset: int = 0) -> DataFrame:
    """A page of restaurants, newest first. after: (created_at, id) of the last row seen, which needs no offset."""
    rows = restaurants
    if city:
        rows = rows.filter(F.lower("city") == city.lower())
    if search:
        rows = rows.filter(F.lower("name").contains(search.lower()) | F.lower("url").contains(search.lower()))
    if after:
        at = F.lit(after[0]).cast("timestamp")
        rows = rows.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < after[1])))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(min(100, max(1, size)))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with the updates laid over it by key; of several updates of a key the last by `order` holds."""
    last = updates.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    kept = base.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.select(*[c for c in base.columns if c in last.columns]), allowMissingColumns=True)


def label_suffix(rows: DataFrame, label: Column, by: list[str], order: list) -> DataFrame:
    """rows with `label`: the n-th row of an equal label gets the number n from the second on."""
    norm = F.trim(F.regexp_replace(F.lower(label), r"\s+", " "))
    n = F.row_number().over(W.partitionBy(*by, norm).orderBy(*order))
    return rows.withColumn("_n", n).withColumn("label", F.when(F.col("_n") == 1, label).otherwise(F.concat(label, F.lit(" "), F.col("_n").cast("string")))).drop("_n")
