"""Menus: dishes in their sections, dish tallies, guide figures, highlights, the public guide.

Dishes meet their sections once, and the verdicts of their names where they lie; everything after that is keyed by restaurant, so
one exchange by restaurant_id carries the windows and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.dish_role import with_dish_role
from larder.functions.misc import FLAG_REPORTS, MIN_DISHES, held_back_reason, is_thin_result
from larder.functions.text import format_price, is_non_main_section, is_veg, menu_as_dish_reason, norm_dish_insights, parse_price
from larder.sources.scratch import stored

#: The section of dishes without one, and its place after all others.
NO_SECTION, LAST = "Menu", 999


def menu_dishes(dishes: DataFrame, sections: DataFrame, include_deleted: bool = False) -> DataFrame:
    """dishes with section, menu_label, section_order and whether a section has them; deleted ones only on demand."""
    live = dishes if include_deleted else dishes.filter("deleted_at is null")
    s = sections.select("restaurant_id", F.col("id").alias("section_id"), F.col("name").alias("section"), "menu_label", F.col("display_order").alias("section_order"), F.lit(True).alias("in_section"))
    out = live.join(s, ["restaurant_id", "section_id"], "left")
    return out.withColumns({"section": F.coalesce("section", F.lit(NO_SECTION)), "section_order": F.coalesce("section_order", F.lit(LAST)), "in_section": F.coalesce("in_section", F.lit(False))})


def price_level(dishes: DataFrame) -> DataFrame:
    """(restaurant_id, level): median of the positive prices of live dishes; null below four of them."""
    p = parse_price(F.col("price"))
    live = dishes.filter("deleted_at is null").select("restaurant_id", F.when(p > 0, p).alias("p"))
    return live.groupBy("restaurant_id").agg(F.when(F.count("p") >= 4, F.median("p")).alias("level"))


def judged(dishes: DataFrame, sections: DataFrame) -> DataFrame:
    """Live dishes in their menus, with key, veg, role, counted by name alone, and counted once the price has its say."""
    return _judged(menu_dishes(dishes, sections), price_level(dishes))


def _judged(placed: DataFrame, levels: DataFrame) -> DataFrame:
    roles = with_dish_role(placed.withColumn("amount", parse_price(F.col("price"))), "section", "name").join(levels, "restaurant_id", "left")
    by_name = F.col("verdict.role") == "counted"
    cheap = F.col("amount") < 0.5 * F.col("level")
    return roles.withColumns(
        {"key": norm_dish_insights(F.col("name"), F.col("id")), "veg": F.coalesce(is_veg(F.col("classification")), F.lit(False)), "by_name": by_name, "counted": F.when(F.col("verdict.ambiguous") & cheap.isNotNull(), ~cheap).otherwise(by_name)}
    )


def menu_tallies(rows: DataFrame) -> DataFrame:
    """Distinct dishes by menu: all, veg and vegan, counted or aside. A dish counted anywhere on a menu is not aside there."""
    flag = lambda c: F.max(F.when(c, 1).otherwise(0))
    vegan = F.col("classification") == "vegan"
    keyed = rows.groupBy("restaurant_id", "menu_label", "key").agg(
        flag(F.col("veg") & F.col("counted")).alias("vc"), flag(F.col("veg")).alias("v"), flag(vegan & F.col("counted")).alias("gc"), flag(vegan).alias("g")
    )
    total = lambda c: F.sum(c).cast("bigint")
    return keyed.groupBy("restaurant_id", "menu_label").agg(
        F.count("*").alias("all_dishes"), total("vc").alias("veg_counted"), total(F.col("v") - F.col("vc")).alias("veg_aside"), total("gc").alias("vegan_counted"), total(F.col("g") - F.col("gc")).alias("vegan_aside")
    )


def menu_order(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """(restaurant_id, menu_label, first_place): menus in the order of their first sections. rows: menu_dishes."""
    own = sections.select("restaurant_id", "menu_label", F.col("display_order").alias("o"))
    orphans = rows.filter("not in_section").select("restaurant_id", F.lit(None).cast("string"), F.lit(LAST))
    return own.union(orphans).groupBy("restaurant_id", "menu_label").agg(F.min("o").alias("first_place"))


def highlights(rows: DataFrame, most: int = 3) -> DataFrame:
    """Up to three counted veg dishes a restaurant: dearest first, then unpriced ones in menu order; and whether that is thin."""
    menu = [F.col("section_order"), F.col("created_at"), F.col("id")]
    named = rows.filter(F.col("veg") & F.col("by_name") & ~F.col("key").startswith("#"))
    first = named.withColumn("_n", F.row_number().over(W.partitionBy("restaurant_id", "key").orderBy(*menu))).filter("_n = 1")
    ranked = first.withColumn("_r", F.row_number().over(W.partitionBy("restaurant_id").orderBy(F.col("amount").isNull(), F.desc("amount"), *menu))).filter(F.col("_r") <= most)
    shown = F.struct("_r", F.trim("name").alias("name"), format_price(F.col("price")).alias("price"))
    thin = (F.count("*") < most) | F.min(is_non_main_section(F.col("section")))
    return ranked.groupBy("restaurant_id").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: F.struct(x["name"].alias("name"), x["price"].alias("price"))).alias("highlights"), thin.alias("highlights_thin"))


#: What the guide reads of judged dishes.
GUIDE_COLUMNS = ["id", "restaurant_id", "menu_label", "section", "section_order", "in_section", "created_at", "name", "description", "price", "classification", "amount", "key", "veg", "by_name", "counted"]


def judged_once(dishes: DataFrame, sections: DataFrame) -> DataFrame:
    """judged for the several aggregates of a guide. Dishes meet their sections once: what prices, names and roles are then read
    from, and what the guide reads, are scratch tables."""
    placed = stored(menu_dishes(dishes, sections), "placed")
    return stored(_judged(placed, price_level(placed)).select(*GUIDE_COLUMNS), "judged")


def guide_insights(dishes: DataFrame, sections: DataFrame) -> DataFrame:
    """One row a restaurant: its best menu, that menu's split and asides, totals and highlights."""
    return insights_of(judged_once(dishes, sections), sections)


def insights_of(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """The same of judged dishes."""
    menus = menu_order(rows, sections).alias("m").join(menu_tallies(rows).alias("t"), (F.col("m.restaurant_id") == F.col("t.restaurant_id")) & F.col("m.menu_label").eqNullSafe(F.col("t.menu_label")), "left")
    zero = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit(0)).alias(c)
    menus = menus.select("m.restaurant_id", "m.menu_label", "m.first_place", zero("veg_counted"), zero("veg_aside"), zero("vegan_counted"))
    best = W.partitionBy("restaurant_id").orderBy(F.desc("veg_counted"), "first_place", F.asc_nulls_first("menu_label"))
    top = menus.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    totals = rows.groupBy("restaurant_id").agg(F.count("*").alias("total_dishes"))
    out = top.join(totals, "restaurant_id", "left").join(highlights(rows), "restaurant_id", "left")
    return out.select(
        "restaurant_id", F.col("menu_label").alias("best_menu"), F.col("veg_counted").alias("max_veg"), F.col("veg_aside").alias("aside"), F.col("vegan_counted").alias("vegan"),
        (F.col("veg_counted") - F.col("vegan_counted")).alias("vegetarian"), F.coalesce("total_dishes", F.lit(0)).alias("total_dishes"), "highlights", F.coalesce("highlights_thin", F.lit(True)).alias("highlights_thin"),
    )


def split_veg(rows: DataFrame) -> DataFrame:
    """Veg dishes of each restaurant, once by key, counted or aside, in menu order (place)."""
    veg = rows.filter("veg")
    keyed = W.partitionBy("restaurant_id", "key")
    order = [F.desc("counted"), F.col("section_order"), F.col("created_at"), F.col("id")]
    first = veg.withColumn("_n", F.row_number().over(keyed.orderBy(*order))).filter("_n = 1")
    place = F.row_number().over(W.partitionBy("restaurant_id", "counted").orderBy(*order[1:]))
    return first.select("restaurant_id", "key", "name", "counted", place.alias("place"))


def featured(featured_rows: DataFrame, restaurants: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Featured restaurants with their place in the city's guide."""
    shown = featured_rows if include_hidden else featured_rows.filter("not hidden")
    return shown.select(F.col("restaurant_id").alias("id"), F.col("city").alias("guide"), "display_order", "hidden").join(restaurants, "id")


def review_flags(rows: DataFrame) -> DataFrame:
    """(restaurant_id, live_dishes, menu_as_dish): live dishes, and the first reason why one looks like a whole menu."""
    reason = menu_as_dish_reason(F.col("name"), F.col("description"))
    return rows.withColumn("_why", reason).groupBy("restaurant_id").agg(F.count("*").alias("live_dishes"), F.min(F.when(F.col("_why").isNotNull(), F.struct("section_order", "created_at", "id", "_why"))).getField("_why").alias("menu_as_dish"))


def is_public(status: Column, live_dishes: Column, approved_at: Column, menu_as_dish: Column) -> Column:
    return F.coalesce((status == "done") & (live_dishes >= MIN_DISHES) & (approved_at.isNotNull() | menu_as_dish.isNull()), F.lit(False))


def public_guide(restaurants: DataFrame, featured_rows: DataFrame, dishes: DataFrame, sections: DataFrame) -> DataFrame:
    """The ranked guide of every city: public restaurants by their best menu, then by their place."""
    chosen = featured(featured_rows, restaurants)
    own = dishes.join(chosen.select(F.col("id").alias("restaurant_id")).distinct(), "restaurant_id", "left_semi")
    rows = judged_once(own, sections)
    flags = review_flags(rows).withColumnRenamed("restaurant_id", "id")
    insights = insights_of(rows, sections).withColumnRenamed("restaurant_id", "id")
    shown = chosen.join(flags, "id").filter(is_public(F.col("status"), F.col("live_dishes"), F.col("guide_approved_at"), F.col("menu_as_dish"))).join(insights, "id")
    rank = F.row_number().over(W.partitionBy("guide").orderBy(F.desc("max_veg"), "display_order", "id"))
    return shown.select("guide", rank.alias("rank"), "id", "name", "max_veg", "aside", "best_menu", "vegan", "vegetarian", "total_dishes", "highlights", "highlights_thin")


def result_counts(rows: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Raw live counts of a result page: all, vegan, veg, menus; and whether the result is thin."""
    n = rows.groupBy("restaurant_id").agg(F.count("*").alias("all_dishes"), F.count_if(F.col("classification") == "vegan").alias("vegan"), F.count_if(F.col("veg")).alias("veg"), F.count_distinct("menu_label").alias("menus"))
    out = restaurants.select(F.col("id").alias("restaurant_id"), "status").join(n, "restaurant_id", "left").fillna(0, ["all_dishes", "vegan", "veg", "menus"])
    return out.withColumn("thin", is_thin_result(F.col("status"), F.col("all_dishes"))).drop("status")


def menu_documents(restaurants: DataFrame, sections: DataFrame, dishes: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Restaurants as nested documents: sections in order, each with its dishes in order."""
    placed = menu_dishes(dishes, sections, include_deleted)
    per = placed.groupBy("restaurant_id", "section_order", "section", "menu_label", "section_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "name", "price", "classification"))).alias("dishes"))
    nested = per.groupBy("restaurant_id").agg(F.array_sort(F.collect_list(F.struct("section_order", "section", "menu_label", "dishes"))).alias("sections"))
    return restaurants.join(nested.withColumnRenamed("restaurant_id", "id"), "id", "left")


def role_exclusions(rows: DataFrame) -> DataFrame:
    """Veg dishes that the roles keep from the count, by role and rule; soft: in a side section, or in the cheapest quarter."""
    veg = rows.filter("veg")
    sorted_prices = F.sort_array(F.collect_list("amount"))
    quarter = rows.filter("amount is not null").groupBy("restaurant_id").agg(F.when(F.count("*") >= 4, F.try_element_at(sorted_prices, (F.floor(F.count("*") * 0.25) + 1).cast("int"))).alias("q1"))
    out = veg.filter("not counted").join(quarter, "restaurant_id", "left")
    return out.groupBy(F.col("verdict.role").alias("role"), F.col("verdict.rule").alias("rule")).agg(F.count("*").alias("n"), F.count_if(is_non_main_section(F.col("section")) | (F.col("amount") <= F.col("q1"))).alias("soft"))


def old_and_new_counts(rows: DataFrame, insights: DataFrame) -> DataFrame:
    """Veg rows of the fullest menu before roles were known, and the headline after."""
    before = rows.filter("veg").groupBy("restaurant_id", "menu_label").agg(F.count("*").alias("n")).groupBy("restaurant_id").agg(F.max("n").alias("before"))
    return insights.select("restaurant_id", F.col("max_veg").alias("after"), "aside").join(before, "restaurant_id", "left").fillna(0, ["before"])


def running_reports(reports: DataFrame) -> DataFrame:
    """Reports of each dish so far, and whether that flags it."""
    so_far = F.count("*").over(W.partitionBy("dish_id").orderBy("created_at", "id").rowsBetween(W.unboundedPreceding, 0))
    return reports.select("id", "dish_id", so_far.alias("reports")).withColumn("flagged", F.col("reports") >= FLAG_REPORTS)


def withheld_featured(restaurants: DataFrame, featured_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """Featured restaurants that the public doesn't see: the cities they are featured in, and why. rows: menu_dishes."""
    flags = review_flags(rows).withColumnRenamed("restaurant_id", "id")
    shown = featured(featured_rows, restaurants).join(flags, "id", "left").fillna(0, ["live_dishes"])
    hidden = shown.filter(~is_public(F.col("status"), F.col("live_dishes"), F.col("guide_approved_at"), F.col("menu_as_dish")))
    return hidden.groupBy("id").agg(F.array_sort(F.collect_set("guide")).alias("cities"), F.min(held_back_reason(F.col("status"), F.col("live_dishes"), F.col("menu_as_dish"))).alias("reason"))


def page_filter(guide: DataFrame, areas: list[str], cuisines: list[str]) -> DataFrame:
    """guide: areas (array), cuisine. Restaurants in any of the areas and of any of the cuisines; an empty choice means all."""
    out = guide.filter(F.arrays_overlap("areas", F.array(*map(F.lit, areas)))) if areas else guide
    return out.filter(F.col("cuisine").isin(cuisines)) if cuisines else out
