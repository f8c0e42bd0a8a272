"""What editors do in batches: votes checked against the city list, chunks joined, menus added, feedback resolved."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.misc import feedback_action
from larder.functions.text import custom_city_norm
from larder.sources.scratch import stored, stored_alone

from .extraction import apply_verdicts
from .identity import next_order


def validate_votes(votes: DataFrame, cities: DataFrame) -> DataFrame:
    """votes: id, city, country, region, is_custom; cities: city, country, region. (id, city, country, region, error).

    A listed city must be in the list, in any case of letters, with its country and region, and is taken as written there; a
    custom one needs a region and loses its country. Refused votes carry an error and no place.
    """
    listed = cities.select(F.lower("city").alias("_low"), F.col("country").alias("_country"), F.col("region").alias("_region"), F.col("city").alias("_city"))
    listed = listed.groupBy("_low", "_country", "_region").agg(F.min("_city").alias("_city"))
    clean = votes.withColumns({"city": custom_city_norm(F.col("city")), "is_custom": F.coalesce("is_custom", F.lit(False))})
    same = ~F.col("is_custom") & (F.lower("city") == F.col("_low")) & F.col("country").eqNullSafe(F.col("_country")) & F.col("region").eqNullSafe(F.col("_region"))
    met = clean.join(listed, same, "left")
    length = F.length(F.coalesce("city", F.lit("")))
    error = (
        F.when((length < 2) | (length > 120), "city")
        .when(F.col("is_custom") & (F.coalesce("region", F.lit("")) == ""), "region")
        .when(~F.col("is_custom") & F.col("_city").isNull(), "not listed")
    )
    kept = lambda c: F.when(F.col("error").isNull(), c)
    out = met.withColumn("error", error)
    return out.select(
        "id", kept(F.coalesce("_city", "city")).alias("city"), kept(F.when(~F.col("is_custom"), F.col("country"))).alias("country"), kept(F.col("region")).alias("region"), "error"
    )


def merge_chunks(chunks: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, sections) of menus that were read in chunks.

    chunks: restaurant_id, chunk, restaurant_name, language, cuisine; sections: restaurant_id, chunk, ord and more. A head takes
    the first name, language and cuisine that is not empty; sections get a place, chunk after chunk.
    """
    first = lambda c: F.min(F.when(F.coalesce(c, F.lit("")) != "", F.struct("chunk", c))).getField(c).alias(c)
    heads = chunks.groupBy("restaurant_id").agg(first("restaurant_name"), first("language"), first("cuisine"))
    place = F.row_number().over(W.partitionBy("restaurant_id").orderBy("chunk", "ord"))
    return heads, sections.withColumn("place", place)


class Added(NamedTuple):
    """What an added menu changes."""

    sections: DataFrame
    dishes: DataFrame
    restaurants: DataFrame
    verdicts: DataFrame


def add_menus(restaurants: DataFrame, sections: DataFrame, menus: DataFrame) -> Added:
    """menus: restaurant_id, label, ord, section, name, description, price, classification, confidence; a row a dish, in the order
    `ord` of its section; a section without dishes has one row without a name. Label and section may be null.

    Sections go on after the restaurant's last one; dishes count as checked by a person; the restaurant is live again, without
    its verdict of having no menu; the menu is a correct one of the golden set. Only new sections and dishes are returned.
    """
    laid = menus.groupBy("restaurant_id", "label", "ord", "section").agg(F.count("name").alias("n"))
    placed = next_order(sections, laid, "restaurant_id")
    # a menu without a label has an id of one part less; its place is its own among all of the restaurant's sections
    new_id = F.concat_ws("-", F.col("restaurant_id").cast("string"), F.col("label"), F.col("display_order").cast("string"))
    placed = placed.withColumn("id", new_id)
    fresh = placed.select("id", "restaurant_id", F.col("section").alias("name"), "display_order", F.col("label").alias("menu_label"))
    same = ["restaurant_id", "label", "ord", "section"]
    at = placed.select(*(F.col(c).alias(f"_{c}") for c in same), F.col("id").alias("section_id"))
    met = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same))
    dishes = menus.filter("name is not null").join(at, met).select("restaurant_id", "section_id", "name", "description", "price", "classification", "confidence", F.lit(True).alias("human_verified"))
    live = menus.select(F.col("restaurant_id").alias("id")).distinct().withColumn("_live", F.lit(True))
    back = F.coalesce("_live", F.lit(False))
    changed = {"status": F.when(back, "done").otherwise(F.col("status"))}
    changed |= {c: F.when(~back, F.col(c)) for c in ("no_menu_reason", "no_menu_confirmed_at")}
    verdicts = menus.select("restaurant_id", "label", F.lit("correct").alias("verdict")).distinct()
    return Added(fresh, dishes, restaurants.join(live, "id", "left").withColumns(changed).drop("_live"), verdicts)


class Resolved(NamedTuple):
    """What accepted feedback does, and how each item was resolved."""

    items: DataFrame
    verdicts: DataFrame
    removals: DataFrame
    renames: DataFrame


def resolve_feedback(items: DataFrame, dishes: DataFrame, restaurants: DataFrame, sections: DataFrame) -> Resolved:
    """items: kind (dish_report or restaurant_feedback), id, type, status (confirmed or dismissed), dish_id, restaurant_id,
    proposed_classification, menu_label, proposed_name.

    The type of a confirmed item says what is done; where something it needs is missing it is routed to review. A batch is
    resolved against the tables as they are before it. Verdicts, removals and renames carry the item's id as `seq`.
    """
    on_dish = F.col("kind").eqNullSafe("dish_report")
    known = restaurants.select(F.col("id").alias("_at"), F.lit(True).alias("_known"))
    d = dishes.select(F.col("id").alias("dish_id"), F.col("restaurant_id").alias("_place"))
    own = sections.select("restaurant_id", F.col("id").alias("section_id"), "menu_label")
    size = dishes.join(own, ["restaurant_id", "section_id"]).groupBy(F.col("restaurant_id").alias("_of"), F.col("menu_label").alias("_label")).agg(F.count("*").alias("_dishes"))

    rows = items.withColumns({"name": F.nullif(F.trim("proposed_name"), F.lit("")), "action": F.when(F.col("status") == "confirmed", feedback_action(F.col("type")))})
    means = lambda action: F.col("action") == action
    at = lambda df, how: df.join(known, F.col("_place") == F.col("_at"), how)
    # each effect asks for no more than it needs: dishes where a dish is meant, no menu's size where it isn't told
    removes, relabels = means("remove_dish"), means("reclassify") & F.col("proposed_classification").isNotNull()
    meant = rows.filter(on_dish & (removes | relabels))
    verdicts = at(meant.join(d, "dish_id"), "inner").select(F.col("id").alias("seq"), "dish_id", F.when(removes, "delete").otherwise("upsert").alias("action"), F.when(relabels, F.col("proposed_classification")).alias("classification"))
    clears, renames = means("remove_menu"), means("rename") & F.col("name").isNotNull()
    menu = F.col("kind") == "restaurant_feedback"
    changes = at(rows.filter(menu & (clears | renames)).withColumn("_place", F.col("restaurant_id")), "inner")

    seen = lambda df: at(df, "left").withColumn("action", F.when(F.col("_known"), F.col("action")))
    dish_rows = seen(rows.filter(on_dish).join(d, "dish_id", "left"))
    told_dish = F.when(removes, "removed_dish").when(relabels, F.concat(F.lit("reclassified:"), F.col("proposed_classification")))
    menu_rows = seen(rows.filter(~on_dish).withColumn("_place", F.col("restaurant_id"))).join(size, (F.col("_place") == F.col("_of")) & F.col("menu_label").eqNullSafe(F.col("_label")), "left")
    told_menu = F.when(menu & clears, _removed(F.col("menu_label"), F.col("_dishes"))).when(menu & renames, F.concat(F.lit("renamed:"), F.col("name"))).when(menu & means("reparse"), "reparsed")
    told = lambda df, done: df.select("kind", "id", F.when(F.col("status") != "confirmed", "dismissed").otherwise(F.coalesce(done, F.lit("routed_to_review"))).alias("resolution_action"))
    return Resolved(
        told(dish_rows, told_dish).union(told(menu_rows, told_menu)),
        verdicts,
        changes.filter(clears).select(F.col("id").alias("seq"), F.col("_place").alias("restaurant_id"), "menu_label"),
        changes.filter(renames).select(F.col("id").alias("seq"), F.col("_place").alias("restaurant_id"), "name"),
    )


class Applied(NamedTuple):
    """The tables after a batch of resolved feedback, and what it adds to the golden set."""

    dishes: DataFrame
    sections: DataFrame
    restaurants: DataFrame
    golden: DataFrame
    spurious: DataFrame


def apply_resolved(resolved: Resolved, dishes: DataFrame, sections: DataFrame, restaurants: DataFrame, as_of: Column) -> Applied:
    """Carries out what resolve_feedback gives.

    A removed menu takes its sections and their dishes with it, and is a spurious one of the golden set (restaurant_id, label,
    verdict); without a label it is the unlabelled one. Of the other dishes the last verdict of each holds. Each dish that was
    given another class is a golden row (dish_id, restaurant_id, name, section, menu_label, expected, ai_original, source), as it
    was before the batch. The last new name of a restaurant is its name. What several of them read is written to scratch tables,
    and the dishes are dealt by their ids once at a time.
    """
    menus = stored(resolved.removals.select(F.col("restaurant_id").alias("_at"), F.col("menu_label").alias("_label")).distinct(), "menus")
    verdicts = stored_alone(resolved.verdicts, "verdicts")
    hit = (F.col("restaurant_id") == F.col("_at")) & F.col("menu_label").eqNullSafe(F.col("_label"))
    gone = stored(sections.join(menus, hit, "left_semi").select(F.col("restaurant_id").alias("_at"), F.col("id").alias("_section")), "gone")
    kept = dishes.join(gone, (F.col("restaurant_id") == F.col("_at")) & (F.col("section_id") == F.col("_section")), "left_anti")
    placed = sections.select("restaurant_id", F.col("id").alias("section_id"), F.col("name").alias("section"), "menu_label")
    was = dishes.select(F.col("id").alias("dish_id"), "restaurant_id", "section_id", "name", F.col("classification").alias("ai_original"))
    told = verdicts.filter("action = 'upsert'").groupBy("dish_id").agg(F.max_by("classification", "seq").alias("expected"))
    golden = stored_alone(told.join(was, "dish_id"), "golden").join(placed, ["restaurant_id", "section_id"], "left").select("dish_id", "restaurant_id", "name", "section", "menu_label", "expected", "ai_original", F.lit("feedback_confirmed").alias("source"))
    names = resolved.renames.groupBy(F.col("restaurant_id").alias("id")).agg(F.max_by("name", "seq").alias("_name"))
    return Applied(
        apply_verdicts(kept, verdicts, as_of),
        sections.join(menus, hit, "left_anti"),
        restaurants.join(names, "id", "left").withColumn("name", F.coalesce("_name", "name")).drop("_name"),
        golden,
        menus.select(F.col("_at").alias("restaurant_id"), F.coalesce("_label", F.lit("(unlabeled menu)")).alias("label"), F.lit("spurious").alias("verdict")),
    )


def _removed(label: Column, dishes: Column) -> Column:
    return F.concat(F.lit("removed_menu:"), F.coalesce(label, F.lit("(unlabeled)")), F.lit(" ("), F.coalesce(dishes, F.lit(0)).cast("string"), F.lit(" dishes)"))
