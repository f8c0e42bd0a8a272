"""Extracted menus: cleaning, choosing, merging, and laying a fresh extraction over what people have corrected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.misc import FLAG_REPORTS, MIN_DISHES
from larder.functions.text import header_item, is_drink_dish, is_drink_section, is_drink_source, is_header_dish, is_non_food_menu, norm_dish_merge, norm_dish_verify
from larder.functions.urls import url_hint, url_lang, url_lang_key

from .identity import label_suffix

#: Which format stands for a menu that comes in several; candidates a site may offer.
FORMATS, MOST_CANDIDATES = {"pdf": 0, "subpage": 1, "text": 2, "image": 3}, 6
# Fixed value: words by which a page names itself a menu.
MENU_NAMES = r"(?i)\bmenus?\b|menukaart|speisekarte|carte"


def clean_menu(rows: DataFrame) -> DataFrame:
    """Without drink sections, drinks and headings. rows: section, name, description, price."""
    return rows.filter(~is_drink_section(F.col("section")) & ~is_drink_dish(F.col("name")) & ~is_header_dish(F.col("name"), F.col("description"), F.col("price")))


def extraction_valid(rows: DataFrame) -> DataFrame:
    """(restaurant_id, menu, items, headings, strong): strong menus have seven items, at most three in ten headings."""
    heading = header_item(F.col("name"), F.col("description"), F.col("price"))
    out = rows.groupBy("restaurant_id", "menu").agg(F.count("*").alias("items"), F.count_if(heading).alias("headings"))
    return out.withColumn("strong", (F.col("items") >= MIN_DISHES) & (F.col("headings") / F.col("items") <= 0.3))


def select_substantial(rows: DataFrame) -> DataFrame:
    """Only strong menus where a restaurant has one, else all."""
    marks = extraction_valid(rows).withColumn("any", F.max("strong").over(W.partitionBy("restaurant_id"))).filter(F.col("strong") | ~F.col("any"))
    return rows.join(marks.select("restaurant_id", "menu"), ["restaurant_id", "menu"], "left_semi")


def merge_menus(rows: DataFrame) -> DataFrame:
    """One row a dish and menu: the surest one, then the first. The label of a section counts only if there is one menu.

    rows: restaurant_id, menu, own_label, name, price, confidence, ord.
    """
    menus = F.size(F.collect_set("menu").over(W.partitionBy("restaurant_id")))
    labelled = rows.withColumn("_menus", menus).withColumn("label", F.when(F.col("_menus") > 1, F.col("menu")).otherwise(F.coalesce("own_label", "menu")))
    key = [F.col("restaurant_id"), F.lower("label"), norm_dish_merge(F.col("name")), F.lower(F.coalesce("price", F.lit("")))]
    best = labelled.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("confidence"), "ord"))).filter("_n = 1")
    return best.withColumn("menu_label", F.when(F.col("_menus") > 1, F.col("menu")).otherwise(F.col("own_label"))).drop("_n", "_menus", "label")


def duplicate_dishes(rows: DataFrame) -> DataFrame:
    """Check on an extraction: (menu, name, price) that come more than once, and leaked drinks, by restaurant."""
    again = rows.groupBy("restaurant_id", "menu", norm_dish_merge(F.col("name")).alias("k"), "price").agg(F.count("*").alias("n")).groupBy("restaurant_id").agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    drinks = rows.groupBy("restaurant_id").agg(F.count_if(is_drink_dish(F.col("name"))).alias("drinks"))
    return again.join(drinks, "restaurant_id")


def dedupe_candidates(rows: DataFrame) -> DataFrame:
    """rows: site, type, ref, hint, validated, ord. One of each (type, ref), a validated one first; no non-food menus."""
    w = W.partitionBy("site", "type", "ref").orderBy(F.desc("validated"), "ord")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").filter(~is_non_food_menu(F.coalesce("hint", F.lit(""))))


def prefer_english(rows: DataFrame) -> DataFrame:
    """Without other languages of a page that the site also has in English."""
    english = url_lang(F.col("ref")).isin("en", "eng", "english")
    keyed = rows.withColumns({"_k": url_lang_key(F.col("ref")), "_e": F.coalesce(english, F.lit(False))})
    has = F.max(F.when(F.col("_k").isNotNull(), F.col("_e"))).over(W.partitionBy("site", "_k"))
    return keyed.withColumn("_h", has).filter(F.col("_k").isNull() | ~F.col("_h") | F.col("_e")).drop("_k", "_e", "_h")


def drop_primary_variants(rows: DataFrame, primary: DataFrame) -> DataFrame:
    """primary: site, url. Without subpages that are the page in use in another language."""
    pages = primary.select("site", url_lang_key(F.col("url")).alias("_k")).filter("_k is not null")
    other = rows.filter("type <> 'subpage'")
    sub = rows.filter("type = 'subpage'").withColumn("_k", url_lang_key(F.col("ref"))).join(pages, ["site", "_k"], "left_anti").drop("_k")
    return other.unionByName(sub)


def exclude_candidate_pdfs(fallbacks: DataFrame, candidates: DataFrame) -> DataFrame:
    """fallbacks: site, ref. Without PDFs that are candidates of their own."""
    return fallbacks.join(candidates.filter("type = 'pdf'").select("site", "ref"), ["site", "ref"], "left_anti")


def pick_formats(rows: DataFrame) -> DataFrame:
    """rows: site, grp, type, ord. One of each group by format, then order; at most six a site."""
    rank = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    one = rows.withColumn("_n", F.row_number().over(W.partitionBy("site", "grp").orderBy(F.try_element_at(rank, F.col("type")), "ord"))).filter("_n = 1")
    return one.withColumn("_n", F.row_number().over(W.partitionBy("site").orderBy("ord"))).filter(F.col("_n") <= MOST_CANDIDATES).drop("_n")


def discover_candidates(rows: DataFrame, verdicts: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(site, type, ref, label): the menus a site offers, at most six, from what its pages showed.

    rows: site, type, ref, hint, validated, ord. verdicts: site, type, ref, label, distinct_menu, drink_only, grp (rows of one
    grp are one menu in several formats); a candidate without one is a distinct menu named by its hint. primary: site, url of
    the page in use. fallback: site, type, ref, ord; its first row stands for a site of which no candidate is left. Of several
    verdicts on one candidate the least holds.
    """
    key = ["site", "type", "ref"]
    found = dedupe_candidates(drop_primary_variants(rows.select(*key, "hint", "validated", "ord"), primary)).withColumn("_words", F.concat_ws(" ", "hint", url_hint(F.col("ref"))))
    found = prefer_english(found.filter(~is_non_food_menu(F.col("_words")) & ((F.col("type") == "text") | ~is_drink_source(F.col("_words")))))
    told = verdicts.groupBy(*key).agg(F.min(F.struct("label", "distinct_menu", "drink_only", "grp")).alias("_told"))
    judged = found.join(told, key, "left").withColumns({"label": F.coalesce(F.nullif("_told.label", F.lit("")), F.nullif("hint", F.lit("")), F.lit("Menu")), "grp": F.coalesce("_told.grp", F.concat_ws("|", "type", "ref"))})
    sure = F.col("type").isin("text", "pdf") | F.coalesce("validated", F.lit(False)) | ((F.col("type") == "subpage") & F.col("_words").rlike(MENU_NAMES))
    kept = judged.filter(~F.coalesce("_told.drink_only", F.lit(False)) & ~is_non_food_menu(F.concat_ws(" ", "label", "_words")) & (F.coalesce("_told.distinct_menu", F.lit(True)) | sure))
    offered = label_suffix(pick_formats(kept), F.col("label"), ["site"], ["ord"]).select(*key, "label")
    first = fallback.groupBy("site").agg(F.min_by(F.struct("type", "ref"), "ord").alias("_f")).join(offered.select("site"), "site", "left_anti")
    return offered.unionByName(first.select("site", "_f.type", "_f.ref", F.lit("Menu").alias("label")))


def match_verified(old: DataFrame, new: DataFrame) -> DataFrame:
    """old: restaurant_id, old_id, name, section; new: restaurant_id, id, name, section, ord. Each old dish's new id, or null.

    A dish of the same name in the same section is meant; else the first one of that name.
    """
    k = norm_dish_verify(F.col("name")).alias("_k")
    a = old.select("restaurant_id", "old_id", "section", k)
    b = new.select("restaurant_id", F.col("id").alias("new_id"), F.col("section").alias("_s"), "ord", k)
    hits = a.join(b, ["restaurant_id", "_k"]).groupBy("old_id").agg(F.min(F.struct(F.when(F.col("section").eqNullSafe(F.col("_s")), 0).otherwise(1).alias("far"), "ord", "new_id")).getField("new_id").alias("new_id"))
    return old.select("old_id").join(hits, "old_id", "left")


STALE = "kept from an earlier reading: not found on the menu as it is now"


def reparse(old: DataFrame, new: DataFrame, reports: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """A fresh extraction laid over the old menu; returns the dishes and the reports that still have one.

    old: id, restaurant_id, ord, name, section, classification, confidence, ai_classification, human_verified, notes,
    deleted_at, report_count. new: id, restaurant_id, ord, name, section, classification, confidence. reports: id, dish_id.
    Human verdicts stay, on the new dish they mean or as rows of their own; of several on one dish the last holds. Reported
    dishes keep their counts; those that are gone come back deleted, so their reports have something to point to.
    """
    verified = old.filter("human_verified").withColumnRenamed("id", "old_id")
    match = verified.join(match_verified(verified, new), "old_id")
    columns = ["classification", "confidence", "ai_classification", "notes", "deleted_at"]
    last = match.filter("new_id is not null").groupBy(F.col("new_id").alias("id")).agg(F.max(F.struct("ord", *columns)).alias("v"))
    fresh = new.join(last, "id", "left").select(
        "id", "restaurant_id", "ord", "name", "section", F.coalesce("v.classification", "classification").alias("classification"), F.coalesce("v.confidence", "confidence").alias("confidence"),
        F.when(F.col("v").isNotNull(), F.coalesce("v.ai_classification", "classification")).alias("ai_classification"), F.col("v").isNotNull().alias("human_verified"), F.col("v.notes").alias("notes"), F.col("v.deleted_at").alias("deleted_at"),
    )
    sections = new.select("restaurant_id", "section").distinct().withColumn("_here", F.lit(True))
    kept = match.filter("new_id is null").join(sections, ["restaurant_id", "section"], "left").select(
        F.col("old_id").alias("id"), "restaurant_id", "ord", "name", F.when(F.col("_here"), F.col("section")).alias("section"), "classification", "confidence", "ai_classification", F.lit(True).alias("human_verified"), F.coalesce("notes", F.lit(STALE)).alias("notes"), "deleted_at",
    )
    now = fresh.unionByName(kept)
    reported = old.filter("report_count > 0").withColumnRenamed("id", "old_id")
    found = reported.join(match_verified(reported, now), "old_id")
    counts = found.filter("new_id is not null").groupBy(F.col("new_id").alias("id")).agg(F.sum("report_count").alias("report_count"))
    gone = found.filter("new_id is null").select(
        F.col("old_id").alias("id"), "restaurant_id", "ord", "name", F.lit(None).cast("string").alias("section"), "classification", "confidence", "ai_classification", F.lit(False).alias("human_verified"), "notes", as_of.cast("timestamp").alias("deleted_at"), F.col("report_count").cast("bigint").alias("report_count"),
    )
    dishes = now.join(counts, "id", "left").withColumn("report_count", F.coalesce("report_count", F.lit(0))).unionByName(gone).withColumn("flagged", F.col("report_count") >= FLAG_REPORTS)
    target = found.select(F.col("old_id").alias("dish_id"), F.coalesce("new_id", "old_id").alias("_to"))
    return dishes, reports.join(target, "dish_id").withColumn("dish_id", F.col("_to")).drop("_to")


def rehome_reports(reports: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Reports on the dishes that stand for theirs now; others disappear."""
    to = match_verified(old, new).filter("new_id is not null").select(F.col("old_id").alias("dish_id"), "new_id")
    return reports.join(to, "dish_id").withColumn("dish_id", F.col("new_id")).drop("new_id")


def remove_nonfood(dishes: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dishes, sections, verdicts): without the menus whose label is no food; each such menu as a `spurious` verdict."""
    bad = sections.filter(is_non_food_menu(F.coalesce("menu_label", F.lit("")))).select("restaurant_id", "id", "menu_label")
    verdicts = bad.select("restaurant_id", F.col("menu_label").alias("label"), F.lit("spurious").alias("verdict")).distinct()
    return dishes.join(bad.select("restaurant_id", F.col("id").alias("section_id")), ["restaurant_id", "section_id"], "left_anti"), sections.join(bad.select("id"), "id", "left_anti"), verdicts


def apply_verdicts(dishes: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """verdicts: seq, dish_id, action in upsert, delete, restore, classification. The last one of each dish changes it."""
    last = verdicts.groupBy(F.col("dish_id").alias("id")).agg(F.max(F.struct("seq", "action", "classification")).alias("v"))
    rows = dishes.join(last, "id", "left")
    label = F.when((F.col("v.action") == "upsert") & F.col("v.classification").isNotNull(), F.col("v.classification")).otherwise(F.col("classification"))
    deleted = F.when(F.col("v.action") == "delete", as_of.cast("timestamp")).when(F.col("v.action").isin("restore", "upsert"), F.lit(None)).otherwise(F.col("deleted_at"))
    return rows.withColumns({"ai_original": F.when(F.col("v").isNotNull(), F.col("classification")), "classification": label, "deleted_at": deleted, "human_verified": F.col("human_verified") | F.col("v").isNotNull()}).drop("v")
