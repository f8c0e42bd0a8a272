"""Sources and sinks: declared schemas, readers, CSV and text writers, keyed overwrite, constant dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.misc import FEEDBACK_ACTIONS, POSTAL_AREAS, content_kind

_MONEY = "decimal(10,6)"
SCHEMAS = {
    "restaurants": f"id string, url string, canonical_url string, name string, city string, status string, error_message string, menu_url string, last_scraped_at timestamp, created_at timestamp, updated_at timestamp, address string, latitude double, longitude double, neighbourhood_id string, area_code string, area_label string, area_source string, location_source string, location_source_url string, location_confidence string, location_checked_at timestamp, model_used string, tokens_in int, tokens_out int, cost_usd {_MONEY}, menu_candidates string, candidates_at timestamp, dedup_key string, guide_approved_at timestamp, cuisine string, menu_language string, no_menu_reason string, no_menu_confirmed_at timestamp",
    "menu_sections": "id string, restaurant_id string, name string, display_order int, menu_label string",
    "dishes": "id string, restaurant_id string, section_id string, name string, description string, price string, classification string, confidence double, confidence_reason string, report_count int, warning_flagged boolean, origin string, ai_classification string, deleted_at timestamp, created_at timestamp, updated_at timestamp, human_verified boolean, reviewer_notes string",
    "dish_reports": "id string, dish_id string, issue_type string, notes string, ip_hash string, created_at timestamp, anon_id string, status string, resolution_notes string, resolved_at timestamp, proposed_classification string, resolution_action string",
    "restaurant_feedback": "id string, restaurant_id string, restaurant_name string, feedback_type string, notes string, ip_hash string, city string, created_at timestamp, anon_id string, status string, proposed_classification string, proposed_dish_name string, proposed_name string, menu_label string, reference_url string, resolution_action string",
    "featured_restaurants": "restaurant_id string, city string, display_order int, hidden boolean",
    "city_guides": "slug string, display_name string, country string, status string, tagline string, published_at timestamp, created_at timestamp",
    "restaurant_locations": "id string, restaurant_id string, label string, address string, latitude double, longitude double, neighbourhood_id string, area_code string, area_label string, area_source string, location_source string, location_source_url string, location_confidence string, created_at timestamp",
    "city_neighbourhoods": "id string, city string, display_name string, group_name string, geometry string, source string, active boolean",
    "ai_usage_log": f"id string, restaurant_id string, restaurant_name string, url string, model_used string, tokens_in bigint, tokens_out bigint, cost_usd {_MONEY}, source string, cache_write_tokens bigint, cache_read_tokens bigint, created_at timestamp",
    "parse_attempts": "id string, url string, domain string, stage string, category string, success boolean, error_message string, duration_ms bigint, created_at timestamp, anon_id string, dish_count int, outcome string, error_code string",
    "rate_limit_events": "ip_hash string, created_at timestamp",
    "nps_responses": "id string, anon_id string, score int, notes string, created_at timestamp",
    "city_guide_votes": "id string, city_name string, country_name string, region string, is_custom boolean, email string, ip_hash string, anon_id string, created_at timestamp",
    "eval_cases": "id string, url string, name string, city string, missed_menus string, notes string, menus_reviewed_at timestamp, created_at timestamp",
    "eval_menu_candidates": "id string, eval_case_id string, label string, verdict string, notes string, created_at timestamp",
    "eval_dishes": "id string, eval_case_id string, menu_label string, section_name string, name string, expected_classification string, ai_original_classification string, source string, notes string, created_at timestamp, updated_at timestamp",
    "pages": "page_id bigint, url string, html string",
}
# What the checked text columns may hold.
ALLOWED = {
    ("restaurants", "status"): ["pending", "processing", "done", "error", "no_menu"],
    ("dishes", "classification"): ["vegan", "vegetarian", "neither", "unknown"],
    ("dishes", "origin"): ["ai", "admin"],
    ("ai_usage_log", "source"): ["product", "qa"],
    ("parse_attempts", "stage"): ["discover", "analyze"],
    ("dish_reports", "status"): ["open", "confirmed", "dismissed"],
    ("eval_menu_candidates", "verdict"): ["correct", "spurious", "duplicate"],
    ("city_guide_votes", "region"): ["Europe", "Asia", "USA", "Australia"],
}
CANDIDATES = "struct<candidates:array<struct<id:string,label:string,description:string,type:string,ref:string,source:string>>,finalUrl:string,title:string>"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its declared schema; files without later columns give nulls for them."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS["pages"]).parquet(path)


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows whose checked columns hold a value that the table doesn't allow."""
    bad = F.lit(False)
    for (t, c), values in ALLOWED.items():
        if t == name and c in df.columns:
            bad = bad | ~F.coalesce(F.col(c).isin(values), F.lit(True))
    return df.filter(bad)


def read_neighbourhoods(spark: SparkSession, path: str, city: str) -> DataFrame:
    """(city, display_name, rings): named polygons of a GeoJSON feature collection, their rings in one list."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    p = F.col("f.properties")
    name = F.trim(F.coalesce(F.nullif(F.trim(F.try_element_at(p, F.lit("name:en"))), F.lit("")), F.try_element_at(p, F.lit("name"))))
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
    point = lambda x: F.struct(F.get(x, F.lit(0)).alias("longitude"), F.get(x, F.lit(1)).alias("latitude"))
    points = F.transform(rings, lambda r: F.transform(F.filter(r, lambda x: F.size(x) >= 2), point))
    return f.select(F.lit(city).alias("city"), name.alias("display_name"), points.alias("rings")).filter("display_name <> '' and rings is not null")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind) of files, by their first bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", content_kind(F.col("content")).alias("kind"))


def explode_candidates(df: DataFrame, column: str = "menu_candidates") -> DataFrame:
    """One row a menu candidate of the JSON column; rows without candidates go."""
    return df.withColumn("_p", F.from_json(column, CANDIDATES)).select(*df.columns, F.posexplode("_p.candidates").alias("position", "candidate")).select(*df.columns, "position", "candidate.*") if "id" not in df.columns else df.withColumn("_p", F.from_json(column, CANDIDATES)).select(F.col("id").alias("restaurant_id"), F.posexplode("_p.candidates").alias("position", "candidate")).select("restaurant_id", "position", "candidate.*")


def csv_cell(c: Column, always: bool = True) -> Column:
    """A CSV cell: quotes doubled, quoted always or only where it has a comma, quote or line end; null as empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return quoted if always else F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def write_csv_quoted(df: DataFrame, path: str) -> None:
    """Every cell quoted."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(df: DataFrame, path: str) -> None:
    """Cells quoted where they must be."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def error_log_lines(corrections: DataFrame) -> DataFrame:
    """(section, ord, line) of the corrections report; corrections: case_id, kind, detail."""
    return corrections.select(F.substring("kind", 3, 50).alias("section"), F.concat_ws("|", F.substring("kind", 1, 1), F.lpad(F.col("case_id").cast("string"), 12, "0"), "detail").alias("ord"), F.concat_ws(" ", F.lit("case"), F.col("case_id").cast("string"), F.lit("-"), "detail").alias("line"))


def write_error_log(corrections: DataFrame, path: str) -> None:
    """The report as text, in order."""
    error_log_lines(corrections).orderBy("ord").select("line").write.mode("overwrite").text(path)


def dim_areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, f"Dublin {c[1:].lstrip('0')}") for c in POSTAL_AREAS], "area_code string, display string")


def dim_actions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FEEDBACK_ACTIONS.items()), "kind string, action string")
