"""Domain tables derived from the driver's tables, as SQL that Spark and DuckDB both run.

Each entry is the body of a common table expression; later ones read earlier ones. The jobs themselves are written twice:
as DataFrame code, and as SQL over these tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

TABLES = {
    "restaurants": """
SELECT cast(s_suppkey AS bigint) AS id, s_name AS name, lower(n_name) AS city,
  CASE s_suppkey % 10 WHEN 7 THEN 'no_menu' WHEN 8 THEN 'error' WHEN 9 THEN 'pending' ELSE 'done' END AS status,
  CASE s_suppkey % 6 WHEN 0 THEN 'https://www.place' || cast(s_suppkey % 70 AS varchar(20)) || '.ie/' WHEN 1 THEN 'http://Place' || cast(s_suppkey % 70 AS varchar(20)) || '.ie/menu'
    WHEN 2 THEN 'https:///place' || cast(s_suppkey % 70 AS varchar(20)) || '.ie' WHEN 3 THEN 'https://toasttab.com/place-' || cast(s_suppkey % 70 AS varchar(20))
    WHEN 4 THEN 'place' || cast(s_suppkey % 70 AS varchar(20)) || '.ie/menu/lunch/' ELSE 'https://order.place' || cast(s_suppkey % 70 AS varchar(20)) || '.ie/' END AS url,
  CASE WHEN s_suppkey % 3 = 0 THEN 'https://place' || cast(s_suppkey % 70 AS varchar(20)) || '.ie' END AS canonical_url,
  CASE WHEN s_suppkey % 4 <> 1 THEN cast(cast(s_suppkey * 37 % 1000 AS decimal(10,6)) * cast(0.001 AS decimal(4,3)) AS decimal(10,6)) END AS cost_usd,
  CASE WHEN s_suppkey % 4 <> 1 THEN s_suppkey * 131 % 9000 END AS tokens_in, CASE WHEN s_suppkey % 4 <> 1 THEN s_suppkey * 17 % 3000 END AS tokens_out,
  CASE s_suppkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' END AS model_used,
  cast('2024-01-01 00:00:00' AS timestamp) + (s_suppkey % 40) * interval '1' day + (s_suppkey % 24) * interval '1' hour AS created_at,
  CASE WHEN s_suppkey % 5 <> 0 THEN cast('2024-02-01 00:00:00' AS timestamp) + (s_suppkey * 7 % 28) * interval '1' day END AS last_scraped_at,
  CASE WHEN s_suppkey % 10 = 7 AND s_suppkey % 20 = 7 THEN 'not_listed' END AS no_menu_reason,
  CASE WHEN s_suppkey % 30 = 17 THEN cast('2024-02-20 00:00:00' AS timestamp) END AS no_menu_confirmed_at,
  CASE WHEN s_suppkey % 11 = 0 THEN cast('2024-02-25 00:00:00' AS timestamp) END AS guide_approved_at,
  CASE s_suppkey % 4 WHEN 0 THEN 'irish' WHEN 1 THEN 'indian' WHEN 2 THEN 'italian' END AS cuisine
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "featured": """
SELECT id AS restaurant_id, city, cast(id * 13 % 101 AS int) AS display_order, id % 7 = 3 AS hidden FROM restaurants WHERE id % 5 <> 4""",
    "menu_sections": """
SELECT DISTINCT cast(l_suppkey AS bigint) AS restaurant_id, CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS menu_label,
  CASE p_type WHEN 'PROMO' THEN 'Desserts' WHEN 'SMALL' THEN 'Sides' WHEN 'ECONOMY' THEN 'Nibbles' WHEN 'LARGE' THEN 'Mains' WHEN 'MEDIUM' THEN 'Starters' ELSE 'Sauces' END AS name,
  cast(ascii(l_returnflag) * 10 + length(p_type) AS int) AS display_order,
  cast(l_suppkey AS varchar(20)) || '-' || l_returnflag || '-' || p_type AS id
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "dishes": """
SELECT cast(l_orderkey AS varchar(20)) || '-' || cast(l_linenumber AS varchar(20)) || '-' || cast(l_partkey AS varchar(20)) || '-' || cast(l_suppkey AS varchar(20)) AS id,
  cast(l_suppkey AS bigint) AS restaurant_id, CASE WHEN l_orderkey % 50 <> 7 THEN cast(l_suppkey AS varchar(20)) || '-' || min(l_returnflag) || '-' || p_type END AS section_id,
  CASE (l_orderkey + l_linenumber) % 24 WHEN 0 THEN 'Garlic Naan' WHEN 1 THEN 'Chips' WHEN 2 THEN 'Creamed potatoes' WHEN 3 THEN 'Truffle mayo' WHEN 4 THEN 'Tomato Sauce'
    WHEN 5 THEN 'Warm Focaccia & Whipped Butter' WHEN 6 THEN 'Chocolate brownie (V)' WHEN 7 THEN 'Side of greens' WHEN 8 THEN 'Roast potatoes, chard & romesco' WHEN 9 THEN 'Rice'
    WHEN 10 THEN 'Baked bread' WHEN 11 THEN 'Paneer tikka with butter naan' WHEN 12 THEN 'Basmati Rice' WHEN 13 THEN 'House wine' WHEN 14 THEN 'Tasting menu' WHEN 15 THEN '(vegan)'
    ELSE p_name || CASE WHEN l_orderkey % 3 = 0 THEN ' curry' WHEN l_orderkey % 3 = 1 THEN ' (VG)' ELSE '' END END AS name,
  CASE WHEN l_orderkey % 4 = 0 THEN 'with ' || p_name || ' and butter' WHEN l_orderkey % 97 = 0 THEN '3 courses' END AS description,
  CASE l_orderkey % 6 WHEN 0 THEN '€' || cast(cast(min(l_quantity) AS int) + 2 AS varchar(20)) WHEN 1 THEN cast(cast(min(l_quantity) AS int) AS varchar(20)) || ',50' WHEN 2 THEN cast(cast(min(l_quantity) AS int) AS varchar(20)) || ' / ' || cast(cast(min(l_quantity) AS int) + 6 AS varchar(20))
    WHEN 3 THEN 'Market price' WHEN 4 THEN '9" £' || cast(cast(min(l_quantity) AS int) AS varchar(20)) || '.25' END AS price,
  CASE cast(min(l_quantity) AS int) % 4 WHEN 0 THEN 'vegan' WHEN 1 THEN 'vegetarian' WHEN 2 THEN 'neither' ELSE 'unknown' END AS classification,
  cast(l_partkey % 100 AS double) / 100 AS confidence, cast(l_orderkey % 9 AS int) - 5 AS raw_reports, l_orderkey % 13 = 0 AS human_verified,
  CASE WHEN l_orderkey % 29 = 0 THEN cast('2024-02-10 00:00:00' AS timestamp) END AS deleted_at, CASE WHEN l_orderkey % 17 = 0 THEN 'admin' ELSE 'ai' END AS origin,
  cast('2024-01-01 00:00:00' AS timestamp) + (l_orderkey % 1000) * interval '1' minute AS created_at
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, p_type""",
    "usage_log": """
SELECT cast(o_orderkey AS bigint) AS id, CASE WHEN o_orderkey % 9 <> 0 THEN cast(o_custkey % 100 AS bigint) END AS restaurant_id, CASE WHEN o_orderkey % 9 <> 0 OR o_orderkey % 18 = 0 THEN 'https://place' || cast(o_custkey % 70 AS varchar(20)) || '.ie' END AS url,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'small' WHEN '2' THEN 'large' WHEN '3' THEN 'huge' ELSE 'other' END AS model_used,
  cast(o_orderkey * 31 % 9000 AS bigint) AS tokens_in, cast(o_orderkey * 7 % 1500 AS bigint) AS tokens_out, cast(o_orderkey % 11 * 100 AS bigint) AS cache_write_tokens, cast(o_orderkey % 5 * 1000 AS bigint) AS cache_read_tokens,
  cast(cast(o_orderkey * 31 % 9000 AS decimal(10,0)) * cast(0.000003 AS decimal(7,6)) AS decimal(10,6)) AS cost_usd,
  CASE WHEN o_orderstatus = 'P' THEN 'qa' ELSE 'product' END AS source, cast(o_orderdate AS timestamp) + (o_orderkey % 24) * interval '1' hour AS created_at
FROM orders""",
    "attempts": """
SELECT cast(event_id AS bigint) AS id, 'https://www.place' || cast(user_id % 70 AS varchar(20)) || '.ie/menu' AS url, CASE WHEN event_type IN ('signup', 'click') THEN 'discover' ELSE 'analyze' END AS stage,
  event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'Could not find a menu' WHEN 2 THEN 'HTTP 429 too many requests' WHEN 3 THEN 'fetch failed: ECONNREFUSED' ELSE 'odd failure' END END AS error_message,
  cast(floor(value * 100) AS bigint) AS duration_ms, ts AS created_at, CASE WHEN event_id % 10 <> 3 THEN 'anon' || cast(user_id AS varchar(20)) END AS anon_id,
  CASE WHEN event_type IN ('view', 'purchase') THEN cast(event_id % 23 AS int) END AS dish_count
FROM events""",
    "product_events": """
SELECT cast(event_id AS bigint) AS id, CASE event_type WHEN 'signup' THEN 'search_submitted' WHEN 'view' THEN 'results_viewed' WHEN 'click' THEN 'results_engaged' WHEN 'error' THEN 'error_shown' ELSE 'share_clicked' END AS event,
  cast(user_id AS bigint) AS user_id, ts, 'place' || cast(user_id % 70 AS varchar(20)) || '.ie' AS domain, CASE WHEN event_id % 4 = 0 THEN 'thin' WHEN event_id % 4 = 1 THEN 'no_menu' ELSE 'menu' END AS outcome,
  cast(floor(value * 1000) AS bigint) AS elapsed_ms, cast(event_id % 37 AS int) AS dish_count, event_id % 15 = 0 AS internal, CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tablet' END AS device,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'not_found' ELSE 'unknown' END END AS code, 'surface' || cast(event_id % 2 AS varchar(20)) AS surface
FROM events""",
    "eval_cases": """
SELECT DISTINCT cast(doc_id % 60 AS bigint) AS id, 'https://WWW.place' || cast(doc_id % 60 AS varchar(20)) || '.ie/' AS url, CASE WHEN doc_id % 60 % 4 = 0 THEN ' ' WHEN doc_id % 60 % 4 = 1 THEN 'Brunch' END AS missed_menus,
  CASE WHEN doc_id % 60 % 3 <> 2 THEN cast('2024-02-01 00:00:00' AS timestamp) END AS menus_reviewed_at
FROM labels""",
    "eval_candidates": """
SELECT doc_id AS id, cast(doc_id % 60 AS bigint) AS case_id, CASE doc_id % 5 WHEN 0 THEN 'Lunch' WHEN 1 THEN 'lunch' WHEN 2 THEN 'Dinner' ELSE 'Kids' END AS label, CASE doc_id % 7 WHEN 0 THEN 'spurious' WHEN 1 THEN 'duplicate' ELSE 'correct' END AS verdict FROM labels""",
    "eval_dishes": """
SELECT doc_id AS id, cast(doc_id % 60 AS bigint) AS case_id, CASE WHEN doc_id % 3 = 0 THEN 'Garlic Naan ' WHEN doc_id % 3 = 1 THEN 'CHIPS' ELSE 'Dish ' || cast(doc_id % 11 AS varchar(20)) END AS name,
  CASE toxic * 2 + quality WHEN 0 THEN 'neither' WHEN 1 THEN 'vegetarian' WHEN 2 THEN 'neither' ELSE 'vegan' END AS expected, CASE doc_id % 6 WHEN 0 THEN 'vegan' WHEN 1 THEN 'vegetarian' WHEN 2 THEN 'neither' WHEN 3 THEN 'unknown' WHEN 4 THEN 'vegetarian' END AS ai_original
FROM labels""",
    "reports": """
SELECT cast(event_id AS bigint) AS id, cast(user_id % 100 AS bigint) AS restaurant_id, CASE event_id % 7 WHEN 0 THEN 'wrong_classification' WHEN 1 THEN 'not_a_dish' WHEN 2 THEN 'dish_removed' WHEN 3 THEN 'duplicate_dish' WHEN 4 THEN 'hidden_ingredient' WHEN 5 THEN 'incorrect_info' ELSE 'other' END AS issue_type,
  cast(user_id AS varchar(20)) || '-dish-' || cast(event_id % 5 AS varchar(20)) AS dish_id, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN 'open' WHEN event_id % 3 = 1 THEN 'confirmed' ELSE 'dismissed' END AS status, 'ip' || cast(user_id % 40 AS varchar(20)) AS ip_hash
FROM events WHERE event_type = 'error'""",
    "feedback": """
SELECT cast(event_id AS bigint) AS id, cast(user_id % 100 AS bigint) AS restaurant_id, CASE event_id % 6 WHEN 0 THEN 'not_a_menu' WHEN 1 THEN 'missing_menu' WHEN 2 THEN 'menu_outdated' WHEN 3 THEN 'wrong_name' WHEN 4 THEN 'wrong_menu' ELSE 'strange' END AS feedback_type,
  ts AS created_at, CASE WHEN event_id % 4 = 0 THEN 'open' ELSE 'dismissed' END AS status, 'ip' || cast(user_id % 40 AS varchar(20)) AS ip_hash
FROM events WHERE event_type = 'click'""",
    "locations": """
SELECT cast(c_custkey AS bigint) AS id, cast(c_custkey % 100 AS bigint) AS restaurant_id, lower(n_name) AS city, cast(53.30 + (c_custkey * 7919 % 1000) * 0.0001 AS double) AS latitude, cast(-6.30 + (c_custkey * 104729 % 1000) * 0.0001 AS double) AS longitude,
  cast(c_custkey % 200 AS varchar(20)) || ' Main Street, ' || CASE c_custkey % 4 WHEN 0 THEN 'Dublin ' || cast(c_custkey % 26 AS varchar(20)) WHEN 1 THEN 'D0' || cast(c_custkey % 10 AS varchar(20)) || ' X2Y3' WHEN 2 THEN 'dublin, 6w' ELSE 'Cork' END AS address,
  CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "docs": """
SELECT doc_id, text FROM documents""",
    "urls": """
SELECT page_id, CASE page_id % 14 WHEN 0 THEN 'HTTPS://www.Place' || cast(page_id AS varchar(20)) || '.ie/Menu/Lunch/' WHEN 1 THEN 'place' || cast(page_id AS varchar(20)) || '.ie' WHEN 2 THEN 'https://order.place' || cast(page_id AS varchar(20)) || '.ie/gift' WHEN 3 THEN 'https://www.toasttab.com/p' || cast(page_id AS varchar(20)) || '/'
  WHEN 4 THEN 'https://cdn.place.ie/files/wine_list-' || cast(page_id AS varchar(20)) || '.pdf?v=2' WHEN 5 THEN 'https://www.instagram.com/p' || cast(page_id AS varchar(20)) WHEN 6 THEN 'https://maps.google.com/?q=1' WHEN 7 THEN 'https://place.ie/locations/greek-street/' WHEN 8 THEN 'https://place.ie/en-gb/menu?lang=en' WHEN 9 THEN 'not a url' WHEN 10 THEN 'https://www.yelp.com/biz/x' ELSE url END AS url
FROM pages""",
}


def depends(name: str) -> list[str]:
    """The derived tables that a table's SQL reads, itself last, in an order that can be evaluated."""
    out: list[str] = []
    for other in TABLES:
        if other != name and re.search(rf"\b(FROM|JOIN) {other}\b", TABLES[name]):
            out += [x for x in depends(other) if x not in out]
    return [*out, name]


def with_tables(names: list[str], body: str) -> str:
    """SQL for DuckDB: the derived tables as common table expressions before the body."""
    order: list[str] = []
    for n in names:
        order += [x for x in depends(n) if x not in order]
    ctes = ", ".join(f"{n} AS ({TABLES[n]})" for n in order)
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


def _timed(df: DataFrame) -> DataFrame:
    """Times without a zone count as session time."""
    return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def _over(spark: SparkSession, name: str, read) -> DataFrame:
    text = with_tables([name], f"SELECT * FROM {name}")
    used = {b: _timed(read(b)) for b in BASE if re.search(rf"\b(FROM|JOIN) {b}\b", text)}
    text = text.replace("{", "{{").replace("}", "}}")  # braces name tables
    for b in used:
        text = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", text)
    return spark.sql(text, **used)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the driver's Parquet files."""
    return _over(spark, name, lambda b: spark.read.parquet(f"{sf_dir}/{b}.parquet"))


def load_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same as a stream, of tables that read one base table without aggregates. A pattern, as a stream can't be of one file."""
    return _over(spark, name, lambda b: spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{b}.parquet").schema).parquet(f"{sf_dir}/{b}.parque[t]"))
