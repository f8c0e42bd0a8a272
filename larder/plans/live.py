"""Queries of sources, pages and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.misc import map_url_coords
from larder.operators import evaluation as E
from larder.operators import pages as P
from larder.operators import telemetry as T
from larder.sources import tables as S
from larder.sources.scratch import scratch
from larder.streaming import limits as M
from larder.streaming import streams as R

from . import fixtures
from .fixtures import load, load_stream, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, run, needs=(), sql=""):
    QUERIES[name] = run
    if sql:
        SQL[name] = with_tables(list(needs), sql) if needs else sql


_pages = lambda s, d: s.read.parquet(f"{d}/pages.parquet")
_signals = lambda s, d: P.page_signals(_pages(s, d))
_links = lambda s, d: P.page_links(P.page_signals(_pages(s, d), text=False))
add("src_pages", lambda s, d: S.read_pages(s, f"{d}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("n")), (), "SELECT page_id, url, length(html) AS n FROM pages")
add("src_full_scan", lambda s, d: load(s, d, "dishes").groupBy("classification").agg(F.count("*").alias("n")), ["dishes"], "SELECT classification, count(*) AS n FROM dishes GROUP BY 1")
add("src_docs_binary", lambda s, d: _pages(s, d).select("page_id", S.content_kind(F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("255044462D312E340A0A0A0A"))).when(F.col("page_id") % 3 == 1, F.unhex(F.lit("524946460000000057454250"))).otherwise(F.col("html").cast("binary"))).alias("kind")), (), "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/webp' END AS kind FROM pages")
add("src_json_candidates", lambda s, d: S.explode_candidates(_pages(s, d).select(F.col("page_id").alias("id"), F.concat(F.lit('{"candidates":[{"id":"a","type":"pdf","ref":"'), F.col("url"), F.lit('"},{"id":"b","type":"text","ref":""}]}')).alias("menu_candidates"))).select("restaurant_id", F.col("id").alias("candidate"), "type", "ref"), (), "SELECT page_id AS restaurant_id, 'a' AS candidate, 'pdf' AS type, url AS ref FROM pages UNION ALL SELECT page_id, 'b', 'text', '' FROM pages")
add("src_dims", lambda s, d: load(s, d, "feedback").join(F.broadcast(S.dim_actions(s)), F.col("feedback_type") == F.col("kind"), "left").select("id", "action"), ["feedback"], "SELECT id, CASE feedback_type WHEN 'not_a_menu' THEN 'remove_menu' WHEN 'menu_outdated' THEN 'reparse' WHEN 'wrong_name' THEN 'rename' WHEN 'strange' THEN NULL ELSE 'route' END AS action FROM feedback")
add("snk_csv_quoted", lambda s, d: load(s, d, "dishes").select("id", F.concat_ws(",", S.csv_cell(F.col("name")), S.csv_cell(F.col("price"))).alias("line")), ["dishes"], """SELECT id, '"' || replace(name, '"', '""') || '","' || replace(coalesce(price, ''), '"', '""') || '"' AS line FROM dishes""")
add("snk_csv_min", lambda s, d: load(s, d, "dishes").select("id", S.csv_cell(F.col("price"), False).alias("cell")), ["dishes"], """SELECT id, CASE WHEN contains(price, '"') OR contains(price, ',') THEN '"' || replace(price, '"', '""') || '"' ELSE coalesce(price, '') END AS cell FROM dishes""")
add("snk_error_log", lambda s, d: S.error_log_lines(E.correction_log(load(s, d, "eval_cases"), load(s, d, "eval_dishes"), load(s, d, "eval_candidates"))).groupBy("section").agg(F.count("*").alias("n"), F.min("line").alias("first")), ["eval_cases", "eval_dishes", "eval_candidates"], """SELECT section, count(*) AS n, min(line) AS first FROM (SELECT CASE WHEN expected = 'neither' AND ai_original IN ('vegan', 'vegetarian') THEN 'unsafe' ELSE 'misread' END AS section, 'case ' || case_id || ' - ' || trim(name) || ' ' || ai_original || ' -> ' || expected AS line FROM eval_dishes WHERE ai_original <> expected
UNION ALL SELECT verdict, 'case ' || case_id || ' - ' || label FROM eval_candidates WHERE verdict <> 'correct' UNION ALL SELECT 'missed', 'case ' || id || ' - ' || trim(missed_menus) FROM eval_cases WHERE trim(missed_menus) <> '') GROUP BY 1""")

add("page_text", lambda s, d: _signals(s, d).select("page_id", "url", F.length("text").alias("n")))
add("page_links", lambda s, d: _links(s, d).select("page_id", "ord", "href", "url", "text"))
add("page_menu_links", lambda s, d: P.menu_links(_links(s, d)))
add("page_nav_links", lambda s, d: P.nav_links(_links(s, d)))
add("page_menu_images", lambda s, d: P.menu_images(P.page_signals(_pages(s, d), text=False)))
add("page_english_variant", lambda s, d: P.english_variants(_signals(s, d)))
add("page_homepage_url", lambda s, d: P.homepage_urls(_pages(s, d)))
add("top_homepage_url", lambda s, d: P.homepage_urls(_pages(s, d).withColumn("html", F.concat("html", F.lit('"https://own.ie/a/b" "https://own.ie"')))).drop("keyed"), (), "SELECT page_id, 'https://own.ie' AS homepage FROM pages")
# six kinds of listing: fields, lists, quotes escaped in two ways, a field that names no place of one's own, nothing of use
fixtures.TABLES["listings"] = """
SELECT page_id, url, html || '<script>"https://aa.ie" ' || CASE page_id % 6
  WHEN 0 THEN '{"website" : "https:' || chr(92) || '/' || chr(92) || '/www.place' || cast(page_id AS varchar(20)) || '.ie' || chr(92) || '/menu"}'
  WHEN 1 THEN 'website_uri: "https://own' || cast(page_id AS varchar(20)) || '.ie/x" "website":"https://second.ie"'
  WHEN 2 THEN chr(92) || 'x22https://b' || cast(page_id % 10 AS varchar(20)) || '.ie' || chr(92) || 'x22 "https://long-name-of-a-place.ie/a/b"'
  WHEN 3 THEN '"website":"https://www.facebook.com/x" ["https://list' || cast(page_id AS varchar(20)) || '.ie",null,null,null]'
  WHEN 4 THEN 'externalLinks: {"a":1} ["https://links' || cast(page_id AS varchar(20)) || '.ie?ref=1"]'
  ELSE '"https://aa.ie/logo.png" "https://www.instagram.com/y" "https://zz.ie/a?b=c"' END || '</script>' AS html
FROM pages"""
add("page_homepage_given", lambda s, d: P.homepage_urls(load(s, d, "listings")), ["listings"], """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.place' || page_id || '.ie/menu' WHEN 1 THEN 'https://own' || page_id || '.ie/x' WHEN 3 THEN 'https://list' || page_id || '.ie' WHEN 4 THEN 'https://links' || page_id || '.ie?ref=1' ELSE 'https://aa.ie' END AS homepage,
  page_id % 6 IN (0, 1, 3, 4) AS keyed FROM listings""")
# links to maps with coordinates in their path or query, an address, or nothing of use
fixtures.TABLES["map_links"] = """
SELECT page_id, 'https://www.google.com/maps' || CASE page_id % 6 WHEN 0 THEN '/place/x/@' || cast(page_id % 90 AS varchar(20)) || '.25,-6.5,17z' WHEN 1 THEN '?q=' || cast(page_id % 90 AS varchar(20)) || '.5%2C+' || cast(page_id % 180 AS varchar(20)) WHEN 2 THEN '?query=' || cast(page_id AS varchar(20)) || '+Fade+Street%2C+Dublin'
  WHEN 3 THEN '?hl=en&destination=91.0,5' WHEN 4 THEN '/dir/' ELSE '?q=-' || cast(page_id % 90 AS varchar(20)) || ',-0.25#top' END AS link
FROM pages"""
add("map_url_parts", lambda s, d: load(s, d, "map_links").select("page_id", map_url_coords(F.col("link")).alias("m")).select("page_id", "m.*"), ["map_links"], """
SELECT page_id, CAST(CASE page_id % 6 WHEN 0 THEN page_id % 90 + 0.25 WHEN 1 THEN page_id % 90 + 0.5 WHEN 5 THEN -(page_id % 90) END AS double) AS latitude,
  CAST(CASE page_id % 6 WHEN 0 THEN -6.5 WHEN 1 THEN page_id % 180 WHEN 5 THEN -0.25 END AS double) AS longitude, CASE WHEN page_id % 6 = 2 THEN page_id || ' Fade Street, Dublin' END AS address FROM map_links""")
add("page_external_site", lambda s, d: P.external_sites(_links(s, d)))
add("page_locations", lambda s, d: P.page_locations(_pages(s, d)))
# the given pages publish no addresses, so each gets one of seven kinds of contact block
fixtures.TABLES["located_pages"] = """
SELECT page_id, url, html || CASE page_id % 7
  WHEN 0 THEN '<footer><p>' || cast(page_id AS varchar(20)) || ' Main Street<br>Dublin 2 D02 X2Y3<br>Phone: 01 234 5678</p></footer>'
  WHEN 1 THEN '<div class="contact"><p>hello@place.ie ' || cast(page_id AS varchar(20)) || ' Quai Vert Lyon</p></div>'
  WHEN 2 THEN '<script type="application/ld+json">{"@graph":[{"@type":["Thing","Restaurant"],"name":" The  Place ","address":{"streetAddress":"' || cast(page_id AS varchar(20)) || ' Harbour Road","addressLocality":"Dublin"},"geo":{"latitude":"53.5","longitude":-6.25}}]}</script><address>' || cast(page_id AS varchar(20)) || ' Harbour Road<br>Dublin, Ireland</address>'
  WHEN 3 THEN '<a href="https://www.google.com/maps?q=' || cast(page_id AS varchar(20)) || '+Fade+Street%2C+Dublin+2">map</a>'
  WHEN 4 THEN '<iframe src="https://www.google.com/maps/@53.25,-6.5,17z"></iframe><a href="https://maps.app.goo.gl/x?q=1.5,200">bad</a>'
  WHEN 5 THEN '<p>From 2016 to 2019 we cooked on a corner of Dublin, ' || cast(page_id AS varchar(20)) || ' days a year</p><p>Room 5 Hidden Lane</p>'
  ELSE '<ul><li id="our-address">' || cast(page_id AS varchar(20)) || ' Ranelagh, Dublin 6<li>Address: 1' || cast(page_id AS varchar(20)) || ' Keizersgracht, 1015 CJ Amsterdam <a href="https://www.google.com/maps/place/x/@52.25,4.75">pin</a></ul>' END AS html
FROM pages"""
add("page_locations_given", lambda s, d: P.page_locations(load(s, d, "located_pages")), ["located_pages"], """
WITH f AS (SELECT page_id, page_id % 7 AS k FROM located_pages)
SELECT page_id, 'website_address_element' AS source, page_id || ' Main Street Dublin 2 D02 X2Y3' AS address, NULL AS label, CAST(NULL AS double) AS latitude, CAST(NULL AS double) AS longitude, 'medium' AS confidence FROM f WHERE k = 0
UNION ALL SELECT page_id, 'website_address_element', page_id || ' Quai Vert Lyon', NULL, NULL, NULL, 'medium' FROM f WHERE k = 1
UNION ALL SELECT page_id, 'website_address_element', page_id || ' Harbour Road Dublin, Ireland', 'The Place', 53.5, -6.25, 'high' FROM f WHERE k = 2
UNION ALL SELECT page_id, 'website_map_link', page_id || ' Fade Street, Dublin 2', NULL, NULL, NULL, 'medium' FROM f WHERE k = 3
UNION ALL SELECT page_id, 'website_map_link', '', NULL, 53.25, -6.5, 'low' FROM f WHERE k = 4
UNION ALL SELECT page_id, 'website_address_element', page_id || ' Ranelagh, Dublin 6', NULL, NULL, NULL, 'medium' FROM f WHERE k = 6
UNION ALL SELECT page_id, 'website_address_element', '1' || page_id || ' Keizersgracht, 1015 CJ Amsterdam', NULL, NULL, NULL, 'medium' FROM f WHERE k = 6""")
add("page_contact_links", lambda s, d: P.contact_links(_links(s, d)))
add("win_first_label", lambda s, d: P.first_labels(_links(s, d)))
add("win_link_topk", lambda s, d: P.nav_links(_links(s, d), 3))

# the given pages have no such links or images, so each gets one of seven kinds
fixtures.TABLES["linked_pages"] = """
SELECT page_id, 'https://spot' || cast(page_id AS varchar(20)) || '.ie/' AS url, html || CASE page_id % 7
  WHEN 0 THEN '<a href="/food/dinner">Dinner</a> <a href="/gift-menu">Menu</a>'
  WHEN 1 THEN '<a href="files/lunch.pdf">Lunch Menu</a>'
  WHEN 2 THEN '<a href="https://order.shop.ie/x">Order</a> <a href="https://other.ie/menu"><b>Menu</b></a>'
  WHEN 3 THEN '<a href="#menu">Menu</a> <embed src="/card">'
  WHEN 4 THEN '<img src="/img/menu-board.jpg?v=2" width="800"><img src="/img/menu-logo.png"><img data-src="/img/x.jpg" src="/img/wait.gif" alt="Our food">'
  WHEN 5 THEN '<a href="/over">About us</a> <a href="/hier">Find us</a> <a href="https://elsewhere.ie/contact">Contact</a>'
  ELSE '<a href="https://www.instagram.com/x">i</a> <a href="https://own.ie/">Site</a>' END AS html
FROM pages"""
_linked = lambda s, d: P.page_links(P.page_signals(load(s, d, "linked_pages"), text=False))
add("page_menu_links_given", lambda s, d: P.menu_links(_linked(s, d)), ["linked_pages"], """
SELECT page_id, 'html' AS kind, url || 'food/dinner' AS url, 8 AS score, 1 AS rank, 'Dinner' AS label FROM linked_pages WHERE page_id % 7 = 0
UNION ALL SELECT page_id, 'pdf', url || 'files/lunch.pdf', 7, 1, 'Lunch Menu' FROM linked_pages WHERE page_id % 7 = 1
UNION ALL SELECT page_id, 'html', 'https://order.shop.ie/x', 7, 1, 'Order' FROM linked_pages WHERE page_id % 7 = 2""")
add("page_menu_images_given", lambda s, d: P.menu_images(P.page_signals(load(s, d, "linked_pages"), text=False)), ["linked_pages"], """
SELECT page_id, url || 'img/menu-board.jpg' AS url, 13 AS score, 1 AS rank FROM linked_pages WHERE page_id % 7 = 4 UNION ALL SELECT page_id, url || 'img/x.jpg', 6, 2 FROM linked_pages WHERE page_id % 7 = 4""")
add("page_contact_links_given", lambda s, d: P.contact_links(_linked(s, d)), ["linked_pages"], """
SELECT page_id, url || 'hier' AS url, 1 AS rank FROM linked_pages WHERE page_id % 7 = 5 UNION ALL SELECT page_id, url || 'over', 2 FROM linked_pages WHERE page_id % 7 = 5""")
add("page_external_given", lambda s, d: P.external_sites(_linked(s, d)), ["linked_pages"], """
SELECT page_id, CASE page_id % 7 WHEN 2 THEN 'https://order.shop.ie/x' WHEN 5 THEN 'https://elsewhere.ie/contact' ELSE 'https://own.ie/' END AS site FROM linked_pages WHERE page_id % 7 IN (2, 5, 6)""")

# whole pages of one pattern, so that all of their text and links is known
fixtures.TABLES["small_pages"] = """
SELECT page_id, 'https://spot' || cast(page_id AS varchar(20)) || '.ie/' AS url, '<html><head><style>p{}</style></head><body><nav><a href="/dining">Eat here</a></nav><p>Hello <b>page ' || cast(page_id AS varchar(20)) || '</b> &amp; more</p><a href="/dining">Again</a>'
  || '<a href="/a/b/c/d">Deep</a><a href="/food">Food</a><a href="/kitchen/x">K</a><a href="/contact">C</a><script>var x = "<p>no</p>";</script></body></html>' AS html
FROM pages"""
_small = lambda s, d, text=False: P.page_signals(load(s, d, "small_pages"), text=text)
add("page_text_given", lambda s, d: _small(s, d, True).select("page_id", "text"), ["small_pages"], "SELECT page_id, 'Hello page ' || page_id || ' & more Again Deep Food K C' AS text FROM small_pages")
LISTED = "SELECT page_id, url AS page, unnest([0, 1, 2, 3, 4, 5]) AS ord, unnest(['dining', 'dining', 'a/b/c/d', 'food', 'kitchen/x', 'contact']) AS path, unnest(['Eat here', 'Again', 'Deep', 'Food', 'K', 'C']) AS text FROM small_pages"
add("page_links_given", lambda s, d: P.page_links(_small(s, d)).select("page_id", "ord", "href", "url", "text"), ["small_pages"], f"SELECT page_id, ord, '/' || path AS href, page || path AS url, text FROM ({LISTED})")
add("win_first_label_given", lambda s, d: P.first_labels(P.page_links(_small(s, d))), ["small_pages"], f"SELECT page_id, page || path AS url, arg_min(text, ord) AS label FROM ({LISTED}) GROUP BY ALL")
add("win_link_topk_given", lambda s, d: P.nav_links(P.page_links(_small(s, d)), 3), ["small_pages"], """
SELECT page_id, url || unnest(['dining', 'food', 'kitchen/x']) AS url, unnest([8, 8, 6]) AS score, unnest([1, 2, 3]) AS rank FROM small_pages""")
fixtures.TABLES["foreign_pages"] = """
SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '<p>Short</p><a href="/en/menu">Menu</a>' WHEN 1 THEN '<head><link rel="alternate" hreflang="en-GB" href="/uk/"></head><p>' || repeat('lekker ', 60) || '</p><a href="/en/menu">Menu</a>'
  ELSE '<p>' || repeat('smakelijk ', 60) || '</p><a href="/nl/kaart">Kaart</a><a href="/en/menu">Menu</a><a href="/taal">English</a>' END AS html
FROM small_pages"""
add("page_english_variant_given", lambda s, d: P.english_variants(P.page_signals(load(s, d, "foreign_pages"))), ["foreign_pages"], "SELECT page_id, url || CASE page_id % 3 WHEN 1 THEN 'uk/' ELSE 'en/menu' END AS variant FROM foreign_pages WHERE page_id % 3 > 0")

A, E2 = ["attempts"], ["product_events"]
OUT = "CASE WHEN NOT success THEN 'error' WHEN dish_count IS NULL THEN NULL WHEN dish_count < 7 THEN 'thin' ELSE 'menu' END"
CODE = "CASE error_message WHEN 'Request timed out' THEN 'timeout' WHEN 'Could not find a menu' THEN 'no_menu_readable' WHEN 'HTTP 429 too many requests' THEN 'rate_limited' WHEN 'fetch failed: ECONNREFUSED' THEN 'network' WHEN 'odd failure' THEN 'unknown' END"
add("st_attempts", lambda s, d: R.replay_closed(lambda x: R.attempts_by_hour(T.build_attempts(x)), (load_stream(s, d, "attempts"), "created_at")), A, f"SELECT date_trunc('hour', created_at)::timestamp AS hour, {OUT} AS outcome, {CODE} AS error_code, count(*) AS n FROM attempts GROUP BY 1, 2, 3")
add("st_success_ratio", lambda s, d: R.replay_closed(R.success_ratio, (load_stream(s, d, "product_events"), "ts")), E2, "SELECT start, count(*) FILTER (event = 'results_viewed' AND outcome = 'menu') AS ok, count(*) FILTER (event = 'search_submitted') AS searches, count(*) FILTER (event = 'results_viewed' AND outcome = 'menu') / nullif(count(*) FILTER (event = 'search_submitted'), 0) AS ratio, coalesce(count(*) FILTER (event = 'results_viewed' AND outcome = 'menu') / nullif(count(*) FILTER (event = 'search_submitted'), 0) < 0.6, false) AS low FROM (SELECT *, (date_trunc('hour', ts)::timestamp - k * interval '1' hour) AS start FROM product_events, (SELECT unnest(range(24)) AS k)) GROUP BY 1")
add("st_thin_share", lambda s, d: R.replay_closed(R.thin_share, (load_stream(s, d, "product_events"), "ts", {"event": "results_viewed"})), E2, "SELECT date_trunc('hour', ts)::timestamp AS hour, count(*) FILTER (outcome = 'thin') AS thin, count(*) AS n FROM product_events WHERE event = 'results_viewed' GROUP BY 1")
add("st_spend", lambda s, d: R.replay_closed(R.spend_by_hour, (load_stream(s, d, "usage_log"), "created_at")).withColumn("cost", F.col("cost").cast("double")), ["usage_log"], "SELECT date_trunc('day', created_at)::timestamp AS day, source, cast(sum(cost_usd) AS double) AS cost, count(*) FILTER (restaurant_id IS NULL AND url IS NULL) AS unattributed FROM usage_log GROUP BY 1, 2")
add("st_report_flag", lambda s, d: R.replay(R.report_flags(load_stream(s, d, "reports")), "complete"), ["reports"], "SELECT dish_id, count(*) AS reports, count(*) >= 3 AS flagged FROM reports GROUP BY 1")
add("st_sessions", lambda s, d: R.replay_closed(R.sessions, (load_stream(s, d, "product_events"), "ts")), E2, """SELECT user_id, min(ts) AS start, count(*) AS n, count(*) FILTER (event = 'search_submitted') > 0 AND count(*) FILTER (event IN ('results_viewed', 'error_shown')) = 0 AS abandoned FROM (
  SELECT *, sum(CASE WHEN ts - prev < interval '30' minute THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, id) AS g FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) AS prev FROM product_events)) GROUP BY user_id, g""")
_stage = lambda s, d, stage: load_stream(s, d, "attempts").filter(F.col("stage") == stage)
add("st_search_join", lambda s, d: R.replay_closed(R.search_join, (_stage(s, d, "discover"), "created_at"), (_stage(s, d, "analyze"), "created_at", R.NO_MATCH)), A, "SELECT d.id AS discover_id, a.id AS analyze_id FROM (SELECT * FROM attempts WHERE stage = 'discover') d LEFT JOIN attempts a ON a.stage = 'analyze' AND a.anon_id = d.anon_id AND a.url = d.url AND a.created_at >= d.created_at AND a.created_at <= d.created_at + interval '1' hour")
add("st_dedupe_events", lambda s, d: R.replay(R.distinct_views(load_stream(s, d, "product_events"))).select("user_id", "domain", "event"), E2, "SELECT DISTINCT user_id, domain, event FROM product_events WHERE event = 'results_viewed'")  # one batch, so no row is late
add("st_rate_limit", lambda s, d: M.rate_limit(load_stream(s, d, "reports"), most=2, span=86_400))
add("rate_limit_batch", lambda s, d: R.rate_limit_batch(load(s, d, "reports"), most=2, span=86_400))
VOTE = ["id", "dish_id as email", "issue_type as city", "cast(null as string) as country", "ip_hash", "created_at"]


def _votes(s, d):
    taken = load(s, d, "reports").filter("restaurant_id = 3").selectExpr(*VOTE)
    return M.vote_ingest(load_stream(s, d, "reports").selectExpr(*VOTE), scratch(s, "votes"), taken=taken, most=2)


add("st_vote_ingest", lambda s, d: _votes(s, d)[1])
# votes for cities of the list, for others, without a region, from addresses that are no hashes; some twice, from two addresses
fixtures.TABLES["vote_cities"] = """
SELECT 'Town ' || cast(n_nationkey AS varchar(20)) AS city, 'country' || cast(n_nationkey AS varchar(20)) AS country, 'region' || cast(n_nationkey % 4 AS varchar(20)) AS region FROM nation"""
fixtures.TABLES["sent_votes"] = """
SELECT cast(event_id AS bigint) AS id, ' Voter' || cast(user_id % 300 AS varchar(20)) || '@mail.ie ' AS email, CASE WHEN event_id % 9 = 0 THEN 'Some Place' ELSE ' town  ' || cast(event_id % 25 AS varchar(20)) END AS city,
  'country' || cast(event_id % 25 AS varchar(20)) AS country, CASE WHEN event_id % 11 <> 0 THEN 'region' || cast(event_id % 25 % 4 AS varchar(20)) END AS region, event_id % 9 = 0 AS is_custom,
  CASE WHEN event_id % 13 = 0 THEN 'plain' ELSE lpad(cast(event_id % 50 AS varchar(20)), 16, 'a') END AS ip_hash, ts AS created_at
FROM events WHERE event_id % 3 = 0"""


def _checked(s, d):
    told = M.vote_ingest(load_stream(s, d, "sent_votes"), scratch(s, "votes"), cities=load(s, d, "vote_cities"), most=1_000_000)
    return told[1]


add("st_vote_ingest_checked", _checked, ["sent_votes", "vote_cities"], """
SELECT id, CASE WHEN error IS NOT NULL THEN 'invalid: ' || error WHEN row_number() OVER (PARTITION BY error, email, city, place ORDER BY sec, id) = 1 THEN 'accepted' ELSE 'repeat' END AS verdict
FROM (SELECT v.id, email, city, floor(epoch(created_at)) AS sec, CASE WHEN NOT is_custom THEN country END AS place,
  CASE WHEN region IS NULL THEN CASE WHEN is_custom THEN 'region' ELSE 'not listed' END WHEN NOT regexp_full_match(ip_hash, '[0-9a-f]{16}') THEN 'ip_hash' END AS error FROM sent_votes v)""")
