"""One query a scalar function: key and value over a derived table, with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import misc as M
from larder.functions import text as T
from larder.functions import urls as U

from . import fixtures
from .fixtures import load, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def add(name: str, table: str, key: str, value, sql: str, before: str = "") -> None:
    """value: Column over the table, given by a function of the row's columns. before: a derived column for both, `x := expr`."""

    def run(spark, sf_dir):
        df = load(spark, sf_dir, table)
        if before:
            alias, _, expr = before.partition(" := ")
            df = df.withColumn(alias, F.expr(expr))
        return df.select(F.col(key).alias("key"), value().alias("value"))

    QUERIES[name] = run
    if sql:
        source = f"(SELECT *, {before.partition(' := ')[2]} AS {before.partition(' := ')[0]} FROM {table}) t" if before else table
        SQL[name] = with_tables([table], f"SELECT {key} AS key, {sql} AS value FROM {source}")


u = lambda: F.col("url")
HOST = r"regexp_extract(trim(url), '(?i)^(?:https?://+)?(?:[^/?#@]*@)?([^/?#:\s]+)', 1)"
RAW = r"lower(regexp_extract(url, '(?i)^\s*https?://+(?:[^/?#@]*@)?([^/?#:\s]+)', 1))"
NORM = r"regexp_replace(regexp_replace(lower(url), '^https?:/+(www\.)?', ''), '/+$', '')"
BARE = rf"regexp_replace(lower({HOST}), '^www\.', '')"
SHARED = rf"(regexp_matches({BARE}, '^(order|orders|ordering)\.') OR regexp_matches({BARE}, {_q(U.SHARED_PLATFORMS)}))"
PATH = r"regexp_extract(url, '(?i)^\s*https?://+[^/?#]+([^?#]*)', 1)"
SEGS = f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')"
SLUG = rf"trim(regexp_replace(regexp_replace(coalesce(list_extract({SEGS}, -1), ''), '(?i)\.(pdf|jpe?g|png|webp|html?)$', ''), '[-_]+', ' ', 'g'))"

add("url_normalize", "urls", "page_id", lambda: U.url_normalize(u()), NORM)
add("url_host", "urls", "page_id", lambda: U.url_host(u()), BARE)
add("url_is_shared_platform", "urls", "page_id", lambda: U.url_is_shared_platform(u()), SHARED)
add("url_dedup_key", "urls", "page_id", lambda: U.url_dedup_key(u()), f"CASE WHEN {SHARED} THEN {NORM} ELSE {BARE} END")
add("url_canonical", "urls", "page_id", lambda: U.url_canonical(u()), f"CASE WHEN {SHARED} THEN trim(url) ELSE 'https://' || {BARE} END")
add("url_domain", "urls", "page_id", lambda: U.url_domain(u()), rf"nullif(regexp_replace({RAW}, '^www\.', ''), '')")
add("url_looks_like", "urls", "page_id", lambda: U.url_looks_like(u()), f"contains({BARE}, '.') AND NOT contains(trim(url), ' ')")
add("url_type", "urls", "page_id", lambda: U.url_type(u()), r"CASE WHEN regexp_matches(lower(url), '\.pdf$|/pdf/|menu\.pdf') THEN 'pdf' WHEN regexp_matches(lower(url), 'maps\.google|maps\.app\.goo|goo\.gl/maps') THEN 'google_maps' WHEN regexp_matches(lower(url), '(instagram|facebook|twitter|tiktok)\.com') THEN 'social' ELSE 'html' END")
add("url_is_review_site", "urls", "page_id", lambda: U.url_is_review_site(u()), r"regexp_matches(lower(url), '(yelp|tripadvisor|zomato|opentable|thefork)\.com')")
add("url_is_pdf", "urls", "page_id", lambda: U.url_is_pdf(u()), r"contains(lower(url), '.pdf') OR contains(split_part(lower(url), '?', 1), '/pdf/') OR regexp_matches(lower(url), 'issuu\.com|drive\.google\.com/file|flipbook|format=pdf')")
add("url_is_ordering_host", "urls", "page_id", lambda: U.url_is_ordering_host(u()), f"regexp_matches({RAW}, {_q(U.ORDERING_HOSTS)})")
add("url_is_restaurant_site", "urls", "page_id", lambda: U.url_is_restaurant_site(u()), f"contains({RAW}, '.') AND length(url) <= 300 AND NOT regexp_matches(lower(url), {_q('|'.join(s.replace('.', chr(92) + '.') for s in U.OTHER_SITES))}) AND NOT regexp_matches(lower({PATH}), {_q('(' + '|'.join(s.replace('.', chr(92) + '.') for s in U.ASSET_ENDINGS) + ')$')})")
add("url_homepage_score", "urls", "page_id", lambda: U.url_homepage_score(u()), rf"CASE WHEN {RAW} = '' THEN -999 ELSE cast(100 - 20 * len({SEGS}) - CASE WHEN regexp_matches(split_part(url, '#', 1), '\?.') THEN 40 ELSE 0 END - CASE WHEN regexp_matches(url, '#.') THEN 10 ELSE 0 END - length(url) // 15 AS int) END")
add("url_same_page_key", "urls", "page_id", lambda: U.url_same_page_key(u()), "regexp_replace(split_part(url, '#', 1), '/$', '')")
add("url_base_domain", "urls", "page_id", lambda: U.url_base_domain(u()), rf"nullif(regexp_extract({RAW}, '([^.]+\.)?[^.]+$'), '')")
add("url_same_site", "urls", "page_id", lambda: U.url_same_site(u(), F.col("other")), rf"coalesce(regexp_extract({RAW}, '([^.]+\.)?[^.]+$') = 'place.ie', false)", before="other := 'https://www.place.ie/x'")
add("url_path_english", "urls", "page_id", lambda: U.url_path_english(u()), r"regexp_matches(lower(regexp_extract(url, '(?i)^https?://+[^/?#]+([^#]*)', 1)), '(^|/)(en|eng|english|en[-_][a-z]{2})(/|$)|[?&](lang|language|locale|hl|l|taal|idioma|sprache)=(en|eng|english)(\b|-|_)')")
add("url_lang_key", "urls", "page_id", lambda: U.url_lang_key(u()), f"CASE WHEN regexp_matches(url, '(?i)/({U.LANGUAGES})(/|$)') THEN regexp_replace(url, '(?is)^(.*?)/(?:{U.LANGUAGES})(/|$)', '\\1/*\\2') END")
add("url_hint", "urls", "page_id", lambda: U.url_hint(u()), SLUG)
add("hint_is_opaque", "urls", "page_id", lambda: U.hint_is_opaque(U.url_hint(u())), f"{SLUG} = '' OR len(list_filter(string_split({SLUG}, ' '), lambda w: regexp_matches(w, '(?i)^[0-9a-f]{{6,}}$') OR regexp_matches(w, '^[0-9]+$'))) >= greatest(1, len(string_split({SLUG}, ' ')) - 1)")
add("url_is_branch", "urls", "page_id", lambda: U.url_is_branch(u()), f"len({SEGS}) >= 2 AND len(list_filter({SEGS}, lambda s: regexp_matches(lower(s), {_q(U.BRANCH_WORDS)}))) > 0")
add("doc_filename", "urls", "page_id", lambda: U.doc_filename(u()), rf"CASE WHEN coalesce(list_extract({SEGS}, -1), '') = '' THEN 'menu.pdf' WHEN ends_with(lower(list_extract({SEGS}, -1)), '.pdf') THEN right(regexp_replace(list_extract({SEGS}, -1), '[^A-Za-z0-9_.-]', '', 'g'), 80) ELSE right(regexp_replace(list_extract({SEGS}, -1), '[^A-Za-z0-9_.-]', '', 'g'), 80) || '.pdf' END")
add("doc_url_candidates", "urls", "page_id", lambda: F.array_join(U.doc_url_candidates(u()), " "), "url")
add("link_kind", "urls", "page_id", lambda: U.link_kind(u()), r"CASE WHEN regexp_matches(split_part(lower(url), '?', 1), '\.pdf$|/pdf/|menu\.pdf') THEN 'pdf' WHEN regexp_matches(split_part(lower(url), '?', 1), '\.(jpe?g|png|webp)$') THEN 'image' ELSE 'other' END")
add("arrival_source", "urls", "page_id", lambda: U.arrival_source(F.when(F.col("page_id") % 5 == 0, "share"), F.regexp_extract(u(), r"^https?://[^/]+(/[^?#]*)", 1)), r"CASE WHEN page_id % 5 = 0 THEN 'share' WHEN regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) = '/' THEN 'search' WHEN regexp_matches(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '(?i)^/[a-z0-9-]+/?$') THEN 'guide' ELSE 'direct' END")
add("candidate_id", "urls", "page_id", lambda: U.candidate_id(F.lit("pdf"), u()), "lpad(printf('%x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split('pdf|' || url, ''), lambda c: ascii(c)::bigint)), lambda a, c: (xor(a, c) * 16777619) % 4294967296)), 8, '0')")
add("candidate_id_whole", "urls", "page_id", lambda: U.candidate_id(F.lit("pdf"), u()), "")

n = lambda: F.col("name")
add("parse_price", "dishes", "id", lambda: T.parse_price(F.col("price")), "try_cast(replace(coalesce(nullif(regexp_extract(price, '[€£$]\\s*([0-9]+(?:[.,][0-9]{1,2})?)', 1), ''), nullif(regexp_extract(price, '[0-9]+(?:[.,][0-9]{1,2})?'), '')), ',', '.') AS double)")
add("format_price", "dishes", "id", lambda: T.format_price(F.col("price")), r"CASE WHEN regexp_matches(price, '[0-9]') THEN CASE WHEN regexp_matches(price, '[€£$]') THEN price ELSE regexp_replace(price, '([0-9]+(?:[.,][0-9]{1,2})?)', '€\1', 'g') END END")
add("is_drink_dish", "dishes", "id", lambda: T.is_drink_dish(n()), f"regexp_matches(lower(name), '{'|'.join(T.DRINKS)}')")
add("is_header_dish", "dishes", "id", lambda: T.is_header_dish(n(), F.col("description"), F.col("price")), r"regexp_matches(name, '(?i)\b(menu|selection|platter|board|option)s?\b$') AND description IS NULL AND price IS NULL")
add("header_item", "dishes", "id", lambda: T.header_item(n(), F.col("description"), F.col("price")), r"regexp_matches(name, '(?i)\b(menu|selection|tasting|platter|board|sample)\b') AND description IS NULL AND price IS NULL")
add("is_drink_section", "menu_sections", "id", lambda: T.is_drink_section(n()), "lower(trim(name)) IN ('drinks', 'beer', 'tea', 'coffee')")
add("is_non_main_section", "menu_sections", "id", lambda: T.is_non_main_section(n()), "regexp_matches(lower(name), 'dessert|sweet|pudding|side|nibble|snack|bar bites|bread|bakery')")
KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(name), '\([^)]*\)', ' ', 'g'), '\b(v|vg|ve|vgn|vegan|vegetarian|veg)\b', ' ', 'g'), '[^a-z0-9]+', '', 'g')"
add("norm_dish_insights", "dishes", "id", lambda: T.norm_dish_insights(n(), F.col("id")), f"CASE WHEN {KEY} = '' THEN '#' || id ELSE {KEY} END")
add("norm_dish_merge", "dishes", "id", lambda: T.norm_dish_merge(n()), r"trim(regexp_replace(regexp_replace(lower(name), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))")
add("norm_dish_verify", "dishes", "id", lambda: T.norm_dish_verify(n()), "trim(lower(name))")
add("is_veg", "dishes", "id", lambda: T.is_veg(F.col("classification")), "classification <> 'neither'")
add("menu_as_dish_reason", "dishes", "id", lambda: T.menu_as_dish_reason(n(), F.col("description")), "CASE WHEN name = 'Tasting menu' THEN '\"Tasting menu\" reads as a menu title, not a dish' WHEN description = '3 courses' THEN '\"' || name || '\" looks like a tasting/set menu' END")
add("dietary_markers", "dishes", "id", lambda: T.diet_marked(n(), "vegan"), "contains(lower(name), 'vegan') OR contains(lower(name), '(vg)')")
add("excluded_ingredients", "dishes", "id", lambda: T.label_contradicted(F.col("classification"), F.concat_ws(" ", n(), F.col("description"))), r"classification = 'vegan' AND regexp_matches(lower(name || coalesce(' ' || description, '')), '\b(butter|cream)\b')")
add("city_slug", "restaurants", "id", lambda: T.city_slug(F.col("city")), "trim(regexp_replace(lower(strip_accents(city)), '[^a-z0-9]+', '-', 'g'), '-')")
add("vote_key", "restaurants", "id", lambda: T.vote_key(F.col("city"), F.when(F.col("id") % 3 != 0, "Ireland")), "lower(CASE WHEN id % 3 <> 0 THEN city || ', Ireland' ELSE city END)")
add("custom_city_norm", "restaurants", "id", lambda: T.custom_city_norm(F.concat(F.lit("  "), F.col("name"), F.lit("\t x "))), r"trim(regexp_replace('  ' || name || chr(9) || ' x ', '\s+', ' ', 'g'))")

FRENCH = "text_is_english"
add(FRENCH, "docs", "doc_id", lambda: T.text_is_english(F.col("text")), r"len(regexp_extract_all(coalesce(text, ''), '\S+')) < 40 OR len(regexp_extract_all(text, '(?i)\b(the|and|with|our|for|from|your|are|this|that|you|served|please)\b')) >= 0.02 * len(regexp_extract_all(text, '\S+'))")
add("price_tokens_review", "docs", "doc_id", lambda: T.price_tokens_review(F.col("text")).cast("bigint"), r"len(regexp_extract_all(text, '[€£$]\s?[0-9]|\b[0-9]{1,3}\.[0-9]{2}\b'))")
add("text_looks_like_menu_loose", "docs", "doc_id", lambda: T.text_looks_like_menu_loose(F.col("text")), r"regexp_matches(lower(text), 'starter|main course|mains|dessert|entrée|appetizer|para picar|à la carte|a la carte') OR len(regexp_extract_all(text, '[€£]\s*[0-9]+')) > 3")
add("is_non_food_menu", "docs", "doc_id", lambda: T.is_non_food_menu(F.col("text")), f"regexp_matches(text, {_q('(?i)' + chr(92) + 'b' + T.NON_FOOD_WORDS + chr(92) + 'b')})")
add("price_tokens_menu", "docs", "doc_id", lambda: T.price_tokens_menu(F.col("text")).cast("bigint"), "")
add("text_is_menu", "docs", "doc_id", lambda: T.text_is_menu(F.col("text")), "")
add("text_is_confident_menu", "docs", "doc_id", lambda: T.text_is_confident_menu(F.col("text")), "")
add("is_drink_source", "docs", "doc_id", lambda: T.is_drink_source(F.col("text")), "")
# texts whose amounts, opening hours, words and lines are known
fixtures.TABLES["menu_texts"] = """
SELECT page_id, cast(page_id % 6 AS int) AS soups, cast(page_id % 4 AS int) AS tarts, cast(page_id % 130 AS int) AS n,
  repeat('Good soup €5 ', cast(page_id % 6 AS int)) || repeat('Tart 6.50 ', cast(page_id % 4 AS int)) || repeat('open 9.30- 17.00 ', cast(page_id % 3 AS int)) || CASE page_id % 5 WHEN 0 THEN 'Wine list ' WHEN 1 THEN 'winery ' ELSE '' END || repeat('filler text here ', 10) AS text,
  repeat(repeat('ab ', 100) || chr(10), cast(page_id % 130 AS int)) AS many_lines
FROM pages"""
add("price_tokens_menu_given", "menu_texts", "page_id", lambda: T.price_tokens_menu(F.col("text")).cast("bigint"), "CAST(soups + tarts AS BIGINT)")
add("text_is_menu_given", "menu_texts", "page_id", lambda: T.text_is_menu(F.col("text")), "soups + tarts >= 4 AND soups > 0 OR soups + tarts >= 8")
add("text_is_confident_menu_given", "menu_texts", "page_id", lambda: T.text_is_confident_menu(F.repeat("text", F.lit(12))), "(soups > 0 OR tarts > 0) AND (12 * (soups + tarts) >= 8)")
add("is_drink_source_given", "menu_texts", "page_id", lambda: T.is_drink_source(F.col("text")), "page_id % 5 = 0")
add("menu_chunks_given", "menu_texts", "page_id", lambda: F.size(T.menu_chunks(F.col("many_lines"))).cast("bigint"), "CAST(CASE WHEN 301 * n <= 9000 THEN 1 ELSE ceil(n / ceil(ceil(301 * n / least(4, ceil(301 * n / 9000))) / 301)) END AS BIGINT)")
add("fold_text", "docs", "doc_id", lambda: F.md5(T.fold_text(F.col("text"))), r"md5(trim(regexp_replace(lower(strip_accents(regexp_replace(text, '\([^)]*\)', ' ', 'g'))), '\s+', ' ', 'g')))")
add("menu_chunks", "docs", "doc_id", lambda: F.size(T.menu_chunks(F.col("text"))).cast("bigint"), "")
add("markdown_link_labels", "docs", "doc_id", lambda: F.size(T.markdown_links(F.concat(F.col("text"), F.lit("[*Lunch*](https://a.ie/x.pdf) [Dinner](https://a.ie/x.pdf) [http://no](https://b.ie)")))).cast("bigint"), "")

add("error_code", "attempts", "id", lambda: M.error_code(F.col("error_message")), "CASE error_message WHEN 'Request timed out' THEN 'timeout' WHEN 'Could not find a menu' THEN 'no_menu_readable' WHEN 'HTTP 429 too many requests' THEN 'rate_limited' WHEN 'fetch failed: ECONNREFUSED' THEN 'network' ELSE 'unknown' END")
add("attempt_outcome", "attempts", "id", lambda: M.attempt_outcome(F.lit(None).cast("string"), F.col("success"), F.col("dish_count")), "CASE WHEN NOT success THEN 'error' WHEN dish_count IS NULL THEN NULL WHEN dish_count < 7 THEN 'thin' ELSE 'menu' END")
AS_OF = "timestamp '2024-03-10 00:00:00'"
add("cache_decision", "restaurants", "id", lambda: M.cache_decision(F.col("status"), F.col("last_scraped_at"), F.col("no_menu_reason"), F.col("no_menu_confirmed_at"), F.expr(AS_OF)), f"CASE WHEN status = 'done' AND last_scraped_at > {AS_OF} - interval '30' day THEN 'cached' WHEN status = 'no_menu' AND (no_menu_confirmed_at IS NOT NULL OR (no_menu_reason = 'not_listed' AND last_scraped_at > {AS_OF} - interval '30' day)) THEN 'no_menu' ELSE 'analyze' END")
add("is_fresh", "restaurants", "id", lambda: M.is_fresh(F.col("last_scraped_at"), F.expr(AS_OF)), f"coalesce(last_scraped_at > {AS_OF} - interval '30' day, false)")
add("is_billing_error", "attempts", "id", lambda: M.is_billing_error(F.concat(F.coalesce("error_message", F.lit("")), F.when(F.col("id") % 6 == 0, " API key missing").otherwise(""))), "id % 6 = 0")
add("is_access_denied", "attempts", "id", lambda: M.is_access_denied(F.when(F.col("id") % 3 == 0, 403).otherwise(200), F.when(F.col("id") % 7 == 0, "Request access").otherwise("x")), "CASE WHEN id % 7 = 0 THEN 'the file owner has restricted downloads' WHEN id % 3 = 0 THEN 'the host refused our request (HTTP 403)' END")
add("should_escalate", "attempts", "id", lambda: M.should_escalate(F.col("id") % 2 == 0, F.col("id") % 3 == 0, F.col("id") % 5 == 0, F.col("id") % 7 == 0, F.col("id") % 4, F.col("id") % 11 == 0), "id % 2 <> 0 AND id % 3 = 0 AND (id % 4 >= 1 OR id % 5 = 0 OR id % 11 = 0 OR id % 7 = 0)")
add("feedback_action", "feedback", "id", lambda: M.feedback_action(F.col("feedback_type")), "CASE feedback_type WHEN 'not_a_menu' THEN 'remove_menu' WHEN 'menu_outdated' THEN 'reparse' WHEN 'wrong_name' THEN 'rename' ELSE 'route' END")
add("status_badge", "restaurants", "id", lambda: M.status_badge(F.col("status")), "CASE status WHEN 'pending' THEN 'Queued' WHEN 'done' THEN 'Analyzed' WHEN 'no_menu' THEN 'No menu' WHEN 'error' THEN 'Error' ELSE status END")
add("ip_hash", "reports", "id", lambda: M.ip_hash(F.col("ip_hash"), F.lit("salt")), "left(sha256(ip_hash || 'salt'), 16)")
_pad = lambda x: b"secret".ljust(64, b"\0").translate(bytes(b ^ x for b in range(256))).hex()
add("vote_ip_hash", "reports", "id", lambda: M.vote_ip_hash(F.col("ip_hash"), "secret"), f"sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(ip_hash))))")
add("valid_anon_id", "attempts", "id", lambda: M.valid_anon_id(F.when(F.col("id") % 2 == 0, "123e4567-e89b-12d3-a456-426614174000").otherwise(F.col("anon_id"))), "CASE WHEN id % 2 = 0 THEN '123e4567-e89b-12d3-a456-426614174000' END")
add("area_code", "locations", "id", lambda: M.area_code(F.col("address")), "CASE WHEN id % 4 = 2 THEN 'D6W' WHEN id % 4 = 0 AND id % 26 IN (1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,20,22,24) THEN 'D' || lpad(cast(id % 26 AS varchar), 2, '0') WHEN id % 4 = 1 AND id % 10 > 0 THEN 'D0' || cast(id % 10 AS varchar) END")
add("address_key", "locations", "id", lambda: M.address_key(F.col("address")), "trim(regexp_replace(lower(strip_accents(address)), '[^a-z0-9]+', ' ', 'g'))")
add("address_equivalent", "locations", "id", lambda: M.address_equivalent(F.col("address"), F.concat(F.upper("address"), F.lit(" Ireland"))), "length(trim(regexp_replace(lower(address), '[^a-z0-9]+', ' ', 'g'))) >= 12")
add("address_usable", "locations", "id", lambda: M.address_usable(F.col("address")), "length(address) BETWEEN 8 AND 300")
add("in_city", "locations", "id", lambda: M.in_city(F.col("address"), F.lit(" dublin ")), "contains(lower(address), 'dublin')")
add("map_url_coords", "locations", "id", lambda: M.map_url_coords(F.concat(F.lit("https://maps.google.com/?q="), F.col("latitude").cast("string"), F.lit(",200")))["latitude"].isNull(), "true")

NONE = lambda: F.array().cast("array<string>")
add("is_thin_result", "attempts", "id", lambda: M.is_thin_result(F.lit("done"), F.col("dish_count")), "dish_count > 0 AND dish_count < 7")
add("menu_category", "attempts", "id", lambda: M.menu_category(F.when(F.col("id") % 3 == 0, F.array(F.lit("pdf"), F.lit("text"))).when(F.col("id") % 3 == 1, F.array(F.lit("subpage"))).otherwise(NONE())), "CASE id % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'js' ELSE 'text' END")
OPAQUE = f"({SLUG} = '' OR len(list_filter(string_split({SLUG}, ' '), lambda w: regexp_matches(w, '(?i)^[0-9a-f]{{6,}}$') OR regexp_matches(w, '^[0-9]+$'))) >= greatest(1, len(string_split({SLUG}, ' ')) - 1))"
add("branch_label", "urls", "page_id", lambda: U.branch_label(u()), f"CASE WHEN {OPAQUE} THEN '' ELSE {SLUG} END")
add("with_branch", "urls", "page_id", lambda: U.with_branch(F.lit("Greek"), U.url_hint(u())), f"CASE WHEN {SLUG} = '' THEN 'Greek' WHEN contains(lower({SLUG}), 'greek') THEN {SLUG} ELSE 'Greek — ' || {SLUG} END")
add("held_back_reason", "restaurants", "id", lambda: M.held_back_reason(F.col("status"), F.col("id") % 9, F.when(F.col("id") % 2 == 0, "flag")), "CASE WHEN status = 'error' THEN 'analysis errored' WHEN status = 'no_menu' THEN 'no menu found' WHEN status <> 'done' THEN status WHEN id % 9 = 1 THEN 'only 1 dish' WHEN id % 9 < 7 THEN 'only ' || cast(id % 9 AS varchar) || ' dishes' WHEN id % 2 = 0 THEN 'flag' ELSE 'held back for review' END")
add("visible_section", "menu_sections", "id", lambda: M.visible_section(F.col("menu_label"), F.lit("A"), F.lit(2)), "menu_label IS NULL OR menu_label = 'A'")
add("content_verdict", "docs", "doc_id", lambda: M.content_verdict(F.col("text"), NONE(), NONE(), F.lit(None).cast("string")), "CASE WHEN length(text) >= 100 THEN 'content' ELSE 'not_listed' END")
add("read_is_thin", "docs", "doc_id", lambda: M.read_is_thin(F.col("text"), NONE(), NONE(), NONE()), "length(text) < 600")
add("display_areas", "locations", "id", lambda: F.array_join(M.display_areas(F.array(F.when(F.col("id") % 2 == 0, F.col("confidence")), F.lit("")), F.when(F.col("id") % 3 == 0, F.col("city")), F.lit("D01")), ","), "CASE WHEN id % 2 = 0 THEN confidence WHEN id % 3 = 0 THEN city ELSE 'D01' END")
