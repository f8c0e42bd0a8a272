"""Telemetry, status, cost and location functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ACCENTED, PLAIN

# Messages and their stable codes; the first pattern that matches decides.
ERROR_PATTERNS = [
    (r"rate limit|too many requests|slow down", "rate_limited"),
    (r"connection dropped|no response body|stream closed", "connection_dropped"),
    (r"taking much longer|timed? ?out|took longer than expected", "timeout"),
    (r"invalid url|invalid request|enter a valid|must be a valid", "invalid_url"),
    (r"not found|does ?n['’]?o?t exist|was removed", "not_found"),
    (r"could ?n['’]?o?t (read|find) a [\w ]*menu|no menu|unreadable|not publish one", "no_menu_readable"),
    (r"down or not live|looks like it'?s down", "site_unreachable"),
    (r"failed to fetch|network ?error|load failed|econnrefused|enotfound", "network"),
    (r"unreachable|refused|dns|certificate|ssl|tls", "site_unreachable"),
    (r"^(internal )?server error|^5\d\d\b", "server_error"),
]
BILLING = r"credit balance|billing|purchase credits|usage limit|authentication_error|invalid x-api-key|api key"
RESTRICTED = r"hasn't given you permission|only the owner and editors|request access|sign in to continue"
# What a confirmed report leads to, and the postal areas of the city.
FEEDBACK_ACTIONS = {"wrong_classification": "reclassify", "not_a_dish": "remove_dish", "dish_removed": "remove_dish", "duplicate_dish": "remove_dish", "hidden_ingredient": "route", "incorrect_info": "route", "not_a_menu": "remove_menu", "missing_menu": "route", "menu_no_dishes": "reparse", "menu_outdated": "reparse", "missing_dish": "route", "wrong_name": "rename", "wrong_menu": "route", "feature_request": "route", "other": "route"}
POSTAL_AREAS = ["D01", "D02", "D03", "D04", "D05", "D06", "D6W", "D07", "D08", "D09", "D10", "D11", "D12", "D13", "D14", "D15", "D16", "D17", "D18", "D20", "D22", "D24"]
#: Fewer dishes than this are thin; days until an analysis is stale; reports until a dish is flagged.
MIN_DISHES, STALE_DAYS, FLAG_REPORTS = 7, 30, 3
CONFIDENCE = {"low": 1, "medium": 2, "high": 3}


def error_code(message: Column) -> Column:
    out = F.lit("unknown")
    for pattern, code in reversed(ERROR_PATTERNS):
        out = F.when(message.rlike(f"(?i){pattern}"), code).otherwise(out)
    return out


def attempt_outcome(explicit: Column, success: Column, dish_count: Column) -> Column:
    return F.coalesce(explicit, F.when(~success, "error").when(dish_count.isNull(), F.lit(None)).when(dish_count < MIN_DISHES, "thin").otherwise("menu"))


def is_thin_result(status: Column, dishes: Column) -> Column:
    return (status == "done") & (dishes > 0) & (dishes < MIN_DISHES)


def is_fresh(scraped_at: Column, as_of: Column) -> Column:
    return F.coalesce(scraped_at > as_of - F.expr(f"INTERVAL '{STALE_DAYS}' DAY"), F.lit(False))


def cache_decision(status: Column, scraped_at: Column, reason: Column, confirmed_at: Column, as_of: Column) -> Column:
    fresh = is_fresh(scraped_at, as_of)
    nothing = (status == "no_menu") & (confirmed_at.isNotNull() | (F.coalesce(reason == "not_listed", F.lit(False)) & fresh))
    return F.when((status == "done") & fresh, "cached").when(nothing, "no_menu").otherwise("analyze")


def usage_cost(tokens_in: Column, tokens_out: Column, cache_write: Column, cache_read: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are per million tokens; cached input counts 1.25 times to write and 0.1 times to read."""
    cached = F.round(cache_write * F.lit(1.25).cast("decimal(4,2)") + cache_read * F.lit(0.1).cast("decimal(4,2)"))
    return (tokens_in * price_in + tokens_out * price_out + cached * price_in) / 1_000_000


def is_billing_error(message: Column) -> Column:
    return F.coalesce(message.rlike(f"(?i){BILLING}"), F.lit(False))


def is_access_denied(status: Column, text: Column) -> Column:
    return F.when(text.rlike(f"(?i){RESTRICTED}"), "the file owner has restricted downloads").when(status.isin(401, 403), F.concat(F.lit("the host refused our request (HTTP "), status.cast("string"), F.lit(")")))


def should_escalate(blocked: Column, billed: Column, malfunction: Column, visual: Column, best_items: Column, menu_like: Column) -> Column:
    return ~blocked & billed & ((best_items >= 1) | malfunction | menu_like | visual)


def content_verdict(text: Column, pdfs: Column, images: Column, screenshot: Column) -> Column:
    """`content`, or `not_listed` where a page has nothing to read."""
    any_of = (F.length(F.coalesce(text, F.lit(""))) >= 100) | (F.coalesce(F.size(pdfs), F.lit(0)) > 0) | (F.coalesce(F.size(images), F.lit(0)) > 0) | screenshot.isNotNull()
    return F.when(any_of, "content").otherwise("not_listed")


def visible_section(label: Column, chosen: Column, labels: Column) -> Column:
    return (labels <= 1) | chosen.isNull() | label.isNull() | (label == chosen)


def read_is_thin(markdown: Column, pdfs: Column, images: Column, links: Column) -> Column:
    return (F.size(pdfs) == 0) & (F.size(images) == 0) & (F.length(markdown) < 600) & (F.size(links) < 5)


def menu_category(types: Column) -> Column:
    first = F.try_element_at(types, F.lit(1))
    return F.when(F.size(types) > 1, "multi").when(first.isin("pdf", "image"), first).when(first == "subpage", "js").otherwise("text")


def feedback_action(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in FEEDBACK_ACTIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit("route"))


def status_badge(status: Column) -> Column:
    return F.when(status == "pending", "Queued").when(status == "processing", "Interrupted").when(status == "done", "Analyzed").when(status == "no_menu", "No menu").when(status == "error", "Error").otherwise(status)


def held_back_reason(status: Column, dishes: Column, flag_detail: Column) -> Column:
    few = F.concat(F.lit("only "), dishes.cast("string"), F.when(dishes == 1, " dish").otherwise(" dishes"))
    return F.when(status == "error", "analysis errored").when(status == "no_menu", "no menu found").when(status != "done", status).when(dishes < MIN_DISHES, few).otherwise(F.coalesce(flag_detail, F.lit("held back for review")))


def ip_hash(ip: Column, salt: Column) -> Column:
    return F.left(F.sha2(F.concat(ip, salt), 256), F.lit(16))


def vote_ip_hash(ip: Column, secret: str) -> Column:
    """HMAC-SHA256 of the address, in hexadecimal, from two nested digests."""
    import hashlib

    key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
    key = key.ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), ip.cast("binary")), 256))), 256)


def valid_anon_id(anon_id: Column) -> Column:
    return F.when(anon_id.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), anon_id)


def display_areas(branch_areas: Column, neighbourhood: Column, area_code: Column) -> Column:
    own = F.filter(F.array_distinct(branch_areas), lambda a: a.isNotNull() & (a != ""))
    return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.array_compact(F.array(F.coalesce(neighbourhood, area_code))))


def area_code(address: Column) -> Column:
    """Postal area from a routing key before a four-character unit, else from `Dublin n`; null if it is none of the areas."""
    key = F.regexp_extract(F.upper(address), r"\b(D(?:0[1-9]|1\d|2[0-4])|D6W)(?=\s*[A-Z0-9]{4}\b)", 1)
    district = F.upper(F.regexp_extract(address, r"(?i)\bDUBLIN[\s,]*(\d{1,2}|6W)\b", 1))
    from_district = F.when(district == "6W", "D6W").when(district != "", F.concat(F.lit("D"), F.lpad(district, 2, "0")))
    return F.coalesce(F.when(key.isin(POSTAL_AREAS), key), F.when(from_district.isin(POSTAL_AREAS), from_district))


def address_key(address: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(F.regexp_replace(address, "[̀-ͯ]", ""), ACCENTED, PLAIN)), "[^a-z0-9]+", " "))


def address_equivalent(a: Column, b: Column) -> Column:
    """Equal keys, or one of at least 12 characters that begins or ends the other at a word's edge."""
    x, y = address_key(a), address_key(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (x == y) | ((F.length(short) >= 12) & (long.startswith(F.concat(short, F.lit(" "))) | long.endswith(F.concat(F.lit(" "), short))))


def address_usable(address: Column) -> Column:
    text = F.trim(F.regexp_replace(address, r"\s+", " "))
    return F.length(text).between(8, 300) & text.rlike(r"\d") & text.rlike("[A-Za-z]{2}")


def in_city(address: Column, city: Column) -> Column:
    return (address == "") | F.lower(address).contains(F.lower(F.trim(city)))


def map_url_coords(url: Column) -> Column:
    """struct<latitude, longitude, address> of a map link: `@lat,lng`, or a q, query or destination value."""
    number = r"(-?\d+(?:\.\d+)?)"
    at = lambda g: F.regexp_extract(url, rf"@{number},{number}", g).try_cast("double")
    value = F.trim(F.coalesce(F.try_url_decode(F.coalesce(F.nullif(F.regexp_extract(url, r"[?&](?:q|query|destination)=([^&#]*)", 1), F.lit("")), F.lit(""))), F.lit("")))
    pair = lambda g: F.regexp_extract(value, rf"^\s*{number}\s*,\s*{number}\s*$", g).try_cast("double")
    lat, lng = F.coalesce(at(1), pair(1)), F.coalesce(at(2), pair(2))
    ok = (F.abs(lat) <= 90) & (F.abs(lng) <= 180)
    address = F.when(lat.isNull() & (value != ""), value)
    return F.struct(F.when(ok, lat).alias("latitude"), F.when(ok, lng).alias("longitude"), address.alias("address"))


def content_kind(content: Column) -> Column:
    """pdf, jpeg, png, gif or webp by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("25504446"), "application/pdf")
        .when(F.length(content) < 12, F.lit(None))
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("474946"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def point_in_rings(latitude: Column, longitude: Column, rings: Column) -> Column:
    """Even-odd ray casting over array<array<struct<longitude, latitude>>>; holes are rings like any other."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)

        def crosses(i: Column) -> Column:
            a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
            straddles = (a["latitude"] > latitude) != (b["latitude"] > latitude)
            x = F.try_divide((b["longitude"] - a["longitude"]) * (latitude - a["latitude"]), b["latitude"] - a["latitude"]) + a["longitude"]
            return F.when(straddles & (longitude < x), 1).otherwise(0)

        return F.when(n > 0, F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), crosses), F.lit(0), lambda s, x: s + x)).otherwise(0)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, x: s + x) % 2 == 1
