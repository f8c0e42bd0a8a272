"""URL functions: Column in, Column out. A url that has no host gives null (or false), never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that many businesses share, hosted ordering platforms, review sites.
SHARED_PLATFORMS = r"(^|\.)(toasttab\.com|square\.site|mryum\.com|bopple\.com|storekit\.com|flipdish\.[a-z.]+|google\.[a-z.]+|goo\.gl|instagram\.com|facebook\.com|fb\.com|yelp\.[a-z.]+|tripadvisor\.[a-z.]+|linktr\.ee|linktree\.[a-z.]+)$"
ORDERING_HOSTS = r"(^|\.)((order|orders|ordering)\.[a-z0-9-]+\.[a-z]{2,}|toasttab\.com|square\.site|mryum\.com|bopple\.com|storekit\.com|flipdish\.[a-z.]+)$"
REVIEW_SITES = ["yelp.com", "tripadvisor.com", "zomato.com", "opentable.com", "thefork.com"]
# Sites that are never a restaurant's own.
OTHER_SITES = [
    "google.com", "google.ie", "google.co.uk", "googleapis.com", "goo.gl", "googletagmanager.com", "googleusercontent.com", "googlevideo.com", "doubleclick.net", "ggpht.com", "maps.app",
    "youtube.com", "facebook.com", "fb.com", "instagram.com", "twitter.com", "x.com", "linkedin.com", "tiktok.com", "pinterest.com", "snapchat.com",
    "apple.com", "microsoft.com", "amazon.com", "cloudflare.com", "schema.org", "w3.org", "openstreetmap.org", "w3schools.com",
    "yelp.com", "tripadvisor.com", "zomato.com", "opentable.com", "thefork.com", "happycow.net", "foursquare.com", "lovin.ie", "timeout.com",
    "deliveroo.", "ubereats.com", "just-eat.", "doordash.com", "grubhub.com", "seamless.com", "menulog.", "hungryhouse.", "wolt.com", "bolt.eu", "flipdish.",
    "resdiary.com", "resdiary.net", "quandoo.com", "bookatable.com", "sevenrooms.com", "resy.com", "booking.com", "toasttab.com", "tock.com", "eatwith.com", "diningout.ie",
    "order.bar", "bopple.com", "square.site", "squareup.com", "linktr.ee", "linktree.com", "beacons.ai", "bio.site", "campsite.bio",
]
# File endings that are no page; words of a list of branches; language markers of a path.
ASSET_ENDINGS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".css", ".js", ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".mp3"]
BRANCH_WORDS = r"\b(location|locations|venue|venues|restaurants|branches|find[-\s]?us|our[-\s]?places)\b"
LANGUAGES = "en|eng|english|nl|de|fr|es|it|pt|da|sv|no|fi|pl|zh|zh-hans|ja"
_LANG_SEGMENT = rf"(?i)/({LANGUAGES})(/|$)"


def _any(patterns: list[str]) -> str:
    return "|".join(p.replace(".", r"\.") for p in patterns)


def scheme_rest(url: Column) -> Column:
    """What follows `scheme://`, scheme being http or https; empty otherwise."""
    return F.regexp_extract(url, r"(?is)^\s*https?://+(.*)$", 1)


def raw_host(url: Column) -> Column:
    """Lower-case host of an absolute http url; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"(?i)^\s*https?://+(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    return F.when(raw_host(url).isNotNull(), F.regexp_extract(url, r"(?i)^\s*https?://+[^/?#]+([^?#]*)", 1))


def url_segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(url_path(url), F.lit("")), "/"), lambda s: s != "")


def url_normalize(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?:/+(www\.)?", ""), r"/+$", "")


def url_host(url: Column) -> Column:
    """Host without `www.`; https is assumed where no scheme is given."""
    text = F.trim(url)
    return F.regexp_replace(raw_host(F.when(text.rlike(r"(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))), r"^www\.", "")


def host_is_shared(host: Column) -> Column:
    return host.rlike(r"^(order|orders|ordering)\.") | host.rlike(SHARED_PLATFORMS)


def url_is_shared_platform(url: Column) -> Column:
    return F.coalesce(host_is_shared(url_host(url)), F.lit(False))


def url_dedup_key(url: Column) -> Column:
    host = url_host(url)
    return F.when(host.isNull() | host_is_shared(host), url_normalize(url)).otherwise(host)


def url_canonical(url: Column) -> Column:
    host = url_host(url)
    return F.when(host.isNull() | host_is_shared(host), F.trim(url)).otherwise(F.concat(F.lit("https://"), host))


def url_domain(url: Column) -> Column:
    return F.regexp_replace(raw_host(url), r"^www\.", "")


def url_looks_like(text: Column) -> Column:
    """A url or bare domain: one token whose host has a dot."""
    return F.coalesce(url_host(text).contains(".") & ~F.trim(text).rlike(r"\s"), F.lit(False))


def url_type(url: Column) -> Column:
    low = F.lower(url)
    has = lambda *parts: low.rlike(_any(list(parts)))
    return (
        F.when(low.endswith(".pdf") | has("/pdf/", "menu.pdf"), "pdf")
        .when(has("maps.google", "maps.app.goo", "goo.gl/maps"), "google_maps")
        .when(has("instagram.com", "facebook.com", "twitter.com", "tiktok.com"), "social")
        .otherwise("html")
    )


def url_is_review_site(url: Column) -> Column:
    return F.lower(url).rlike(_any(REVIEW_SITES))


def url_is_pdf(url: Column) -> Column:
    low = F.lower(url)
    bare = F.substring_index(low, "?", 1)
    return bare.endswith(".pdf") | bare.contains("/pdf/") | low.rlike(_any([".pdf", "issuu.com", "drive.google.com/file", "flipbook", "format=pdf"]))


def url_is_ordering_host(url: Column) -> Column:
    return F.coalesce(raw_host(url).rlike(ORDERING_HOSTS), F.lit(False))


def url_is_restaurant_site(url: Column, more: list[str] | None = None) -> Column:
    own = raw_host(url).contains(".") & ~F.lower(url).rlike(_any(OTHER_SITES + (more or []))) & (F.length(url) <= 300)
    return F.coalesce(own & ~F.lower(url_path(url)).rlike("(" + _any(ASSET_ENDINGS) + ")$"), F.lit(False))


def url_homepage_score(url: Column) -> Column:
    """100 for a bare site, less for depth, query, fragment and length; -999 for what is no url."""
    rest = F.substring_index(url, "#", 1)
    score = F.lit(100) - 20 * F.size(url_segments(url)) - F.when(rest.rlike(r"\?."), 40).otherwise(0) - F.when(url.rlike("#."), 10).otherwise(0) - F.floor(F.length(url) / 15)
    return F.when(raw_host(url).isNotNull(), score.cast("int")).otherwise(F.lit(-999))


def url_same_page_key(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "(?s)#.*$", ""), "/$", "")


def url_base_domain(url: Column) -> Column:
    """Last two labels of the host."""
    return F.substring_index(raw_host(url), ".", -2)


def url_same_site(a: Column, b: Column) -> Column:
    return F.coalesce(url_base_domain(a) == url_base_domain(b), F.lit(False))


def url_path_english(url: Column) -> Column:
    tail = F.lower(F.regexp_extract(url, r"(?i)^https?://+[^/?#]+([^#]*)", 1))
    return tail.rlike(r"(^|/)(en|eng|english|en[-_][a-z]{2})(/|$)") | tail.rlike(r"[?&](lang|language|locale|hl|l|taal|idioma|sprache)=(en|eng|english)(\b|-|_)")


def url_lang(url: Column) -> Column:
    """The first language marker of the path, lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, _LANG_SEGMENT, 1)), F.lit(""))


def url_lang_key(url: Column) -> Column:
    """The url with its first language marker replaced by `*`; null without one."""
    return F.when(url.rlike(_LANG_SEGMENT), F.regexp_replace(url, rf"(?is)^(.*?)/(?:{LANGUAGES})(/|$)", "$1/*$2"))


def url_hint(url: Column) -> Column:
    """Words of the last path segment, without its file ending."""
    last = F.coalesce(F.try_element_at(url_segments(url), F.lit(-1)), F.lit(""))
    text = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)\.(pdf|jpe?g|png|webp|html?)$", ""), "[-_]+", " "))


def hint_is_opaque(hint: Column) -> Column:
    """Nothing, or at most one word that is neither a number nor a hexadecimal name."""
    words = F.split(hint, r"\s+")
    coded = F.size(F.filter(words, lambda w: w.rlike(r"(?i)^[0-9a-f]{6,}$") | w.rlike(r"^\d+$")))
    return F.coalesce(hint == "", F.lit(True)) | (coded >= F.greatest(F.lit(1), F.size(words) - 1))


def url_is_branch(url: Column) -> Column:
    segments = url_segments(url)
    return (F.size(segments) >= 2) & F.exists(segments, lambda s: F.lower(s).rlike(BRANCH_WORDS))


def branch_label(url: Column) -> Column:
    hint = url_hint(url)
    return F.when(hint_is_opaque(hint), "").otherwise(hint)


def with_branch(label: Column, hint: Column) -> Column:
    return F.when(label == "", hint).when(hint == "", label).when(F.lower(hint).contains(F.lower(label)), hint).otherwise(F.concat(label, F.lit(" — "), hint))


def doc_url_candidates(url: Column) -> Column:
    """Addresses to try for a shared document, best first."""
    drive = F.when(
        raw_host(url).isin("drive.google.com", "docs.google.com"),
        F.coalesce(F.nullif(F.regexp_extract(url, r"/d/([A-Za-z0-9_-]{10,})", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]{10,})", 1), F.lit(""))),
    )
    dropbox = F.when(raw_host(url).rlike(r"(^|\.)dropbox\.com$"), F.when(url.rlike(r"[?&]dl=\d"), F.regexp_replace(url, r"([?&])dl=\d", "$1dl=1")).otherwise(F.concat(url, F.when(url.contains("?"), "&dl=1").otherwise("?dl=1"))))
    return (
        F.when(drive.isNotNull(), F.array(F.concat(F.lit("https://drive.usercontent.google.com/download?id="), drive, F.lit("&export=download&confirm=t")), F.concat(F.lit("https://drive.google.com/uc?export=download&id="), drive)))
        .when(dropbox.isNotNull(), F.array(dropbox))
        .otherwise(F.array(url))
    )


def doc_filename(url: Column) -> Column:
    clean = F.right(F.regexp_replace(F.coalesce(F.try_element_at(url_segments(url), F.lit(-1)), F.lit("")), r"[^A-Za-z0-9_.-]", ""), F.lit(80))
    return F.when(clean == "", "menu.pdf").when(F.lower(clean).endswith(".pdf"), clean).otherwise(F.concat(clean, F.lit(".pdf")))


def candidate_id(kind: Column, ref: Column) -> Column:
    """FNV-1a, 32 bits, of `kind|ref`, eight hexadecimal digits. For ids that must stay as they were; jobs use xxhash64."""
    codes = F.transform(F.split(F.concat(kind, F.lit("|"), ref), ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda a, c: F.when(c == 0, a).otherwise((a.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295))))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def arrival_source(ref: Column, referrer_path: Column) -> Column:
    """share, search, guide or direct. referrer_path: path of a same-site referrer, else null."""
    return F.when(ref == "share", "share").when(referrer_path == "/", "search").when(referrer_path.rlike(r"(?i)^/[a-z0-9-]+/?$"), "guide").otherwise("direct")


def link_kind(url: Column) -> Column:
    low = F.substring_index(F.lower(url), "?", 1)
    return F.when(low.endswith(".pdf") | low.contains("/pdf/") | low.contains("menu.pdf"), "pdf").when(low.rlike(r"\.(jpe?g|png|webp)$"), "image").otherwise("other")
