"""Web pages: text, links and images read from html, then scored and ranked with expressions.

Reading html is a small helper over Arrow batches, a few pages at a time; what it gives is exploded and everything after is
Spark.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.text import text_is_english
from larder.functions.urls import raw_host, url_homepage_score, url_is_ordering_host, url_is_pdf, url_is_restaurant_site, url_path, url_path_english, url_same_page_key, url_same_site, url_segments

from .locations import page_locations  # noqa: F401

# Words of menu links, images and navigation.
LINK_WORDS = ["menu", "food", "eat", "dishes", "cuisine", "carte", "speisekarte", "kaart", "menukaart", "order", "lunch", "dinner", "brunch", "breakfast", "tasting", "specials", "sharing", "sunday", "à la carte", "a la carte", "a-la-carte", "set menu", "set-menu", "early bird", "early-bird", "pre-theatre", "pre theatre", "neighbourhood"]
IMAGE_WORDS = ["menu", "food", "carte", "speise", "dish", "notions"]
SKIP_IMAGES = r"logo|icon|favicon|avatar|banner|social|twitter|facebook|instagram"
PHOTO_WORDS = ["gallery", "hero", "slide", "carousel", "photo", "interior", "team", "staff", "event"]
GIFT_LINKS = r"\b(gift|giftcard|egift|voucher)"
NAV_BOOST = r"\b(restaurant|restaurants|dining|dine|food|eat|kitchen|cafe|bistro|venue|venues|location|locations)\b"
NAV_SKIP = r"\b(contact|about|gallery|book|booking|reservation|career|job|voucher|gift|privacy|terms|cookie|news|blog|press|event|faq|login|account|cart|checkout|shop|store|sitemap)\b"
ASSETS = r"\.(jpg|jpeg|png|gif|webp|svg|mp4)$"
HIDDEN = {"script", "style", "nav", "footer", "header", "noscript", "iframe"}


class _Page(HTMLParser):
    """Visible text, links, images and embeds of one page."""

    def __init__(self, keep_text: bool = True):
        super().__init__(convert_charrefs=True)
        self.keep_text = keep_text
        self.text, self.links, self.images, self.hidden, self.open = [], [], [], [], None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in HIDDEN:
            self.hidden.append(tag)
        if tag == "a" and "href" in a:
            self.open = {"kind": "a", "href": a["href"], "text": "", "title": a.get("title") or a.get("aria-label", ""), "lang": a.get("hreflang", "")}
            self.links.append(self.open)
        elif tag == "link" and a.get("hreflang"):
            self.links.append({"kind": "alternate", "href": a.get("href", ""), "text": "", "title": "", "lang": a["hreflang"]})
        elif tag in ("embed", "iframe", "object") and (a.get("src") or a.get("data")):
            self.links.append({"kind": "embed", "href": a.get("src") or a["data"], "text": "", "title": "", "lang": ""})
        elif tag == "img":
            src = a.get("data-src") or a.get("data-lazy-src") or a.get("data-original") or a.get("src")
            if src:
                number = lambda x: int(x) if x.isdigit() else 0
                self.images.append({"src": src, "alt": a.get("alt", "").lower(), "size": max(number(a.get("width", "")), number(a.get("height", "")))})

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = None
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]

    def handle_data(self, data):
        if self.open is not None:
            self.open["text"] += data
        if self.keep_text and not self.hidden:
            self.text.append(data)


def _absolute(href: str, base: str) -> str:
    try:
        return urljoin(base, href.strip())
    except ValueError:
        return ""


_LINK = pa.struct([("kind", pa.string()), ("href", pa.string()), ("url", pa.string()), ("text", pa.string()), ("lang", pa.string())])
_IMAGE = pa.struct([("url", pa.string()), ("alt", pa.string()), ("size", pa.int32())])
_SIGNALS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("links", pa.list_(_LINK)), ("images", pa.list_(_IMAGE))])


def _read(batches, most: int | None, text: bool):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                p = _Page(text)
                p.feed(html or "")
                links = [{"kind": x["kind"], "href": x["href"], "url": _absolute(x["href"], url or ""), "text": (" ".join(x["text"].split()) or x["title"].strip()), "lang": x["lang"]} for x in p.links]
                images = [{"url": _absolute(x["src"], url or ""), "alt": x["alt"], "size": x["size"]} for x in p.images]
                rows.append({"page_id": page_id, "url": url, "text": " ".join(" ".join(p.text).split())[:most] if text else None, "links": links, "images": images})
            yield pa.RecordBatch.from_pylist(rows, schema=_SIGNALS)


def page_signals(pages: DataFrame, most: int | None = None, text: bool = True) -> DataFrame:
    """(page_id, url, text, links, images) of every page; text whole, or its first `most` characters, or null where the job asks
    for links and images alone."""
    schema = "page_id bigint, url string, text string, links array<struct<kind:string,href:string,url:string,text:string,lang:string>>, images array<struct<url:string,alt:string,size:int>>"
    return pages.select("page_id", "url", "html").mapInArrow(lambda batches: _read(batches, most, text), schema)


def page_links(signals: DataFrame) -> DataFrame:
    """One row a link, in page order."""
    return signals.select("page_id", F.col("url").alias("page"), F.posexplode("links").alias("ord", "l")).select("page_id", "page", "ord", F.col("l.kind").alias("kind"), F.col("l.href").alias("href"), F.col("l.url").alias("url"), F.col("l.text").alias("text"), F.col("l.lang").alias("lang"))


def _hits(text: Column, words: list[str], points: int) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.when(text.contains(w), points).otherwise(0)
    return out


def _top(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The best `most` rows of each page, one of each key, in page order where they tie."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("page_id", key).orderBy(F.desc("score"), "ord"))).filter("_n = 1")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "ord"))).filter(F.col("rank") <= most).drop("_n")


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1))


def menu_links(links: DataFrame) -> DataFrame:
    """(page_id, kind html or pdf, url, score, rank, label): links that lead to menus, the best five pages and six PDFs."""
    low, text = F.lower("url"), F.lower("text")
    rows = links.filter(F.col("url").rlike("(?i)^https?://") & ~low.rlike(ASSETS) & (url_same_page_key(F.col("url")) != url_same_page_key(F.col("page"))) & ~low.rlike(GIFT_LINKS) & ~text.rlike(GIFT_LINKS))
    rows = rows.withColumns({"words": _hits(text, LINK_WORDS, 2) + _hits(low, LINK_WORDS, 3), "pdf": url_is_pdf(F.col("url")), "outside": origin(F.col("url")) != origin(F.col("page"))})
    pdf = rows.filter("pdf").withColumn("score", F.when(F.col("kind") == "embed", 5).when(F.col("words") > 0, F.col("words")).when(text.contains("download") | text.contains("pdf"), 1).otherwise(0))
    html = rows.filter("not pdf and kind = 'a'").filter(~F.col("outside") | url_is_ordering_host(F.col("url"))).withColumn("score", F.col("words") + F.when(F.col("outside"), 2).otherwise(0))
    out = None
    for kind, part, most in (("pdf", pdf, 6), ("html", html, 5)):
        one = _top(part.filter("score > 0"), F.col("url"), most).select("page_id", F.lit(kind).alias("kind"), "url", "score", "rank", F.when(F.length("text").between(1, 60), F.col("text")).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def nav_links(links: DataFrame, most: int = 8) -> DataFrame:
    """Links of the same site that may lead to a menu: shallow ones first, food words before others."""
    slug, text = F.lower(F.coalesce(url_path(F.col("url")), F.lit(""))), F.lower("text")
    rows = links.filter((F.col("kind") == "a") & (origin(F.col("url")) == origin(F.col("page"))) & ~F.lower("url").rlike(ASSETS) & ~slug.isin("", "/") & (url_same_page_key(F.col("url")) != url_same_page_key(F.col("page"))) & ~slug.rlike(NAV_SKIP) & ~text.rlike(NAV_SKIP))
    depth = F.size(url_segments(F.col("url")))
    scored = rows.withColumn("score", F.when(depth <= 1, 3).when(depth == 2, 1).otherwise(0) + F.when(slug.rlike(NAV_BOOST) | text.rlike(NAV_BOOST), 5).otherwise(0))
    return _top(scored, F.regexp_replace(F.regexp_replace("url", r"[#?].*$", ""), "/$", ""), most).select("page_id", "url", "score", "rank")


def menu_images(signals: DataFrame, most: int = 3) -> DataFrame:
    rows = signals.select("page_id", F.posexplode("images").alias("ord", "i")).select("page_id", "ord", F.col("i.url").alias("url"), F.col("i.alt").alias("alt"), F.col("i.size").alias("size"))
    low = F.lower("url")
    rows = rows.filter(F.col("url").startswith("http") & ~low.rlike(SKIP_IMAGES) & ~F.col("alt").rlike(SKIP_IMAGES) & ~low.contains(".gif") & ~low.contains(".svg"))
    photo = F.lit(0)
    for w in PHOTO_WORDS:
        photo = photo - F.when(low.contains(w) | F.col("alt").contains(w), 5).otherwise(0)
    scored = rows.withColumn("score", F.lit(1) + _hits(low, IMAGE_WORDS, 10) + _hits(F.col("alt"), IMAGE_WORDS, 5) + photo + F.when(F.col("size") > 400, 2).otherwise(0))
    return _top(scored, F.substring_index("url", "?", 1), most).select("page_id", F.substring_index("url", "?", 1).alias("url"), "score", "rank")


def english_variants(signals: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, variant): of pages not in English, the first alternate in English, else the first link to an English path. The
    whole text is judged, or its first `most` characters."""
    other = signals.filter(~text_is_english(F.col("text"), most))
    links = page_links(other).filter(url_same_site(F.col("url"), F.col("page")) & (url_same_page_key(F.col("url")) != url_same_page_key(F.col("page"))))
    level = F.when(F.lower("lang").startswith("en"), 0).when((F.col("kind") == "a") & (url_path_english(F.col("url")) | F.lower(F.trim("text")).isin("en", "eng", "english")), 1)
    return links.withColumn("level", level).filter("level is not null").groupBy("page_id").agg(F.min(F.struct("level", "ord", "url")).getField("url").alias("variant"))


# Where listing pages keep a place's own site: fields by name, and first places of lists; slashes unescaped.
_URL = r'"(https?://[^"\\]+)"'
SITE_FIELDS = [
    r'website_uri[^"]{0,30}' + _URL,
    r'"website"\s*:\s*' + _URL,
    r'"primaryUrl"\s*:\s*' + _URL,
    r"\[" + _URL + ",null,null,null",
    r"\[" + _URL + r",null,null\]",
    r"externalLinks[^\[]{0,50}\[" + _URL,
]
QUOTED_URLS = [r'"(https?://[^"\\]{5,300})"', r"\\x22(https?://[^\\]{5,300})\\x22", r"\\u0022(https?://[^\\]{5,300})\\u0022"]


def homepage_urls(pages: DataFrame, not_these: list[str] | None = None) -> DataFrame:
    """(page_id, homepage, keyed): a place's own site in a listing page, and whether a field says so.

    The first match of each field is asked in order; failing all, the likeliest of the urls in quotes, plain ones before those
    whose quotes are escaped, earlier before later where scores tie. Only urls that can be a place's own site count, and none that
    holds one of `not_these`.
    """
    flat = pages.select("page_id", F.replace("html", F.lit("\\/"), F.lit("/")).alias("html"))
    own = lambda urls: F.filter(urls, lambda u: (u != "") & url_is_restaurant_site(u, not_these))
    fields = own(F.array(*(F.regexp_extract("html", p, 1) for p in SITE_FIELDS)))
    told = flat.select("page_id", "html", F.get(fields, F.lit(0)).alias("field"))
    keyed = told.filter("field is not null").select("page_id", F.col("field").alias("homepage"), F.lit(True).alias("keyed"))
    quoted = F.concat(*(F.regexp_extract_all("html", F.lit(p), 1) for p in QUOTED_URLS))
    others = told.filter("field is null").select("page_id", F.posexplode(F.array_distinct(quoted)).alias("ord", "url")).filter(url_is_restaurant_site(F.col("url"), not_these))
    best = others.withColumn("score", url_homepage_score(F.col("url"))).groupBy("page_id").agg(F.max_by("url", F.struct("score", -F.col("ord"))).alias("homepage"))
    return keyed.unionByName(best.withColumn("keyed", F.lit(False)))


def external_sites(links: DataFrame) -> DataFrame:
    """(page_id, site): the first link of a review page to another, non-social site."""
    social = r"google\.com|facebook\.com|instagram\.com|twitter\.com|yelp\.com|tripadvisor\.com"
    out = links.filter((F.col("kind") == "a") & F.col("url").startswith("http") & (raw_host(F.col("url")) != raw_host(F.col("page"))) & ~F.col("url").rlike(social))
    return out.groupBy("page_id").agg(F.min_by("url", "ord").alias("site"))


def contact_links(links: DataFrame, most: int = 3) -> DataFrame:
    """Links of the same host that say contact, location or about; contact before about."""
    label = F.lower(F.concat_ws(" ", "text", "href"))
    host = lambda c: F.regexp_replace(raw_host(F.col(c)), r"^www\.", "")
    rows = links.filter((F.col("kind") == "a") & label.rlike(r"contact|about|find[-_ ]?us|location|visit[-_ ]?us") & (host("url") == host("page")))
    return _top(rows.withColumn("score", F.when(label.rlike(r"contact|find[-_ ]?us|location|visit[-_ ]?us"), 1).otherwise(0)), F.col("url"), most).select("page_id", "url", "rank")


def first_labels(links: DataFrame) -> DataFrame:
    """(page_id, url, label): the first text of at most 60 characters of each linked url."""
    rows = links.filter((F.col("kind") == "a") & F.length("text").between(1, 60))
    return rows.groupBy("page_id", "url").agg(F.min_by("text", "ord").alias("label"))
