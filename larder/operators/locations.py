"""Addresses that pages publish: structured data, address elements, visible blocks and map links, merged page by page.

A helper reads html into blocks: each element that may hold an address, with its text, its own and its parent's names and what
surrounds it. Everything after that is column expressions: contact details are cut, evidence is looked for, the address is cut
at its end, and candidates of a page are merged as those of a restaurant are.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larder.functions.misc import map_url_coords

from .geo import loc_dedupe

# Words of streets, cities and business types, the shapes of postal codes.
STREETS = ["street", r"st\.?", "road", r"rd\.?", "row", "court", "square", "quay", "lane", "place", "terrace", "buildings?", "avenue", "boulevard", "straat", "gracht", "kade", "plein", "weg", "dijk", "markt", "rue", "quai", "via", "viale", "piazza", "calle", "carrer", "paseo", "platz", "strasse", "straße", "chaussee", "chaussée", "rua", "travessa"]
CITIES = ["Dublin", "Amsterdam", "London", "Westport"]
BUSINESS = ["restaurant", "foodestablishment", "localbusiness", "cafeorcoffeeshop", "barorpub"]
EIRCODE = r"(?:D(?:0[1-9]|1\d|2[0-4])|D6W)\s*(?=[A-Z0-9]{4}(?!\w))(?=[A-Z0-9]*[A-Z])[A-Z0-9]{4}"
DUTCH_CODE = r"\d{4}\s?[A-Z]{2}"
MAPS = r"google\.[^/]+/maps|maps\.app\.goo\.gl|openstreetmap\.org|/maps\b"

_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"  # of ASCII words, whatever the runtime takes for one
_STREET = "(?:" + "|".join(STREETS) + ")"
_HOUSE = r"\d+[A-Z]?(?:[-/]\d+[A-Z]?)?"
_ANY_STREET = f"(?i){_EDGE}{_STREET}{_EDGE}"
_NUMBERED_STREET = rf"(?i){_EDGE}{_HOUSE}(?:\s+[^\s,]+){{0,6}}\s+{_STREET}{_EDGE}"
# what is no house's number: a telephone number behind a plus, decimals and the like, long numbers of cards and accounts
_NO_HOUSE = r"\+\d[\d\s().-]*|\d+(?:\.\d+)+|\d{10,}"
_CITY = rf"(?i){_EDGE}(?:{CITIES[0]}(?:\s+\d{{1,2}})?|{'|'.join(CITIES[1:])}){_EDGE}"

# telephone and mail: what follows their labels, and a number or address in front
_LABELLED = re.compile(r"\b(?:phone|tel(?:ephone)?|email)\b.*", re.ASCII | re.IGNORECASE | re.DOTALL)
_NUMBER = re.compile(r"\+?\d[\d\s().-]{5,}\s*", re.ASCII)
_MAIL = re.compile(r"[\w.+-]+@[\w.-]+\.[A-Z]{2,}\s*", re.ASCII | re.IGNORECASE)

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_HOLDERS = {"address", "p", "li", "h1", "h2", "h3", "h4", "h5", "h6"}
_SILENT = {"script", "style", "svg"}


class _Blocks(HTMLParser):
    """Elements that may hold an address, in page order, with map links and structured data."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.parts, self.rows, self.breaks, self.silent, self.data = [], [], [], 0, 0, None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("iframe", "a") and (a.get("src") or a.get("href")):
            self.rows.append({"kind": "map", "text": a.get("src") or a["href"]})
        if tag in _ENDS_P:
            self._close("p")
        if tag == "li":
            self._close("li", {"ul", "ol"})
        if tag == "br":
            self.breaks += 1
            self.parts.append(" ")
        if tag in _VOID:
            return
        names = f"{a.get('class', '')} {a.get('id', '')}"
        row = None
        if tag in _HOLDERS or "address" in names or "Address" in names or a.get("itemprop") == "address":
            parent = self.open[-1]["attrs"] if self.open else {}
            own = " ".join(a[k] for k in ("class", "id", "itemprop", "aria-label") if a.get(k))
            around = " ".join(parent[k] for k in ("class", "id") if parent.get(k))
            footer = tag == "footer" or any(x["tag"] == "footer" for x in self.open)
            row = {"kind": "block", "names": own, "around": f"{own} {around} footer" if footer else f"{own} {around}", "element": tag == "address"}
            self.rows.append(row)
        self.open.append({"tag": tag, "attrs": a, "from": len(self.parts), "breaks": self.breaks, "row": row})
        if tag in _SILENT:
            self.silent += 1
            self.data = [] if tag == "script" and a.get("type") == "application/ld+json" else None

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if self.data is not None:
            self.data.append(data)
        elif not self.silent:
            self.parts.append(data)

    def _close(self, tag, within=()):
        """Ends the last open element of that name, and what is open inside it."""
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i]["tag"] == tag or self.open[i]["tag"] in within), None)
        if at is None or self.open[at]["tag"] != tag:
            return
        while len(self.open) > at:
            x = self.open.pop()
            if x["row"] is not None:
                x["row"] |= {"text": " ".join("".join(self.parts[x["from"] :]).split()), "broken": self.breaks > x["breaks"]}
            if x["tag"] in _SILENT:
                self.silent -= 1
                if self.data is not None:
                    self.rows += _structured("".join(self.data))
                    self.data = None

    def read(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        while self.open:
            self._close(self.open[-1]["tag"])
        return self.rows


def _is_telephone(number: str) -> bool:
    """Of 7 digits or more in parts, or behind a + or 0; a number in one piece that is neither is a house's up to 9 digits."""
    return number[0] in "+0" or sum(c.isdigit() for c in number) >= (10 if number.isdigit() else 7)


def _without_contacts(text: str) -> str:
    text = _LABELLED.sub("", text, count=1)
    for at_start in (_NUMBER, _MAIL):
        found = at_start.match(text)
        if found and (at_start is _MAIL or _is_telephone(found[0].strip())):
            text = text[found.end() :]
    return text.strip()


def _compact(value) -> str:
    return " ".join(value.split()) if isinstance(value, str) else ""


def _degrees(value) -> float | None:
    try:
        return float(value) if isinstance(value, (int, float, str)) and not isinstance(value, bool) else None
    except ValueError:
        return None


def _structured(text: str) -> list[dict]:
    """Addresses of businesses in a piece of JSON-LD, an item before those nested in its graph."""
    try:
        todo = [json.loads(text)]
    except (ValueError, RecursionError):
        return []
    out = []
    while todo:
        item = todo.pop(0)
        if isinstance(item, list):
            todo = item + todo
        if not isinstance(item, dict):
            continue
        graph = item.get("@graph")
        todo = (graph if isinstance(graph, list) else []) + todo
        kinds = item.get("@type")
        if not any(isinstance(k, str) and any(b in k.lower() for b in BUSINESS) for k in (kinds if isinstance(kinds, list) else [kinds])):
            continue
        where = item.get("address")
        if isinstance(where, dict):
            named = [_compact(where.get(k)) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
            where = ", ".join(x for x in named if x)
        geo = item.get("geo") if isinstance(item.get("geo"), dict) else {}
        if _compact(where):
            out.append({"kind": "jsonld", "text": _compact(where), "label": _compact(item.get("name")) or None, "latitude": _degrees(geo.get("latitude")), "longitude": _degrees(geo.get("longitude"))})
    return out


_BLOCK = pa.schema(
    [
        ("page_id", pa.int64()), ("ord", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("shown", pa.string()), ("names", pa.string()), ("around", pa.string()),
        ("broken", pa.bool_()), ("element", pa.bool_()), ("label", pa.string()), ("latitude", pa.float64()), ("longitude", pa.float64()),
    ]
)


def _read(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = []
            for page_id, html in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                found = _Blocks().read(html or "")
                # an address has a figure in it, in its text or its link
                found = [{"page_id": page_id, "ord": i, **r} for i, r in enumerate(found) if any(c.isdigit() for c in r["text"])]
                rows += [{**r, "shown": _without_contacts(r["text"])} if r["kind"] == "block" else r for r in found]
            yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)


def address_blocks(pages: DataFrame) -> DataFrame:
    """pages: page_id, html. A row a block: page_id, ord (place on the page), kind (jsonld, block, map), text, shown (a block's
    without telephone and mail), names (of the element), around (names, those of the parent, and footer), broken (by lines), element (an address one), label, latitude,
    longitude. Only blocks with a digit."""
    columns = "page_id bigint, ord bigint, kind string, text string, shown string, names string, around string, broken boolean, element boolean, label string, latitude double, longitude double"
    return pages.select("page_id", "html").mapInArrow(_read, columns)


def visible_addresses(blocks: DataFrame) -> DataFrame:
    """(page_id, ord, address): blocks that show an address, cut behind its postal code or city.

    One of three must hold: a postal code; a city behind a numbered street, or in a short block behind any street or, where the
    block calls itself an address, any number; or, whatever the city, a numbered street in a short block that calls itself an
    address, is broken by lines, or stands among contacts or in the footer. Telephone numbers, decimals and numbers of ten
    digits or more number no street.
    """
    rows = blocks.filter("kind = 'block'").withColumnRenamed("shown", "v").filter(F.length("v").between(8, 260))
    eircode = F.regexp_extract("v", f"(?i){_EDGE}({EIRCODE}){_EDGE}", 1)
    rows = rows.withColumn("code", F.when(eircode != "", eircode).otherwise(F.regexp_extract("v", f"{_EDGE}({DUTCH_CODE}){_EDGE}", 1)))
    rows = rows.withColumn("town", F.regexp_extract("v", f"({_CITY})", 1))
    end = lambda part: F.when(F.col(part) != "", F.instr(F.col("v"), F.col(part)) + F.length(part) - 1).otherwise(0)
    before = F.when(F.col("town") != "", F.substring("v", F.lit(1), F.instr(F.col("v"), F.col("town")) - 1)).otherwise("")
    rows = rows.withColumns({"before": before, "end": F.greatest(end("code"), end("town"))})
    calls_itself = F.lower("names").contains("address") | F.col("v").rlike(r"(?i)^address\s*:?")
    n = F.length("v")
    short = (n <= 140) & (F.col("before").rlike(_ANY_STREET) | (calls_itself & F.col("before").rlike(r"\d")))
    numbered = lambda c: F.regexp_replace(c, _NO_HOUSE, "#").rlike(_NUMBERED_STREET)
    in_city = (F.col("town") != "") & (numbered("before") | short)
    placed = calls_itself | F.col("broken") | F.col("around").rlike("(?i)contact|location|visit|footer")
    anywhere = (n <= 180) & numbered("v") & placed
    rows = rows.filter((F.col("code") != "") | in_city | anywhere)
    shown = F.when(F.col("end") > 0, F.substring("v", F.lit(1), F.col("end"))).otherwise(F.col("v"))
    return rows.select("page_id", "ord", F.trim(F.regexp_replace(shown, r"(?i)^address\s*:?\s*", "")).alias("address"))


def location_candidates(blocks: DataFrame) -> DataFrame:
    """(page_id, ord, label, address, latitude, longitude, confidence, source) of a page's blocks; ord in order of trust in the
    source, then of the page. A map link that only has coordinates has address ''."""
    none = lambda kind: F.lit(None).cast(kind)
    at = lambda source: (F.lit(source).cast("bigint") * (1 << 32) + F.col("ord")).alias("ord")
    valid = (F.abs("latitude") <= 90) & (F.abs("longitude") <= 180)
    data = blocks.filter("kind = 'jsonld'").select(
        "page_id", at(0), "label", F.col("text").alias("address"), F.when(valid, F.col("latitude")).alias("latitude"), F.when(valid, F.col("longitude")).alias("longitude"),
        F.lit("high").alias("confidence"), F.lit("website_jsonld").alias("source"),
    )
    plain = lambda df, order, trust: df.select(
        "page_id", at(order), none("string").alias("label"), "address", none("double").alias("latitude"), none("double").alias("longitude"),
        F.lit(trust).alias("confidence"), F.lit("website_address_element").alias("source"),
    )
    elements = plain(blocks.filter("kind = 'block' and element").filter(F.length("text").between(8, 300)).withColumnRenamed("text", "address"), 1, "high")
    links = blocks.filter("kind = 'map'").filter(F.col("text").rlike(f"(?i){MAPS}") & F.col("text").rlike(r"(?i)^\s*[a-z][a-z0-9+.-]*:"))
    links = links.withColumn("m", map_url_coords(F.col("text"))).filter("m.address is not null or m.latitude is not null and m.longitude is not null")
    told = F.col("m.address").isNotNull()
    links = links.select(
        "page_id", at(3), none("string").alias("label"), F.coalesce("m.address", F.lit("")).alias("address"), "m.latitude", "m.longitude",
        F.when(told, "medium").otherwise("low").alias("confidence"), F.lit("website_map_link").alias("source"),
    )
    return data.unionByName(elements).unionByName(plain(visible_addresses(blocks), 2, "medium")).unionByName(links)


def page_locations(pages: DataFrame) -> DataFrame:
    """(page_id, source, address, label, latitude, longitude, confidence) of each published address of a page, once.

    pages: page_id, html. Equivalent addresses are one, of the surest source, with the label and coordinates of either. The
    only pin of a page belongs to its only address; a page without addresses has its first pin, with address ''.
    """
    found = location_candidates(address_blocks(pages))
    named = found.filter("address <> ''").withColumnRenamed("page_id", "restaurant_id")
    named = loc_dedupe(named).withColumnRenamed("restaurant_id", "page_id").withColumn("alone", F.count("*").over(W.partitionBy("page_id")) == 1)
    pins = found.filter("address = ''").groupBy("page_id").agg(F.count("*").alias("pins"), F.min_by(F.struct("latitude", "longitude", "label", "confidence", "source"), "ord").alias("pin"))
    met = named.join(pins, "page_id", "full")
    fits = F.col("alone") & (F.col("pins") == 1) & F.col("latitude").isNull()
    only_pin = F.col("address").isNull()
    value = lambda c: F.when(only_pin | (fits if c in ("latitude", "longitude") else F.lit(False)), F.col(f"pin.{c}")).otherwise(F.col(c)).alias(c)
    return met.select("page_id", value("source"), F.coalesce("address", F.lit("")).alias("address"), *(value(c) for c in ("label", "latitude", "longitude", "confidence")))
