"""Addresses of pages: each rule on hand-made pages, and all sources merged."""

import pytest

from larder.operators import locations as L
from larder.operators import pages as P


def found(spark, *bodies):
    pages = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "page_id long, html string")
    rows = L.visible_addresses(L.address_blocks(pages)).orderBy("page_id", "ord").collect()
    return [[r.address for r in rows if r.page_id == i] for i in range(len(bodies))]


RULES = [
    ("<p>53 Ranelagh, Dublin 6, D06 K2Y4 and more</p>", ["53 Ranelagh, Dublin 6, D06 K2Y4"]),
    ("<p>Keizersgracht 12, 1015 CJ Amsterdam, open daily</p>", ["Keizersgracht 12, 1015 CJ Amsterdam"]),
    ("<p>from 2016 to 2019 we cooked</p>", []),
    ("<p>We cook at 12 Fade Street, Dublin 2 every day</p>", ["We cook at 12 Fade Street, Dublin 2"]),
    ("<p>Fade Street, Dublin 2</p>", ["Fade Street, Dublin 2"]),
    (f"<p>{'very ' * 30}quiet Fade Street, Dublin 2</p>", []),
    ("<p>53 Ranelagh, Dublin 6</p>", []),
    ("<div class='Address-line'>53 Ranelagh, Dublin 6</div>", ["53 Ranelagh, Dublin 6"]),
    ("<span itemprop=address>53 Ranelagh, Dublin 6</span>", ["53 Ranelagh, Dublin 6"]),
    ("<p>Address: 53 Ranelagh, Dublin 6</p>", ["53 Ranelagh, Dublin 6"]),
    ("<p>12 rue Verte, Lyon</p>", []),
    ("<p>12 rue Verte<br>Lyon</p>", ["12 rue Verte Lyon"]),
    ("<div id='visit-us'><p>12 rue Verte, Lyon</p></div>", ["12 rue Verte, Lyon"]),
    ("<footer><div><p>12 rue Verte, Lyon</p></div></footer><p>13 rue Verte, Lyon</p>", ["12 rue Verte, Lyon"]),
    ("<p>12 rue Verte<br>Lyon<br>Telephone 01 23 45 67 89</p>", ["12 rue Verte Lyon"]),
    ("<p>+353 (1) 234-5678, x@y.ie</p><p>info@y.ie 7 Main Street, Dublin</p>", ["7 Main Street, Dublin"]),
    ("<p>7 Main Street, Dublin<p>8 Main Street, Dublin<div>9 Main Street, Dublin</div>", ["7 Main Street, Dublin", "8 Main Street, Dublin"]),
    ("<ul><li>7 Main Street, Dublin<li>8 Main Street, Dublin</ul>", ["7 Main Street, Dublin", "8 Main Street, Dublin"]),
    ("<p>7 Main Street, <script>var x = 'London 1';</script><style>p{}</style>Dublin</p>", ["7 Main Street, Dublin"]),
    ("<p>Hauptstrasse 7, Berlin</p><h3>7 Alte Strasse, <br>Berlin</h3>", ["7 Alte Strasse, Berlin"]),
    ("<p>no figure in this street, Dublin</p><p>1 St</p><p></p>", []),
    ("<div class=address><div class=address><p>7 Main Street, Dublin", ["7 Main Street, Dublin"] * 3),
]


def test_rules(spark):
    for (body, want), got in zip(RULES, found(spark, *(b for b, _ in RULES))):
        assert got == want, body


NUMBERS = [
    ("<p>10003 Main Street<br>Dublin 2 D02 X2Y3<br>Phone: 01 234 5678</p>", ["10003 Main Street Dublin 2 D02 X2Y3"]),
    ("<ul><li id='our-address'>1000002 Ranelagh, Dublin 6</ul>", ["1000002 Ranelagh, Dublin 6"]),
    ("<p>12-14 Main Street, Dublin</p>", ["12-14 Main Street, Dublin"]),
    ("<p>01 678 8872 Main Street, Dublin</p><p>6788872 16 Main Street, Dublin</p><p>2125551234 Main Street, Dublin</p>", ["Main Street, Dublin"] * 3),
    ("<p>das +1 (944) 555-6250 ung den st.<br></p><p>25.246.22.179 enea be st<br></p><p>4276954614066980 auf st<br></p>", []),
    ("<p>12 auf st<br></p><p>+1 (944) 555-6250 ung 7 Alte Strasse<br></p>", ["12 auf st", "ung 7 Alte Strasse"]),
]


def test_house_numbers(spark):
    """Long house numbers stay, telephone numbers go; neither those nor other long numbers make a street's number."""
    for (body, want), got in zip(NUMBERS, found(spark, *(b for b, _ in NUMBERS))):
        assert got == want, body


LD = '<script type="application/ld+json">%s</script>'


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"@type":"Restaurant","name":" A  B ","address":"1 Main St, Cork","geo":{"latitude":"51.9","longitude":-8}}', [("A B", "1 Main St, Cork", 51.9, -8.0)]),
        ('[{"@type":"Organization","address":"x 1"},{"@type":["CafeOrCoffeeShop"],"address":{"streetAddress":"2 Quay","postalCode":" T12 "}}]', [(None, "2 Quay, T12", None, None)]),
        ('{"@type":"BarOrPub","address":"3 Lane","@graph":[{"@type":"LocalBusiness","address":{"streetAddress":"4 Lane"}},{"@graph":[{"@type":"restaurant","address":"5 Lane"}]}]}', [(None, "3 Lane", None, None), (None, "4 Lane", None, None), (None, "5 Lane", None, None)]),
        ('{"@type":"Restaurant","address":{}} ', []),
        ('{"@type":"Restaurant","address":"1 x","geo":{"latitude":"north","longitude":true}}', [(None, "1 x", None, None)]),
        ("{not json", []),
    ],
)
def test_structured(text, want):
    assert [(r["label"], r["text"], r["latitude"], r["longitude"]) for r in L._structured(text)] == want


def test_sources_merge(spark):
    ld = LD % '{"@type":"Restaurant","name":"HQ","address":"12 Main Street, Dublin 2"}'
    pages = [
        ld + "<address>12 Main Street<br>Dublin 2, Ireland</address><footer><p>12 Main Street, Dublin 2</p></footer><a href='https://www.google.com/maps/@53.5,-6.5,9z'>x</a>",
        ld + "<a href='https://www.google.com/maps/@53.5,-6.5'>x</a><a href='https://www.google.com/maps/@53.6,-6.5'>y</a>",
        "<iframe src='https://www.openstreetmap.org/?query=53.5,%20-6.5'></iframe><a href='https://maps.google.com/maps?q=1,2'>2</a>",
        "<a href='/maps?q=12+Main+Street'>relative</a><a href='https://x.ie/maps?q=12+Main+Street%2C+Cork'>map</a>",
        "<p>12 Main Street, Dublin</p><p>13 Main Street, Dublin</p><a href='https://x.ie/maps/@53.5,-6.5'>x</a>",
        "<p>nothing here</p>",
        None,
        LD % '{"@type":"Restaurant","address":"12 Main Street, Dublin 2","geo":{"latitude":95,"longitude":3}}',
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {}
    for r in P.page_locations(df).collect():
        got.setdefault(r.page_id, []).append((r.source, r.address, r.label, r.latitude, r.longitude, r.confidence))
    got[4].sort()
    assert got == {
        0: [("website_address_element", "12 Main Street Dublin 2, Ireland", "HQ", 53.5, -6.5, "high")],
        1: [("website_jsonld", "12 Main Street, Dublin 2", "HQ", None, None, "high")],
        2: [("website_map_link", "", None, 53.5, -6.5, "low")],
        3: [("website_map_link", "12 Main Street, Cork", None, None, None, "medium")],
        4: [("website_address_element", f"{n} Main Street, Dublin", None, None, None, "medium") for n in (12, 13)],
        7: [("website_jsonld", "12 Main Street, Dublin 2", None, None, None, "high")],
    }


def test_homepages(spark):
    """Fields before quoted urls, escaped quotes, and what can't be a place's own site."""
    pages = [
        '"https://a.ie" {"website":"https:\\/\\/field.ie\\/x\\/y"}',
        'website_uri\\u003d: "https://uri.ie" "website":"https://field.ie"',
        '"website":"https://www.instagram.com/x" "primaryUrl" : "https://primary.ie"',
        'x ["https://list.ie",null,null] ["https://other.ie",null,null,null]',
        '{"externalLinks": [["https://no.ie"]]} externalLinks: ["https://links.ie"]',
        '"https://deep.ie/a/b" \\x22https://hex.ie\\x22 \\u0022https://uni.ie/x\\u0022',
        '"https://deep.ie/a/b" \\u0022https://uni.ie\\u0022',
        '"https://one.ie" "https://two.ie"',
        '"https://cdn.ie/a.png" "https://www.facebook.com/me" "ftp://x.ie"',
        None,
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r.page_id: (r.homepage, r.keyed) for r in P.homepage_urls(df).collect()}
    want = ["https://field.ie/x/y", "https://uri.ie", "https://primary.ie", "https://other.ie", "https://links.ie"]
    assert got == {i: (u, True) for i, u in enumerate(want)} | {5: ("https://hex.ie", False), 6: ("https://uni.ie", False), 7: ("https://one.ie", False)}
    assert {r.page_id for r in P.homepage_urls(df, ["one.ie"]).collect()} == set(range(8)) and P.homepage_urls(df, ["one.ie"]).filter("page_id = 7").first().homepage == "https://two.ie"
