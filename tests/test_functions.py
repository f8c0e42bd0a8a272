"""Single functions on hand-written inputs."""

import pytest
from pyspark.sql import functions as F

from larder.functions import misc as M
from larder.functions import text as T
from larder.functions import urls as U
from larder.functions.dish_role import with_dish_role


def each(spark, column, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in rows.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def table(spark, column, cases):
    assert dict(zip(cases, each(spark, column, list(cases)))) == cases


def test_parse_price(spark):
    table(spark, T.parse_price, {"€7.50": 7.5, "€29": 29.0, "12": 12.0, "£12.50": 12.5, None: None, "": None, "Market Price": None, '9" €12.99 / 12" €14.99': 12.99, "€18 (dinner) / €16 (lunch)": 18.0, "€8–€11": 8.0, "Half dozen €21 | Dozen €42": 21.0, "3,75": 3.75, "38/70": 38.0})


def test_format_price(spark):
    table(spark, T.format_price, {"4": "€4", "14.50": "€14.50", "12 / 18": "€12 / €18", "€7.50": "€7.50", "12 USD": "12 USD", "market price": None})


def test_whole_texts_are_judged(spark):
    late = "the soup and bread " * 250 + "le potage du jour avec pain " * 20_000
    assert each(spark, T.text_is_english, [late, "the soup and bread " * 250, "le potage", None]) == [False, True, True, True]
    assert each(spark, lambda c: T.text_is_english(c, most=4_000), [late]) == [True]


def test_english_words_are_ascii_words(spark):
    """As SQL has it: edges and spaces of ASCII, and a long s for an s."""
    filler = "plat " * 48
    texts = [filler + "Ouré des", filler + "ourée des", filler + "the_ des", filler + "éthe des", filler + "PLEAſE des", filler + "thiſ des", filler + "ethe\u00a0des", "plat\x0b" * 45 + "des", "plat\u00a0" * 45 + "des"]
    assert each(spark, T.text_is_english, texts) == [True, True, False, True, True, False, False, True, True]


def test_url_identity(spark):
    keys = each(spark, U.url_dedup_key, ["https://dohertysbar.ie", "https://www.dohertysbar.ie/menu/", "http://DohertysBar.ie/menu/lunch", "dohertysbar.ie"])
    assert set(keys) == {"dohertysbar.ie"}
    shared = each(spark, U.url_dedup_key, ["https://toasttab.com/restaurant-a", "https://toasttab.com/restaurant-b", "https://a.square.site", "https://b.square.site", "https://instagram.com/x", "https://instagram.com/y"])
    assert len(set(shared)) == 6
    table(spark, U.url_normalize, {"https:///isaacsrestaurant.ie": "isaacsrestaurant.ie", "HTTPS://WWW.A.ie//": "a.ie"})
    table(spark, U.url_canonical, {"https://www.dohertysbar.ie/menu/": "https://dohertysbar.ie", " https://toasttab.com/a ": "https://toasttab.com/a"})


def test_fnv(spark):
    def plain(s):
        h = 2166136261
        for c in s.encode():
            h = (h ^ c) * 16777619 % 2**32
        return f"{h:08x}"

    refs = ["https://a.ie/menu.pdf", "", "x"]
    assert each(spark, lambda c: U.candidate_id(F.lit("pdf"), c), refs) == [plain(f"pdf|{r}") for r in refs]


ROLES = [
    ("Mains", "Mushroom risotto", "counted"), ("Sides", "Butter Naan", "staple"), ("Desserts", "Gulab Jamun", "dessert"), ("Mains", "Paneer tikka with butter naan", "counted"),
    ("Sides", "Creamed potatoes", "staple"), ("Sides", "Roast potatoes, chard & romesco", "counted"), ("Mains", "Potato & leek soup", "counted"), ("Sides", "Truffle & parmesan fries", "staple"),
    ("Starters", "48-hour Sourdough, Parmesan Custard, Cep Butter", "counted"), ("Starters", "Guinness Bread & Butter", "staple"), ("Sauces", "Ketchup", "condiment"), ("Sides", "Chips with mayo", "staple"),
    ("Extras", "+ fried egg", "condiment"), ("Brunch", "Side of strawberries", "condiment"), ("Puds", "Crème brûlée", "dessert"), ("Snacks", "Padrón peppers", "counted"), (None, "", "counted"), ("Mains", None, "counted"),
]


def test_fnv_of_whole_urls(spark, sf_dir):
    from larder.plans import catalog
    from larder.plans.fixtures import load

    urls = {r.page_id: r.url for r in load(spark, sf_dir, "urls").collect()}
    got = {r.key: r.value for r in catalog.QUERIES["candidate_id_whole"](spark, sf_dir).collect()}

    def plain(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return f"{h:08x}"

    assert got == {i: plain(f"pdf|{u}") for i, u in urls.items()} and len(set(got.values())) > 1


def test_dish_roles(spark):
    df = spark.createDataFrame([(i, s, n) for i, (s, n, _) in enumerate(ROLES)], "i int, s string, n string")
    got = [r.verdict.role for r in with_dish_role(df, "s", "n").orderBy("i").collect()]
    assert got == [r for _, _, r in ROLES]
    amb = {r.n: r.verdict.ambiguous for r in with_dish_role(spark.createDataFrame([("Bar snacks", "Padron"), ("Mains", "Tamarind Sauce"), ("Mains", "Gluten Free Bread"), ("Mains", "Risotto")], "s string, n string"), "s", "n").collect()}
    assert amb == {"Padron": True, "Tamarind Sauce": True, "Gluten Free Bread": True, "Risotto": False}


@pytest.mark.parametrize("message, code", [("Request timed out", "timeout"), ("rate limit: timed out", "rate_limited"), ("That page doesn’t exist", "not_found"), ("We couldn't find a food menu", "no_menu_readable"), ("500 oops", "server_error"), ("getaddrinfo ENOTFOUND", "network"), ("TLS handshake", "site_unreachable"), (None, "unknown")])
def test_error_code(spark, message, code):
    assert each(spark, M.error_code, [message]) == [code]


def test_area_code(spark):
    table(spark, M.area_code, {"1 Main St, D02 X2Y3": "D02", "1 Main St, Dublin 6": "D06", "x, Dublin 6W": "D6W", "x, Dublin 23": None, "Cork": None, None: None})


def test_addresses(spark):
    df = spark.createDataFrame([("1 Main Street, Dublin", "1 main street dublin Ireland"), ("1 Main", "1 Main Street"), ("A", "a")], "a string, b string")
    assert [r.v for r in df.select(M.address_equivalent(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, True]


def test_hmac(spark):
    import hashlib
    import hmac

    assert each(spark, lambda c: M.vote_ip_hash(c, "secret"), ["1.2.3.4"]) == [hmac.new(b"secret", b"1.2.3.4", hashlib.sha256).hexdigest()]


def test_menu_text(spark):
    hours = "We open 5.30-9.30 and 12.00-2.30 daily. " * 8
    menu = "Starter soup 7.50 salad 8.50 main pasta 14.00 pizza 12.00 dessert 6.50 " * 3
    assert each(spark, T.text_is_menu, [hours, menu, "short", None]) == [False, True, False, False]


def test_chunks_keep_text(spark):
    text = "\n".join(f"line {i} " + "x" * 50 for i in range(600))
    (parts,) = each(spark, T.menu_chunks, [text])
    assert 1 < len(parts) <= 4 and "".join(parts).rstrip("\n") == text


def test_chunks_grow_with_the_text_alone(spark):
    """Parts as a plain loop gives them; and a text of very many lines, which took minutes when each line counted all of it."""
    import time

    def plain(text, chunk=9000, most=4):
        parts = min(most, max(1, -(-len(text) // chunk)))
        if parts == 1:
            return [text]
        out = [""]
        for line in text.split("\n"):
            if len(out[-1]) >= -(-len(text) // parts):
                out.append("")
            out[-1] += line + "\n"
        return [x for x in out if x.strip()]

    texts = ["\n".join("é" * (i * n % 700) for i in range(n)) for n in (1, 2, 30, 77, 200)] + ["\n" * 20_000 + "x", "x" * 9_000 + "\n" * 9_000, "x" * 9_001, "", "ab\n" * 12_000]
    assert each(spark, T.menu_chunks, texts) == [plain(t) for t in texts]
    began = time.time()
    (parts,) = each(spark, T.menu_chunks, ["a\n" * 200_000])
    assert [len(p) for p in parts] == [100_000] * 4 and time.time() - began < 30


def test_markdown_links(spark):
    (links,) = each(spark, T.markdown_links, ["[*Lunch*](https://a.ie/x.pdf) [Dinner](https://a.ie/x.pdf) [http://no](https://b.ie) [B](https://b.ie)"])
    assert [(x.url, x.label) for x in links] == [("https://a.ie/x.pdf", "Lunch"), ("https://b.ie", "B")]


def test_content_kinds(spark):
    df = spark.createDataFrame([(b"%PDF-1.4",), (b"\xff\xd8\xff" + b"0" * 12,), (b"\x89PNG" + b"0" * 12,), (b"GIF89a" + b"0" * 12,), (b"RIFF0000WEBP1",), (b"<html>",), (None,)], "c binary")
    assert [r.v for r in df.select(M.content_kind(F.col("c")).alias("v")).collect()] == ["application/pdf", "image/jpeg", "image/png", "image/gif", "image/webp", None, None]
