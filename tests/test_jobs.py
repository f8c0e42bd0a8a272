"""Jobs with rules that SQL can't hold, on small tables; and properties of the rest."""

import random

from pyspark.sql import functions as F

from larder.operators import editing as E
from larder.operators import extraction as X
from larder.operators import geo as G
from larder.operators import menus as O
from larder.operators import pages as P
from larder.plans import catalog
from larder.plans.fixtures import load
from larder.sources import tables as S
from larder.streaming import streams as R


def test_tally_properties(spark, sf_dir):
    t = O.menu_tallies(O.judged(load(spark, sf_dir, "dishes"), load(spark, sf_dir, "menu_sections")))
    assert t.filter("vegan_counted > veg_counted or veg_counted + veg_aside > all_dishes").count() == 0


def test_merge_keeps_labels_apart(spark):
    rows = spark.createDataFrame([(1, "Lunch", None, "Risotto", "€15", 0.9, 1), (1, "Dinner", None, "Risotto", "€15", 0.5, 2), (1, "Dinner", None, "risotto!", "€15", 0.8, 3), (2, "Only", "Veg", "A", None, 0.1, 1)], "restaurant_id int, menu string, own_label string, name string, price string, confidence double, ord int")
    assert sorted((r.restaurant_id, r.menu_label, r.ord) for r in X.merge_menus(rows).collect()) == [(1, "Dinner", 3), (1, "Lunch", 1), (2, "Veg", 1)]


def _old(spark, rows):
    return spark.createDataFrame(rows, "id string, restaurant_id int, ord int, name string, section string, classification string, confidence double, ai_classification string, human_verified boolean, notes string, deleted_at timestamp, report_count int")


def test_reparse_keeps_human_work(spark):
    old = _old(spark, [("a", 1, 1, "Garlic Bread", "Sides", "vegan", 1.0, "vegetarian", True, "checked", None, 0), ("b", 1, 2, "Gone Dish", "Mains", "neither", 1.0, None, True, None, None, 4), ("c", 1, 3, "Odd", "Mains", "vegan", 0.2, None, False, None, None, 1)])
    new = spark.createDataFrame([("n1", 1, 1, "garlic bread ", "Starters", "neither", 0.7), ("n2", 1, 2, "Garlic Bread", "Sides", "neither", 0.8)], "id string, restaurant_id int, ord int, name string, section string, classification string, confidence double")
    reports = spark.createDataFrame([(1, "b"), (2, "c"), (3, "zz")], "id int, dish_id string")
    dishes, kept = X.reparse(old, new, reports, F.expr("timestamp '2024-01-01'"))
    by_id = {r.id: r for r in dishes.collect()}
    assert by_id["n2"].classification == "vegan" and by_id["n2"].human_verified and by_id["n2"].ai_classification == "vegetarian" and by_id["n2"].notes == "checked"
    assert by_id["n1"].classification == "neither" and not by_id["n1"].human_verified
    assert by_id["b"].human_verified and by_id["b"].section is None and by_id["b"].notes == X.STALE and by_id["b"].report_count == 4 and by_id["b"].flagged
    assert by_id["c"].deleted_at is not None and len(by_id) == 4
    assert sorted((r.id, r.dish_id) for r in kept.collect()) == [(1, "b"), (2, "c")]


def test_locations_merge_in_order(spark):
    schema = "restaurant_id int, ord int, label string, address string, latitude double, longitude double, confidence string"
    rows = [(1, 1, None, "12 Main Street, Dublin", None, None, "low"), (1, 2, "HQ", "12 main street dublin, Ireland", 53.3, -6.2, "high"), (1, 3, None, "", 53.4, -6.3, "low"), (2, 1, None, "5 Quay Row, Cork", None, None, "high"), (2, 2, None, "", 51.9, -8.4, "low"), (3, 1, None, "no", None, None, "high")]
    got = sorted((r.restaurant_id, r.address, r.label, r.latitude) for r in G.loc_dedupe(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "", None, 53.4), (1, "12 main street dublin, Ireland", "HQ", 53.3), (2, "5 Quay Row, Cork", None, 51.9)]


def test_locations_of_a_large_restaurant(spark):
    schema = "restaurant_id int, ord int, label string, address string, latitude double, longitude double, confidence string"
    rows = [(1, i, None, f"{i} Other Street, Cork", None, None, "low") for i in range(11_000)]
    pairs = [(f"{i} Harbour Road, Dublin", f"{i} Harbour Road, Dublin, Ireland", f"Unit {i % 7}, {i} Harbour Road, Dublin") for i in range(100, 150)]
    rows += [(1, 20_000 + 3 * i + j, None, a, None, None, c) for i, p in enumerate(pairs) for j, (a, c) in enumerate(zip(p, ("low", "high", "low")))]
    rows += [(2, 1, None, "5 Quay Row, Cork", None, None, "high"), (2, 2, None, "", 51.9, -8.4, "low"), (None, 1, None, "5 Quay Row, Cork", None, None, "low"), (None, 2, None, "5 Quay Row, Cork, Ireland", None, None, "low")]
    got = sorted((r.restaurant_id or 0, r.address, r.latitude) for r in G.loc_dedupe(spark.createDataFrame(rows, schema)).collect())
    harbour = [(1, b, None) for _, b, _ in pairs] + [(1, c, None) for _, _, c in pairs]
    assert got == sorted([(0, "5 Quay Row, Cork, Ireland", None), (2, "5 Quay Row, Cork", 51.9), *((1, f"{i} Other Street, Cork", None) for i in range(11_000)), *harbour])


def _most_rows(df):
    """The most rows that any operator of the plan gives, after a run."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_location_upsert_by_key(spark):
    """Many candidates and stored addresses of one key cost their number, not its square; the surest and longest one wins."""
    kinds = "case id % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as confidence"
    stored = spark.range(2_000).selectExpr("id", "1L as restaurant_id", "'12 Main Street, Cork' as address", kinds)
    cand = spark.range(3_000).selectExpr("id + 10000 as id", "1L as restaurant_id", "case when id % 2 = 0 then '12 Main Street, Cork' else '12 main street Cork Ireland' end as address", kinds)
    updated, inserted = G.upsert_locations(cand, stored)
    assert _most_rows(updated) <= 3_000 and inserted.count() == 0
    assert {(r.candidate_id, r.n) for r in updated.groupBy("candidate_id").agg(F.count("*").alias("n")).collect()} == {(10_005, 2_000)}


def test_location_upsert_rules(spark):
    """The surer stored address stays; what meets none is new, once by key; unknown trust and no restaurant meet nothing."""
    columns = "id long, restaurant_id long, address string, confidence string"
    stored = spark.createDataFrame([(1, 1, "12 Main Street, Cork", "high"), (2, 1, "12 Main Street", "low"), (3, 2, "7 Quay", "low"), (4, 1, None, "low"), (5, 3, "9 Long Lane, Cork", "odd"), (6, 1, "Main Street, Cork, Ireland", "medium")], columns)
    cand = [(10, 1, "12 Main Street, Cork", "medium"), (11, 1, "12 MAIN street, Cork!", "medium"), (12, 2, "7 Quay, Cork", "high"), (13, 2, "7 quay cork", "medium"), (14, 3, "9 Long Lane, Cork", "high"), (15, None, "1 Some Road", "low"), (16, None, "1 some road.", "low"), (17, 1, "x", "high"), (18, 1, "Main Street, Cork, Ireland", None)]
    updated, inserted = G.upsert_locations(spark.createDataFrame(cand, columns), stored)
    assert sorted(tuple(r) for r in updated.collect()) == [(2, 11)]
    assert sorted((r.candidate_id, r.restaurant_id, r.new_address, r.new_confidence) for r in inserted.collect()) == [(12, 2, "7 Quay, Cork", "high"), (15, None, "1 Some Road", "low")]


def test_polygon_with_hole(spark):
    ring = lambda lo, hi: [(lo, lo), (hi, lo), (hi, hi), (lo, hi)]
    areas = spark.createDataFrame([(1, "X", [ring(0.0, 1.0), ring(0.4, 0.6)], True), (2, "X", [ring(0.0, 2.0)], True)], "area_id int, city string, rings array<array<struct<longitude:double,latitude:double>>>, active boolean")
    points = spark.createDataFrame([(1, "x", 0.2, 0.2), (2, "x", 0.5, 0.5), (3, "x", 5.0, 5.0), (4, "y", 0.2, 0.2)], "id int, city string, latitude double, longitude double")
    assert {r.id: r.area_id for r in G.assign_neighbourhoods(points, areas).collect()} == {1: 1, 2: 2, 3: None, 4: None}


def test_geojson(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"features":[{"properties":{"name":"A","name:en":" B "},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}},{"properties":{"name":""},"geometry":{"type":"Polygon","coordinates":[]}},{"properties":{"name":"C"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[2,2],[3,2],[3,3]]]]}},{"properties":{"name":"P"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    rows = S.read_neighbourhoods(spark, str(tmp_path / "g.json"), "x").collect()
    assert sorted((r.display_name, len(r.rings)) for r in rows) == [("B", 1), ("C", 2)]


HTML = """<html><body><nav><a href='/about'>About</a></nav><p>Hello <a href="/menus/lunch.pdf">Lunch Menu</a> <a href='/food/dinner'>Dinner</a> <a href='#top'>menu</a>
<a href='https://order.place.ie/x'>Order</a> <a href='https://other.com/menu'>Menu</a> <a href='/gift-menu'>gift</a> <a href='/contact'>Contact us</a> <a href='/restaurants'>Venues</a></p>
<img src='/img/menu-board.jpg' width='800'><img src='/img/logo.png'><address>1 Main Street<br>Dublin</address>
<script type="application/ld+json">{"@type":"Restaurant","address":{"streetAddress":"5 Quay","addressLocality":"Cork"}}</script></body></html>"""


def test_page_signals(spark):
    pages = spark.createDataFrame([(1, "https://place.ie/", HTML), (2, None, None)], "page_id long, url string, html string")
    signals = P.page_signals(pages)
    links = P.page_links(signals)
    menus = {(r.kind, r.url) for r in P.menu_links(links).collect()}
    assert ("pdf", "https://place.ie/menus/lunch.pdf") in menus and ("html", "https://place.ie/food/dinner") in menus and ("html", "https://order.place.ie/x") in menus
    assert not any("other.com" in u or "gift" in u or "#" in u for _, u in menus)
    assert P.nav_links(links).orderBy("rank").first().url == "https://place.ie/restaurants"
    assert [r.url for r in P.menu_images(signals).collect()] == ["https://place.ie/img/menu-board.jpg"]
    assert [r.url for r in P.contact_links(links).orderBy("rank").collect()] == ["https://place.ie/contact", "https://place.ie/about"]
    assert {r.address for r in P.page_locations(pages).collect()} == {"5 Quay, Cork", "1 Main Street Dublin"}
    assert "About" not in signals.filter("page_id = 1").first().text


def test_page_text_is_whole(spark):
    pages = spark.createDataFrame([(1, "https://place.ie/", f"<body><p>{'soup ' * 20_000}bread</p></body>")], "page_id long, url string, html string")
    assert P.page_signals(pages).first().text == "soup " * 20_000 + "bread"
    assert P.page_signals(pages, most=40_000).first().text == ("soup " * 8_000)


def test_rate_limit_counts_accepted_only():
    rng = random.Random(5)
    times = sorted(rng.randrange(0, 20_000) for _ in range(300))
    verdicts, _ = R.accepted(times, [], 15, 3600)
    let = [t for t, v in zip(times, verdicts) if v]
    assert all(sum(1 for x in let if t - 3600 < x <= t) <= 15 for t in let)
    assert all(sum(1 for x in let if t - 3600 < x <= t) >= 15 for t, v in zip(times, verdicts) if not v)


def test_stream_equals_batch(spark, sf_dir):
    from larder.plans.live import QUERIES

    ours = {(r.id, r.allowed) for r in QUERIES["st_rate_limit"](spark, sf_dir).collect()}
    assert ours == {(r.id, r.allowed) for r in QUERIES["rate_limit_batch"](spark, sf_dir).collect()}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', None), ("plain", "x\ny")], "p string, q string")
    S.write_csv_quoted(df, str(tmp_path / "q"))
    back = spark.read.csv(str(tmp_path / "q"), header=True, escape='"', multiLine=True, nullValue=None)
    assert sorted((r.p, r.q or "") for r in back.collect()) == [('a "b", c', ""), ("plain", "x\ny")]


def test_partitions_do_not_matter(spark, sf_dir):
    d, s = load(spark, sf_dir, "dishes"), load(spark, sf_dir, "menu_sections")
    once = O.guide_insights(d.coalesce(1), s.coalesce(1)).drop("highlights").collect()
    assert sorted(map(str, once)) == sorted(map(str, O.guide_insights(d.repartition(7), s.repartition(3)).drop("highlights").collect()))


def test_discover_candidates(spark):
    at = "https://x.nl"
    rows = spark.createDataFrame(
        [
            (1, "text", "", "Main Menu", None, 1), (1, "pdf", f"{at}/a1.pdf", "Lunch", False, 2), (1, "pdf", f"{at}/a1.pdf", "Lunch", True, 3),
            (1, "subpage", f"{at}/nl/menu", "Menukaart", False, 4), (1, "subpage", f"{at}/eng/menu", "Menu", False, 5), (1, "pdf", f"{at}/wine-list.pdf", None, False, 6),
            (1, "subpage", f"{at}/de/karte", "Karte", True, 7), (1, "subpage", f"{at}/news", "News", False, 8), (1, "pdf", f"{at}/b2.pdf", "Lunch", False, 9), (2, "pdf", f"{at}/kids-menu.pdf", "Kids menu", True, 1),
        ],
        "site int, type string, ref string, hint string, validated boolean, ord int",
    )
    verdicts = spark.createDataFrame([(1, "subpage", f"{at}/news", "News", False, False, "n"), (1, "text", "", "", True, False, "m"), (1, "subpage", f"{at}/eng/menu", "Menu", False, False, "m")], "site int, type string, ref string, label string, distinct_menu boolean, drink_only boolean, grp string")
    primary = spark.createDataFrame([(1, f"{at}/en/karte")], "site int, url string")
    fallback = spark.createDataFrame([(1, "image", f"{at}/1.png", 1), (2, "image", f"{at}/3.png", 2), (2, "image", f"{at}/2.png", 1)], "site int, type string, ref string, ord int")
    found = X.discover_candidates(rows, verdicts, primary, fallback)
    # a1 once; the English sibling stands for the text of its group; no wine list, variant of the page in use, or page told not to be a menu
    assert sorted(tuple(r) for r in found.collect()) == [(1, "pdf", f"{at}/a1.pdf", "Lunch"), (1, "pdf", f"{at}/b2.pdf", "Lunch 2"), (1, "subpage", f"{at}/eng/menu", "Menu"), (2, "image", f"{at}/2.png", "Menu")]
    assert X.discover_candidates(rows.limit(0), verdicts, primary, fallback.limit(0)).count() == 0


def test_added_menus_without_names(spark):
    """A menu without a label and a section without a name keep their dishes."""
    from larder.operators import editing as D

    restaurants = spark.createDataFrame([(1, "no_menu", "x", None)], "id long, status string, no_menu_reason string, no_menu_confirmed_at timestamp")
    sections = spark.createDataFrame([(1, 4)], "restaurant_id long, display_order int")
    menus = spark.createDataFrame(
        [(1, None, 1, "Mains", "A"), (1, None, 1, "Mains", "B"), (1, "Late", 2, None, "C"), (1, None, 3, None, "D"), (1, None, 4, "Empty", None)], "restaurant_id long, label string, ord int, section string, name string"
    ).withColumns({"description": F.lit(None).cast("string"), "price": F.lit("1"), "classification": F.lit("vegan"), "confidence": F.lit(0.5)})
    out = D.add_menus(restaurants, sections, menus)
    ids = {r.display_order: r.id for r in out.sections.collect()}
    assert ids == {5: "1-5", 6: "1-Late-6", 7: "1-7", 8: "1-8"}
    assert {r["name"]: r.section_id for r in out.dishes.collect()} == {"A": "1-5", "B": "1-5", "C": "1-Late-6", "D": "1-7"}


def test_applied_feedback_reads_written_tables(spark, sf_dir):
    """Derived tables are worked out before and once; what is left deals each written table a few times."""
    plan = catalog.QUERIES["job_apply_feedback"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") <= 12


def test_resolved_feedback_by_kind(spark):
    """Dishes count for reports of dishes alone, menus for feedback on places; what is unknown is routed, and does nothing."""
    columns = "kind string, id long, type string, status string, dish_id string, restaurant_id long, proposed_classification string, menu_label string, proposed_name string"
    dish, place = "dish_report", "restaurant_feedback"
    items = [
        (dish, 1, "not_a_dish", "confirmed", "d1", None, None, None, None), (dish, 2, "wrong_classification", "confirmed", "d1", 9, "vegan", None, None),
        (dish, 3, "wrong_classification", "confirmed", "d1", None, None, None, None), (dish, 4, "not_a_dish", "confirmed", "gone", 1, None, None, None),
        (dish, 5, "not_a_dish", "confirmed", "lost", None, None, None, None), (dish, 6, "not_a_dish", "open", "d1", None, None, None, None), (dish, 7, "not_a_menu", "confirmed", "d1", 1, None, "A", None),
        (place, 11, "not_a_menu", "confirmed", "d1", 1, None, "A", None), (place, 12, "not_a_menu", "confirmed", None, 1, None, None, None), (place, 13, "not_a_menu", "confirmed", None, 9, None, "A", None),
        (place, 14, "wrong_name", "confirmed", None, 1, None, None, " New "), (place, 15, "wrong_name", "confirmed", None, 1, None, None, "  "), (place, 16, "menu_outdated", "confirmed", None, 1, None, None, None), (place, 17, "not_a_dish", "confirmed", "d1", 1, None, None, None),
        (None, 21, "not_a_dish", "confirmed", "d1", 1, None, None, None), ("other", 22, "not_a_menu", "confirmed", None, 1, None, "A", None), (None, 23, "not_a_dish", None, "d1", 1, None, None, None),
    ]
    dishes = spark.createDataFrame([("d1", 1, "s1"), ("d2", 1, "s2"), ("d3", 1, None), ("lost", 8, "s1")], "id string, restaurant_id long, section_id string")
    sections = spark.createDataFrame([("s1", 1, "A"), ("s2", 1, None)], "id string, restaurant_id long, menu_label string")
    out = E.resolve_feedback(spark.createDataFrame(items, columns), dishes, spark.createDataFrame([(1,), (2,)], "id long"), sections)
    told = {r.id: r.resolution_action for r in out.items.collect()}
    routed = dict.fromkeys((3, 4, 5, 7, 13, 15, 17, 21, 22, 23), "routed_to_review")
    assert told == routed | {1: "removed_dish", 2: "reclassified:vegan", 6: "dismissed", 11: "removed_menu:A (1 dishes)", 12: "removed_menu:(unlabeled) (1 dishes)", 14: "renamed:New", 16: "reparsed"}
    assert sorted(tuple(r) for r in out.verdicts.collect()) == [(1, "d1", "delete", None), (2, "d1", "upsert", "vegan")]
    assert sorted((r.seq, r.restaurant_id, r.menu_label) for r in out.removals.collect()) == [(11, 1, "A"), (12, 1, None)] and [tuple(r) for r in out.renames.collect()] == [(14, 1, "New")]
