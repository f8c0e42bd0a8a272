"""Queries of menus and the guide, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import menus as O

from .fixtures import load, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

# The derived dish names are few, so the SQL names each one's role outright.
JUDGED = """placed AS (
  SELECT d.*, coalesce(s.name, 'Menu') AS section, s.menu_label, coalesce(s.display_order, 999) AS section_order,
    try_cast(replace(coalesce(nullif(regexp_extract(price, '[€£$]\\s*([0-9]+(?:[.,][0-9]{1,2})?)', 1), ''), nullif(regexp_extract(price, '[0-9]+(?:[.,][0-9]{1,2})?'), '')), ',', '.') AS double) AS amount
  FROM dishes d LEFT JOIN menu_sections s ON s.id = d.section_id AND s.restaurant_id = d.restaurant_id WHERE d.deleted_at IS NULL
), roles AS (
  SELECT *, CASE WHEN name = '(vegan)' THEN 'counted' WHEN section = 'Desserts' THEN 'dessert' WHEN section = 'Sauces' THEN 'condiment'
      WHEN name IN ('Creamed potatoes', 'Garlic Naan', 'Warm Focaccia & Whipped Butter', 'Baked bread', 'Rice', 'Chips', 'Basmati Rice') THEN 'staple' WHEN name IN ('Truffle mayo', 'Tomato Sauce', 'Side of greens') THEN 'condiment'
      WHEN name = 'Chocolate brownie (V)' THEN 'dessert' ELSE 'counted' END AS role,
    CASE WHEN name = '(vegan)' THEN NULL WHEN section = 'Desserts' THEN 'dessert section' WHEN section = 'Sauces' THEN 'sauce/dip section' WHEN name = 'Creamed potatoes' THEN 'potatoes on their own' WHEN name = 'Garlic Naan' THEN 'named "… naan/roti"'
      WHEN name = 'Warm Focaccia & Whipped Butter' THEN 'bread & butter' WHEN name = 'Baked bread' THEN 'named "… bread"' WHEN name = 'Chocolate brownie (V)' THEN 'dish name: "brownie"' WHEN name = 'Side of greens' THEN 'add-on ("extra…"/"side of…")'
      WHEN name = 'Truffle mayo' THEN 'named "mayo"' WHEN name = 'Tomato Sauce' THEN 'named "… sauce"' WHEN name IN ('Rice', 'Chips') THEN 'bare "' || lower(name) || '"' WHEN name = 'Basmati Rice' THEN 'named "basmati rice"' END AS rule,
    CASE WHEN name = '(vegan)' OR section IN ('Desserts', 'Sauces') THEN false WHEN name IN ('Baked bread', 'Tomato Sauce') THEN true
      WHEN name IN ('Creamed potatoes', 'Garlic Naan', 'Warm Focaccia & Whipped Butter', 'Rice', 'Chips', 'Basmati Rice', 'Truffle mayo', 'Side of greens', 'Chocolate brownie (V)') THEN false ELSE section = 'Nibbles' END AS ambiguous
  FROM placed
), levels AS (
  SELECT restaurant_id, CASE WHEN count(*) >= 4 THEN median(amount) END AS level FROM placed WHERE amount > 0 GROUP BY restaurant_id
), judged AS (
  SELECT r.*, l.level, CASE WHEN regexp_replace(regexp_replace(regexp_replace(lower(name), '\\([^)]*\\)', ' ', 'g'), '\\b(v|vg|ve|vgn|vegan|vegetarian|veg)\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') = '' THEN '#' || id
      ELSE regexp_replace(regexp_replace(regexp_replace(lower(name), '\\([^)]*\\)', ' ', 'g'), '\\b(v|vg|ve|vgn|vegan|vegetarian|veg)\\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') END AS key,
    classification <> 'neither' AS veg, role = 'counted' AS by_name, CASE WHEN ambiguous AND amount < 0.5 * level THEN false WHEN ambiguous AND amount >= 0.5 * level THEN true ELSE role = 'counted' END AS counted
  FROM roles r LEFT JOIN levels l USING (restaurant_id)
), tallies AS (
  SELECT restaurant_id, menu_label, count(DISTINCT key) AS all_dishes, count(DISTINCT key) FILTER (veg AND counted) AS veg_counted, count(DISTINCT key) FILTER (veg) - count(DISTINCT key) FILTER (veg AND counted) AS veg_aside,
    count(DISTINCT key) FILTER (classification = 'vegan' AND counted) AS vegan_counted, count(DISTINCT key) FILTER (classification = 'vegan') - count(DISTINCT key) FILTER (classification = 'vegan' AND counted) AS vegan_aside
  FROM judged GROUP BY restaurant_id, menu_label
), menus AS (
  SELECT restaurant_id, menu_label, min(o) AS first_place FROM (SELECT restaurant_id, menu_label, display_order AS o FROM menu_sections UNION ALL SELECT restaurant_id, NULL, 999 FROM placed WHERE section_id IS NULL) GROUP BY ALL
), best AS (
  SELECT m.restaurant_id, m.menu_label, coalesce(veg_counted, 0) AS veg_counted, coalesce(veg_aside, 0) AS veg_aside, coalesce(vegan_counted, 0) AS vegan_counted
  FROM menus m LEFT JOIN tallies t ON t.restaurant_id = m.restaurant_id AND t.menu_label IS NOT DISTINCT FROM m.menu_label
  QUALIFY row_number() OVER (PARTITION BY m.restaurant_id ORDER BY coalesce(veg_counted, 0) DESC, first_place, m.menu_label NULLS FIRST) = 1
), firsts AS (
  SELECT * FROM judged WHERE veg AND by_name AND NOT starts_with(key, '#') QUALIFY row_number() OVER (PARTITION BY restaurant_id, key ORDER BY section_order, created_at, id) = 1
), shown AS (
  SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY amount IS NULL, amount DESC, section_order, created_at, id) AS r FROM firsts QUALIFY r <= 3
), high AS (
  SELECT restaurant_id, string_agg(trim(name), '|' ORDER BY r) AS highlights, count(*) < 3 OR bool_and(section IN ('Desserts', 'Sides', 'Nibbles')) AS highlights_thin FROM shown GROUP BY restaurant_id
), insights AS (
  SELECT b.restaurant_id, b.menu_label AS best_menu, veg_counted AS max_veg, veg_aside AS aside, vegan_counted AS vegan, veg_counted - vegan_counted AS vegetarian, coalesce(n, 0) AS total_dishes, highlights, coalesce(highlights_thin, true) AS highlights_thin
  FROM best b LEFT JOIN (SELECT restaurant_id, count(*) AS n FROM judged GROUP BY restaurant_id) USING (restaurant_id) LEFT JOIN high USING (restaurant_id)
)"""
NEEDS = ["restaurants", "featured", "menu_sections", "dishes"]
_names = lambda: F.array_join(F.transform("highlights", lambda h: h["name"]), "|").alias("highlights")


def add(name, run, sql, needs=NEEDS):
    QUERIES[name] = run
    if sql:
        SQL[name] = with_tables(needs, f"WITH {JUDGED} {sql}" if "FROM judged" in sql or "insights" in sql or "tallies" in sql or "placed" in sql or "roles" in sql else sql)


def _judged(spark, d):
    return O.judged(load(spark, d, "dishes"), load(spark, d, "menu_sections"))


def _insights(spark, d):
    return O.guide_insights(load(spark, d, "dishes"), load(spark, d, "menu_sections"))


add("dish_role", lambda s, d: _judged(s, d).select("id", F.col("verdict.role").alias("role"), F.col("verdict.rule").alias("rule"), F.col("verdict.ambiguous").alias("ambiguous")), "SELECT id, role, rule, ambiguous FROM roles")
add("agg_median_price", lambda s, d: O.price_level(load(s, d, "dishes")), "SELECT p.restaurant_id, l.level FROM (SELECT DISTINCT restaurant_id FROM placed) p LEFT JOIN levels l USING (restaurant_id)")
add("agg_menu_tallies", lambda s, d: O.menu_tallies(_judged(s, d)), "SELECT * FROM tallies")
add("agg_guide_insights", lambda s, d: _insights(s, d).withColumn("highlights", _names()), "SELECT * FROM insights")
add("win_highlights", lambda s, d: O.highlights(_judged(s, d)).select("restaurant_id", _names(), "highlights_thin"), "SELECT restaurant_id, highlights, highlights_thin FROM high, (SELECT count(*) FROM insights)")
add("win_split_veg", lambda s, d: O.split_veg(_judged(s, d)), """SELECT restaurant_id, key, name, counted, row_number() OVER (PARTITION BY restaurant_id, counted ORDER BY section_order, created_at, id) AS place FROM (
  SELECT * FROM judged WHERE veg QUALIFY row_number() OVER (PARTITION BY restaurant_id, key ORDER BY counted DESC, section_order, created_at, id) = 1)""")
add("job_public_guide", lambda s, d: O.public_guide(*(load(s, d, n) for n in ("restaurants", "featured", "dishes", "menu_sections"))).withColumn("highlights", _names()), """
SELECT f.city AS guide, row_number() OVER (PARTITION BY f.city ORDER BY max_veg DESC, f.display_order, r.id) AS rank, r.id, r.name, max_veg, aside, best_menu, vegan, vegetarian, total_dishes, highlights, highlights_thin
FROM featured f JOIN restaurants r ON r.id = f.restaurant_id JOIN insights i ON i.restaurant_id = r.id
WHERE NOT hidden AND status = 'done' AND total_dishes >= 7 AND (guide_approved_at IS NOT NULL OR NOT EXISTS (SELECT 1 FROM placed p WHERE p.restaurant_id = r.id AND (p.name = 'Tasting menu' OR p.description = '3 courses')))""")
add("win_guide_rank", lambda s, d: O.public_guide(*(load(s, d, n) for n in ("restaurants", "featured", "dishes", "menu_sections"))).select("guide", "rank", "id"), """
SELECT f.city AS guide, row_number() OVER (PARTITION BY f.city ORDER BY max_veg DESC, f.display_order, r.id) AS rank, r.id
FROM featured f JOIN restaurants r ON r.id = f.restaurant_id JOIN insights i ON i.restaurant_id = r.id
WHERE NOT hidden AND status = 'done' AND total_dishes >= 7 AND (guide_approved_at IS NOT NULL OR NOT EXISTS (SELECT 1 FROM placed p WHERE p.restaurant_id = r.id AND (p.name = 'Tasting menu' OR p.description = '3 courses')))""")
add("join_featured", lambda s, d: O.featured(load(s, d, "featured"), load(s, d, "restaurants"), True).select("guide", "id", "display_order", "hidden", "name", "status"), "SELECT f.city AS guide, r.id, display_order, hidden, name, status FROM featured f JOIN restaurants r ON r.id = f.restaurant_id")
add("agg_result_counts", lambda s, d: O.result_counts(_judged(s, d), load(s, d, "restaurants")), """SELECT r.id AS restaurant_id, coalesce(n, 0) AS all_dishes, coalesce(vegan, 0) AS vegan, coalesce(veg, 0) AS veg, coalesce(menus, 0) AS menus, status = 'done' AND coalesce(n, 0) > 0 AND coalesce(n, 0) < 7 AS thin
FROM restaurants r LEFT JOIN (SELECT restaurant_id, count(*) AS n, count(*) FILTER (classification = 'vegan') AS vegan, count(*) FILTER (veg) AS veg, count(DISTINCT menu_label) AS menus FROM judged GROUP BY 1) x ON x.restaurant_id = r.id""")
add("join_menu_document", lambda s, d: O.menu_documents(load(s, d, "restaurants"), load(s, d, "menu_sections"), load(s, d, "dishes")).select("id", F.md5(F.array_join(F.flatten(F.transform("sections", lambda x: F.transform(x["dishes"], lambda y: F.concat(x["section"], F.lit(":"), y["id"])))), ",")).alias("menu")), """
SELECT r.id, md5(string_agg(section || ':' || p.id, ',' ORDER BY section_order, section, menu_label NULLS FIRST, p.created_at, p.id)) AS menu FROM restaurants r LEFT JOIN placed p ON p.restaurant_id = r.id GROUP BY r.id""")
add("agg_role_exclusions", lambda s, d: O.role_exclusions(_judged(s, d)), """SELECT role, rule, count(*) AS n, count(*) FILTER (section IN ('Desserts', 'Sides', 'Nibbles') OR amount <= q1) AS soft FROM judged j
LEFT JOIN (SELECT restaurant_id AS rid, CASE WHEN count(*) >= 4 THEN list_extract(list_sort(list(amount)), cast(floor(count(*) * 0.25) AS int) + 1) END AS q1 FROM judged WHERE amount IS NOT NULL GROUP BY 1) q ON q.rid = j.restaurant_id WHERE veg AND NOT counted GROUP BY role, rule""")


def _old_and_new(spark, d):
    sections = load(spark, d, "menu_sections")
    rows = O.judged_once(load(spark, d, "dishes"), sections)
    return O.old_and_new_counts(rows, O.insights_of(rows, sections))


add("agg_old_vs_new_counts", _old_and_new, """SELECT i.restaurant_id, max_veg AS after, aside, coalesce(b, 0) AS before FROM insights i
LEFT JOIN (SELECT restaurant_id, max(n) AS b FROM (SELECT restaurant_id, menu_label, count(*) AS n FROM judged WHERE veg GROUP BY 1, 2) GROUP BY 1) USING (restaurant_id)""")
add("win_running_reports", lambda s, d: O.running_reports(load(s, d, "reports")), "SELECT id, dish_id, count(*) OVER (PARTITION BY dish_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS reports, count(*) OVER (PARTITION BY dish_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) >= 3 AS flagged FROM reports", ["reports"])
add("agg_withheld", lambda s, d: O.withheld_featured(load(s, d, "restaurants"), load(s, d, "featured"), O.menu_dishes(load(s, d, "dishes"), load(s, d, "menu_sections"))).select("id", F.array_join("cities", ",").alias("cities"), F.col("reason").startswith('"').alias("flagged")), """
SELECT r.id, f.city AS cities, status = 'done' AND (SELECT count(*) FROM placed p WHERE p.restaurant_id = r.id) >= 7 AS flagged FROM featured f JOIN restaurants r ON r.id = f.restaurant_id WHERE NOT hidden AND NOT (status = 'done' AND (SELECT count(*) FROM placed p WHERE p.restaurant_id = r.id) >= 7
AND (guide_approved_at IS NOT NULL OR NOT EXISTS (SELECT 1 FROM placed p WHERE p.restaurant_id = r.id AND (p.name = 'Tasting menu' OR p.description = '3 courses'))))""")
add("job_guide_page_filter", lambda s, d: O.page_filter(load(s, d, "restaurants").withColumn("areas", F.array("city", F.lit("x"))), ["nation_1", "nation_2", "nation_3"], ["irish", "indian"]).select("id", "city", "cuisine"), "SELECT id, city, cuisine FROM restaurants WHERE city IN ('nation_1', 'nation_2', 'nation_3') AND cuisine IN ('irish', 'indian')", ["restaurants"])
