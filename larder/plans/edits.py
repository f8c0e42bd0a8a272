"""Queries of editors' batch jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import editing as E
from larder.sources.scratch import stored_alone

from . import fixtures
from .fixtures import load, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

fixtures.TABLES["cities"] = """
SELECT n_name AS city, 'country' || cast(n_nationkey AS varchar(20)) AS country, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"""
fixtures.TABLES["city_votes"] = """
SELECT cast(c_custkey AS bigint) AS id, CASE c_custkey % 5 WHEN 0 THEN lower(n_name) WHEN 1 THEN '  ' || n_name || ' ' WHEN 2 THEN 'Some   Where' WHEN 3 THEN 'x' ELSE n_name END AS city,
  'country' || cast(n_nationkey + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS varchar(20)) AS country, CASE WHEN c_custkey % 7 <> 0 THEN r_name END AS region, c_custkey % 5 = 2 AS is_custom
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
fixtures.TABLES["chunks"] = """
SELECT DISTINCT restaurant_id, display_order % 4 AS chunk,
  CASE (restaurant_id + display_order % 4) % 3 WHEN 0 THEN 'Place ' || cast(display_order % 4 AS varchar(20)) WHEN 1 THEN '' END AS restaurant_name,
  CASE WHEN (restaurant_id + display_order % 4) % 5 = 0 THEN 'en' END AS language,
  CASE WHEN (restaurant_id * 3 + display_order % 4) % 4 = 0 THEN 'irish' || cast(display_order % 4 AS varchar(20)) END AS cuisine
FROM menu_sections"""
fixtures.TABLES["added_menus"] = """
SELECT cast(s_suppkey AS bigint) AS restaurant_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Brunch' ELSE 'Late' END AS label, cast(r_regionkey AS int) AS ord, 'Section ' || cast(r_regionkey AS varchar(20)) AS section,
  CASE WHEN (s_suppkey + r_regionkey) % 4 <> 0 THEN 'Dish ' || cast(s_suppkey * 5 + r_regionkey AS varchar(20)) END AS name, cast(NULL AS varchar(20)) AS description, '9' AS price, 'vegan' AS classification, cast(0.9 AS double) AS confidence
FROM supplier CROSS JOIN region WHERE s_suppkey % 6 = 1"""
fixtures.TABLES["resolutions"] = """
SELECT 'dish_report' AS kind, id, issue_type AS type, CASE WHEN id % 4 = 0 THEN 'dismissed' ELSE 'confirmed' END AS status, dish_id, cast(NULL AS bigint) AS restaurant_id, CASE WHEN id % 3 = 0 THEN 'vegan' END AS proposed_classification, cast(NULL AS varchar(20)) AS menu_label, cast(NULL AS varchar(20)) AS proposed_name FROM reported
UNION ALL
SELECT 'restaurant_feedback', id, feedback_type, CASE WHEN id % 4 = 1 THEN 'dismissed' ELSE 'confirmed' END, cast(NULL AS varchar(20)), CASE WHEN id % 9 <> 0 THEN restaurant_id END, cast(NULL AS varchar(20)), CASE id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' END, CASE id % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' New name ' END FROM feedback"""
# reports that name dishes of the table, and some that are gone
fixtures.TABLES["reported"] = """
SELECT row_number() OVER (ORDER BY id) AS id, CASE WHEN raw_reports = 3 THEN 'gone' ELSE id END AS dish_id, CASE raw_reports WHEN 1 THEN 'wrong_classification' WHEN 2 THEN 'not_a_dish' WHEN 3 THEN 'dish_removed' ELSE 'other' END AS issue_type
FROM dishes WHERE raw_reports > 0"""


def add(name, run, needs, sql):
    QUERIES[name] = run
    SQL[name] = with_tables(needs, sql)


add(
    "join_vote_city",
    lambda s, d: E.validate_votes(load(s, d, "city_votes"), load(s, d, "cities")),
    ["city_votes", "cities"],
    r"""WITH v AS (SELECT id, trim(regexp_replace(city, '\s+', ' ', 'g')) AS c, country, region, is_custom FROM city_votes),
e AS (SELECT v.*, k.city AS known, CASE WHEN length(c) < 2 THEN 'city' WHEN is_custom AND v.region IS NULL THEN 'region' WHEN NOT is_custom AND k.city IS NULL THEN 'not listed' END AS error
  FROM v LEFT JOIN cities k ON NOT is_custom AND lower(k.city) = lower(c) AND k.country = v.country AND k.region = v.region)
SELECT id, CASE WHEN error IS NULL THEN coalesce(known, c) END AS city, CASE WHEN error IS NULL AND NOT is_custom THEN country END AS country, CASE WHEN error IS NULL THEN region END AS region, error FROM e""",
)


def _merged(s, d):
    own = load(s, d, "menu_sections").selectExpr("restaurant_id", "display_order % 4 as chunk", "id as ord")
    heads, sections = E.merge_chunks(load(s, d, "chunks"), own)
    listed = sections.groupBy("restaurant_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "ord"))), lambda x: x["ord"]), ",").alias("sections"))
    return heads.join(listed, "restaurant_id", "left")


add(
    "set_menu_sections",
    _merged,
    ["chunks", "menu_sections"],
    """SELECT h.*, l.sections FROM (SELECT restaurant_id, arg_min(restaurant_name, chunk) FILTER (restaurant_name <> '') AS restaurant_name, arg_min(language, chunk) FILTER (language <> '') AS language, arg_min(cuisine, chunk) FILTER (cuisine <> '') AS cuisine FROM chunks GROUP BY 1) h
LEFT JOIN (SELECT restaurant_id, string_agg(id, ',' ORDER BY display_order % 4, id) AS sections FROM menu_sections GROUP BY 1) l USING (restaurant_id)""",
)


def _added(s, d):
    out = E.add_menus(load(s, d, "restaurants"), load(s, d, "menu_sections"), load(s, d, "added_menus"))
    n = out.dishes.groupBy(F.col("section_id").alias("id")).agg(F.count("*").alias("dishes"))
    state = out.restaurants.select(F.col("id").alias("restaurant_id"), "status", "no_menu_reason")
    verdicts = out.verdicts.select("restaurant_id", F.col("label").alias("menu_label"), "verdict")
    rows = out.sections.join(n, "id", "left").join(state, "restaurant_id").join(verdicts, ["restaurant_id", "menu_label"])
    return rows.select("restaurant_id", "id", "name", "display_order", "menu_label", F.coalesce("dishes", F.lit(0)).alias("dishes"), "status", "no_menu_reason", "verdict")


add(
    "job_add_menu",
    _added,
    ["added_menus", "menu_sections", "restaurants"],
    """SELECT a.restaurant_id, a.restaurant_id || '-' || label || '-' || (coalesce(l.o, -1) + 1 + ord) AS id, section AS name, coalesce(l.o, -1) + 1 + ord AS display_order, label AS menu_label, CASE WHEN name IS NULL THEN 0 ELSE 1 END AS dishes, 'done' AS status, NULL AS no_menu_reason, 'correct' AS verdict
FROM added_menus a LEFT JOIN (SELECT restaurant_id, max(display_order) AS o FROM menu_sections GROUP BY 1) l USING (restaurant_id)""",
)


def _resolved(s, d):
    out = E.resolve_feedback(load(s, d, "resolutions"), load(s, d, "dishes"), load(s, d, "restaurants"), load(s, d, "menu_sections"))
    done = out.verdicts.selectExpr("'dish_report' as kind", "seq as id", "concat(action, ':', dish_id, ':', coalesce(classification, '')) as effect")
    done = done.union(out.removals.selectExpr("'restaurant_feedback'", "seq", "concat('clear:', restaurant_id, ':', coalesce(menu_label, ''))"))
    done = done.union(out.renames.selectExpr("'restaurant_feedback'", "seq", "concat('name:', restaurant_id, ':', name)"))
    return out.items.join(done, ["kind", "id"], "left")


RESOLVED = """WITH n AS (SELECT d.restaurant_id AS r, s.menu_label AS l, count(*) AS n FROM dishes d JOIN menu_sections s ON s.id = d.section_id AND s.restaurant_id = d.restaurant_id GROUP BY 1, 2),
x AS (SELECT i.*, d.id IS NOT NULL AND e.id IS NOT NULL AS dish_ok, r.id IS NOT NULL AS place_ok, coalesce(n.n, 0) AS n, nullif(trim(proposed_name), '') AS new_name
  FROM resolutions i LEFT JOIN dishes d ON d.id = i.dish_id LEFT JOIN restaurants e ON e.id = d.restaurant_id LEFT JOIN restaurants r ON r.id = i.restaurant_id LEFT JOIN n ON n.r = i.restaurant_id AND n.l IS NOT DISTINCT FROM i.menu_label),
y AS (SELECT *, CASE WHEN status <> 'confirmed' THEN 'dismissed'
  WHEN kind = 'dish_report' AND dish_ok AND type IN ('not_a_dish', 'dish_removed') THEN 'removed_dish'
  WHEN kind = 'dish_report' AND dish_ok AND type = 'wrong_classification' AND proposed_classification IS NOT NULL THEN 'reclassified:' || proposed_classification
  WHEN kind = 'restaurant_feedback' AND place_ok AND type = 'not_a_menu' THEN 'removed_menu:' || coalesce(menu_label, '(unlabeled)') || ' (' || n || ' dishes)'
  WHEN kind = 'restaurant_feedback' AND place_ok AND type = 'wrong_name' AND new_name IS NOT NULL THEN 'renamed:' || new_name
  WHEN kind = 'restaurant_feedback' AND place_ok AND type = 'menu_outdated' THEN 'reparsed' ELSE 'routed_to_review' END AS resolution_action FROM x)
"""
add(
    "job_resolve_feedback",
    _resolved,
    ["resolutions", "dishes", "restaurants", "menu_sections"],
    RESOLVED
    + """SELECT kind, id, resolution_action, CASE WHEN resolution_action = 'removed_dish' THEN 'delete:' || dish_id || ':' WHEN starts_with(resolution_action, 'reclassified') THEN 'upsert:' || dish_id || ':' || proposed_classification
  WHEN starts_with(resolution_action, 'removed_menu') THEN 'clear:' || restaurant_id || ':' || coalesce(menu_label, '') WHEN starts_with(resolution_action, 'renamed') THEN 'name:' || restaurant_id || ':' || new_name END AS effect FROM y""",
)


def _applied(s, d):
    """What changed, a row a thing: dishes with another class or gone, removed sections, new names, golden rows."""
    # derived tables are aggregates of the largest ones, so those that are read again and again are written once
    read = ["id", "restaurant_id", "section_id", "name", "classification", "human_verified", "deleted_at"]
    dishes, sections, restaurants = stored_alone(load(s, d, "dishes").select(*read), "dishes"), stored_alone(load(s, d, "menu_sections"), "sections"), load(s, d, "restaurants")
    out = E.apply_resolved(E.resolve_feedback(load(s, d, "resolutions"), dishes, restaurants, sections), dishes, sections, restaurants, F.expr("timestamp '2024-03-01 00:00:00'"))
    row = lambda kind, key, value: [F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), value.alias("value")]
    join = lambda *columns: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    parts = [
        out.dishes.select(*row("dish", "id", F.concat_ws("|", "classification", F.col("deleted_at").isNull().cast("string"), F.col("human_verified").cast("string")))),
        out.sections.select(*row("section", "id", F.lit("left"))),
        out.restaurants.select(*row("restaurant", "id", F.col("name"))),
        out.golden.select(*row("golden", "dish_id", join("restaurant_id", "name", "section", "menu_label", "expected", "ai_original", "source"))),
        out.spurious.select(*row("spurious", "restaurant_id", join("label", "verdict"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


add(
    "job_apply_feedback",
    _applied,
    ["resolutions", "dishes", "restaurants", "menu_sections"],
    RESOLVED
    + """, menus AS (SELECT DISTINCT restaurant_id, menu_label FROM y WHERE starts_with(resolution_action, 'removed_menu')),
gone AS (SELECT s.id, s.restaurant_id FROM menu_sections s JOIN menus m ON m.restaurant_id = s.restaurant_id AND m.menu_label IS NOT DISTINCT FROM s.menu_label),
said AS (SELECT dish_id, arg_max(CASE WHEN resolution_action = 'removed_dish' THEN '' ELSE proposed_classification END, id) AS c FROM y WHERE resolution_action = 'removed_dish' OR starts_with(resolution_action, 'reclassified') GROUP BY 1),
gold AS (SELECT dish_id, arg_max(proposed_classification, id) AS c FROM y WHERE starts_with(resolution_action, 'reclassified') GROUP BY 1),
named AS (SELECT restaurant_id, arg_max(new_name, id) AS name FROM y WHERE starts_with(resolution_action, 'renamed') GROUP BY 1)
SELECT 'dish' AS kind, d.id AS key, coalesce(nullif(c, ''), classification) || '|' || CASE WHEN c = '' THEN false WHEN c IS NULL THEN deleted_at IS NULL ELSE true END || '|' || (human_verified OR c IS NOT NULL) AS value
  FROM dishes d LEFT JOIN said ON dish_id = d.id WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = d.section_id AND g.restaurant_id = d.restaurant_id)
UNION ALL SELECT 'section', id, 'left' FROM menu_sections s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.id = s.id AND g.restaurant_id = s.restaurant_id)
UNION ALL SELECT 'restaurant', CAST(r.id AS VARCHAR), coalesce(n.name, r.name) FROM restaurants r LEFT JOIN named n ON n.restaurant_id = r.id
UNION ALL SELECT 'golden', g.dish_id, d.restaurant_id || '|' || d.name || '|' || coalesce(s.name, '-') || '|' || coalesce(s.menu_label, '-') || '|' || c || '|' || classification || '|feedback_confirmed' FROM gold g JOIN dishes d ON d.id = g.dish_id LEFT JOIN menu_sections s ON s.id = d.section_id AND s.restaurant_id = d.restaurant_id
UNION ALL SELECT 'spurious', CAST(restaurant_id AS VARCHAR), coalesce(menu_label, '(unlabeled menu)') || '|spurious' FROM menus""",
)
