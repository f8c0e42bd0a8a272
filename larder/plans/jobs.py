"""Queries of extraction, merging and places, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import extraction as X
from larder.operators import geo as G

from . import fixtures
from .fixtures import load, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

fixtures.TABLES["extracted"] = """
SELECT restaurant_id, CASE WHEN raw_reports % 3 = 0 THEN 'Lunch' WHEN restaurant_id % 5 = 0 THEN 'Lunch' ELSE 'Dinner' END AS menu, CASE WHEN classification = 'vegan' THEN 'Veg' END AS own_label, CASE WHEN origin = 'admin' THEN 'Drinks' ELSE 'Food' END AS section, name, description, price, classification, confidence, id AS ord, id
FROM dishes WHERE raw_reports <> 3"""
fixtures.TABLES["candidates"] = """
SELECT doc_id AS ord, cast(doc_id % 40 AS bigint) AS site, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'subpage' ELSE 'image' END AS type,
  'https://site.ie/' || CASE doc_id % 4 WHEN 0 THEN 'en/' WHEN 1 THEN 'nl/' WHEN 2 THEN '' ELSE 'de/' END || 'menu' || cast(doc_id % 6 AS varchar(20)) AS ref, CASE doc_id % 9 WHEN 0 THEN 'kids menu' WHEN 1 THEN 'gift voucher' ELSE 'menu' END AS hint, quality = 0 AS validated, cast(doc_id % 4 AS bigint) AS grp FROM labels"""


def add(name, run, needs, sql=""):
    QUERIES[name] = run
    if sql:
        SQL[name] = with_tables(needs, sql)


def _old(s, d):
    return load(s, d, "dishes").selectExpr("id", "id as old_id", "restaurant_id", "id as ord", "name", "case when origin = 'admin' then 'Drinks' else 'Food' end as section", "classification", "confidence", "classification as ai_classification", "human_verified", "cast(null as string) as notes", "deleted_at", "greatest(raw_reports, 0) as report_count")


DRINK = "regexp_matches(lower(name), 'wine|beer|lager|ale|stout|porter|cider|cocktail|spirit|whisk|gin|vodka|rum|prosecco|champagne|sparkling|still water|mineral water|soft drink|cola|lemonade|juice|smoothie|coffee|espresso|cappuccino|latte|americano|tea|hot chocolate')"
HEAD = r"(regexp_matches(name, '(?i)\b(menu|selection|tasting|platter|board|sample)\b') AND description IS NULL AND price IS NULL)"
NM = r"trim(regexp_replace(regexp_replace(lower(name), '\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))"
add("job_clean_menu", lambda s, d: X.clean_menu(load(s, d, "extracted")).select("id", "restaurant_id", "name"), ["extracted"], rf"SELECT id, restaurant_id, name FROM extracted WHERE section <> 'Drinks' AND NOT {DRINK} AND NOT (regexp_matches(name, '(?i)\b(menu|selection|platter|board|option)s?\b$') AND description IS NULL AND price IS NULL)")
VALID = f"(SELECT restaurant_id, menu, count(*) AS items, count(*) FILTER ({HEAD}) AS headings, count(*) >= 7 AND count(*) FILTER ({HEAD}) / count(*) <= 0.3 AS strong FROM extracted GROUP BY 1, 2)"
add("agg_menu_validity", lambda s, d: X.extraction_valid(load(s, d, "extracted")), ["extracted"], f"SELECT * FROM {VALID}")
add("agg_select_substantial", lambda s, d: X.select_substantial(load(s, d, "extracted")).groupBy("restaurant_id", "menu").agg(F.count("*").alias("n")), ["extracted"], f"SELECT e.restaurant_id, e.menu, count(*) AS n FROM extracted e JOIN (SELECT *, bool_or(strong) OVER (PARTITION BY restaurant_id) AS a FROM {VALID}) v ON v.restaurant_id = e.restaurant_id AND v.menu = e.menu WHERE strong OR NOT a GROUP BY 1, 2")
MERGED = f"(SELECT *, CASE WHEN menus > 1 THEN menu ELSE coalesce(own_label, menu) END AS label FROM (SELECT e.*, m.menus FROM extracted e JOIN (SELECT restaurant_id AS r, count(DISTINCT menu) AS menus FROM extracted GROUP BY 1) m ON r = restaurant_id))"
add("win_merge_menus", lambda s, d: X.merge_menus(load(s, d, "extracted")).select("id", "menu_label"), ["extracted"], f"SELECT id, CASE WHEN menus > 1 THEN menu ELSE own_label END AS menu_label FROM {MERGED} QUALIFY row_number() OVER (PARTITION BY restaurant_id, lower(label), {NM}, lower(coalesce(price, '')) ORDER BY confidence DESC, ord) = 1")
add("agg_merge_best", lambda s, d: X.merge_menus(load(s, d, "extracted")).groupBy("restaurant_id").agg(F.count("*").alias("n"), F.max("confidence").alias("best")), ["extracted"], f"SELECT restaurant_id, count(*) AS n, max(confidence) AS best FROM (SELECT * FROM {MERGED} QUALIFY row_number() OVER (PARTITION BY restaurant_id, lower(label), {NM}, lower(coalesce(price, '')) ORDER BY confidence DESC, ord) = 1) GROUP BY 1")
add("agg_duplicates", lambda s, d: X.duplicate_dishes(load(s, d, "extracted")), ["extracted"], f"SELECT restaurant_id, count(*) FILTER (n > 1) AS duplicates, sum(dr)::bigint AS drinks FROM (SELECT restaurant_id, menu, {NM} AS k, price, count(*) AS n, count(*) FILTER ({DRINK}) AS dr FROM extracted GROUP BY ALL) GROUP BY 1")
add("win_candidate_dedupe", lambda s, d: X.dedupe_candidates(load(s, d, "candidates")).select("ord", "site"), ["candidates"], "SELECT ord, site FROM (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY site, type, ref ORDER BY validated DESC, ord) = 1) WHERE hint = 'menu'")
add("join_lang_sibling", lambda s, d: X.prefer_english(load(s, d, "candidates")).select("ord", "ref"), ["candidates"], "SELECT ord, ref FROM (SELECT *, bool_or(contains(ref, '/en/')) OVER (PARTITION BY site, regexp_replace(ref, '/(en|nl|de)/', '/*/')) AS h FROM candidates) WHERE NOT regexp_matches(ref, '/(en|nl|de)/') OR NOT h OR contains(ref, '/en/')")
add("join_lang_primary", lambda s, d: X.drop_primary_variants(load(s, d, "candidates"), load(s, d, "candidates").selectExpr("site", "concat('https://site.ie/fr/menu', site % 6) as url").distinct()).select("ord", "type"), ["candidates"], "SELECT ord, type FROM candidates WHERE type <> 'subpage' OR NOT regexp_matches(ref, '/(en|nl|de)/menu') OR NOT ends_with(ref, 'menu' || cast(site % 6 AS varchar))")
add("join_exclude_pdfs", lambda s, d: X.exclude_candidate_pdfs(load(s, d, "candidates").filter("type <> 'pdf'").select("site", "ref", "ord"), load(s, d, "candidates")).select("ord"), ["candidates"], "SELECT ord FROM candidates c WHERE type <> 'pdf' AND NOT EXISTS (SELECT 1 FROM candidates p WHERE p.type = 'pdf' AND p.site = c.site AND p.ref = c.ref)")
add("win_format_pref", lambda s, d: X.pick_formats(load(s, d, "candidates")).select("site", "grp", "ord"), ["candidates"], "SELECT site, grp, ord FROM (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY site, grp ORDER BY CASE type WHEN 'pdf' THEN 0 WHEN 'subpage' THEN 1 ELSE 3 END, ord) = 1) QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord) <= 6")


def _discovered(s, d):
    rows = load(s, d, "candidates")
    k = rows.filter("not endswith(ref, '0')").selectExpr("site", "type", "ref", "cast(right(ref, 1) as int) as k").distinct()
    verdicts = k.selectExpr("site", "type", "ref", "case k when 2 then 'Dinner' else 'Lunch' end as label", "k <> 2 as distinct_menu", "k = 5 as drink_only", "case when k in (3, 4) then 'a' else 'b' end as grp")
    primary = rows.selectExpr("site", "concat('https://site.ie/fr/menu', site % 6) as url").distinct()
    return X.discover_candidates(rows, verdicts, primary, rows.filter("type = 'image'").selectExpr("site + 5 as site", "type", "ref", "ord"))


add("job_discover_candidates", _discovered, ["candidates"], """WITH r AS (SELECT * FROM candidates WHERE type <> 'subpage' OR NOT regexp_matches(ref, '/(en|nl|de)/menu') OR NOT ends_with(ref, 'menu' || cast(site % 6 AS varchar))),
d AS (SELECT *, cast(right(ref, 1) AS int) AS k FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY site, type, ref ORDER BY validated DESC, ord) = 1) WHERE hint = 'menu'),
j AS (SELECT *, CASE k WHEN 0 THEN hint WHEN 2 THEN 'Dinner' ELSE 'Lunch' END AS name, CASE WHEN k = 0 THEN type || ref WHEN k IN (3, 4) THEN 'a' ELSE 'b' END AS g FROM d WHERE k <> 5 AND (k <> 2 OR validated)),
p AS (SELECT *, row_number() OVER (PARTITION BY site, name ORDER BY ord) AS n FROM (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY site, g ORDER BY CASE type WHEN 'pdf' THEN 0 WHEN 'subpage' THEN 1 ELSE 3 END, ord) = 1) QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord) <= 6)
SELECT site, type, ref, CASE WHEN n = 1 THEN name ELSE name || ' ' || n END AS label FROM p
UNION ALL SELECT site + 5, 'image', arg_min(ref, ord), 'Menu' FROM candidates WHERE type = 'image' AND site + 5 NOT IN (SELECT site FROM p) GROUP BY 1""")
OLD = "(SELECT id, restaurant_id, lower(trim(name)) AS k, CASE WHEN origin = 'admin' THEN 'Drinks' ELSE 'Food' END AS section FROM dishes WHERE human_verified)"
HIT = f"(SELECT o.id AS old_id, arg_min(n.id, (CASE WHEN n.section = o.section THEN 0 ELSE 1 END, n.ord)) AS new_id FROM {OLD} o LEFT JOIN extracted n ON n.restaurant_id = o.restaurant_id AND lower(trim(n.name)) = o.k GROUP BY o.id)"
add("join_verified", lambda s, d: X.match_verified(_old(s, d).filter("human_verified"), load(s, d, "extracted")), ["extracted"], f"SELECT * FROM {HIT}")
add("join_rehome_reports", lambda s, d: X.rehome_reports(_old(s, d).filter("human_verified").selectExpr("old_id as dish_id", "old_id as id"), _old(s, d).filter("human_verified"), load(s, d, "extracted")), ["extracted"], f"SELECT new_id AS dish_id, old_id AS id FROM {HIT} WHERE new_id IS NOT NULL")
add("job_reparse_merge", lambda s, d: X.reparse(_old(s, d).drop("old_id"), load(s, d, "extracted"), _old(s, d).selectExpr("id", "id as dish_id"), F.expr("timestamp '2024-03-01 00:00:00'"))[0].select("id", "classification", "human_verified", "report_count", "flagged"), ["extracted"], f"""
WITH old AS (SELECT id, restaurant_id, name, CASE WHEN origin = 'admin' THEN 'Drinks' ELSE 'Food' END AS section, classification, human_verified, greatest(raw_reports, 0) AS reports FROM dishes),
hit AS {HIT},
told AS (SELECT new_id, arg_max(o.classification, o.id) AS classification FROM hit JOIN old o ON o.id = old_id WHERE new_id IS NOT NULL GROUP BY new_id),
own AS (SELECT e.id, e.restaurant_id, e.id AS ord, e.name, e.section, coalesce(t.classification, e.classification) AS classification, t.new_id IS NOT NULL AS human_verified FROM extracted e LEFT JOIN told t ON t.new_id = e.id
  UNION ALL SELECT o.id, o.restaurant_id, o.id, o.name, CASE WHEN EXISTS (SELECT 1 FROM extracted e WHERE e.restaurant_id = o.restaurant_id AND e.section = o.section) THEN o.section END, o.classification, true FROM hit JOIN old o ON o.id = old_id WHERE new_id IS NULL),
found AS (SELECT o.id AS old_id, arg_min(n.id, (CASE WHEN n.section IS NOT DISTINCT FROM o.section THEN 0 ELSE 1 END, n.ord, n.id)) AS new_id FROM old o LEFT JOIN own n ON n.restaurant_id = o.restaurant_id AND lower(trim(n.name)) = lower(trim(o.name)) WHERE o.reports > 0 GROUP BY o.id),
counts AS (SELECT new_id, sum(reports) AS n FROM found JOIN old ON old.id = old_id WHERE new_id IS NOT NULL GROUP BY new_id)
SELECT id, classification, human_verified, CAST(coalesce(n, 0) AS BIGINT) AS report_count, coalesce(n, 0) >= 3 AS flagged FROM own LEFT JOIN counts ON new_id = id
UNION ALL SELECT id, classification, false, reports, reports >= 3 FROM found JOIN old ON old.id = old_id WHERE new_id IS NULL""")
VERD = "SELECT id AS dish_id, raw_reports AS seq, CASE raw_reports WHEN 1 THEN 'delete' WHEN 2 THEN 'restore' ELSE 'upsert' END AS action, CASE WHEN raw_reports = 3 THEN 'neither' END AS classification FROM dishes WHERE raw_reports > 0"
add("job_apply_verdicts", lambda s, d: X.apply_verdicts(load(s, d, "dishes"), s.sql(VERD.replace("FROM dishes", "FROM {x}"), x=load(s, d, "dishes")), F.expr("timestamp '2024-03-01 00:00:00'")).select("id", "classification", "deleted_at", "human_verified", "ai_original"), ["dishes"], "SELECT id, CASE WHEN raw_reports = 3 THEN 'neither' ELSE classification END AS classification, CASE WHEN raw_reports = 1 THEN timestamp '2024-03-01 00:00:00' WHEN raw_reports > 1 THEN NULL ELSE deleted_at END AS deleted_at, human_verified OR raw_reports > 0 AS human_verified, CASE WHEN raw_reports > 0 THEN classification END AS ai_original FROM dishes")

AREAS = "SELECT n_nationkey * 4 + k AS area_id, lower(n_name) AS city, 53.29995 + floor(k / 2) * 0.05 AS lat0, -6.30005 + k % 2 * 0.05 AS lng0, k <> 3 AS active FROM nation, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)"


def _areas(s, d):
    corner = lambda a, b: F.struct((F.col("lng0") + b * 0.05).cast("double").alias("longitude"), (F.col("lat0") + a * 0.05).cast("double").alias("latitude"))
    ring = F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0))
    return s.sql(AREAS.replace("FROM nation", "FROM {n}"), n=s.read.parquet(f"{d}/nation.parquet")).withColumn("rings", F.array(ring))


add("join_neighbourhood", lambda s, d: G.assign_neighbourhoods(load(s, d, "locations"), _areas(s, d)).select("id", F.col("area_id").cast("bigint").alias("area_id")), ["locations"], f"SELECT l.id, min(a.area_id)::bigint AS area_id FROM locations l LEFT JOIN ({AREAS}) a ON a.city = l.city AND a.active AND latitude >= lat0 AND latitude < lat0 + 0.05 AND longitude >= lng0 AND longitude < lng0 + 0.05 GROUP BY 1")
add("job_import_areas", lambda s, d: G.assign_neighbourhoods(load(s, d, "locations"), _areas(s, d).withColumn("active", F.lit(True))).groupBy("area_id").agg(F.count("*").alias("n")).select(F.col("area_id").cast("bigint").alias("area_id"), "n"), ["locations"], f"SELECT area_id, count(*) AS n FROM (SELECT l.id, min(a.area_id)::bigint AS area_id FROM locations l LEFT JOIN ({AREAS}) a ON a.city = l.city AND latitude >= lat0 AND latitude < lat0 + 0.05 AND longitude >= lng0 AND longitude < lng0 + 0.05 GROUP BY 1) GROUP BY 1")
add("join_area_backfill", lambda s, d: G.assign_areas(load(s, d, "locations").withColumn("area", F.lit(None).cast("string"))).select("id", "area"), ["locations"], "SELECT id, CASE WHEN id % 4 = 2 THEN 'D6W' WHEN id % 4 = 0 AND id % 26 IN (1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,20,22,24) THEN 'D' || lpad(cast(id % 26 AS varchar), 2, '0') END AS area FROM locations")
CAND = "SELECT id + 100000 AS id, restaurant_id, address || ' Ireland' AS address, CASE id % 2 WHEN 0 THEN 'medium' ELSE 'high' END AS confidence FROM locations WHERE id % 3 <> 1"
RANK = "CASE {} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
AK = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
ALIKE = f"({AK.format('c.address')} = {AK.format('s.address')} OR (length({AK.format('s.address')}) >= 12 AND length({AK.format('s.address')}) <= length({AK.format('c.address')}) AND (starts_with({AK.format('c.address')}, {AK.format('s.address')} || ' ') OR ends_with({AK.format('c.address')}, ' ' || {AK.format('s.address')}))))"
_cand = lambda s, d: s.sql(CAND.replace("FROM locations", "FROM {l}"), l=load(s, d, "locations"))
add("join_location_upsert", lambda s, d: G.upsert_locations(_cand(s, d), load(s, d, "locations"))[0], ["locations"], f"WITH c AS ({CAND}) SELECT s.id AS stored_id, c.id AS candidate_id FROM c JOIN locations s ON s.restaurant_id = c.restaurant_id AND {ALIKE} WHERE {RANK.format('c.confidence')} >= {RANK.format('s.confidence')} QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY {RANK.format('c.confidence')} DESC, length(c.address) DESC, c.id) = 1")
add("set_locations_backfill", lambda s, d: G.locations_backfill(load(s, d, "locations").selectExpr("restaurant_id", "case when id % 2 = 0 then upper(address) else concat(address, 'x') end as address"), load(s, d, "locations")), ["locations"], "SELECT restaurant_id, address FROM (SELECT restaurant_id, CASE WHEN id % 2 = 0 THEN upper(address) ELSE address || 'x' END AS address FROM locations) a WHERE NOT EXISTS (SELECT 1 FROM locations l WHERE l.restaurant_id = a.restaurant_id AND lower(l.address) = lower(a.address))")
add("job_location_enrich", lambda s, d: G.location_enrich(load(s, d, "restaurants").withColumn("city", F.when(F.col("id") % 2 == 0, "Dublin").otherwise("Cork")), load(s, d, "dishes"), load(s, d, "locations")).select("id", "restaurant_id"), ["locations", "restaurants", "dishes"], "SELECT l.id, l.restaurant_id FROM locations l JOIN restaurants r ON r.id = l.restaurant_id WHERE status = 'done' AND contains(lower(address), CASE WHEN r.id % 2 = 0 THEN 'dublin' ELSE 'cork' END) AND (SELECT count(*) FROM dishes d WHERE d.restaurant_id = r.id AND deleted_at IS NULL) >= 7")
add("loc_dedupe", lambda s, d: G.loc_dedupe(load(s, d, "locations").selectExpr("restaurant_id", "id as ord", "cast(null as string) as label", "address", "latitude", "longitude", "confidence")).select("restaurant_id", "address", "confidence"), [])
add("job_remove_nonfood", lambda s, d: X.remove_nonfood(load(s, d, "dishes"), load(s, d, "menu_sections").withColumn("menu_label", F.when(F.col("menu_label") == "N", "Kids menu").otherwise(F.col("menu_label"))))[0].groupBy("restaurant_id").agg(F.count("*").alias("n")), ["dishes"], "SELECT restaurant_id, count(*) AS n FROM dishes WHERE section_id IS NULL OR NOT contains(section_id, '-N-') GROUP BY 1")
