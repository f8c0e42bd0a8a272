"""Queries of identity, guide membership and the golden set, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import evaluation as E
from larder.operators import identity as I

from .fixtures import load, with_tables
from .scalars import BARE, NORM, SHARED

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, run, needs, sql=""):
    QUERIES[name] = run
    if sql:
        SQL[name] = with_tables(needs, sql)


KEY = f"CASE WHEN {SHARED} THEN {NORM} ELSE {BARE} END"
ASKED = "SELECT DISTINCT 'http://WWW.place' || cast(page_id % 90 AS varchar(20)) || '.ie/x' || cast(page_id % 3 AS varchar(20)) AS url FROM pages UNION SELECT DISTINCT 'https://toasttab.com/place-' || cast(page_id % 90 AS varchar(20)) || '/' AS url FROM pages"


def _asked(s, d):
    return s.sql(ASKED.replace("FROM pages", "FROM {pages}"), pages=s.read.parquet(f"{d}/pages.parquet"))


LIVE = "(SELECT restaurant_id, count(*) AS live, count(*) FILTER (human_verified) AS verified FROM dishes WHERE deleted_at IS NULL GROUP BY 1)"
add("join_url_match", lambda s, d: I.match_restaurants(_asked(s, d), load(s, d, "restaurants")), ["restaurants"], f"""WITH asked AS ({ASKED}), known AS (SELECT id, url FROM restaurants UNION SELECT id, canonical_url FROM restaurants WHERE canonical_url IS NOT NULL),
k AS (SELECT id, {KEY} AS key, {NORM} AS norm FROM known), a AS (SELECT url, {KEY} AS key, {NORM} AS norm FROM asked)
SELECT url, coalesce((SELECT min(id) FROM k WHERE k.key = a.key), (SELECT min(id) FROM k WHERE k.norm = a.norm)) AS restaurant_id FROM a""")
SURV = f"(SELECT id, {KEY} AS dedup_key, first_value(id) OVER (PARTITION BY {KEY} ORDER BY (status = 'done') DESC, coalesce(live, 0) DESC, last_scraped_at DESC NULLS LAST, id) AS keep_id FROM restaurants LEFT JOIN {LIVE} l ON l.restaurant_id = id)"
add("win_survivor", lambda s, d: I.survivors(load(s, d, "restaurants"), load(s, d, "dishes")), ["restaurants", "dishes"], f"SELECT * FROM {SURV}")
add("job_dedupe_restaurants", lambda s, d: I.moved_memberships(load(s, d, "featured"), I.survivors(load(s, d, "restaurants"), load(s, d, "dishes"))), ["restaurants", "dishes", "featured"], f"SELECT keep_id AS restaurant_id, city, min(display_order) AS display_order, bool_and(hidden) AS hidden FROM featured f JOIN {SURV} k ON k.id = f.restaurant_id GROUP BY 1, 2")
add("set_distinct_urls", lambda s, d: I.distinct_urls(load(s, d, "urls").withColumnRenamed("page_id", "ord")), ["urls"], f"SELECT {KEY} AS dedup_key, min(page_id) AS ord, arg_min(url, page_id) AS url FROM urls GROUP BY 1")
add("job_batch_add", lambda s, d: I.batch_add(_asked(s, d).withColumn("ord", F.col("url")), load(s, d, "restaurants")), ["restaurants"], f"""WITH asked AS (SELECT min(url) AS url FROM (SELECT url, {KEY} AS key FROM ({ASKED})) GROUP BY key), known AS (SELECT id, url FROM restaurants UNION SELECT id, canonical_url FROM restaurants WHERE canonical_url IS NOT NULL),
k AS (SELECT id, {KEY} AS key FROM known), a AS (SELECT url, {KEY} AS key FROM asked), m AS (SELECT url, (SELECT min(id) FROM k WHERE k.key = a.key) AS rid FROM a)
SELECT url AS ord, url, CASE WHEN rid IS NULL THEN 'created' ELSE 'existing' END AS result, rid AS restaurant_id, coalesce((SELECT status <> 'done' FROM restaurants r WHERE r.id = rid), true) AS needs_analysis FROM m""")
add("join_guide_filter", lambda s, d: I.by_guide(load(s, d, "restaurants"), load(s, d, "featured"), False).select("id", "city"), ["restaurants", "featured"], "SELECT id, city FROM restaurants WHERE id NOT IN (SELECT restaurant_id FROM featured)")
add("join_live_exists", lambda s, d: I.with_live_dishes(load(s, d, "restaurants"), load(s, d, "dishes")).select("id", "status"), ["restaurants", "dishes"], "SELECT id, status FROM restaurants WHERE id IN (SELECT restaurant_id FROM dishes WHERE deleted_at IS NULL)")
add("win_next_order", lambda s, d: I.next_order(load(s, d, "featured"), load(s, d, "restaurants").selectExpr("id as restaurant_id", "city", "id as ord"), "city").select("restaurant_id", "city", "display_order"), ["restaurants", "featured"], "SELECT id AS restaurant_id, city, coalesce((SELECT max(display_order) FROM featured f WHERE f.city = r.city), -1) + row_number() OVER (PARTITION BY city ORDER BY id) AS display_order FROM restaurants r")
add("job_guide_cleanup", lambda s, d: I.guide_cleanup(load(s, d, "featured"), load(s, d, "restaurants"), load(s, d, "dishes")), ["restaurants", "featured", "dishes"], f"SELECT f.restaurant_id, f.city, CASE WHEN status <> 'done' THEN 'status ' || status ELSE 'only ' || coalesce(live, 0) || ' dishes' END AS reason FROM featured f JOIN restaurants r ON r.id = f.restaurant_id LEFT JOIN {LIVE} l ON l.restaurant_id = r.id WHERE status <> 'done' OR coalesce(live, 0) < 7")
add("job_feature_passed", lambda s, d: I.feature_passed(load(s, d, "restaurants").selectExpr("id as restaurant_id", "city", "id as ord"), load(s, d, "featured"), load(s, d, "restaurants"), load(s, d, "dishes")), ["restaurants", "featured", "dishes"], f"""WITH b AS (SELECT id, city, CASE WHEN status <> 'done' THEN status WHEN coalesce(live, 0) < 7 THEN 'only ' || coalesce(live, 0) || ' dishes' END AS reason FROM restaurants LEFT JOIN {LIVE} l ON l.restaurant_id = id)
SELECT id AS restaurant_id, city, coalesce((SELECT max(display_order) FROM featured f WHERE f.city = b.city), -1) + row_number() OVER (PARTITION BY city ORDER BY id) AS display_order, reason FROM b WHERE reason IS NULL AND id NOT IN (SELECT restaurant_id FROM featured)
UNION ALL SELECT id, city, NULL, reason FROM b WHERE reason IS NOT NULL""")
CHANGES = "SELECT id AS seq, id % 50 AS restaurant_id, city, CASE id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'hide' ELSE 'show' END AS change FROM restaurants"
add("job_guide_membership", lambda s, d: I.apply_membership(load(s, d, "featured"), s.sql(CHANGES.replace("FROM restaurants", "FROM {r}"), r=load(s, d, "restaurants"))), ["restaurants", "featured"], f"""WITH c AS ({CHANGES}), l AS (SELECT restaurant_id, city, arg_max(change, seq) AS change, max(seq) AS seq FROM c GROUP BY 1, 2)
SELECT f.restaurant_id, f.city, display_order, CASE WHEN change = 'hide' THEN true WHEN change = 'show' THEN false ELSE hidden END AS hidden FROM featured f LEFT JOIN l ON l.restaurant_id = f.restaurant_id AND l.city = f.city WHERE change IS NULL OR change <> 'remove'
UNION ALL SELECT restaurant_id, city, coalesce((SELECT max(display_order) FROM featured f WHERE f.city = n.city), -1) + row_number() OVER (PARTITION BY city ORDER BY seq), change = 'hide' FROM l n WHERE change <> 'remove' AND NOT EXISTS (SELECT 1 FROM featured f WHERE f.restaurant_id = n.restaurant_id AND f.city = n.city)""")
OUTC = "SELECT id AS seq, id % 60 AS id, CASE id % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'no_menu' ELSE 'error' END AS status, CASE WHEN id % 3 = 1 THEN 'not_listed' END AS reason FROM feedback"
add("job_status_updates", lambda s, d: I.status_updates(load(s, d, "restaurants"), s.sql(OUTC.replace("FROM feedback", "FROM {f}"), f=load(s, d, "feedback"))).select("id", "status", "no_menu_reason", "no_menu_confirmed_at"), ["restaurants", "feedback"], f"""WITH o AS (SELECT id, arg_max(status, seq) AS st, max_by(coalesce(reason, '-'), seq) AS re FROM ({OUTC}) GROUP BY 1)
SELECT r.id, coalesce(st, status) AS status, CASE WHEN st IS NULL THEN no_menu_reason WHEN st = 'no_menu' THEN nullif(re, '-') END AS no_menu_reason, CASE WHEN st IS NULL THEN no_menu_confirmed_at END AS no_menu_confirmed_at FROM restaurants r LEFT JOIN o ON o.id = r.id""")
add("job_cascade_delete", lambda s, d: I.cascade_delete(load(s, d, "restaurants").filter("status = 'error'").selectExpr("id as restaurant_id"), dishes=load(s, d, "dishes"))["dishes"].groupBy("restaurant_id").agg(F.count("*").alias("n")), ["restaurants", "dishes"], "SELECT restaurant_id, count(*) AS n FROM dishes WHERE restaurant_id NOT IN (SELECT id FROM restaurants WHERE status = 'error') GROUP BY 1")
add("page_restaurants", lambda s, d: I.restaurant_page(load(s, d, "restaurants"), search="place1", size=20, offset=2).select("id", "url"), ["restaurants"], "SELECT id, url FROM restaurants WHERE contains(lower(name), 'place1') OR contains(lower(url), 'place1') ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 2")
add("top_recent_restaurants", lambda s, d: I.restaurant_page(load(s, d, "restaurants"), size=25).select("id", "name"), ["restaurants"], "SELECT id, name FROM restaurants ORDER BY created_at DESC, id DESC LIMIT 25")
add("snk_upsert", lambda s, d: E.upsert_verdicts(load(s, d, "eval_candidates")).select("case_id", "label", "verdict"), ["eval_candidates"], "SELECT case_id, label, verdict FROM eval_candidates QUALIFY row_number() OVER (PARTITION BY case_id, lower(label) ORDER BY id DESC) = 1")
add("win_label_suffix", lambda s, d: I.label_suffix(load(s, d, "eval_candidates"), F.col("label"), ["case_id"], ["id"]).select("id", "label"), ["eval_candidates"], "SELECT id, CASE WHEN n = 1 THEN label ELSE label || ' ' || n END AS label FROM (SELECT id, label, row_number() OVER (PARTITION BY case_id, lower(label) ORDER BY id) AS n FROM eval_candidates)")

add("agg_dish_accuracy", lambda s, d: E.dish_accuracy(load(s, d, "eval_dishes")), ["eval_dishes"], "SELECT count(*) AS scored, count(*) FILTER (expected = ai_original) AS correct, count(*) FILTER (expected = ai_original) * 100 / count(*) AS pct, count(*) FILTER (expected = 'neither' AND ai_original IN ('vegan', 'vegetarian')) AS unsafe FROM eval_dishes WHERE ai_original IS NOT NULL")
add("agg_confusion", lambda s, d: E.confusion(load(s, d, "eval_dishes")), ["eval_dishes"], "SELECT e.expected, " + ", ".join(f"count(*) FILTER (ai_original = '{x}') AS {x}" for x in E.LABELS) + " FROM (VALUES ('vegan'), ('vegetarian'), ('neither'), ('unknown')) e(expected) LEFT JOIN eval_dishes d ON d.expected = e.expected GROUP BY 1")
add("join_eval_live", lambda s, d: E.eval_live(load(s, d, "eval_cases"), load(s, d, "restaurants")), ["eval_cases", "restaurants"], "SELECT c.id AS case_id, coalesce((SELECT min(r.id) FROM restaurants r WHERE lower(r.url) = lower(c.url)), (SELECT min(r.id) FROM restaurants r WHERE lower(r.canonical_url) = lower(c.url))) AS restaurant_id FROM eval_cases c")
GOLD = "(SELECT restaurant_id % 60 AS case_id, lower(trim(name)) AS k FROM dishes WHERE deleted_at IS NULL)"
_live = lambda s, d: load(s, d, "dishes").filter("deleted_at is null").selectExpr("restaurant_id % 60 as case_id", "name")
add("join_eval_coverage", lambda s, d: E.eval_coverage(load(s, d, "eval_dishes"), _live(s, d)).select("id", "case_id"), ["eval_dishes", "dishes"], f"SELECT id, case_id FROM eval_dishes e WHERE EXISTS (SELECT 1 FROM {GOLD} g WHERE g.case_id = e.case_id AND g.k = lower(trim(e.name)))")
add("agg_eval_case_score", lambda s, d: E.score_cases(load(s, d, "eval_cases"), load(s, d, "eval_dishes"), _live(s, d)).withColumn("unsafe", F.array_join("unsafe", ",")), ["eval_cases", "eval_dishes", "dishes"], f"""SELECT c.id AS case_id, count(e.id) AS total, count(ai_original) AS scored, count(*) FILTER (ai_original = expected) AS correct, coalesce(string_agg(trim(name), ',' ORDER BY trim(name)) FILTER (expected = 'neither' AND ai_original IN ('vegan', 'vegetarian')), '') AS unsafe,
count(*) FILTER (EXISTS (SELECT 1 FROM {GOLD} g WHERE g.case_id = e.case_id AND g.k = lower(trim(e.name)))) AS still_live, count(*) FILTER (ai_original = expected) * 100 / nullif(count(ai_original), 0) AS pct FROM eval_cases c LEFT JOIN eval_dishes e ON e.case_id = c.id GROUP BY 1""")
add("agg_discovery_accuracy", lambda s, d: E.discovery_accuracy(load(s, d, "eval_cases"), load(s, d, "eval_candidates")), ["eval_cases", "eval_candidates"], "WITH r AS (SELECT * FROM eval_cases WHERE menus_reviewed_at IS NOT NULL), k AS (SELECT count(*) AS clean FROM r WHERE coalesce(trim(missed_menus), '') = '' AND id NOT IN (SELECT case_id FROM eval_candidates WHERE verdict <> 'correct')) SELECT (SELECT count(*) FROM r) AS reviewed, clean, clean * 100 / nullif((SELECT count(*) FROM r), 0) AS pct FROM k")
add("agg_corrections", lambda s, d: E.correction_log(load(s, d, "eval_cases"), load(s, d, "eval_dishes"), load(s, d, "eval_candidates")), ["eval_cases", "eval_dishes", "eval_candidates"], """SELECT case_id, CASE WHEN expected = 'neither' AND ai_original IN ('vegan', 'vegetarian') THEN '1 unsafe' ELSE '2 misread' END AS kind, trim(name) || ' ' || ai_original || ' -> ' || expected AS detail FROM eval_dishes WHERE ai_original <> expected
UNION ALL SELECT case_id, '3 ' || verdict, label FROM eval_candidates WHERE verdict <> 'correct' UNION ALL SELECT id, '4 missed', trim(missed_menus) FROM eval_cases WHERE trim(missed_menus) <> ''""")
ACT = "CASE kind WHEN 'wrong_classification' THEN 'reclassify' WHEN 'not_a_dish' THEN 'remove_dish' WHEN 'dish_removed' THEN 'remove_dish' WHEN 'duplicate_dish' THEN 'remove_dish' WHEN 'not_a_menu' THEN 'remove_menu' WHEN 'menu_outdated' THEN 'reparse' WHEN 'wrong_name' THEN 'rename' ELSE 'route' END"
BOX = "(SELECT 'dish' AS about, id, restaurant_id, issue_type AS kind, dish_id, created_at, status FROM reports UNION ALL SELECT 'restaurant', id, restaurant_id, feedback_type, NULL, created_at, status FROM feedback)"
_box = lambda s, d: E.feedback_inbox(load(s, d, "reports"), load(s, d, "feedback"), load(s, d, "restaurants"))
add("join_feedback_inbox", lambda s, d: _box(s, d).drop("created_at"), ["reports", "feedback", "restaurants"], f"SELECT about, b.id, restaurant_id, kind, dish_id, b.status, r.name AS restaurant, {ACT} AS action FROM {BOX} b LEFT JOIN restaurants r ON r.id = restaurant_id")
add("set_inbox", lambda s, d: _box(s, d).groupBy("about", "action", "status").agg(F.count("*").alias("n")), ["reports", "feedback", "restaurants"], f"SELECT about, {ACT} AS action, status, count(*) AS n FROM {BOX} GROUP BY 1, 2, 3")
add("sort_inbox", lambda s, d: _box(s, d).orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "about"), ["reports", "feedback", "restaurants"], f"SELECT id, about FROM {BOX} ORDER BY created_at DESC, id DESC LIMIT 100")
add("join_restaurant_feedback", lambda s, d: E.restaurant_feedback(_box(s, d), 7).select("about", "id", "kind"), ["reports", "feedback"], f"SELECT about, id, kind FROM {BOX} WHERE restaurant_id = 7")
add("agg_review_badges", lambda s, d: E.review_badges(*(load(s, d, n) for n in ("restaurants", "dishes", "eval_cases", "reports", "feedback"))), ["restaurants", "dishes", "eval_cases", "reports", "feedback"], f"""SELECT r.id, EXISTS (SELECT 1 FROM (SELECT {NORM} AS u FROM eval_cases WHERE menus_reviewed_at IS NOT NULL) c WHERE c.u = {NORM.replace('url', 'r.url')} OR c.u = {NORM.replace('url', 'r.canonical_url')}) AS menus_reviewed,
coalesce(verified, 0) AS reviewed_dishes, coalesce(live, 0) AS live_dishes, (SELECT count(*) FROM reports p WHERE p.status = 'open' AND p.restaurant_id = r.id) + (SELECT count(*) FROM feedback p WHERE p.status = 'open' AND p.restaurant_id = r.id) AS open_feedback FROM restaurants r LEFT JOIN {LIVE} l ON l.restaurant_id = r.id""")
add("join_reviewed_urls", lambda s, d: E.review_badges(*(load(s, d, n) for n in ("restaurants", "dishes", "eval_cases", "reports", "feedback"))).filter("menus_reviewed").select("id"), ["restaurants", "eval_cases"], f"SELECT id FROM restaurants r WHERE EXISTS (SELECT 1 FROM (SELECT {NORM} AS u FROM eval_cases WHERE menus_reviewed_at IS NOT NULL) c WHERE c.u = {NORM.replace('url', 'r.url')} OR c.u = {NORM.replace('url', 'r.canonical_url')})")
add("agg_dish_counts", lambda s, d: E.dish_counts(load(s, d, "dishes")), ["dishes"], f"SELECT * FROM {LIVE}")
add("agg_fetch_failures", lambda s, d: E.fetch_failures(load(s, d, "restaurants"), load(s, d, "dishes")), ["restaurants", "dishes"], f"SELECT id, status, coalesce(live, 0) AS live FROM restaurants LEFT JOIN {LIVE} l ON l.restaurant_id = id WHERE status IN ('error', 'no_menu') OR (status = 'done' AND live IS NULL)")
add("agg_low_dish", lambda s, d: E.low_dish(load(s, d, "restaurants"), load(s, d, "dishes"), 590), ["restaurants", "dishes"], f"SELECT id, live FROM restaurants JOIN {LIVE} l ON l.restaurant_id = id WHERE status = 'done' AND live < 590")
add("join_hallucinated", lambda s, d: E.hallucinated(load(s, d, "dishes"), load(s, d, "restaurants")), ["dishes", "restaurants"], "SELECT d.id AS dish_id, restaurant_id, d.name AS dish, r.name, r.url FROM dishes d LEFT JOIN restaurants r ON r.id = restaurant_id WHERE deleted_at IS NOT NULL AND origin = 'ai'")
add("join_reported_dishes", lambda s, d: E.report_activity(load(s, d, "dishes"), load(s, d, "restaurants")), ["dishes", "restaurants"], "SELECT t.*, r.name FROM (SELECT id AS dish_id, restaurant_id, name AS dish, raw_reports FROM dishes WHERE raw_reports > 0 ORDER BY raw_reports DESC, id LIMIT 50) t JOIN restaurants r ON r.id = restaurant_id")
add("win_original_guess", lambda s, d: E.first_guess(load(s, d, "eval_dishes").selectExpr("case_id", "name", "id as seq", "ai_original as ai_guess", "expected")), ["eval_dishes"], "SELECT case_id, arg_max(name, id) AS name, arg_max(expected, id) AS expected, arg_min(ai_original, id) FILTER (ai_original IS NOT NULL) AS ai_original FROM eval_dishes GROUP BY case_id, lower(trim(name))")
add("set_eval_export", lambda s, d: E.eval_export(load(s, d, "eval_dishes"), load(s, d, "eval_candidates"), load(s, d, "eval_cases")), ["eval_dishes", "eval_candidates", "eval_cases"], "SELECT 'dish' AS kind, case_id, name AS what, expected AS verdict FROM eval_dishes UNION ALL SELECT 'menu', case_id, label, verdict FROM eval_candidates UNION ALL SELECT 'missed', id, missed_menus, NULL FROM eval_cases WHERE trim(missed_menus) <> ''")
add("job_ensure_cases", lambda s, d: E.ensure_cases(load(s, d, "eval_cases"), load(s, d, "urls").select("url")), ["eval_cases", "urls"], "SELECT min(url) AS url FROM urls WHERE lower(url) NOT IN (SELECT lower(url) FROM eval_cases) GROUP BY lower(url)")
add("agg_guide_counts", lambda s, d: load(s, d, "featured").groupBy("city").agg(F.count("*").alias("total"), F.count_if(~F.col("hidden")).alias("visible")), ["featured"], "SELECT city, count(*) AS total, count(*) FILTER (NOT hidden) AS visible FROM featured GROUP BY 1")
add("agg_distinct_filters", lambda s, d: load(s, d, "restaurants").groupBy("city").agg(F.array_join(F.array_sort(F.collect_set("cuisine")), ",").alias("cuisines")), ["restaurants"], "SELECT city, coalesce(string_agg(DISTINCT cuisine, ',' ORDER BY cuisine), '') AS cuisines FROM restaurants GROUP BY 1")
add("sort_no_menu_queue", lambda s, d: load(s, d, "restaurants").filter("status = 'no_menu' and no_menu_confirmed_at is null").join(E.review_badges(*(load(s, d, n) for n in ("restaurants", "dishes", "eval_cases", "reports", "feedback"))), "id").orderBy(F.desc("created_at")).select("id", "open_feedback"), ["restaurants", "reports", "feedback"], "SELECT id, (SELECT count(*) FROM reports p WHERE p.status = 'open' AND p.restaurant_id = r.id) + (SELECT count(*) FROM feedback p WHERE p.status = 'open' AND p.restaurant_id = r.id) AS open_feedback FROM restaurants r WHERE status = 'no_menu' AND no_menu_confirmed_at IS NULL")
