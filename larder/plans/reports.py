"""Queries of spend and telemetry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import spend as S
from larder.operators import telemetry as T

from .fixtures import load, with_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def money(df, *columns):
    """Decimals as doubles, so that engines with other decimal types give the same values."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def add(name, run, needs, sql=""):
    QUERIES[name] = run
    if sql:
        SQL[name] = with_tables(needs, sql)


L, R, E, A = ["usage_log"], ["restaurants"], ["product_events"], ["attempts"]
add("agg_spend_total", lambda s, d: money(S.spend_total(load(s, d, "usage_log")), "cost"), L, "SELECT count(*) AS calls, cast(sum(cost_usd) AS double) AS cost, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out FROM usage_log")
add("agg_spend_weekly", lambda s, d: money(S.spend_by_week(load(s, d, "usage_log")), "cost"), L, "SELECT cast(date_trunc('week', created_at) AS date) AS week, count(*) AS calls, cast(round(sum(cost_usd), 4) AS double) AS cost FROM usage_log GROUP BY 1")
add("agg_spend_current", lambda s, d: money(S.spend_current(load(s, d, "restaurants")), "cost"), R, "SELECT count(*) AS n, cast(round(sum(cost_usd), 4) AS double) AS cost, sum(tokens_in) AS tokens_in FROM restaurants WHERE status = 'done' AND cost_usd IS NOT NULL")
AT = "timestamp '2024-03-01 00:00:00'"
add("agg_spend_daily", lambda s, d: money(S.spend_by_day(load(s, d, "restaurants"), F.expr(AT)), "cost"), R, f"SELECT cast(last_scraped_at AS date) AS day, count(*) AS n, cast(round(sum(cost_usd), 4) AS double) AS cost FROM restaurants WHERE last_scraped_at >= {AT} - interval '30' day AND last_scraped_at <= {AT} GROUP BY 1")
add("agg_spend_model", lambda s, d: money(S.spend_by_model(load(s, d, "restaurants")), "cost", "exact"), R, "SELECT model_used, count(*) AS n, cast(round(sum(cost_usd), 4) AS double) AS cost, cast(sum(cost_usd) AS double) AS exact FROM restaurants WHERE model_used IS NOT NULL AND cost_usd IS NOT NULL GROUP BY 1")
add("agg_cache_rate", lambda s, d: S.cache_rate(load(s, d, "restaurants")), R, "SELECT count(*) AS n, count(cost_usd) AS with_cost, count(*) - count(cost_usd) AS without_cost FROM restaurants")
add("agg_cost_projection", lambda s, d: money(S.cost_projection(load(s, d, "restaurants")), "for_100", "for_500", "for_2000"), R, "SELECT round(cast(sum(cost_usd) * 100 AS double) / count(*), 2) AS for_100, round(cast(sum(cost_usd) * 500 AS double) / count(*), 2) AS for_500, round(cast(sum(cost_usd) * 2000 AS double) / count(*), 2) AS for_2000 FROM restaurants WHERE cost_usd IS NOT NULL")
add("agg_status", lambda s, d: S.status_counts(load(s, d, "restaurants")), R, "SELECT status, count(*) AS n FROM restaurants GROUP BY 1")
add("agg_spend_unattributed", lambda s, d: money(S.unattributed_spend(load(s, d, "usage_log"), "day"), "cost"), L, "SELECT date_trunc('day', created_at)::timestamp AS at, count(*) AS calls, cast(sum(cost_usd) AS double) AS cost FROM usage_log WHERE restaurant_id IS NULL AND url IS NULL GROUP BY 1")
add("agg_spend_by_source", lambda s, d: money(S.spend_by_source(load(s, d, "usage_log")), "cost"), L, "SELECT cast(date_trunc('month', created_at) AS date) AS month, source, count(*) AS calls, cast(sum(cost_usd) AS double) AS cost FROM usage_log GROUP BY 1, 2")
RUNS = "SELECT cast(m AS bigint) AS run_id, timestamp '1998-01-01 00:00:00' + m * interval '30' day AS started, timestamp '1998-01-01 00:00:00' + (m + 1) * interval '30' day AS ended, cast(1.5 AS decimal(10,6)) AS cost FROM (SELECT DISTINCT n_nationkey AS m FROM nation)"
add("agg_spend_reconcile", lambda s, d: money(S.reconcile(load(s, d, "usage_log"), s.sql(RUNS.replace("FROM nation", "FROM {nation}"), nation=s.read.parquet(f"{d}/nation.parquet"))), "cost", "ledger", "gap"), L, f"SELECT run_id, 1.5::double AS cost, cast(coalesce(sum(cost_usd), 0) AS double) AS ledger, cast(coalesce(sum(cost_usd), 0) - 1.5 AS double) AS gap FROM ({RUNS}) r LEFT JOIN usage_log ON created_at >= started AND created_at < ended GROUP BY run_id")
NOW = "timestamp '2024-01-15 18:00:00'"
add("agg_spend_today", lambda s, d: money(S.spend_today(load(s, d, "usage_log"), load(s, d, "attempts"), load(s, d, "reports"), load(s, d, "feedback"), F.expr(NOW)), "spend"), L + A + ["reports", "feedback"], f"SELECT (SELECT cast(coalesce(sum(cost_usd), 0) AS double) FROM usage_log WHERE created_at >= date_trunc('day', {NOW}) AND created_at <= {NOW}) AS spend, (SELECT count(*) FILTER (NOT success) / count(*) FROM attempts WHERE created_at >= date_trunc('day', {NOW}) AND created_at <= {NOW}) AS error_rate, (SELECT count(*) FROM reports WHERE status = 'open') + (SELECT count(*) FROM feedback WHERE status = 'open') AS open_feedback")
add("usage_cost", lambda s, d: money(S.with_cost(load(s, d, "usage_log"), s.createDataFrame([("small", 1.0, 5.0), ("huge", 5.0, 25.0)], "model_used string, price_in double, price_out double")), "cost").select("id", "cost"), L, "SELECT id, cast(round((greatest(tokens_in - cache_write_tokens - cache_read_tokens, 0) * pi + tokens_out * po + round(cache_write_tokens * 1.25 + cache_read_tokens * 0.1) * pi) / 1000000, 6) AS double) AS cost FROM (SELECT *, CASE model_used WHEN 'small' THEN 1 WHEN 'huge' THEN 5 ELSE 3 END AS pi, CASE model_used WHEN 'small' THEN 5 WHEN 'huge' THEN 25 ELSE 15 END AS po FROM usage_log)")
add("sum_usage", lambda s, d: money(S.sum_usage(load(s, d, "usage_log").filter("restaurant_id is not null"), "restaurant_id"), "cost"), L, "SELECT restaurant_id, string_agg(model_used, '+' ORDER BY created_at, id) AS models, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out, cast(sum(cost_usd) AS double) AS cost FROM usage_log WHERE restaurant_id IS NOT NULL GROUP BY 1")
add("top_expensive", lambda s, d: money(S.top_expensive(load(s, d, "restaurants")), "cost_usd"), R, "SELECT id, name, cast(cost_usd AS double) AS cost_usd, model_used FROM restaurants WHERE cost_usd IS NOT NULL ORDER BY restaurants.cost_usd DESC, id LIMIT 20")
add("snk_ledger", lambda s, d: money(S.ledger_rows(load(s, d, "usage_log")), "cost_usd").select("id", "source", "cost_usd", "date"), L, "SELECT id, source, cast(cost_usd AS double) AS cost_usd, cast(created_at AS date) AS date FROM usage_log WHERE cost_usd <> 0 OR tokens_in <> 0 OR tokens_out <> 0")

OUT = "CASE WHEN NOT success THEN 'error' WHEN dish_count IS NULL THEN NULL WHEN dish_count < 7 THEN 'thin' ELSE 'menu' END"
CODE = "CASE error_message WHEN 'Request timed out' THEN 'timeout' WHEN 'Could not find a menu' THEN 'no_menu_readable' WHEN 'HTTP 429 too many requests' THEN 'rate_limited' WHEN 'fetch failed: ECONNREFUSED' THEN 'network' WHEN 'odd failure' THEN 'unknown' END"
add("snk_attempts", lambda s, d: T.build_attempts(load(s, d, "attempts")).select("id", "domain", "error_code", "outcome"), A, f"SELECT id, 'place' || regexp_extract(url, 'place([0-9]+)', 1) || '.ie' AS domain, {CODE} AS error_code, {OUT} AS outcome FROM attempts")
add("join_discover_analyze", lambda s, d: T.search_sessions(load(s, d, "attempts")), A, """SELECT a.id, x.discover_id, (epoch_us(a.created_at) - epoch_us(x.at)) AS gap_us FROM attempts a LEFT JOIN LATERAL (
  SELECT d.id AS discover_id, d.created_at AS at FROM attempts d WHERE d.stage = 'discover' AND d.anon_id = a.anon_id AND d.url = a.url AND d.created_at <= a.created_at ORDER BY d.created_at DESC, d.id DESC LIMIT 1) x ON true WHERE a.stage = 'analyze'""")
add("agg_search_tiles", lambda s, d: T.search_tiles(T.build_attempts(load(s, d, "attempts"))), A, "SELECT count(*) FILTER (success AND dish_count >= 7) AS menu, count(*) FILTER (success AND dish_count < 7) AS thin, count(*) FILTER (NOT success) AS failed FROM attempts WHERE stage = 'analyze'")
add("top_recent_searches", lambda s, d: T.recent_searches(load(s, d, "attempts")).select("id", "url", "stage"), A, "SELECT id, url, stage FROM attempts ORDER BY created_at DESC, id DESC LIMIT 200")
add("agg_dau", lambda s, d: T.daily_users(load(s, d, "product_events")), E, "SELECT cast(ts AS date) AS day, count(DISTINCT user_id) AS users FROM product_events WHERE NOT internal GROUP BY 1")
add("agg_trend", lambda s, d: T.trend(load(s, d, "product_events"), "search_submitted", "device"), E, "SELECT cast(ts AS date) AS day, device, count(*) AS n FROM product_events WHERE NOT internal AND event = 'search_submitted' GROUP BY 1, 2")
add("agg_ratio", lambda s, d: T.daily_ratio(load(s, d, "product_events"), F.expr("event = 'results_viewed' and outcome = 'menu'"), F.expr("event = 'search_submitted'")), E, "SELECT day, part, whole, part / nullif(whole, 0) AS ratio FROM (SELECT cast(ts AS date) AS day, count(*) FILTER (event = 'results_viewed' AND outcome = 'menu') AS part, count(*) FILTER (event = 'search_submitted') AS whole FROM product_events WHERE NOT internal GROUP BY 1)")
add("agg_histogram", lambda s, d: T.histogram(load(s, d, "product_events"), "elapsed_ms", 8), E, "SELECT cast(least(7, floor((elapsed_ms - lo) * 8 / (hi - lo)::double)) AS int) AS bin, count(*) AS n FROM product_events, (SELECT min(elapsed_ms) AS lo, max(elapsed_ms) AS hi FROM product_events) GROUP BY 1")
STEPS = ["event = 'search_submitted'", "event = 'results_viewed'", "event = 'results_engaged'", "event = 'share_clicked'"]
add("agg_funnel", lambda s, d: T.funnel(load(s, d, "product_events"), [F.expr(x) for x in STEPS], 24 * 60), E, """WITH a AS (SELECT user_id, min(ts) AS t FROM product_events WHERE NOT internal AND event = 'search_submitted' GROUP BY 1),
b AS (SELECT a.user_id, min(e.ts) AS t FROM a JOIN product_events e ON e.user_id = a.user_id AND e.ts > a.t AND NOT internal AND event = 'results_viewed' GROUP BY 1),
c AS (SELECT b.user_id, min(e.ts) AS t FROM b JOIN product_events e ON e.user_id = b.user_id AND e.ts > b.t AND NOT internal AND event = 'results_engaged' GROUP BY 1),
f AS (SELECT c.user_id, min(e.ts) AS t FROM c JOIN product_events e ON e.user_id = c.user_id AND e.ts > c.t AND NOT internal AND event = 'share_clicked' GROUP BY 1)
SELECT 1 AS step, count(*) AS users FROM a UNION ALL SELECT 2, count(*) FROM b UNION ALL SELECT 3, count(*) FROM c UNION ALL SELECT 4, count(*) FROM f""")
# within a day of its start; whoever starts again has another chance
add("agg_funnel_day", lambda s, d: T.funnel(load(s, d, "product_events"), [F.expr(x) for x in STEPS], 24), E, """
WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE event WHEN 'search_submitted' THEN 0 WHEN 'results_viewed' THEN 1 WHEN 'results_engaged' THEN 2 WHEN 'share_clicked' THEN 3 END AS s FROM product_events WHERE NOT internal),
a AS (SELECT *, max(CASE WHEN s = 0 THEN t END) OVER (PARTITION BY user_id ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS l FROM e WHERE s IS NOT NULL),
b AS (SELECT user_id, t, s, CASE WHEN s = 1 AND t - l <= 86400000000 THEN l END AS r FROM a),
c AS (SELECT *, max(r) OVER (PARTITION BY user_id ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS l FROM b),
d AS (SELECT user_id, t, s, CASE WHEN s = 2 AND t - l <= 86400000000 THEN l END AS r FROM c),
f AS (SELECT *, max(r) OVER (PARTITION BY user_id ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS l FROM d),
g AS (SELECT user_id, CASE WHEN s = 3 AND t - l <= 86400000000 THEN l END AS r FROM f)
SELECT 1 AS step, count(DISTINCT user_id) AS users FROM e WHERE s = 0 UNION ALL SELECT 2, count(DISTINCT user_id) FROM b WHERE r IS NOT NULL
UNION ALL SELECT 3, count(DISTINCT user_id) FROM d WHERE r IS NOT NULL UNION ALL SELECT 4, count(DISTINCT user_id) FROM g WHERE r IS NOT NULL""")
add("agg_retention", lambda s, d: T.retention(load(s, d, "product_events"), "search_submitted"), E, "SELECT cohort, cast(date_diff('day', cohort, week) // 7 AS int) AS offset, count(*) AS users FROM (SELECT user_id, week, min(week) OVER (PARTITION BY user_id) AS cohort FROM (SELECT DISTINCT user_id, cast(date_trunc('week', ts) AS date) AS week FROM product_events WHERE NOT internal AND event = 'search_submitted')) GROUP BY 1, 2")
add("agg_domain_success", lambda s, d: T.domain_outcomes(load(s, d, "product_events")), E, "SELECT domain, count(*) FILTER (event = 'search_submitted') AS searches, count(*) FILTER (event = 'results_viewed' AND outcome = 'menu') AS successes, count(*) FILTER (event = 'error_shown') AS failures FROM product_events GROUP BY 1")
add("agg_by_code", lambda s, d: T.error_breakdown(load(s, d, "product_events")), E, "SELECT code, surface, count(*) AS n FROM product_events WHERE event = 'error_shown' GROUP BY 1, 2")
add("agg_voice", lambda s, d: T.voice(load(s, d, "reports"), load(s, d, "feedback")), ["reports", "feedback"], "SELECT 'dish' AS about, issue_type AS kind, count(*) AS n FROM reports GROUP BY 2 UNION ALL SELECT 'restaurant', feedback_type, count(*) FROM feedback GROUP BY 2")
add("agg_alerts", lambda s, d: T.alerts(load(s, d, "product_events"), 6, 0.6, 0.3), E, """SELECT 'errors' AS kind, date_trunc('hour', ts)::timestamp AS at, count(*)::double AS value FROM product_events WHERE event = 'error_shown' GROUP BY 2 HAVING count(*) >= 6
UNION ALL SELECT 'success', "at", ok FROM (SELECT date_trunc('day', ts)::timestamp AS "at", count(*) FILTER (event = 'results_viewed' AND outcome = 'menu') / nullif(count(*) FILTER (event = 'search_submitted'), 0) AS ok FROM product_events GROUP BY 1) WHERE ok < 0.6
UNION ALL SELECT 'thin', "at", th FROM (SELECT date_trunc('day', ts)::timestamp AS "at", count(*) FILTER (event = 'results_viewed' AND outcome = 'thin') / nullif(count(*) FILTER (event = 'results_viewed'), 0) AS th FROM product_events GROUP BY 1) WHERE th > 0.3""")
TR = "count(*) OVER (PARTITION BY ip_hash ORDER BY cast(floor(epoch(created_at)) AS bigint) RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
add("win_trailing_hour", lambda s, d: T.trailing_count(load(s, d, "reports"), "ip_hash", "created_at", 3600).select("id", "recent"), ["reports"], f"SELECT id, {TR.format(3600)} AS recent FROM reports")
add("win_trailing_day_votes", lambda s, d: T.trailing_count(load(s, d, "feedback"), "ip_hash", "created_at", 86400).select("id", "recent"), ["feedback"], f"SELECT id, {TR.format(86400)} AS recent FROM feedback")
add("win_first_event", lambda s, d: T.first_events(load(s, d, "product_events")).select("user_id", "id", "event"), E, "SELECT user_id, id, event FROM product_events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, id) = 1")
add("job_prune", lambda s, d: T.prune(load(s, d, "attempts"), F.expr("timestamp '2024-07-15 00:00:00'"))[0].select("id", "created_at"), A, "SELECT id, created_at FROM attempts WHERE created_at >= timestamp '2024-07-15 00:00:00' - interval '180' day")
