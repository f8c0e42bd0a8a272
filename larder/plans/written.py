"""Queries that write a table as a user would and read it back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import spend, telemetry
from larder.sources import deliveries, sinks, tables
from larder.sources.scratch import scratch

from .fixtures import load, load_stream, with_tables
from .reports import SQL as REPORTS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, run, needs, sql):
    QUERIES[name] = run
    SQL[name] = with_tables(needs, sql) if needs else sql


def _ledger(s, d):
    """The stream is fed twice with one checkpoint: the second run finds nothing new."""
    path, checkpoint = scratch(s, "ledger"), scratch(s, "checkpoint")
    for _ in range(2):
        spend.append_usage_stream(load_stream(s, d, "usage_log"), path, checkpoint, "month")
    schema = "id bigint, source string, cost_usd decimal(10,6), date date, batch bigint, part date"
    return sinks.read_parts(s, path, schema).select("id", "source", F.col("cost_usd").cast("double").alias("cost_usd"), "date")


add("snk_ledger_stream", _ledger, [], REPORTS["snk_ledger"])


def _attempts(s, d):
    path, checkpoint = scratch(s, "attempts"), scratch(s, "checkpoint")
    for _ in range(2):
        telemetry.append_attempts_stream(load_stream(s, d, "attempts"), path, checkpoint)
    return sinks.read_parts(s, path, "id bigint, domain string, error_code string, outcome string, batch bigint, date date").drop("batch", "date")


add("snk_attempts_stream", _attempts, [], REPORTS["snk_attempts"])


def _upserted(s, d):
    """A table of verdicts, and those of reported dishes laid over it, in two orders of one answer."""
    path = scratch(s, "verdicts")
    dishes = load(s, d, "dishes")
    sinks.upsert_table(dishes.select("id", "classification", F.lit(1).alias("seq")), path, ["id"], "seq", 8)
    doubted = dishes.filter("raw_reports > 1").select("id", F.explode(F.array(F.lit(3), F.lit(2))).alias("seq"))
    sinks.upsert_table(doubted.select("id", F.when(F.col("seq") == 3, "neither").otherwise("vegan").alias("classification"), "seq"), path, ["id"], "seq", 8)
    return sinks.read_parts(s, path, "id string, classification string, seq int, bucket int").drop("bucket")


add(
    "snk_upsert_table",
    _upserted,
    ["dishes"],
    "SELECT id, CASE WHEN raw_reports > 1 THEN 'neither' ELSE classification END AS classification, CASE WHEN raw_reports > 1 THEN 3 ELSE 1 END AS seq FROM dishes",
)

EDGE = "2024-01-11 12:00:00"


def _pruned(s, d):
    path = scratch(s, "reports")
    rows = load(s, d, "reports").select("id", "created_at", F.to_date("created_at").alias("date"))
    for k in range(2):
        sinks.append_batch(rows.filter(F.col("id") % 2 == k), k, path)
    sinks.prune_table(s, path, "id bigint, created_at timestamp, date date, batch bigint", EDGE)
    return sinks.read_parts(s, path, "id bigint, created_at timestamp, date date, batch bigint").select("id", "date")


add("job_prune_table", _pruned, ["reports"], f"SELECT id, CAST(created_at AS date) AS date FROM reports WHERE created_at >= timestamp '{EDGE}'")


def _csv(s, d):
    """All cells quoted, written and read with the reader's defaults for such a file."""
    path = scratch(s, "csv")
    dishes = load(s, d, "dishes").select("id", F.concat(F.col("name"), F.lit(', "so"\n')).alias("name"), "price")
    tables.write_csv_quoted(dishes, path)
    return s.read.schema("id string, name string, price string").csv(path, header=True, escape='"', multiLine=True).select("id", "name", F.coalesce("price", F.lit("")).alias("price"))


add("snk_csv_written", _csv, ["dishes"], """SELECT id, name || ', "so"' || chr(10) AS name, coalesce(price, '') AS price FROM dishes""")


def _csv_min(s, d):
    path = scratch(s, "csv")
    tables.write_csv(load(s, d, "dishes").select("id", "price"), path)
    return s.read.text(path).filter(F.col("value") != "id,price").groupBy("value").agg(F.count("*").alias("n"))


add(
    "snk_csv_min_written",
    _csv_min,
    ["dishes"],
    """SELECT id || ',' || CASE WHEN contains(price, '"') OR contains(price, ',') THEN '"' || replace(price, '"', '""') || '"' ELSE coalesce(price, '') END AS value, count(*) AS n FROM dishes GROUP BY 1""",
)


def _delivered(s, d):
    """Attempts in three deliveries: as declared; with times as text, some of them none, and one column more; as JSON lines, some
    of them cut short. Stages that are none are in all."""
    root = scratch(s, "deliveries")
    rows = load(s, d, "attempts").select(F.col("id").cast("string").alias("id"), "url", F.when(F.col("id") % 50 == 7, "other").otherwise(F.col("stage")).alias("stage"), "success", "duration_ms", "created_at", "dish_count")
    part = lambda k: rows.filter(F.col("id").cast("bigint") % 3 == k)
    part(0).write.parquet(f"{root}/a")
    late = F.when(F.col("id").cast("bigint") % 20 == 1, "soon").otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    part(1).withColumns({"created_at": late, "dish_count": F.col("dish_count").cast("double"), "more": F.lit(1)}).write.parquet(f"{root}/b")
    line = F.to_json(F.struct("id", "url", "stage", "success", "dish_count"))
    part(2).select(F.when(F.col("id").cast("bigint") % 40 == 2, F.substring(line, 1, 12)).otherwise(line)).write.text(f"{root}/c.json")
    got = deliveries.read_deliveries(s, root, "parse_attempts")
    kept = got.rows.groupBy("delivery", F.lit("kept").alias("reason")).agg(F.count("*").alias("n"), F.count("created_at").alias("timed"), F.sum("dish_count").alias("dishes"))
    return kept.unionByName(got.aside.groupBy("delivery", "reason").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("timed"), F.lit(None).cast("bigint").alias("dishes")))


add(
    "src_tables",
    _delivered,
    ["attempts"],
    """SELECT delivery, reason, count(*) AS n, CASE WHEN reason = 'kept' AND delivery <> 'c.json' THEN count(*) ELSE 0 END AS timed, CAST(sum(CASE WHEN reason = 'kept' THEN dish_count END) AS BIGINT) AS dishes FROM (
  SELECT dish_count, CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c.json' END AS delivery,
    CASE WHEN id % 3 = 2 AND id % 40 = 2 THEN 'corrupt' WHEN id % 3 = 1 AND id % 20 = 1 THEN 'drift: created_at' WHEN id % 50 = 7 THEN 'not allowed: stage' ELSE 'kept' END AS reason FROM attempts) GROUP BY delivery, reason""",
)


def _geojson(s, d):
    """Areas of nations as a feature collection: squares and pairs of squares, some without a name, some points."""
    path = scratch(s, "geojson")
    nations = s.read.parquet(f"{d}/nation.parquet")
    square = lambda x: F.array(F.array(*(F.array(x + a, F.lit(float(b))) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)))))
    x = F.col("n_nationkey").cast("double")
    shape = F.when(F.col("n_nationkey") % 3 == 0, F.to_json(F.struct(F.lit("Polygon").alias("type"), square(x).alias("coordinates"))))
    shape = shape.when(F.col("n_nationkey") % 3 == 1, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(square(x), square(x + 9)).alias("coordinates"))))
    shape = shape.otherwise(F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, x).alias("coordinates"))))
    names = F.to_json(F.struct(F.when(F.col("n_nationkey") % 5 != 1, F.concat(F.lit(" "), "n_name")).alias("name"), F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit(" EN"))).alias("name:en")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), names, F.lit(',"geometry":'), shape, F.lit("}"))
    # the file is one document, as such files are; a nation is a line of it
    whole = nations.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.array_sort(F.collect_list(feature)), ","), F.lit("]}")).alias("value"))
    whole.write.text(path)
    read = tables.read_neighbourhoods(s, path, "x")
    return read.select("city", "display_name", F.size("rings").cast("bigint").alias("rings"))


add(
    "src_geojson",
    _geojson,
    [],
    """SELECT 'x' AS city, name AS display_name, CASE n_nationkey % 3 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS rings FROM (
  SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN n_name || ' EN' WHEN n_nationkey % 5 <> 1 THEN n_name END AS name FROM nation) WHERE name IS NOT NULL AND n_nationkey % 3 < 2""",
)


def _documents(s, d):
    """Files of three kinds, told by their first bytes; `folder` is what was written there."""
    root = scratch(s, "documents")
    head = F.when(F.col("page_id") % 3 == 0, "%PDF-1.4 ").when(F.col("page_id") % 3 == 1, "GIF89a     ").otherwise("plain text ")
    pages = s.read.parquet(f"{d}/pages.parquet").select(F.concat(head, F.col("url")).alias("value"), (F.col("page_id") % 3).alias("folder"))
    pages.repartition("folder").write.partitionBy("folder").text(root)
    files = tables.read_documents(s, f"{root}/*/*.txt")
    return files.select(F.regexp_extract("path", "folder=([0-9])", 1).alias("folder"), "kind").distinct()


add("src_docs_files", _documents, [], "SELECT DISTINCT CAST(page_id % 3 AS VARCHAR) AS folder, CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/gif' END AS kind FROM pages")


def _json_pages(s, d):
    """Pages as JSON lines."""
    root = scratch(s, "pages")
    s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html").write.json(f"{root}/p.json")
    got = deliveries.read_deliveries(s, root, "pages")
    return got.rows.select("page_id", "url", F.length("html").cast("bigint").alias("n"))


add("src_pages_json", _json_pages, [], "SELECT page_id, url, length(html) AS n FROM pages")
