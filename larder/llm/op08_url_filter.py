"""URL filter: host and path rules, then a blocked Bloom filter of listed canonical URLs with an exact hash join behind it.

Only DataFrame functions: nothing of this module runs Python on the executors.

The filter is sized by a count of the list, 16 bits a url. Up to 64 MB it goes to every task; a larger one meets the urls by
block. Only urls that it lets pass go to the exact join.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule, has an empty canonical form
and is never listed. Repeated rows are judged alike, each on its own. Extra columns pass through; those named host, path,
canonical, rule or verdict are replaced. An empty list lets all pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_for, bloom_blocks, stored, table, with_possible

#: (host, path, verdict); fixed values of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    """host without `www.` and port, then path without trailing slashes and index page; query and fragment go."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":\d*$", ""), r"^www\.", "")
    return F.concat(host, F.regexp_replace(path_of(url), r"(/index\.html?)?/*$", ""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits host or one of its parent domains and the path's start; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def listed_keys(keys: DataFrame, listed: DataFrame, key: str = "canonical", blocks: int | None = None) -> DataFrame:
    """The distinct keys that are in the list. blocks: size of the filter, else by a count of the list."""
    known = listed.select(key).filter(F.col(key) != "").distinct()
    blocks = blocks or blocks_for(known.count())
    distinct = keys.select(key).filter(F.col(key) != "").distinct()
    possible = with_possible(distinct, F.col(key), bloom_blocks(known, key, blocks), blocks, "_possible").filter("_possible").select(key)
    return possible.join(known.hint("shuffle_hash"), key, "left_semi")


def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, blocks: int | None = None) -> DataFrame:
    """pages with host, path, canonical, rule and verdict; listed has a column `canonical`."""
    known = stored(listed.select("canonical").filter("canonical <> ''").distinct(), "listed")
    blocks = blocks or blocks_for(known.count())
    out = ["host", "path", "canonical", "rule", "verdict"]
    rows = pages.select(F.struct("*").alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical_url(F.col(url)).alias("canonical"))
    rows = rows.withColumn("told", rule_of(F.col("host"), F.col("path"), rules))
    rows = with_possible(rows, F.col("canonical"), bloom_blocks(known, "canonical", blocks), blocks, "possible")
    passed = rows.filter("possible and canonical <> ''").join(known.withColumn("listed", F.lit(True)), "canonical", "left")
    judged = rows.filter("not possible or canonical = ''").withColumn("listed", F.lit(False)).unionByName(passed)
    verdict = F.coalesce(F.col("told.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    kept = [F.col("page").getField(c).alias(c) for c in pages.columns if c not in out]
    return judged.select(*kept, "host", "path", "canonical", F.col("told.rule").alias("rule"), verdict.alias("verdict"))


def repeated_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """The list of the query: canonical URLs that more than one distinct URL of the table leads to."""
    return pages.select(canonical_url(F.col(url)).alias("canonical"), F.col(url).alias("u")).distinct().groupBy("canonical").agg(F.count("*").alias("n")).filter("n > 1").select("canonical")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, repeated_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), c AS (
  SELECT *, regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^www\.', '') || regexp_replace(path, '(/index\.html?)?/*$', '') AS canonical FROM p
), listed AS (
  SELECT canonical FROM c WHERE canonical <> '' GROUP BY canonical HAVING count(DISTINCT url) > 1
), r AS (
  SELECT c.*,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM c
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
