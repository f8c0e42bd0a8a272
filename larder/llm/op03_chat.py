"""Chat formatting: conversations logged as growing snapshots collapse to the longest, then turns are rendered.

Every turn has a rolling hash of the turns up to it: a sum of hashes of (position, role, text), so it can be summed in pieces
and no conversation has to sit in one task. A conversation whose whole hash is that of another, longer conversation's prefix
of the same length is absorbed; so is one equal to another with a smaller id. Prefixes are first reduced to one row each (the
longest conversation behind it), so a first turn that very many conversations share costs one row a task. An anti-join
against the absorbed ones leaves the maximal conversations, whose turns are rendered one row each.

Defined results: a null role is `user`, a null text an empty one; turns are in order of turn, then role, then text, null turns
first; a mark inside a role or text is rendered with a space in it, a line break in a role as a space; repeated rows are turns of their own; a null conv_id is dropped; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, stored, table

def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pos", "role", "text").cast("decimal(20,0)")


def rolling(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, pos, prefix): pos counts from 1; prefix names the turns up to this one.

    Turns are dealt by range of (conv_id, turn, ...), so a conversation of any length spreads over ranges; what the ranges
    before hold of a conversation is one row each.
    """
    clean = turns.filter("conv_id is not null").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = clean.repartitionByRange(partitions(turns.sparkSession), "conv_id", F.asc_nulls_first("turn"), "role", "text").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "turns")  # the ranges must not be drawn anew
    here = W.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "text")
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), zero).alias("ahead"))
    placed = dealt.withColumn("pos", F.row_number().over(here)).join(counts, ["conv_id", "part"]).withColumn("pos", F.col("pos") + F.col("ahead")).withColumns({"h1": _hash(1), "h2": _hash(2)})
    placed = stored(placed.drop("ahead"), "placed")
    sums = placed.groupBy("conv_id", "part").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    sums = sums.select("conv_id", "part", *(F.coalesce(F.sum(s).over(earlier), zero).alias(s) for s in ("s1", "s2")))
    upto = W.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    out = placed.withColumns({"r1": F.sum("h1").over(upto), "r2": F.sum("h2").over(upto)}).join(sums, ["conv_id", "part"])
    prefix = F.concat_ws(":", (F.col("r1") + F.col("s1")).cast("string"), (F.col("r2") + F.col("s2")).cast("string"))
    return out.select("conv_id", "turn", "role", "text", "pos", prefix.alias("prefix"))


def collapse(rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns, absorbed_by): null for maximal conversations, else the longest conversation it is a prefix of."""
    sized = rolled.groupBy("conv_id").agg(F.max("pos").alias("n_turns"))
    whole = rolled.join(sized, "conv_id").select("conv_id", "pos", "prefix", "n_turns")
    longest = whole.groupBy("pos", "prefix").agg(F.max(F.struct("n_turns", (-F.col("conv_id")).alias("order"))).alias("best"))
    # written, so that a prefix that ends very many conversations can be split in the join
    ends = whole.filter("pos = n_turns").join(stored(longest, "longest"), ["pos", "prefix"], "left")
    heir = -F.col("best.order")
    return ends.select("conv_id", "n_turns", F.when(heir != F.col("conv_id"), heir).alias("absorbed_by"))


def rendered(role: Column, text: Column) -> Column:
    """A turn between marks; the start of a mark inside role or text gets a space, so that no turn can end itself or forge another."""
    plain = lambda c: F.replace(c, F.lit("<|im_"), F.lit("< |im_"))
    return F.concat(F.lit("<|im_start|>"), F.replace(plain(role), F.lit("\n"), F.lit(" ")), F.lit("\n"), plain(text), F.lit("<|im_end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n_turns, role, rendered) of the maximal conversations; a chat is its rows' `rendered` by pos."""
    rolled = stored(rolling(turns), "rolled")
    outcome = stored(collapse(rolled), "outcome")
    kept = rolled.join(outcome.filter("absorbed_by is not null").select("conv_id"), "conv_id", "left_anti")
    return kept.join(outcome.select("conv_id", "n_turns"), "conv_id").select("conv_id", F.col("pos").cast("bigint").alias("pos"), F.col("n_turns").cast("bigint").alias("n_turns"), "role", rendered(F.col("role"), F.col("text")).alias("rendered"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT *, '<|im_start|>' || replace(replace(role, '<|im_', '< |im_'), chr(10), ' ') || chr(10) || replace(text, '<|im_', '< |im_') || '<|im_end|>' || chr(10) AS rendered, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t
), p AS (
  SELECT conv_id, pos, n_turns, string_agg(md5(role || chr(0) || text), ',') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM r
), best AS (
  SELECT prefix, max(n_turns) AS longest, arg_min(conv_id, (-n_turns, conv_id)) AS heir FROM p GROUP BY prefix
), kept AS (
  SELECT p.conv_id FROM p JOIN best USING (prefix) WHERE p.pos = p.n_turns AND best.heir = p.conv_id
)
SELECT conv_id, pos, n_turns, role, rendered FROM r WHERE conv_id IN (SELECT conv_id FROM kept)
"""
