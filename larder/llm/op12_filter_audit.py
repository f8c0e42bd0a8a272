"""Filter interaction audit: what each filter removes, in every order in which the filters can be applied.

1. Every document gets a mask, one bit for each filter it fails. A text's own conditions are column expressions; the condition
   on earlier copies compares the document's id with the least id of its text, found by an aggregate over text digests that is
   joined back, so a text of very many copies is split like any other skewed key.
2. Documents are counted by part, mask and label, before any shuffle where they lie. What is left of the corpus is at most
   2^filters rows a part.
3. The masks of a part form a matrix (masks x filters, 0 where the filter fails, infinite elsewhere). Its min-plus product with
   the matrix of positions (filters x orders, the inverse of each order) is the step at which each order removes each mask.
4. Counts are scattered by that step: removed, kept and lost documents; a mask that fails the filter of a later step is
   redundant there.

Defined results: a null text is an empty one, a null source is the part ''. A null id is neither smaller nor larger than any
other, so it is no copy and nothing is its copy. A repeated row counts each time, and is not a copy of itself. A document with
several label rows is good (toxic) if one of them says so; label rows without a document, and null labels, count for nothing.
Extra columns are not read. Without documents there are no parts and no rows.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, slices, stored, table

_SPACES = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def text_failures(words: Column, text: Column) -> dict[str, Column]:
    """The conditions on a text alone. words: its words; text: not null."""
    n = F.size(words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * capitals > 5 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): a row a document; bit i of mask is set where the filter FILTERS[i] fails it."""
    text = F.coalesce("text", F.lit("")).alias("text")
    words = F.array_remove(F.split(text, _SPACES), "").alias("words")
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text, words)
    bits = [F.when(fails, 1 << FILTERS.index(k)).otherwise(0) for k, fails in text_failures(F.col("words"), F.col("text")).items()]
    own = read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    own = stored(own, "masks")  # texts are read once
    several = own.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last")
    several = stored(several.select("digest", "least"), "several")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    return own.join(several, "digest", "left").select("doc_id", "part", mask.alias("mask"))


def counted(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those of them labelled quality=1 and toxic=1."""
    said = labels.filter("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("bigint")).alias(c)
    return masks.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), one("good"), one("toxic"))


@cache
def positions(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders (orders x steps, the filter of each step) and their inverse (filters x orders, the step of each filter)."""
    orders = np.array(list(permutations(range(filters))), np.int64).reshape(-1, filters)
    return orders, np.argsort(orders, axis=1).T


def removal_steps(masks: np.ndarray, filters: int) -> np.ndarray:
    """(masks x orders): the step, from 0, at which an order removes a mask; `filters` where none does. A min-plus product."""
    fails = (masks[:, None] >> np.arange(filters)) & 1
    costs = np.where(fails == 1, 0, filters)
    _, at = positions(filters)
    out = np.full((len(masks), at.shape[1]), filters)
    for f in range(filters):
        np.minimum(out, costs[:, f, None] + at[f], out=out)
    return out


def audited(masks: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Counts by order and step (orders x steps), of masks that stand for so many documents each."""
    orders, at = positions(filters)
    step = removal_steps(masks, filters)
    which = np.broadcast_to(np.arange(len(orders)), step.shape)

    def scattered(weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(orders), filters + 1), np.int64)
        np.add.at(out, (which, step), weights[:, None])
        return out[:, :filters]

    removed = scattered(n)
    fails = ((masks[:, None] >> np.arange(filters)) & 1).astype(bool)
    earlier = step[:, :, None] < np.arange(filters)  # masks x orders x steps
    redundant = np.einsum("m,mos,mos->os", n, earlier.astype(np.int64), fails[:, orders].astype(np.int64))
    alone = np.array([n[masks == 1 << f].sum() for f in range(filters)], np.int64)
    by_filter = np.take_along_axis(removed, at.T, axis=1).sum(axis=0)
    return {
        "kept": n.sum() - np.cumsum(removed, axis=1),
        "removed": removed,
        "redundant": redundant,
        "unique_fails": alone[orders],
        "good_lost": scattered(good),
        "toxic_lost": scattered(toxic),
        "shapley": by_filter[orders],
    }


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_AUDIT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in _COUNTS)])


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row a part, order and step. counts: part, mask, n, good, toxic; bit i of mask stands for filters[i]."""
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))  # 2^filters at most

    def run(batches):
        def rows():
            orders, _ = positions(len(filters))
            names = ["".join(filters[f] for f in order) for order in orders]
            for batch in slices(batches):
                for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    columns = [np.array([m[k] for m in masks], np.int64) for k in ("mask", "n", "good", "toxic")]
                    found = audited(*columns, len(filters))
                    for o, name in enumerate(names):
                        for s in range(len(filters)):
                            yield part, name, s + 1, *(int(found[c][o, s]) for c in _COUNTS)

        yield from batched(rows(), _AUDIT)

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(counted(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), fails AS (
  SELECT doc_id, part,
    (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM words
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM fails LEFT JOIN said USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE length(list_aggregate(list_distinct([a.f, b.f, c.f, d.f, e.f]), 'string_agg', '')) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM orders, range(1, 6) AS r(step)
), first_step AS (
  SELECT mask, filter_order, min(step) AS gone_at FROM steps JOIN letters USING (f), (SELECT DISTINCT mask FROM counts) WHERE mask & bit > 0 GROUP BY mask, filter_order
), cells AS (
  SELECT part, filter_order, step, f, bit, sum(n) AS total,
    sum(CASE WHEN gone_at <= step THEN n ELSE 0 END) AS gone,
    sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone_at < step AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts CROSS JOIN steps JOIN letters USING (f) LEFT JOIN first_step USING (mask, filter_order)
  GROUP BY part, filter_order, step, f, bit
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(total - gone AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM cells
"""
