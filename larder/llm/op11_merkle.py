"""Merkle manifest of a dataset: a tree for each group of rows, and one over the roots of the groups.

1. Rows are ranked within their group without any task that sees a whole group: dealt by ranges of (group, order, digest),
   counted by range, and numbered from the sum of the ranges before. Equal rows travel as one row with a count.
2. 512 consecutive nodes form an aligned block. A block keeps each of its levels as one string of 64 hex characters a node;
   substrings of 8 nodes, hashed, make up the string of the level above. The tops of the blocks are the nodes of the next
   round, until each group has one block, whose top is the group's root. The groups' roots are a tree of the same kind.
3. Downwards each block gives its nodes their siblings: at each level the substrings before and after the node within its run
   of 8, then the path of the block itself.

A path is an array of (before, after), from the leaf to the root of the whole; `folded` computes the root from a digest and a
path, `path_digest` a digest of the siblings. A run of one node has an empty pair, and is hashed like any other run.

Defined results: nulls order first, among the groups too. Rows of equal order ascend by digest; rows equal in all stand next
to each other, each with a place and a path of its own. A lone row's digest is the root of its group; a lone group's root is
the root. Carried columns keep their names, which must not be those of the result; other columns are not read. Without rows
there is no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, stored, table

FAN, DEPTH, HEX = 8, 3, 64
#: Nodes of a block.
BLOCK = FAN**DEPTH
_RUN = FAN * HEX
_PATH = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    """`-` for null, else UTF-8 bytes, `:`, value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def _ceil(n: Column, by: int) -> Column:
    return F.floor((n + (by - 1)) / by)


def _ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (grp, *order, digest, n, ...) with `at`, the rank of the first of its n equal rows, and `total`, the rows of its group."""
    keys = ["grp", *order, "digest"]
    dealt = nodes.repartitionByRange(partitions(nodes.sparkSession), *keys)
    dealt = stored(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("grp", "range").agg(F.sum("n").alias("m"))  # a row a range, and one more a group
    before = F.sum("m").over(W.partitionBy("grp").orderBy("range")) - F.col("m")
    sums = sums.select("grp", "range", before.alias("before"), F.sum("m").over(W.partitionBy("grp")).alias("total"))
    inside = W.partitionBy("grp", "range").orderBy(*order, "digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = dealt.withColumn("until", F.sum("n").over(inside))
    return counted.join(sums, ["grp", "range"]).withColumn("at", F.col("before") + F.col("until") - F.col("n")).drop("range", "before", "until")


def _above(level: Column) -> Column:
    """The level above: a digest for each substring of 8 nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / _RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * _RUN + 1, F.lit(_RUN)), 256)), "")


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(grp, block, total, members, l0..l3, top) of nodes (grp, at, n, total, digest, *carried). total: nodes of the group on this
    level; a level is null where the group has come down to one node before; n equal nodes meet as many blocks as they reach."""
    first, last = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("n") - 1) / BLOCK)
    parts = nodes.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest("at", F.col("block") * BLOCK)
    end = F.least(F.col("at") + F.col("n"), (F.col("block") + 1) * BLOCK)
    member = F.struct(start.alias("at"), (end - start).cast("int").alias("n"), "digest", *carried)
    out = parts.groupBy("grp", "block").agg(F.first("total").alias("total"), F.array_sort(F.collect_list(member)).alias("members"))
    out = out.withColumn("l0", F.array_join(F.transform("members", lambda m: F.repeat(m["digest"], m["n"])), ""))
    for k in range(DEPTH):
        out = out.withColumn(f"l{k + 1}", F.when(_ceil(F.col("total"), FAN**k) > 1, _above(F.col(f"l{k}"))))
    out = out.withColumn("top", F.coalesce(*(f"l{k}" for k in range(DEPTH, -1, -1))))
    return out.withColumn("members", F.transform("members", lambda m: F.struct(m["n"].alias("n"), *(m[c].alias(c) for c in carried))))


def _tree(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """The blocks of each round, the last one with one block a group."""
    rounds, names = [], carried
    while True:
        rounds.append(stored(_blocks(nodes, names), "blocks"))
        most = rounds[-1].agg(F.max("total")).first()[0] or 0
        if most <= BLOCK:
            return rounds
        total = _ceil(F.col("total"), BLOCK)
        nodes, names = rounds[-1].select("grp", F.col("block").alias("at"), F.lit(1).alias("n"), total.alias("total"), F.col("top").alias("digest")), []


def _siblings(i: Column, k: int) -> Column:
    """What stands before and after node i's ancestor on level k, within its run; null where the level is the last."""
    own = F.floor(i / FAN**k).cast("int")
    run = F.floor(own / FAN).cast("int") * _RUN
    level = F.col(f"l{k}")
    before = F.substring(level, run + 1, (own % FAN) * HEX)
    after = F.substring(level, (own + 1) * HEX + 1, (FAN - 1 - own % FAN) * HEX)
    return F.when(F.col(f"l{k + 1}").isNotNull(), F.struct(before.alias("before"), after.alias("after")))


def _paths(blocks: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """(grp, at, subroot, root, path, digest, *carried) of the blocks' nodes; above: (grp, block, subroot, root, path) of the blocks."""
    met = blocks.join(above, ["grp", "block"])
    members = F.flatten(F.transform("members", lambda m: F.array_repeat(F.struct(*(m[c].alias(c) for c in ["n", *carried])), m["n"])))

    def placed(m: Column, i: Column) -> Column:
        own = F.array_compact(F.array(*(_siblings(i, k) for k in range(DEPTH))))
        digest = F.substring(F.col("l0"), i * HEX + 1, F.lit(HEX))
        return F.struct(*(m[c].alias(c) for c in carried), i.alias("i"), digest.alias("digest"), F.concat(own, F.col("path")).alias("path"))

    each = met.select("grp", "block", "subroot", "root", F.explode(F.transform(members, placed)).alias("m"))
    return each.select("grp", (F.col("block") * BLOCK + F.col("m.i")).alias("at"), "subroot", "root", "m.path", "m.digest", *(F.col("m").getField(c).alias(c) for c in carried))


def _descend(rounds: list[DataFrame], above: DataFrame, carried: list[str]) -> DataFrame:
    """Paths of the leaves; above: (grp, subroot, root, path) of the groups' roots."""
    above = above.withColumn("block", F.lit(0).cast("bigint"))
    for blocks in rounds[:0:-1]:
        above = _paths(blocks, above, []).withColumnRenamed("at", "block").drop("digest")
    return _paths(rounds[0], above, carried)


def manifest(rows: DataFrame, group: str, order: list[str], digest: str, carried: list[str] = ()) -> DataFrame:
    """A row a row: the group, order and digest columns, `subroot`, `root`, `path`, and the carried columns.

    rows: a column of group names, columns that order the rows of a group, the digest of each row in lowercase hex.
    """
    keep = list(dict.fromkeys([*order, *carried]))
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # sorts null first
    nodes = rows.select(key.alias("grp"), *(F.col(c).alias(f"c_{i}") for i, c in enumerate(keep)), F.col(digest).alias("digest"))
    names = [f"c_{i}" for i in range(len(keep))]
    equal = nodes.groupBy("grp", "digest", *names).agg(F.count("*").alias("n"))
    rounds = _tree(_ranked(equal, names[: len(order)]), names)
    groups = rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.lit(1).cast("bigint").alias("n"), F.col("top").alias("digest"))
    tops = _tree(_ranked(groups, ["name"]), ["name"])
    whole = tops[-1].select("grp", F.lit("").alias("subroot"), F.col("top").alias("root"), F.lit(None).cast(_PATH).alias("path"))
    whole = whole.withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
    roots = _descend(tops, whole, ["name"]).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "path")
    out = _descend(rounds, stored(roots, "roots"), names)
    value = F.when(F.col("grp") != "", F.expr("substring(grp, 2)"))
    return out.select(value.alias(group), *(F.col(f"c_{i}").alias(c) for i, c in enumerate(keep)), F.col("digest").alias(digest), "subroot", "root", "path")


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda a, s: F.sha2(F.concat(s["before"], a, s["after"]), 256))


def path_digest(path: Column) -> Column:
    """Digest of all siblings from leaf to root, each level's from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z as a-z; where all is ASCII, the faster function does the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest(*columns, lowered(F.col("text"))))
    leaves = docs.select("doc_id", "lang", leaf_digest(*columns, F.col("text")).alias("leaf"), other.alias("tampered"))
    out = manifest(leaves, "lang", ["doc_id"], "leaf", ["tampered"])
    out = out.withColumns({"proof_sha256": path_digest(F.col("path")), "folded_root": folded(F.col("path"), F.coalesce("tampered", "leaf"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(CAST(4294967295 AS UBIGINT), list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([1, 2, 3, 4, 5, 6, 7, 8] AS UBIGINT[])), lambda x, k: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1))))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered
  FROM docs
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), up AS (
  SELECT lang, 0 AS level, pos, leaf AS h, n FROM ranked
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, level, pos // 8
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, pos // 8
), steps AS (
  SELECT r.lang, r.pos, u.level,
    coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < r.pos // CAST(power(8, u.level) AS BIGINT)), '') AS before,
    coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > r.pos // CAST(power(8, u.level) AS BIGINT)), '') AS after
  FROM ranked r JOIN up u ON r.lang IS NOT DISTINCT FROM u.lang AND u.n > 1 AND u.pos // 8 = r.pos // CAST(power(8, u.level + 1) AS BIGINT)
  GROUP BY r.lang, r.pos, u.level
), top_steps AS (
  SELECT s.lang, 1000 + t.level AS level,
    coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos // CAST(power(8, t.level) AS BIGINT)), '') AS before,
    coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos // CAST(power(8, t.level) AS BIGINT)), '') AS after
  FROM subroots s JOIN top t ON t.n > 1 AND t.pos // 8 = s.pos // CAST(power(8, t.level + 1) AS BIGINT)
  GROUP BY s.lang, s.pos, t.level
), path AS (
  SELECT *, row_number() OVER (PARTITION BY lang, pos ORDER BY level) AS k FROM (
    SELECT * FROM steps UNION ALL SELECT r.lang, r.pos, t.level, t.before, t.after FROM ranked r JOIN top_steps t ON r.lang IS NOT DISTINCT FROM t.lang)
), fold AS (
  SELECT lang, pos, CAST(0 AS BIGINT) AS k, coalesce(tampered, leaf) AS h FROM ranked
  UNION ALL
  SELECT f.lang, f.pos, p.k, sha256(p.before || f.h || p.after) FROM fold f JOIN path p ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos AND p.k = f.k + 1
), ends AS (
  SELECT lang, pos, arg_max(h, k) AS folded_root FROM fold GROUP BY lang, pos
), proofs AS (
  SELECT lang, pos, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM path GROUP BY lang, pos
)
SELECT r.doc_id, r.leaf, s.subroot, t.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM ranked r
JOIN subroots s ON r.lang IS NOT DISTINCT FROM s.lang
JOIN top t ON t.n = 1
JOIN ends e ON r.lang IS NOT DISTINCT FROM e.lang AND r.pos = e.pos
LEFT JOIN proofs p ON r.lang IS NOT DISTINCT FROM p.lang AND r.pos = p.pos
"""
