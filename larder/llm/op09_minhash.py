"""Near-duplicates: universal hash minima, banding, signature check, full-set check, components by alternating stars.

1. Every document gets the set of its 5-word shingles (64-bit hashes), a digest of the set, and minima of universal hashes in
   bands of 5 rows: as many bands as let a pair at the threshold miss them all with a probability under 3e-7 (26 bands at 0.85,
   38 at 0.80).
2. Documents of equal sets are one class; only its smallest id goes on.
3. Classes that share a band form a bucket. Buckets of the same members are one.
4. A bucket of few members falls apart where the signatures disagree (estimate 0.15 under the threshold, 4.8 standard errors at
   0.85), and links in each part are confirmed on the full sets: the part is searched breadth first, each pivot compared with
   the members not yet reached, so linked copies are reached in a few steps and no pairs are written.
5. In a large bucket every member first meets one pivot, the class of most copies; those confirmed as its links are one
   component already. The others, the open ones, meet each other and all members, in blocks of bounded size, a pair of blocks
   a task; signatures are compared before sets. A bucket of very many shingles counts as a large one too. So the work is the number of open members times the bucket's, not its square.
6. Links (a forest a task) go to the components.

Of texts and signatures only those of candidates are shuffled: a Bloom filter of their ids, sized by their count, passes over
the rows first. Band keys are not shuffled as a whole to leave out later copies of a class: a filter of these passes over them.

Defined results: a null or blank text has an empty set and is linked with nothing; fewer than five words make one shingle;
a repeated id counts once (its smallest text); a null id is dropped (`near_duplicates` gives no row for it); extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, blocks_for, bloom_blocks, groups, mixed, partitions, shingle_hashes, slices, stored, table, with_possible
from .components import connected_components

ROWS, MOST_BANDS, MISSED = 5, 200, 3e-7
_RANDOM = np.random.default_rng(97)
_A, _B = _RANDOM.integers(0, 2**64, (2, ROWS * MOST_BANDS, 1), dtype=np.uint64)
_IN_BAND = _RANDOM.integers(0, 2**63, (MOST_BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A bucket above this many members is a large one.
SMALL = 1000
#: Shingles of one block of a bucket: two blocks are what a task of the full check holds.
BLOCK = 1_000_000


def bands_for(percent: int) -> int:
    n = math.ceil(math.log(MISSED) / math.log(1 - (percent / 100) ** ROWS))
    if n > MOST_BANDS:
        raise ValueError("the threshold is too low for bands of 5 rows")
    return n


def minima(shingles: np.ndarray, bands: int) -> np.ndarray:
    """The least value over the set of each hash (a*x+b mod 2^64) >> 32 of 32-bit x, a strongly universal family."""
    x = shingles >> np.uint64(32)
    a, b = _A[: ROWS * bands], _B[: ROWS * bands]
    out = np.full(ROWS * bands, 2**64 - 1, np.uint64)
    for at in range(0, len(x), 512):
        np.minimum(out, (a * x[None, at : at + 512] + b).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = len(signature) // ROWS
    rows = mixed(signature.astype(np.uint64).reshape(bands, ROWS) + np.arange(bands, dtype=np.uint64)[:, None])
    return mixed((rows * _IN_BAND[:bands]).sum(axis=1, dtype=np.uint64)).view(np.int64)


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])


def set_features(docs: DataFrame, bands: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature, bands) of every document."""

    def run(batches):
        def rows():
            for batch in slices(batches):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    s = shingle_hashes(text)
                    if not len(s):
                        yield doc_id, 0, None, None, None
                        continue
                    signature = minima(s, bands)
                    yield doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature.tobytes(), band_keys(signature)

        yield from batched(rows(), _FEATURES, 1024)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, signature binary, bands array<bigint>")


_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])


def _sets(batches):
    yield from batched(((i, shingle_hashes(t).tobytes()) for b in slices(batches) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), _SETS, 256)


def reach(n: int, linked) -> list[tuple[int, int]]:
    """A spanning forest of n items. linked(p, rest) tells which of `rest` are linked with p; asked once for each pair at most."""
    rest, found = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            hit = linked(p, rest)
            new = rest[hit]
            found += [(p, int(x)) for x in new]
            queue += new.tolist()
            rest = rest[~hit]
    return found


_PARTS = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64())])


def _signature_parts(least: float):
    """Buckets cut where signatures disagree; parts of one member go."""

    def run(batches):
        def rows():
            for (bucket,), members in groups(batches, 1):
                ids = [m[0] for m in members]
                s = np.frombuffer(b"".join(m[1] for m in members), np.uint32).reshape(len(ids), -1)
                root = list(range(len(ids)))
                for p, x in reach(len(ids), lambda p, rest: (s[rest] == s[p]).mean(axis=1) >= least):
                    root[x] = root[p]
                parts: dict[int, list[int]] = {}
                for i, r in enumerate(root):
                    parts.setdefault(r, []).append(ids[i])
                for part in parts.values():
                    if len(part) > 1:
                        yield from ((bucket, part[0], i) for i in part)

        yield from batched(rows(), _PARTS)

    return run


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Sets:
    """Members' full sets, in one array of numbers."""

    def __init__(self, raw: list[bytes], percent: int):
        sets = [np.frombuffer(x, np.uint64) for x in raw]
        self.sizes, self.percent = np.array([len(s) for s in sets]), percent
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.mark = np.zeros(int(self.flat.max()) + 1, bool)

    def linked(self, p: int, rest: np.ndarray) -> np.ndarray:
        """Which of `rest` have 100 * common >= percent * union with p."""
        flat, starts, ends, sizes, mark = self.flat, self.starts, self.ends, self.sizes, self.mark
        near = 100 * np.minimum(sizes[rest], sizes[p]) >= self.percent * np.maximum(sizes[rest], sizes[p])
        out = np.zeros(len(rest), bool)
        if near.any():
            own, at = flat[starts[p] : ends[p]], rest[near]
            mark[own] = True
            if len(at) * 4 > len(sizes):
                common = np.add.reduceat(mark[flat], starts, dtype=np.int64)[at]
            else:
                common = np.array([np.count_nonzero(mark[flat[starts[i] : ends[i]]]) for i in at])
            out[near] = 100 * common >= self.percent * (sizes[at] + sizes[p] - common)
            mark[own] = False
        return out


def _full_check(percent: int):
    """Edges of a spanning forest of each part's members, every link confirmed on the full sets."""

    def run(batches):
        def rows():
            for _, members in groups(batches, 2):
                ids, sets = [m[0] for m in members], Sets([m[1] for m in members], percent)
                yield from ((ids[p], ids[x]) for p, x in reach(len(ids), sets.linked))

        yield from batched(rows(), _EDGES)

    return run


def _open_check(percent: int, least: float):
    """Edges between the open members of each task, and from each of them to a settled one that it is linked with."""

    def run(batches):
        def rows():
            for _, members in groups(batches, 2):
                ids, sets = [m[0] for m in members], Sets([m[2] for m in members], percent)
                settled = np.array([m[1] for m in members])
                signatures = np.frombuffer(b"".join(m[3] for m in members), np.uint32).reshape(len(ids), -1)

                def linked(p, rest):
                    alike = (signatures[rest] == signatures[p]).mean(axis=1) >= least  # noqa: B023
                    alike[alike] = sets.linked(p, rest[alike])  # noqa: B023
                    return alike

                unsettled, known = np.flatnonzero(~settled), np.flatnonzero(settled)
                yield from ((ids[unsettled[p]], ids[unsettled[x]]) for p, x in reach(len(unsettled), lambda p, rest: linked(unsettled[p], unsettled[rest])))  # noqa: B023
                for p in unsettled if len(known) else ():
                    hit = np.flatnonzero(linked(p, known))
                    if len(hit):
                        yield ids[p], ids[known[hit[0]]]

        yield from batched(rows(), _EDGES)

    return run


def _with_pivot(percent: int):
    """(bucket, doc_id, pivot, settled): whether a member is the pivot or linked with it."""
    schema = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("pivot", pa.int64()), ("settled", pa.bool_())])

    def run(batches):
        def rows():
            for batch in slices(batches, 256):
                for bucket, i, own, pivot, other in zip(*(c.to_pylist() for c in batch.columns)):
                    a, b = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
                    near = 100 * min(len(a), len(b)) >= percent * max(len(a), len(b))
                    common = len(np.intersect1d(a, b, assume_unique=True)) if near else 0
                    yield bucket, i, pivot, i == pivot or (near and 100 * common >= percent * (len(a) + len(b) - common))

        yield from batched(rows(), schema)

    return run


def _together(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def _perhaps(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with a column `possible`: whether a Bloom filter of the ids, a written table, may hold their doc_id."""
    blocks = blocks_for(ids.count())
    return with_possible(rows, F.col("doc_id"), bloom_blocks(ids, "doc_id", blocks), blocks, "possible")


def _only(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of those documents. Only rows that pass a filter of the ids are shuffled."""
    ids = stored(ids.distinct(), name)
    return _perhaps(rows, ids).filter("possible").drop("possible").join(ids.hint("shuffle_hash"), "doc_id")


def first_of_classes(every: DataFrame, classes: DataFrame) -> DataFrame:
    """The features of each class's smallest id. Only rows that pass a filter of the later copies' ids are shuffled."""
    again = every.select("doc_id", "set_key").join(classes.filter("copies > 1").select("set_key", "class_id"), "set_key")
    again = stored(again.filter("doc_id <> class_id").select("doc_id"), "copies")
    told = _perhaps(every.filter("n_shingles > 0"), again)
    sure, perhaps = (told.filter(c).drop("possible") for c in ("not possible", "possible"))
    return sure.union(perhaps.join(again, "doc_id", "left_anti"))


def candidate_buckets(features: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(bucket, part, doc_id) of small buckets, cut by their signatures, and (bucket, doc_id) of large ones: classes that share
    a band."""
    band = features.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    sized = band.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")).filter("n > 1")
    # written, so that the join below can split a band that very many classes share; likewise the blocks further down
    large = F.max((F.col("n") > SMALL) | (F.col("total") > BLOCK)).alias("large")
    kept = stored(sized.groupBy("n", "x", "y").agg(F.min("band").alias("band"), large), "bands")
    members = stored(band.select("band", "doc_id").join(kept.select("band", "large"), "band").select(F.col("band").alias("bucket"), "doc_id", "large"), "buckets")
    few = members.filter("not large")
    small = few.join(_only(features.select("doc_id", "signature"), few.select("doc_id"), "small"), "doc_id").select("bucket", "doc_id", "signature")
    parts = _together(small, "bucket").mapInArrow(_signature_parts(least), "bucket bigint, part bigint, doc_id bigint")
    return stored(parts, "parts"), members.filter("large").select("bucket", "doc_id")


def _candidate_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the wanted documents."""
    texts = _only(docs.select(F.col("doc_id").cast("bigint"), "text"), wanted, "wanted")
    return stored(texts.mapInArrow(_sets, "doc_id bigint, shingles binary"), "sets").dropDuplicates(["doc_id"])


def _large_links(large: DataFrame, features: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, least: float) -> DataFrame:
    """(a, b): links in buckets of any number of members."""
    features = stored(_only(features.select("doc_id", "n_shingles", "signature"), large.select("doc_id"), "large"), "large_features")
    copies = classes.select(F.col("class_id").alias("doc_id"), "copies")
    members = large.join(features.select("doc_id").join(copies, "doc_id"), "doc_id")
    pivots = stored(members.groupBy("bucket").agg(F.max(F.struct("copies", (-F.col("doc_id")).alias("order"))).alias("best")).select("bucket", (-F.col("best.order")).alias("pivot")), "pivots")
    known = stored(pivots.join(sets, F.col("pivot") == F.col("doc_id")).select("bucket", "pivot", F.col("shingles").alias("pivot_shingles")), "pivot_sets")
    met = large.join(sets, "doc_id").join(known, "bucket").select("bucket", "doc_id", "shingles", "pivot", "pivot_shingles")
    told = stored(met.mapInArrow(_with_pivot(percent), "bucket bigint, doc_id bigint, pivot bigint, settled boolean"), "settled")
    sized = told.join(features.select("doc_id", "n_shingles", "signature"), "doc_id")
    count = lambda rows: F.ceil(F.sum(F.when(rows, F.col("n_shingles")).otherwise(0)) / F.lit(BLOCK)).cast("int")
    blocks = stored(sized.groupBy("bucket").agg(count(~F.col("settled")).alias("unsettled"), count(F.col("settled")).alias("known")), "blocks").filter("unsettled > 0")
    placed = sized.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("settled"), F.col("known")).otherwise(F.col("unsettled"))).cast("int"))
    # two blocks of open members meet in task (i, j), i <= j; block k of settled ones meets each open block i in task (i, n + k)
    n, i = F.col("unsettled"), F.col("block")
    open_tasks = F.concat(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"))), F.transform(F.sequence(F.lit(0), F.greatest(F.col("known") - 1, F.lit(0))), lambda k: F.struct(i.alias("i"), (n + k).alias("j"))))
    known_tasks = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(j.alias("i"), (n + i).alias("j")))
    tasks = F.explode(F.when(F.col("settled"), known_tasks).otherwise(open_tasks)).alias("task")
    dealt = placed.select("bucket", tasks, "doc_id", "settled", "signature").join(sets, "doc_id")
    dealt = dealt.select(F.xxhash64("bucket", "task").alias("task"), "bucket", "doc_id", "settled", "shingles", "signature")
    links = _together(dealt, "task", "bucket").mapInArrow(_open_check(percent, least), "a bigint, b bigint")
    return told.filter("settled and doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).union(links)


def confirmed_links(docs: DataFrame, features: DataFrame, classes: DataFrame, parts: DataFrame, large: DataFrame, percent: int, least: float) -> DataFrame:
    """(a, b): links between classes with 100 * common >= percent * union, a forest of each task's links."""
    sets = _candidate_sets(docs, parts.select("doc_id").union(large.select("doc_id")))
    full = _together(parts.join(sets, "doc_id").select("bucket", "part", "doc_id", "shingles"), "bucket", "part")
    links = full.mapInArrow(_full_check(percent), "a bigint, b bigint")
    if not large.isEmpty():
        links = links.union(_large_links(large, features, classes, sets, percent, least))
    return links.distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row a document (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.filter("doc_id is not null")
    bands = bands_for(percent)
    every = stored(set_features(docs, bands), "features")
    if not every.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():  # repeated ids
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
        every = stored(set_features(docs, bands), "features")
    classes = every.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    firsts, least = first_of_classes(every, classes), percent / 100 - 0.15
    parts, large = candidate_buckets(firsts, least)
    links = confirmed_links(docs, every, classes, parts, large, percent, least)
    component = connected_components(links).withColumnRenamed("node", "class_id")
    to = classes.join(component, "class_id", "left").select("set_key", F.coalesce("component", "class_id").alias("component_id"))
    out = every.select("doc_id", "n_shingles", "set_key").join(to, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
