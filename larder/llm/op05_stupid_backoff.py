"""LM scoring by stupid backoff over bigrams, computed relationally.

1. Words are counted over all documents: a table (word, n). Bigrams that a bounded sample shows as very frequent are counted
   exactly in the same pass, at most `most_pairs` of them.
2. Documents are exploded to rows (document, first, second, n), each distinct bigram once a document. They are dealt by bigram,
   and a sum over each bigram's rows gives every row the bigram's count: the count table and its join with the n-grams share one
   exchange and one sort. The very frequent bigrams, whose counts are known, are scored where the text is read, so no bigram
   holds a large part of a partition. So are bigrams with a word that occurs less than `least` times: a Bloom filter tells most
   of these words, and their bigrams can't be seen often enough either.
3. Which of its two words a bigram needs follows from its count. Counts of the `most_words` most frequent words go to every
   task; what is needed of other words is summed by (document, word), dealt by word and joined with the table of word counts.
4. Scores are summed by document.

A word is named by a number if frequent, else by a 63-bit hash; a bigram by both numbers in one, or by a 63-bit hash. Numbers
only shorten rows, and no word is left out.

Texts are read by runs of many: each distinct word of a run is looked up once, and bigrams are told by the places of their words.

A bigram seen at least `least` times scores log10(count / count of its first word); another backs off to
log10(0.4 * count of its second word / words in all). A document's first word scores as a single one. A corpus that scores
itself has seen each of its bigrams, so with `least` 1 nothing ever backs off; the default asks for a second occurrence.

Defined results: a null text or one without words has n_words 0, score null. Words are runs of other than ASCII white space,
A-Z taken as a-z. Repeated rows count, and each gets its score; rows of one id, or null, with different words are documents
of their own. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import least_count, mixed, partitions, slices, stored, table, word_hashes_of

BACKOFF = 0.4
#: Rows of bigrams that one partition should have.
BUCKET = 4_000_000
_KEYS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])
_RARE = np.uint64(1 << 63)
#: Where the slices of a word's hash begin that set bits of its block; most blocks of 8 bytes.
_SLICES, MOST_BLOCKS = (22, 28, 34, 40, 46, 52), 1 << 20


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _runs(batches, most: int = 1 << 18):
    """Texts, the last column of the batches, by runs of about `most` characters: the other columns' values, the word hashes of
    the texts and where each text's begin and the last one's end."""
    held, size = [], 0
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            size += len(row[-1] or "")
            if size >= most:
                yield [r[:-1] for r in held], *word_hashes_of([r[-1] for r in held])
                held, size = [], 0
    if held:
        yield [r[:-1] for r in held], *word_hashes_of([r[-1] for r in held])


def _inside(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each word, and which words have a next one in their text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return text, np.flatnonzero(text[:-1] == text[1:])


def _tally(kinds_of, most: int = 3_000_000):
    """Counts of keys by kind, summed in the task while they are few enough to hold."""

    def packed(held):
        for kind, parts in held.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            for at in range(0, len(keys), 65536):
                k = keys[at : at + 65536].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[at : at + 65536])], schema=_KEYS)

    def run(batches):
        held, size = {}, 0
        for _, words, bounds in _runs(batches):
            for kind, keys in kinds_of(words, bounds):
                if len(keys):
                    held.setdefault(kind, []).append(keys)
                    size += len(keys)
            if size > most:
                yield from packed(held)
                held, size = {}, 0
        yield from packed(held)

    return run


def _place(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `of` in the sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, of), max(0, len(keys) - 1))
    return at, (keys[at] == of if len(keys) else np.zeros(len(of), bool))


class Hashes:
    """Sorted 64-bit hashes, found by their first bits."""

    def __init__(self, keys: np.ndarray):
        bits = len(keys).bit_length() + 2
        self.keys, self.shift = keys, np.uint64(64 - bits)
        ends = np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))
        self.low = np.append(0, ends[:-1]).astype(np.int32)
        self.deep = int(np.diff(ends, prepend=0).max())

    def place(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What `_place` tells."""
        place, there = self.low[(of >> self.shift).astype(np.int64)], np.zeros(len(of), bool)
        found = place
        for step in range(self.deep):
            at = np.minimum(place + step, len(self.keys) - 1)
            hit = self.keys[at] == of
            found, there = np.where(hit, at, found), there | hit
        return np.where(there, found, 0), there


class Known:
    """What goes to every task: counts of the frequent words, in order of their hashes, and of the very frequent pairs; a filter
    of the other words that occur `least` times or more."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, total: int, masks: np.ndarray):
        self.masks = masks
        order = np.argsort(words)
        self.words, self.counts, self.total = words[order], counts[order], total
        self.shift = len(words).bit_length()  # what a word's number takes
        order = np.argsort(pairs)
        self.pairs, self.pair_counts = Hashes(pairs[order]), pair_counts[order]

    def below(self, words: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Which of the words are sure to occur less than `least` times."""
        bits = np.zeros(len(words), np.uint64)
        for s in _SLICES:
            bits |= np.uint64(1) << (words >> np.uint64(s) & np.uint64(63))
        return (named < 0) & (self.masks[words & np.uint64(len(self.masks) - 1)] & bits != bits)

    def names(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the frequent words; hashes of the others, as negative ones."""
        at, there = _place(self.words, words)
        return np.where(there, at.astype(np.uint64), words | _RARE).view(np.int64)


def _filter(words: DataFrame) -> np.ndarray:
    """Masks of a blocked Bloom filter, some 16 bits a word as long as MOST_BLOCKS allow; a fuller one only lets more through."""
    blocks, n = 1, words.count()
    while blocks * 4 < n and blocks < MOST_BLOCKS:
        blocks *= 2
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned("key", s).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(_SLICES[0])
    for s in _SLICES[1:]:
        mask = mask.bitwiseOR(bit(s))
    set_ = words.groupBy(F.col("key").bitwiseAND(F.lit(blocks - 1)).alias("block")).agg(F.bit_or(mask).alias("mask")).toArrow()  # at most MOST_BLOCKS rows
    out = np.zeros(blocks, np.uint64)
    out[set_.column("block").to_numpy()] = set_.column("mask").to_numpy().view(np.uint64)
    return out


def counts_of(corpus: DataFrame, fewest: int, most_words: int, most_pairs: int, sample: int) -> tuple[Known, DataFrame]:
    """Known, and the table (word, count) of all other words, from every document. Only which pairs to count ahead comes from
    a sample."""
    spark = corpus.sparkSession
    n = corpus.count()
    share = corpus.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(1_000_000 * min(1, sample / max(1, n)))).select("text")
    schema = "kind int, key bigint, n bigint"
    each = lambda w, bounds: [(1, np.unique(_pairs(w[a : b - 1], w[a + 1 : b]))) for a, b in zip(bounds[:-1], bounds[1:]) if b - a > 1]
    frequent = share.mapInArrow(_tally(each), schema).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 3")
    ahead = np.sort(np.array([r.key for r in frequent.orderBy(F.desc("n"), "key").limit(most_pairs).collect()], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(Hashes(ahead))

    def kinds_of(words, bounds):
        at = _inside(bounds)[1]
        own = _pairs(words[at], words[at + 1])
        return [(0, words), (1, own[shared.value.place(own)[1]])]

    counts = stored(corpus.select("text").mapInArrow(_tally(kinds_of), schema).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.filter("kind = 0")
    least = least_count(words, most_words)
    column = lambda t, c: t.column(c).to_numpy().astype(np.int64)
    top = words.filter(F.col("n") >= least).select("key", "n").toArrow()  # at most most_words rows of 16 bytes
    pairs = counts.filter("kind = 1").select("key", "n").toArrow()  # at most most_pairs rows
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    masks = _filter(words.filter((F.col("n") < least) & (F.col("n") >= fewest)))
    known = Known(column(top, "key").view(np.uint64), column(top, "n"), column(pairs, "key").view(np.uint64), column(pairs, "n"), total, masks)
    rare = F.col("key").bitwiseOR(F.lit(-(2**63))).alias("word")
    return known, words.filter(F.col("n") < least).select(rare, F.col("n").alias("count"))


_ROWS = pa.schema([("id", pa.int64()), ("tag", pa.int32()), ("key", pa.int64()), ("second", pa.int64()), ("n", pa.int32()), ("part", pa.float64()), ("size", pa.int64())])
_ROWS_SQL = "id bigint, tag int, key bigint, second bigint, n int, part double, size bigint"


def _named(doc_id: int | None, words: np.ndarray) -> tuple[int, int, int]:
    """A document's id and tag, and a number to deal it by. The tag tells rows of one id apart by their words; it is negative
    where there is no id, whose place a hash of the words takes."""
    digest = hashlib.blake2b(words.tobytes(), digest_size=12).digest()
    number, tag = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little") >> 1
    return (number, -1 - tag, number) if doc_id is None else (doc_id, tag, number)


def _explode(shared, least: int):
    """Rows of every document:

    * one with its size and the score of what is known ahead: n 0, any key;
    * a rare word that counts as a single one, n times: the word as key and first, -n;
    * every other distinct bigram that may be seen `least` times: n, its key, and if one of its words is rare, the first's name
      as key and the second's name.
    """

    def documents(known, ids, words, bounds):
        names = [_named(i, words[a:b]) for (i,), a, b in zip(ids, bounds[:-1], bounds[1:])]
        name, tag, spread = (np.array(x, kind) for x, kind in zip(zip(*names), (np.int64, np.int32, np.int64)))
        size, sums = np.diff(bounds), lambda text, x: np.bincount(text, x, len(ids)).astype(float)
        # distinct words of the run by their places, distinct bigrams of each document by its place and those of both words
        vocabulary, local = np.unique(words, return_inverse=True)
        named = known.names(vocabulary)
        below = known.below(vocabulary, named)
        text, at = _inside(bounds)
        bits = len(vocabulary).bit_length()
        both, n = np.unique((text[at] << bits | local[at]) << bits | local[at + 1], return_counts=True)
        text, a, b = both >> 2 * bits, both >> bits & (1 << bits) - 1, both & (1 << bits) - 1
        one, two = named[a], named[b]
        rare, unseen = (one < 0) | (two < 0), below[a] | below[b]
        there, often = np.zeros(len(both), bool), np.flatnonzero(~rare)
        place, hit = known.pairs.place(_pairs(vocabulary[a[often]], vocabulary[b[often]]))
        ahead, c = often[hit], known.pair_counts[place[hit]]
        there[ahead] = True
        part = sums(text[ahead], n[ahead] * np.log10(np.where(c >= least, c / known.counts[one[ahead]], BACKOFF * known.counts[two[ahead]] / known.total)))
        # single words: the first, and the second ones of bigrams that can't be seen often enough
        filled = np.flatnonzero(size)
        first = local[bounds[filled]]
        owner, single, times, lone = np.append(text[unseen], filled), np.append(two[unseen], named[first]), np.append(n[unseen], np.ones(len(filled), np.int64)), np.append(below[b[unseen]], below[first])
        part += sums(text[unseen], n[unseen] * math.log10(BACKOFF))
        sure = single >= 0
        part += sums(owner[sure], times[sure] * np.log10(known.counts[single[sure]] / known.total))
        if least == 2:  # a word that is not seen twice is seen once
            part -= sums(owner[lone], times[lone] * math.log10(known.total)) if lone.any() else 0.0
            sure |= lone
        owner, single, times = owner[~sure], single[~sure], times[~sure]
        left = ~there & ~unseen
        one, two, rare = one[left], two[left], rare[left]
        of = np.concatenate([np.arange(len(ids)), owner, text[left]])
        key = np.concatenate([spread, single, np.where(rare, one, one << known.shift | two)]).astype(np.int64)
        n = np.concatenate([np.zeros(len(ids), np.int64), -times, n[left]]).astype(np.int32)
        k, rest = len(ids) + len(owner), len(of) - len(ids)
        second = np.append(np.zeros(k, np.int64), two)
        head = np.arange(len(of)) < len(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(name[of]), pa.array(tag[of]), pa.array(key), pa.array(second, mask=np.append(np.ones(k, bool), ~rare)),
                pa.array(n), pa.array(np.append(part, np.zeros(rest))), pa.array(np.append(size, np.zeros(rest, np.int64)), mask=~head),
            ],
            schema=_ROWS,
        )

    def run(batches):
        for ids, words, bounds in _runs(batches):
            yield documents(shared.value, ids, words, bounds)

    return run


def backoff_scores(docs: DataFrame, least: int = 2, most_words: int = 400_000, bucket: int = BUCKET, most_pairs: int = 65_536, sample: int = 8_000) -> DataFrame:
    """(doc_id, n_words, score, mean_score): log10 of stupid backoff, summed over the words, and by word."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    known, rare_words = counts_of(docs, least, most_words, most_pairs, sample)
    shared = spark.sparkContext.broadcast(known)
    tasks = max(partitions(spark), known.total // bucket + 1)
    # one number a bigram, so that the rows of a partition are sorted by their prefixes alone; negative if one of its words is rare
    bigram = F.when(F.col("second").isNull(), F.col("key")).otherwise(F.xxhash64("key", "second").bitwiseOR(F.lit(-(2**63))))
    dealt = docs.mapInArrow(_explode(shared, least), _ROWS_SQL).repartition(int(tasks), bigram).withColumn("bigram", bigram)
    n, alone = F.col("n"), F.col("n") <= 0
    rows = dealt.withColumn("count", F.sum(F.greatest("n", F.lit(0))).over(W.partitionBy("bigram")))
    seen = ~alone & (F.col("count") >= least)
    first = F.when(alone | F.col("second").isNotNull(), F.col("key")).otherwise(F.shiftright("key", known.shift))
    second = F.coalesce("second", F.col("key").bitwiseAND(F.lit((1 << known.shift) - 1)))
    word, times = F.when(alone | seen, first).otherwise(second), F.when(alone | seen, -n).otherwise(n)
    total = math.log10(max(1, known.total))
    part = F.col("part") + F.when(seen, n * F.log10("count")).when(alone, n * F.lit(total)).otherwise(n * F.lit(math.log10(BACKOFF) - total))
    rows = rows.select("id", "tag", "size", word.alias("word"), times.alias("times"), part.alias("part"))
    frequent = spark.createDataFrame(pa.table({"word": np.arange(len(known.counts)), "log": np.log10(known.counts)}))
    rows = rows.join(F.broadcast(frequent), "word", "left")  # at most most_words rows
    open_ = (F.col("word") < 0) & (F.col("times") != 0)
    needed = rows.groupBy("id", "tag", F.when(open_, F.col("word")).alias("need")).agg(
        F.sum(F.col("part") + F.when(F.col("times") != 0, F.col("times") * F.coalesce("log", F.lit(0.0))).otherwise(0.0)).alias("part"), F.sum(F.when(open_, F.col("times"))).alias("times"), F.sum("size").alias("size"), F.count("size").alias("copies")
    )
    # rows that need no word are dealt by their document
    placed = needed.withColumn("at", F.coalesce("need", F.xxhash64("id", "tag")))
    met = placed.join(rare_words, (F.col("at") == F.col("word")) & F.col("need").isNotNull(), "left")
    whole = F.col("part") + F.coalesce(F.col("times") * F.log10("count"), F.lit(0.0))
    by_doc = met.groupBy("id", "tag").agg(F.sum(whole).alias("score"), F.sum("size").alias("size"), F.sum("copies").cast("int").alias("copies"))
    each = by_doc.select(F.when(F.col("tag") >= 0, F.col("id")).alias("doc_id"), (F.col("size") / F.col("copies")).cast("bigint").alias("n_words"), (F.col("score") / F.col("copies")).alias("score"), F.explode(F.sequence(F.lit(1), "copies")))
    score = F.when(F.col("n_words") > 0, F.col("score"))
    return each.select("doc_id", "n_words", score.alias("score"), (score / F.when(F.col("n_words") > 0, F.col("n_words"))).alias("mean_score"))


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the counts of them all, to six digits, in which SQL and Spark agree whatever the order of sums."""
    scored = backoff_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 6).alias("score"), F.round("mean_score", 6).alias("mean_score"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), one AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word
), pairs AS (
  SELECT r, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM d
), two AS (
  SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b
), words AS (
  SELECT sum(n) AS total FROM one
), later AS (
  SELECT r, sum(log10(CASE WHEN two.n >= 2 THEN two.n / x.n ELSE 0.4 * y.n / total END)) AS s
  FROM pairs JOIN two USING (a, b) JOIN one x ON x.word = a JOIN one y ON y.word = b, words GROUP BY r
)
SELECT doc_id, len(w) AS n_words, round(log10(one.n / total) + coalesce(s, 0), 6) AS score, round((log10(one.n / total) + coalesce(s, 0)) / len(w), 6) AS mean_score
FROM d LEFT JOIN one ON one.word = w[1] LEFT JOIN later USING (r), words
"""
