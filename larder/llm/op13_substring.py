"""Substring dedup: words covered by a window of words that also starts elsewhere go, by level-wise doubling.

Windows are looked at from short to long, each level about twice as long as the one before (18 and 35 words for windows of 35),
and only windows whose part was repeated at one level are looked at on the next, until none is left or the full length is
reached. A window's hash is a pair of hashes of half its length, down to single words.

1. Below the full length a window is stood for by one of its parts, the one of the least hash, the first of equals: equal
   windows choose the same part at the same place, so a part that occurs once rules out every window it stands for. About one
   part in ten is chosen.
2. Hashes are counted, where they lie first, then by hash; those that occur again form a table. Occurrences meet it by a Bloom
   filter sized by its keys, then by a join, which can be split where one passage has very many occurrences.
3. Texts meet the surviving places and go on to the next level. On the last level the places are those of repeated windows.

Documents of the same words in the same order are known as such from the start: all their windows are repeated. One of them
goes on for the sake of others, counted twice; and a text is only shipped where it has places.

Windows are told by 64-bit hashes on two levels. Words are runs of other than ASCII white space, unchanged.

Defined results: a null text has no words. A window never reaches over the end of a document, so a document of fewer words
than a window keeps all. Windows may overlap; a run of one word repeated more often than a window is long goes whole. Repeated
rows are copies, and each has a row in the result; null ids are like any other. Extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SENT, batched, blocks_for, bloom_blocks, mixed, slices, stored, table, with_possible, word_hashes

#: Least length of a level below the full one; entries of one row of hashes.
SHORTEST, ENTRIES = 16, 1 << 16
_FIRST, _SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))


def lengths(window: int) -> list[int]:
    """The lengths of the levels, each at most twice the one before, the last being the window's."""
    out = [window]
    while (out[0] + 1) // 2 >= SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each window of so many words: a pair of two windows of half the length, which share a word if that is odd."""
    if length == 1:
        return words
    half = (length + 1) // 2
    h = window_hashes(words, half)
    n = max(0, len(words) - length + 1)
    return mixed(h[:n] * (_FIRST + np.uint64(2 * length)) + h[length - half : length - half + n] * _SECOND)


def stand_ins(hashes: np.ndarray, length: int, window: int) -> np.ndarray:
    """For each whole window the place of the part of that length that stands for it."""
    n = len(hashes) - (window - length)
    if n <= 0:
        return np.empty(0, np.int64)
    if length == window:
        return np.arange(n)
    out = np.empty(n, np.int64)
    for at in range(0, n, ENTRIES):
        view = np.lib.stride_tricks.sliding_window_view(hashes[at : at + ENTRIES + window - length], window - length + 1)[: n - at]
        out[at : at + len(view[:ENTRIES])] = at + np.arange(len(view[:ENTRIES])) + view[:ENTRIES].argmin(axis=1)
    return out


def _chosen(words: np.ndarray, length: int, window: int, alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the parts that stand for the windows that are alive (all, if not said)."""
    hashes = window_hashes(words, length)
    stand = stand_ins(hashes, length, window)
    places = np.unique(stand if alive is None else stand[alive])
    return places, hashes[places]


def _alive(words: np.ndarray, length: int, window: int, places: list[int]) -> np.ndarray:
    """Which windows have their part among the places that survived."""
    marked = np.zeros(len(words) + 1, bool)
    marked[places] = True
    return marked[stand_ins(window_hashes(words, length), length, window)]


_READ = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.binary()), ("n_words", pa.int64()), ("words_sha", pa.binary()), ("places", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))]
)
_LEVEL = pa.schema([("rid", pa.int64()), ("copies", pa.bool_()), ("places", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])


def _read(length: int, window: int):
    """First level: a row a document."""

    def run(batches):
        def rows():
            for batch in slices(batches):
                for doc_id, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                    data = (text or "").encode().split()
                    places, hashes = _chosen(word_hashes(text or "", cased=True), length, window)
                    yield doc_id, mark, len(data), hashlib.sha256(b" ".join(data)).digest(), places.astype(np.int32), hashes.view(np.int64)

        yield from batched(rows(), _READ, 256)

    return run


def _extended(before: int, length: int, window: int):
    """A later level: the windows whose part survived the level before; a long document's in several rows."""

    def run(batches):
        def rows():
            for batch in slices(batches, 64):
                for rid, copies, text, survived in zip(*(c.to_pylist() for c in batch.columns)):
                    words = word_hashes(text or "", cased=True)
                    places, hashes = _chosen(words, length, window, _alive(words, before, window, survived))
                    for at in range(0, len(places), ENTRIES):
                        yield rid, copies, places[at : at + ENTRIES].astype(np.int32), hashes[at : at + ENTRIES].view(np.int64)

        yield from batched(rows(), _LEVEL, 64)

    return run


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text); id and mark name a text, rows equal in both are equal."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("mark"), text.alias("text"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, mark, ...) with the texts it names."""
    texts, blocks = _marked(docs), blocks_for(wanted.count())
    if 16 * blocks <= SENT:  # a filter that has to be joined itself spares nothing
        texts = with_possible(texts, F.col("mark"), bloom_blocks(wanted, "mark", blocks), blocks, "_possible").filter("_possible").drop("_possible")
    named = wanted.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}).hint("shuffle_hash")
    return texts.join(named, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")))


def _occurrences(level: DataFrame, *columns: str) -> DataFrame:
    pairs = F.explode(F.arrays_zip("hashes", "places")).alias("o")
    return level.select(*columns, pairs).select(*columns, F.col("o.hashes").alias("h"), F.col("o.places").alias("place"))


def _met(occurrences: DataFrame, again: DataFrame) -> DataFrame:
    """(rid, places) of the occurrences (rid, h, place) whose hash is in `again`."""
    blocks = blocks_for(again.count())
    if 16 * blocks <= SENT:
        occurrences = with_possible(occurrences, F.col("h"), bloom_blocks(again, "h", blocks), blocks, "_possible").filter("_possible").drop("_possible")
    return occurrences.join(again, "h").groupBy("rid").agg(F.collect_set("place").alias("places"))


def repeated_windows(docs: DataFrame, window: int = 35) -> tuple[DataFrame, DataFrame]:
    """(documents, repeats). documents: a row a document with rid, doc_id, mark, n_words, words_sha, copies (whether another has
    the same words in the same order). repeats: (rid, places), the starts of repeated windows of documents that are no copies."""
    levels = lengths(window)
    columns = "doc_id bigint, mark binary, n_words bigint, words_sha binary, places array<int>, hashes array<bigint>"
    read = _marked(docs).mapInArrow(_read(levels[0], window), columns).withColumn("rid", F.monotonically_increasing_id())
    read = stored(read, "windows")  # written, so that a row's number stays
    known = read.select("rid", "doc_id", "mark", "n_words", "words_sha")
    same = known.groupBy("words_sha").agg(F.count("*").alias("n"), F.min("rid").alias("first")).filter("n > 1").select("words_sha", "first")
    known = known.join(stored(same, "copies"), "words_sha", "left")
    goes_on = F.coalesce(F.col("first") == F.col("rid"), F.lit(True))
    known = stored(known.select("rid", "doc_id", "mark", "n_words", "words_sha", F.col("first").isNotNull().alias("copies"), goes_on.alias("goes_on")), "known")
    again = _occurrences(read, "rid").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    places = _met(_occurrences(read, "rid"), stored(again, "again"))
    for before, length in zip(levels, levels[1:]):
        wanted = stored(places.join(known.filter("goes_on").select("rid", "doc_id", "mark", "copies"), "rid"), "places")
        level = _texts(docs, wanted).select("rid", "copies", "text", "places").mapInArrow(_extended(before, length, window), "rid bigint, copies boolean, places array<int>, hashes array<bigint>")
        level = stored(level, "windows")
        # a copy counts twice; hashes of copies alone tell nothing new
        counts = _occurrences(level, "copies").groupBy("h").agg(F.sum(F.when(F.col("copies"), 2).otherwise(1)).alias("n"), F.min("copies").alias("copies"))
        again = stored(counts.filter("n > 1 and not copies").select("h"), "again")
        last = level.filter("not copies") if length == window else level
        places = _met(_occurrences(last, "rid"), again)
    return known.drop("goes_on"), places.join(known.filter("not copies").select("rid"), "rid", "left_semi")


_SPANS = pa.schema([("rid", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])


def spans_of(places: np.ndarray, window: int) -> list[dict[str, int]]:
    """The words that windows at these places cover, as runs (begin, end)."""
    at = np.sort(places)
    new = np.flatnonzero(np.diff(at, prepend=-window - 1) > window)
    last = np.append(new[1:], len(at)) - 1
    return [{"begin": int(b), "end": int(e) + window} for b, e in zip(at[new], at[last])]


def removed_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """A row a document: doc_id, mark (a digest of its text), n_words, words_sha, and the runs (begin, end) of words, counted from
    0, that a repeated window covers."""
    known, repeats = repeated_windows(docs, window)

    def run(batches):
        for batch in slices(batches):
            rids, places = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array([spans_of(np.array(p), window) for p in places], _SPANS.field(1).type)], schema=_SPANS)

    runs = repeats.select("rid", "places").mapInArrow(run, "rid bigint, spans array<struct<begin:int,end:int>>")
    n = F.col("n_words").cast("int")
    whole = F.when(F.col("copies") & (n >= window), F.array(F.struct(F.lit(0).alias("begin"), n.alias("end"))))
    spans = F.coalesce(whole, "spans", F.array().cast("array<struct<begin:int,end:int>>"))
    return known.join(runs, "rid", "left").select("doc_id", "mark", "n_words", "words_sha", spans.alias("spans"))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def kept_words(docs: DataFrame, window: int = 35, text: bool = True) -> DataFrame:
    """A row a document: doc_id, n_words, n_removed, and what is left, kept words joined by one space: its text, or only its
    sha256 (binary), for which the texts that lose nothing need not be read again."""
    spans = stored(removed_spans(docs, window), "spans")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    spans = spans.withColumn("n_removed", removed)

    def run(batches):
        def rows():
            for batch in slices(batches, 64):
                for doc_id, n, gone, data, runs in zip(*(c.to_pylist() for c in batch.columns)):
                    words, kept, at = data.encode().split(), [], 0
                    for r in [*runs, {"begin": n, "end": n}]:
                        kept += words[at : r["begin"]]
                        at = r["end"]
                    left = b" ".join(kept)
                    yield doc_id, n, gone, left if text else hashlib.sha256(left).digest()

        yield from batched(rows(), _KEPT, 64)

    columns = "doc_id bigint, n_words bigint, n_removed bigint, kept binary"
    read = lambda some: _texts(docs, some).select("doc_id", "n_words", "n_removed", "text", "spans").mapInArrow(run, columns)
    if text:
        return read(spans.dropDuplicates(["doc_id", "mark"])).withColumn("kept", F.col("kept").cast("string"))
    in_part = F.col("n_removed").between(1, F.col("n_words") - 1)
    none = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    rest = spans.filter(~in_part).select("doc_id", "n_words", "n_removed", F.when(F.col("n_removed") == 0, F.col("words_sha")).otherwise(none).alias("kept"))
    return rest.unionByName(read(spans.filter(in_part)))


def op13_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_words(table(spark, sf_dir, "documents"), 35, text=False)
    return kept.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs
), windows AS (
  SELECT d.r, i, array_to_string(w[i + 1 : i + 35], ' ') AS s FROM docs d JOIN words USING (r) WHERE i + 35 <= len(w)
), again AS (
  SELECT s FROM windows GROUP BY s HAVING count(*) > 1
), starts AS (
  SELECT r, i FROM windows SEMI JOIN again USING (s)
), judged AS (
  SELECT r, i, word, max(CASE WHEN starts.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN starts USING (r, i)
), sums AS (
  SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM judged GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN sums USING (r)
"""
