"""Language identification: known words by their log frequency in each language, unseen words by ever shorter n-grams.

The model is fitted on a bounded sample of rows (`most_docs`, by a hash of the text's id) and is itself bounded: `most_words`
rows (language, word, count) and `most_grams` n-gram rows, the most frequent ones. Each bound is shared out by language: one
that needs less than an equal share gives all it has, the others share the rest, so a rare language gives all its rows.

A word the model knows adds its log frequency under each language. Another word is padded with its ends and read as character
n-grams of five; the mean over those that the model knows is added, and if it knows none, n-grams of four are tried, and so on
to single characters. A word longer than RUN characters (a text without spaces is one word) is read to its end, in runs of RUN
that each count as a word.

Frequencies are smoothed towards all languages together: (n + WEIGHT * share) / (total + WEIGHT), where share is the term's
share of all counts. A term that a language doesn't have counts FLOOR times its share, in every language alike, and no term
counts less. So a language that shows little evidence gains nothing by it, whatever the size of the others, and only the
languages that have a term need a row of it.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if there was nothing to learn
from. A tie goes to the first language by name. Repeated rows are judged alike; extra columns are not read; a null lang is
not learned from, and a language whose sampled texts have no word is no choice.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, free_name, least_counts, slices, table

_WORD = re.compile(r"[^\W\d_]+")
#: Longest n-grams; characters of a run of a long word; how many words of evidence all languages together weigh.
LONGEST, RUN, WEIGHT, FLOOR = 5, 32, 1000.0, 0.001


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(padded: str, n: int) -> list[str]:
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def runs_of(word: str) -> list[str]:
    """The padded word, a long one in runs that share as much as an n-gram needs to be in one of them."""
    padded = f"<{word}>"
    return [padded[i : i + RUN + LONGEST - 1] for i in range(0, len(padded) if len(padded) <= RUN else len(padded) - LONGEST + 1, RUN)]


@dataclass
class Evidence:
    """Log frequencies of terms, less what a term adds to languages that don't have it: for each term, the languages that have it
    (`lang`, from `start[i]` to `start[i + 1]`) and what it adds to them."""

    number: dict[str, int]
    start: np.ndarray
    lang: np.ndarray
    adds: np.ndarray
    languages: int

    @classmethod
    def of(cls, counts: list[tuple[str, str, int]], names: list[str], totals: dict[str, int]) -> Evidence:
        """counts: (language, term, n). totals: of all terms of each language, kept or not."""
        place, number = {name: i for i, name in enumerate(names)}, {}
        at = np.array([number.setdefault(term, len(number)) for _, term, _ in counts], np.int64)
        lang = np.array([place[name] for name, _, _ in counts], np.int64)
        n = np.array([k for _, _, k in counts], np.float64)
        every = np.bincount(at, n, len(number)) / max(1.0, n.sum())
        order = np.argsort(at, kind="stable")
        total = np.array([totals.get(name, 0) for name in names], np.float64)
        share = every[at]
        adds = np.log(np.maximum((n + WEIGHT * share) / (total[lang] + WEIGHT) / share / FLOOR, 1.0)) if len(n) else n
        start = np.append(0, np.cumsum(np.bincount(at, minlength=len(number)))).astype(np.int64)
        return cls(number, start, lang[order], adds[order], len(names))

    def total(self, terms: list[int], weights: np.ndarray | None = None) -> np.ndarray:
        """What the terms add to each language, each times its weight."""
        t = np.asarray(terms, np.int64)
        begin, size = self.start[t], self.start[t + 1] - self.start[t]
        flat = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        adds = self.adds[flat] if weights is None else self.adds[flat] * np.repeat(weights, size)
        return np.bincount(self.lang[flat], adds, self.languages)


@dataclass
class Languages:
    names: list[str]
    prior: np.ndarray
    words: Evidence
    grams: Evidence
    unseen: dict[str, list[list[int]]] = field(default_factory=dict)

    def grams_of_unseen(self, word: str) -> list[list[int]]:
        """For each run of the word, the known n-grams of the longest length that has any."""
        got = self.unseen.get(word)
        if got is None:
            got = []
            for run in runs_of(word):
                for n in range(LONGEST, 0, -1):
                    known = [self.grams.number[g] for g in grams_of(run, n) if g in self.grams.number]
                    if known:
                        got.append(known)
                        break
            if len(word) <= RUN:
                if len(self.unseen) >= 100_000:
                    self.unseen.clear()
                self.unseen[word] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.names:
            return "und", 0.0
        at = list(map(self.words.number.get, words))
        total = self.prior + self.words.total([i for i in at if i is not None])
        runs = [r for w, i in zip(words, at) if i is None for r in self.grams_of_unseen(w)]
        if runs:
            total = total + self.grams.total([g for r in runs for g in r], np.repeat([1 / len(r) for r in runs], [len(r) for r in runs]))
        best = int(np.argmax(total))
        return self.names[best], float(1 / np.exp(total - total[best]).sum())


_COUNTS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])


def _summed(pairs, most: int = 400_000):
    """Counts by (lang, term), summed within the task while they are few enough to hold."""
    held: Counter = Counter()
    for lang, terms in pairs:
        held.update((lang, t) for t in terms)
        if len(held) > most:
            yield from batched(((*k, n) for k, n in held.items()), _COUNTS)
            held.clear()
    yield from batched(((*k, n) for k, n in held.items()), _COUNTS)


def _word_counts(batches):
    yield from _summed((lang, words_of(text)) for b in slices(batches) for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))


def _gram_counts(batches):
    """n-grams of each distinct word, so that frequent words don't drown the rest."""
    yield from _summed((lang, [g for n in range(1, LONGEST + 1) for g in grams_of(f"<{term}>", n)]) for b in slices(batches) for lang, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))


def share(sizes: dict[str, int], most: int) -> int:
    """The share of each, so that the sizes cut to it come to at most `most`."""
    left = most
    for i, n in enumerate(sorted(sizes.values())):
        if n * (len(sizes) - i) > left:
            return left // (len(sizes) - i)
        left -= n
    return max(sizes.values(), default=0)


def _frequent(counts: DataFrame, most: int) -> list[tuple[str, str, int]]:
    """The most frequent (lang, term, n) of each language up to its share, the same whatever the order of tasks."""
    sizes = {r.lang: r.n for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    least = list(least_counts(counts, "lang", share(sizes, most)).items())
    kept = counts.join(F.broadcast(counts.sparkSession.createDataFrame(least, "lang string, _least long")), "lang").filter("n >= _least") if least else counts
    got = kept.select("lang", "term", "n").toArrow().sort_by([("lang", "ascending"), ("term", "ascending")])
    return list(zip(*(c.to_pylist() for c in got.columns)))


def fit(rows: DataFrame, most_docs: int = 15_000, most_words: int = 150_000, most_grams: int = 200_000) -> Languages:
    """rows: doc_id, text, lang. One of at most so many documents is read; the model holds at most so many counts."""
    spark = rows.sparkSession
    rows = rows.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    by_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    n = sum(by_lang.values())
    each = share(by_lang, most_docs)
    if n > most_docs:
        rates = spark.createDataFrame([(x, int(1_000_000_000 * min(1, each / k))) for x, k in by_lang.items()], "lang string, _rate long")
        rows = rows.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < F.col("_rate")).drop("_rate")
    totals = lambda counts: {r.lang: r.s for r in counts.groupBy("lang").agg(F.sum("n").alias("s")).collect()}
    words = rows.select("text", "lang").mapInArrow(_word_counts, "lang string, term string, n bigint").groupBy("lang", "term").agg(F.sum("n").alias("n")).persist()
    try:
        word_totals = totals(words)
        top = _frequent(words, most_words)
        grams = words.select("lang", "term").mapInArrow(_gram_counts, "lang string, term string, n bigint").groupBy("lang", "term").agg(F.sum("n").alias("n")).persist()
        try:
            gram_totals = totals(grams)
            top_grams = _frequent(grams, most_grams)
        finally:
            grams.unpersist()
    finally:
        words.unpersist()
    names = sorted(x for x in by_lang if word_totals.get(x))  # no evidence, no choice
    prior = np.array([math.log(by_lang[x] / n) for x in names])
    return Languages(names, prior, Evidence.of(top, names, word_totals), Evidence.of(top_grams, names, gram_totals))


def predictions(docs: DataFrame, model: Languages, *keep: str, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """keep, and the predicted language and its share of the belief for every whole text of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep, F.lit("").alias(into[0]), F.lit(0.0).alias(into[1])).schema

    def run(batches):
        m = shared.value
        for batch in slices(batches, 1024):
            *rest, text = batch.columns
            told = [m.predict(t) for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64())], names=[*keep, *into])

    return docs.select(*keep, F.col("text").alias(free_name(keep, "read"))).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predictions(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out")
