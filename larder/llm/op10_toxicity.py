"""Toxicity: logistic regression on words and word starts, regularised by counterfactual swaps of identity terms.

Fitting reads a bounded sample of labelled rows (`most_rows`, chosen by a hash of the id). Counts by feature are made on
Spark; the features that labelled toxic texts hold most clearly more often are kept (`most_features`). Each sampled text then
comes twice: as it is, and with its identity terms swapped for others of their group. The loss is log loss plus
`swap_weight` times the squared change of the logit between the two, so a term that names a group cannot carry the score.
Scoring reads every whole text and nothing else.

Defined results: a null or empty text has no feature and scores by the intercept alone; a null label or id is not learned
from; a document with several labels counts as toxic if one says so; with no labels at all, the score is 0; extra columns are
not read; repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, free_name, slices, table

#: Terms that name a group; within a tuple, each is swapped for the next. Fixed values.
IDENTITY_TERMS = [
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "citizens", "refugees", "foreigners"), ("disabled", "deaf", "blind", "autistic"), ("old", "young"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
]
_SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, term in enumerate(group)}
_WORD = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)


def features_of(words: set[str]) -> set[str]:
    """The words, and their starts of 4 to 6 letters marked by `^`, which carry what inflected forms share."""
    out = set(words)
    for n in STARTS:
        out |= {w[:n] + "^" for w in words if len(w) >= n}
    return out


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped(words: set[str]) -> set[str]:
    return {_SWAP.get(w, w) for w in words}


@dataclass(frozen=True)
class Toxicity:
    """Weights by feature, and the intercept."""

    weights: dict[str, float]
    intercept: float

    def score(self, text: str | None) -> float:
        w = self.weights
        words = words_of(text)
        total = self.intercept + sum(map(w.__getitem__, words & w.keys()))
        for n in STARTS:
            total += sum(map(w.__getitem__, {x[:n] + "^" for x in words if len(x) >= n} & w.keys()))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


_COUNTS = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())])


def _count(batches):
    """Documents by feature, summed within the task while they are few enough to hold."""
    toxic, every = Counter(), Counter()

    def rows():
        return ((k, toxic[k], n) for k, n in every.items())

    for batch in slices(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            f = features_of(words_of(text))
            every.update(f)
            if label:
                toxic.update(f)
        if len(every) > 300_000:
            yield from batched(rows(), _COUNTS)
            toxic.clear()
            every.clear()
    yield from batched(rows(), _COUNTS)


def sampled(labelled: DataFrame, most_rows: int) -> DataFrame:
    """About most_rows rows at most, by a hash of the id alone, so the ids can be chosen before any join."""
    n = labelled.count()
    return labelled if n <= most_rows else labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))


def descend(own: list[np.ndarray], other: list[np.ndarray], labels: np.ndarray, n: int, swap_weight: float, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the whole sample. own, other: feature numbers of each text and of its swapped twin."""
    flat = lambda x: (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(x)), [len(y) for y in x]))
    (fa, ra), (fb, rb) = flat(own), flat(other)
    m, w, b = len(labels), np.zeros(n), float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    g1, g2 = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        za = np.bincount(ra, w[fa], m)
        gap = za - np.bincount(rb, w[fb], m)
        error = (1 / (1 + np.exp(-np.clip(za + b, -30, 30))) - labels) / m
        pull = 2 * swap_weight * gap / m
        g = np.append(np.bincount(fa, (error + pull)[ra], n) - np.bincount(fb, pull[rb], n) + l2 * w, error.sum())
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
        step = 0.1 * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(documents: DataFrame, labels: DataFrame, most_rows: int = 20_000, most_features: int = 4_000, swap_weight: float = 1.0) -> Toxicity:
    """documents: doc_id, text; labels: doc_id, toxic. Both are cut to the sample before they meet."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = sampled(marked, most_rows)
    texts = documents.select("doc_id", "text")
    if chosen is not marked:
        n = marked.count()
        texts = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    rows = texts.join(chosen, "doc_id").select("text", "toxic")
    rows = rows.persist()
    try:
        total, bad = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not total:
            return Toxicity({}, -30.0)
        share = bad / total
        counts = rows.mapInArrow(_count, "feature string, toxic bigint, n bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).filter("n >= 3")
        z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-9))
        terms = {*_SWAP, *(t[:n] + "^" for t in _SWAP for n in STARTS if len(t) >= n)}
        best = counts.withColumn("z", z).filter("z > 3").orderBy(F.desc("z"), "feature").limit(most_features)
        number = {r.feature: i for i, r in enumerate(best.select("feature").collect())}
        number |= {t: len(number) + i for i, t in enumerate(sorted(terms - number.keys()))}
        names = documents.sparkSession.sparkContext.broadcast(number)

        def encoded(batches):
            at = names.value
            schema = pa.schema([("toxic", pa.int64()), ("own", pa.list_(pa.int32())), ("other", pa.list_(pa.int32()))])

            def each():
                for batch in slices(batches):
                    for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        words = words_of(text)
                        own = sorted(at[f] for f in features_of(words) & at.keys())
                        twin = swapped(words)
                        yield int(label), own, own if twin == words else sorted(at[f] for f in features_of(twin) & at.keys())

            yield from batched(each(), schema, 1024)

        sample = rows.mapInArrow(encoded, "toxic bigint, own array<int>, other array<int>").toPandas()  # at most most_rows rows
        names.unpersist()
    finally:
        rows.unpersist()
    own = [np.asarray(x, np.int64) for x in sample["own"]]
    other = [np.asarray(x, np.int64) for x in sample["other"]]
    order = sorted(range(len(own)), key=lambda i: (int(sample["toxic"][i]), own[i].tolist()))  # the same sums whatever the order of tasks
    w, b = descend([own[i] for i in order], [other[i] for i in order], sample["toxic"].to_numpy(float)[order], len(number), swap_weight)
    return Toxicity({f: float(w[i]) for f, i in number.items() if w[i] != 0}, b)


def scores(docs: DataFrame, model: Toxicity, *keep: str, into: str = "score") -> DataFrame:
    """keep, and the score of every whole text of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep, F.lit(0.0).alias(into)).schema

    def run(batches):
        m = shared.value
        for batch in slices(batches, 2048):
            *rest, text = batch.columns
            yield pa.RecordBatch.from_arrays([*rest, pa.array([m.score(t) for t in text.to_pylist()], pa.float64())], names=[*keep, into])

    return docs.select(*keep, F.col("text").alias(free_name(keep, "read"))).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    out = scores(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out")
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
