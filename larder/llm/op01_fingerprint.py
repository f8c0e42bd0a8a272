"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every shingle hash below one fixed fraction (1 in SCALE) of the hash range, whatever the text's length. So
sketches merge exactly (the sketch of two texts together is the union of theirs) and a short document can be looked for in a
very long one. A kept hash is written with 48 bits: the text form is the sorted hashes, 6 bytes each, in base64.

A text shorter than a shingle is one shingle of its own kind, whose hash always lies in the kept range; a text of n shingles
has an empty sketch with probability (1 - 1/SCALE)^n.

Defined results: a null text is an empty one, with an empty sketch; two empty sketches are alike by 1, an empty and another by
0. The next document follows by descending id, ties in the order of a hash of their texts or of the texts, null ids last; the
last one's next is the first. Repeated rows are documents of their own. A single document is its own next. Extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, char_shingle_hashes, partitions, slices, table

#: One hash in SCALE is kept.
SCALE, SHINGLE, WIDTH = 4, 8, 6
_SHIFT = np.uint64(64 - 8 * WIDTH - int(math.log2(SCALE)))


def sketch(text: str | None) -> np.ndarray:
    """Sorted kept hashes."""
    return np.unique(char_shingle_hashes(text or "", SHINGLE, 2**64 // SCALE) >> _SHIFT)


def to_text(sk: np.ndarray) -> str:
    return base64.b64encode(sk.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    kept = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, WIDTH)
    return np.pad(kept, ((0, 0), (8 - WIDTH, 0))).view(">u8").reshape(-1).astype(np.uint64)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    k = _common(a, b)
    return k / (len(a) + len(b) - k) if len(a) or len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    return _common(a, b) / len(a) if len(a) else 0.0


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the beginning of the next text, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text."""
    fields = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        yield from batched(((i, to_text(sketch(t))) for b in slices(batches) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), fields, 1024)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fingerprint string")


#: Null ids come after all others; a tie within an id that fills several ranges is ordered by so many values of a hash.
LEAST, TIES = -(2**63), 1 << 20


def _cuts_above(key: Column, cuts: list[int]) -> Column:
    """How many of the falling cuts are greater than key: whole blocks of them first, then those of one block."""
    if not cuts:
        return F.lit(0)
    side = math.isqrt(len(cuts)) + 1
    lasts = cuts[side - 1 :: side]
    more = lambda of: F.size(F.filter(of, lambda c: c > key))
    whole = more(F.lit(lasts)) if lasts else F.lit(0)
    return whole * side + more(F.slice(F.lit(cuts), whole * side + 1, F.lit(side)))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, guest, doc_id, text), a range a partition, sorted so that each row's next document is the row below it.

    Ids are cut into ranges of about equally many rows; an id (or null) that fills several is dealt over them by a hash of its
    texts. The first row of each range also goes, as a guest, to the end of the range before. One shuffle of the texts; the
    driver sees two numbers a range.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, key = max(2, ranges), F.coalesce("doc_id", F.lit(LEAST))
    found = Counter(ids.agg(F.percentile_approx(key, [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0] or [])
    cuts = sorted(found, reverse=True)
    filled = [found[c] for c in cuts] + [1]  # ranges that end with the cut
    starts = [sum(filled[:i]) for i in range(len(filled))]
    at = lambda values: F.element_at(F.lit(values), F.col("_above") + 1)
    several = (key == at([*cuts, LEAST])) & (at(filled) > 1)
    placed = ids.withColumn("_above", _cuts_above(key, cuts)).withColumn("_tie", F.when(several, F.pmod(F.xxhash64("text"), F.lit(TIES))).otherwise(0).cast("int"))
    placed = placed.select("doc_id", "text", "_tie", (at(starts) + F.when(several, F.floor(F.col("_tie") * at(filled) / TIES)).otherwise(0)).cast("int").alias("range"))
    rows = placed.groupBy("range").agg(F.max(F.struct(key.alias("k"), (-F.col("_tie")).alias("t"))).alias("first")).collect()
    first = {r["range"]: (r["first"].k, -r["first"].t) for r in rows}
    order = sorted(first)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # of the first range: the last one
    total = starts[-1] + 1
    of = lambda values: F.element_at(F.lit([values.get(r, 0) for r in range(total)]), F.col("range") + 1)
    leads = (key == of({r: k for r, (k, _) in first.items()})) & (F.col("_tie") == of({r: t for r, (_, t) in first.items()}))
    home, other = F.struct("range", F.lit(0).alias("guest")), F.struct(of(before).cast("int").alias("range"), F.lit(1).alias("guest"))
    homes = F.explode(F.when(leads, F.array(home, other)).otherwise(F.array(home))).alias("home")
    rows = placed.select("doc_id", "text", "_tie", homes).select("home.range", "home.guest", "doc_id", "text", "_tie")
    return rows.repartitionById(total, F.col("range")).sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "_tie", "text").drop("_tie")


_FIELDS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compared(batches):
    def rows():
        last = None  # range, doc_id, text, sketch of the row above, unless that was a guest
        for batch in slices(batches):
            for place, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if guest and (last is None or last[0] != place):
                    continue
                own = sketch(text)
                if last is not None and last[0] == place:
                    _, above_id, above, sk = last
                    new = edited(above, text)
                    changed = sketch(new)
                    yield above_id, len(above), hashlib.sha256(new.encode()).hexdigest(), to_text(sk), to_text(changed), likeness(sk, changed), likeness(sk, own)
                last = None if guest else (place, doc_id, text, own)

    yield from batched(rows(), _FIELDS, 512)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_next(docs, partitions(spark)).mapInArrow(_compared, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
