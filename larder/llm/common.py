"""What the operators of this package share: scratch tables in the shared folder, streamed groups, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.sources.scratch import dropped, scratch, stored  # noqa: F401

#: ASCII white space as the operators' contracts name it: [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_count(counted: DataFrame, most: int) -> int:
    """The smallest count from which on at most so many rows are left; rows of equal counts stay or go together.

    counted has a column n. The driver sees how many rows have each count, counts from 2^10 on in powers of two.
    """
    return least_counts(counted.withColumn("_all", F.lit(0)), "_all", most).get(0, 1)


def least_counts(counted: DataFrame, by: str, most: int) -> dict:
    """The same for the rows of each value of the column `by`."""
    low, rows, least = 1 << 10, {}, {}
    step = F.when(F.col("n") < low, F.col("n")).otherwise(F.lit(1).cast("bigint") * F.pow(F.lit(2), F.floor(F.log2("n"))).cast("bigint"))
    for r in counted.groupBy(by, step.alias("at")).agg(F.count("*").alias("rows")).orderBy(by, F.desc("at")).collect():
        before = rows.get(r[by], 0)
        rows[r[by]] = before + r["rows"]
        if before <= most < rows[r[by]]:
            least[r[by]] = r["at"] + 1 if r["at"] < low else 2 * r["at"]
    return {x: least.get(x, 1) for x in rows}


# --- blocked Bloom filter: a relation (block, mask) of 64-bit blocks, DataFrame functions only ---------------------------

#: Bits of a block that a key sets; bits of the filter for each key; bytes up to which a filter goes to every task.
BITS, PER_KEY, SENT = 6, 16, 64 << 20


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def mask_of(key: Column) -> Column:
    """The bits of a key inside its block, from six slices of a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 10 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, mask) of the keys."""
    return listed.select(block_of(F.col(key), blocks).alias("block"), mask_of(F.col(key)).alias("m")).groupBy("block").agg(F.bit_or("m").alias("mask"))


def blocks_for(keys: int) -> int:
    """Blocks that give each key PER_KEY bits."""
    return max(1, -(-keys * PER_KEY // 64))


def with_possible(df: DataFrame, key: Column, bits: DataFrame, blocks: int, into: str) -> DataFrame:
    """df with a column `into`: whether the filter may hold the key. A filter of at most SENT bytes (16 a block) goes to every
    task; a larger one meets the rows by block, in a join that can be split."""
    filled = bits.select(F.col("block").alias("_bloom_block"), F.col("mask").alias("_bloom_mask"))
    filled = F.broadcast(filled) if 16 * blocks <= SENT else filled
    hit = mask_of(key).bitwiseAND(F.col("_bloom_mask")) == mask_of(key)
    return df.join(filled, block_of(key, blocks) == F.col("_bloom_block"), "left").withColumn(into, F.coalesce(hit, F.lit(False))).drop("_bloom_block", "_bloom_mask")


def free_name(taken: Iterable[str], name: str) -> str:
    """The name, with as many `_` before it as keep it from being one of those taken, in any case of letters."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most so many rows, which bounds what a Python worker holds beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of adjacent rows with equal first n_keys columns; the input is sorted by them within its partition."""
    key, rows = None, []
    for batch in slices(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches."""
    held: list[tuple] = []

    def packed() -> pa.RecordBatch:
        columns = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield packed()
            held = []
    if held:
        yield packed()


# --- hashes of words and shingles -------------------------------------------------------------------------------------

_SEEDED = np.random.default_rng(20240229)


def _odd(n: int) -> np.ndarray:
    return _SEEDED.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _odd(256)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[*WHITE_SPACE.encode()]] = True
_BASE = int(_odd(1)[0])
_PLACE = _odd(64)
_CASED = _odd(256)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2^64; grows as far as the longest run of text needs."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS * np.uint64(pow(_BASE, len(_POWERS), 2**64))])
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: all bits of a sum spread over the 64 of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, cased: bool = False) -> np.ndarray:
    """A 64-bit hash of each run of other than ASCII white space, in order; A-Z are taken as a-z unless cased."""
    return _hashed(text.encode(), cased)[0]


def word_hashes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of several texts, one after the other, and where each text's begin and the last one's end."""
    raw = [(t or "").encode() for t in texts]
    words, starts = _hashed(b"\n".join(raw))
    return words, np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw]))


def _hashed(raw: bytes, cased: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words and the bytes at which they begin."""
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
    values = (_CASED if cased else _BYTE)[data[inside]] * _powers(int(lengths.max()))[within]
    return mixed(np.add.reduceat(values, heads) + lengths.astype(np.uint64)), starts


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than size make one shingle, none make none."""
    words = word_hashes(text or "")
    n = len(words)
    if not n:
        return words
    if n < size:
        return mixed((words * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - size + 1] * _PLACE[0]
    for k in range(1, size):
        total = total + words[k : n - size + 1 + k] * _PLACE[k]
    return np.unique(mixed(total))


def char_shingle_hashes(text: str, size: int, below: int = 2**64) -> np.ndarray:
    """Sorted distinct hashes under `below` of the runs of `size` code points. A shorter text is one run, whose hash is always
    under `below`; an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    if not n:
        return points
    points = mixed(points)
    if n < size:
        return mixed((points * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) // np.uint64(2**64 // below)
    total = points[: n - size + 1] * _PLACE[0]
    for k in range(1, size):
        total = total + points[k : n - size + 1 + k] * _PLACE[k]
    hashes = mixed(total)
    return np.unique(hashes[hashes <= np.uint64(below - 1)])
