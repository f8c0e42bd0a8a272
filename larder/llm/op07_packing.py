"""Best-fit packing of documents into token sequences: local best-fit, nearly full bins go out, underfull ones merge in a tree.

Round one deals the pieces into groups of at most `per_group` by a hash and packs each group best-fit decreasing. Bins with
no more than `slack` tokens free are done. The others become items of the next round, dealt into fewer groups, until one
group holds them all or a round merges almost none. No task ever holds more than a group; rounds exchange lengths, never
tokens.

Defined results: a null or empty text is one piece that holds the end id alone. A document longer than a sequence is cut into
whole sequences and a rest. Repeated rows are packed each on its own. A null id is kept as it is. Extra columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, groups, partitions, slices, stored, table

CAPACITY, END_ID = 4096, 1


class WordBPE:
    """Ids of whole texts by a BPE tokenizer whose words are encoded one by one, each distinct word once.

    The tokenizer lower-cases, drops white space and cuts at a pattern, so a text's ids are its words' ids in a row. Texts of
    plain Latin letters, digits and common marks are cut here; any other text goes to the tokenizer whole.
    """

    _MARKS = "–—‘’“”„…€•"
    _PLAIN = [c for c in map(chr, [9, 10, 13, *range(32, 127), *range(0xA1, 0x17F)]) if c != "İ"] + [*_MARKS]
    _LETTERS = re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L"))
    _NUMBERS = re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N"))
    _OTHER = re.compile(f"[^{re.escape(''.join(_PLAIN))}]|<\\|")
    _WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = Tokenizer.from_file(path)  # takes words that are cut and byte-mapped already
        self.by_word.normalizer = normalizers.Sequence([])
        self.by_word.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {c: "".join(x for x, _ in level.pre_tokenize_str(c)) for c in self._PLAIN if not c.isascii()}
        self.mapped = str.maketrans(self.mapped)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.most = most

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Encodes words in one call; a word ends where an id carries the word-end mark."""
        line = " ".join(words)
        line = line if line.isascii() else line.translate(self.mapped)
        ids = np.array(self.by_word.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the tokenizer doesn't mark each word's end")
        data, at, out = ids.tobytes(), 0, {}
        for word, end in zip(words, (cuts * 4).tolist()):
            out[word] = data[at:end]
            at = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list = [None] * len(texts)
        known, waiting, new = self.known.get, [], set()
        for i, text in enumerate(texts):
            if self._OTHER.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            words = self._WORD.findall(text.lower())
            parts = list(map(known, words))
            if None in parts:
                waiting.append((i, words, parts))
                new.update(w for w, p in zip(words, parts) if p is None)
            else:
                out[i] = b"".join(parts)
        if new:
            learnt = self._learn(list(new))
            for i, words, parts in waiting:
                out[i] = b"".join([learnt[w] if p is None else p for w, p in zip(words, parts)])
            if len(self.known) + len(learnt) > self.most:
                self.known.clear()
            self.known.update(learnt)
        return out


_ENCODERS: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBPE(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut at the capacity."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        def rows():
            enc = encoder(tokenizer)
            for batch in slices(batches, 128):
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        yield (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(fields)]

        yield from batched(rows(), pa.schema(fields), 2048)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and what each bin holds; the items come in falling length for best-fit decreasing."""
    bins, offsets, fill = [], [], []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r free
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, fill


def _round(items: DataFrame, n: int, number: int, per_group: int, capacity: int) -> DataFrame:
    """items (any columns, length) with bin, place and held: what the bin holds in all."""
    spread = max(1, -(-n // per_group))
    keys = [c for c in items.columns if c != "length"]
    dealt = items.withColumn("group", F.pmod(F.xxhash64(F.lit(number), *keys), F.lit(spread)))
    dealt = dealt.select("group", F.col("length").cast("bigint"), *keys).repartition(min(spread, max(partitions(items.sparkSession), 1)), "group").sortWithinPartitions("group", F.desc("length"), *keys)
    at = (number << 58) if number < 16 else 0
    schema = dealt.select("group", "length", *keys, F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("held")).schema
    kinds = pa.schema([(f.name, {"int": pa.int32()}.get(f.dataType.simpleString(), pa.int64())) for f in schema])

    def run(batches):
        def rows():
            for (group,), members in groups(batches, 1):
                bins, offsets, fill = best_fit([m[0] for m in members], capacity)
                for m, b, o in zip(members, bins, offsets):
                    yield (group, *m, at + (group << 24) + b, o, fill[b])

        yield from batched(rows(), kinds)

    return stored(dealt.mapInArrow(run, schema).drop("group"), f"round{number}")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = 16, per_group: int = 100_000, most_rounds: int = 12) -> DataFrame:
    """pieces (bigint and int columns, length among them) with sequence_id and offset."""
    n = pieces.count()
    packed = _round(pieces, n, 0, per_group, capacity)
    out = packed.drop("held").withColumnsRenamed({"bin": "sequence_id", "place": "offset"})
    bins = packed.filter((F.col("place") == 0) & (F.col("held") < capacity - slack)).select(F.col("bin").alias("item"), F.col("held").alias("length"))
    groups_before = -(-n // per_group)
    for number in range(1, most_rounds):
        n = bins.count()
        if groups_before <= 1 or n < 2:
            break
        merged = _round(bins, n, number, per_group, capacity)
        out = (
            out.join(merged.select(F.col("item").alias("sequence_id"), "bin", "place"), "sequence_id", "left")
            .withColumns({"offset": F.col("offset") + F.coalesce("place", F.lit(0)), "sequence_id": F.coalesce("bin", "sequence_id")})
            .drop("bin", "place")
        )
        bins = merged.filter((F.col("place") == 0) & (F.col("held") < capacity - slack)).select(F.col("bin").alias("item"), F.col("held").alias("length"))
        groups_before = -(-n // per_group)
        if groups_before > 1 and merged.filter("place > 0").limit(n // 1000 + 1).count() <= n // 1000:
            break  # what is left doesn't fit together
    return out


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = stored(token_pieces(table(spark, sf_dir, "documents"), tokenizer), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
