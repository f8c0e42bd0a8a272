"""SentencePiece encoding that keeps byte offsets, and decoding.

The text is normalised by the longest prefixes of the model's compiled character map; each normalised byte remembers the
original byte it came from. The normalised text is cut where no piece can reach across, each distinct cut is segmented once
by the library's merges, and the pieces' byte lengths, laid along the alignment, give every piece its span of original bytes.

Defined results: a null text is an empty one: begin and end id only, no span of its own. Long texts are encoded whole.
Repeated rows are encoded alike; extra columns are not read; an empty table gives an empty result. A model without byte
fallback is refused, since an unknown piece has no length of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, slices, table

SPACE = "▁"
_MARK = SPACE.encode()


# --- the model file: the few fields that normalisation needs ------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield number, data[at : at + size]
        at += size


class CharMap:
    """The compiled map: a double-array trie of prefixes, whose values are offsets of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that data has at `at`."""
        units, found = self.units, None
        node = self._base(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            leaf = units[node] >> 8 & 1
            node ^= self._base(units[node])
            if leaf:
                start = units[node] & 0x7FFFFFFF
                found = self.replacements[start : self.replacements.index(b"\0", start)], k + 1 - at
        return found

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)


class Normaliser:
    """Normalised bytes of a text, and the original byte that each came from."""

    def __init__(self, spec: bytes):
        f = dict(_fields(spec))
        self.map = CharMap(f[2]) if f.get(2) else None
        self.prefix, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        if not f.get(5, 1):
            raise ValueError("models that don't escape white space are not handled")

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """align has one entry more than there are bytes: the end of the text."""
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze:
            out = data.replace(b" ", _MARK)
            width = np.where(np.frombuffer(data, np.uint8) == 32, len(_MARK), 1)
            align = np.append(np.repeat(np.arange(len(data)), width), len(data))
        else:
            out, align = self._mapped(data)
        if self.prefix and out:
            out, align = _MARK + out, np.concatenate([np.full(len(_MARK), align[0]), align])
        return out, align

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, align, at = bytearray(), [], 0
        while at < len(data):
            found = self.map and self.map.longest(data, at)
            if found:
                new, size = found
            else:
                size = 1 if data[at] < 128 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                new = data[at : at + size]
            for k, byte in enumerate(new):
                if byte != 32:
                    out.append(byte)
                    align.append(at + k if new == data[at : at + size] else at)
                elif not self.squeeze or (out and not out.endswith(_MARK)):
                    out += _MARK
                    align += [at] * len(_MARK)
            at += size
        end = len(data)
        while self.squeeze and out.endswith(_MARK):
            del out[-len(_MARK) :]
            end = align[-len(_MARK)]
            del align[-len(_MARK) :]
        return bytes(out), np.array([*align, end], np.int64)


class OffsetEncoder:
    def __init__(self, path: str, most: int = 250_000):
        import sentencepiece

        raw = open(path, "rb").read()
        top = list(_fields(raw))
        pieces = [dict(_fields(v)) for k, v in top if k == 1]
        kinds = [p.get(3, 1) for p in pieces]
        if 6 not in kinds:
            raise ValueError("the model has no byte fallback")
        texts = [p[1].decode() for p in pieces]
        normal = [t for t, k in zip(texts, kinds) if k == 1]
        self.normalise = Normaliser(next((v for k, v in top if k == 3), b""))
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        # a second normaliser spec is merged over the first: no map, no prefix, nothing removed
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=raw + bytes([0x1A, 8, 0x12, 0, 0x18, 0, 0x20, 0, 0x28, 1]))
        self.bytes_of = np.array([0 if k in (2, 3) else 1 if k == 6 else len(t.encode()) for t, k in zip(texts, kinds)], np.int64)
        joined = {c for t in normal if len(t) > 1 for c in t}
        # no cut is safe if a piece goes on after its leading marks with another mark, or is matched before the merges
        self.cuts = None
        if not any(SPACE in t.lstrip(SPACE) for t in normal) and not {4, 5} & {*kinds}:
            self.cuts = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if "\n" not in joined else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, list[int]] = {}
        self.most = most

    def encode(self, texts: list[str], spans: bool = True) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """ids with begin and end id; first and past-the-end original byte of every piece between them."""
        ready = [self.normalise(t) for t in texts]
        cut = [self.cuts.findall(n.decode()) if self.cuts else [n.decode()] * bool(n) for n, _ in ready]
        known, new = self.known.get, set()
        held = []
        for words in cut:
            parts = list(map(known, words))
            held.append(parts)
            if None in parts:
                new.update(w for w, p in zip(words, parts) if p is None)
        order = list(new)
        learnt = dict(zip(order, self.plain.encode(order, num_threads=1))) if order else {}
        out = []
        bos, eos = self.processor.bos_id(), self.processor.eos_id()
        for (data, align), words, parts in zip(ready, cut, held):
            ids = [bos]
            for w, p in zip(words, parts):
                ids += learnt[w] if p is None else p
            ends = np.cumsum(self.bytes_of[ids[1:]])
            if (int(ends[-1]) if len(ends) else 0) != len(data):
                raise ValueError("pieces don't cover the normalised text")
            starts = np.append(0, ends[:-1]) if len(ends) else ends
            ids.append(eos)
            out.append((ids, align[starts], align[ends]))
        learnt = {w: i for w, i in learnt.items() if len(w) <= 64}
        if len(self.known) + len(learnt) > self.most:
            self.known.clear()
        self.known.update(learnt)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


_ENCODERS: dict[str, OffsetEncoder] = {}


def encoder(path: str) -> OffsetEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = OffsetEncoder(path)
    return _ENCODERS[path]


def _mapped(docs: DataFrame, schema: str, fields: pa.Schema, rows_of, size: int) -> DataFrame:
    def run(batches):
        def rows():
            for batch in slices(batches, 64):
                yield from rows_of(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()])

        yield from batched(rows(), fields, size)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, starts, ends): ids with begin and end id; the byte span of every id between them."""

    def rows_of(doc_ids, texts):
        for doc_id, (ids, starts, ends) in zip(doc_ids, encoder(model).encode(texts)):
            yield doc_id, ids, starts, ends

    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    return _mapped(docs, "doc_id bigint, ids array<int>, starts array<bigint>, ends array<bigint>", fields, rows_of, 128)


def encoded_digests(docs: DataFrame, model: str) -> DataFrame:
    """Counts and digests of what encode_documents gives and of its decoding, made where the ids are, so they don't travel."""

    def rows_of(doc_ids, texts):
        enc = encoder(model)
        for doc_id, (ids, starts, ends) in zip(doc_ids, enc.encode(texts)):
            spans = hashlib.sha256(np.stack([starts, ends]).astype("<i8").tobytes()).hexdigest()
            yield doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest(), spans

    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string())])
    return _mapped(docs, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string", fields, rows_of, 1024)


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return encoded_digests(table(spark, sf_dir, "documents"), model)
