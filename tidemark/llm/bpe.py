"""Byte-level BPE by a sentencepiece model that is serialised from a rank vocabulary.

Each token of the vocabulary becomes a piece: its bytes, mapped to one printable character each, with the negative rank as
score. With identity normalisation, sentencepiece then joins the adjacent pair of the smallest rank first, the leftmost of
equals, as byte-level BPE asks. Texts are cut into pre-tokens; distinct ones are encoded once per batch, many in one call,
parted by a character that no piece holds. Ids are ranks, so decoding is a look-up of each id's bytes.

The model is built on the driver from the vocabulary file (a parameter) and travels with the function: about 1 MB, fixed by
the vocabulary and not by the data. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, table

CACHED, LONGEST = 200_000, 48  # pre-tokens that a task remembers at most, and the most characters of one
GAP = "\ue000"  # between pre-tokens: in no piece, and no byte maps to it
CALL = 1 << 20  # characters that one call of the encoder gets, unless one pre-token alone has more


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> str:
    """256 characters, none of them blank: byte b is character 256 + b, a rule that is one-to-one and touches no special sign."""
    return "".join(chr(256 + b) for b in range(256))


def _field(number: int, payload: bytes | int | float | bool) -> bytes:
    if isinstance(payload, float):
        return _varint(number << 3 | 5) + struct.pack("<f", payload)
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(int(payload))
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is token i, mapped; one more piece stands for what is unknown."""
    to = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, "".join(to[b] for b in t).encode()) + _field(2, -float(rank)) + _field(3, normal) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(40, len(tokens))
    normaliser = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes within one task."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str) -> None:
        import sentencepiece

        self.tokens, self.gap = tokens, len(tokens)
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.shift = {b: c for b, c in enumerate(byte_characters())}
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.known: dict[str, tuple[int, ...]] = {}

    def _encode_pieces(self, pieces: list[str]) -> Iterator[tuple[int, ...]]:
        """Ids of each of some pre-tokens, in one call."""
        text = GAP.join(p.encode().decode("latin-1").translate(self.shift) for p in pieces)
        ids = self.encoder.encode(text, out_type=int)
        at = 0
        for p in pieces:
            end = at
            while end < len(ids) and ids[end] != self.gap:
                end += 1
            # a pre-token that is a token is that token, whether or not merges would lead to it
            yield (whole,) if (whole := self.whole.get(p.encode())) is not None else tuple(ids[at:end])
            at = end + 1

    def _learn(self, new: Iterable[str], into: dict[str, tuple[int, ...]]) -> None:
        group: list[str] = []
        size = 0
        for p in itertools.chain(new, [None]):
            if group and (p is None or size + len(p) > CALL):
                into.update(zip(group, self._encode_pieces(group), strict=True))
                group, size = [], 0
            if p is not None:
                group.append(p)
                size += len(p) + 1

    def encode(self, text: str) -> list[int]:
        pieces = self.find(text)
        new = {p for p in pieces if p not in self.known}
        look = self.known
        if new:
            if len(self.known) > CACHED:
                self.known.clear()
                new = set(pieces)
            short = {p for p in new if len(p) <= LONGEST}
            self._learn(short, self.known)
            if len(short) < len(new):
                rare: dict[str, tuple[int, ...]] = {}
                self._learn(new - short, rare)
                look = self.known | rare if len(pieces) > 50_000 else {p: rare.get(p) or self.known[p] for p in set(pieces)}
        return list(itertools.chain.from_iterable(map(look.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Vocabulary:
    """What travels to the tasks; path and pattern are the parameters."""

    def __init__(self, path: str, pattern: str) -> None:
        self.tokens, self.pattern = read_ranks(path), pattern
        self.model = serialise(self.tokens)

    def codec(self) -> Codec:
        return Codec(self.tokens, self.model, self.pattern)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (array<int>); null text counts as empty; a row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            for part in _parts(batch):
                ids = pa.array([codec.encode(x.as_py() or "") for x in part.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """rows (doc_id, ids) -> doc_id, bytes: of any ids of the vocabulary, valid UTF-8 or not; null ids: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for batch in batches:
            found = pa.array([codec.decode(x.as_py() or ()) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "bytes"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def tokenised(docs: DataFrame, vocabulary: Vocabulary, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids]: encodes, then decodes the ids; rows and nulls as in encode()."""
    decimal = [str(i) for i in range(len(vocabulary.tokens))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = vocabulary.codec()
        for part in (p for batch in batches for p in _parts(batch)):
            counts, digests, decoded, kept = [], [], [], []
            for x in part.column(1):
                ids = codec.encode(x.as_py() or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            columns = {"doc_id": part.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(kept, pa.list_(pa.int32()))} if with_ids else {}))

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def _rows(docs: DataFrame) -> DataFrame:
    return documents_only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))


def _parts(batch: pa.RecordBatch, size: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices that keep the ids of one output batch small."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def public_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"), public_vocabulary(), with_ids=False)
