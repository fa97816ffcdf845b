"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank vocabulary.

Each token's bytes are mapped to letters (byte b to code point 256 + b), which makes the pieces of a sentencepiece BPE
model. A piece's score is its negative rank, so sentencepiece merges the pair of the least rank first, the leftmost of ties,
as byte-level BPE does. Normalisation is the identity. Piece ids are the ranks. Texts are cut into pre-tokens by the
vocabulary's pattern; a pre-token that is a token as a whole is that token. Decoding maps ids to pieces and letters to bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import small_batches

LETTER = 256
#: Entries of a generation of a worker's pre-token cache; two generations are held.
CACHE = 250_000

# fixed values: field numbers and enum values of sentencepiece's model format
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE, _SCORE, _TYPE, _UNKNOWN = 1, 2, 3, 2
_MODEL_TYPE, _BPE, _VOCAB_SIZE, _UNK_ID, _BOS_ID, _EOS_ID, _PAD_ID = 3, 2, 4, 40, 41, 42, 43
_NAME, _DUMMY_PREFIX, _EXTRA_SPACE, _ESCAPE = 1, 3, 4, 5


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, b: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(b)) + b


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a token in base64 and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_LETTER)


_TO_LETTER = {b: LETTER + b for b in range(256)}


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; ranks must be 0, 1, 2, ..."""
    out = []
    for i, (token, rank) in enumerate(sorted(ranks.items(), key=lambda x: x[1])):
        if i != rank:
            raise ValueError(f"ranks have a gap at {i}")
        score = _varint(_SCORE << 3 | 5) + np.float32(-rank).tobytes()
        out.append(_bytes(_PIECES, _bytes(_PIECE, letters(token).encode()) + score))
    out.append(_bytes(_PIECES, _bytes(_PIECE, b"<unk>") + _varint(_SCORE << 3 | 5) + np.float32(-len(ranks)).tobytes() + _number(_TYPE, _UNKNOWN)))
    trainer = _number(_MODEL_TYPE, _BPE) + _number(_VOCAB_SIZE, len(ranks) + 1) + _number(_UNK_ID, len(ranks))
    trainer += b"".join(_number(k, -1) for k in (_BOS_ID, _EOS_ID, _PAD_ID))
    normalizer = _bytes(_NAME, b"identity") + b"".join(_number(k, 0) for k in (_DUMMY_PREFIX, _EXTRA_SPACE, _ESCAPE))
    return b"".join(out) + _bytes(_TRAINER, trainer) + _bytes(_NORMALIZER, normalizer)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.pre_tokens = regex.compile(pattern)
        self.whole = {token.decode(): rank for token, rank in self.ranks.items() if _is_text(token)}
        self.back = [self.model.id_to_piece(i).encode("utf-16-le")[::2] for i in range(len(self.ranks))]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.young) + len(words) > CACHE:
            self.old, self.young = self.young, {}
        new = []
        for word in [w for w in words if w not in self.young]:
            if (ids := self.old.get(word)) is not None:
                self.young[word] = ids
            elif (rank := self.whole.get(word)) is not None:
                self.young[word] = rank.to_bytes(4, "little")
            else:
                new.append(word)
        if new:
            for word, ids in zip(new, self.model.encode([letters(w.encode()) for w in new], num_threads=1), strict=True):
                self.young[word] = np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        words = self.pre_tokens.findall(text)
        self._learn(set(words))
        return b"".join(map(self.young.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.back.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


_models: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _models:
        _models[path, pattern] = ByteBpe(path, pattern)
    return _models[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (an array of longs) of each row; a null text is empty and has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t or ""), "<u4").astype(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ("doc_id", "ids"))

    return _own(docs).mapInArrow(run, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text bytes of rows with ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            raw = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ("doc_id", "bytes"))

    small_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def _own(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each whole text encoded, then its ids decoded, a row for each row.

    A null or empty text has no tokens; a very long text is one more text; null ids and repeated rows pass through; other
    columns are not carried; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            n, made, back = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                made.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(made, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))

    return _own(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
