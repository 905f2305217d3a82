"""Byte-level BPE through a sentencepiece model written straight from a vocabulary.

Every byte stands for one character, so each token of the vocabulary is a piece; its score is its
negative rank, and the best-scored merge is then the one of lowest rank. Normalisation is the identity.
The model is a few protobuf fields, written here by hand. Texts are cut into pre-tokens by the
vocabulary's pattern, each is encoded by itself, and decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

# fixed values: field numbers and kinds of the public sentencepiece model format
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, BPE = 3, 2
VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 4, 40, 41, 42, 43
NAME, DUMMY_PREFIX, DROP_SPACES, ESCAPE_SPACES = 1, 3, 4, 5

#: The first of the 256 characters that stand for bytes.
BYTE_ZERO = 0x100
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 1 << 18
#: Rows that a task returns at a time.
ROWS = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def as_characters(data: bytes) -> str:
    """One character for each byte."""
    return "".join([chr(BYTE_ZERO + b) for b in data])


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose n-th piece is the n-th token by rank; the unknown piece is last."""
    pieces = [
        (as_characters(token), -float(rank), NORMAL) for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    ]
    pieces.append(("<unk>", 0.0, UNKNOWN))
    out = bytearray()
    for text, score, kind in pieces:
        score_field = _varint(SCORE << 3 | 5) + struct.pack("<f", score)
        out += _bytes(PIECES, _bytes(PIECE, text.encode()) + score_field + _number(KIND, kind))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(pieces)) + _number(UNK_ID, len(pieces) - 1)
    trainer += b"".join(_number(field, -1) for field in (BOS_ID, EOS_ID, PAD_ID))
    normalizer = _bytes(NAME, b"identity") + b"".join(
        _number(field, 0) for field in (DUMMY_PREFIX, DROP_SPACES, ESCAPE_SPACES)
    )
    return bytes(out + _bytes(TRAINER, trainer) + _bytes(NORMALIZER, normalizer))


class Codec:
    """Encodes and decodes whole texts; ``ranks`` are those that ``model`` was written from."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.cut = regex.compile(pattern).findall
        self.ranks = ranks
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.rank_of = sorted(ranks.values())
        self.token_of = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, list[int]] = {}

    def _learn(self, pretokens: set[str]) -> dict[str, list[int]]:
        """Ids of pre-tokens; one that is a token as a whole is that token, as in the vocabulary's own library."""
        found, rest = {}, []
        for text in pretokens:
            data = text.encode()
            rank = self.ranks.get(data)
            if rank is None:
                rest.append((text, as_characters(data)))
            else:
                found[text] = [rank]
        if rest:
            split = self.model.encode([c for _, c in rest], out_type=int, num_threads=1)
            found |= {t: [self.rank_of[i] for i in ids] for (t, _), ids in zip(rest, split, strict=True)}
        return found

    def encode(self, text: str) -> list[int]:
        pretokens = self.cut(text)
        known = self.known
        new = set(pretokens).difference(known)
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(pretokens)
            found = self._learn(new)
            if len(found) <= REMEMBERED:
                known |= found
            else:
                known = found
        return list(chain.from_iterable(map(known.__getitem__, pretokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(tokens: tuple[tuple[bytes, int], ...], pattern: str) -> Codec:
    return Codec(dict(tokens), pattern)


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` (array of int), ``decoded`` (the bytes the ids stand for).

    Whole texts are encoded; a null or empty text has no ids and no bytes. Repeated rows and null ids of
    documents pass through; an empty table gives no rows; other columns are ignored. The vocabulary is
    sent to the tasks once (its size is that of the rank file, whatever the input), so executors need
    no file of their own.
    """
    held = docs.sparkSession.sparkContext.broadcast((tuple(ranks.items()), pattern))

    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                ids = [codec.encode(t) if t else [] for t in rows.column("text").to_pylist()]
                columns = [rows.column("doc_id"), ids, list(map(codec.decode, ids))]
                yield pa.record_batch([columns[0], *map(pa.array, columns[1:], kind.types[1:])], schema=kind)

    numbered = docs.select(docs["doc_id"].cast("long"), "text")
    return numbered.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
