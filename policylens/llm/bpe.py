"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

The model is serialised straight from the vocabulary: each of the 256 bytes stands as one printable
character, piece i is the i-th token in those characters and scores -i, and normalisation is the
identity.  sentencepiece merges the adjacent pair whose piece scores highest, leftmost first, which
is the order of the ranks, so a pre-token gets the ids that rank merging gives it.  Every match of
the splitting pattern is encoded on its own; decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylens.llm.common import column, give_back

#: Distinct pre-tokens that a task remembers before it starts afresh.
CACHE = 200_000
#: Texts that are encoded before their ids leave the task.
ROWS = 128


def byte_characters() -> list[str]:
    """One printable character per byte value: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token, rank), by rank.  Ranks have to be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"ranks in {path} are not consecutive")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: a length-delimited, 32-bit float or integer value."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised_model(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of `tokens`; the unknown piece it has to hold comes last."""
    characters = byte_characters()
    pieces = [
        _field(1, "".join(characters[b] for b in token).encode()) + _field(2, -float(i)) + _field(3, 1)
        for i, token in enumerate(tokens)
    ]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Text to ids, as little-endian unsigned 32-bit integers in a row.  Pre-tokens met before are remembered."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.table = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; none for null."""
        parts = self.split(text) if text else []
        if new := list(set(parts).difference(self.known)):
            mapped = [p.encode().decode("latin-1").translate(self.table) for p in new]
            for part, got in zip(new, self.processor.encode(mapped, num_threads=1), strict=True):
                self.known[part] = struct.pack(f"<{len(got)}I", *got)
        out = b"".join(map(self.known.__getitem__, parts))
        if len(self.known) > CACHE:
            self.known.clear()
        return out


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """`keep` (default: all columns) with `token_ids` (binary, four bytes an id), `n_tokens` and `decoded` (binary).

    A null text counts as empty: no ids, empty `decoded`.  Texts of any length are encoded whole.
    Every row is encoded by itself, so repeated rows and null ids need no rule.  Columns of `docs`
    named like a new one are replaced.
    """
    tokens = read_ranks(path)
    model = serialised_model(tokens)
    kept = [c for c in keep or docs.columns if c.lower() not in ("token_ids", "n_tokens", "decoded")]
    held = docs.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = [encoder.encode(t) for t in column(part, "text").to_pylist()]
                back = [decode(x, tokens) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "row"), pa.array(ids, pa.binary()), pa.array(back, pa.binary())],
                    ["row", "token_ids", "decoded"],
                )
        give_back()

    out = held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, token_ids binary, decoded binary")
    n_tokens = (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "token_ids", n_tokens, "decoded")
