"""Repeated windows as Spark jobs over content-defined anchors; see `anchors` for the idea.

A piece is part of a text that still has to be looked at: (doc, loc, text), where `loc` holds the
CRC-32 of the whole text in its upper half and the piece's first symbol in its lower half.  Rows that
share an id and a text are one document; rows that share only the id are ordered by that checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylens.llm import anchors as A
from policylens.llm.common import column, give_back, written

_N = A.KIND_BITS + 1
_OFFSET = _N + A.N_BITS


def _named(docs: DataFrame, text: str, doc_id: str, others: list[str], nameless: bool = False) -> DataFrame:
    """(doc, loc, text) and the other columns by number.

    `nameless`: a row without an id is named by a hash of its text, so that it takes part.
    """
    crc = F.crc32(F.col(f"`{text}`").cast("binary"))
    doc, kind = F.col(f"`{doc_id}`"), docs.schema[doc_id].dataType.simpleString()
    if nameless:
        own = F.xxhash64(F.lit("nameless"), F.col(f"`{text}`"))
        doc = F.coalesce(doc, (own if kind in ("bigint", "string") else F.pmod(own, F.lit(1 << 31))).try_cast(kind))
    return docs.select(
        doc.alias("doc"),
        F.shiftleft(crc, 32).alias("loc"),
        F.col(f"`{text}`").alias("text"),
        *[F.col(f"`{c}`").alias(f"other{i}") for i, c in enumerate(others)],
    )


_TAKES_PART = "doc is not null and text is not null and loc is not null"


def pieces_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", nameless: bool = False) -> DataFrame:
    """Whole texts as pieces.  Null texts take no part, and rows without an id only if `nameless`."""
    return _named(docs, text, doc_id, [], nameless).where(_TAKES_PART)


def _id_type(pieces: DataFrame) -> str:
    return pieces.schema["doc"].dataType.simpleString()


def cell_rows(pieces: DataFrame, unit: str, length: int, gram: int) -> DataFrame:
    """The cells of all pieces, combined within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = A.Powers()
        ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            keys = pa.concat_arrays(ids)
            rank = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            g, cover, doc, loc, n, offset = (np.concatenate(x) for x in zip(*held))
            _, back = np.unique(rank, return_index=True)
            rows = A.combined(g, cover, rank[doc], loc, n, offset)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["g"].view(np.int64)),
                    pa.array(rows["cover"].view(np.int64)),
                    keys.take(pa.array(back[rows["doc"]])),
                    pa.array(rows["loc"]),
                    pa.array(rows["bits"]),
                ],
                ["g", "cover", "doc", "loc", "bits"],
            )

        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                first = sum(map(len, ids))
                ids.append(column(part, "doc"))
                loc = column(part, "loc").to_numpy()
                texts = ((i, t.as_buffer().to_pybytes()) for i, t in enumerate(column(part, "text")))
                made = A.byte_blocks(texts, length) if unit == "byte" else A.word_blocks(texts, length, powers)
                for numbers, offsets, values, ends in made:
                    c = A.cells(values, ends, length, gram, powers)
                    at = np.searchsorted(ends, c.first, side="right") - 1
                    number = np.array(numbers)[at]
                    offset = np.array(offsets)[at] + c.first - ends[at]
                    held.append((c.gram, c.cover, first + number, loc[number] + offset, c.last - c.first + 1, offset))
                    size += len(c.first)
                if size > A.HELD:
                    yield flush()
                    ids, held, size = [], [], 0
        if size:
            yield flush()
        ids, held = [], []
        give_back()

    return pieces.mapInArrow(run, A.CELL_SCHEMA.format(id=_id_type(pieces)))


def sift(pieces: DataFrame, unit: str, length: int, gram: int, keep_first: bool, name: str) -> DataFrame:
    """What a round finds out about cells whose gram recurs: (doc, piece, offset, n, repeated, down).

    `repeated`: all `n` windows of the cell recur (with `keep_first`: start earlier as well).  `down`: the
    gram also recurs with other symbols around it, so single windows may recur that the cell as a whole
    does not tell; of equal cells the earliest stands for all.
    """
    cells = cell_rows(pieces, unit, length, gram)
    kind, copied = F.col("bits").bitwiseAND(3), F.shiftright("bits", A.KIND_BITS).bitwiseAND(1)
    same = Window.partitionBy("g")
    looked = cells.select(
        "*",
        (kind == A.ALONE).alias("alone"),
        F.count(F.lit(1)).over(same).alias("rows"),
        ((F.min("cover").over(same) != F.max("cover").over(same)) | (F.max((kind == A.NOTICE).cast("int")).over(same) == 1)).alias("varied"),
    )
    known = (kind == A.KNOWN) | (kind == A.COPY)
    open_ = looked.where(known | (F.col("alone") & ((F.col("rows") > 1) | (copied == 1)))).select(
        F.when(F.col("alone"), F.col("g").bitwiseXOR(F.col("cover"))).otherwise(F.col("g")).alias("class"),
        "cover",
        F.struct("doc", "loc").alias("place"),
        "bits",
        ((kind == A.KNOWN) | (F.col("alone") & F.col("varied"))).alias("varied"),
    )
    equal = Window.partitionBy("class", "cover")
    first, last = F.min("place").over(equal), F.max("place").over(equal)
    several = (first != last) | (F.max(copied).over(equal) == 1)
    is_copy = kind == A.COPY
    later = F.col("place") != first
    told = open_.select(
        "place",
        "bits",
        (is_copy | (later if keep_first else several)).alias("repeated"),
        (F.col("varied") & ~is_copy & ~later).alias("down"),
    )
    offset = F.shiftright("bits", _OFFSET)
    marks = told.where("repeated or down").select(
        F.col("place.doc").alias("doc"),
        (F.col("place.loc") - offset).alias("piece"),
        offset.cast("int").alias("offset"),
        F.shiftright("bits", _N).bitwiseAND((1 << A.N_BITS) - 1).cast("int").alias("n"),
        "repeated",
        "down",
    )
    return written(marks, name)


def below(pieces: DataFrame, marks: DataFrame, unit: str, length: int) -> DataFrame:
    """The parts of `pieces` that the windows of the cells marked `down` cover, as pieces."""
    wanted = marks.where("down").groupBy("doc", "piece").agg(F.collect_list(F.struct("offset", "n")).alias("cuts"))
    met = pieces.join(wanted, (pieces["doc"] == wanted["doc"]) & (pieces["loc"] == wanted["piece"])).select(
        pieces["doc"], "loc", "text", "cuts"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, locs, parts = [], [], []
            texts, cuts, base = column(batch, "text"), column(batch, "cuts").to_pylist(), column(batch, "loc").to_pylist()
            for i, wanted_cuts in enumerate(cuts):
                raw = texts[i].as_buffer().to_pybytes()
                symbols = raw if unit == "byte" else raw.split()
                for cut in wanted_cuts:
                    part = symbols[cut["offset"] : cut["offset"] + cut["n"] + length - 1]
                    rows.append(i)
                    locs.append(base[i] + cut["offset"])
                    parts.append(part if unit == "byte" else b" ".join(part))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc").take(pa.array(rows, pa.int64())), pa.array(locs, pa.int64()), pa.array(parts, pa.binary())],
                ["doc", "loc", "text"],
            )

    return met.mapInArrow(run, f"doc {_id_type(pieces)}, loc long, text binary")


def spans(marks: DataFrame) -> DataFrame:
    """(doc, loc, n): `n` repeated windows in a row, by where the first starts."""
    return marks.where("repeated").select("doc", (F.col("piece") + F.col("offset")).alias("loc"), "n")


def with_spans(docs: DataFrame, found: DataFrame, text: str, doc_id: str, keep: list[str], nameless: bool = False) -> DataFrame:
    """(row, text, spans): the columns `keep`, the text as bytes and an array of (start, n) of its repeated
    windows, null if there are none.

    Texts are dealt out here as in `below`, so one shuffle of them serves both.
    """
    others = [c for c in keep if c != text]
    per_doc = found.groupBy("doc", F.shiftleft(F.shiftrightunsigned("loc", 32), 32).alias("whole")).agg(
        F.collect_list(F.struct(F.col("loc").bitwiseAND(0xFFFFFFFF).alias("start"), "n")).alias("spans")
    )
    named = _named(docs, text, doc_id, others, nameless)
    whole = named.where(_TAKES_PART)
    joined = whole.join(per_doc, (whole["doc"] == per_doc["doc"]) & (whole["loc"] == per_doc["whole"]), "left")
    rest = named.where(f"not ({_TAKES_PART})")
    place = {text: "text"} | {c: f"other{i}" for i, c in enumerate(others)}

    def shaped(df: DataFrame, spans_: Column) -> DataFrame:
        row = F.struct(*[F.col(place[c]).alias(c) for c in keep])
        return df.select(row.alias("row"), F.col("text").cast("binary").alias("text"), spans_.alias("spans"))

    none = F.lit(None).cast(per_doc.schema["spans"].dataType)
    return shaped(joined, F.col("spans")).unionByName(shaped(rest, none))


def covered(n_symbols: int, found: list[dict] | None, length: int) -> np.ndarray:
    """Per symbol whether a repeated window covers it."""
    change = np.zeros(n_symbols + 1, np.int64)
    if found:
        start = np.array([s["start"] for s in found])
        end = start + np.array([s["n"] for s in found]) + length - 1
        np.add.at(change, np.minimum(start, n_symbols), 1)
        np.add.at(change, np.minimum(end, n_symbols), -1)
    return np.cumsum(change[:-1]) > 0
