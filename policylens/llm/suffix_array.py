"""Repeated strings of bytes by content-defined positions, in place of plain prefix doubling.

Every byte that a string of `LENGTH` bytes covers which also starts elsewhere is removed.  Plain prefix
doubling sorts one (rank, rank) pair per byte and round, many times the size of the text; here a round
ranks strings of a growing length only at the positions that every window of `LENGTH` bytes picks for
itself (see `anchors`).  A position whose string is unique is done.  If the string recurs together with
all that its windows cover, these windows are past the threshold and done as well; what is left is
picked anew with a longer string, until the string is the window itself.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylens.llm.common import arrow_map, column, written
from policylens.llm.repeats import below, covered, pieces_of, sift, spans, with_spans

#: Bytes of a string whose repetition counts, and of the strings that the rounds rank.
LENGTH = 200
ROUNDS = (64, 180, LENGTH)


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, loc, n) of all starts of repeated strings."""
    pieces, found = pieces_of(docs, text, doc_id, nameless=True), []
    for i, gram in enumerate(ROUNDS):
        marks = sift(pieces, "byte", LENGTH, gram, False, f"ranks-{gram}")
        found.append(spans(marks))
        if i + 1 < len(ROUNDS):
            pieces = written(below(pieces, marks, "byte", LENGTH), f"left-after-{gram}")
    return reduce(DataFrame.unionByName, found)


def _judged(docs: DataFrame, text: str, doc_id: str, keep: list[str], as_text: bool = False) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): the columns `keep` and what is left of each text.

    `as_text`: what is left as a string, without the remaining bytes of characters that are cut in two; null for a null text.
    """
    held = with_spans(docs, repeated_spans(docs, text, doc_id), text, doc_id, keep, nameless=True)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, rest = [], []
        for raw, found in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist()):
            raw, null = raw or b"", raw is None
            gone = covered(len(raw), found, LENGTH)
            left = np.frombuffer(raw, np.uint8)[~gone].tobytes() if found else raw
            rest.append((None if null else left.decode(errors="ignore")) if as_text else left)
            counts.append((len(raw), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())))
        n = np.array(counts, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays(
            [column(batch, "row"), *[pa.array(n[:, i]) for i in range(3)], pa.array(rest, pa.string() if as_text else pa.binary())],
            ["row", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    row_type, left = held.schema["row"].dataType.simpleString(), "string" if as_text else "binary"
    return arrow_map(held, work, f"row {row_type}, n_bytes long, n_removed long, n_spans long, kept {left}")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns) with `n_bytes`, `n_removed`, `n_spans` and `kept` (the remaining bytes).

    A null text counts as empty.  Matches never cross texts.  Rows without an id take part, named by
    their text.  Repeated rows of one id (or none) and text are one document: they do not count as
    each other's repetition and get equal results; rows that share only the id are told apart.  Columns
    of `docs` named like a new one are replaced.
    """
    kept = [c for c in keep or docs.columns if c.lower() not in ("n_bytes", "n_removed", "n_spans", "kept")]
    out = _judged(docs, text, doc_id, kept)
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "n_bytes", "n_removed", "n_spans", "kept")


def removed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with what repeats cut out of the text, all other columns as they were.

    Of a character that is cut in two, the remaining bytes go as well.  Texts without repetition, null
    ones too, are returned unchanged; a text that repeats as a whole becomes empty.
    """
    others = [c for c in docs.columns if c != text]
    out = _judged(docs, text, doc_id, others, as_text=True)
    return out.select(*[F.col("kept" if c == text else f"row.`{c}`").alias(c) for c in docs.columns])
