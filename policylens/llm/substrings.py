"""Substring deduplication: suffix trees over words, partitioned by prefixes of variable length.

Words covered by a window of `LENGTH` words that also starts earlier are removed.  Suffixes matter to
a depth of `LENGTH` words, and only where their surroundings recur: a first round over content-defined
anchors (see `anchors`) finds windows that recur with all around them, and leaves those for which the
words have to be followed.  Their suffixes become labelled paths of four edges (the first `EDGES[0]`
words, then `EDGES[1]` more, and so on).  Range boundaries over these paths split them at prefixes as
long as it takes to fill every task alike, and a task grows the subtrees of its range from the sorted
paths: an internal node as deep as a window is a repeat, its first leaf is the earliest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylens.llm import anchors as A
from policylens.llm.common import arrow_map, column
from policylens.llm.repeats import below, covered, pieces_of, sift, spans, with_spans

#: Words of a window, of an anchor, and of the edges of a path.
LENGTH, GRAM, EDGES = 20, 8, (8, 4, 4, 4)
#: Suffixes that a task holds to combine equal ones before they are shuffled.
HELD = 500_000

_PATH = ["e0", "e1", "e2", "e3"]


def suffixes(pieces: DataFrame) -> DataFrame:
    """A path per window start of every piece: (e0, ..., e3, doc, loc, copy).

    Of equal paths of a task the earliest goes on; the others are marked as copies and lie anywhere.
    """
    id_type = pieces.schema["doc"].dataType.simpleString()
    cuts = [0, *accumulate(EDGES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = A.Powers()
        ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            keys = pa.concat_arrays(ids)
            rank = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            *path, doc, loc = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((loc, rank[doc], *reversed(path)))
            path, doc, loc = [p[order] for p in path], doc[order], loc[order]
            same = np.append(False, np.all([np.diff(p) == 0 for p in path], axis=0))
            again = same & np.append(False, (np.diff(rank[doc]) == 0) & (np.diff(loc) == 0))
            path, doc, loc, same = [p[~again] for p in path], doc[~again], loc[~again], same[~again]
            path[0] = np.where(same, A.mixed(loc.astype(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), path[0])
            return pa.RecordBatch.from_arrays(
                [*[pa.array(p.view(np.int64)) for p in path], keys.take(pa.array(doc)), pa.array(loc), pa.array(same)],
                [*_PATH, "doc", "loc", "copy"],
            )

        for batch in batches:
            first = sum(map(len, ids))
            ids.append(column(batch, "doc"))
            loc = column(batch, "loc").to_numpy()
            texts = ((i, t.as_buffer().to_pybytes()) for i, t in enumerate(column(batch, "text")))
            for numbers, offsets, values, ends in A.word_blocks(texts, LENGTH, powers):
                names = A.Names(values[0], 0, powers)
                room = np.repeat(ends[1:], np.diff(ends)) - np.arange(values.shape[1]) >= LENGTH
                at = np.flatnonzero(room)
                which = np.searchsorted(ends, at, side="right") - 1
                number = np.array(numbers)[which]
                path = [names.of(at + s, at + e) for s, e in zip(cuts, cuts[1:])]
                held.append((*path, first + number, loc[number] + np.array(offsets)[which] + at - ends[which]))
                size += len(at)
            if size > HELD:
                yield flush()
                ids, held, size = [], [], 0
        if size:
            yield flush()

    return pieces.mapInArrow(run, f"e0 long, e1 long, e2 long, e3 long, doc {id_type}, loc long, copy boolean")


def common_depth(path: np.ndarray) -> np.ndarray:
    """Words that each of the sorted paths (edges x suffixes) shares with the one before it."""
    same = np.diff(path, axis=1) == 0
    depth = np.cumprod(same, axis=0).T @ np.array(EDGES)
    return np.append(0, depth)


def later_leaves(paths: DataFrame) -> DataFrame:
    """(doc, loc) of suffixes below a node of depth `LENGTH` that are not its earliest leaf."""
    id_type = paths.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first_doc = first_loc = None
        for batch in batches:
            if not batch.num_rows:
                continue
            path = np.stack([column(batch, e).to_numpy() for e in _PATH])
            doc, loc = column(batch, "doc"), column(batch, "loc").to_numpy()
            held = path if last is None else np.hstack([last, path])
            depth = common_depth(held)[0 if last is None else 1 :]
            inner = depth == LENGTH
            # the first leaf of each node: of this batch, or carried over from the one before
            opening = np.where(inner, -1, np.arange(len(inner)))
            opening = np.maximum.accumulate(opening)
            carried = opening < 0
            at = np.maximum(opening, 0)
            same_place = np.array(loc == np.where(carried, first_loc if first_loc is not None else 0, loc[at]))
            if same_place.any() and inner.any():
                doc_list = doc.to_pylist()
                for i in np.flatnonzero(same_place & inner):
                    same_place[i] = doc_list[i] == (first_doc if carried[i] else doc_list[at[i]])
            told = column(batch, "copy").to_numpy(zero_copy_only=False) | (inner & ~same_place)
            if not carried[-1]:
                first_doc, first_loc = doc[int(at[-1])].as_py(), loc[at[-1]]
            last = path[:, -1:]
            keep = pa.array(np.flatnonzero(told))
            yield pa.RecordBatch.from_arrays([doc.take(keep), pa.array(loc[told])], ["doc", "loc"])

    grown = paths.repartitionByRange(*_PATH).sortWithinPartitions(*_PATH, "doc", "loc")
    return grown.mapInArrow(run, f"doc {id_type}, loc long")


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, loc, n) of all window starts whose words start earlier as well."""
    pieces = pieces_of(docs, text, doc_id)
    marks = sift(pieces, "word", LENGTH, GRAM, True, "word-anchors")
    leaves = later_leaves(suffixes(below(pieces, marks, "word", LENGTH)))
    return spans(marks).unionByName(leaves.withColumn("n", F.lit(1)))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns) with `n_words`, `n_removed` and `kept` (words joined by one space).

    A null text has no words.  Windows never cross texts; the earlier one has the smaller id, or starts
    earlier in the same text.  Rows without an id lose nothing and match nothing.  Repeated rows of one
    id and text are one document and get equal results; rows that share only the id are ordered by the
    CRC-32 of their texts.  Columns of `docs` named like a new one are replaced.
    """
    kept = [c for c in keep or docs.columns if c.lower() not in ("n_words", "n_removed", "kept")]
    held = with_spans(docs, repeated_spans(docs, text, doc_id), text, doc_id, kept)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, rest = [], [], []
        for raw, found in zip(column(batch, "text").to_pylist(), column(batch, "spans").to_pylist()):
            words = (raw or b"").split()
            n.append(len(words))
            if found:
                away = covered(len(words), found, LENGTH)
                words = [w for w, a in zip(words, away.tolist()) if not a]
            gone.append(n[-1] - len(words))
            rest.append(b" ".join(words).decode())
        return pa.RecordBatch.from_arrays(
            [column(batch, "row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(rest, pa.string())],
            ["row", "n_words", "n_removed", "kept"],
        )

    out = arrow_map(held, work, f"row {held.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "n_words", "n_removed", "kept")
