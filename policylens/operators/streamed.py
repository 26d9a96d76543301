"""Groups that pass through a task in order, a record batch at a time.

A job that learns needs the rows of a group in order and keeps a state from row to row, not the rows.  Spark
shuffles by the group's key and sorts (spilling, if need be); the task then sees the sorted rows as a stream of
Arrow batches, opens a state where a new key begins and closes it where the key ends.  No group is held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


class State(Protocol):
    """What a group keeps between batches."""

    def add(self, part: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of the group, in order, with what they yield."""

    def close(self) -> Iterator[pa.RecordBatch]:
        """What the group yields after its last row."""


def _differs(column: pa.Array) -> np.ndarray:
    """Where a value is not the one before it; nulls equal each other."""
    a, b = column[1:], column[:-1]
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def edges(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> list[int]:
    """Where runs of equal keys start, and the end."""
    changed = np.zeros(max(batch.num_rows - 1, 0), bool)
    for key in keys:
        held = batch.column(key) if isinstance(batch, pa.Table) else batch.column(batch.schema.get_field_index(key))
        changed |= _differs(held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held)
    return [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]


def by_group(
    batches: Iterator[pa.RecordBatch], keys: Sequence[str], make: Callable[[tuple[Any, ...]], State]
) -> Iterator[pa.RecordBatch]:
    """Feeds sorted batches to one state per key."""
    key, state = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = edges(batch, keys)
        for lo, hi in zip(cuts, cuts[1:]):
            part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
            found = tuple(part.column(k)[0].as_py() for k in keys)
            if state is None or found != key:
                if state is not None:
                    yield from state.close()
                key, state = found, make(found)
            yield from state.add(part)
    if state is not None:
        yield from state.close()


def stream_groups(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[tuple[Any, ...]], State], schema: Any
) -> DataFrame:
    """The groups of `rows` by `keys`, each in `order`, through states made by `make`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_group(batches, keys, make)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
