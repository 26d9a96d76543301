"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.session import shared_folder

#: Rows of a batch that are worked on at a time inside a task.
SLICE_ROWS = 512
#: Rows that a group of a sample has at least, if it holds as many.
LEAST_ROWS = 20
#: Groups of a sample that have a room of their own.
MOST_GROUPS = 100


def arrow_map(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = SLICE_ROWS
) -> DataFrame:
    """`work` on slices of at most `rows` rows, so that a task's memory does not follow its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield work(batch.slice(start, rows))
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """What a task has freed goes back to the system: workers live on and serve later stages beside the executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def with_columns(docs: DataFrame, **new: Column) -> DataFrame:
    """`docs` with the named columns last; columns of the same names are replaced."""
    taken = {k.lower() for k in new}
    kept = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken]
    return docs.select(*kept, *[v.alias(k) for k, v in new.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`: how the contracts split rows for learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def sample_hash(*of: str) -> Column:
    """What `bounded_sample` chooses by: a fixed number per content of the named columns."""
    return F.xxhash64(F.lit("sample"), *[F.col(f"`{c}`") for c in of])


def room(sizes: list[int], most: int) -> int:
    """The largest number of rows per group with which all groups together have about `most`."""
    left, rest = most, sorted(sizes)
    for i, n in enumerate(rest):
        if n > (each := left // (len(rest) - i)):
            return max(each, LEAST_ROWS)
        left -= n
    return rest[-1] if rest else 0


def bounded_sample(rows: DataFrame, groups: list[str], most: int, most_bytes: int | None = None) -> DataFrame:
    """About `most` rows (all, if there are fewer), chosen in each group by the column `hash`.

    Small groups come whole and leave their room to the others; a group has `LEAST_ROWS` at least, if it
    holds as many.  Beyond the `MOST_GROUPS` largest, groups share a quarter of the room as one, so that many groups do not
    lift the bound.  With `most_bytes` there are so few rows that the column `bytes` sums to about that at most;
    which rows are taken does not depend on it.  Of the rows of a group that are equal in `hash` one is taken.
    """
    size = F.lit(0.0) if most_bytes is None else F.avg("bytes")
    counts = rows.groupBy(*groups).agg(F.approx_count_distinct("hash", 0.01).alias("n"), size.alias("size"))
    counts = counts.orderBy(F.desc("n"), *groups).limit(MOST_GROUPS + 1).collect()
    types = [f"`__{g}` {rows.schema[g].dataType.simpleString()}" for g in groups]

    def table_of(held: list[tuple], *more: str) -> tuple[DataFrame, list[Column]]:
        """A small table by group, to broadcast, and how rows meet it."""
        table = F.broadcast(rows.sparkSession.createDataFrame(held, ", ".join([*types, *more])))
        return table, [rows[f"`{g}`"].eqNullSafe(table[f"`__{g}`"]) for g in groups]

    if len(counts) > MOST_GROUPS:
        large, same = table_of([tuple(r[g] for g in groups) for r in counts[:MOST_GROUPS]])
        part = None if most_bytes is None else most_bytes // 4
        named = bounded_sample(rows.join(large, same, "left_semi"), groups, most - most // 4, None if part is None else most_bytes - part)
        pool = rows.join(large, same, "left_anti").withColumn("__pool", F.lit(0))
        return named.unionByName(bounded_sample(pool, ["__pool"], most // 4, part).drop("__pool"))
    each = room([r["n"] for r in counts], most)
    while most_bytes is not None and each > LEAST_ROWS and sum(min(r["n"], each) * r["size"] for r in counts) > most_bytes:
        each = max(LEAST_ROWS, each * 9 // 10)
    cut = [(*[r[g] for g in groups], each / r["n"]) for r in counts if r["n"] > each]
    if cut:
        shares, same = table_of(cut, "__share double")
        at = F.pmod("hash", F.lit(1 << 52)) / (1 << 52)
        rows = rows.join(shares, same, "left").where(F.col("__share").isNull() | (at < F.col("__share"))).select(*[f"`{c}`" for c in rows.columns])
    return rows.dropDuplicates([*groups, "hash"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def flat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text starts (with the end as last entry)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends
