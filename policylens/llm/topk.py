"""Exact top-k search by block-at-a-time pruning.

Vectors of integers are put in order of their likeness to a few of them and cut into blocks; a block
keeps its rows (the forward index) and, per component, the largest and smallest value it holds.  For a
query the sum over components of its value times the extreme that is better for it bounds every score in
a block.  Blocks are scored from the largest bound down, until bounds fall below the k-th score.  Index
and queries meet in tasks of a fixed number of blocks and of queries, whose best rows are then ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylens.llm.common import arrow_map, column, written

#: Vectors of a block, blocks and queries that meet in a task.
BLOCK, TASK_BLOCKS, TASK_QUERIES = 256, 32, 4096
#: A bounded sample, chosen by a hash of the id: rows that order the index, rows that give each query
#: a k-th score to start from.
ANCHORS, SEEDS = 64, 2048

_LOWEST = np.iinfo(np.int64).min + 1


def quantised(vector: Column) -> Column:
    """floor(1024 x) of every component; null for a vector that is null or holds a null or non-finite one."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * 1024)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly; in doubles if these hold all sums."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores with their ids; ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Search:
    """The k best rows so far for each of some queries of one dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.rows, self.floor, self.k = ids, rows, floor, k
        self.scores = np.full((len(ids), k), _LOWEST)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def score(self, which: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        scores = product(self.rows[which], rows)
        named = np.broadcast_to(ids, scores.shape)
        scores = np.where(named == self.ids[which][:, None], _LOWEST, scores)
        self.scores[which], self.found[which] = best(
            np.hstack([self.scores[which], scores]), np.hstack([self.found[which], named]), self.k
        )

    def run(self, blocks: list[tuple[np.ndarray, np.ndarray]]) -> int:
        """Scores blocks (ids, rows) as long as a bound allows; how many (query, block) pairs that took."""
        high = np.stack([rows.max(0) for _, rows in blocks])
        low = np.stack([rows.min(0) for _, rows in blocks])
        bound = product(np.maximum(self.rows, 0), high) + product(np.minimum(self.rows, 0), low)
        order = np.argsort(-bound, axis=1, kind="stable")
        open_, pairs = np.arange(len(self.ids)), 0
        for turn in range(len(blocks)):
            block = order[open_, turn]
            least = np.maximum(self.floor[open_], self.scores[open_, -1])
            going = bound[open_, block] >= least
            open_, block = open_[going], block[going]
            pairs += len(open_)
            for b in np.unique(block):
                self.score(open_[block == b], *blocks[b])
        return pairs


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.int64) for v in values])


def _packed(rows: DataFrame) -> DataFrame:
    """(id, x): the components as eight-byte integers in a row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [np.array(v, np.int64).tobytes() for v in column(batch, "x").to_pylist()]
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(x, pa.binary())], ["id", "x"])

    return arrow_map(rows.where("id is not null and x is not null"), work, "id long, x binary")


def index(vectors: DataFrame) -> DataFrame:
    """Blocks (block, size, ids, rows) of vectors (id, x array<long>), written."""
    packed = _packed(vectors)
    anchors = [r["x"] for r in packed.orderBy(F.xxhash64("id"), "x").limit(ANCHORS).collect()]
    by_size = {n: _matrix([a for a in anchors if len(a) == n]) for n in {len(a) for a in anchors}}

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = []
        for x in column(batch, "x").to_pylist():
            some = by_size.get(len(x))
            at.append(-1 if some is None or not len(x) else int(product(np.frombuffer(x, np.int64)[None], some)[0].argmax()))
        return pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "x"), pa.array(at, pa.int32())], ["id", "x", "at"])

    placed = arrow_map(packed, near, "id long, x binary, at int").withColumn("size", F.octet_length("x"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, last = [], [], None

        def block() -> pa.RecordBatch:
            x = np.array(ids, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[0]], pa.int64()), pa.array([len(rows[0])], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([b"".join(rows)], pa.binary())],
                ["block", "size", "ids", "rows"],
            )

        for batch in batches:
            for key, x in zip(column(batch, "id").to_pylist(), column(batch, "x").to_pylist()):
                if (key, x) == last:
                    continue
                if rows and (len(rows) == BLOCK or len(rows[0]) != len(x)):
                    yield block()
                    ids, rows = [], []
                ids.append(key)
                rows.append(x)
                last = (key, x)
        if rows:
            yield block()

    order = ["size", "at", "id", "x"]
    return written(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        cut, "block long, size int, ids binary, rows binary"), "vector-blocks")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of `vectors` for each of `queries`, both (id, x).

    Scores are integer inner products; ties go to the smaller id.  A row of the query's own id is no
    candidate.  Rows without an id or without a vector take no part; vectors meet only those of their own
    dimension.  Repeated rows of one id and vector are one; an id with several vectors is several rows.
    Fewer candidates than k give fewer rows, none give none.
    """
    blocks = index(vectors)
    asked = _packed(queries).distinct()
    seeds = [(r["id"], r["x"]) for r in _packed(vectors).orderBy(F.xxhash64("id", F.lit(1)), "x").limit(SEEDS).collect()]
    seeds = list(dict.fromkeys(seeds))
    shards = max(1, -(-blocks.count() // TASK_BLOCKS))
    crowds = max(1, -(-asked.count() // TASK_QUERIES))

    def floors(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, x, out = column(batch, "id").to_pylist(), column(batch, "x").to_pylist(), []
        for one, row in zip(ids, x):
            some = [s for i, s in seeds if len(s) == len(row) and i != one] if row else []
            if len(some) < k:
                out.append(_LOWEST)
                continue
            out.append(int(np.sort(product(np.frombuffer(row, np.int64)[None], _matrix(some))[0])[-k]))
        return pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "x"), pa.array(out, pa.int64())], ["id", "x", "floor"])

    crowd = F.pmod(F.xxhash64("id", "x"), F.lit(crowds)).alias("crowd")
    ready = arrow_map(asked, floors, "id long, x binary, floor long").select("*", crowd)
    left = ready.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = blocks.select(
        "*",
        F.pmod(F.xxhash64("block", "size"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(crowds - 1)).cast("array<bigint>")).alias("crowd"),
    )

    def meet(queries_here: pa.Table, blocks_here: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        ids = np.array(queries_here["id"].to_pylist(), np.int64)
        floor = np.array(queries_here["floor"].to_pylist(), np.int64)
        x = queries_here["x"].to_pylist()
        size_of = np.array([len(v) for v in x])
        held = list(zip(blocks_here["size"].to_pylist(), blocks_here["ids"].to_pylist(), blocks_here["rows"].to_pylist()))
        for size in np.unique(size_of):
            mine = np.flatnonzero(size_of == size)
            cut = [(np.frombuffer(i, np.int64), np.frombuffer(r, np.int64).reshape(-1, size // 8)) for s, i, r in held if s == size and size]
            cut += [(np.frombuffer(i, np.int64), np.zeros((len(i) // 8, 0), np.int64)) for s, i, r in held if s == size == 0]
            if not cut:
                continue
            one = Search(ids[mine], _matrix([x[i] for i in mine]), floor[mine], k)
            one.run(cut)
            good = (one.scores > _LOWEST) & (one.scores >= one.floor[:, None])
            own = np.broadcast_to(one.ids[:, None], one.found.shape)
            out = [np.append(a, b) for a, b in zip(out, (own[good], one.found[good], one.scores[good]))]
        return pa.table({"query_id": out[0], "vec_id": out[1], "score": out[2]})

    keys = ["shard", "crowd"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
