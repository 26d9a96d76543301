"""Centroid clustering of vectors of 64 integers by bit planes and popcounts.

A vector is kept as its bit planes: plane j is one 64-bit word that holds bit j of all 64 components, in two's
complement, so it weighs 2**j, the last one -2**j.  The inner product of two vectors is the sum over pairs of their
planes of both weights times the number of bits that the AND of the planes has; squared distances follow
exactly.  A round reads the packed planes where they lie, sums them by cluster within a task, and
sends one row of sums per task and cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.llm.common import column, written

#: Components of a vector: the bits of a plane.
WIDTH = 64
#: Components lie within plus and minus this, so that squared distances fit into 64 bits.
LARGEST = 1 << 27
#: Vectors that are compared at a time inside a task.
SLICE = 4096


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null for a vector that is null, has not 64 components or has a null or non-finite one.

    A finite component that leaves the range fails the job.
    """
    wide = lambda x: x.cast("double") * scale
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    message = F.lit(f"a component is not within {LARGEST} in size")
    fits = lambda x: F.when(F.abs(F.floor(wide(x))) < LARGEST, F.floor(wide(x))).otherwise(F.raise_error(message).cast("long"))
    return F.when((F.size(vector) == WIDTH) & finite, F.transform(vector, fits))


def planes_of(rows: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes (rows x bits, unsigned 64-bit) of integers (rows x 64)."""
    out = np.empty((len(rows), bits), np.uint64)
    for j in range(bits):
        out[:, j] = np.packbits((rows >> j & 1).astype(np.uint8), axis=1).view(np.uint64)[:, 0]
    return out


def weights(bits: int) -> np.ndarray:
    """What a set bit of each plane is worth."""
    return np.array([1 << j for j in range(bits - 1)] + [-(1 << bits - 1)], np.int64)


def products(planes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products of all vectors with all others, both as planes."""
    w = weights(planes.shape[1])
    out = np.zeros((len(planes), len(others)), np.int64)
    for i in range(planes.shape[1]):
        part = np.zeros_like(out)
        for j in range(others.shape[1]):
            part += np.bitwise_count(planes[:, i, None] & others[None, :, j]).astype(np.int64) * w[j]
        out += part * w[i]
    return out


def plane_sums(planes: np.ndarray) -> np.ndarray:
    """The componentwise sum of vectors given as planes."""
    counts = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), -1, 8), axis=2).sum(axis=0, dtype=np.int64)
    return weights(planes.shape[1]) @ counts.reshape(planes.shape[1], WIDTH)


class Centroids:
    """Centroids with their planes."""

    def __init__(self, rows: list[list[int]], bits: int) -> None:
        self.rows = np.array(rows, np.int64).reshape(-1, WIDTH)
        self.planes = planes_of(self.rows, bits)
        self.norms = (self.rows * self.rows).sum(axis=1)

    def nearest(self, planes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid; ties to the smaller number."""
        d = norms[:, None] + self.norms[None, :] - 2 * products(planes, self.planes)
        at = d.argmin(axis=1)
        return at, np.take_along_axis(d, at[:, None], 1)[:, 0]


def _slices(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the packed table with their planes and norms."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            held = column(part, "planes").to_pylist()
            planes = np.frombuffer(b"".join(held), np.uint64).reshape(-1, bits)
            yield part, planes, column(part, "norm").to_numpy(zero_copy_only=False)


def _bits(kept: DataFrame) -> int:
    """Planes that all components need, sign included."""
    least, most = kept.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    return 1 if least is None else max(int(least).bit_length(), int(~least).bit_length(), int(most).bit_length()) + 1


def packed(kept: DataFrame, bits: int) -> DataFrame:
    """(id, planes, norm) of (id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = column(part, "x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
                planes = planes_of(rows, bits)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "id"), pa.array([p.tobytes() for p in planes], pa.binary()), pa.array((rows * rows).sum(axis=1))],
                    ["id", "planes", "norm"],
                )

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, planes binary, norm long")


def _sums(table: DataFrame, centroids: Centroids, bits: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum by cluster: a task sends one row per cluster, the driver gets 64 numbers for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids.rows), np.int64)
        sums = np.zeros((len(centroids.rows), WIDTH), np.int64)
        for _, planes, norms in _slices(batches, bits):
            at, _ = centroids.nearest(planes, norms)
            counts += np.bincount(at, minlength=len(counts))
            for c in np.unique(at):
                sums[c] += plane_sums(planes[at == c])
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full), pa.array(counts[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    parts = table.mapInArrow(run, "cluster long, n long, sums array<long>")
    total = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in total.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("sum")).collect():
        out.setdefault(r["cluster"], (r["n"], [0] * WIDTH))[1][r["at"]] = r["sum"]
    return out


def start(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The `k` vectors with the smallest sha256 of salt and id, in that order; ids that are null come last, ties by vector."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    return [list(r["x"]) for r in kept.select("x", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, vector: str = "embedding", vec_id: str = "vec_id", salt: str = "3:"
) -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid (64 integers).

    Components count as floor(1024 * x).  Vectors that are null, have not 64 components or hold a null or non-finite one take
    no part.  Centroids 0, 1, ... start as the vectors that `start` names (all, if there are fewer than `k`).  A round assigns
    every vector to the nearest centroid (ties: the smaller number) and replaces each centroid that has vectors by
    their componentwise floor(sum / count), exactly; one without stays.  After the last round vectors are assigned once more.

    Repeated rows count as often as they come, and can start several centroids; a null id is kept.  No rows, no
    result.  Other columns of `vectors` are not read.  Components that reach 2**27 after scaling fail the job: squared
    distances would leave 64 bits; so does an inertia that does.
    """
    x = quantised(F.col(f"`{vector}`"))
    kept = vectors.select(F.col(f"`{vec_id}`").alias("id"), x.alias("x")).where(F.col("x").isNotNull())
    bits = _bits(kept)
    first = start(kept, k, salt)
    table = written(packed(kept, bits), "cluster-planes")
    centroids = Centroids(first, bits)
    for _ in range(rounds if first else 0):
        rows = centroids.rows.tolist()
        for c, (n, sums) in _sums(table, centroids, bits).items():
            rows[c] = [s // n for s in sums]
        centroids = Centroids(rows, bits)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, planes, norms in _slices(batches, bits):
            at, distance = centroids.nearest(planes, norms)
            yield pa.RecordBatch.from_arrays([column(part, "id"), pa.array(at.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = table.schema["id"].dataType.simpleString()
    assigned = written(table.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "cluster-assigned")
    total = {r["cluster"]: int(r["sum"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()}
    per = [(c, total.get(c, 0), sum(total.values()), row) for c, row in enumerate(centroids.rows.tolist())]
    # one row per centroid: k of them, however many vectors there are
    table_of = vectors.sparkSession.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(table_of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
