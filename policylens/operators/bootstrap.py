"""Paired percentile bootstrap over rows at any size.

Drawing n row indices per resample needs all rows in one place.  Here every row gets, per
resample, an independent Poisson(1) count, which for many rows is the same resampling without
that need.  The counts come from a hash of (row, resample block, seed), so they do not depend
on how rows are partitioned.  A task multiplies its count matrix with its terms and emits only
sums; rows are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylens.functions import kernels as K
from policylens.operators.estimators import BY

TERMS = ["w", "wr", "dr", "r"]
#: Rows multiplied at once; bounds a task's memory at about 16 MB for 1000 resamples.
CHUNK = 2048
#: Resamples drawn at a time (a multiple of 4), capsules and policies summed at a time, and sums
#: that a task holds before it passes them on: about 10 MB, whatever the job asks for.
RESAMPLES, KEYS, HELD = 1000, 64, 256


def _poisson_table() -> np.ndarray:
    """Poisson(1) count for each 16-bit draw, by inverting its CDF."""
    cdf = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])
    return np.searchsorted(cdf, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(
        np.uint8
    )


def counts(row_hash: np.ndarray, resamples: int, seed: int, first: int = 0) -> np.ndarray:
    """(rows, resamples) Poisson counts from resample `first` (a multiple of 4) on; four 16-bit
    draws come from one 64-bit hash."""
    blocks = -(-resamples // 4)
    nth = np.arange(first // 4, first // 4 + blocks, dtype=np.uint64)
    base = K.splitmix(np.uint64(seed & (2**64 - 1)) + nth * K.GOLDEN)
    bits = K.splitmix(row_hash[:, None] ^ base[None, :])
    draws = bits.view(np.uint16).reshape(len(row_hash), blocks * 4)[:, :resamples]
    return _TABLE[draws]


_TABLE = _poisson_table()


def resample_sums(t: DataFrame, resamples: int, seed: int) -> DataFrame:
    """Per capsule, policy and resample: weighted sums of the terms."""
    source = t.select(
        *BY, F.xxhash64(*BY[:-1], "id").alias("row_hash"),
        *[F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in TERMS],
    )
    names = [*BY, "b", "rows", *[f"s_{c}" for c in TERMS]]
    kinds = ["string"] * 4 + ["int"] + ["double"] * 5
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for part in _by_keys(pa.Table.from_batches([batch])):
                for first in range(0, resamples, RESAMPLES):
                    _accumulate(held, part, first, min(RESAMPLES, resamples - first), seed)
                    if len(held) > HELD:
                        yield _emit(held, names)
                        held = {}
        if held:
            yield _emit(held, names)

    return source.mapInArrow(sums, schema).groupBy(*BY, "b").agg(
        *[F.sum(c).alias(c) for c in names[5:]]
    )


def _codes(table: pa.Table) -> tuple[list, np.ndarray]:
    """The key columns as dictionaries, and one number per row for all of them."""
    keys = [table.column(c).combine_chunks().dictionary_encode() for c in BY]
    code = np.zeros(table.num_rows, dtype=np.int64)
    for k in keys:
        code = code * len(k.dictionary) + k.indices.to_numpy()
    return keys, code


def _by_keys(table: pa.Table) -> Iterator[pa.Table]:
    """The rows in tables of at most `KEYS` capsules and policies."""
    code = _codes(table)[1]
    distinct = np.unique(code)
    if len(distinct) <= KEYS:
        yield table
        return
    part = np.searchsorted(distinct, code) // KEYS
    for i in range(part.max() + 1):
        yield table.filter(pa.array(part == i))


def _accumulate(held: dict, table: pa.Table, first: int, resamples: int, seed: int) -> None:
    keys, code = _codes(table)
    hashes = table.column("row_hash").to_numpy().view(np.uint64)
    values = np.column_stack(
        [np.ones(table.num_rows)] + [table.column(c).to_numpy() for c in TERMS]
    )
    # One weight row serves every policy of the same decision: multiply each distinct
    # decision once with all its policies' terms side by side.
    unique_rows, row_at = np.unique(hashes, return_inverse=True)
    codes, code_at = np.unique(code, return_inverse=True)
    width = values.shape[1]
    label = {}
    for j, c in enumerate(codes):
        i = int(np.flatnonzero(code_at == j)[0])
        label[j] = (*(k.dictionary[int(k.indices[i].as_py())].as_py() for k in keys), first)
    per_code = np.zeros((len(codes), resamples, width))
    for lo in range(0, len(unique_rows), CHUNK):
        hi = min(lo + CHUNK, len(unique_rows))
        inside = np.flatnonzero((row_at >= lo) & (row_at < hi))
        present = np.unique(code_at[inside])
        remap = np.full(len(codes), -1)
        remap[present] = np.arange(len(present))
        wide = np.zeros((hi - lo, len(present), width))
        np.add.at(wide, (row_at[inside] - lo, remap[code_at[inside]]), values[inside])
        weight = counts(unique_rows[lo:hi], resamples, seed, first).astype(np.float64)
        product = weight.T @ wide.reshape(hi - lo, -1)
        per_code[present] += product.reshape(resamples, len(present), width).transpose(1, 0, 2)
    for j, key in label.items():
        held[key] = held[key] + per_code[j] if key in held else per_code[j]


def _emit(held: dict, names: list[str]) -> pa.RecordBatch:
    keys = list(held)
    sizes = [len(held[k]) for k in keys]
    block = np.concatenate([held[k] for k in keys])
    columns = [
        pa.array(np.repeat(np.array([k[i] for k in keys], dtype=object), sizes)) for i in range(4)
    ]
    nth = [np.arange(k[4], k[4] + n, dtype=np.int32) for k, n in zip(keys, sizes, strict=True)]
    columns.append(pa.array(np.concatenate(nth)))
    columns += [pa.array(block[:, i]) for i in range(block.shape[1])]
    return pa.RecordBatch.from_arrays(columns, names=names)


def intervals(t: DataFrame, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """2.5% and 97.5% percentiles of every series, per capsule and policy.

    Resamples in which every weight is 0 are left out of the SNIPS series.
    """
    if not 100 <= resamples <= 100_000:
        raise ValueError("resamples must be in [100, 100000]")
    c = F.col
    n = c("rows")
    snips = F.when(c("s_w") > 0, F.try_divide("s_wr", "s_w"))

    def mean(total):
        value = F.try_divide(total, n)
        return F.when(~F.isnan(value), value)

    series = {
        "logged": mean(c("s_r")),
        "ips": mean(c("s_wr")),
        "snips": snips,
        "dr": mean(c("s_dr")),
        "lift_ips": mean(c("s_wr") - c("s_r")),
        "lift_snips": snips - mean(c("s_r")),
        "lift_dr": mean(c("s_dr") - c("s_r")),
    }
    draws = resample_sums(t, resamples, seed).select(
        *BY, *[value.alias(name) for name, value in series.items()]
    )
    quantiles = F.array(F.lit(0.025), F.lit(0.975))
    bounds = draws.groupBy(*BY).agg(
        *[F.percentile(name, quantiles).alias(name) for name in series]
    )
    return bounds.select(
        *BY,
        *[
            F.get(c(name), F.lit(i)).alias(f"{name}_{side}")
            for name in series
            for i, side in enumerate(("lower", "upper"))
        ],
    )


def with_bootstrap(metrics: DataFrame, t: DataFrame, resamples: int = 1000, seed: int = 7):
    """Metrics whose intervals are bootstrap percentiles; the normal ones are kept beside."""
    names = [f"{s}_{side}" for s in ("logged", "ips", "snips", "dr", "lift_ips", "lift_snips",
                                     "lift_dr") for side in ("lower", "upper")]
    normal = metrics.withColumnsRenamed({n: f"{n}_normal" for n in names})
    return normal.join(intervals(t, resamples, seed), BY)
