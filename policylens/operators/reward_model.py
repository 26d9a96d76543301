"""Cross-fitted reward models (O8, O9a, O9b): a row is scored by a model that never saw it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylens.operators import specs as P
from policylens.operators.learner import OUT_SLOTS, Nag, chosen_features, phi_of, pieces
from policylens.operators.streamed import edges, stream_groups
from policylens.schema import KEY
from policylens.session import attach
from policylens.spec import PolicySpec

# Multiples of the learning rate, one pass over the rows each.
ENGINE_PASSES = [1.0]
ANNEALED_PASSES = [1.0, 0.25, 0.0625]

#: Parts of a capsule, by a hash of the id, that are cross-fitted on their own.
SHARDS = 8


def cell_means(df: DataFrame, segment: Column, fold: Column, folds: int) -> DataFrame:
    """Leave-fold-out mean reward per (segment, action) as `rhat`, plus `n_updates`.

    Sums are associative: one pass over (cell, fold), then total minus own fold.  A cell that
    is empty outside the fold uses the capsule's mean outside the fold.
    """
    rows = df.withColumn("segment", segment).withColumn("fold", fold)
    cells = rows.groupBy(*KEY, "segment", "chosen_index", "fold").agg(
        F.sum("reward").alias("s"), F.count(F.lit(1)).alias("n")
    )
    every_fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("out")
    own = F.col("fold") == F.col("out")

    def outside(grouped_by: list[str]) -> DataFrame:
        return (
            cells.select("*", every_fold)
            .groupBy(*grouped_by, "out")
            .agg(
                F.sum(F.when(own, 0.0).otherwise(F.col("s"))).alias("s"),
                F.sum(F.when(own, 0).otherwise(F.col("n"))).alias("n"),
            )
        )

    by_cell = (
        outside([*KEY, "segment", "chosen_index"])
        .groupBy(*KEY, "segment", F.col("out").alias("fold"))
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct("chosen_index", F.try_divide("s", "n").alias("mean"))
                )
            ).alias("means")
        )
    )
    by_capsule = outside(KEY).select(
        *KEY, F.col("out").alias("fold"),
        F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("overall"),
        F.col("n").alias("n_updates"),
    )
    lookup = by_cell.join(by_capsule, [*KEY, "fold"])
    joined = rows.join(lookup, [*KEY, "segment", "fold"])
    rhat = F.transform(
        "eligible", lambda e: F.coalesce(F.col("means")[e], F.col("overall"))
    )
    return joined.withColumn("rhat", rhat).drop("means", "overall", "segment")


def reward_scale(df: DataFrame, given: tuple[float, float] | None = None) -> DataFrame:
    """Adds `lo` and `hi`: the given range, or the capsule's observed one."""
    if given is not None:
        return df.select("*", *scale_columns(given))
    seen = df.groupBy(*KEY).agg(F.min("reward").alias("low"), F.max("reward").alias("high"))
    return attach(df, seen.select(*KEY, *scale_columns(None)), KEY)


def cross_fit(
    df: DataFrame, spec: PolicySpec | DataFrame, fold: Column, folds: int,
    with_context: bool = True, passes: list[float] | None = None,
    given: tuple[float, float] | None = None, shards: int = SHARDS,
    in_sample: bool = False, order: tuple[str, str] = ("ts_ms", "id"),
    keep: list[str] | None = None, shard: Column | None = None,
) -> DataFrame:
    """Out-of-fold predictions of the hashed linear learner.

    Needs `features` and the logged columns.  Adds `rhat_norm` (clamped, unit scale), `rhat` (raw
    units) and `n_updates` of the model used; `keep` names the columns that are carried along
    (by default all but the feature columns).  `spec` is one spec or a spec table.  A capsule is cut into
    `shards` parts by a hash of the id (or by the column `shard`), and each part is cross-fitted on its own: a setting, not
    a matter of the number of rows, so the same rows give the same models whatever else the log holds.

    A part's rows pass by in order, once for each pass, with the chosen action's features only; what stays is one model per
    fold.  The models then pass by ahead of the part's rows, which they score.  No part is held whole.
    """
    passes = passes or (ANNEALED_PASSES if with_context else ENGINE_PASSES)
    keep = keep or [c for c in df.columns if c not in ("features", "context", "derived")]
    unit = (F.col("reward") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    part = F.pmod(F.xxhash64("id"), F.lit(shards)) if shard is None else shard.cast("long")
    settings = F.col("settings")
    rows = P.with_settings(reward_scale(df, given), spec).select(
        part.alias("shard"),
        F.struct(*keep).alias("row"),
        *[F.col(k).alias(k) for k in KEY],
        *[F.col(c).alias(f"order_{i}") for i, c in enumerate(order)],
        "lo", "hi",
        fold.cast("int").alias("fold_"),
        F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)).alias("y_"),
        P.weight(settings, F.col("probability")).alias("h_"),
        settings["bits"].alias("bits"), settings["learning_rate"].alias("rate"),
        *chosen_features(),
        F.col("features.x").alias("all_x"), F.col("features.a").alias("all_a"),
    )
    group = [*KEY, "shard"]
    every_pass = F.explode(F.array(*[F.lit(i) for i in range(len(passes))])).alias("pass")
    train = rows.select(*group, "order_0", "order_1", "fold_", "y_", "h_", "bits", "rate", "x", "a", every_pass)
    models = stream_groups(
        train, group, ["pass", "order_0", "order_1"], lambda key: _Folds(key, folds, with_context, passes, in_sample), MODELS
    )
    scored = rows.select(
        *group, F.lit(1).alias("kind"), "row", "lo", "hi", "fold_", "bits", F.col("all_x").alias("x"), F.col("all_a").alias("a")
    )
    ahead = models.withColumn("kind", F.lit(0))
    out = T.StructType(
        [
            T.StructField("row", T.StructType([df.schema[c] for c in keep])),
            T.StructField("rhat_norm", T.ArrayType(T.DoubleType())),
            T.StructField("rhat", T.ArrayType(T.DoubleType())),
            T.StructField("n_updates", T.LongType()),
        ]
    )
    both = scored.unionByName(ahead, allowMissingColumns=True)
    return stream_groups(both, group, ["kind"], lambda key: _Scores(folds, with_context), out).select(
        *[F.col("row")[c].alias(c) for c in keep], "rhat_norm", "rhat", "n_updates"
    )


#: A part's models: weights and numbers of updates by fold, some slots to a row.
MODELS = (
    "tenant string, job string, capsule string, shard bigint, "
    "slots array<bigint>, weights array<double>, updates array<bigint>"
)


class _Folds:
    """The fold models of a part while its rows pass by."""

    def __init__(self, key: tuple, folds: int, with_context: bool, passes: list[float], in_sample: bool) -> None:
        self.key, self.folds, self.passes, self.in_sample = key, folds, passes, in_sample
        self.with_context = with_context
        self.model = Nag(0, folds)

    def add(self, part: pa.Table) -> Iterator[pa.RecordBatch]:
        for piece in pieces(part):
            cuts = edges(piece, ["pass"])
            for lo, hi in zip(cuts, cuts[1:]):
                self._learn(piece.slice(lo, hi - lo))
        return iter(())

    def _learn(self, rows: pa.Table) -> None:
        _, _, pair, slot, value = phi_of(rows, rows.column("bits")[0].as_py(), self.with_context)
        on = np.ones((rows.num_rows, self.folds))
        if not self.in_sample:
            on[np.arange(rows.num_rows), rows.column("fold_").to_numpy()] = 0.0
        rate = rows.column("rate")[0].as_py() * self.passes[rows.column("pass")[0].as_py()]
        self.model.learn(
            np.bincount(pair, minlength=rows.num_rows), self.model.places(slot), value.astype(np.float64),
            rows.column("y_").to_numpy(), rows.column("h_").to_numpy(), on, rate,
        )

    def close(self) -> Iterator[pa.RecordBatch]:
        weights = self.model.weights()
        for lo in range(0, len(weights), OUT_SLOTS):
            part = slice(lo, lo + OUT_SLOTS)
            columns = [*[pa.array([k]) for k in self.key], *[pa.array([v]) for v in (self.model.slots[part], weights[part].ravel(), self.model.n)]]
            yield pa.RecordBatch.from_arrays(columns, [*KEY, "shard", "slots", "weights", "updates"])


class _Scores:
    """A part's models, then its rows scored by the models that did not see them."""

    def __init__(self, folds: int, with_context: bool) -> None:
        self.folds, self.with_context = folds, with_context
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.slots: np.ndarray | None = None
        self.updates = np.zeros(folds, np.int64)

    def add(self, part: pa.Table) -> Iterator[pa.RecordBatch]:
        models = int(part.num_rows - np.count_nonzero(part.column("kind").to_numpy()))
        for i in range(models):
            slots, weights, updates = (part.column(c)[i].values.to_numpy() for c in ("slots", "weights", "updates"))
            self.held.append((slots, weights.reshape(-1, self.folds)))
            self.updates = updates
        if models < part.num_rows:
            if self.slots is None:
                slots = np.concatenate([s for s, _ in self.held])
                order = np.argsort(slots)
                self.slots, self.weights = slots[order], np.concatenate([w for _, w in self.held])[order]
                self.held = []
            for piece in pieces(part.slice(models)):
                yield self._score(piece)

    def _score(self, rows: pa.Table) -> pa.RecordBatch:
        per_row, a_row, pair, slot, value = phi_of(rows, rows.column("bits")[0].as_py(), self.with_context)
        fold = rows.column("fold_").to_numpy()
        at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        picked = np.where(self.slots[at] == slot, self.weights[at, fold[a_row[pair]]], 0.0) * value.astype(np.float64)
        unit = np.clip(np.bincount(pair, weights=picked, minlength=len(a_row)), 0.0, 1.0)
        lo, hi = (rows.column(c).to_numpy()[a_row] for c in ("lo", "hi"))
        offsets = pa.array(np.concatenate(([0], np.cumsum(per_row))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (unit, lo + unit * (hi - lo))]
        row = rows.column("row").combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        return pa.RecordBatch.from_arrays([row, *lists, pa.array(self.updates[fold])], ["row", "rhat_norm", "rhat", "n_updates"])

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def scale_columns(given: tuple[float, float] | None) -> list[Column]:
    """`lo` and `hi`: the given range, or the observed `low` and `high`; a constant reward is
    widened (P3)."""
    if given is not None:
        lo, hi = given
        if not (np.isfinite(hi - lo) and lo < hi):
            raise ValueError("a reward range is two finite numbers lo < hi")
        return [F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")]
    half = F.greatest(F.abs("low") * 1e-6, F.lit(0.5))
    flat = F.col("low") == F.col("high")
    return [
        F.when(flat, F.col("low") - half).otherwise(F.col("low")).alias("lo"),
        F.when(flat, F.col("high") + half).otherwise(F.col("high")).alias("hi"),
    ]
