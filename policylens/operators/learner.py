"""The online linear learner and the jobs around it.

The learner is normalized adaptive gradient descent on squared loss over hashed slots (Ross,
Mineiro and Langford, "Normalized Online Learning", 2013).  Learning is sequential inside one
model: a capsule's rewards pass through one task in sequence order, a batch at a time, and
only the model stays (`streamed`).  Capsules are learned in parallel.  Whoever asks for blocks has blocks of
consecutive sequence numbers trained in parallel too, and their models averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylens.functions import kernels as K
from policylens.functions.features import uniform_of_seed
from policylens.functions.pmf import baseline_explore, draw, once, settings_pmf
from policylens.operators import specs as P
from policylens.operators.streamed import stream_groups
from policylens.schema import KEY
from policylens.session import attach, checkpointed, written
from policylens.spec import PolicySpec

#: Feature terms that a task holds at a time, and slots of a model in one output batch.
TERMS, OUT_SLOTS = 1 << 21, 1 << 16


class Nag:
    """State of `models` learners side by side over a compact list of slots.

    Rows are slots and columns are models; `slots` names the rows and grows as slots are met. `u` is weight times scale, `s` the scale and `a` the
    accumulated squared gradient over squared scale.  They are stored as float32, arithmetic is
    done in doubles.
    """

    def __init__(self, slots: int, models: int) -> None:
        self.u, self.s, self.a = (np.zeros((slots, models), dtype=np.float32) for _ in range(3))
        self.slots = np.arange(slots)
        self.t, self.norm = np.zeros(models), np.zeros(models)
        self.n = np.zeros(models, dtype=np.int64)

    def places(self, slots: np.ndarray) -> np.ndarray:
        """Rows of the given slots; new ones get a row of zeros, in order of slots."""
        new = np.setdiff1d(slots, self.slots)
        if len(new):
            at = np.searchsorted(self.slots, new)
            self.slots = np.insert(self.slots, at, new)
            self.u, self.s, self.a = (np.insert(v, at, np.float32(0), axis=0) for v in (self.u, self.s, self.a))
        return np.searchsorted(self.slots, slots)

    def learn(
        self, lengths: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, h: np.ndarray,
        on: np.ndarray, rate: float,
    ) -> None:
        """One pass over rows of `lengths` features (`at`, `x`), in order.

        `on` (rows, models) is 1.0 where a model learns from a row.  Scales and normalizers
        depend on the features only, so they are computed for the whole pass at once; the loop
        that remains is the one whose steps depend on each other.
        """
        if not len(lengths):
            return
        row = np.repeat(np.arange(len(lengths)), lengths)
        scaled, shrink, top = self._scales(row, at, x, on)
        weight = h[:, None] * on
        # every row has at least its bias, so no stretch is empty
        per_row = np.add.reduceat(scaled * scaled, np.cumsum(lengths) - lengths, axis=0)
        # summed on from the state, row by row: where a stream is cut into passes changes no bit
        t = np.cumsum(np.vstack((self.t, weight)), axis=0)[1:]
        norm = np.cumsum(np.vstack((self.norm, weight * per_row)), axis=0)[1:]
        speed = rate * np.sqrt(t / np.where(norm > 0, norm, np.inf))
        models = on.shape[1]
        both = np.concatenate((self.u, self.a), axis=1)
        ends = np.cumsum(lengths).tolist()
        lo = 0
        for i, hi in enumerate(ends):
            slots, xn = at[lo:hi], scaled[lo:hi]
            state = both[slots]
            u, a = state[:, :models], state[:, models:]
            if i in shrink:
                a = a * shrink[i]
            gap = np.add.reduce(u * xn, 0) - y[i]
            gradient = (weight[i] * gap) * xn
            total = gradient * gradient
            total += a
            # too small to be stored means no information, hence no step
            step = gradient / np.sqrt(total + 1e-40)
            step *= speed[i]
            state[:, models:] = total
            state[:, :models] = u - step
            both[slots] = state
            lo = hi
        self.u, self.a = both[:, :models].copy(), both[:, models:].copy()
        self.s = np.maximum(self.s, top)
        self.t, self.norm = t[-1], norm[-1]
        self.n = self.n + (on > 0).sum(axis=0)

    def _scales(
        self, row: np.ndarray, at: np.ndarray, x: np.ndarray, on: np.ndarray
    ) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """Features over the scale in force at their row, the shrink factors of the accumulated
        gradients where a scale grows, and the largest magnitude per slot and model."""
        size = np.abs(x).astype(np.float32)[:, None]
        order = np.argsort(at, kind="stable")
        seen, first = np.unique(at[order], return_index=True)
        masked = size[order] * on[row[order]].astype(np.float32)
        top = np.zeros_like(self.s)
        top[seen] = np.maximum.reduceat(masked, first, axis=0) if len(seen) else masked
        low = np.minimum.reduceat(size[order], first, axis=0)[:, 0] if len(seen) else size[:, 0]
        high = np.maximum.reduceat(size[order], first, axis=0)[:, 0] if len(seen) else low
        prior = self.s[seen]
        settled = (prior >= high[:, None]).all(axis=1)
        fresh = ((prior == 0) | (prior >= high[:, None])).all(axis=1) & (low == high)
        now = np.maximum(self.s[at], size).astype(np.float64)
        shrink: dict[int, np.ndarray] = {}
        edges = np.append(first, len(order))
        starts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(on)))))
        for j in np.flatnonzero(~(settled | fresh)):
            entries = order[edges[j]:edges[j + 1]]
            grown = np.maximum.accumulate(
                np.vstack((prior[j], size[entries] * on[row[entries]])), axis=0
            )
            before, after = grown[:-1], grown[1:]
            now[entries] = after
            for e in np.flatnonzero(((after > before) & (before > 0)).any(axis=1)):
                i = int(row[entries[e]])
                factor = shrink.setdefault(
                    i, np.ones((starts[i + 1] - starts[i], on.shape[1]))
                )
                ratio = before[e] / np.where(after[e] > 0, after[e], 1)
                factor[entries[e] - starts[i]] = np.where(before[e] > 0, ratio * ratio, 1.0)
        return x[:, None] / np.where(now > 0, now, np.inf), shrink, top

    def weights(self) -> np.ndarray:
        return np.where(self.s > 0, self.u.astype(np.float64) / np.where(self.s > 0, self.s, 1), 0)


def ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(lengths, flattened values) of a list column."""
    joined = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(joined, pa.ChunkedArray):
        joined = pa.concat_arrays(joined.chunks)
    lengths = joined.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lengths.astype(np.int64), joined.flatten()


def feature_arrays(values: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    hashes = values.field("hash").to_numpy(zero_copy_only=False).astype(np.int64)
    return hashes.view(np.uint64), values.field("value").to_numpy(zero_copy_only=False)


def phi_of(
    table: pa.Table, bits: int, with_context: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(actions per row, row of each action, pair, slot, value) of a featurized table."""
    x_len, x = ragged(table.column("x"))
    per_row, lists = ragged(table.column("a"))
    a_len, a = ragged(lists)
    a_row = np.repeat(np.arange(table.num_rows), per_row)
    x_hash, x_val = feature_arrays(x)
    a_hash, a_val = feature_arrays(a)
    pair, slot, value = K.phi(
        x_len, x_hash, x_val, a_len, a_hash, a_val, a_row, bits, with_context
    )
    return per_row, a_row, pair, slot, value


def chosen_features() -> list[Column]:
    """`x` and, as a one-entry list, the chosen action's features `a`."""
    position = F.array_position("eligible", F.col("chosen_index")).cast("int") - 1
    chosen = F.get(F.col("features.a"), position)
    return [F.col("features.x").alias("x"), F.array(chosen).alias("a")]


def learning_weight(spec: PolicySpec, probability: Column) -> Column:
    """Importance weight of an update: 1, or a capped inverse probability (L3)."""
    learner = spec.get("learner")
    if learner["importance"] == "none":
        return F.lit(1.0)
    cap = F.lit(float(learner["maxImportanceWeight"]))
    return F.least(1.0 / F.coalesce(probability, F.lit(1.0)), cap)


def was_learned(detail: Column) -> Column:
    """Rewards marked as not learned stay out of the model."""
    flag = F.try_variant_get(F.try_parse_json(detail), "$.learned", "boolean")
    return F.coalesce(flag, F.lit(True))


def normalized(value: Column, low: float, high: float) -> Column:
    """A reward on the unit scale, clamped."""
    return F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def pieces(part: pa.Table, most: int = TERMS) -> Iterator[pa.Table]:
    """Consecutive rows with about `most` feature terms at most, one row at least."""
    x_len, _ = ragged(part.column("x"))
    per_row, lists = ragged(part.column("a"))
    a_len, _ = ragged(lists)
    a_row = np.repeat(np.arange(part.num_rows), per_row)
    terms = np.cumsum(np.bincount(a_row, weights=(1 + a_len) * (1.0 + x_len[a_row]), minlength=part.num_rows))
    lo = 0
    while lo < part.num_rows:
        hi = max(int(np.searchsorted(terms, (terms[lo - 1] if lo else 0) + most, side="right")), lo + 1)
        yield part.slice(lo, hi - lo)
        lo = hi


def fold_models(
    featurized: DataFrame, spec: PolicySpec | DataFrame, snapshot: DataFrame | None = None,
    header: DataFrame | None = None, block: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Models after learning from later rewards, per capsule (L2).

    `featurized` holds one row per reward joined to its decision: KEY, seq, value, probability,
    detail, eligible, chosen_index and `features`.  `spec` is one spec or a spec table (see `specs`); capsules
    that are frozen by it learn nothing.  `snapshot` and `header` are the slot and header tables of the
    models to start from.  A capsule's rewards are learned one after the other in sequence order, however many
    they are, and only its model is held.  With `block`, those of each `block` consecutive sequence numbers are
    learned from the start model side by side, and the blocks' models averaged: other models, asked for.  Returns
    the new (header, slots), both read from one written table.
    """
    if header is not None:
        marks = header.select(*KEY, F.col("reward_seq").alias("mark"))
        featurized = featurized.join(marks, KEY, "left").filter(
            F.col("seq") > F.coalesce("mark", F.lit(0))
        )
    own = F.col("settings")
    shard = F.lit(0).cast("long") if block is None else F.floor(F.col("seq") / block)
    rows = P.with_settings(featurized.filter(was_learned(F.col("detail"))), spec).filter(own["mode"] != "frozen").select(
        *KEY,
        shard.alias("shard"),
        F.lit(1).alias("kind"),
        "seq",
        normalized(F.col("value"), own["low"], own["high"]).alias("y"),
        P.weight(own, F.col("probability")).alias("h"),
        own["bits"].alias("bits"),
        own["learning_rate"].alias("rate"),
        *chosen_features(),
    )
    if snapshot is not None and header is not None:
        start = _start_rows(snapshot, header)
        if block is None:
            start = start.withColumn("shard", F.lit(0).cast("long"))
        else:
            start = start.join(rows.select(*KEY, "shard").distinct(), KEY)
        rows = rows.unionByName(start.withColumn("kind", F.lit(0)).withColumn("seq", F.col("start.slot")), allowMissingColumns=True)
    else:
        rows = rows.withColumn("start", F.lit(None).cast("struct<slot:bigint>"))
    trained = stream_groups(rows, [*KEY, "shard"], ["kind", "seq"], _Fold, TRAINED)
    return _merged(written(trained, "trained"))


TRAINED = (
    "tenant string, job string, capsule string, shard bigint, slot bigint, "
    "u double, s double, a double, u0 double, s0 double, a0 double, "
    "n bigint, t double, norm double, t0 double, norm0 double, n0 bigint, last bigint, bits int, rate double"
)


def _start_rows(snapshot: DataFrame, header: DataFrame) -> DataFrame:
    """KEY and `start`: the slots of the models to start from; slot -1 carries the header."""
    zero = F.lit(0.0)
    head = F.struct(
        F.lit(-1).cast("long").alias("slot"), *[zero.alias(c) for c in ("u", "s", "a")],
        F.col("total_weight").alias("t"), F.col("norm_sum").alias("norm"), F.col("n_updates").alias("n"),
    )
    body = F.struct(
        "slot", *[F.col(c).cast("double").alias(c) for c in ("u", "s", "a")],
        zero.alias("t"), zero.alias("norm"), F.lit(0).cast("long").alias("n"),
    )
    return header.select(*KEY, head.alias("start")).unionByName(snapshot.select(*KEY, body.alias("start")))


class _Fold:
    """A capsule's (or block's) model while its start model and then its rewards pass by."""

    def __init__(self, key: tuple) -> None:
        self.key, self.model = key, Nag(0, 1)
        self.start: list[pa.Table] | None = []
        self.before = Nag(0, 1)
        self.last, self.bits, self.rate = None, 0, 0.0

    def add(self, part: pa.Table) -> Iterator[pa.RecordBatch]:
        starts = int(part.num_rows - np.count_nonzero(part.column("kind").to_numpy()))
        if starts:
            self.start.append(part.slice(0, starts).select(["start"]))
        if starts < part.num_rows:
            if self.start is not None:
                self._begin()
            for piece in pieces(part.slice(starts)):
                self._learn(piece)
        return iter(())

    def _begin(self) -> None:
        """The start model in force."""
        if self.start:
            held = pa.concat_tables(self.start).combine_chunks().flatten()
            of = {c: held.column(f"start.{c}").to_numpy() for c in ("slot", "u", "s", "a", "t", "norm", "n")}
            body = of["slot"] >= 0
            at = self.model.places(of["slot"][body])
            for name in ("u", "s", "a"):
                getattr(self.model, name)[at, 0] = of[name][body]
            self.model.t[0], self.model.norm[0], self.model.n[0] = (of[c][~body].sum() for c in ("t", "norm", "n"))
        self.start = None
        for name in ("slots", "u", "s", "a", "t", "norm", "n"):
            setattr(self.before, name, getattr(self.model, name).copy())

    def _learn(self, rows: pa.Table) -> None:
        self.bits, self.rate = rows.column("bits")[0].as_py(), rows.column("rate")[0].as_py()
        _, _, pair, slot, value = phi_of(rows, self.bits, False)
        self.model.learn(
            np.bincount(pair, minlength=rows.num_rows), self.model.places(slot), value.astype(np.float64),
            rows.column("y").to_numpy(), rows.column("h").to_numpy(), np.ones((rows.num_rows, 1)), self.rate,
        )
        self.last = rows.column("seq")[-1].as_py()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.last is None:
            return
        m, old = self.model, self.before
        at = old.places(m.slots)
        for lo in range(0, len(m.slots), OUT_SLOTS):
            part = slice(lo, lo + OUT_SLOTS)
            size = len(m.slots[part])
            same = [*self.key, int(m.n[0]), m.t[0], m.norm[0], old.t[0], old.norm[0], int(old.n[0]), self.last, self.bits, self.rate]
            own = [m.slots[part], *[getattr(v, c)[i, 0].astype(np.float64) for v, i in ((m, part), (old, at[part])) for c in ("u", "s", "a")]]
            columns = [*[[v] * size for v in same[:4]], *own, *[[v] * size for v in same[4:]]]
            schema = _trained_schema()
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


def _trained_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    fields = [part.split() for part in TRAINED.split(", ")]
    return pa.schema([(name, kinds[kind]) for name, kind in fields])


def _merged(trained: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One model per capsule: weights are averaged by the blocks' new weight (one block's are its
    own), scales take the maximum and squared gradients add."""
    c = F.col
    per_shard = trained.groupBy(*KEY, "shard").agg(
        *[F.first(x).alias(x) for x in ("n", "t", "norm", "t0", "norm0", "n0", "last", "bits", "rate")]
    )
    header = per_shard.groupBy(*KEY).agg(
        F.max("last").alias("reward_seq"), F.first("bits").alias("bits"), F.first("rate").alias("rate"),
        (F.sum(c("n") - c("n0")) + F.max("n0")).alias("n_updates"),
        (F.sum(c("t") - c("t0")) + F.max("t0")).alias("total_weight"),
        (F.sum(c("norm") - c("norm0")) + F.max("norm0")).alias("norm_sum"),
    ).select(
        *KEY, c("n_updates").alias("version"), "reward_seq",
        F.lit(None).cast("long").alias("ts_ms"), "bits", c("rate").alias("learning_rate"), "n_updates", "total_weight", "norm_sum",
    )
    new = c("t") - c("t0")
    slots = (
        trained.groupBy(*KEY, "slot")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.first("u").alias("u1"), F.first("s").alias("s1"), F.first("a").alias("a1"),
            F.max("s").alias("s"),
            F.try_divide(
                F.sum(new * F.coalesce(F.try_divide("u", "s"), F.lit(0.0))), F.sum(new)
            ).alias("w"),
            F.sum(c("a") * c("s") * c("s") - c("a0") * c("s0") * c("s0")).alias("g"),
            F.max(c("a0") * c("s0") * c("s0")).alias("g0"),
        )
        .select(
            *KEY, "slot",
            F.when(c("parts") == 1, c("u1")).otherwise(c("w") * c("s")).cast("float").alias("u"),
            F.when(c("parts") == 1, c("s1")).otherwise(c("s")).cast("float").alias("s"),
            F.when(c("parts") == 1, c("a1"))
            .otherwise(F.try_divide(c("g") + c("g0"), c("s") * c("s")))
            .cast("float").alias("a"),
        )
        .filter((c("u") != 0) | (c("s") != 0) | (c("a") != 0))
    )
    return header, slots


def phi_rows(featurized: DataFrame, keep: list[str], bits: int, with_context: bool = False):
    """Long form of the feature vectors: one row per (row, eligible action, slot)."""
    fields = ", ".join(f"{n} {featurized.schema[n].dataType.simpleString()}" for n in keep)
    source = featurized.select(*keep, F.col("features.x").alias("x"), F.col("features.a").alias("a"))
    out_schema = f"{fields}, position int, slot bigint, x_value float"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            per_row, a_row, pair, slot, value = phi_of(table, bits, with_context)
            position = K.ragged_positions(per_row)[1]
            taken = table.select(keep).take(pa.array(a_row[pair]))
            out = taken.append_column("position", pa.array(position[pair].astype(np.int32)))
            out = out.append_column("slot", pa.array(slot))
            out = out.append_column("x_value", pa.array(value, type=pa.float32()))
            yield from out.to_batches()

    return source.mapInArrow(explode, out_schema)


def score(
    featurized: DataFrame, slots: DataFrame, row_key: list[str], bits: int,
    with_context: bool = False,
) -> DataFrame:
    """Predicted normalized reward of every eligible action, clamped (L4).

    The feature vectors meet the slot table in a join on (model key, slot).  The products are
    summed before anything else is shuffled; AQE broadcasts the slot table once it has measured
    that it is small, and splits the partitions of slots that occur in every row.
    """
    model_key = [c for c in slots.columns if c not in ("slot", "u", "s", "a", "version")]
    long = phi_rows(featurized, row_key, bits, with_context)
    weight = F.when(F.col("s") > 0, F.col("u").cast("double") / F.col("s").cast("double"))
    weights = slots.select(*model_key, "slot", weight.alias("weight"))
    joined = long.join(weights, [*model_key, "slot"], "left")
    product = F.coalesce(F.col("weight"), F.lit(0.0)) * F.col("x_value").cast("double")
    return (
        joined.groupBy(*row_key, "position")
        .agg(F.sum(product).alias("raw"))
        .withColumn("prediction", F.least(F.greatest("raw", F.lit(0.0)), F.lit(1.0)))
        .drop("raw")
    )


#: Rows of one model that one task scores.
SCORE_ROWS = 50_000


def predict(
    featurized: DataFrame, slots: DataFrame, model_key: list[str], row_id: list[str], bits: int | Column,
    shard_rows: int = SCORE_ROWS,
) -> DataFrame:
    """Rows with `predictions`, one clamped prediction per eligible action (L4, batch form).

    `bits` is a number or a column with one value per model.
    Rows and slots of a model meet in one grouped task.  A model with many rows is served by
    several tasks, each with a bounded share of the rows and its own copy of the slots (at most
    2^bits of them), so one hot model neither fills a task nor needs a broadcast.
    """
    shards = featurized.groupBy(*model_key).agg(
        F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards")
    )
    shards = checkpointed(shards)
    rows = attach(featurized, shards, model_key).withColumn(
        "shard", F.pmod(F.xxhash64(*row_id), F.col("shards"))
    )
    kept = [c for c in featurized.columns if c != "features"]
    bits = (bits if isinstance(bits, Column) else F.lit(bits)).cast("int").alias("model_bits")
    rows = rows.select(
        "shard", *kept, bits, F.col("features.x").alias("x"), F.col("features.a").alias("a")
    )
    weight = F.when(F.col("s") > 0, F.col("u").cast("double") / F.col("s").cast("double"))
    weighted = slots.select(*model_key, "slot", weight.alias("weight"))
    copies = attach(weighted, shards, model_key).select(
        *[F.col(k).alias(k) for k in model_key],
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"),
        "slot", "weight",
    )
    fields = [featurized.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("predictions", T.ArrayType(T.DoubleType()))])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return pa.Table.from_batches([], schema=_empty(left, kept))
        per_row, a_row, pair, slot, value = phi_of(left, left.column("model_bits")[0].as_py(), False)
        known = right.column("slot").to_numpy()
        order = np.argsort(known)
        known = known[order]
        table = np.nan_to_num(
            right.column("weight").to_numpy(zero_copy_only=False).astype(np.float64)
        )[order]
        weights = np.zeros(len(slot))
        if len(known):
            at = np.minimum(np.searchsorted(known, slot), len(known) - 1)
            weights = np.where(known[at] == slot, table[at], 0.0)
        total = np.bincount(pair, weights=weights * value, minlength=len(a_row))
        return left.select(kept).append_column("predictions", lists(per_row, total))

    return (
        rows.groupBy(*model_key, "shard")
        .cogroup(copies.groupBy(*model_key, "shard"))
        .applyInArrow(apply, schema)
    )


def lists(per_row: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    """One list per row of values clamped to the unit interval."""
    offsets = np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.clip(flat, 0.0, 1.0)))


def _empty(table: pa.Table, kept: list[str]) -> pa.Schema:
    fields = [table.schema.field(c) for c in kept]
    return pa.schema([*fields, pa.field("predictions", pa.list_(pa.float64()))])


def decide(
    requests: DataFrame, slots: DataFrame, header: DataFrame, spec: PolicySpec | DataFrame,
    model_key: list[str] | None = None, row_id: list[str] | None = None,
) -> DataFrame:
    """Decisions for a table of requests.

    `requests` carries KEY, id, seed, actions, eligible (see `restrict`), features and, in
    baselineExplore mode, `baseline` (an action id).  Models are found by `model_key`; `spec` is one spec
    or a spec table, by which every capsule is served by its own.
    """
    model_key, row_id, spec = model_key or list(KEY), row_id or ["id"], P.once(spec)
    requests = P.with_settings(requests.drop("model_version"), spec).withColumn("model_bits_", F.col("settings.bits"))
    df = predict(requests.drop("settings"), slots, model_key, row_id, F.col("model_bits_")).drop("model_bits_")
    versions = header.select(*model_key, F.col("n_updates").alias("model_version"))
    df = attach(df, versions, model_key, how="left").withColumn(
        "model_version", F.coalesce("model_version", F.lit(0).cast("long"))
    )
    own = F.col("settings")
    df = P.with_settings(df, spec)
    pmf = settings_pmf(own, F.col("predictions"), F.col("model_version"))
    if "baseline" in df.columns:
        index = F.array_position(F.transform("actions", lambda a: a["id"]), F.col("baseline")) - 1
        position = F.array_position("eligible", index.cast("int")).cast("int") - 1
        explored = baseline_explore(F.size("eligible"), position, own["baseline_epsilon"])
    else:
        explored = F.raise_error(F.lit("baselineExplore needs a column baseline")).cast("array<double>")
    pmf = F.when(own["mode"] == "baselineExplore", explored).otherwise(pmf)
    df = once(df, *df.columns, pmf.alias("pmf"), uniform_of_seed(F.col("seed")).alias("uniform"))
    df = once(df, *df.columns, draw(F.col("pmf"), F.col("uniform")).alias("picked"))
    return df.select(
        "*",
        F.get("eligible", F.col("picked")).alias("chosen_index"),
        F.get(F.col("actions.id"), F.get("eligible", F.col("picked"))).alias("chosen_id"),
        F.get("pmf", F.col("picked")).alias("probability"),
        own["mode"].alias("mode"),
    ).drop("picked", "uniform", "settings")
