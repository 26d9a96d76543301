"""Probability mass functions over the eligible actions, as Column expressions.

A prediction list and its PMF are arrays aligned with `eligible`.  `let` binds a value once, so
a lambda over K actions never re-evaluates an O(K) expression per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.spec import PolicySpec


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """`df.select(*columns)` with every column evaluated once per row.

    A filter on a computed column is normally pushed below the projection, which repeats the
    whole expression.  Columns made by a generator are not rewritten that way.
    """
    fields = [F.col(c) if isinstance(c, str) else c for c in columns]
    return df.select(F.inline(F.array(F.struct(*fields))))


def total(values: Column) -> Column:
    """Sum of an array, left to right."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def argmax(values: Column) -> Column:
    """0-based position of the largest entry; ties go to the lowest position (F8)."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(size: Column, position: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: F.when(i == position, 1.0).otherwise(0.0)
    )


def renormalize(pmf: Column, minimum: Column | float = 0.0) -> Column:
    """Scale to sum 1, then lift entries that rounding left below `minimum`."""
    low = minimum if isinstance(minimum, Column) else F.lit(float(minimum))

    def scaled(s: Column) -> Column:
        return F.transform(pmf, lambda p: F.greatest(F.when(s > 0, p / s).otherwise(p), low))

    return let(total(pmf), scaled)


def _rest_to_best(best: Column, others: Column) -> Column:
    """`others` with the mass that is missing from 1 put on position `best`."""
    filled = let(
        total(others),
        lambda used: F.transform(others, lambda p, i: F.when(i == best, 1.0 - used).otherwise(p)),
    )
    return let(filled, renormalize)


def gamma(scale: Column | float, exponent: Column | float, n_updates: Column) -> Column:
    """SquareCB's exploration strength after `n_updates` learner updates."""
    by, power = (v if isinstance(v, Column) else F.lit(float(v)) for v in (scale, exponent))
    return by * F.pow(n_updates.cast("double"), power)


def squarecb(predictions: Column, strength: Column) -> Column:
    """Inverse gap weighting."""

    def body(b: Column) -> Column:
        others = F.transform(
            predictions,
            lambda r, i: F.when(i == b["best"], 0.0).otherwise(
                1.0 / (b["k"] + b["g"] * (b["top"] - r))
            ),
        )
        return let(others, lambda o: _rest_to_best(b["best"], o))

    return let(
        F.struct(
            argmax(predictions).alias("best"),
            F.array_max(predictions).alias("top"),
            F.size(predictions).cast("double").alias("k"),
            strength.cast("double").alias("g"),
        ),
        body,
    )


def epsilon_greedy(predictions: Column, epsilon: Column | float) -> Column:
    """1 - epsilon on the best action plus epsilon / K on each."""
    eps = epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon))

    def body(b: Column) -> Column:
        others = F.transform(
            predictions, lambda r, i: F.when(i == b["best"], 0.0).otherwise(b["share"])
        )
        return let(others, lambda o: _rest_to_best(b["best"], o))

    return let(
        F.struct(argmax(predictions).alias("best"), (eps / F.size(predictions)).alias("share")),
        body,
    )


def floor_mix(pmf: Column, floor: Column | float) -> Column:
    """Mix in a uniform share, keeping every entry at least floor / K."""
    f = floor if isinstance(floor, Column) else F.lit(float(floor))
    return let(
        f / F.size(pmf),
        lambda low: let(
            F.transform(pmf, lambda p: (1.0 - f) * p + low), lambda mixed: renormalize(mixed, low)
        ),
    )


def baseline_explore(size: Column, baseline: Column, epsilon: Column | float) -> Column:
    """1 - epsilon on the baseline position plus epsilon / K on each."""
    eps = epsilon if isinstance(epsilon, Column) else F.lit(float(epsilon))
    return let(
        eps / size,
        lambda low: let(
            F.transform(
                F.sequence(F.lit(0), size - 1),
                lambda i: F.when(i == baseline, 1.0 - low * (size - 1)).otherwise(low),
            ),
            lambda p: renormalize(p, low),
        ),
    )


def serving_pmf(spec: PolicySpec, predictions: Column, n_updates: Column) -> Column:
    """The PMF a learner-mode spec serves: its exploration, then its floor."""
    e = spec.get("exploration")
    if e["kind"] == "squarecb":
        base = squarecb(predictions, gamma(e["gammaScale"], e["gammaExponent"], n_updates))
    else:
        base = epsilon_greedy(predictions, e["epsilon"])
    return let(base, lambda p: floor_mix(p, e["floor"]))


def settings_pmf(settings: Column, predictions: Column, n_updates: Column) -> Column:
    """`serving_pmf` by a settings column: exploration and floor of each row's own spec."""
    strength = gamma(settings["gamma_scale"], settings["gamma_exponent"], n_updates)
    square = settings["kind"] == "squarecb"
    base = F.when(square, squarecb(predictions, strength)).otherwise(epsilon_greedy(predictions, settings["epsilon"]))
    return let(base, lambda p: floor_mix(p, settings["floor"]))


def draw(pmf: Column, uniform: Column) -> Column:
    """Position drawn by inverting the CDF at `uniform`.

    Entries with probability 0 are never drawn; when rounding leaves the CDF below the draw,
    the last positive entry is taken.
    """
    walked = F.aggregate(
        pmf,
        F.struct(
            F.lit(0.0).alias("sum"), F.lit(-1).alias("hit"), F.lit(-1).alias("last"),
            F.lit(0).alias("i"),
        ),
        lambda s, p: F.struct(
            (s["sum"] + p).alias("sum"),
            F.when((s["hit"] < 0) & (uniform < s["sum"] + p) & (p > 0), s["i"])
            .otherwise(s["hit"])
            .alias("hit"),
            F.when(p > 0, s["i"]).otherwise(s["last"]).alias("last"),
            (s["i"] + 1).alias("i"),
        ),
        lambda s: F.when(s["hit"] >= 0, s["hit"])
        .when(s["last"] >= 0, s["last"])
        .otherwise(s["i"] - 1),
    )
    return walked.cast("int")


def eligible_positions(
    action_ids: Column, eligible_ids: Column | None, excluded_ids: Column | None
) -> Column:
    """Ascending indices of the actions that may be chosen."""

    def keep(action: Column) -> Column:
        ok = F.lit(True)
        if eligible_ids is not None:
            ok = F.coalesce(F.array_contains(eligible_ids, action), F.lit(True))
        if excluded_ids is not None:
            ok = ok & ~F.coalesce(F.array_contains(excluded_ids, action), F.lit(False))
        return ok

    flags = F.transform(action_ids, lambda a, i: F.when(keep(a), i))
    return F.array_compact(flags)


def unknown_ids(action_ids: Column, named: Column) -> Column:
    """Ids that are named by a filter or an exclusion but are no action; an error when any."""
    return F.array_except(F.coalesce(named, F.array().cast("array<string>")), action_ids)
