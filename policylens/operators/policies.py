"""Target policies: a label, a PMF column and a fallback flag.

Any function that returns a `Target` extends the list; `check_targets` applies the PMF rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.functions.pmf import argmax, one_hot, serving_pmf, settings_pmf, total
from policylens.schema import PMF_SUM_TOLERANCE
from policylens.spec import PolicySpec


@dataclass(frozen=True)
class Target:
    """`pi` is aligned with `eligible`; `falls_back` marks rows that use the logged PMF."""

    label: str
    pi: Column
    falls_back: Column

    def struct(self) -> Column:
        return F.struct(
            F.lit(self.label).alias("policy"),
            self.pi.alias("pi"),
            self.falls_back.alias("falls_back"),
        )


def logged() -> Target:
    return Target("logged", F.col("pmf"), F.lit(False))


def constant(action: str) -> Target:
    """All mass on one action; the logged PMF where the action is not eligible (O3)."""
    index = F.array_position(F.transform("actions", lambda a: a["id"]), F.lit(action)) - 1
    position = F.coalesce(F.array_position(F.col("eligible"), index.cast("int")), F.lit(0)) - 1
    there = position >= 0
    pi = F.when(there, one_hot(F.size("eligible"), position)).otherwise(F.col("pmf"))
    return Target(f"constant:{action}", pi, ~there)


def target_column(column: str = "target_pmf") -> Target:
    return Target("target-column", F.col(column), F.lit(False))


def greedy(predictions: str = "rhat", label: str = "greedy") -> Target:
    """All mass on the best out-of-fold prediction."""
    pi = one_hot(F.size("eligible"), argmax(F.col(predictions)))
    return Target(label, pi, F.lit(False))


def served(
    spec: PolicySpec, predictions: str = "rhat_norm", n_updates: str = "n_updates",
    label: str = "candidate spec",
) -> Target:
    """What a spec would serve over out-of-fold normalized predictions."""
    if spec.get("mode") == "baselineExplore":
        raise ValueError("the log does not record each request's baseline action")
    return Target(label, serving_pmf(spec, F.col(predictions), F.col(n_updates)), F.lit(False))


def served_by_settings(
    settings: Column, predictions: str = "rhat_norm", n_updates: str = "n_updates", label: str = "own spec",
) -> Target:
    """What each row's capsule would serve by its own spec (O7); `settings` is the column of `specs.with_settings`.

    A capsule in baselineExplore mode fails the job: the log does not record each request's baseline action.
    """
    told = F.raise_error(F.lit("the log does not record each request's baseline action")).cast("array<double>")
    pi = settings_pmf(settings, F.col(predictions), F.col(n_updates))
    return Target(label, F.when(settings["mode"] == "baselineExplore", told).otherwise(pi), F.lit(False))


def sweep(df: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """One row per decision and policy; a plain projection when there is one policy."""
    if len(targets) == 1:
        one = targets[0]
        return df.select(
            "*", F.lit(one.label).alias("policy"), one.pi.alias("pi"),
            one.falls_back.alias("falls_back"),
        )
    return df.select("*", F.inline(F.array(*[t.struct() for t in targets])))


def action_constants(df: DataFrame) -> DataFrame:
    """The constant policy of every action a row lists, without naming the actions."""
    constants = F.transform(
        F.col("actions"),
        lambda a, i: F.struct(
            F.concat(F.lit("constant:"), a["id"]).alias("policy"),
            F.when(
                F.array_contains(F.col("eligible"), i),
                F.transform("eligible", lambda e: F.when(e == i, 1.0).otherwise(0.0)),
            )
            .otherwise(F.col("pmf"))
            .alias("pi"),
            (~F.array_contains(F.col("eligible"), i)).alias("falls_back"),
        ),
    )
    return df.select("*", F.inline(constants))


def target_ok() -> Column:
    """Whether `pi` is a PMF over the eligible actions."""
    ok = (
        (F.size("pi") == F.size("eligible"))
        & F.forall("pi", lambda p: F.coalesce((p >= 0) & (p <= 1), F.lit(False)))
        & (F.abs(total(F.col("pi")) - 1) <= PMF_SUM_TOLERANCE)
    )
    return F.coalesce(ok, F.lit(False))
