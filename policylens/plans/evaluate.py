"""The evaluation plan: logged rows to metrics for many capsules and policies in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.functions.features import featurize, fold_of
from policylens.operators.bootstrap import with_bootstrap
from policylens.operators.estimators import eval_rows, metrics, repeated_ids, row_ok, terms, warnings
from policylens.operators.gates import verdicts
from policylens.operators.policies import Target, action_constants, sweep, target_ok
from policylens.operators.reward_model import SHARDS, cell_means, cross_fit
from policylens.operators.validate import data_summary
from policylens.schema import KEY
from policylens.session import checkpointed, written
from policylens.spec import PolicySpec


@dataclass(frozen=True)
class EvalConfig:
    """Settings of an evaluation; out-of-range values are errors."""

    folds: int = 5
    bootstrap: int = 1000
    seed: int = 7
    w_max: float = 100.0
    reward_range: tuple[float, float] | None = None
    shards: int = SHARDS
    spec: PolicySpec = PolicySpec.of()
    #: A fault ends the job; otherwise bad rows, capsules and policies are left out (see `faults`).
    strict: bool = True

    def __post_init__(self) -> None:
        if not 2 <= self.folds <= 100:
            raise ValueError("folds must be in [2, 100]")
        if self.bootstrap and not 100 <= self.bootstrap <= 100_000:
            raise ValueError("bootstrap must be 0 or in [100, 100000]")
        if not self.shards >= 1:
            raise ValueError("shards must be at least 1")
        if not self.w_max >= 1:
            raise ValueError("w_max must be at least 1")


#: What policies and estimators read of a row.
CARRIED = [
    *KEY, "id", "actions", "eligible", "pmf", "chosen_index", "probability", "reward", "target_pmf",
]


def with_linear_model(rows: DataFrame, config: EvalConfig, fold: Column | None = None) -> DataFrame:
    """Rows with the cross-fitted hashed linear reward model as `rhat`."""
    fold = fold_of(F.col("id"), config.folds) if fold is None else fold
    # past this point only the ids of the actions matter, and few columns
    ids = F.transform("actions", lambda a: F.struct(a["id"].alias("id")))
    ready = featurize(rows).withColumn("actions", ids)
    keep = [c for c in CARRIED if c in ready.columns]
    return cross_fit(
        ready, config.spec, fold, config.folds, given=config.reward_range, shards=config.shards,
        keep=keep,
    )


def with_cell_model(
    rows: DataFrame, segment: Column, config: EvalConfig, fold: Column | None = None
) -> DataFrame:
    """Rows with leave-fold-out means per (segment, action) as `rhat`."""
    fold = fold_of(F.col("id"), config.folds) if fold is None else fold
    return cell_means(rows, segment, fold, config.folds)


def _holds(df: DataFrame, condition: Column, message: str, strict: bool) -> DataFrame:
    """Rows that meet a condition; with `strict` it is an error if one does not."""
    if not strict:
        return df.filter(condition)
    fails = F.raise_error(F.lit(message)).cast("boolean")
    return df.filter(F.when(condition, F.lit(True)).otherwise(fails))


def evaluate(
    logged: DataFrame,
    model: Callable[[DataFrame], DataFrame],
    targets: Sequence[Target] | None,
    config: EvalConfig,
    checks: Sequence[str] = (),
) -> DataFrame:
    """Metrics, warnings, gates and verdict per capsule and policy.

    `targets` None evaluates the constant policy of every action.  Only the metrics rows are
    small; everything before them stays distributed.
    """
    # the model, the preconditions and the summary all read it: joined once, read thrice
    logged = written(logged, "logged")
    used = eval_rows(logged)
    rows = model(_holds(used, row_ok(), "a logged row contradicts itself", config.strict))
    swept = action_constants(rows) if targets is None else sweep(rows, targets)
    t = terms(_holds(swept, target_ok(), "a target is no PMF", config.strict), config.w_max)
    if config.bootstrap:
        # narrow rows that two aggregations read: fit and weigh once, read twice
        t = checkpointed(t)
    m = metrics(t).join(repeated_ids(used), KEY, "left")
    m = _holds(m, F.col("repeated_ids").isNull(), "a decision id is repeated", config.strict)
    m = _holds(m.drop("repeated_ids"), F.col("n") >= 2, "fewer than two rows", config.strict)
    if targets is not None:
        somewhere = ~F.col("policy").startswith("constant:") | (F.col("fallback_rows") < F.col("n"))
        m = _holds(m, somewhere, "a policy's action is never eligible", config.strict)
    if config.bootstrap:
        m = with_bootstrap(m, t, config.bootstrap, config.seed)
    m = warnings(m, data_summary(logged, config.reward_range))
    return verdicts(m, list(checks))
