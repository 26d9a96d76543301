"""Joins between decisions, rewards and models.

All joins are equi-joins on the capsule key plus an id.  The reward side is aggregated to one
row per decision before it meets the decisions, so neither side repeats a key; where one side
can repeat (a hot decision id in a raw reward stream) AQE splits the skewed partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylens.schema import KEY
from policylens.session import attach

def decision_key(df: DataFrame, name: str) -> DataFrame:
    """Rename the reward side's `decision_id` so both sides join by the same names."""
    return df.withColumnRenamed("decision_id", name)


def fold_rewards(rewards: DataFrame, mode: str = "first") -> DataFrame:
    """One row per decision: reward, reward_norm and reward_count.

    `first` is the value with the lowest sequence number and combines before the shuffle.
    `sum` adds values one by one in sequence order, however many there are: a running sum that
    keeps no list, so a decision with very many rewards costs time but no memory.
    """
    by = [*KEY, "decision_id"]
    if mode == "first":
        return rewards.groupBy(*by).agg(
            F.min_by("value", "seq").alias("reward"),
            F.min_by("value_norm", "seq").alias("reward_norm"),
            F.count(F.lit(1)).alias("reward_count"),
        )
    if mode != "sum":
        raise ValueError("mode must be first or sum")
    so_far = Window.partitionBy(*by).orderBy("seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = rewards.select(
        *by, "seq",
        F.struct(
            F.sum("value").over(so_far).alias("reward"),
            F.sum("value_norm").over(so_far).alias("reward_norm"),
            F.count(F.lit(1)).over(so_far).alias("reward_count"),
        ).alias("total"),
    )
    return running.groupBy(*by).agg(F.max_by("total", "seq").alias("total")).select(*by, "total.*")


def logged_rows(decisions: DataFrame, rewards: DataFrame, mode: str = "first") -> DataFrame:
    """Every decision with its rewards folded into one value."""
    folded = decision_key(fold_rewards(rewards, mode), "id")
    return decisions.join(folded, [*KEY, "id"], "left").withColumn(
        "reward_count", F.coalesce("reward_count", F.lit(0).cast("long"))
    )


def rewards_since(
    rewards: DataFrame, decisions: DataFrame, after_seq: Column | int, limit: int | None = None
) -> DataFrame:
    """Rewards after a watermark, each with its decision, in each capsule's sequence order.

    `limit` is per capsule, as sequence numbers are.
    """
    late = rewards.filter(F.col("seq") > after_seq)
    if limit is not None:
        nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("seq"))
        late = late.withColumn("nth", nth).filter(F.col("nth") <= limit).drop("nth")
    right = decisions.withColumnRenamed("ts_ms", "decision_ts_ms")
    joined = decision_key(late, "id").join(right, [*KEY, "id"])
    return joined.orderBy(*KEY, "seq")


def unrewarded(
    decisions: DataFrame, rewards: DataFrame, until_ms: Column | int,
    after: tuple[int, str] | None = None,
) -> DataFrame:
    """Decisions without any reward, after a (ts, id) cursor and up to `until_ms`."""
    window = F.col("ts_ms") <= until_ms
    if after is not None:
        ts, last = after
        window = window & (
            (F.col("ts_ms") > ts) | ((F.col("ts_ms") == ts) & (F.col("id") > F.lit(last)))
        )
    paid = decision_key(rewards.select(*KEY, "decision_id"), "id")
    return decisions.filter(window).join(paid, [*KEY, "id"], "left_anti")


def known_rewards(rewards: DataFrame, decisions: DataFrame, known: bool = True) -> DataFrame:
    """Rewards whose decision exists, or those whose decision does not."""
    ids = decisions.select(*KEY, F.col("id").alias("decision_id"))
    return rewards.join(ids, [*KEY, "decision_id"], "left_semi" if known else "left_anti")


def rewards_of(rewards: DataFrame, key: tuple[str, str, str], decision_id: str) -> DataFrame:
    """The rewards of one decision in sequence order."""
    return rewards.filter(of_key(key) & (F.col("decision_id") == decision_id)).orderBy("seq")


def of_key(key: tuple[str, str, str]) -> Column:
    condition = F.lit(True)
    for name, value in zip(KEY, key, strict=True):
        condition = condition & (F.col(name) == value)
    return condition


def with_model(decisions: DataFrame, models: DataFrame) -> DataFrame:
    """Each decision with the published model its tag names; NULL version = retired.

    Many decisions name one model, so they stay where they are unless the models are many.
    """
    return attach(decisions, models, [*KEY, "model_tag"], how="left")
