"""Retention, erasure and history of the log."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policylens.operators.joins import known_rewards, of_key
from policylens.schema import KEY
from policylens.spec import PolicySpec


def prune(
    decisions: DataFrame, rewards: DataFrame, before_ms: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept decisions, kept rewards and per-capsule counts of what goes.

    A reward goes with its decision; a reward whose decision is kept stays however old it is.
    """
    old = F.col("ts_ms") < before_ms
    gone = decisions.filter(old)
    removed = known_rewards(rewards, gone)
    kept_rewards = known_rewards(rewards, gone, known=False)
    n_decisions = gone.groupBy(*KEY).agg(F.count(F.lit(1)).alias("decisions"))
    n_rewards = removed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rewards"))
    counts = n_decisions.join(n_rewards, KEY, "left").fillna(0, ["rewards"])
    return decisions.filter(~old), kept_rewards, counts


def unlearned_losses(
    decisions: DataFrame, rewards: DataFrame, headers: DataFrame, before_ms: int
) -> DataFrame:
    """Capsules whose pruning would lose rewards their latest model has not seen.

    Must be empty before `prune` is applied; otherwise fold a model first.
    """
    removed = known_rewards(rewards, decisions.filter(F.col("ts_ms") < before_ms))
    marks = headers.groupBy(*KEY).agg(F.max_by("reward_seq", "version").alias("mark"))
    return (
        removed.groupBy(*KEY)
        .agg(F.max("seq").alias("last_removed"))
        .join(marks, KEY, "left")
        .filter(F.col("last_removed") > F.coalesce("mark", F.lit(-1)))
    )


def erase(
    tables: dict[str, DataFrame], prefix: tuple[str, ...], now_ms: int
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Drop a tenant, job or capsule from every table; returns kept tables and audit rows.

    On a store partitioned by the key the filter is a partition drop.  Audit rows are kept.
    """
    hit = F.lit(True)
    for name, value in zip(KEY, prefix, strict=False):
        hit = hit & (F.col(name) == value)
    counted = None
    for name, df in tables.items():
        n = df.filter(hit).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        counted = n if counted is None else counted.unionByName(n)
    audit = counted.groupBy(*KEY).agg(F.sum("n").alias("n")).select(
        *KEY, F.lit(now_ms).cast("long").alias("ts_ms"), F.lit("capsule_deleted").alias("event"),
        F.to_json(F.struct(F.col("n").alias("removedRows"))).alias("detail"),
    )
    return {name: df.filter(~hit) for name, df in tables.items()}, audit


def purge_logs(
    decisions: DataFrame, rewards: DataFrame, key: tuple[str, str, str], now_ms: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop one capsule's decisions and rewards, keep its models; with the audit row."""
    hit = of_key(key)
    nd = decisions.filter(hit).agg(F.count(F.lit(1)).alias("removedDecisions"))
    nr = rewards.filter(hit).agg(F.count(F.lit(1)).alias("removedRewards"))
    # two one-row tables side by side
    both = nd.withColumn("one", F.lit(1)).join(nr.withColumn("one", F.lit(1)), "one")
    audit = both.select(
        *[F.lit(v).alias(n) for n, v in zip(KEY, key, strict=True)],
        F.lit(now_ms).cast("long").alias("ts_ms"), F.lit("logs_purged").alias("event"),
        F.to_json(F.struct("removedDecisions", "removedRewards")).alias("detail"),
    )
    return decisions.filter(~hit), rewards.filter(~hit), audit


def keep_newest_models(headers: DataFrame, keep: int) -> DataFrame:
    """The `keep` highest versions of every capsule."""
    newest = Window.partitionBy(*KEY).orderBy(F.col("version").desc())
    return headers.withColumn("rank", F.row_number().over(newest)).filter(
        F.col("rank") <= keep
    ).drop("rank")


def latest_models(headers: DataFrame) -> DataFrame:
    """The highest version of every capsule (A2)."""
    rest = [c for c in headers.columns if c not in KEY]
    return headers.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("m")).select(
        *KEY, "m.*"
    )


#: Audit events whose patch takes effect.
SPEC_EVENTS = ["capsule_created", "spec_changed", "spec_promoted"]


def spec_history(audit: DataFrame) -> DataFrame:
    """The spec in force per capsule: its patches merged in sequence order.

    Only patches of `SPEC_EVENTS` count; an audit table without `event` holds nothing else.  A patch
    that is no valid change is left out and counted in `refused`.  Patches are few per capsule, so
    a capsule's history is one small group.
    """
    if "event" in audit.columns:
        audit = audit.filter(F.col("event").isin(SPEC_EVENTS))
    patches = audit.filter(F.get_json_object("detail", "$.patch").isNotNull()).select(
        *KEY, "seq", "detail"
    )

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        spec, refused = PolicySpec.of(), 0
        for detail in rows.sort_values("seq")["detail"]:
            patch = json.loads(detail)["patch"]
            try:
                spec = spec.patched(json.loads(patch) if isinstance(patch, str) else patch)
            except ValueError:
                refused += 1
        first = rows.iloc[0]
        return pd.DataFrame(
            [[*(first[k] for k in KEY), int(rows["seq"].max()), spec.json(), refused]],
            columns=[*KEY, "seq", "spec", "refused"],
        )

    return patches.groupBy(*KEY).applyInPandas(
        fold, "tenant string, job string, capsule string, seq bigint, spec string, refused bigint"
    )
