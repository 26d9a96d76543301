"""Idempotent ingest: first-wins deduplication, sequence numbers and default rewards
(E1-E6, W1, W5).

A batch row carries `arrival`, a unique long that grows in input order.  A copy that repeats a
million times must not fill one task, so the winner of a key is the minimum arrival (combined
before the shuffle), and the join that marks the winner includes the arrival: it is one-to-one
and copies spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylens.operators.joins import decision_key, known_rewards, unrewarded
from policylens.operators.specs import with_settings
from policylens.operators.validate import validate_decisions, validate_rewards
from policylens.schema import DEFERRED_TTL_MS, KEY

#: Arrivals per numbering block: a block holds at most this many rows of a capsule.
BLOCK = 1 << 20


def first_wins(df: DataFrame, by: list[str], order: str = "arrival") -> DataFrame:
    """Adds `first`: whether the row is the first of its key."""
    winners = df.groupBy(*by).agg(F.min(order).alias(order)).withColumn("first", F.lit(True))
    return df.join(winners, [*by, order], "left").withColumn(
        "first", F.coalesce("first", F.lit(False))
    )


def next_seq(df: DataFrame, last: DataFrame | None = None, order: str = "arrival") -> DataFrame:
    """Adds `seq`: 1, 2, 3... per capsule in arrival order, after the highest used.

    Numbering a whole capsule in one window would put it in one task.  Rows are numbered inside
    blocks of consecutive arrivals; block sizes, one row per block, give each block its offset.
    """
    block = F.floor(F.col(order) / BLOCK)
    df = df.withColumn("block", block)
    sizes = df.groupBy(*KEY, "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*KEY).orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(*KEY, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    if last is not None:
        offsets = offsets.join(last.select(*KEY, "last_seq"), KEY, "left").withColumn(
            "o", F.col("o") + F.coalesce("last_seq", F.lit(0))
        )
    inside = Window.partitionBy(*KEY, "block").orderBy(order)
    numbered = df.withColumn("rank", F.row_number().over(inside))
    return (
        numbered.join(offsets.select(*KEY, "block", "o"), [*KEY, "block"])
        .withColumn("seq", (F.col("o") + F.col("rank")).cast("long"))
        .drop("block", "rank", "o")
    )


def last_seq(rewards: DataFrame) -> DataFrame:
    return rewards.groupBy(*KEY).agg(F.max("seq").alias("last_seq"))


def ingest_decisions(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds `outcome` (inserted, duplicate or invalid) and `problem` to every row.

    Stored rows are never overwritten: append the rows whose outcome is `inserted`.
    """
    checked = validate_decisions(new)
    good = checked.filter(F.col("problem").isNull())
    winners = good.groupBy(*KEY, "id").agg(F.min("arrival").alias("arrival"))
    if existing is not None:
        winners = winners.join(existing.select(*KEY, "id"), [*KEY, "id"], "left_anti")
    winners = winners.withColumn("wins", F.lit(True))
    return (
        checked.join(winners, [*KEY, "id", "arrival"], "left")
        .withColumn(
            "outcome",
            F.when(F.col("problem").isNotNull(), "invalid")
            .when(F.col("wins"), "inserted")
            .otherwise("duplicate"),
        )
        .drop("wins")
    )


def ingest_rewards(
    new: DataFrame, decisions: DataFrame, existing: DataFrame | None = None, last: DataFrame | None = None
) -> DataFrame:
    """Adds `outcome` (applied, duplicate, unknown_decision or invalid) and `seq`.

    `last` holds the highest number given so far by KEY (`last_seq`); without it, it is taken from `existing`, which
    then has to be all earlier rewards and not only those that may share a key.

    `seq` is the number given to an applied reward; a duplicate's number is found with
    `duplicate_of`.
    """
    checked = validate_rewards(new).drop("seq")
    good = checked.filter(F.col("problem").isNull())
    known = known_rewards(good, decisions)
    winners = known.groupBy(*KEY, "idempotency_key").agg(F.min("arrival").alias("arrival"))
    if existing is not None:
        winners = winners.join(
            existing.select(*KEY, "idempotency_key"), [*KEY, "idempotency_key"], "left_anti"
        )
    if last is None and existing is not None:
        last = last_seq(existing)
    winners = next_seq(winners, last)
    flags = known.select(*KEY, "idempotency_key", "arrival").join(
        winners, [*KEY, "idempotency_key", "arrival"], "left"
    ).withColumn("known", F.lit(True))
    return (
        checked.join(flags, [*KEY, "idempotency_key", "arrival"], "left")
        .withColumn(
            "outcome",
            F.when(F.col("problem").isNotNull(), "invalid")
            .when(F.col("known").isNull(), "unknown_decision")
            .when(F.col("seq").isNotNull(), "applied")
            .otherwise("duplicate"),
        )
        .drop("known")
    )


def duplicate_of(outcomes: DataFrame, stored: DataFrame) -> DataFrame:
    """For duplicate rewards: `stored_seq`, the number their key is stored under."""
    keys = stored.select(*KEY, "idempotency_key", F.col("seq").alias("stored_seq"))
    return (
        outcomes.filter(F.col("outcome") == "duplicate")
        .drop("seq")
        .join(keys, [*KEY, "idempotency_key"], "left")
    )


def retry_or_conflict(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds `status` for ids that may be used again: new, retry or conflict.

    A retry repeats the stored request hash (and seed and choice, where the batch has them).
    """
    compare = [c for c in ("request_sha256", "seed", "chosen_index") if c in new.columns]
    old = stored.select(*KEY, "id", *[F.col(c).alias(f"stored_{c}") for c in compare])
    joined = new.join(old, [*KEY, "id"], "left")
    same = F.lit(True)
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.col(f"stored_{c}"))
    return joined.withColumn(
        "status",
        F.when(F.col("stored_request_sha256").isNull(), "new")
        .when(same, "retry")
        .otherwise("conflict"),
    ).drop(*[f"stored_{c}" for c in compare])


def idempotency_key(mode: str, decision_id: Column, given: Column, *fresh: Column) -> Column:
    """The key a reward counts under.

    `first`: the decision id.  `sum`: the caller's key, else one made from the reward itself,
    so that running the job again gives the same key.
    """
    if mode == "first":
        return decision_id
    made = F.concat_ws(":", decision_id, F.lpad(F.hex(F.xxhash64(decision_id, *fresh)), 16, "0"))
    return F.coalesce(given, made)


def mark_frozen(rewards: DataFrame, specs: DataFrame) -> DataFrame:
    """Rewards of capsules whose spec is frozen, marked in `detail` as not to be learned (L3).

    `specs` holds KEY and `spec` (JSON), one row per capsule, as `retention.spec_history` gives it.
    A detail that is no JSON object is kept under `detail` in the new one.
    """
    frozen = specs.filter(F.get_json_object("spec", "$.mode") == "frozen").select(
        *KEY, F.lit(True).alias("frozen")
    )
    told = F.regexp_replace("detail", '"learned"\\s*:\\s*(true|false|null)', '"learned":false')
    body = F.regexp_extract("detail", r"^\s*\{(.*)\}\s*$", 1)
    marked = (
        F.when(F.col("detail").isNull(), '{"learned":false}')
        .when(F.get_json_object("detail", "$.learned").isNotNull(), told)
        .when(F.trim(F.col("detail")).rlike(r"^\{\s*\}$"), '{"learned":false}')
        .when(F.length(body) > 0, F.concat(F.lit("{"), body, F.lit(',"learned":false}')))
        .otherwise(F.concat(F.lit('{"detail":'), F.to_json(F.array("detail")), F.lit(',"learned":false}')))
    )
    return rewards.join(frozen, KEY, "left").withColumn(
        "detail", F.when(F.col("frozen"), marked).otherwise(F.col("detail"))
    ).drop("frozen")


def default_rewards(
    decisions: DataFrame, rewards: DataFrame, now_ms: int, value: float, wait_seconds: int,
    mode: str = "first", low: float = 0.0, high: float = 1.0,
    arrived_ms: Column | None = None,
) -> DataFrame:
    """Reward rows for decisions still without one after their wait (E5).

    With `arrived_ms`, decisions that were logged only after their wait are left alone.
    """
    until = now_ms - wait_seconds * 1000
    due = unrewarded(decisions, rewards, until)
    if arrived_ms is not None:
        due = due.filter(arrived_ms <= F.col("ts_ms") + wait_seconds * 1000)
    key = F.col("id") if mode == "first" else F.concat(F.col("id"), F.lit(":default"))
    norm = min(max((value - low) / (high - low), 0.0), 1.0)
    return due.select(
        *KEY, F.col("id").alias("decision_id"), F.lit(now_ms).cast("long").alias("ts_ms"),
        F.lit(float(value)).alias("value"), F.lit(norm).alias("value_norm"),
        key.alias("idempotency_key"), F.lit('{"default":true}').alias("detail"),
        *[c for c in ("arrival",) if c in decisions.columns],
    )


def default_rewards_by_spec(
    decisions: DataFrame, rewards: DataFrame, now_ms: int, specs: DataFrame, arrived_ms: Column | None = None
) -> DataFrame:
    """`default_rewards` with each capsule's own default, wait, range and mode, from a spec table (E5).

    Capsules whose spec has no default get none.
    """
    own = F.col("settings")
    wait = own["wait_seconds"] * 1000
    rows = with_settings(decisions, specs).filter(own["reward_default"].isNotNull())
    due = unrewarded(rows.filter(F.col("ts_ms") <= now_ms - wait), rewards, now_ms)
    if arrived_ms is not None:
        due = due.filter(arrived_ms <= F.col("ts_ms") + wait)
    norm = (own["reward_default"] - own["low"]) / (own["high"] - own["low"])
    return due.select(
        *KEY, F.col("id").alias("decision_id"), F.lit(now_ms).cast("long").alias("ts_ms"),
        own["reward_default"].alias("value"), F.least(F.greatest(norm, F.lit(0.0)), F.lit(1.0)).alias("value_norm"),
        F.when(own["rewards"] == "first", F.col("id")).otherwise(F.concat(F.col("id"), F.lit(":default"))).alias("idempotency_key"),
        F.lit('{"default":true}').alias("detail"), *[c for c in ("arrival",) if c in decisions.columns],
    )


def activate(
    deferred: DataFrame, activations: DataFrame, held: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Decisions activated within 24 hours and the rewards that were waiting for them."""
    first = activations.groupBy(*KEY, "id").agg(F.min("ts_ms").alias("activated_ms"))
    live = deferred.join(first, [*KEY, "id"]).filter(
        F.col("activated_ms").between(F.col("ts_ms"), F.col("ts_ms") + DEFERRED_TTL_MS - 1)
    )
    released = held.join(
        decision_key(live.select(*KEY, F.col("id").alias("decision_id")), "decision_id"),
        [*KEY, "decision_id"], "left_semi",
    )
    return live, released
