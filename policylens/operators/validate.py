"""Record checks as boolean columns; bad rows are quarantined with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.functions.pmf import total
from policylens.schema import (
    KEY, MAX_ACTION_ID_CHARS, MAX_ACTIONS, MAX_ID_CHARS, MAX_KEY_PART_CHARS, PMF_SUM_TOLERANCE,
    PROBABILITY_TOLERANCE, UNVERIFIED, UPLOAD_MAX_AGE_MS, UPLOAD_MAX_AHEAD_MS,
)


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def action_list_ok(actions: Column) -> Column:
    """At most 1024 actions with unique ids of 1 to 256 characters (V2)."""
    ids = F.transform(actions, lambda a: a["id"])
    return yes(
        (F.size(actions) <= MAX_ACTIONS)
        & F.forall(ids, lambda i: F.char_length(i).between(1, MAX_ACTION_ID_CHARS))
        & (F.size(F.array_distinct(ids)) == F.size(ids))
    )


def pmf_ok(pmf: Column, size: Column) -> Column:
    """One probability per entry, each in [0, 1], summing to 1."""
    return yes(
        (F.size(pmf) == size)
        & F.forall(pmf, lambda p: yes(p.between(0.0, 1.0)))
        & (F.abs(total(pmf) - 1.0) <= PMF_SUM_TOLERANCE)
    )


def first_problem(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that does not hold; NULL when all hold."""
    return F.coalesce(*[F.when(~yes(ok), F.lit(name)) for name, ok in rules])


def logged_rules(columns: list[str]) -> list[tuple[str, Column]]:
    """The rules of a logged row, in the order they are reported (V1)."""
    size = F.size("actions")
    position = F.array_position("eligible", F.col("chosen_index")).cast("int") - 1
    rules = [
        ("id_empty", F.char_length("id") > 0),
        ("actions_empty", size > 0),
        ("actions_invalid", action_list_ok(F.col("actions"))),
        ("eligible_empty", F.size("eligible") > 0),
        ("eligible_out_of_range", F.forall("eligible", lambda i: (i >= 0) & (i < size))),
        ("eligible_repeated", F.size(F.array_distinct("eligible")) == F.size("eligible")),
        ("pmf_invalid", pmf_ok(F.col("pmf"), F.size("eligible"))),
        ("chosen_out_of_range", (F.col("chosen_index") >= 0) & (F.col("chosen_index") < size)),
        ("chosen_not_eligible", position >= 0),
        ("probability_range", (F.col("probability") > 0) & (F.col("probability") <= 1)),
        (
            "probability_mismatch",
            F.abs(F.col("probability") - F.get("pmf", position)) <= PROBABILITY_TOLERANCE,
        ),
    ]
    if "reward" in columns:
        rules.append(("reward_not_finite", F.col("reward").isNull() | finite(F.col("reward"))))
    if "target_pmf" in columns:
        ok = pmf_ok(F.col("target_pmf"), F.size("eligible"))
        rules.append(("target_pmf_invalid", F.col("target_pmf").isNull() | ok))
    return rules


def validate_logged(df: DataFrame) -> DataFrame:
    """Adds `problem`: NULL, `legacy` for a row without a PMF, or the first broken rule (V1)."""
    broken = first_problem(logged_rules(df.columns))
    return df.withColumn("problem", F.when(F.col("pmf").isNull(), "legacy").otherwise(broken))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their problem)."""
    good = df.filter(F.col("problem").isNull()).drop("problem")
    return good, df.filter(F.col("problem").isNotNull() & (F.col("problem") != "legacy"))


def require_valid(df: DataFrame) -> DataFrame:
    """Strict mode: the job fails at the first quarantined row."""
    bad = F.col("problem").isNotNull() & (F.col("problem") != "legacy")
    message = F.concat(F.lit("decision "), F.col("id"), F.lit(": "), F.col("problem"))
    return df.withColumn("problem", F.when(bad, F.raise_error(message)).otherwise(F.col("problem")))


def event_id_ok(column: Column) -> Column:
    """1 to 128 characters from A-Z a-z 0-9 _ . : - (V3)."""
    return yes(column.rlike(r"\A[A-Za-z0-9_.:-]{1,128}\z"))


def key_part_ok(column: Column) -> Column:
    """A tenant, job or capsule name (V3)."""
    return yes(
        F.char_length(column).between(1, MAX_KEY_PART_CHARS)
        & ~column.rlike(r"[/\\\x00]")
        & ~column.isin(".", "..")
    )


def id_ok(column: Column) -> Column:
    """A decision id or idempotency key: 1 to 256 characters without NUL (V3)."""
    return yes(F.char_length(column).between(1, MAX_ID_CHARS) & ~column.rlike(r"\x00"))


def json_ok(column: Column) -> Column:
    return F.try_parse_json(column).isNotNull()


def validate_decisions(df: DataFrame) -> DataFrame:
    """Adds `problem` for decision records before they are stored (V3, V4)."""
    return df.withColumn(
        "problem",
        first_problem(
            [
                *[(f"{k}_invalid", key_part_ok(F.col(k))) for k in KEY],
                ("id_invalid", id_ok(F.col("id"))),
                ("mode_empty", F.char_length("mode") > 0),
                ("context_not_json", json_ok(F.col("context"))),
                ("derived_not_json", json_ok(F.col("derived"))),
                ("actions_missing", F.col("actions").isNotNull()),
                ("eligible_missing", F.col("eligible").isNotNull()),
                ("chosen_id_empty", F.char_length("chosen_id") > 0),
                (
                    "probability_range",
                    F.col("probability").isNull() | yes(F.col("probability").between(0.0, 1.0)),
                ),
            ]
        ),
    )


def validate_rewards(df: DataFrame) -> DataFrame:
    """Adds `problem` for reward records before they are stored (V3, V4)."""
    return df.withColumn(
        "problem",
        first_problem(
            [
                ("decision_id_invalid", id_ok(F.col("decision_id"))),
                ("idempotency_key_invalid", id_ok(F.col("idempotency_key"))),
                ("value_not_finite", finite(F.col("value"))),
                ("value_norm_not_finite", finite(F.col("value_norm"))),
                ("detail_not_json", F.col("detail").isNull() | json_ok(F.col("detail"))),
            ]
        ),
    )


def upload_window(df: DataFrame, now_ms: Column | int) -> DataFrame:
    """Adds `on_time`: at most 7 days old and at most 5 minutes ahead (V5)."""
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    return df.withColumn(
        "on_time", F.col("ts_ms").between(now - UPLOAD_MAX_AGE_MS, now + UPLOAD_MAX_AHEAD_MS)
    )


def data_summary(logged: DataFrame, given: tuple[float, float] | None = None) -> DataFrame:
    """What an evaluation read, skipped and scaled by, per capsule."""
    verified = F.col("mode") != UNVERIFIED
    weighted = verified & F.col("pmf").isNotNull() & F.col("probability").isNotNull()
    used = weighted & F.col("reward").isNotNull()
    value = F.when(used, F.col("reward"))
    agg = logged.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~verified).alias("rows_unverified"),
        F.count_if(verified & F.col("pmf").isNull()).alias("rows_without_pmf"),
        F.count_if(weighted & F.col("reward").isNull()).alias("rows_without_reward"),
        F.count_if(used & (F.col("reward_count") > 0)).alias("aggregated_rewards"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        (
            F.lit(0).cast("long")
            if given is None
            else F.count_if(used & ~F.col("reward").between(*given))
        ).alias("rewards_outside_range"),
    )
    half = F.greatest(F.abs("low") * 1e-6, F.lit(0.5))
    flat = F.col("low") == F.col("high")
    lo = F.when(flat, F.col("low") - half).otherwise(F.col("low"))
    hi = F.when(flat, F.col("high") + half).otherwise(F.col("high"))
    if given is not None:
        lo, hi = F.lit(float(given[0])), F.lit(float(given[1]))
    return agg.select(
        *KEY, "rows", "rows_unverified", "rows_without_pmf", "rows_without_reward",
        "aggregated_rewards", lo.alias("range_lo"), hi.alias("range_hi"),
        F.lit("observed" if given is None else "given").alias("range_source"),
        "rewards_outside_range",
    )


def health(
    decisions: DataFrame, rewards: DataFrame, low: float, high: float
) -> DataFrame:
    """Findings about a stored log: (severity, code, n, lowest and highest id) (V6)."""
    c = F.col

    def finding(rows: DataFrame, severity: str, code: str) -> DataFrame:
        return rows.agg(
            F.lit(severity).alias("severity"),
            F.lit(code).alias("code"),
            F.count(F.lit(1)).alias("n"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
        )

    repeated = decisions.groupBy(*KEY, "id").count().filter("count > 1")
    ids = decisions.select(*KEY, c("id").alias("decision_id")).distinct()
    orphan = rewards.join(ids, [*KEY, "decision_id"], "left_anti").select(
        c("decision_id").alias("id")
    )
    found = finding(repeated, "error", "duplicate_id").unionByName(
        finding(orphan, "error", "orphan_reward")
    )

    def by_row(rows: DataFrame, id_: str, rules: dict[tuple[str, str], Column]) -> DataFrame:
        """Findings of all rules about single rows in one pass."""
        told = [
            F.struct(
                F.lit(severity).alias("severity"), F.lit(code).alias("code"),
                F.count_if(broken).alias("n"),
                F.min(F.when(broken, c(id_))).alias("first_id"),
                F.max(F.when(broken, c(id_))).alias("last_id"),
            )
            for (severity, code), broken in rules.items()
        ]
        return rows.agg(F.array(*told).alias("told")).select(F.inline("told"))

    norm = F.least(F.greatest((c("value") - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    wrong_id = ~c("chosen_id").eqNullSafe(F.get("actions", c("chosen_index"))["id"])
    bad_pmf = F.coalesce(c("pmf").isNotNull() & ~pmf_ok(c("pmf"), F.size("eligible")), F.lit(False))
    return found.unionByName(
        by_row(decisions, "id", {("error", "bad_pmf"): bad_pmf, ("error", "chosen_id_mismatch"): wrong_id})
    ).unionByName(
        by_row(rewards, "decision_id", {("warn", "value_norm_mismatch"): F.abs(c("value_norm") - norm) > 1e-9})
    )

