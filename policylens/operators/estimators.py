"""Off-policy estimators, intervals and diagnostics.

Per-row terms are arithmetic on the logged arrays.  One grouped aggregation with partial
(map-side) combination then yields every estimate, standard error and diagnostic, so the only
data that is shuffled is one row of moments per task, capsule and policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.functions.pmf import total
from policylens.operators.policies import target_ok
from policylens.operators.validate import pmf_ok
from policylens.schema import KEY, PROBABILITY_TOLERANCE, UNVERIFIED, Z_95

BY = [*KEY, "policy"]
ESTIMATORS = ["dm", "ips", "snips", "dr"]


def has_propensity() -> Column:
    """A row that can be weighted: it has a logged PMF and probability."""
    return F.col("pmf").isNotNull() & F.col("probability").isNotNull()


def verified() -> Column:
    """Uploads whose propensities could not be checked stay out of estimates."""
    return F.col("mode") != UNVERIFIED


def eval_rows(logged: DataFrame) -> DataFrame:
    """The rows an evaluation uses: verified, with a PMF and with a reward (O1)."""
    return logged.filter(has_propensity() & verified() & F.col("reward").isNotNull())


def repeated_ids(rows: DataFrame) -> DataFrame:
    """Per capsule, how many decision ids occur more than once; no row where none does (O1)."""
    again = rows.groupBy(*KEY, "id").count().filter("count > 1")
    return again.groupBy(*KEY).agg(F.count(F.lit(1)).alias("repeated_ids"))


def row_ok() -> Column:
    """Whether the logged PMF, choice and probability of a row fit together (O1, V1)."""
    position = F.array_position("eligible", F.col("chosen_index")).cast("int") - 1
    return F.coalesce(
        pmf_ok(F.col("pmf"), F.size("eligible"))
        & (F.col("probability") > 0)
        & (F.abs(F.get("pmf", position) - F.col("probability")) <= PROBABILITY_TOLERANCE),
        F.lit(False),
    )


def faults(rows: DataFrame, swept: DataFrame) -> DataFrame:
    """What stands against an evaluation, per capsule and policy.

    Counts of rows, of rows that contradict themselves, of targets that are no PMF and of repeated
    ids; and whether a policy followed the log in every row because its action is never eligible.
    """
    counted = swept.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~row_ok()).alias("invalid_rows"),
        F.count_if(~target_ok()).alias("bad_targets"),
        F.bool_and("falls_back").alias("never_eligible"),
    )
    return counted.join(repeated_ids(rows), KEY, "left").fillna(0, ["repeated_ids"])


def terms(df: DataFrame, w_max: float = 100.0) -> DataFrame:
    """Narrow per-row terms of each policy (O10); needs `pi` and, for DM and DR, `rhat`."""
    if not w_max >= 1:
        raise ValueError("w_max must be at least 1, or inf for no clipping")
    has_model = "rhat" in df.columns
    position = (F.array_position("eligible", F.col("chosen_index"))).cast("int") - 1
    at = F.get(F.col("pi"), F.col("position"))
    off = F.aggregate(
        F.zip_with("pi", "pmf", lambda p, m: F.when(m == 0, p).otherwise(0.0)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    dm = (
        F.aggregate(
            F.zip_with("pi", "rhat", lambda p, q: p * q), F.lit(0.0), lambda acc, x: acc + x
        )
        if has_model
        else F.lit(None).cast("double")
    )
    hat = F.get(F.col("rhat"), F.col("position")) if has_model else F.lit(None).cast("double")
    first = df.select(
        *[c for c in df.columns if c in {*BY, "id", "eligible", "pi", "pmf", "rhat"}],
        position.alias("position"),
        "probability",
        "falls_back",
        F.col("reward").alias("r"),
    )
    second = first.select(
        *BY, "id", "r", "falls_back", "probability",
        at.alias("at"), off.alias("off_support"), total(F.col("pi")).alias("mass"),
        dm.alias("dm"), hat.alias("hat"),
    )
    raw = F.col("at") / F.col("probability")
    third = second.withColumn("raw_w", raw).withColumn(
        "w", F.least(F.col("raw_w"), F.lit(float(w_max)))
    )
    return third.select(
        *BY, "id", "w", (F.col("w") * F.col("r")).alias("wr"), "dm",
        (F.col("dm") + F.col("w") * (F.col("r") - F.col("hat"))).alias("dr"),
        "r", "raw_w",
        (F.col("raw_w") - (F.col("mass") - F.col("off_support"))).alias("gap"),
        "off_support",
        (F.col("at") > 0).alias("covered"),
        (F.col("raw_w") > F.lit(float(w_max))).alias("clipped"),
        "falls_back",
    )


def moments(t: DataFrame) -> DataFrame:
    """One row of moments per capsule and policy."""
    c = F.col
    return t.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("r").alias("logged_mean"),
        F.var_samp("r").alias("v_r"),
        F.avg("dm").alias("dm"),
        F.avg("wr").alias("ips"),
        F.var_samp("wr").alias("v_wr"),
        F.avg("dr").alias("dr"),
        F.var_samp("dr").alias("v_dr"),
        F.sum("w").alias("s_w"),
        F.sum("wr").alias("s_wr"),
        F.sum(c("w") * c("w")).alias("s_w2"),
        F.var_samp("w").alias("v_w"),
        F.covar_samp("wr", "w").alias("c_wr_w"),
        F.covar_samp("wr", "r").alias("c_wr_r"),
        F.covar_samp("w", "r").alias("c_w_r"),
        F.avg(c("dm") - c("r")).alias("lift_dm"),
        F.avg(c("wr") - c("r")).alias("lift_ips"),
        F.var_samp(c("wr") - c("r")).alias("v_lift_ips"),
        F.avg(c("dr") - c("r")).alias("lift_dr"),
        F.var_samp(c("dr") - c("r")).alias("v_lift_dr"),
        F.count_if("covered").alias("covered_rows"),
        F.count_if("clipped").alias("clipped_rows"),
        F.max("raw_w").alias("max_weight"),
        F.avg("raw_w").alias("mean_weight"),
        F.count_if("falls_back").alias("fallback_rows"),
        F.avg("off_support").alias("unsupported_mass"),
        F.avg("gap").alias("gap_mean"),
        F.var_samp("gap").alias("gap_var"),
    )


def metrics(t: DataFrame) -> DataFrame:
    """Estimates, standard errors, normal intervals, lifts and diagnostics.

    Undefined numbers are NULL.  DM has a point estimate only: resampling rows does not see
    the reward model's error.
    """
    c = F.col
    m = moments(t)
    snips = F.try_divide(c("s_wr"), c("s_w"))
    wbar = c("s_w") / c("n")
    m = m.withColumn("snips", F.when(c("s_w") > 0, snips)).withColumn("wbar", wbar)
    ratio_var = c("v_wr") - 2 * c("snips") * c("c_wr_w") + c("snips") * c("snips") * c("v_w")
    positive = c("s_w") > 0
    lift_var = (
        F.try_divide(ratio_var, c("wbar") * c("wbar"))
        + c("v_r")
        - 2 * F.try_divide(c("c_wr_r") - c("snips") * c("c_w_r"), c("wbar"))
    )

    def se(variance: Column) -> Column:
        # rounding can leave a tiny negative; NULL must stay NULL
        return F.sqrt(F.when(variance < 0, 0.0).otherwise(variance) / c("n"))

    m = m.select(
        "*",
        se(c("v_r")).alias("logged_se"),
        se(c("v_wr")).alias("ips_se"),
        se(c("v_dr")).alias("dr_se"),
        F.when(positive, F.try_divide(se(ratio_var), c("wbar"))).alias("snips_se"),
        (c("snips") - c("logged_mean")).alias("lift_snips"),
        se(c("v_lift_ips")).alias("lift_ips_se"),
        se(c("v_lift_dr")).alias("lift_dr_se"),
        F.when(positive, se(lift_var)).alias("lift_snips_se"),
    )
    bounds = []
    for name, value in interval_series():
        half = F.lit(Z_95) * c(f"{name}_se")
        bounds += [
            (c(value) - half).alias(f"{name}_lower"), (c(value) + half).alias(f"{name}_upper"),
        ]
    m = m.select("*", *bounds)
    gap_se = se(c("gap_var"))
    return m.select(
        *BY, "n",
        "logged_mean", "logged_se", "logged_lower", "logged_upper",
        "dm",
        *[x for e in ("ips", "snips", "dr") for x in (e, f"{e}_se", f"{e}_lower", f"{e}_upper")],
        "lift_dm",
        *[
            x
            for e in ("lift_ips", "lift_snips", "lift_dr")
            for x in (e, f"{e}_se", f"{e}_lower", f"{e}_upper")
        ],
        F.when(c("s_w2") > 0, c("s_w") * c("s_w") / c("s_w2")).otherwise(0.0).alias("ess"),
        (c("covered_rows") / c("n")).alias("coverage"),
        (c("clipped_rows") / c("n")).alias("clip_rate"),
        "clipped_rows", "max_weight", "mean_weight", "fallback_rows",
        (c("fallback_rows") / c("n")).alias("fallback_rate"),
        "unsupported_mass",
        F.try_divide(c("gap_mean"), gap_se).alias("weight_z"),
    )


def interval_series() -> list[tuple[str, str]]:
    """(prefix of the interval columns, column of the estimate)."""
    return [
        ("logged", "logged_mean"),
        *[(e, e) for e in ("ips", "snips", "dr", "lift_ips", "lift_snips", "lift_dr")],
    ]


# When the report warns.
LOW_ESS = 100.0
FALLBACK_WARNING = 0.05
WEIGHT_Z = 4.0
WEIGHT_Z_ROWS = 100


def warnings(m: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Metrics with an array of warnings, each a code and a sentence."""
    c = F.col
    if summary is not None:
        m = m.join(summary.select(*KEY, "rows_unverified", "rewards_outside_range"), KEY, "left")
    unverified = c("rows_unverified") if summary is not None else F.lit(0)
    outside = c("rewards_outside_range") if summary is not None else F.lit(0)

    def warn(code: str, when: Column, text: str, *args: Column) -> Column:
        return F.when(
            when,
            F.struct(F.lit(code).alias("code"), F.format_string(text, *args).alias("message")),
        )

    found = F.array(
        warn("unverified", unverified > 0,
             "%d unverified uploads are not part of the estimates", unverified),
        warn("fallback", c("fallback_rate") > FALLBACK_WARNING,
             "the policy follows the logged one in %d of %d rows", c("fallback_rows"), c("n")),
        warn("unsupported", c("unsupported_mass") > 0,
             "%.4f of the policy's mass is on actions with logged probability 0",
             c("unsupported_mass")),
        warn("clipping", c("clipped_rows") > 0,
             "%d weights were clipped, the largest was %.4f", c("clipped_rows"), c("max_weight")),
        warn("low_ess", c("ess") < LOW_ESS,
             "the weights are worth %.1f rows", c("ess")),
        warn("propensities",
             (c("n") >= WEIGHT_Z_ROWS) & (F.abs("weight_z") > WEIGHT_Z),
             "the mean weight %.4f is %.1f standard errors off: check the logged pmf",
             c("mean_weight"), c("weight_z")),
        warn("reward_range", outside > 0,
             "%d rewards lie outside the given range", outside),
    )
    return m.withColumn("warnings", F.array_compact(found))
