"""Lookups, pages, rankings and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylens.operators.joins import of_key
from policylens.schema import KEY


class UnknownCursor(ValueError):
    """The page cursor names a decision that is not in the log."""


def point_lookup(decisions: DataFrame, key: tuple[str, str, str], decision_id: str) -> DataFrame:
    return decisions.filter(of_key(key) & (F.col("id") == decision_id))


def in_window(df: DataFrame, since_ms: int | None = None, until_ms: int | None = None):
    """Rows with ts_ms in [since, until); the range reaches the Parquet scan."""
    if since_ms is not None:
        df = df.filter(F.col("ts_ms") >= since_ms)
    if until_ms is not None:
        df = df.filter(F.col("ts_ms") < until_ms)
    return df


def page(
    decisions: DataFrame, key: tuple[str, str, str], limit: int, newest: bool = False,
    since_ms: int | None = None, until_ms: int | None = None, after_id: str | None = None,
) -> DataFrame:
    """One page by (ts_ms, id); only the page itself is sorted to one place."""
    rows = in_window(decisions.filter(of_key(key)), since_ms, until_ms)
    if after_id is not None:
        cursor = point_lookup(decisions, key, after_id).select("ts_ms").first()
        if cursor is None:
            raise UnknownCursor(after_id)
        at, ts = F.lit(after_id), cursor["ts_ms"]
        later = (F.col("ts_ms") > ts) | ((F.col("ts_ms") == ts) & (F.col("id") > at))
        earlier = (F.col("ts_ms") < ts) | ((F.col("ts_ms") == ts) & (F.col("id") < at))
        rows = rows.filter(earlier if newest else later)
    order = [F.col("ts_ms"), F.col("id")]
    return rows.orderBy(*[c.desc() if newest else c.asc() for c in order]).limit(limit)


def latest_audit(audit: DataFrame, key: tuple[str, str, str], limit: int) -> DataFrame:
    """The newest `limit` audit rows, oldest first."""
    return audit.filter(of_key(key)).orderBy(F.col("seq").desc()).limit(limit).orderBy("seq")


def capsule_stats(decisions: DataFrame, rewards: DataFrame) -> DataFrame:
    """Row counts and bounds per capsule (A1)."""
    d = decisions.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("decisions"),
        F.min("ts_ms").alias("first_decision_ms"),
        F.max("ts_ms").alias("last_decision_ms"),
    )
    r = rewards.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("rewards"), F.max("seq").alias("last_reward_seq")
    )
    return d.join(r, KEY, "full").fillna(0, ["decisions", "rewards"])


# Upper bounds of the latency buckets in seconds.
LATENCY_BOUNDS = [
    0.000005, 0.00001, 0.000025, 0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01,
    0.025, 0.05, 0.1,
]


def latency_histogram(df: DataFrame, seconds: Column) -> DataFrame:
    """Cumulative buckets with sum and count; the last bucket has no bound (A4).

    All buckets are conditional sums of one pass, so no bucket is missing when empty.
    """
    total = df.select(seconds.alias("s")).filter(F.col("s").isNotNull()).agg(
        *[F.count_if(F.col("s") <= b).alias(f"b{i}") for i, b in enumerate(LATENCY_BOUNDS)],
        F.count(F.lit(1)).alias("all"),
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("sum"),
    )
    rows = [
        F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cumulative"))
        for i, b in enumerate(LATENCY_BOUNDS)
    ]
    rows.append(
        F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("cumulative"))
    )
    return total.select(
        F.inline(F.array(*rows)), F.col("sum").alias("sum_seconds"), F.col("all").alias("count")
    )


def log_counters(decisions: DataFrame, rewards: DataFrame, audit: DataFrame) -> DataFrame:
    """Counters per capsule: committed, default and upload outcomes (A5)."""
    d = decisions.groupBy(*KEY).agg(F.count(F.lit(1)).alias("decisions_committed"))
    is_default = F.coalesce(F.get_json_object("detail", "$.default") == "true", F.lit(False))
    r = rewards.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("rewards_committed"),
        F.count_if(is_default).alias("default_rewards"),
    )
    a = audit.groupBy(*KEY).agg(
        F.count_if(F.col("event") == "upload_accepted").alias("uploads_accepted"),
        F.count_if(F.col("event") == "upload_rejected").alias("uploads_rejected"),
    )
    joined = d.join(r, KEY, "full").join(a, KEY, "full")
    return joined.fillna(0)


def regret_report(df: DataFrame, by: list[str], rank: Column, rounds: Column) -> DataFrame:
    """Mean regret, and the last tenth's share of the best mean reward.

    `means` holds each action's known mean; `rank` numbers a group's rounds from 0.
    """
    best = F.array_max("means")
    got = F.get("means", F.col("chosen_index"))
    tail = rank >= rounds - F.floor(rounds / 10)
    return df.withColumn("best", best).withColumn("got", got).groupBy(*by).agg(
        F.avg(F.col("best") - F.col("got")).alias("regret_per_round"),
        F.try_divide(
            F.sum(F.when(tail, F.col("got"))), F.sum(F.when(tail, F.col("best")))
        ).alias("tail_share"),
    )


def numbered(df: DataFrame, by: list[str], order: str, block_rows: int = 1 << 20) -> DataFrame:
    """Adds `rank` from 0 and `rounds` per group without one task per group.

    `order` is a unique long inside a group; see `ingest.next_seq` for the block idea.
    """
    df = df.withColumn("block", F.floor(F.col(order) / block_rows))
    sizes = df.groupBy(*by, "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"),
        F.sum("n").over(Window.partitionBy(*by)).alias("rounds"),
    )
    inside = Window.partitionBy(*by, "block").orderBy(order)
    return (
        df.withColumn("r", F.row_number().over(inside))
        .join(offsets, [*by, "block"])
        .withColumn("rank", F.col("o") + F.col("r") - 1)
        .drop("block", "o", "r")
    )


def outcome_breakdown(logged: DataFrame) -> DataFrame:
    """Mean quality, cost and latency and the failure share per action, from `detail`."""
    doc = F.try_parse_json("detail")

    def read(path: str, kind: str) -> Column:
        return F.try_variant_get(doc, path, kind)

    return (
        logged.select(
            *KEY, "chosen_id",
            read("$.quality", "double").alias("quality"),
            read("$.costUsd", "double").alias("cost"),
            read("$.latencyMs", "double").alias("latency"),
            read("$.ok", "boolean").alias("ok"),
        )
        .groupBy(*KEY, "chosen_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("quality").alias("mean_quality"),
            F.sum("cost").alias("total_cost_usd"),
            F.avg("latency").alias("mean_latency_ms"),
            F.avg(F.when(F.col("ok"), 0.0).when(~F.col("ok"), 1.0)).alias("failure_rate"),
        )
    )


def _meet(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which null is one."""
    named = right.select(*[F.col(c).alias(f"_{c}" if c in by else c) for c in right.columns])
    same = F.lit(True)
    for c in by:
        same = same & left[c].eqNullSafe(named[f"_{c}"])
    return left.join(named, same, how).drop(*[f"_{c}" for c in by])


#: Equal parts of a group's range that are counted before values are looked at.
RANGES = 4096


def column_stats(df: DataFrame, by: list[str], value: str, percent: float) -> DataFrame:
    """Mean, population deviation, extremes and an interpolated percentile.

    The percentile is exact and no task holds a group's values: counts of equal ranges tell in which
    ranges the two ranks beside it lie, and only the values of those are ranked, by their counts.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must be in [0, 100]")
    stats = df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_dev"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        ((F.count(value) - 1) * (percent / 100)).alias("rank"),
    )
    values = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    held = _meet(values, stats, by)
    part = F.try_divide((F.col("v") - F.col("low")) * RANGES, F.col("high") - F.col("low"))
    counted = (
        held.groupBy(*by, "rank", F.coalesce(F.floor(part), F.lit(0).cast("long")).alias("range"), "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    up_to = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counted.groupBy(*by, "rank", "range").agg(F.sum("n").alias("m")).withColumn(
        "before", F.coalesce(F.sum("m").over(up_to), F.lit(0))
    )
    around = ranges.filter(
        (F.col("before") <= F.ceil("rank")) & (F.col("before") + F.col("m") > F.floor("rank"))
    ).select(*by, "range", "before")
    inside = Window.partitionBy(*by, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = _meet(counted, around, [*by, "range"]).withColumn(
        "first", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col("v")))

    between = placed.groupBy(*by).agg(
        at(F.floor("rank")).alias("below"), at(F.ceil("rank")).alias("above"), F.max("rank").alias("r")
    )
    share = F.col("r") - F.floor("r")
    percentile = F.when(share == 0, F.col("below")).otherwise(
        (1 - share) * F.col("below") + share * F.col("above")
    )
    return _meet(stats, between.select(*by, percentile.alias("percentile")), by, "left").drop("rank")


def ewma(
    df: DataFrame, by: list[str], order: str, value: str, alpha: float, window: int = 1 << 16
) -> DataFrame:
    """One-step exponentially weighted forecast of each group's ordered series.

    f = a v + (1 - a) f is affine in the carried forecast.  Stretches of at most `window` consecutive
    order values are folded on their own; a stretch counts (1 - a) to the power of the number of
    values after it, and the stretches' shares add up.  No list grows with the number of stretches.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    keep = 1.0 - alpha
    entry = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    stretches = (
        df.groupBy(*by, F.floor(F.col(order) / window).alias("stretch"))
        .agg(F.array_sort(F.collect_list(entry)).alias("e"))
        .select(
            *by, "stretch",
            F.get("e", F.lit(0))["v"].alias("first"),
            F.size("e").alias("n"),
            F.aggregate("e", F.lit(0.0), lambda f, x: f * keep + x["v"] * alpha).alias("add"),
            F.aggregate(
                F.slice("e", F.lit(2), F.greatest(F.size("e") - 1, F.lit(0))),
                F.get("e", F.lit(0))["v"],
                lambda f, x: f * keep + x["v"] * alpha,
            ).alias("alone"),
        )
    )
    # what comes after a stretch multiplies its share; the earliest one has no forecast before it
    later = Window.partitionBy(*by).orderBy(F.col("stretch").desc())
    after = F.coalesce(F.sum("n").over(later.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earliest = F.lead("stretch").over(later).isNull()
    share = F.when(earliest, F.col("alone")).otherwise(F.col("add")) * F.pow(F.lit(keep), after.cast("double"))
    return stretches.select(*by, share.alias("share")).groupBy(*by).agg(F.sum("share").alias("forecast"))



def ranking(decisions: DataFrame) -> DataFrame:
    """Eligible actions by probability, ties in action order: (id, rank, action, p)."""
    pairs = F.arrays_zip(F.col("pmf").alias("p"), F.col("eligible").alias("index"))
    ordered = F.array_sort(
        pairs,
        lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1)
        .when(a["index"] < b["index"], -1).when(a["index"] > b["index"], 1).otherwise(0),
    )
    return decisions.select(
        *KEY, "id", "actions", F.posexplode(ordered).alias("rank", "e")
    ).select(
        *KEY, "id", "rank",
        F.get("actions", F.col("e.index"))["id"].alias("action"),
        F.col("e.p").alias("probability"),
    )


def rank_table(decisions: DataFrame) -> DataFrame:
    """Chosen action first, the other eligible ones by probability, excluded last at 0."""
    chosen = F.col("chosen_index")
    entries = F.transform(
        F.sequence(F.lit(0), F.size("actions") - 1),
        lambda i: F.struct(
            F.when(i == chosen, 0).when(F.array_contains("eligible", i), 1).otherwise(2).alias(
                "tier"
            ),
            F.when(i == chosen, F.lit(0.0))
            .otherwise(
                -F.coalesce(
                    F.get("pmf", F.array_position("eligible", i).cast("int") - 1), F.lit(0.0)
                )
            )
            .alias("minus_p"),
            i.alias("index"),
        ),
    )
    return decisions.select(
        *KEY, "id", "actions", "chosen_index", "probability",
        F.posexplode(F.array_sort(entries)).alias("rank", "e"),
    ).select(
        *KEY, "id", "rank",
        F.get("actions", F.col("e.index"))["id"].alias("action"),
        F.when(F.col("e.tier") == 0, F.coalesce("probability", F.lit(1.0)))
        .otherwise(F.abs("e.minus_p"))
        .alias("probability"),
    )
