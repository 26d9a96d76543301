"""Import of ranking-service decision logs, one JSON event per line (S3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.functions.pmf import once
from policylens.operators.validate import event_id_ok, finite, first_problem
from policylens.schema import IMPORT_SUM_TOLERANCE, KEY
from policylens.sources.logs import clean_lines


def _text(node: Column, path: str) -> Column:
    """A string at a path; NULL when it is absent or no string."""
    at = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string"))


def merged_namespace(value: Column) -> Column:
    """An array of objects merged into one object, later keys win; other values as they are."""
    parts = F.try_variant_get(value, "$", "array<map<string,variant>>")
    none = F.create_map().cast("map<string,variant>")
    merged = F.aggregate(
        parts, none, lambda m, p: F.map_zip_with(m, p, lambda _, a, b: F.coalesce(b, a))
    )
    is_list = F.schema_of_variant(value).startswith("ARRAY") & (F.size(parts) > 0)
    return F.when(F.coalesce(is_list, F.lit(False)), F.parse_json(F.to_json(merged))).otherwise(value)


def namespaces(node: Column, skip: Column) -> Column:
    """JSON text of an object's namespaces whose name neither starts with _ nor is skipped."""
    kept = F.map_filter(
        F.try_variant_get(node, "$", "map<string,variant>"),
        lambda k, _: ~k.startswith("_") & ~F.array_contains(skip, k),
    )
    merged = F.transform_values(kept, lambda _, v: merged_namespace(v))
    return F.to_json(merged)


def parse_dsjson(lines: DataFrame) -> DataFrame:
    """One row per line with `status`: event, deferred, multislot or invalid (S3a-S3h).

    The PMF is aligned with the eligible actions and scaled to sum 1 when the file's sum is
    within 1e-3 of it.
    """
    extra = [c for c in lines.columns if c != "value"]
    none = F.array().cast("array<string>")
    v, c, keys, outcomes = F.col("v"), F.col("c"), F.col("keys"), F.col("outcomes")
    df = once(clean_lines(lines), *extra, "value", F.try_parse_json("value").alias("v"), F.json_object_keys("value").alias("keys"))
    # what is read several times is evaluated once per row
    df = once(
        df, *extra, "value", "v", "keys",
        F.try_variant_get("v", "$.c", "variant").alias("c"),
        F.try_variant_get("v", "$.o", "array<variant>").alias("outcomes"),
        F.try_variant_get("v", "$.a", "array<int>").alias("ranked"),
        F.try_variant_get("v", "$.p", "array<double>").alias("probs"),
        _text(v, "$.Timestamp").alias("stamp"),
    )
    activated = F.exists(
        outcomes,
        lambda o: F.coalesce(F.try_variant_get(o, "$.ActionTaken", "boolean"), F.lit(False)),
    )
    deferred = F.coalesce(F.try_variant_get(v, "$.DeferredAction", "boolean"), F.lit(False))
    multi = F.try_variant_get(c, "$._multi", "array<variant>")

    def action(a: Column, i: Column) -> Column:
        own = F.map_keys(F.try_variant_get(a, "$.i", "map<string,variant>"))
        id_only = F.size(F.array_except(own, F.array(F.lit("constant"), F.lit("id")))) == 0
        skip = F.when(
            F.coalesce(id_only, F.lit(False)), F.array(F.lit("i"), F.lit("id"))
        ).otherwise(F.array(F.lit("id")))
        name = F.coalesce(
            _text(a, "$._tag"), _text(a, "$.i.id"), _text(a, "$.id"), F.concat(F.lit("action"), i)
        )
        return F.struct(name.alias("id"), namespaces(a, skip).alias("features"))

    ranked, probs, stamp = F.col("ranked"), F.col("probs"), F.col("stamp")
    pairs = F.array_sort(F.arrays_zip(ranked.alias("a"), probs.alias("p")))
    total = F.aggregate(probs, F.lit(0.0), lambda s, p: s + p)
    cost = F.try_variant_get(v, "$._label_cost", "double")
    values = F.array_compact(
        F.transform(outcomes, lambda o: F.try_variant_get(o, "$.v", "double"))
    )
    summed = F.when(
        F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    )
    utc = stamp.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d*)?(Z|\+00:00)$")
    ts = F.unix_millis(F.try_to_timestamp(F.when(utc, stamp)))
    parsed = once(
        df,
        *extra,
        "value",
        F.array_contains(keys, "_outcomes").alias("has_outcomes"),
        F.try_variant_get(c, "$._slots", "variant").isNotNull().alias("has_slots"),
        c.isNotNull().alias("has_c"),
        v.isNotNull().alias("is_json"),
        (deferred & ~F.coalesce(activated, F.lit(False))).alias("waiting"),
        _text(v, "$.EventId").alias("id"),
        ts.alias("ts_ms"),
        namespaces(c, none).alias("context"),
        F.transform(multi, action).alias("actions"),
        ranked.alias("ranked"),
        probs.alias("probs"),
        pairs.alias("pairs"),
        total.alias("total"),
        F.coalesce(-cost, summed).alias("reward"),
        (
            ~F.coalesce(F.try_variant_get(v, "$._skipLearn", "boolean"), F.lit(False))
        ).alias("learn"),
    )
    n = F.size("actions")
    problem = first_problem(
        [
            ("not_json", F.col("is_json")),
            ("no_context", F.col("has_c")),
            ("no_event_id", F.col("id").isNotNull()),
            ("event_id_invalid", event_id_ok(F.col("id"))),
            ("timestamp_invalid", F.col("ts_ms").isNotNull()),
            ("no_actions", n > 0),
            ("no_ranking", F.size("ranked") > 0),
            ("rank_out_of_range", F.forall("ranked", lambda a: (a >= 1) & (a <= n))),
            ("no_probabilities", F.col("probs").isNotNull()),
            ("length_mismatch", F.size("ranked") == F.size("probs")),
            ("probability_range", F.forall("probs", lambda p: p.between(0.0, 1.0))),
            ("pmf_sum", F.abs(F.col("total") - 1) <= IMPORT_SUM_TOLERANCE),
            ("chosen_probability_zero", F.get("probs", F.lit(0)) > 0),
            ("reward_not_finite", F.col("reward").isNull() | finite(F.col("reward"))),
        ]
    )
    multislot = F.col("has_slots") | F.coalesce("has_outcomes", F.lit(False))
    judged = parsed.withColumn("problem", problem).withColumn(
        "status",
        F.when(~F.col("is_json") | ~F.col("has_c"), "invalid")
        .when(multislot, "multislot")
        .when(F.col("waiting"), "deferred")
        .when(F.col("problem").isNotNull(), "invalid")
        .otherwise("event"),
    )
    shown = F.when(F.col("status") == "invalid", F.col("problem")).alias("problem")
    return once(judged, *[shown if c == "problem" else c for c in judged.columns])


def import_decisions(parsed: DataFrame) -> DataFrame:
    """Decision rows of the importable events; KEY columns come with the lines."""
    return parsed.filter(F.col("status") == "event").select(
        *KEY, "id", "ts_ms",
        F.lit(0).cast("long").alias("model_version"),
        F.lit("imported").alias("mode"),
        "context", "actions",
        F.transform("pairs", lambda e: e["a"] - 1).alias("eligible"),
        F.transform("pairs", lambda e: e["p"] / F.col("total")).alias("pmf"),
        (F.get("ranked", F.lit(0)) - 1).alias("chosen_index"),
        F.get("actions", F.get("ranked", F.lit(0)) - 1)["id"].alias("chosen_id"),
        (F.get("probs", F.lit(0)) / F.col("total")).alias("probability"),
        F.lit(0).cast("long").alias("seed"),
        F.lit("null").alias("derived"),
        F.lit(None).cast("string").alias("reason"),
        F.sha2("value", 256).alias("request_sha256"),
        F.lit(None).cast("string").alias("program_sha256"),
        *[c for c in ("arrival",) if c in parsed.columns],
    )


def import_rewards(
    parsed: DataFrame, low: float, high: float, learn: bool = False
) -> DataFrame:
    """Reward rows of the importable events, marked as not learned unless `learn` (S3f, S3h)."""
    learned = F.col("learn") & F.lit(learn)
    detail = F.when(learned, '{"imported":"dsjson"}').otherwise(
        '{"imported":"dsjson","learned":false}'
    )
    norm = F.least(F.greatest((F.col("reward") - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    events = parsed.filter((F.col("status") == "event") & F.col("reward").isNotNull())
    return events.select(
        *KEY, F.col("id").alias("decision_id"), "ts_ms", F.col("reward").alias("value"),
        norm.alias("value_norm"), F.col("id").alias("idempotency_key"), detail.alias("detail"),
        *[c for c in ("arrival",) if c in parsed.columns],
    )


def import_report(
    parsed: DataFrame, decisions: DataFrame, rewards: DataFrame
) -> DataFrame:
    """One row of counts; `decisions` and `rewards` are the ingest outcomes (S3i)."""
    lines = parsed.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("status") == "deferred").alias("skipped_deferred"),
        F.count_if(F.col("status") == "multislot").alias("skipped_multislot"),
        F.count_if(F.col("status") == "invalid").alias("invalid"),
    )
    stored = decisions.agg(
        F.count_if(F.col("outcome") == "inserted").alias("decisions"),
        F.count_if(F.col("outcome") == "duplicate").alias("already_present"),
        F.count_if(F.col("outcome") == "invalid").alias("not_stored"),
    )
    paid = rewards.agg(F.count_if(F.col("outcome") == "applied").alias("rewards"))
    one = F.lit(1).alias("one")
    return (
        lines.select("*", one)
        .join(stored.select("*", one), "one")
        .join(paid.select("*", one), "one")
        .select(
            "lines", "decisions", "rewards", "already_present", "skipped_deferred",
            "skipped_multislot", (F.col("invalid") + F.col("not_stored")).alias("invalid"),
        )
    )


def first_errors(parsed: DataFrame, order: str = "arrival", limit: int = 10) -> DataFrame:
    """The first invalid lines with their problem (S3i)."""
    return (
        parsed.filter(F.col("status") == "invalid")
        .select(order, "problem")
        .orderBy(order)
        .limit(limit)
    )
