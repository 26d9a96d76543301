"""Scalar and JSON helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_get(text: Column, path: str, kind: str = "string") -> Column:
    """Value at a `$.a.b[0]` path; NULL when absent (F16)."""
    return F.try_variant_get(F.try_parse_json(text), path, kind)


def json_has(text: Column, path: str) -> Column:
    """Whether the path exists, a JSON null included (F16)."""
    return F.try_variant_get(F.try_parse_json(text), path, "variant").isNotNull()


def json_len(text: Column, path: str = "$") -> Column:
    """Elements of an array, keys of an object or characters of a string (F16)."""
    at = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = F.schema_of_variant(at)
    shown = F.to_json(at)
    return (
        F.when(kind.startswith("ARRAY"), F.json_array_length(shown))
        .when(kind.startswith("OBJECT"), F.size(F.json_object_keys(shown)))
        .when(kind == "STRING", F.char_length(F.try_variant_get(at, "$", "string")))
        .cast("int")
    )


# Text that marks a message as containing code.
CODE_MARKS = ["```", "def ", "function "]


def prompt_features(messages: DataFrame, by: str = "conv_id") -> DataFrame:
    """Size, turns, system message and code hint of each conversation."""
    code = F.lit(False)
    for mark in CODE_MARKS:
        code = code | F.contains(F.col("text"), F.lit(mark))
    chars = F.coalesce(F.sum(F.char_length("text")), F.lit(0))
    return messages.groupBy(by).agg(
        F.bround(chars / 4.0).cast("bigint").alias("prompt_tokens"),
        F.count_if(F.col("role") == "user").alias("turns"),
        F.bool_or(F.col("role") == "system").alias("has_system"),
        F.coalesce(F.bool_or(code), F.lit(False)).alias("looks_like_code"),
    )


def compose_reward(
    quality: Column, ok: Column, cost_usd: Column, latency_s: Column,
    cost_weight: float, latency_weight: float, failure_reward: float = 0.0,
) -> Column:
    """Quality minus weighted cost and latency; failures get a fixed reward."""
    worth = (
        quality
        - F.coalesce(cost_usd, F.lit(0.0)) * cost_weight
        - latency_s * latency_weight
    )
    failed = ~F.coalesce(ok, F.lit(False)) | quality.isNull()
    return F.when(failed, F.lit(float(failure_reward))).otherwise(worth)


def capacity(load: Column, target: float, low: int, high: int) -> Column:
    """Units needed for a load, clamped."""
    if not (target > 0 and 0 <= low <= high):
        raise ValueError("capacity needs target > 0 and 0 <= low <= high")
    needed = F.ceil(load / F.lit(float(target)))
    return F.least(F.greatest(needed, F.lit(low)), F.lit(high)).cast("bigint")
