"""Canonical schemas and the fixed limits shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

#: A capsule (one decision point) is addressed by these three columns.
KEY = ["tenant", "job", "capsule"]

ACTION = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("features", T.StringType())]
)

DECISIONS = T.StructType(
    [
        T.StructField("tenant", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("capsule", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("model_version", T.LongType()),
        T.StructField("mode", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("actions", T.ArrayType(ACTION)),
        T.StructField("eligible", T.ArrayType(T.IntegerType())),
        T.StructField("pmf", T.ArrayType(T.DoubleType())),
        T.StructField("chosen_index", T.IntegerType()),
        T.StructField("chosen_id", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("seed", T.LongType()),
        T.StructField("derived", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("request_sha256", T.StringType()),
        T.StructField("program_sha256", T.StringType()),
    ]
)

REWARDS = T.StructType(
    [
        T.StructField("tenant", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("capsule", T.StringType()),
        T.StructField("decision_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("value_norm", T.DoubleType()),
        T.StructField("idempotency_key", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("tenant", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("capsule", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)

#: A model is a header row plus one row per touched slot (no blobs).
MODEL_HEADER = T.StructType(
    [
        T.StructField("tenant", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("capsule", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("reward_seq", T.LongType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("n_updates", T.LongType()),
        T.StructField("total_weight", T.DoubleType()),
        T.StructField("norm_sum", T.DoubleType()),
    ]
)

MODEL_SLOTS = T.StructType(
    [
        T.StructField("tenant", T.StringType()),
        T.StructField("job", T.StringType()),
        T.StructField("capsule", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("slot", T.LongType()),
        T.StructField("u", T.FloatType()),
        T.StructField("s", T.FloatType()),
        T.StructField("a", T.FloatType()),
    ]
)

FEATURE = T.StructType(
    [T.StructField("hash", T.LongType()), T.StructField("value", T.FloatType())]
)
FEATURES = T.StructType(
    [
        T.StructField("x", T.ArrayType(FEATURE)),
        T.StructField("a", T.ArrayType(T.ArrayType(FEATURE))),
    ]
)

# Limits and tolerances that decide which records are accepted.
MAX_ACTIONS = 1024
MAX_ACTION_ID_CHARS = 256
MAX_KEY_PART_CHARS = 128
MAX_ID_CHARS = 256
PMF_SUM_TOLERANCE = 1e-6
PROBABILITY_TOLERANCE = 1e-9
IMPORT_SUM_TOLERANCE = 1e-3
UPLOAD_MAX_AGE_MS = 7 * 24 * 3600 * 1000
UPLOAD_MAX_AHEAD_MS = 5 * 60 * 1000
DEFERRED_TTL_MS = 24 * 3600 * 1000
MAX_REWARD_WAIT_SECONDS = 7 * 24 * 3600
UNVERIFIED = "unverified"
Z_95 = 1.959963984540054
