"""Settings of a policy spec as columns, so that one job serves capsules with different specs.

A spec table holds KEY and `spec` (JSON), one row per capsule, as `retention.spec_history` gives it.  It is compiled
once per distinct text; learning, serving and defaults then read the struct column `settings`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.schema import KEY
from policylens.session import attach, checkpointed
from policylens.spec import PolicySpec

#: Fields of `settings` with their types, in order.
FIELDS = {
    "bits": "int", "learning_rate": "double", "mtr": "boolean", "max_weight": "double", "low": "double", "high": "double",
    "mode": "string", "kind": "string", "gamma_scale": "double", "gamma_exponent": "double", "epsilon": "double",
    "floor": "double", "baseline_epsilon": "double", "reward_default": "double", "wait_seconds": "bigint", "rewards": "string",
    "declared": "string",
}


def settings_of(spec: PolicySpec) -> dict[str, Any]:
    """What a spec says, by the names of `FIELDS`."""
    learner, explore, reward = spec.get("learner"), spec.get("exploration"), spec.get("reward")
    low, high = reward["range"]
    default = reward["default"]
    return {
        "bits": learner["bits"], "learning_rate": float(learner["learningRate"]), "mtr": learner["importance"] == "mtr",
        "max_weight": float(learner["maxImportanceWeight"]), "low": float(low), "high": float(high), "mode": spec.get("mode"),
        "kind": explore["kind"], "gamma_scale": float(explore["gammaScale"]), "gamma_exponent": float(explore["gammaExponent"]),
        "epsilon": float(explore["epsilon"]), "floor": float(explore["floor"]), "baseline_epsilon": float(spec.get("baselineEpsilon")),
        "reward_default": None if default is None else float(default), "wait_seconds": reward["waitSeconds"],
        "rewards": spec.get("rewards"), "declared": json.dumps(spec.get("actions"), separators=(",", ":")),
    }


def literal(spec: PolicySpec) -> Column:
    """One spec's settings for every row."""
    return F.struct(*[F.lit(v).cast(FIELDS[k]).alias(k) for k, v in settings_of(spec).items()])


def compiled(specs: DataFrame) -> DataFrame:
    """KEY and `settings` of a spec table.  A spec that is not valid, or no JSON object, leaves `settings` null and is told in `problem`."""
    kind = ", ".join(f"{k}:{t}" for k, t in FIELDS.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, tuple[dict[str, Any] | None, str | None]] = {}
        for batch in batches:
            got = []
            for text in batch.column(len(KEY)).to_pylist():
                if text not in known:
                    try:
                        known[text] = settings_of(PolicySpec.of(json.loads(text or "{}"))), None
                    except (ValueError, AttributeError) as error:  # AttributeError: JSON that is no object
                        known[text] = None, str(error)
                got.append(known[text])
            settings = pa.array([s for s, _ in got], fields)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(KEY)], settings, pa.array([p for _, p in got], pa.string())], [*KEY, "settings", "problem"])

    types = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "bigint": pa.int64()}
    fields = pa.struct([(k, types[t]) for k, t in FIELDS.items()])
    schema = ", ".join([*[f"{k} string" for k in KEY], f"settings struct<{kind}>", "problem string"])
    return specs.select(*KEY, "spec").mapInArrow(run, schema)


def once(spec: PolicySpec | DataFrame) -> PolicySpec | DataFrame:
    """A spec table compiled and kept, for jobs that read it more than once."""
    return spec if isinstance(spec, PolicySpec) or "settings" in spec.columns else checkpointed(compiled(spec))


def with_settings(df: DataFrame, spec: PolicySpec | DataFrame) -> DataFrame:
    """`df` with `settings`: those of one spec, or of each row's capsule by a spec table.

    A capsule that the table does not name has the default spec.  A row of a capsule whose spec is not valid fails the
    job, as one such spec would.  The table is broadcast if it is small by its measured bytes, else shuffled.
    """
    if isinstance(spec, PolicySpec):
        return df.withColumn("settings", literal(spec))
    told = F.concat(F.lit("spec of "), F.concat_ws("/", *KEY), F.lit(": "), F.col("spec_problem"))
    table = spec if "settings" in spec.columns else compiled(spec)
    joined = attach(df, table.withColumnRenamed("problem", "spec_problem"), KEY, how="left")
    checked = F.when(F.col("spec_problem").isNotNull(), F.raise_error(told).cast(joined.schema["settings"].dataType))
    chosen = checked.otherwise(F.coalesce("settings", literal(PolicySpec.of())))
    return joined.withColumn("settings", chosen).drop("spec_problem")


def weight(settings: Column, probability: Column) -> Column:
    """Importance weight of an update: 1, or a capped inverse probability (L3)."""
    inverse = F.least(1.0 / F.coalesce(probability, F.lit(1.0)), settings["max_weight"])
    return F.when(settings["mtr"], inverse).otherwise(1.0)
