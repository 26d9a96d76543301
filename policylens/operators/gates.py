"""Promotion gates: checks on metrics rows, verdicts and promotion decisions.

A check is `metric op operand [+|- number]`.  Checks are configuration: a handful of strings
that become Column expressions over the metrics table, so any number of capsules and policies
is checked in the same job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.schema import KEY
from policylens.spec import PolicySpec

# The metric names a check may use and the metrics column of each.
METRICS = {
    "dm.estimate": "dm",
    "lift.dm.mean": "lift_dm",
    **{f"{e}.estimate": e for e in ("ips", "snips", "dr")},
    **{f"{e}.{s}": f"{e}_{s}" for e in ("ips", "snips", "dr") for s in ("lower", "upper", "se")},
    **{f"lift.{e}.mean": f"lift_{e}" for e in ("ips", "snips", "dr")},
    **{
        f"lift.{e}.{s}": f"lift_{e}_{s}"
        for e in ("ips", "snips", "dr")
        for s in ("lower", "upper", "se")
    },
    "logged.mean": "logged_mean",
    "logged.lower": "logged_lower",
    "logged.upper": "logged_upper",
    "ess": "ess",
    "coverage": "coverage",
    "n": "n",
    "clip_rate": "clip_rate",
    "max_weight": "max_weight",
}
NUMBER = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
CHECK = re.compile(
    rf"\s*(?P<left>[A-Za-z_][\w.]*)\s*(?P<op>>=|<=|==|>|<)\s*"
    rf"(?:(?P<right>[A-Za-z_][\w.]*)|(?P<value>[+-]?\s*{NUMBER}))"
    rf"\s*(?:(?P<sign>[+-])\s*(?P<offset>{NUMBER}))?\s*"
)
COMPARE = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
}


class GateError(ValueError):
    """A check cannot be read."""


def _known(name: str) -> str:
    if name not in METRICS:
        if name.startswith(("dm.", "lift.dm.")):
            raise GateError(f"{name}: DM has no interval; gate on dr instead")
        raise GateError(f"unknown metric {name}")
    return METRICS[name]


def parse_check(text: str) -> tuple[str, str, str | float, float]:
    """(metrics column, operator, column or number, offset) of a check."""
    found = CHECK.fullmatch(text)
    if not found:
        raise GateError(f"{text!r}: expected metric op (metric or number) [+- number]")
    if found["right"]:
        right: str | float = _known(found["right"])
    else:
        right = float(found["value"].replace(" ", ""))
    offset = float(found["offset"] or 0) * (-1 if found["sign"] == "-" else 1)
    return _known(found["left"]), found["op"], right, offset


def gate(text: str) -> Column:
    """One check as a struct column: check, left, right, pass."""
    left_name, op, right_value, offset = parse_check(text)

    def metric(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)  # undefined is NULL, and NULL fails

    left = metric(left_name)
    right = metric(right_value) if isinstance(right_value, str) else F.lit(right_value)
    right = right + F.lit(offset)
    return F.struct(
        F.lit(text.strip()).alias("check"),
        left.alias("left"),
        right.alias("right"),
        F.coalesce(COMPARE[op](left, right), F.lit(False)).alias("pass"),
    )


def read_gates(text: str, as_json: bool = False) -> list[str]:
    """Checks of a gates document: a list, or one under the key `gates`.

    JSON, or the YAML list form with one quoted or plain check per `- ` line.
    """
    if not text.strip():
        raise GateError("the gates document is empty")
    if as_json:
        doc = json.loads(text)
        items = doc.get("gates") if isinstance(doc, dict) and set(doc) == {"gates"} else doc
        if not isinstance(items, list) or not all(isinstance(i, str) for i in items):
            raise GateError("expected a list of checks, each a text")
    else:
        lines = [re.sub(r"(^|\s)#.*$", "", line).rstrip() for line in text.splitlines()]
        lines = [line.strip() for line in lines if line.strip()]
        if lines and lines[0] == "gates:":
            lines = lines[1:]
        if not all(line.startswith("- ") for line in lines):
            raise GateError("expected a list of checks, each a text")
        items = [line[2:].strip().strip("\"'") for line in lines]
    for item in items:
        parse_check(item)
    return items


def check_gates(metrics: DataFrame, checks: Sequence[str]) -> DataFrame:
    """One row per capsule, policy and check."""
    return metrics.select(
        *KEY, "policy", F.posexplode(F.array(*[gate(c) for c in checks])).alias("gate", "g")
    ).select(*KEY, "policy", "gate", "g.*")


def verdicts(metrics: DataFrame, checks: Sequence[str]) -> DataFrame:
    """Metrics with `gates`, `gates_passed` and a one-line `verdict`."""
    c = F.col
    results = F.array(*[gate(t) for t in checks]) if checks else F.array()
    m = metrics.withColumn("gates", results)
    headline = F.format_string(
        "dr %s, 95%% interval %s to %s; logged %s; lift %s, 95%% interval %s to %s",
        *[
            F.coalesce(F.format_string("%.4f", c(name)), F.lit("n/a"))
            for name in ("dr", "dr_lower", "dr_upper", "logged_mean", "lift_dr", "lift_dr_lower",
                         "lift_dr_upper")
        ],
    )
    if not checks:
        relation = (
            F.when(c("lift_dr_lower") > 0, "better than the logged policy")
            .when(c("lift_dr_upper") < 0, "worse than the logged policy")
            .when(c("lift_dr_lower").isNull(), "no interval for the lift")
            .otherwise("not significantly different from the logged policy")
        )
        return m.withColumn("gates_passed", F.lit(True)).withColumn(
            "verdict", F.concat(F.lit("NO GATES: "), relation, F.lit(": "), headline)
        )
    failed = F.filter("gates", lambda g: ~g["pass"])
    names = F.array_join(F.transform(failed, lambda g: g["check"]), "; ")
    passed = F.size(failed) == 0
    return m.withColumn("gates_passed", passed).withColumn(
        "verdict",
        F.when(
            passed, F.concat(F.lit(f"PASS: {len(checks)} of {len(checks)} checks: "), headline)
        ).otherwise(
            F.concat(
                F.format_string(f"FAIL: %d of {len(checks)} checks (", F.size(failed)),
                names, F.lit("): "), headline,
            )
        ),
    )


def spec_sha256(spec: Column) -> Column:
    return F.sha2(spec, 256)


def promote(
    judged: DataFrame, candidates: DataFrame, current: DataFrame, now_ms: int
) -> DataFrame:
    """Audit rows for gated promotions.

    `judged` comes from `verdicts` with at least one check; `candidates` holds KEY, policy,
    patch and base_sha256 (the spec the candidate was built on); `current` holds KEY and spec.
    A candidate is refused when a gate fails or the spec has changed since.
    """
    now = current.select(*KEY, spec_sha256(F.col("spec")).alias("current_sha256"))
    joined = judged.join(candidates, [*KEY, "policy"]).join(now, KEY, "left")
    joined = joined.withColumn("patch", F.parse_json("patch"))
    fresh = F.coalesce(F.col("base_sha256") == F.col("current_sha256"), F.lit(False))
    good = (F.size("gates") > 0) & F.col("gates_passed")
    event = F.when(~good, "promotion_refused").when(~fresh, "promotion_conflict").otherwise(
        "spec_promoted"
    )
    return joined.select(
        *KEY, "policy", F.lit(now_ms).cast("long").alias("ts_ms"), event.alias("event"),
        F.to_json(F.struct("patch", "verdict", "gates", F.col("n").alias("rows"))).alias("detail"),
    )


def candidate(base: PolicySpec, patch: dict) -> tuple[PolicySpec, str]:
    """A candidate spec and the hash of the spec it was built on."""
    import hashlib

    return base.patched(patch), hashlib.sha256(base.json().encode()).hexdigest()
