"""Sinks: decision JSON with nested rewards, and evaluation reports."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policylens.schema import KEY


def decision_fields() -> list[Column]:
    c = F.col
    unsigned = F.conv(F.hex(c("seed")), 16, 10)
    return [
        c("id").alias("decisionId"), c("ts_ms").alias("tsMs"),
        c("model_version").alias("modelVersion"), "mode",
        F.parse_json("context").alias("context"), F.parse_json("derived").alias("derived"),
        F.transform(
            "actions",
            lambda a: F.struct(
                a["id"].alias("id"), F.parse_json(a["features"]).alias("features")
            ),
        ).alias("actions"),
        "eligible", "pmf", c("chosen_index").alias("chosenIndex"), c("chosen_id").alias("action"),
        "probability", unsigned.alias("seed"), "reason",
        c("request_sha256").alias("requestSha256"), c("program_sha256").alias("programSha256"),
    ]


def export_decisions(decisions: DataFrame, rewards: DataFrame) -> DataFrame:
    """One JSON text per decision with all its rewards in sequence order."""
    by = [*KEY, "id"]
    placed = rewards.withColumnRenamed("decision_id", "id")
    event = F.struct(
        F.col("seq"), F.col("ts_ms").alias("tsMs"), F.col("value").alias("reward"),
        F.col("value_norm").alias("rewardNormalized"),
        F.col("idempotency_key").alias("idempotencyKey"),
        F.col("detail").alias("detail"),
    )
    lists = placed.groupBy(*by).agg(F.array_sort(F.collect_list(event)).alias("events"))
    shown_events = F.transform(
        F.coalesce("events", F.array().cast(lists.schema["events"].dataType)),
        lambda e: F.struct(
            e["seq"].alias("seq"), e["tsMs"].alias("tsMs"), e["reward"].alias("reward"),
            e["rewardNormalized"].alias("rewardNormalized"),
            e["idempotencyKey"].alias("idempotencyKey"),
            F.try_parse_json(e["detail"]).alias("detail"),
        ),
    )
    joined = decisions.join(lists, by, "left")
    options = {"ignoreNullFields": "false"}
    line = F.to_json(F.struct(*decision_fields(), shown_events.alias("rewards")), options)
    return joined.select(*by, line.alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("errorifexists").text(path)


def write_report(verdicts: DataFrame, path: str) -> None:
    """The metrics, gates and verdict of every capsule and policy as JSON lines."""
    verdicts.write.mode("errorifexists").json(path)


def shown(x: float | None) -> str:
    """A number for readers, to four significant digits; a dash where it is undefined."""
    return "-" if x is None or math.isnan(x) else format(x, ".4g")


#: Columns of the report's first table: what a row is called, and the metric it shows.
ESTIMATES = {
    "logged": "logged_mean", "dm": "dm", "ips": "ips", "snips": "snips", "dr": "dr",
    "lift_dm": "lift_dm", "lift_ips": "lift_ips", "lift_snips": "lift_snips", "lift_dr": "lift_dr",
}
DIAGNOSTICS = [
    "n", "ess", "coverage", "clip_rate", "max_weight", "mean_weight", "fallback_rate", "unsupported_mass",
]


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    return ["", *["| " + " | ".join(cells) + " |" for cells in (head, ["---"] * len(head), *rows)], ""]


def markdown(verdict_row: dict) -> str:
    """A Markdown page of one already aggregated capsule and policy."""
    m = verdict_row
    policy = str(m["policy"]).replace("|", "\\|").replace("`", "'")
    page = [f"# {policy} in {'/'.join(m[k] for k in KEY)}", "", f"**{m['verdict']}**"]
    page += _table(
        ["estimator", "value", "standard error", "from", "to"],
        [
            [name.replace("_", " "), *[shown(m.get(c)) for c in (value, f"{name}_se", f"{name}_lower", f"{name}_upper")]]
            for name, value in ESTIMATES.items()
        ],
    )
    page += _table(["diagnostic", "value"], [[name, shown(m[name])] for name in DIAGNOSTICS])
    if m.get("gates"):
        page += _table(
            ["gate", "left", "right", "holds"],
            [[f"`{g['check']}`", shown(g["left"]), shown(g["right"]), "yes" if g["pass"] else "**no**"] for g in m["gates"]],
        )
    page += [f"- {w['message']}" for w in m.get("warnings") or []]
    return "\n".join(page) + "\n"


def write_pages(verdicts: DataFrame, path: str) -> None:
    """A Markdown page per capsule and policy, in a folder named by them.

    Executors render the pages and Spark's commit protocol writes them, so a lost task leaves no half page and any store that
    Spark writes to will do.  A page that exists already is an error, as for the other sinks.
    """
    names = verdicts.columns

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            of = [pa.array([r[c] for r in rows], pa.string()) for c in (*KEY, "policy")]
            yield pa.RecordBatch.from_arrays([*of, pa.array([markdown(r) for r in rows], pa.string())], [*KEY, "policy", "value"])

    pages = verdicts.select(*names).mapInArrow(render, ", ".join(f"{c} string" for c in (*KEY, "policy", "value")))
    pages.write.mode("errorifexists").partitionBy(*KEY, "policy").text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages under a path: KEY, policy and `value`, the whole page."""
    named = ", ".join(f"{c} string" for c in ("value", *KEY, "policy"))
    return spark.read.schema(named).text(path, wholetext=True)
