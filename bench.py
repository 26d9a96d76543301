"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the table folder, BENCH_CPUS the local cores.  Each query runs once to warm up
and once timed; the timed run consumes every output row.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from policylens.operators import estimators as S  # noqa: E402
from policylens.operators import policies as T  # noqa: E402
from policylens.operators.bootstrap import with_bootstrap  # noqa: E402
from policylens.plans import catalog  # noqa: E402
from policylens.plans.evaluate import EvalConfig, evaluate, with_linear_model  # noqa: E402
from policylens.plans.log_queries import logged  # noqa: E402
from policylens.session import local_session  # noqa: E402

#: Registered queries that are timed as they are.
NAMED = [
    "J1_logged_rows_first", "J1_logged_rows_sum", "E1_ingest_decisions", "E2_ingest_rewards",
    "V1_validate_logged", "O28_constant_sweep", "O5_policy_greedy", "O19_bootstrap_intervals",
    "O9a_linear_reward_model", "L4_score", "L5_decide_batch", "L6_verify_uploads",
    "S1_read_logged_rows", "S3_import_dsjson",
]


def evaluate_100k(spark, folder) -> DataFrame:
    """The reference workload: DM, IPS, SNIPS and DR of one policy with the cross-fitted linear
    model, 5 folds and 1000 resamples."""
    config = EvalConfig()
    return evaluate(
        logged(spark, folder), lambda d: with_linear_model(d, config), [T.constant("click")],
        config, ["lift.dr.lower >= 0"],
    )


def bootstrap_1000(spark, folder) -> DataFrame:
    """1000 resamples of one policy without a reward model."""
    rows = S.eval_rows(logged(spark, folder))
    t = S.terms(T.sweep(rows, [T.constant("click")]))
    return with_bootstrap(S.metrics(t), t, 1000, 7)


def consume(df: DataFrame) -> int:
    """Every row and column is computed; only a count and a hash come back."""
    return df.agg(F.count(F.lit(1)), F.max(F.xxhash64(*df.columns))).first()[0]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(
        cpus,
        "bench",
        **{
            "spark.ui.showConsoleProgress": "false",
            # the inputs are a few MB: keep one partition per core for compute-heavy stages
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        },
    )
    work = {
        "evaluate_linear_bootstrap": evaluate_100k,
        "bootstrap_1000": bootstrap_1000,
        **{name: catalog.QUERIES[name] for name in NAMED},
    }
    seconds: dict[str, float] = {}
    for name, run in work.items():
        if only and name not in only:
            continue
        consume(run(spark, folder))
        start = time.perf_counter()
        consume(run(spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
