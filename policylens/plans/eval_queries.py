"""Queries of off-policy evaluation and of PMF functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylens.functions import features as X
from policylens.functions import pmf as P
from policylens.operators import estimators as S
from policylens.operators import gates as G
from policylens.operators import policies as T
from policylens.operators.bootstrap import intervals
from policylens.operators.estimators import warnings
from policylens.operators.gates import verdicts
from policylens.operators.reports import in_window
from policylens.operators.reward_model import cell_means, cross_fit, reward_scale
from policylens.operators.validate import data_summary
from policylens.plans import nag_sql as N
from policylens.plans import oracle as O
from policylens.plans.evaluate import EvalConfig, evaluate
from policylens.plans.log_queries import LOG, NOW, logged
from policylens.plans.registry import query, r, rounded
from policylens.plans.sample_log import document_decisions, event_decisions
from policylens.schema import KEY
from policylens.session import shared_folder, written
from policylens.sources import exports
from policylens.spec import PolicySpec


def segment():
    return F.get_json_object("context", "$.seg")


def fold():
    return (F.col("arrival") % 5).cast("int")



def rows(spark: SparkSession, folder: str) -> DataFrame:
    return S.eval_rows(logged(spark, folder))


def modelled(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation rows with leave-fold-out cell means as the reward model."""
    return cell_means(rows(spark, folder), segment(), fold(), 5)


def all_terms(spark: SparkSession, folder: str, w_max: float = 100.0) -> DataFrame:
    return S.terms(T.action_constants(modelled(spark, folder)), w_max)


def all_metrics(spark: SparkSession, folder: str, w_max: float = 100.0) -> DataFrame:
    return S.metrics(all_terms(spark, folder, w_max))


def picked(*names: str):
    """A query of some metrics columns of every constant policy, with its SQL twin."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(all_metrics(spark, folder).select("capsule", "policy", *names))

    cells = []
    for n in names:
        if n.endswith(("_lower", "_upper")):
            base, sign = (n[:-6], "-") if n.endswith("_lower") else (n[:-6], "+")
            mean = "logged_mean" if base == "logged" else base
            cells.append(f"round({mean} {sign} 1.959963984540054 * {base}_se, 6) AS {n}")
        elif n in ("n", "clipped_rows", "fallback_rows"):
            cells.append(n)
        else:
            cells.append(f"round({n}, 6) AS {n}")
    return run, O.evaluation() + f" SELECT capsule, policy, {', '.join(cells)} FROM am"


def metric_query(name: str, *columns: str) -> None:
    run, sql = picked(*columns)
    query(name, sql)(run)


metric_query("O11_ips", "n", "ips")
metric_query("O12_snips", "snips")
metric_query("O13_dm", "dm")
metric_query("O14_dr", "dr")
metric_query("O15_logged_value", "logged_mean")
metric_query("O16_lift", "lift_dm", "lift_ips", "lift_snips", "lift_dr")
metric_query(
    "O17_standard_errors", "logged_se", "ips_se", "snips_se", "dr_se", "lift_ips_se",
    "lift_snips_se", "lift_dr_se",
)
metric_query(
    "O18_normal_intervals",
    *[f"{n}_{s}" for n in ("logged", "ips", "snips", "dr", "lift_ips", "lift_snips", "lift_dr")
      for s in ("lower", "upper")],
)
metric_query(
    "O20_diagnostics", "n", "ess", "coverage", "clip_rate", "clipped_rows", "max_weight",
    "mean_weight", "fallback_rows", "fallback_rate", "unsupported_mass",
)
metric_query("O21_propensity_z", "weight_z")
metric_query(
    "O28_constant_sweep", "n", "logged_mean", "ips", "ips_se", "ips_lower", "ips_upper", "snips",
    "snips_se", "dm", "dr", "dr_se", "dr_lower", "dr_upper", "lift_dr", "lift_dr_se", "ess",
    "coverage", "max_weight", "fallback_rate",
)


@query("O1_eval_data", LOG + """
SELECT capsule, fold::INT AS fold, count(*) AS n, round(sum(reward), 4) AS total,
  round(min(reward), 6) AS lo, round(max(reward), 6) AS hi FROM er GROUP BY ALL""")
def o1(spark, folder):
    return rows(spark, folder).groupBy("capsule", fold().alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("reward"), 4).alias("total"),
        r(F.min("reward")).alias("lo"), r(F.max("reward")).alias("hi"),
    )


@query("O1_preconditions", LOG + """,
twice AS (SELECT * FROM er UNION ALL SELECT * FROM er WHERE reward >= 400),
again AS (SELECT capsule, count(*) FILTER (reward >= 400) AS repeated_ids FROM er GROUP BY ALL)
SELECT capsule, policy, count(*) AS rows, 0::BIGINT AS invalid_rows,
  CASE WHEN policy = 'target-column' THEN count(*) FILTER (reward >= 100 OR reward < 5) ELSE 0 END AS bad_targets,
  policy = 'constant:nothing' AS never_eligible, any_value(repeated_ids) AS repeated_ids
FROM twice JOIN again USING (capsule), (VALUES ('target-column'), ('constant:nothing'), ('constant:click')) p(policy)
GROUP BY capsule, policy""")
def o1_preconditions(spark, folder):
    """Faults put into the log: missing and unscaled targets, repeated rows, an unknown action."""
    scaled = F.transform("pmf", lambda p: p * 2)
    target = F.when(F.col("reward") >= 100, F.lit(None)).when(F.col("reward") < 5, scaled).otherwise(F.col("pmf"))
    d = rows(spark, folder).withColumn("target_pmf", target)
    d = d.unionByName(d.filter("reward >= 400"))
    found = S.faults(d, T.sweep(d, [T.target_column(), T.constant("nothing"), T.constant("click")]))
    return found.drop("tenant", "job")


def exploded(swept: DataFrame) -> DataFrame:
    """One row per eligible action of each policy row."""
    return swept.select(
        "capsule", "id", "policy", "falls_back",
        F.posexplode(F.arrays_zip(F.col("eligible"), F.col("pi"))).alias("position", "e"),
        "actions",
    ).select(
        "capsule", "id", "policy", "falls_back",
        F.get("actions", F.col("e.eligible"))["id"].alias("action"),
        r(F.col("e.pi"), 9).alias("pi"),
    )


@query("O2_policy_logged", LOG + """
SELECT capsule, id, 'logged' AS policy, false AS falls_back, action, round(mu, 9) AS pi FROM la""")
def o2(spark, folder):
    return exploded(T.sweep(rows(spark, folder), [T.logged()]))


@query("O3_policy_constant", LOG + """
SELECT capsule, id, 'constant:signup' AS policy, seg = 3 AS falls_back, action,
  round(CASE WHEN seg = 3 THEN mu WHEN action = 'signup' THEN 1 ELSE 0 END, 9) AS pi FROM la""")
def o3(spark, folder):
    return exploded(T.sweep(rows(spark, folder), [T.constant("signup")]))


@query("O4_policy_target_column", LOG + """
SELECT capsule, id, 'target-column' AS policy, false AS falls_back, action,
  round(1.0::DOUBLE / k, 9) AS pi FROM la""")
def o4(spark, folder):
    uniform = F.transform("eligible", lambda _: 1.0 / F.size("eligible"))
    d = rows(spark, folder).withColumn("target_pmf", uniform)
    return exploded(T.sweep(d, [T.target_column()]))


GREEDY = """
  SELECT *, 'greedy' AS policy, false AS falls, CASE WHEN idx = first_value(idx) OVER (
    PARTITION BY capsule, id ORDER BY rhat DESC, idx) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pi
  FROM lr"""


@query("O5_policy_greedy", O.evaluation(GREEDY) + """
SELECT capsule, policy, n, round(ips, 6) AS ips, round(snips, 6) AS snips, round(dm, 6) AS dm,
  round(dr, 6) AS dr, round(dr_se, 6) AS dr_se, round(lift_dr, 6) AS lift_dr FROM am""")
def o5(spark, folder):
    t = S.terms(T.sweep(modelled(spark, folder), [T.greedy()]))
    return rounded(
        S.metrics(t).select(
            "capsule", "policy", "n", "ips", "snips", "dm", "dr", "dr_se", "lift_dr"
        )
    )


CANDIDATE = PolicySpec.of({"exploration": {"gammaScale": 2.0, "floor": 0.1}})
SERVED = """
  SELECT *, 'candidate spec' AS policy, false AS falls,
    0.9 * CASE WHEN best THEN 1 - others ELSE p END + 0.1 / k AS pi
  FROM (SELECT *, sum(CASE WHEN best THEN 0 ELSE p END) OVER (PARTITION BY capsule, id) AS others
    FROM (SELECT *, 1.0 / (k + 2.0 * sqrt(n_updates) * (top - u)) AS p
      FROM (SELECT *, max(u) OVER (PARTITION BY capsule, id) AS top,
          idx = first_value(idx) OVER (PARTITION BY capsule, id ORDER BY u DESC, idx) AS best
        FROM (SELECT lr.*, least(greatest((rhat - lo) / (hi - lo), 0), 1) AS u
          FROM lr JOIN (SELECT capsule, min(reward) AS lo, max(reward) AS hi FROM er GROUP BY ALL) s
          ON s.capsule = lr.capsule))))"""


@query("O7_policy_candidate", O.evaluation(SERVED) + """
SELECT capsule, policy, n, round(ips, 6) AS ips, round(snips, 6) AS snips, round(dm, 6) AS dm,
  round(dr, 6) AS dr, round(dr_se, 6) AS dr_se, round(coverage, 6) AS coverage FROM am""")
def o7(spark, folder):
    d = reward_scale(modelled(spark, folder))
    unit = F.transform(
        "rhat",
        lambda x: F.least(
            F.greatest((x - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0)
        ),
    )
    t = S.terms(T.sweep(d.withColumn("rhat_norm", unit), [T.served(CANDIDATE)]))
    return rounded(
        S.metrics(t).select(
            "capsule", "policy", "n", "ips", "snips", "dm", "dr", "dr_se", "coverage"
        )
    )


def linear(spark: SparkSession, folder: str, **options) -> DataFrame:
    d = X.featurize(rows(spark, folder), options.pop("declared", None))
    spec = options.pop("spec", PolicySpec.of())
    return cross_fit(d, spec, fold(), 5, shard=F.col("arrival") % 8, **options)


def out_of_fold(policies: str, **options) -> str:
    """Metrics over out-of-fold predictions of the hashed linear learner, to four decimals."""
    names = ["logged_mean", "dm", "ips", "snips", "dr", "lift_dr", "dr_se", "coverage", "mean_weight"]
    cells = ", ".join(f"round({n}, 4) AS {n}" for n in names)
    return ", ".join([N.cross_fitted(**options), O.terms(policies), O.METRICS]) + f" SELECT capsule, policy, n, {cells} FROM am"


def four_decimals(t: DataFrame) -> DataFrame:
    names = ["logged_mean", "dm", "ips", "snips", "dr", "lift_dr", "dr_se", "coverage", "mean_weight"]
    return rounded(S.metrics(t).select("capsule", "policy", "n", *names), 4)


#: The declared features of the candidate below: click costs nothing, view has none.
DECLARED = """SELECT action, 'cost' AS feature, CASE WHEN action = 'click' THEN 0 ELSE cost END::FLOAT AS av FROM acts WHERE action <> 'view'"""


@query("O6_policy_spec", out_of_fold(
    GREEDY.replace("'greedy'", "'spec:candidate'"), bits=16, context=False, passes=[1.0], rate=0.3, features=DECLARED))
def o6(spark, folder):
    """Greedy over a learner with other settings and declared action features."""
    spec = PolicySpec.of({"learner": {"bits": 16, "learningRate": 0.3}})
    d = linear(
        spark, folder, spec=spec, with_context=False, declared={"click": {"cost": 0.0}, "view": {}}
    )
    return four_decimals(S.terms(T.sweep(d, [T.greedy(label="spec:candidate")])))


def served_sql(scale: float, floor: float) -> str:
    """What a SquareCB spec serves, as `SERVED` with its settings."""
    return SERVED.replace("0.9 *", f"{1 - floor} *").replace("+ 0.1 / k", f"+ {floor} / k").replace("2.0 * sqrt", f"{scale} * sqrt")


@query("O8_cross_fit", out_of_fold(
    GREEDY + " UNION ALL " + served_sql(10.0, 0.05).replace("SELECT *, 'candidate", "SELECT * EXCLUDE (others, p, top, best, u), 'candidate"),
    bits=18, context=False, passes=[1.0]))
def o8(spark, folder):
    """Greedy and served policies of the learner as it learns online, out of fold."""
    d = linear(spark, folder, with_context=False)
    return four_decimals(S.terms(T.sweep(d, [T.greedy(), T.served(PolicySpec.of())])))


@query("O9a_linear_reward_model", out_of_fold(O.CONSTANTS, bits=18, context=True, passes=[1.0, 0.25, 0.0625]))
def o9a(spark, folder):
    """DM and DR of every constant policy with the hashed linear reward model."""
    return four_decimals(S.terms(T.action_constants(linear(spark, folder))))


@query("O9b_cell_reward_model", "WITH " + ", ".join([O.LOG, O.CELLS]) + """
SELECT capsule, id, action, rhat::FLOAT::DOUBLE AS rhat, n_updates::BIGINT AS n_updates FROM lr""")
def o9b(spark, folder):
    d = modelled(spark, folder)
    return d.select(
        "capsule", "id", "n_updates", "actions",
        F.inline(F.arrays_zip(F.col("eligible"), F.col("rhat"))),
    ).select(
        "capsule", "id", F.get("actions", F.col("eligible"))["id"].alias("action"),
        F.col("rhat").cast("float").cast("double").alias("rhat"), "n_updates",
    )


@query("O10_terms", O.evaluation(w_max="5.0") + """
SELECT capsule, policy, id, round(w, 6) AS w, round(wr, 6) AS wr, dm::FLOAT::DOUBLE AS dm,
  dr::FLOAT::DOUBLE AS dr, round(r, 6) AS r, round(raw_w, 6) AS raw_w, round(gap, 6) AS gap,
  round(off, 6) AS off_support, covered, clipped, falls AS falls_back FROM tt""")
def o10(spark, folder):
    t = all_terms(spark, folder, 5.0).drop("tenant", "job")
    # means of prices in cents can end exactly on a rounding boundary: compare as floats
    single = {c: F.col(c).cast("float").cast("double") for c in ("dm", "dr")}
    shown = {c: r(c) for c in ("w", "wr", "r", "raw_w", "gap", "off_support")}
    return t.withColumns({**single, **shown})


@query("O19_bootstrap_intervals")
def o19(spark, folder):
    t = all_terms(spark, folder)
    return rounded(intervals(t, resamples=200, seed=7).drop("tenant", "job"))


@query("O22_warnings", O.evaluation(w_max="5.0") + """,
w AS (
  SELECT capsule, policy, 'unverified' AS code, printf('%d unverified uploads are not part of the estimates', u) AS message
    FROM am JOIN (SELECT capsule AS c, count(*) FILTER (mode = 'unverified') AS u FROM lg GROUP BY ALL) ON c = capsule WHERE u > 0
  UNION ALL SELECT capsule, policy, 'fallback', printf('the policy follows the logged one in %d of %d rows', fallback_rows, n) FROM am WHERE fallback_rate > 0.05
  UNION ALL SELECT capsule, policy, 'clipping', printf('%d weights were clipped, the largest was %.4f', clipped_rows, max_weight) FROM am WHERE clipped_rows > 0
  UNION ALL SELECT capsule, policy, 'low_ess', printf('the weights are worth %.1f rows', ess) FROM am WHERE ess < 100
  UNION ALL SELECT capsule, policy, 'propensities', printf('the mean weight %.4f is %.1f standard errors off: check the logged pmf', mean_weight, weight_z) FROM am WHERE n >= 100 AND abs(weight_z) > 4
  UNION ALL SELECT am.capsule, policy, 'reward_range', printf('%d rewards lie outside the given range', o)
    FROM am JOIN (SELECT capsule, count(*) FILTER (reward > 100) AS o FROM er GROUP BY ALL) x ON x.capsule = am.capsule WHERE o > 0)
SELECT * FROM w""")
def o22(spark, folder):
    m = S.warnings(
        all_metrics(spark, folder, 5.0), data_summary(logged(spark, folder), (0.0, 100.0))
    )
    return m.select("capsule", "policy", F.inline("warnings"))


CHECKS = [
    "lift.dr.lower >= -5", "ess >= 200", "coverage >= 0.2", "n >= 1000",
    "dr.lower >= logged.mean - 4.5", "ips.estimate > snips.estimate + 2", "max_weight < 6.7",
    "clip_rate == 0",
]
GATES = """
g AS (
  SELECT capsule, policy, 0 AS gate, 'lift.dr.lower >= -5' AS "check", lift_dr - 1.959963984540054 * lift_dr_se AS "left", -5.0::DOUBLE AS "right", lift_dr - 1.959963984540054 * lift_dr_se >= -5 AS pass FROM am
  UNION ALL SELECT capsule, policy, 1, 'ess >= 200', ess, 200, ess >= 200 FROM am
  UNION ALL SELECT capsule, policy, 2, 'coverage >= 0.2', coverage, 0.2, coverage >= 0.2::DOUBLE FROM am
  UNION ALL SELECT capsule, policy, 3, 'n >= 1000', n, 1000, n >= 1000 FROM am
  UNION ALL SELECT capsule, policy, 4, 'dr.lower >= logged.mean - 4.5', dr - 1.959963984540054 * dr_se, logged_mean - 4.5, dr - 1.959963984540054 * dr_se >= logged_mean - 4.5 FROM am
  UNION ALL SELECT capsule, policy, 5, 'ips.estimate > snips.estimate + 2', ips, snips + 2, ips > snips + 2 FROM am
  UNION ALL SELECT capsule, policy, 6, 'max_weight < 6.7', max_weight, 6.7, max_weight < 6.7::DOUBLE FROM am
  UNION ALL SELECT capsule, policy, 7, 'clip_rate == 0', clip_rate, 0, clip_rate = 0 FROM am)
"""


@query("O23_gate_check", O.evaluation() + "," + GATES + """
SELECT capsule, policy, gate, "check", round("left", 6) AS "left", round("right", 6) AS "right", pass FROM g""")
def o23(spark, folder):
    return rounded(G.check_gates(all_metrics(spark, folder), CHECKS).drop("tenant", "job"))


@query("O24_gate_list", O.evaluation() + """
SELECT capsule, policy, 0 AS gate, 'lift.dr.lower >= 0.01' AS "check",
  lift_dr - 1.959963984540054 * lift_dr_se >= 0.01 AS pass FROM am
UNION ALL SELECT capsule, policy, 1, 'ess >= 200', ess >= 200 FROM am""")
def o24(spark, folder):
    document = "gates:\n  - lift.dr.lower >= 0.01  # recommended\n  - 'ess >= 200'\n"
    checks = G.read_gates(document)
    return G.check_gates(all_metrics(spark, folder), checks).select(
        "capsule", "policy", "gate", "check", "pass"
    )


@query("O25_verdict", O.evaluation() + "," + GATES + """
SELECT g.capsule, g.policy, bool_and(pass) AS gates_passed, count(*) FILTER (NOT pass) AS failed,
  CASE WHEN bool_and(pass) THEN 'PASS' ELSE 'FAIL' END AS word,
  printf('logged %.4f', any_value(logged_mean)) AS shown
FROM g JOIN am ON am.capsule = g.capsule AND am.policy = g.policy GROUP BY ALL""")
def o25(spark, folder):
    v = G.verdicts(all_metrics(spark, folder), CHECKS)
    return v.select(
        "capsule", "policy", "gates_passed",
        F.size(F.filter("gates", lambda g: ~g["pass"])).cast("bigint").alias("failed"),
        F.substring("verdict", 1, 4).alias("word"),
        F.regexp_extract("verdict", r"logged [\d.]+", 0).alias("shown"),
    )


@query("O26_gated_promotion", O.evaluation() + """
SELECT capsule, policy, CASE WHEN NOT (lift_dr - 1.959963984540054 * lift_dr_se >= -1.5 AND ess >= 200)
  THEN 'promotion_refused' WHEN capsule = 'router2' THEN 'promotion_conflict'
  ELSE 'spec_promoted' END AS event, n AS rows FROM am""")
def o26(spark, folder):
    judged = G.verdicts(all_metrics(spark, folder), ["lift.dr.lower >= -1.5", "ess >= 200"])
    base = PolicySpec.of()
    _, base_hash = G.candidate(base, {"exploration": {"epsilon": 0.01}})
    candidates = judged.select(
        *KEY, "policy", F.lit('{"exploration":{"epsilon":0.01}}').alias("patch"),
        F.lit(base_hash).alias("base_sha256"),
    )
    changed = base.patched({"mode": "frozen"}).json()
    current = judged.select(*KEY).distinct().withColumn(
        "spec", F.when(F.col("capsule") == "router2", changed).otherwise(base.json())
    )
    out = G.promote(judged, candidates, current, int(NOW))
    return out.select(
        "capsule", "policy", "event",
        F.get_json_object("detail", "$.rows").cast("bigint").alias("rows"),
    )


@query("O27_time_window", "WITH " + O.LOG.replace(
    "WHERE mode <> 'unverified' AND NOT legacy AND reward IS NOT NULL)",
    f"WHERE mode <> 'unverified' AND NOT legacy AND reward IS NOT NULL AND ts_ms >= {NOW} - 604800000 AND ts_ms < {NOW})",
) + ", " + ", ".join([O.CELLS, O.terms(O.CONSTANTS), O.METRICS]) + """
SELECT capsule, policy, n, round(ips, 6) AS ips, round(snips, 6) AS snips, round(dr, 6) AS dr,
  round(dr_se, 6) AS dr_se FROM am""")
def o27(spark, folder):
    d = in_window(logged(spark, folder), int(NOW) - 604800000, int(NOW))
    m = cell_means(S.eval_rows(d), segment(), fold(), 5)
    out = S.metrics(S.terms(T.action_constants(m)))
    return rounded(out.select("capsule", "policy", "n", "ips", "snips", "dr", "dr_se"))


@query("O28_policy_sweep_docs", """
WITH d AS (SELECT lang, source, quality::DOUBLE AS r FROM documents JOIN labels USING (doc_id)),
p AS (SELECT DISTINCT source AS a FROM documents),
t AS (SELECT concat('constant:', a) AS policy, CASE WHEN source = a THEN (SELECT count(*) FROM p)::DOUBLE ELSE 0 END AS w, r
  FROM d, p),
m AS (SELECT policy, count(*) AS n, avg(r) AS logged_mean, avg(w * r) AS ips, sum(w * r) / nullif(sum(w), 0) AS snips,
  sum(w) * sum(w) / nullif(sum(w * w), 0) AS ess FROM t GROUP BY ALL)
SELECT policy, n, round(logged_mean, 6) AS logged_mean, round(ips, 6) AS ips, round(snips, 6) AS snips,
  round(coalesce(ess, 0), 6) AS ess FROM m""")
def o28_docs(spark, folder):
    d = S.eval_rows(document_decisions(spark, folder))
    m = S.metrics(S.terms(T.action_constants(d)))
    return rounded(m.select("policy", "n", "logged_mean", "ips", "snips", "ess"))


@query("S6_report")
def s6(spark, folder):
    """The whole report with bootstrap intervals, warnings, gates and verdict."""
    out = evaluate(
        logged(spark, folder), lambda d: cell_means(d, segment(), fold(), 5),
        [T.logged(), T.constant("purchase"), T.greedy()],
        EvalConfig(bootstrap=200), ["lift.dr.lower >= 0", "ess >= 200"],
    )
    return out.select("capsule", "policy", "n", "gates_passed", "verdict",
                      F.size("warnings").alias("n_warnings"))


@query("S6_pages", O.evaluation() + """
SELECT capsule, policy, concat('# ', policy, ' in acme/default/', capsule) AS title, printf('%.4g', n::DOUBLE) AS n,
  printf('%.4g', ips) AS ips FROM am""")
def s6_pages(spark, folder):
    """Every capsule and policy's report as a page and as JSON lines, written and read back."""
    path = shared_folder(spark, "pages")
    found = verdicts(warnings(all_metrics(spark, folder), data_summary(logged(spark, folder), None)), ["ess >= 200"])
    found = written(found, "verdicts")
    exports.write_pages(found, path)
    exports.write_report(found, f"{path}-json")
    lines = spark.read.schema("capsule string, policy string, n bigint").json(f"{path}-json").select("capsule", "policy", F.col("n").alias("lines"))
    page = exports.read_pages(spark, path)
    return page.join(lines, ["capsule", "policy"]).select(
        "capsule", "policy", F.regexp_extract("value", r"^(.*)\n", 1).alias("title"),
        F.regexp_extract("value", r"\| n \| (\S+) \|", 1).alias("n"), F.regexp_extract("value", r"\| ips \| (\S+) \|", 1).alias("ips"),
    )


# --- PMF functions over synthetic predictions of every event -----------------------------

def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Each decision with predictions that depend on the event number."""
    d = event_decisions(spark, folder)
    rhat = F.transform("eligible", lambda i: ((F.col("arrival") * (i + 3)) % 97) / F.lit(97.0))
    return d.withColumn("rhat", rhat)


PREDICTIONS = """
lp AS (SELECT log.capsule, log.id, event_id, k, action, idx, fav,
    (((event_id * (idx + 3)) % 97) / 97.0::DOUBLE) AS rhat
  FROM log JOIN acts ON NOT (seg = 3 AND action = 'signup')),
lb AS (SELECT *, max(rhat) OVER w AS top, idx = first_value(idx) OVER (PARTITION BY id, capsule
    ORDER BY rhat DESC, idx) AS best FROM lp WINDOW w AS (PARTITION BY id, capsule))"""


def pmf_rows(d: DataFrame, pmf) -> DataFrame:
    return d.select(
        "capsule", "id", "actions",
        F.inline(F.arrays_zip(F.col("eligible").alias("index"), pmf.alias("p"))),
    ).select(
        "capsule", "id", F.get("actions", F.col("index"))["id"].alias("action"),
        r("p", 9).alias("p"),
    )


@query("F8_argmax", LOG + f""", {PREDICTIONS}
SELECT capsule, id, action FROM lb WHERE best""")
def f8(spark, folder):
    d = predictions(spark, folder)
    return d.select(
        "capsule", "id",
        F.get("actions", F.get("eligible", P.argmax(F.col("rhat"))))["id"].alias("action"),
    )


SQUARE = """
sq AS (SELECT *, CASE WHEN best THEN 0 ELSE 1.0::DOUBLE / (k + 10.0 * sqrt(event_id) * (top - rhat)) END AS q
  FROM lb),
sp AS (SELECT *, CASE WHEN best THEN 1 - sum(q) OVER (PARTITION BY capsule, id) ELSE q END AS p FROM sq)"""


@query("F9_squarecb_pmf", LOG + f""", {PREDICTIONS}, {SQUARE}
SELECT capsule, id, action, round(p, 9) AS p FROM sp""")
def f9(spark, folder):
    d = predictions(spark, folder)
    pmf = P.squarecb(F.col("rhat"), P.gamma(10.0, 0.5, F.col("arrival")))
    return pmf_rows(d, pmf)


@query("F10_epsilon_greedy_pmf", LOG + f""", {PREDICTIONS}
SELECT capsule, id, action, round(CASE WHEN best THEN 1 - 0.2 + 0.2::DOUBLE / k ELSE 0.2::DOUBLE / k END, 9)
  AS p FROM lb""")
def f10(spark, folder):
    d = predictions(spark, folder)
    return pmf_rows(d, P.epsilon_greedy(F.col("rhat"), 0.2))


@query("F11_floor_mix", LOG + f""", {PREDICTIONS}, {SQUARE}
SELECT capsule, id, action, round(0.9::DOUBLE * p + 0.1::DOUBLE / k, 9) AS p FROM sp""")
def f11(spark, folder):
    d = predictions(spark, folder)
    base = P.squarecb(F.col("rhat"), P.gamma(10.0, 0.5, F.col("arrival")))
    return pmf_rows(d, P.let(base, lambda p: P.floor_mix(p, 0.1)))


@query("F12_baseline_explore_pmf", LOG + f""", {PREDICTIONS}
SELECT capsule, id, action, round(CASE WHEN action = fav THEN 1 - 0.1::DOUBLE / k * (k - 1)
  ELSE 0.1::DOUBLE / k END, 9) AS p FROM lb""")
def f12(spark, folder):
    d = predictions(spark, folder)
    seg = F.get_json_object("context", "$.seg")
    fav = F.element_at(
        F.create_map(*[F.lit(x) for p in (("s0", 0), ("s1", 1), ("s2", 2), ("s3", 4)) for x in p]),
        seg,
    )
    d = d.withColumn("fav", fav)
    at = F.array_position("eligible", F.col("fav")).cast("int") - 1
    return pmf_rows(d, P.baseline_explore(F.size("eligible"), at, 0.1))


SPLIT = O.splitmix("s")


@query("F13_sample_action", LOG + ", u AS (" + O.chain(
    "(SELECT id, event_id::UHUGEINT AS s FROM logp WHERE NOT legacy)",
    "id, (z3 // 2048)::DOUBLE / 9007199254740992::DOUBLE AS u", SPLIT) + """),
c AS (SELECT logp.capsule, logp.id, action, idx, u,
    sum(CASE WHEN action = fav THEN 0.4::DOUBLE ELSE 0.6::DOUBLE / (k - 1) END)
      OVER (PARTITION BY logp.id ORDER BY idx) AS cum
  FROM logp JOIN acts ON NOT (seg = 3 AND action = 'signup') JOIN u ON u.id = logp.id
  WHERE NOT legacy)
SELECT capsule, id, any_value(round(u, 9)) AS u,
  coalesce(arg_min(action, idx) FILTER (u < cum), arg_max(action, idx)) AS action
FROM c GROUP BY ALL""")
def f13(spark, folder):
    d = event_decisions(spark, folder).filter(F.col("pmf").isNotNull())
    d = d.withColumn("u", X.uniform_of_seed(F.col("seed")))
    picked_at = P.draw(F.col("pmf"), F.col("u"))
    return d.select(
        "capsule", "id", r("u", 9).alias("u"),
        F.get("actions", F.get("eligible", picked_at))["id"].alias("action"),
    )


@query("F14_seed_stream", "WITH e AS (SELECT event_id, xor(42::UHUGEINT, (event_id::UHUGEINT * "
       f"11400714819323198485::UHUGEINT) % {O.TWO64}) AS s FROM events) "
       + O.chain("e", f"event_id, {O.signed('z3')} AS seed", SPLIT))
def f14(spark, folder):
    from policylens.plans.sample_log import table

    return table(spark, folder, "events").select(
        "event_id", X.stream_seed(42, F.col("event_id")).alias("seed")
    )


@query("F6_derived_and_rules", LOG + """
SELECT capsule, id, CASE WHEN hour >= 12 THEN concat('{"late":true,"double":', hour * 2, '}')
  ELSE concat('{"double":', hour * 2, '}') END AS derived,
  array_to_string(list_sort(list_filter([0, 1, 2, 3, 4], lambda i:
    (CASE WHEN hour % 5 = 0 THEN i IN (0, 2) ELSE true END)
    AND NOT (i = 0 AND hour % 2 = 1) AND NOT (i = 4 AND seg = 2))), ',') AS eligible
FROM log""")
def f6(spark, folder):
    d = event_decisions(spark, folder)
    hour = F.get_json_object("context", "$.hour").cast("int")
    seg = F.get_json_object("context", "$.seg")
    d = X.with_derived(
        d, {"late": F.when(hour >= 12, F.lit(True)), "double": hour * 2}
    )
    d = X.only(X.only(d, "click", hour % 5 == 0), "purchase", hour % 5 == 0)
    d = X.exclude(X.exclude(d, "click", hour % 2 == 1), "view", seg == "s2")
    return X.restrict(d).select(
        "capsule", "id", "derived",
        F.array_join(F.col("eligible").cast("array<string>"), ",").alias("eligible"),
    )


@query("F7_eligible_set", LOG + """
SELECT capsule, id, array_to_string(list_filter([0, 1, 2, 3, 4], lambda i:
  (event_id % 3 <> 0 OR i IN (idx, 1)) AND i <> event_id % 6), ',') AS eligible,
  event_id % 6 = 5 AS unknown
FROM log JOIN acts ON action = chosen_id""")
def f7(spark, folder):
    d = event_decisions(spark, folder)
    ids = F.transform("actions", lambda a: a["id"])
    names = F.concat(ids, F.array(F.lit("nobody")))
    banned = F.array(F.get(names, (F.col("arrival") % 6).cast("int")))
    allowed = F.when(F.col("arrival") % 3 == 0, F.array(F.col("chosen_id"), F.lit("error")))
    eligible = P.eligible_positions(ids, allowed, banned)
    return d.select(
        "capsule", "id", F.array_join(eligible.cast("array<string>"), ",").alias("eligible"),
        (F.size(P.unknown_ids(ids, banned)) > 0).alias("unknown"),
    )

