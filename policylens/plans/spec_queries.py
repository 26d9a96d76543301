"""One job over capsules with different specs, which come from the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylens.functions import features as X
from policylens.operators import estimators as S
from policylens.operators import ingest as I
from policylens.operators import learner as L
from policylens.operators import policies as T
from policylens.operators import specs as P
from policylens.operators.retention import spec_history
from policylens.plans import nag_sql as N
from policylens.plans import oracle as O
from policylens.plans.eval_queries import linear
from policylens.plans.learn_queries import BITS, SPEC, learning_rows
from policylens.plans.log_queries import LOG, NOW
from policylens.plans.registry import query, r
from policylens.plans.sample_log import event_decisions as all_decisions
from policylens.plans.sample_log import event_rewards, table
from policylens.schema import KEY
from policylens.session import checkpointed


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """An audit row per event, most of them with a patch of the capsule's spec.

    Each capsule is given another mix: importance weights and epsilon-greedy, another rate and exploration, a default
    reward.  Patches of uploads take no effect, as these are no spec events.
    """
    e = table(spark, folder, "events").withColumn("c", F.col("user_id") % 3)
    number = F.round(F.col("value") / 1000, 6)
    kind = F.col("event_type")
    patch = (
        F.when(kind == "view", F.format_string('{"learner":{"bits":%s},"reward":{"range":[0,500]}}', F.lit(BITS)))
        .when((kind == "click") & (F.col("c") == 0), F.format_string('{"exploration":{"kind":"epsilonGreedy","epsilon":%s}}', number))
        .when((kind == "signup") & (F.col("c") == 0), F.lit('{"learner":{"importance":"mtr","maxImportanceWeight":4}}'))
        .when((kind == "purchase") & (F.col("c") == 1), F.format_string('{"exploration":{"gammaScale":%s,"floor":0.2},"learner":{"learningRate":0.25}}', number * 100))
        .when((kind == "click") & (F.col("c") == 2), F.format_string('{"reward":{"default":%s,"waitSeconds":3600},"rewards":"sum"}', number))
        .when(kind == "error", F.lit('{"mode":"frozen"}'))
    )
    event = F.when(kind == "error", "upload_rejected").when(kind == "view", "capsule_created").when(kind == "click", "spec_changed").otherwise("spec_promoted")
    return e.select(
        F.lit("acme").alias("tenant"), F.lit("default").alias("job"), F.concat(F.lit("router"), F.col("c")).alias("capsule"),
        F.col("event_id").alias("seq"), event.alias("event"),
        F.when(patch.isNotNull(), F.concat(F.lit('{"patch":'), patch, F.lit("}"))).otherwise("{}").alias("detail"),
    )


def specs(spark: SparkSession, folder: str) -> DataFrame:
    return checkpointed(spec_history(audit(spark, folder)))


#: st: the settings in force, from the last patch that names them.
SETTINGS = """
st AS MATERIALIZED (
  SELECT cap AS capsule, any_value(user_id % 3) AS c,
    CASE WHEN any_value(user_id % 3) = 0 THEN arg_max(round(value / 1000, 6), event_id) FILTER (event_type = 'click') ELSE 0.05 END::DOUBLE AS eps,
    CASE WHEN any_value(user_id % 3) = 1 THEN arg_max(round(value / 1000, 6) * 100, event_id) FILTER (event_type = 'purchase') ELSE 10 END::DOUBLE AS scale,
    CASE WHEN any_value(user_id % 3) = 2 THEN arg_max(round(value / 1000, 6), event_id) FILTER (event_type = 'click') END::DOUBLE AS default_value
  FROM ev GROUP BY cap)"""

#: The reward log with each capsule's weight and rate.
OWN = {
    "h": "CASE WHEN rw.capsule = 'router0' THEN least(1 / coalesce(probability, 1), 4) ELSE 1 END",
    "rate": "CASE WHEN rw.capsule = 'router1' THEN 0.25 ELSE 0.5 END",
}

#: pm: the PMF of every decision under its capsule's settings, from preds(capsule, id, action, idx, k, n, u).
PMF = """
pm AS (
  SELECT *, (1 - f) * CASE WHEN best THEN 1 - others ELSE p END + f / k AS pi
  FROM (SELECT *, sum(CASE WHEN best THEN 0 ELSE p END) OVER w AS others
    FROM (SELECT *, CASE WHEN greedy THEN eps / k ELSE 1.0 / (k + scale * sqrt(n) * (top - u)) END AS p
      FROM (SELECT preds.*, eps, scale, greedy, f, max(u) OVER d AS top, idx = first_value(idx) OVER (d ORDER BY u DESC, idx) AS best
        FROM preds JOIN own ON own.capsule = preds.capsule WINDOW d AS (PARTITION BY preds.capsule, id))) WINDOW w AS (PARTITION BY capsule, id)))"""


def decided(own: str) -> str:
    """Decisions of the whole log by the models of model(...) under the settings of `own`."""
    return f"""
weights AS MATERIALIZED (
  SELECT capsule, n, list_transform(list_zip(u, s), lambda p: CASE WHEN p[2] > 0 THEN p[1]::DOUBLE / p[2]::DOUBLE ELSE 0 END) AS w FROM model),
own AS ({own}),
preds AS (
  SELECT logp.capsule, logp.id, event_id, acts.action, acts.idx, k, n,
    least(greatest(list_sum(list_transform(list_zip(w, x), lambda p: p[1] * p[2])), 0), 1) AS u
  FROM logp JOIN acts ON NOT (seg = 3 AND acts.action = 'signup') JOIN weights ON weights.capsule = logp.capsule
  JOIN dense ON dense.hour = logp.hour AND dense.seg = logp.seg AND dense.action = acts.action), {PMF},
un AS ({O.chain("(SELECT id, event_id::UHUGEINT AS s FROM logp)", "id, (z3 // 2048)::DOUBLE / 9007199254740992::DOUBLE AS uni", O.splitmix("s"))}),
cum AS (SELECT pm.*, uni, sum(pi) OVER (PARTITION BY pm.capsule, pm.id ORDER BY idx) AS cum FROM pm JOIN un ON un.id = pm.id),
picked AS (
  SELECT capsule, id, any_value(n) AS model_version, coalesce(arg_min(action, idx) FILTER (uni < cum), arg_max(action, idx)) AS chosen_id
  FROM cum GROUP BY ALL)
SELECT picked.capsule, picked.id, chosen_id, round(pi, 4) AS probability, model_version
FROM picked JOIN pm ON pm.capsule = picked.capsule AND pm.id = picked.id AND pm.action = chosen_id"""


@query("L2_fold_by_spec", N.models(BITS, **OWN) + """
SELECT model.capsule, n AS n_updates, round(t, 4) AS total_weight, CASE WHEN model.capsule = 'router1' THEN 0.25 ELSE 0.5 END::DOUBLE AS learning_rate,
  slot, round(slots.u::DOUBLE, 4) AS u, round(slots.a::DOUBLE, 3) AS a FROM model JOIN slots ON slots.capsule = model.capsule""")
def l2_by_spec(spark, folder):
    """Every capsule learned by the spec that its audit log leaves in force."""
    head, slots = L.fold_models(learning_rows(spark, folder), specs(spark, folder))
    weights = slots.select(*KEY, "slot", r(F.col("u").cast("double"), 4).alias("u"), r(F.col("a").cast("double"), 3).alias("a"))
    return head.join(weights, KEY).select(
        "capsule", "n_updates", r("total_weight", 4).alias("total_weight"), "learning_rate", "slot", "u", "a"
    )


def _decide(spark: SparkSession, folder: str, spec) -> DataFrame:
    header, slots = L.fold_models(learning_rows(spark, folder), spec)
    requests = X.featurize(all_decisions(spark, folder).drop("pmf", "probability", "chosen_index", "chosen_id", "mode"))
    return L.decide(requests, slots, header, spec).select(
        "capsule", "id", "chosen_id", r("probability", 4).alias("probability"), "model_version"
    )


@query("L5_decide_batch", N.models(BITS) + ", " + decided(
    "SELECT DISTINCT capsule, 0.0::DOUBLE AS eps, 10.0::DOUBLE AS scale, false AS greedy, 0.05::DOUBLE AS f FROM log"))
def l5(spark, folder):
    """Every event decided again by the model learned from the log."""
    return _decide(spark, folder, SPEC)


@query("L5_decide_by_spec", N.models(BITS, **OWN) + ", " + SETTINGS + ", " + decided(
    "SELECT capsule, eps, scale, c = 0 AS greedy, CASE WHEN c = 1 THEN 0.2 ELSE 0.05 END::DOUBLE AS f FROM st"))
def l5_by_spec(spark, folder):
    """Every capsule learned and served by its own spec."""
    return _decide(spark, folder, P.once(specs(spark, folder)))


@query("E5_default_rewards_by_spec", LOG + ", " + SETTINGS + f"""
SELECT log.capsule, id AS decision_id, {NOW} AS ts_ms, default_value AS value, round(default_value / 500, 9) AS value_norm,
  concat(id, ':default') AS idempotency_key, '{{"default":true}}' AS detail
FROM log JOIN st ON st.capsule = log.capsule WHERE default_value IS NOT NULL AND ts_ms <= {NOW} - 3600000
  AND NOT EXISTS (SELECT 1 FROM rw WHERE rw.capsule = log.capsule AND rw.decision_id = log.id)""")
def e5_by_spec(spark, folder):
    """Default rewards of the capsules whose spec has one, each with its own value, wait and mode."""
    due = I.default_rewards_by_spec(all_decisions(spark, folder), event_rewards(spark, folder), int(NOW), specs(spark, folder))
    return due.select(
        "capsule", "decision_id", "ts_ms", "value", r("value_norm", 9).alias("value_norm"), "idempotency_key", "detail"
    )


@query("O7_candidate_by_spec", ", ".join([
    N.cross_fitted(BITS, False, [1.0]).replace("1.0::DOUBLE AS h, 0.5 *", "CASE er.capsule WHEN 'router0' THEN least(1 / probability, 4) ELSE 1 END::DOUBLE AS h, CASE er.capsule WHEN 'router1' THEN 0.25 ELSE 0.5 END *"),
    SETTINGS, "own AS (SELECT capsule, eps, scale, c = 0 AS greedy, CASE WHEN c = 1 THEN 0.2 ELSE 0.05 END::DOUBLE AS f FROM st)",
    """preds AS (SELECT lr.*, n_updates AS n, (rhat - lo) / (hi - lo) AS u FROM lr JOIN lohi ON lohi.capsule = lr.capsule)""", PMF,
    O.terms("SELECT pm.*, 'own spec' AS policy, false AS falls FROM pm"), O.METRICS]) + """
SELECT capsule, n, round(ips, 4) AS ips, round(snips, 4) AS snips, round(dm, 4) AS dm, round(dr, 4) AS dr, round(dr_se, 4) AS dr_se FROM am""")
def o7_by_spec(spark, folder):
    """What every capsule's own spec would have earned, out of fold, in one evaluation."""
    spec = P.once(specs(spark, folder))
    d = P.with_settings(linear(spark, folder, spec=spec, with_context=False), spec)
    t = S.terms(T.sweep(d, [T.served_by_settings(F.col("settings"), label="own spec")]))
    out = S.metrics(t)
    return out.select("capsule", "n", *[r(c, 4).alias(c) for c in ("ips", "snips", "dm", "dr", "dr_se")])
