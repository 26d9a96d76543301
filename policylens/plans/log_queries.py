"""Queries over the event log: joins, ingest, retention, reports and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylens.functions import features as X
from policylens.functions import values as V
from policylens.operators import ingest as I
from policylens.operators import joins as J
from policylens.operators import reports as R
from policylens.operators import retention as H
from policylens.operators import validate as C
from policylens.operators.reward_model import reward_scale
from policylens.operators.store import RefusedError, Store
from policylens.plans import oracle as O
from policylens.plans.registry import query, r, rounded
from policylens.plans.sample_log import (
    document_decisions, epoch_ms, event_decisions, event_rewards, table,
)
from policylens.schema import KEY
from policylens.session import checkpointed, shared_folder

LOG = f"WITH {O.LOG} "
ROUTER1 = ("acme", "default", "router1")
NOW = "1705708800000"  # 2024-01-20T00:00:00Z in milliseconds


def logged(spark: SparkSession, folder: str, mode: str = "first") -> DataFrame:
    return J.logged_rows(event_decisions(spark, folder), event_rewards(spark, folder), mode)


def event_audit(spark: SparkSession, folder: str) -> DataFrame:
    """An audit row per event."""
    e = table(spark, folder, "events")
    return e.select(
        F.lit("acme").alias("tenant"), F.lit("default").alias("job"),
        F.concat(F.lit("router"), F.col("user_id") % 3).alias("capsule"),
        F.col("event_id").alias("seq"), epoch_ms(F.col("ts")).alias("ts_ms"),
        F.when(F.col("event_type") == "purchase", "upload_accepted")
        .when(F.col("event_type") == "error", "upload_rejected")
        .otherwise(F.col("event_type")).alias("event"),
        F.col("props").alias("detail"),
    )


def model_headers(spark: SparkSession, folder: str) -> DataFrame:
    """A model per capsule and day of the month, its watermark the day's last event."""
    e = table(spark, folder, "events")
    return e.groupBy(
        F.lit("acme").alias("tenant"), F.lit("default").alias("job"),
        F.concat(F.lit("router"), F.col("user_id") % 3).alias("capsule"),
        F.day("ts").cast("bigint").alias("version"),
    ).agg((F.max("event_id") * 2).alias("reward_seq"), F.count(F.lit(1)).alias("n_updates"))


MODELS = """models AS (SELECT 'acme' AS tenant, 'default' AS job, cap AS capsule,
  day(ts)::BIGINT AS version, 2 * max(event_id) AS reward_seq, count(*) AS n_updates
  FROM ev GROUP BY ALL)"""


# --- joins -------------------------------------------------------------------------------

@query("J1_logged_rows_first", LOG + """
SELECT capsule, id, round(reward, 6) AS reward, round(reward_norm, 9) AS reward_norm, reward_count
FROM lg""")
def j1_first(spark, folder):
    return logged(spark, folder).select(
        "capsule", "id", r("reward").alias("reward"), r("reward_norm", 9).alias("reward_norm"),
        "reward_count",
    )


@query("J1_logged_rows_sum", LOG + """
SELECT capsule, id, round(reward_sum, 6) AS reward, round(norm_sum, 9) AS reward_norm, reward_count
FROM lg""")
def j1_sum(spark, folder):
    return logged(spark, folder, "sum").select(
        "capsule", "id", r("reward").alias("reward"), r("reward_norm", 9).alias("reward_norm"),
        "reward_count",
    )


@query("J2_rewards_since", LOG + f""", {MODELS},
mark AS (SELECT capsule, arg_max(reward_seq, version) AS m FROM models WHERE version <= 15
  GROUP BY ALL)
SELECT rw.capsule, rw.seq, rw.decision_id AS id, round(rw.value, 6) AS value, logp.chosen_id,
  logp.ts_ms AS decision_ts_ms
FROM rw JOIN mark ON mark.capsule = rw.capsule AND rw.seq > mark.m
JOIN logp ON logp.capsule = rw.capsule AND logp.id = rw.decision_id""")
def j2(spark, folder):
    marks = H.latest_models(model_headers(spark, folder).filter("version <= 15"))
    rewards = event_rewards(spark, folder).join(
        marks.select(*KEY, F.col("reward_seq").alias("mark")), KEY
    )
    late = J.rewards_since(rewards, event_decisions(spark, folder), F.col("mark"))
    return late.select(
        "capsule", "seq", "id", r("value").alias("value"), "chosen_id", "decision_ts_ms"
    )


@query("J3_unrewarded_decisions", LOG + f"""
SELECT capsule, id, ts_ms FROM logp WHERE ts_ms <= {NOW}
  AND NOT EXISTS (SELECT 1 FROM rw WHERE rw.capsule = logp.capsule AND rw.decision_id = logp.id)""")
def j3(spark, folder):
    d, w = event_decisions(spark, folder), event_rewards(spark, folder)
    return J.unrewarded(d, w, int(NOW)).select("capsule", "id", "ts_ms")


@query("J4_known_rewards", LOG + """
SELECT rw.capsule, logp.id IS NOT NULL AS known, count(*) AS n
FROM rw LEFT JOIN logp ON logp.capsule = rw.capsule AND logp.id = rw.decision_id GROUP BY ALL""")
def j4(spark, folder):
    d, w = event_decisions(spark, folder), event_rewards(spark, folder)
    both = J.known_rewards(w, d).withColumn("known", F.lit(True)).unionByName(
        J.known_rewards(w, d, known=False).withColumn("known", F.lit(False))
    )
    return both.groupBy("capsule", "known").agg(F.count(F.lit(1)).alias("n"))


@query("J5_rewards_of_decision", LOG + """
SELECT capsule, decision_id, seq, round(value, 6) AS value, idempotency_key FROM rw
WHERE decision_id = 'dec_7' AND capsule = (SELECT cap FROM ev WHERE event_id = 7)""")
def j5(spark, folder):
    user = table(spark, folder, "events").filter("event_id = 7").first()["user_id"]
    out = J.rewards_of(
        event_rewards(spark, folder), ("acme", "default", f"router{user % 3}"), "dec_7"
    )
    return out.select("capsule", "decision_id", "seq", r("value").alias("value"), "idempotency_key")


@query("J6_cascade_to_rewards", LOG + f"""
SELECT rw.capsule, count(*) AS n, round(sum(rw.value), 4) AS total
FROM rw JOIN logp ON logp.capsule = rw.capsule AND logp.id = rw.decision_id
WHERE logp.ts_ms < {NOW} GROUP BY ALL""")
def j6(spark, folder):
    gone = event_decisions(spark, folder).filter(F.col("ts_ms") < int(NOW))
    removed = J.known_rewards(event_rewards(spark, folder), gone)
    return removed.groupBy("capsule").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total")
    )


@query("J7_decision_to_model", LOG + """,
tags AS (SELECT DISTINCT capsule, model_version FROM logp WHERE model_version % 3 <> 0)
SELECT logp.capsule, tags.model_version AS published, count(*) AS n
FROM logp LEFT JOIN tags ON tags.capsule = logp.capsule AND tags.model_version = logp.model_version
GROUP BY ALL""")
def j7(spark, folder):
    d = event_decisions(spark, folder).withColumn(
        "model_tag", F.concat(F.lit("m"), F.col("model_version"))
    )
    models = (
        d.filter(F.col("model_version") % 3 != 0)
        .select(*KEY, "model_tag", F.col("model_version").alias("published"))
        .distinct()
    )
    return J.with_model(d, models).groupBy("capsule", "published").agg(F.count(F.lit(1)).alias("n"))


# --- validation --------------------------------------------------------------------------

def faulty(spark, folder):
    """The event log with one kind of fault in every 29th row, kind by kind."""
    k = F.col("arrival") % 29
    d = logged(spark, folder)
    return d.select(
        *[c for c in d.columns if c not in ("id", "actions", "eligible", "pmf", "chosen_index",
                                            "probability", "reward")],
        F.when(k == 1, "").otherwise(F.col("id")).alias("id"),
        F.when(k == 2, F.slice("actions", 1, 0))
        .when(k == 3, F.concat(F.col("actions"), F.slice("actions", 1, 1)))
        .otherwise(F.col("actions")).alias("actions"),
        F.when(k == 4, F.slice("eligible", 1, 0))
        .when(k == 5, F.concat(F.col("eligible"), F.array(F.lit(9))))
        .when(k == 6, F.concat(F.col("eligible"), F.slice("eligible", 1, 1)))
        .otherwise(F.col("eligible")).alias("eligible"),
        F.when(k == 7, F.transform("pmf", lambda p: p * 1.01)).otherwise(F.col("pmf")).alias("pmf"),
        F.when(k == 8, F.lit(7)).otherwise(F.col("chosen_index")).alias("chosen_index"),
        F.when(k == 9, 0.0).when(k == 10, F.col("probability") + 1e-6)
        .otherwise(F.col("probability")).alias("probability"),
        F.when(k == 11, float("nan")).otherwise(F.col("reward")).alias("reward"),
    )


@query("V1_validate_logged", LOG + """
SELECT capsule, CASE WHEN legacy THEN 'legacy' ELSE CASE event_id % 29
  WHEN 1 THEN 'id_empty' WHEN 2 THEN 'actions_empty' WHEN 3 THEN 'actions_invalid'
  WHEN 4 THEN 'eligible_empty' WHEN 5 THEN 'eligible_out_of_range' WHEN 6 THEN 'eligible_repeated'
  WHEN 7 THEN 'pmf_invalid' WHEN 8 THEN 'chosen_out_of_range' WHEN 9 THEN 'probability_range'
  WHEN 10 THEN 'probability_mismatch' WHEN 11 THEN 'reward_not_finite' END END AS problem,
  count(*) AS n FROM lg GROUP BY ALL""")
def v1(spark, folder):
    return C.validate_logged(faulty(spark, folder)).groupBy("capsule", "problem").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("V2_action_list_limits", """
WITH w AS (SELECT lang, string_split(text, ' ') AS ids FROM documents)
SELECT lang, len(ids) <= 1024 AND len(list_distinct(ids)) = len(ids)
  AND len(list_filter(ids, lambda i: length(i) < 1 OR length(i) > 256)) = 0 AS ok, count(*) AS n
FROM w GROUP BY ALL""")
def v2(spark, folder):
    docs = table(spark, folder, "documents")
    actions = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("id")))
    return docs.select("lang", C.action_list_ok(actions).alias("ok")).groupBy("lang", "ok").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("V3_id_rules", """
WITH v AS (SELECT url AS v FROM pages UNION ALL SELECT source FROM documents
  UNION ALL SELECT text FROM documents UNION ALL SELECT event_type FROM events)
SELECT regexp_full_match(v, '[A-Za-z0-9_.:-]{1,128}') AS event_id_ok,
  length(v) BETWEEN 1 AND 128 AND NOT contains(v, '/') AND NOT contains(v, '\\')
    AND v NOT IN ('.', '..') AS key_part_ok,
  length(v) BETWEEN 1 AND 256 AS id_ok, count(*) AS n FROM v GROUP BY ALL""")
def v3(spark, folder):
    docs = table(spark, folder, "documents")
    v = (
        table(spark, folder, "pages").select(F.col("url").alias("v"))
        .union(docs.select("source")).union(docs.select("text"))
        .union(table(spark, folder, "events").select("event_type"))
    )
    c = F.col("v")
    return v.select(
        C.event_id_ok(c).alias("event_id_ok"), C.key_part_ok(c).alias("key_part_ok"),
        C.id_ok(c).alias("id_ok"),
    ).groupBy("event_id_ok", "key_part_ok", "id_ok").agg(F.count(F.lit(1)).alias("n"))


@query("V4_record_checks", LOG + """
SELECT 'reward' AS record, capsule, CASE event_id % 23 WHEN 1 THEN 'decision_id_invalid'
  WHEN 2 THEN 'idempotency_key_invalid' WHEN 3 THEN 'value_not_finite'
  WHEN 4 THEN 'value_norm_not_finite' WHEN 5 THEN 'detail_not_json' END AS problem, count(*) AS n
FROM rw GROUP BY ALL
UNION ALL
SELECT 'decision', capsule, CASE event_id % 23 WHEN 1 THEN 'id_invalid' WHEN 2 THEN 'mode_empty'
  WHEN 3 THEN 'context_not_json' WHEN 4 THEN 'derived_not_json' WHEN 5 THEN 'chosen_id_empty'
  WHEN 6 THEN 'probability_range' END, count(*) FROM log GROUP BY ALL""")
def v4(spark, folder):
    k = F.floor(F.col("seq") / 2) % 23
    w = event_rewards(spark, folder).withColumns(
        {
            "decision_id": F.when(k == 1, "").otherwise(F.col("decision_id")),
            "idempotency_key": F.when(k == 2, F.repeat(F.lit("x"), 257)).otherwise(
                F.col("idempotency_key")
            ),
            "value": F.when(k == 3, float("inf")).otherwise(F.col("value")),
            "value_norm": F.when(k == 4, float("nan")).otherwise(F.col("value_norm")),
            "detail": F.when(k == 5, '{"k":').otherwise(F.col("detail")),
        }
    )
    k = F.col("arrival") % 23
    d = event_decisions(spark, folder).withColumns(
        {
            "id": F.when(k == 1, F.concat(F.col("id"), F.char(F.lit(0)))).otherwise(F.col("id")),
            "mode": F.when(k == 2, "").otherwise(F.col("mode")),
            "context": F.when(k == 3, "{'a'").otherwise(F.col("context")),
            "derived": F.when(k == 4, "").otherwise(F.col("derived")),
            "chosen_id": F.when(k == 5, "").otherwise(F.col("chosen_id")),
            "probability": F.when(k == 6, 1.5).otherwise(F.col("probability")),
        }
    )
    def count(df, record):
        return df.groupBy(F.lit(record).alias("record"), "capsule", "problem").agg(
            F.count(F.lit(1)).alias("n")
        )

    return count(C.validate_rewards(w), "reward").unionByName(
        count(C.validate_decisions(d), "decision")
    )


@query("V5_upload_window", LOG + f"""
SELECT capsule, ts_ms BETWEEN {NOW} - 7 * 24 * 3600 * 1000::BIGINT AND {NOW} + 300000 AS on_time,
  count(*) AS n FROM log GROUP BY ALL""")
def v5(spark, folder):
    d = C.upload_window(event_decisions(spark, folder), int(NOW))
    return d.groupBy("capsule", "on_time").agg(F.count(F.lit(1)).alias("n"))


@query("V6_log_health", LOG + """,
doubled AS (SELECT id, capsule FROM log UNION ALL SELECT id, capsule FROM log WHERE event_id % 20 = 0),
dup AS (SELECT id FROM doubled GROUP BY capsule, id HAVING count(*) > 1),
orphan AS (SELECT decision_id AS id FROM rw WHERE NOT EXISTS (
  SELECT 1 FROM log WHERE log.capsule = rw.capsule AND log.id = rw.decision_id)),
pmf AS (SELECT id FROM log WHERE event_id % 31 = 1 AND NOT legacy),
wrong AS (SELECT id FROM log WHERE event_id % 37 = 1),
norm AS (SELECT decision_id AS id FROM rw WHERE event_id % 41 = 1)
SELECT 'error' AS severity, 'duplicate_id' AS code, count(*) AS n, min(id) AS first_id,
  max(id) AS last_id FROM dup
UNION ALL SELECT 'error', 'orphan_reward', count(*), min(id), max(id) FROM orphan
UNION ALL SELECT 'error', 'bad_pmf', count(*), min(id), max(id) FROM (
  SELECT id FROM pmf UNION ALL SELECT id FROM pmf WHERE substr(id, 5)::BIGINT % 20 = 0)
UNION ALL SELECT 'error', 'chosen_id_mismatch', count(*), min(id), max(id) FROM (
  SELECT id FROM wrong UNION ALL SELECT id FROM wrong WHERE substr(id, 5)::BIGINT % 20 = 0)
UNION ALL SELECT 'warn', 'value_norm_mismatch', count(*), min(id), max(id) FROM norm""")
def v6(spark, folder):
    n = F.col("arrival")
    d = event_decisions(spark, folder).withColumns(
        {
            "pmf": F.when(n % 31 == 1, F.transform("pmf", lambda p: p / 2)).otherwise(F.col("pmf")),
            "chosen_id": F.when(n % 37 == 1, "nobody").otherwise(F.col("chosen_id")),
        }
    )
    d = d.unionByName(d.filter(n % 20 == 0))
    wrong = F.floor(F.col("seq") / 2) % 41 == 1
    w = event_rewards(spark, folder).withColumn(
        "value_norm", F.col("value_norm") + F.when(wrong, 0.5).otherwise(0.0)
    )
    return C.health(d, w, 0.0, 500.0)


@query("P1_has_propensity", LOG + """
SELECT capsule, NOT legacy AS weighted, count(*) AS n FROM log GROUP BY ALL""")
def p1(spark, folder):
    from policylens.operators.estimators import has_propensity

    d = event_decisions(spark, folder)
    return d.groupBy("capsule", has_propensity().alias("weighted")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("P2_verified_only", LOG + """
SELECT capsule, count(*) FILTER (mode <> 'unverified') AS kept,
  count(*) FILTER (mode = 'unverified') AS dropped FROM log GROUP BY ALL""")
def p2(spark, folder):
    from policylens.operators.estimators import verified

    return event_decisions(spark, folder).groupBy("capsule").agg(
        F.count_if(verified()).alias("kept"), F.count_if(~verified()).alias("dropped")
    )


@query("P3_reward_scale", LOG + """,
s AS (SELECT capsule, min(reward) AS lo, max(reward) AS hi FROM lg WHERE reward IS NOT NULL
  GROUP BY ALL)
SELECT lg.capsule, id, round((reward - lo) / (hi - lo), 6) AS unit,
  round(lo + (reward - lo) / (hi - lo) * (hi - lo), 6) AS back, reward > 400 AS outside
FROM lg JOIN s ON s.capsule = lg.capsule WHERE reward IS NOT NULL""")
def p3(spark, folder):
    from policylens.operators.learner import normalized

    d = reward_scale(logged(spark, folder).filter(F.col("reward").isNotNull()))
    unit = normalized(F.col("reward"), F.col("lo"), F.col("hi"))
    return d.select(
        "capsule", "id", r(unit).alias("unit"),
        r(F.col("lo") + unit * (F.col("hi") - F.col("lo"))).alias("back"),
        (F.col("reward") > 400).alias("outside"),
    )


@query("P4_fold_of", "WITH " + O.LOG + ", d AS (SELECT DISTINCT id FROM log) "
       + O.chain(f"(SELECT id, {O.fnv(O.text_bytes('id'))} AS h FROM d)",
                 "id, (m3 % 5)::INT AS fold", O.mix("h")))
def p4(spark, folder):
    return event_decisions(spark, folder).select("id", X.fold_of(F.col("id"), 5).alias("fold"))


@query("P5_point_lookup", LOG + """
SELECT capsule, id, ts_ms, chosen_id FROM log WHERE capsule = 'router1'
  AND event_id = (SELECT min(event_id) FROM log WHERE capsule = 'router1')""")
def p5(spark, folder):
    """The first decision of a capsule, by its id."""
    d = event_decisions(spark, folder)
    first = d.filter(F.col("capsule") == "router1").agg(F.min_by("id", "arrival")).first()[0]
    return R.point_lookup(d, ROUTER1, first).select("capsule", "id", "ts_ms", "chosen_id")


@query("P6_decision_page", LOG + f"""
SELECT 'newest' AS side, * FROM (SELECT id, ts_ms FROM log
  WHERE capsule = 'router1' AND ts_ms < {NOW} ORDER BY ts_ms DESC, id DESC LIMIT 100)
UNION ALL SELECT 'oldest', * FROM (SELECT id, ts_ms FROM log
  WHERE capsule = 'router1' AND ts_ms >= {NOW} ORDER BY ts_ms, id LIMIT 100)
UNION ALL SELECT 'after', * FROM (
  SELECT id, ts_ms FROM log, (SELECT ts_ms AS t, id AS i FROM log WHERE capsule = 'router1'
    ORDER BY ts_ms, id LIMIT 1 OFFSET 49)
  WHERE capsule = 'router1' AND (ts_ms > t OR (ts_ms = t AND id > i)) ORDER BY ts_ms, id LIMIT 100)
""")
def p6(spark, folder):
    d = event_decisions(spark, folder)
    cursor = R.page(d, ROUTER1, 50).orderBy(F.col("ts_ms").desc(), F.col("id").desc()).first()["id"]
    pages = {
        "newest": R.page(d, ROUTER1, 100, newest=True, until_ms=int(NOW)),
        "oldest": R.page(d, ROUTER1, 100, since_ms=int(NOW)),
        "after": R.page(d, ROUTER1, 100, after_id=cursor),
    }
    out = None
    for side, p in pages.items():
        rows = p.select(F.lit(side).alias("side"), "id", "ts_ms")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("P7_latest_audit", LOG + """
SELECT event_id AS seq, CASE event_type WHEN 'purchase' THEN 'upload_accepted'
  WHEN 'error' THEN 'upload_rejected' ELSE event_type END AS event
FROM ev WHERE cap = 'router1' ORDER BY event_id DESC LIMIT 50""")
def p7(spark, folder):
    return R.latest_audit(event_audit(spark, folder), ROUTER1, 50).select("seq", "event")


# --- aggregations ------------------------------------------------------------------------

@query("A1_capsule_stats", LOG + """
SELECT d.capsule, decisions, first_decision_ms, last_decision_ms, rewards, last_reward_seq
FROM (SELECT capsule, count(*) AS decisions, min(ts_ms) AS first_decision_ms,
  max(ts_ms) AS last_decision_ms FROM log GROUP BY ALL) d
FULL JOIN (SELECT capsule, count(*) AS rewards, max(seq) AS last_reward_seq FROM rw GROUP BY ALL) w
ON w.capsule = d.capsule""")
def a1(spark, folder):
    return R.capsule_stats(event_decisions(spark, folder), event_rewards(spark, folder)).select(
        "capsule", "decisions", "first_decision_ms", "last_decision_ms", "rewards",
        "last_reward_seq",
    )


@query("A2_latest_model", LOG + f""", {MODELS}
SELECT capsule, max(version) AS version, arg_max(reward_seq, version) AS reward_seq,
  arg_max(n_updates, version) AS n_updates FROM models GROUP BY ALL""")
def a2(spark, folder):
    return H.latest_models(model_headers(spark, folder)).select(
        "capsule", "version", "reward_seq", "n_updates"
    )


@query("A3_data_summary", LOG + """,
u AS (SELECT *, mode <> 'unverified' AND NOT legacy AND reward IS NOT NULL AS used FROM lg)
SELECT capsule, count(*) AS rows, count(*) FILTER (mode = 'unverified') AS rows_unverified,
  count(*) FILTER (mode <> 'unverified' AND legacy) AS rows_without_pmf,
  count(*) FILTER (mode <> 'unverified' AND NOT legacy AND reward IS NULL) AS rows_without_reward,
  count(*) FILTER (used AND reward_count > 0) AS aggregated_rewards,
  0.0::DOUBLE AS range_lo, 100.0::DOUBLE AS range_hi, 'given' AS range_source,
  count(*) FILTER (used AND reward > 100) AS rewards_outside_range
FROM u GROUP BY ALL""")
def a3(spark, folder):
    return C.data_summary(logged(spark, folder), (0.0, 100.0)).drop("tenant", "job")


@query("A4_latency_histogram", """
WITH s AS (SELECT value / 5000.0::DOUBLE AS s FROM events),
b(le) AS (SELECT unnest([0.000005, 0.00001, 0.000025, 0.00005, 0.0001, 0.00025, 0.0005, 0.001,
  0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, NULL]::DOUBLE[]))
SELECT le, count(*) FILTER (le IS NULL OR s <= le) AS cumulative, round(sum(s), 6) AS sum_seconds,
  count(*) AS count FROM s, b GROUP BY le""")
def a4(spark, folder):
    e = table(spark, folder, "events")
    return R.latency_histogram(e, F.col("value") / 5000.0).withColumn(
        "sum_seconds", r("sum_seconds")
    )


@query("A5_log_counters", LOG + """
SELECT d.capsule, decisions_committed, rewards_committed, default_rewards, uploads_accepted,
  uploads_rejected
FROM (SELECT capsule, count(*) AS decisions_committed FROM log GROUP BY ALL) d
JOIN (SELECT capsule, count(*) AS rewards_committed, count(*) FILTER (event_id % 9 = 0)
  AS default_rewards FROM rw GROUP BY ALL) w ON w.capsule = d.capsule
JOIN (SELECT cap AS capsule, count(*) FILTER (event_type = 'purchase') AS uploads_accepted,
  count(*) FILTER (event_type = 'error') AS uploads_rejected FROM ev GROUP BY ALL) a
  ON a.capsule = d.capsule""")
def a5(spark, folder):
    is_default = F.floor(F.col("seq") / 2) % 9 == 0
    w = event_rewards(spark, folder).withColumn(
        "detail", F.when(is_default, '{"default":true}').otherwise(F.col("detail"))
    )
    return R.log_counters(
        event_decisions(spark, folder), w, event_audit(spark, folder)
    ).drop("tenant", "job")


def with_means(d: DataFrame) -> DataFrame:
    """Known mean rewards: they depend on the action and the hour."""
    hour = F.get_json_object("context", "$.hour").cast("int")
    means = F.array(*[((hour * (i + 2)) % 11 + i) / F.lit(20.0) for i in range(5)])
    return d.withColumn("means", means)


MEANS = """mn AS (SELECT logp.*, ((hour * (chosen_index + 2)) % 11 + chosen_index) / 20.0::DOUBLE AS got,
  list_max(list_transform(range(5), lambda i: ((hour * (i + 2)) % 11 + i) / 20.0::DOUBLE)) AS best
  FROM logp)"""


@query("A6_regret_report", LOG + f""", {MEANS},
n AS (SELECT *, row_number() OVER (PARTITION BY capsule ORDER BY event_id) - 1 AS rank,
  count(*) OVER (PARTITION BY capsule) AS rounds FROM mn)
SELECT capsule, round(avg(best - got), 6) AS regret_per_round,
  round(sum(got) FILTER (rank >= rounds - rounds // 10)
    / sum(best) FILTER (rank >= rounds - rounds // 10), 6) AS tail_share
FROM n GROUP BY ALL""")
def a6(spark, folder):
    d = with_means(event_decisions(spark, folder))
    d = R.numbered(d.select(*KEY, "arrival", "chosen_index", "means"), KEY, "arrival")
    return rounded(R.regret_report(d, KEY, F.col("rank"), F.col("rounds")).drop("tenant", "job"))


@query("A7_outcome_breakdown", LOG + """
SELECT rw.capsule, chosen_id, count(*) AS n, round(avg(rw.value / 100), 6) AS mean_quality,
  round(sum(CASE WHEN rw.event_id % 4 <> 0 THEN rw.value / 1000 END), 6) AS total_cost_usd,
  round(avg(rw.event_id % 700), 6) AS mean_latency_ms,
  round(avg((rw.event_id % 6 = 0)::INT), 6) AS failure_rate
FROM rw JOIN logp ON logp.capsule = rw.capsule AND logp.id = rw.decision_id GROUP BY ALL""")
def a7(spark, folder):
    n = F.floor(F.col("seq") / 2)
    w = event_rewards(spark, folder).withColumn(
        "detail",
        F.to_json(
            F.struct(
                (F.col("value") / 100).alias("quality"),
                F.when(n % 4 != 0, F.col("value") / 1000).alias("costUsd"),
                (n % 700).cast("double").alias("latencyMs"),
                (n % 6 != 0).alias("ok"),
            )
        ),
    )
    d = event_decisions(spark, folder).select(*KEY, "id", "chosen_id")
    joined = J.decision_key(w.select(*KEY, "decision_id", "detail"), "id").join(d, [*KEY, "id"])
    return rounded(R.outcome_breakdown(joined).drop("tenant", "job"))


@query("A8_column_stats", """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_dev,
  round(min(value), 6) AS low, round(max(value), 6) AS high,
  round(quantile_cont(value, 0.9), 6) AS percentile FROM events GROUP BY ALL""")
def a8(spark, folder):
    return rounded(R.column_stats(table(spark, folder, "events"), ["event_type"], "value", 90.0))


@query("A9_ewma_forecast", """
SELECT event_type, round(list_reduce(list(value ORDER BY event_id),
  lambda f, v: 0.3::DOUBLE * v + 0.7::DOUBLE * f), 6) AS forecast FROM events GROUP BY ALL""")
def a9(spark, folder):
    e = table(spark, folder, "events")
    return rounded(R.ewma(e, ["event_type"], "event_id", "value", 0.3, window=1 << 10))


# --- windows -----------------------------------------------------------------------------

def repeated_batch(spark, folder):
    """The event log with every 20th decision sent twice more, later."""
    d = event_decisions(spark, folder)
    again = d.filter(F.col("arrival") % 20 == 0)
    for shift in (10**9, 2 * 10**9):
        d = d.unionByName(again.withColumn("arrival", F.col("arrival") + shift))
    return d


@query("W1_first_wins", LOG + """,
b AS (SELECT capsule, id, event_id AS arrival FROM log
  UNION ALL SELECT capsule, id, event_id + n FROM log, (VALUES (1000000000), (2000000000)) t(n)
  WHERE event_id % 20 = 0)
SELECT capsule, id, arrival, row_number() OVER (PARTITION BY capsule, id ORDER BY arrival) = 1 AS first
FROM b""")
def w1(spark, folder):
    return I.first_wins(repeated_batch(spark, folder), [*KEY, "id"]).select(
        "capsule", "id", "arrival", "first"
    )


@query("W2_newest_models", LOG + f""", {MODELS}
SELECT capsule, version, reward_seq FROM models
QUALIFY row_number() OVER (PARTITION BY capsule ORDER BY version DESC) <= 3""")
def w2(spark, folder):
    return H.keep_newest_models(model_headers(spark, folder), 3).select(
        "capsule", "version", "reward_seq"
    )


ALL_MU = """lx AS (SELECT logp.*, action, idx, CASE WHEN action = fav THEN 0.4::DOUBLE
  ELSE 0.6::DOUBLE / (k - 1) END AS mu FROM logp JOIN acts ON NOT (seg = 3 AND action = 'signup')
  WHERE NOT legacy)"""


@query("W3_ranking", LOG + f""", {ALL_MU}
SELECT capsule, id, (row_number() OVER (PARTITION BY capsule, id ORDER BY mu DESC, idx) - 1)::INT AS rank,
  action, round(mu, 9) AS probability FROM lx""")
def w3(spark, folder):
    from policylens.operators.estimators import has_propensity

    d = event_decisions(spark, folder).filter(has_propensity())
    return rounded(R.ranking(d).drop("tenant", "job"), 9)


@query("W4_rank_table", LOG + """,
x AS (SELECT logp.*, action, idx, CASE WHEN seg = 3 AND action = 'signup' THEN 0.0::DOUBLE
  WHEN action = fav THEN 0.4::DOUBLE ELSE 0.6::DOUBLE / (k - 1) END AS mu,
  CASE WHEN action = chosen_id THEN 0 WHEN seg = 3 AND action = 'signup' THEN 2 ELSE 1 END AS tier
  FROM logp, acts WHERE NOT legacy)
SELECT capsule, id, (row_number() OVER (PARTITION BY capsule, id ORDER BY tier,
  CASE WHEN tier = 0 THEN 0 ELSE -mu END, idx) - 1)::INT AS rank, action,
  round(mu, 9) AS probability FROM x""")
def w4(spark, folder):
    from policylens.operators.estimators import has_propensity

    d = event_decisions(spark, folder).filter(has_propensity())
    return rounded(R.rank_table(d).drop("tenant", "job"), 9)


@query("W5_sequence_numbers", LOG + """
SELECT rw.capsule, rw.decision_id, rw.seq AS arrival, last_seq
  + row_number() OVER (PARTITION BY rw.capsule ORDER BY rw.seq) AS seq
FROM rw JOIN (SELECT cap AS capsule, max(event_id) AS last_seq FROM ev GROUP BY ALL) l
ON l.capsule = rw.capsule""")
def w5(spark, folder):
    rewards = event_rewards(spark, folder).withColumnRenamed("seq", "arrival")
    last = event_audit(spark, folder).groupBy(*KEY).agg(F.max("seq").alias("last_seq"))
    return I.next_seq(rewards, last).select("capsule", "decision_id", "arrival", "seq")


# --- maintenance -------------------------------------------------------------------------

@query("E1_ingest_decisions", LOG + """,
b AS (SELECT capsule, id, event_id, event_id AS arrival FROM log
  UNION ALL SELECT capsule, id, event_id, event_id + n FROM log,
    (VALUES (1000000000), (2000000000)) t(n) WHERE event_id % 20 = 0)
SELECT capsule, id, arrival, CASE WHEN event_id % 33 = 1 THEN 'invalid'
  WHEN event_id % 15 = 2 THEN 'duplicate'
  WHEN row_number() OVER (PARTITION BY capsule, id ORDER BY arrival) = 1 THEN 'inserted'
  ELSE 'duplicate' END AS outcome FROM b""")
def e1(spark, folder):
    n = F.col("arrival") % 10**9
    new = repeated_batch(spark, folder).withColumn(
        "mode", F.when(n % 33 == 1, "").otherwise(F.col("mode"))
    )
    existing = event_decisions(spark, folder).filter(F.col("arrival") % 15 == 2)
    return I.ingest_decisions(new, existing).select("capsule", "id", "arrival", "outcome")


@query("E2_ingest_rewards", LOG + """,
raw AS (
  SELECT *, seq AS arrival FROM rw
  UNION ALL SELECT *, seq + 1000000000 FROM rw WHERE event_id % 20 = 4),
old AS (SELECT capsule, count(*) AS last_seq FROM rw WHERE event_id % 25 = 7 GROUP BY ALL),
c AS (
  SELECT raw.*, event_id % 21 = 1 AS bad, event_id % 25 = 7 AS stored,
    EXISTS (SELECT 1 FROM log WHERE log.capsule = raw.capsule AND log.id = raw.decision_id) AS known
  FROM raw),
d AS (
  SELECT *, NOT bad AND known AND NOT stored AND arrival = min(CASE WHEN NOT bad AND known
    THEN arrival END) OVER (PARTITION BY capsule, idempotency_key) AS wins FROM c)
SELECT d.capsule, idempotency_key, arrival,
  CASE WHEN bad THEN 'invalid' WHEN NOT known THEN 'unknown_decision' WHEN wins THEN 'applied'
    ELSE 'duplicate' END AS outcome,
  CASE WHEN wins THEN last_seq + count(*) FILTER (wins) OVER (PARTITION BY d.capsule ORDER BY arrival)
    END AS seq
FROM d JOIN old ON old.capsule = d.capsule""")
def e2(spark, folder):
    n = F.floor(F.col("seq") / 2)
    w = event_rewards(spark, folder)
    existing = I.next_seq(
        w.filter(n % 25 == 7).withColumnRenamed("seq", "arrival")
    )
    new = w.withColumn("arrival", F.col("seq"))
    new = new.unionByName(
        new.filter(n % 20 == 4).withColumn("arrival", F.col("seq") + 10**9)
    ).withColumn("value", F.when(n % 21 == 1, float("nan")).otherwise(F.col("value")))
    out = I.ingest_rewards(new, event_decisions(spark, folder), existing)
    return out.select("capsule", "idempotency_key", "arrival", "outcome", "seq")


@query("E3_retry_or_conflict", LOG + """
SELECT capsule, id, CASE WHEN event_id % 5 = 0 THEN 'new' WHEN event_id % 7 = 1 THEN 'conflict'
  WHEN event_id % 11 = 2 THEN 'conflict' ELSE 'retry' END AS status FROM log""")
def e3(spark, folder):
    d = event_decisions(spark, folder)
    new = d.withColumns(
        {
            "request_sha256": F.when(F.col("arrival") % 7 == 1, F.sha2("id", 256)).otherwise(
                F.col("request_sha256")
            ),
            "seed": F.when(F.col("arrival") % 11 == 2, -1).otherwise(F.col("seed")),
        }
    )
    return I.retry_or_conflict(new, d.filter(F.col("arrival") % 5 != 0)).select(
        "capsule", "id", "status"
    )


@query("E4_idempotency_key", LOG + """
SELECT capsule, seq, decision_id AS first_key, CASE WHEN event_id % 3 = 0 THEN idempotency_key
  END AS sum_key, event_id % 3 <> 0 AS made FROM rw""")
def e4(spark, folder):
    w = event_rewards(spark, folder)
    given = F.when(F.floor(F.col("seq") / 2) % 3 == 0, F.col("idempotency_key"))
    fresh = I.idempotency_key(
        "sum", F.col("decision_id"), given, F.col("ts_ms"), F.col("value"), F.col("seq")
    )
    w = w.withColumn("k", fresh)
    made = given.isNull() & F.col("k").startswith(F.concat(F.col("decision_id"), F.lit(":")))
    return w.select(
        "capsule", "seq",
        I.idempotency_key("first", F.col("decision_id"), given).alias("first_key"),
        F.when(~made, F.col("k")).alias("sum_key"), made.alias("made"),
    )


@query("E5_default_rewards", LOG + f"""
SELECT capsule, id AS decision_id, {NOW} AS ts_ms, 25.0::DOUBLE AS value, 0.05::DOUBLE AS value_norm,
  concat(id, ':default') AS idempotency_key, '{{"default":true}}' AS detail
FROM logp WHERE ts_ms <= {NOW} - 600000
  AND NOT EXISTS (SELECT 1 FROM rw WHERE rw.capsule = logp.capsule AND rw.decision_id = logp.id)""")
def e5(spark, folder):
    return I.default_rewards(
        event_decisions(spark, folder), event_rewards(spark, folder), int(NOW), 25.0, 600, "sum",
        0.0, 500.0,
    ).select(
        "capsule", "decision_id", "ts_ms", "value", "value_norm", "idempotency_key", "detail"
    )


@query("E6_deferred_activation", LOG + """,
act AS (SELECT capsule, id, ts_ms + (event_id % 30) * 3600000 AS activated_ms FROM log
  WHERE event_id % 3 <> 0),
live AS (SELECT log.capsule, log.id, activated_ms FROM log JOIN act ON act.capsule = log.capsule
  AND act.id = log.id WHERE activated_ms < ts_ms + 86400000)
SELECT live.capsule, live.id, activated_ms, count(decision_id) AS released
FROM live LEFT JOIN rw ON rw.capsule = live.capsule AND rw.decision_id = live.id GROUP BY ALL""")
def e6(spark, folder):
    d = event_decisions(spark, folder)
    acts = d.filter(F.col("arrival") % 3 != 0).select(
        *KEY, "id", (F.col("ts_ms") + (F.col("arrival") % 30) * 3600000).alias("ts_ms")
    )
    live, released = I.activate(d, acts, event_rewards(spark, folder))
    n = released.groupBy(*KEY, F.col("decision_id").alias("id")).agg(
        F.count(F.lit(1)).alias("released")
    )
    return live.join(n, [*KEY, "id"], "left").select(
        "capsule", "id", "activated_ms", F.coalesce("released", F.lit(0)).alias("released")
    )


@query("E7_retention", LOG + f""", {MODELS},
gone AS (SELECT * FROM log WHERE ts_ms < {NOW}),
m AS (SELECT capsule, arg_max(reward_seq, version) AS mark FROM models WHERE version <= 10 GROUP BY ALL)
SELECT g.capsule, decisions, rewards, kept_decisions, kept_rewards, last_removed > mark AS loses
FROM (SELECT capsule, count(*) AS decisions FROM gone GROUP BY ALL) g
JOIN (SELECT rw.capsule, count(*) AS rewards, max(seq) AS last_removed FROM rw
  JOIN gone ON gone.capsule = rw.capsule AND gone.id = rw.decision_id GROUP BY ALL) w
  ON w.capsule = g.capsule
JOIN (SELECT capsule, count(*) AS kept_decisions FROM log WHERE ts_ms >= {NOW} GROUP BY ALL) kd
  ON kd.capsule = g.capsule
JOIN (SELECT rw.capsule, count(*) AS kept_rewards FROM rw WHERE NOT EXISTS (SELECT 1 FROM gone
  WHERE gone.capsule = rw.capsule AND gone.id = rw.decision_id) GROUP BY ALL) kr
  ON kr.capsule = g.capsule
JOIN m ON m.capsule = g.capsule""")
def e7(spark, folder):
    d, w = event_decisions(spark, folder), event_rewards(spark, folder)
    kept_d, kept_w, counts = H.prune(d, w, int(NOW))
    heads = model_headers(spark, folder).filter("version <= 10")
    lost = H.unlearned_losses(d, w, heads, int(NOW)).select(*KEY, F.lit(True).alias("loses"))
    nd = kept_d.groupBy(*KEY).agg(F.count(F.lit(1)).alias("kept_decisions"))
    nw = kept_w.groupBy(*KEY).agg(F.count(F.lit(1)).alias("kept_rewards"))
    return counts.join(nd, KEY).join(nw, KEY).join(lost, KEY, "left").select(
        "capsule", "decisions", "rewards", "kept_decisions", "kept_rewards",
        F.coalesce("loses", F.lit(False)).alias("loses"),
    )


@query("E8_erase_capsule", LOG + """,
t AS (SELECT 'decisions' AS part, capsule FROM log UNION ALL SELECT 'rewards', capsule FROM rw)
SELECT part, capsule, count(*) AS n, NULL AS detail FROM t WHERE capsule <> 'router1' GROUP BY ALL
UNION ALL SELECT 'audit', 'router1', count(*), concat('{"removedRows":', count(*), '}')
FROM t WHERE capsule = 'router1'""")
def e8(spark, folder):
    tables = {"decisions": event_decisions(spark, folder), "rewards": event_rewards(spark, folder)}
    kept, audit = H.erase(tables, ROUTER1, int(NOW))
    out = audit.select(
        F.lit("audit").alias("part"), "capsule",
        F.get_json_object("detail", "$.removedRows").cast("bigint").alias("n"), "detail",
    )
    for name, df in kept.items():
        out = out.unionByName(
            df.groupBy(F.lit(name).alias("part"), "capsule").agg(
                F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("detail")
            )
        )
    return out


@query("E9_purge_logs", LOG + """
SELECT 'audit' AS part, concat('{"removedDecisions":', (SELECT count(*) FROM log WHERE
  capsule = 'router1'), ',"removedRewards":', (SELECT count(*) FROM rw WHERE capsule = 'router1'),
  '}') AS value
UNION ALL SELECT 'decisions', count(*)::VARCHAR FROM log WHERE capsule <> 'router1'
UNION ALL SELECT 'rewards', count(*)::VARCHAR FROM rw WHERE capsule <> 'router1'""")
def e9(spark, folder):
    d, w, audit = H.purge_logs(
        event_decisions(spark, folder), event_rewards(spark, folder), ROUTER1, int(NOW)
    )
    count = F.count(F.lit(1)).cast("string").alias("value")
    return (
        audit.select(F.lit("audit").alias("part"), F.col("detail").alias("value"))
        .unionByName(d.agg(count).select(F.lit("decisions").alias("part"), "value"))
        .unionByName(w.agg(count).select(F.lit("rewards").alias("part"), "value"))
    )


@query("E7_E9_store", LOG + f""", {MODELS},
kept AS (SELECT * FROM log WHERE ts_ms >= {NOW}),
kw AS (SELECT rw.* FROM rw WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.capsule = rw.capsule AND log.id = rw.decision_id AND ts_ms < {NOW})),
m3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capsule ORDER BY version DESC) AS k FROM models) WHERE k <= 3),
steps AS (
  SELECT 'pruned' AS step, 'decisions' AS part, capsule FROM kept UNION ALL SELECT 'pruned', 'rewards', capsule FROM kw
  UNION ALL SELECT 'pruned', 'models', capsule FROM models UNION ALL SELECT 'pruned', 'slots', capsule FROM models
  UNION ALL SELECT 'pruned', 'audit', capsule FROM (SELECT DISTINCT capsule FROM log WHERE ts_ms < {NOW})
  UNION ALL SELECT 'erased', 'decisions', capsule FROM kept WHERE capsule <> 'router1' UNION ALL SELECT 'erased', 'rewards', capsule FROM kw WHERE capsule <> 'router1'
  UNION ALL SELECT 'erased', 'models', capsule FROM models WHERE capsule <> 'router1' UNION ALL SELECT 'erased', 'slots', capsule FROM models WHERE capsule <> 'router1'
  UNION ALL SELECT 'erased', 'audit', capsule FROM (SELECT DISTINCT capsule FROM log WHERE ts_ms < {NOW})
  UNION ALL SELECT 'erased', 'audit', 'router1'
  UNION ALL SELECT 'purged', 'decisions', capsule FROM kept WHERE capsule = 'router0' UNION ALL SELECT 'purged', 'rewards', capsule FROM kw WHERE capsule = 'router0'
  UNION ALL SELECT 'purged', 'models', capsule FROM m3 WHERE capsule <> 'router1' UNION ALL SELECT 'purged', 'slots', capsule FROM m3 WHERE capsule <> 'router1'
  UNION ALL SELECT 'purged', 'audit', capsule FROM (SELECT DISTINCT capsule FROM log WHERE ts_ms < {NOW})
  UNION ALL SELECT 'purged', 'audit', 'router1' UNION ALL SELECT 'purged', 'audit', 'router2'
  UNION ALL SELECT 'purged', 'audit', capsule FROM models WHERE capsule <> 'router1' GROUP BY capsule HAVING count(*) > 3)
SELECT step, part, capsule, count(*) AS n FROM steps GROUP BY ALL
UNION ALL SELECT 'refused', 'decisions', capsule, count(*) FROM log GROUP BY ALL""")
def e7_e9(spark, folder):
    """A store of the whole log: a refused pruning, then pruning, erasing, old models dropped and purging, read back after each."""
    heads = model_headers(spark, folder)
    head = heads.select(
        *KEY, "version", (F.col("reward_seq") + 1).alias("reward_seq"), F.lit(0).alias("ts_ms"), F.lit(12).alias("bits"),
        F.lit(0.5).alias("learning_rate"), "n_updates", F.col("n_updates").cast("double").alias("total_weight"), F.lit(1.0).alias("norm_sum"),
    )
    slots = heads.select(*KEY, "version", F.col("version").alias("slot"), *[F.lit(1.0).alias(c) for c in ("u", "s", "a")])
    store = Store(spark, shared_folder(spark, "store"))
    store.append(decisions=event_decisions(spark, folder), rewards=event_rewards(spark, folder))
    seen = []

    def look(step: str, *tables: str) -> None:
        for t in tables:
            rows = store.read(t).groupBy(F.lit(step).alias("step"), F.lit(t).alias("part"), "capsule")
            seen.append(checkpointed(rows.agg(F.count(F.lit(1)).alias("n"))))  # later steps remove the files

    everything = ("decisions", "rewards", "models", "slots", "audit")
    try:
        store.prune(int(NOW), int(NOW))
    except RefusedError:
        look("refused", "decisions")  # without a model nothing may go
    store.append(models=head, slots=slots)
    store.prune(int(NOW), int(NOW))
    look("pruned", *everything)
    store.erase(ROUTER1, int(NOW))
    look("erased", *everything)
    store.keep_newest_models(3, int(NOW))
    store.purge(("acme", "default", "router2"), int(NOW))
    store.vacuum()
    look("purged", *everything)
    return reduce(DataFrame.unionByName, seen)


@query("E10_spec_history", """
SELECT concat('user', user_id) AS capsule, max(event_id) AS seq,
  round(arg_max(round(value / 1000, 6), event_id) FILTER (event_type = 'purchase'), 6) AS epsilon,
  CASE WHEN count(*) FILTER (event_type = 'signup') > 0 THEN 'frozen' ELSE 'learner' END AS mode
FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL""")
def e10(spark, folder):
    e = table(spark, folder, "events").filter(F.col("event_type").isin("purchase", "signup"))
    eps = F.format_string(
        '{"patch":{"exploration":{"epsilon":%s}}}', F.round(F.col("value") / 1000, 6)
    )
    audit = e.select(
        F.lit("acme").alias("tenant"), F.lit("default").alias("job"),
        F.concat(F.lit("user"), F.col("user_id")).alias("capsule"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", eps)
        .otherwise('{"patch":{"mode":"frozen"}}').alias("detail"),
    )
    patched = audit.filter(F.contains("detail", F.lit("epsilon"))).select("capsule").distinct()
    h = H.spec_history(audit).join(patched.withColumn("has", F.lit(True)), "capsule", "left")
    epsilon = F.get_json_object("spec", "$.exploration.epsilon").cast("double")
    return h.select(
        "capsule", "seq", F.when(F.col("has"), r(epsilon)).alias("epsilon"),
        F.get_json_object("spec", "$.mode").alias("mode"),
    )


@query("L3_learning_weight", LOG + """
SELECT capsule, id, 1.0::DOUBLE AS plain, round(least(1 / coalesce(probability, 1), 5.0), 9) AS mtr
FROM logp""")
def l3(spark, folder):
    from policylens.operators.learner import learning_weight
    from policylens.spec import PolicySpec

    mtr = PolicySpec.of({"learner": {"importance": "mtr", "maxImportanceWeight": 5.0}})
    p = F.col("probability")
    return event_decisions(spark, folder).select(
        "capsule", "id", learning_weight(PolicySpec.of(), p).alias("plain"),
        r(learning_weight(mtr, p), 9).alias("mtr"),
    )


@query("L7_learned_rewards", LOG + """
SELECT capsule, count(*) AS n, round(sum(value), 4) AS total FROM rw
WHERE event_id % 6 <> 1 GROUP BY ALL""")
def l7(spark, folder):
    from policylens.operators.learner import was_learned

    n = F.floor(F.col("seq") / 2) % 6
    w = event_rewards(spark, folder).withColumn(
        "detail",
        F.when(n == 1, '{"learned":false}').when(n == 2, '{"learned":true}')
        .when(n == 3, F.lit(None)).otherwise(F.col("detail")),
    )
    return w.filter(was_learned(F.col("detail"))).groupBy("capsule").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total")
    )


# --- values ------------------------------------------------------------------------------

@query("F16_json_path", """
WITH j AS (SELECT event_id, concat('{"p":', props, ',"l":["', event_type, '",', event_id,
  '],"n":null}') AS t FROM events)
SELECT event_id, json_extract_string(t, '$.p.k') AS k, json_extract_string(t, '$.l[0]') AS first,
  json_exists(t, '$.n') AS has_n, json_exists(t, '$.z') AS has_z,
  json_array_length(t, '$.l')::INT AS list_len, len(json_keys(t, '$.p'))::INT AS object_len,
  length(json_extract_string(t, '$.l[0]'))::INT AS text_len FROM j""")
def f16(spark, folder):
    t = F.concat(
        F.lit('{"p":'), F.col("props"), F.lit(',"l":["'), F.col("event_type"), F.lit('",'),
        F.col("event_id"), F.lit('],"n":null}'),
    )
    e = table(spark, folder, "events").select("event_id", t.alias("t"))
    c = F.col("t")
    return e.select(
        "event_id", V.json_get(c, "$.p.k").alias("k"), V.json_get(c, "$.l[0]").alias("first"),
        V.json_has(c, "$.n").alias("has_n"), V.json_has(c, "$.z").alias("has_z"),
        V.json_len(c, "$.l").alias("list_len"), V.json_len(c, "$.p").alias("object_len"),
        V.json_len(c, "$.l[0]").alias("text_len"),
    )


@query("F17_prompt_features", """
WITH c AS (SELECT conv_id, sum(length(text)) / 4.0::DOUBLE AS x,
  count(*) FILTER (role = 'user') AS turns, bool_or(role = 'system') AS has_system,
  bool_or(contains(text, '```') OR contains(text, 'def ') OR contains(text, 'function '))
    AS looks_like_code FROM conversations GROUP BY ALL)
SELECT conv_id, (CASE WHEN x - floor(x) = 0.5 THEN 2 * round(x / 2) ELSE round(x) END)::BIGINT
  AS prompt_tokens, turns, has_system, looks_like_code FROM c""")
def f17(spark, folder):
    return V.prompt_features(table(spark, folder, "conversations"))


@query("F18_compose_reward", """
SELECT event_id, round(CASE WHEN event_id % 9 = 0 OR event_id % 8 = 0 THEN -1.0
  ELSE value / 100 - 2.0 * CASE WHEN event_id % 4 = 0 THEN 0 ELSE value / 1000 END
    - 0.1 * (event_id % 50) / 10.0::DOUBLE END, 6) AS reward FROM events""")
def f18(spark, folder):
    n = F.col("event_id")
    reward = V.compose_reward(
        F.when(n % 9 != 0, F.col("value") / 100), n % 8 != 0,
        F.when(n % 4 != 0, F.col("value") / 1000), (n % 50) / F.lit(10.0), 2.0, 0.1, -1.0,
    )
    return table(spark, folder, "events").select("event_id", r(reward).alias("reward"))


@query("F19_capacity", """
SELECT event_id, least(greatest(ceil(value / 12.5::DOUBLE)::BIGINT, 2), 20) AS units FROM events""")
def f19(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", V.capacity(F.col("value"), 12.5, 2, 20).alias("units")
    )


@query("B3_document_log", """
WITH d AS (SELECT lang, source, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, source, count(*) AS n, count(quality) AS rewarded, round(avg(quality), 9) AS mean
FROM d GROUP BY ALL""")
def b3(spark, folder):
    d = document_decisions(spark, folder)
    lang = F.get_json_object("context", "$.seg")
    return d.groupBy(lang.alias("lang"), F.col("chosen_id").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.count("reward").alias("rewarded"),
        r(F.avg("reward"), 9).alias("mean"),
    )
