"""Queries of features, learning, scoring, replay and the log formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policylens.functions import features as X
from policylens.functions.pmf import once
from policylens.operators import ingest as I
from policylens.operators import joins as J
from policylens.operators import learner as L
from policylens.operators.uploads import verify_uploads
from policylens.plans import nag_sql as N
from policylens.plans import oracle as O
from policylens.plans.log_queries import LOG, NOW, logged
from policylens.plans.registry import query, r, rounded
from policylens.plans.sample_log import event_decisions, event_rewards, table
from policylens.schema import KEY
from policylens.session import checkpointed, shared_folder, written
from policylens.sources import dsjson, exports, logs
from policylens.spec import PolicySpec

BITS = 12
SPEC = PolicySpec.of({"learner": {"bits": BITS}, "reward": {"range": [0.0, 500.0]}})


# --- features ----------------------------------------------------------------------------

@query("F1_flatten_features", LOG + """
SELECT capsule, id, n.name AS name, n.value AS value FROM log, LATERAL (SELECT unnest([
  {'name': 'hour', 'value': hour::DOUBLE}, {'name': concat('seg=s', seg), 'value': 1.0::DOUBLE},
  {'name': 'tags=a', 'value': 1.0::DOUBLE}, {'name': 'tags=a', 'value': 1.0::DOUBLE},
  {'name': 'tags[2]', 'value': 3.0::DOUBLE}, {'name': 'user.pro=true', 'value': 1.0::DOUBLE},
  {'name': 'user.at[0].x', 'value': (event_id % 7)::DOUBLE}]) AS n)""")
def f1(spark, folder):
    d = event_decisions(spark, folder)
    nested = F.concat(
        F.expr("substring(context, 1, length(context) - 1)"),
        F.lit(',"none":null,"tags":["a","a",3],"user":{"pro":true,"at":[{"x":'),
        F.col("arrival") % 7, F.lit("}]}}"),
    )
    flat = X.flatten_features(nested)
    return d.select("capsule", "id", F.inline(flat)).withColumn(
        "value", F.col("value").cast("double")
    )


@query("F2_hash_features", "WITH " + O.LOG + ", s AS (SELECT seg, " + O.fnv(
    "list_concat([99::UHUGEINT, 0::UHUGEINT], " + O.text_bytes("concat('seg=s', seg)") + ")"
) + " AS h FROM (SELECT DISTINCT seg FROM log)) SELECT capsule, id, " + O.signed("h")
    + " AS hash FROM log JOIN s ON s.seg = log.seg")
def f2(spark, folder):
    seg = F.concat(F.lit("seg="), F.get_json_object("context", "$.seg"))
    hashed = X.hash_features(F.array(seg), "c")
    return event_decisions(spark, folder).select(
        "capsule", "id", F.get(hashed, F.lit(0)).alias("hash")
    )


PHI = N.phi(BITS)


@query("F3_phi", LOG + f""", {PHI}
SELECT log.capsule, log.id, phi.action, slot, round(x::DOUBLE, 6) AS x
FROM log JOIN phi ON phi.hour = log.hour AND phi.seg = log.seg""")
def f3(spark, folder):
    d = X.featurize(event_decisions(spark, folder))
    names = F.transform("eligible", lambda i: F.get(F.col("actions"), i)["id"])
    d = d.withColumn("names", names)
    long = L.phi_rows(d, ["capsule", "id", "names"], BITS)
    return long.select(
        "capsule", "id", F.get("names", F.col("position")).alias("action"), "slot",
        r(F.col("x_value").cast("double")).alias("x"),
    )


@query("F4_canonical_slots", LOG + f""", {PHI}
SELECT slot, count(*) AS n, round(sum(x::DOUBLE), 4) AS total
FROM log JOIN phi ON phi.hour = log.hour AND phi.seg = log.seg GROUP BY ALL""")
def f4(spark, folder):
    long = L.phi_rows(X.featurize(event_decisions(spark, folder)), ["id"], BITS)
    return long.groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(F.col("x_value").cast("double")), 4).alias("total")
    )


@query("F5_action_features", LOG + f"""
SELECT log.capsule, log.id, action, {O.signed(N._space(97, "concat('id=', action)"))} AS id_hash
FROM log JOIN acts ON NOT (seg = 3 AND action = 'signup')""")
def f5(spark, folder):
    d = X.featurize(event_decisions(spark, folder))
    return d.select(
        "capsule", "id", "actions",
        F.inline(F.arrays_zip(F.col("eligible").alias("i"), F.col("features.a").alias("f"))),
    ).select(
        "capsule", "id", F.get("actions", F.col("i"))["id"].alias("action"),
        F.get("f", F.lit(0))["hash"].alias("id_hash"),
    )


@query("F15_merge_objects", LOG + """
SELECT capsule, id, concat('{"hour":', hour, ',"seg":"late","user":{"n":', event_id % 5,
  ',"tier":"pro"}}') AS merged FROM log""")
def f15(spark, folder):
    parts = F.array(
        F.col("context"),
        F.concat(F.lit('{"user":{"tier":"free","n":'), F.col("arrival") % 5, F.lit("}}")),
        F.lit('{"user":{"tier":"pro"},"seg":"late"}'),
    )
    return event_decisions(spark, folder).select(
        "capsule", "id", X.merge_objects(parts).alias("merged")
    )


# --- learning ----------------------------------------------------------------------------

def learning_rows(spark: SparkSession, folder: str) -> DataFrame:
    d = event_decisions(spark, folder).withColumnRenamed("ts_ms", "decision_ts_ms")
    joined = J.decision_key(event_rewards(spark, folder), "id").join(d, [*KEY, "id"])
    return X.featurize(joined)


def header_and_slots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return L.fold_models(learning_rows(spark, folder), SPEC)


@query("L1_nag_model", N.models(BITS) + """
SELECT capsule, slot, round(u::DOUBLE, 4) AS u, round(s::DOUBLE, 4) AS s, round(a::DOUBLE, 3) AS a FROM slots""")
def l1(spark, folder):
    """Slots of every capsule's model after learning from its whole reward log, one reward after the other."""
    _, slots = header_and_slots(spark, folder)
    return slots.select(
        "capsule", "slot", *[r(F.col(c).cast("double"), d).alias(c) for c, d in (("u", 4), ("s", 4), ("a", 3))]
    )


@query("L2_fold_models", N.models(BITS) + """,
top AS (SELECT capsule, max(seq) AS reward_seq FROM rw JOIN logp USING (capsule) WHERE logp.id = rw.decision_id GROUP BY ALL)
SELECT capsule, n AS n_updates, reward_seq, round(t, 4) AS total_weight, round(q, 4) AS norm_sum, count(*) AS n_slots,
  round(sum(slots.u::DOUBLE / slots.s::DOUBLE), 4) AS weights
FROM model JOIN top USING (capsule) JOIN slots USING (capsule) WHERE slots.s > 0 GROUP BY ALL""")
def l2(spark, folder):
    """A first model, then the later rewards folded onto it: the same as all rewards one after the other."""
    data = learning_rows(spark, folder)
    half = data.agg((F.max("seq") / 2).cast("bigint").alias("half")).first()["half"]
    head, slots = L.fold_models(data.filter(F.col("seq") <= half), SPEC)
    head, slots = checkpointed(head), checkpointed(slots)
    head2, slots2 = L.fold_models(data, SPEC, slots, head)
    weights = slots2.filter("s > 0").groupBy("capsule").agg(
        F.count(F.lit(1)).alias("n_slots"), r(F.sum(F.col("u").cast("double") / F.col("s").cast("double")), 4).alias("weights")
    )
    return head2.join(weights, "capsule").select(
        "capsule", "n_updates", "reward_seq", r("total_weight", 4).alias("total_weight"), r("norm_sum", 4).alias("norm_sum"),
        "n_slots", "weights",
    )


def weight_table(df: DataFrame, bits: int) -> DataFrame:
    """A slot table with weights that follow from the slot number."""
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((1 << bits) - 1).cast("bigint")))
    keys = df.select(*KEY).distinct().select(*KEY, every.alias("slot"))
    return keys.select(
        *KEY, "slot", ((F.col("slot") % 100 - 20) / 200.0).cast("float").alias("u"),
        (1.0 + F.col("slot") % 3).cast("float").alias("s"), F.lit(1.0).cast("float").alias("a"),
    )


@query("L4_score", LOG + f""", {PHI},
sc AS (SELECT hour, seg, action, sum(((slot % 100 - 20) / 200.0::DOUBLE)::FLOAT::DOUBLE
    / (1.0::DOUBLE + slot % 3) * x::DOUBLE) AS raw FROM phi GROUP BY ALL)
SELECT log.capsule, log.id, action, round(least(greatest(raw, 0), 1), 6) AS prediction
FROM log JOIN sc ON sc.hour = log.hour AND sc.seg = log.seg""")
def l4(spark, folder):
    d = event_decisions(spark, folder)
    scored = L.score(X.featurize(d), weight_table(d, BITS), [*KEY, "id"], BITS)
    named = d.select(*KEY, "id", "actions", "eligible")
    return scored.join(named, [*KEY, "id"]).select(
        "capsule", "id",
        F.get("actions", F.get("eligible", F.col("position")))["id"].alias("action"),
        r("prediction").alias("prediction"),
    )


@query("L3_frozen_rewards", LOG + """
SELECT rw.capsule, rw.capsule = 'router2' AS frozen, count(*) FILTER (rw.capsule <> 'router2') AS learned, count(*) AS n
FROM rw JOIN log ON log.capsule = rw.capsule AND log.id = rw.decision_id GROUP BY ALL""")
def l3_frozen(spark, folder):
    """Rewards of a frozen capsule are stored and teach nothing."""
    base = SPEC.patched({"mode": "frozen"}).json()
    d = event_decisions(spark, folder)
    specs = d.select(*KEY).distinct().withColumn(
        "spec", F.when(F.col("capsule") == "router2", base).otherwise(SPEC.json())
    )
    stored = J.known_rewards(I.mark_frozen(event_rewards(spark, folder), specs), d)
    return stored.groupBy("capsule", (F.col("capsule") == "router2").alias("frozen")).agg(
        F.count_if(L.was_learned(F.col("detail"))).alias("learned"), F.count(F.lit(1)).alias("n")
    )


def upload_parts(decided: DataFrame, **pmfs: Column) -> DataFrame:
    """What the upload lines of a decision are put together from: texts that are made once, however many lines share them.

    One column per PMF of `pmfs`, by its name.
    """
    item_input = F.struct(
        F.parse_json("context").alias("context"),
        F.transform(
            "actions",
            lambda a: F.struct(a["id"].alias("id"), F.parse_json(a["features"]).alias("features")),
        ).alias("actions"),
        F.col("excluded_ids").alias("excludedActions"),
    )
    return once(
        decided, *KEY, "arrival", "seed",
        fields_text(
            F.col("id").alias("decisionId"), F.col("ts_ms").alias("tsMs"),
            F.col("model_tag").alias("modelTag"), F.col("model_version").alias("modelVersion"),
        ).alias("head"),
        fields_text(item_input.alias("input")).alias("input"),
        fields_text(
            F.col("chosen_index").alias("chosenIndex"), F.col("chosen_id").alias("chosenId"), F.col("probability"),
        ).alias("chosen"),
        fields_text(F.col("eligible")).alias("eligible"),
        *[fields_text(pmf.alias("pmf")).alias(name) for name, pmf in pmfs.items()],
    )


def fields_text(*columns: Column) -> Column:
    """JSON text of fields without the braces; null if all are null."""
    return F.nullif(F.regexp_extract(F.to_json(F.struct(*columns)), r"(?s)\A\{(.*)\}\z", 1), F.lit(""))


def lines_of(parts: DataFrame, seed: Column, pmf: Column) -> DataFrame:
    """Client batches of one decision each from `upload_parts`, with a seed and the text of a PMF."""
    texts = F.array("head", F.concat(F.lit('"seed":"'), seed.cast("string"), F.lit('"')), "input", "chosen", pmf, "eligible")
    line = F.concat(F.lit('{"decisions":[{'), F.array_join(texts, ","), F.lit("}]}"))
    return parts.select(*KEY, "arrival", line.alias("value"))


def upload_lines(decided: DataFrame) -> DataFrame:
    """Client batches: one JSON line per decision, as a client would upload it."""
    return lines_of(upload_parts(decided, pmf=F.col("pmf")), F.col("seed"), F.col("pmf"))


@query("L6_verify_uploads", LOG + f""",
o AS (SELECT DISTINCT capsule, model_version % 3 AS m FROM log)
SELECT log.capsule, CASE WHEN event_id % 13 = 1 THEN 'rejected'
  WHEN event_id % 13 = 2 THEN 'duplicate'
  WHEN NOT (ts_ms BETWEEN {NOW} - 7 * 24 * 3600 * 1000::BIGINT AND {NOW} + 300000) THEN 'rejected'
  WHEN event_id % 13 = 3 THEN 'unverified' WHEN event_id % 13 IN (4, 5) THEN 'rejected'
  ELSE 'new' END AS status,
  CASE WHEN event_id % 13 = 1 THEN 'id_used_by_other_decision' WHEN event_id % 13 = 2 THEN NULL
  WHEN NOT (ts_ms BETWEEN {NOW} - 7 * 24 * 3600 * 1000::BIGINT AND {NOW} + 300000)
    THEN 'outside_upload_window'
  WHEN event_id % 13 = 4 THEN 'inconsistent' WHEN event_id % 13 = 5 THEN 'does_not_replay' END AS why,
  count(*) AS n FROM log GROUP BY ALL""")
def l6(spark, folder):
    """Uploads that replay, and every way one can fail to."""
    decided, models, slots = upload_fixture(spark, folder)
    k = F.col("arrival") % 13
    tag = F.when(k.isin(3, 4), "gone").otherwise(F.col("model_tag"))
    sent = decided.withColumn("model_tag", tag).withColumns(
        {
            "probability": F.when(k == 4, F.col("probability") / 2).otherwise(F.col("probability")),
            "pmf": F.when(k == 5, blurred()).otherwise(F.col("pmf")),
        }
    )
    uploads = written(logs.parse_uploaded_decisions(upload_lines(sent)), "l6-uploads")
    stored = uploads.filter(F.col("arrival") % 13 == 2).unionByName(
        uploads.filter(F.col("arrival") % 13 == 1).withColumn("seed", F.col("seed") + 1)
    )
    out = verify_uploads(uploads, stored, models, slots, SPEC, int(NOW))
    return out.groupBy("capsule", "status", "why").agg(F.count(F.lit(1)).alias("n"))


@query("L6_claims", LOG + f""",
copies AS (SELECT *, ts_ms BETWEEN {NOW} - 7 * 24 * 3600 * 1000::BIGINT AND {NOW} + 300000 AS on_time
  FROM log, (VALUES (0), (1), (2), (3)) t(copy))
SELECT capsule, CASE WHEN on_time AND copy = 1 THEN 'new' WHEN on_time AND copy = 2 THEN 'duplicate' ELSE 'rejected' END AS status,
  CASE WHEN NOT on_time THEN 'outside_upload_window' WHEN copy = 0 THEN 'does_not_replay'
  WHEN copy = 3 THEN 'id_used_by_other_decision' END AS why, count(*) AS n FROM copies GROUP BY ALL""")
def l6_claims(spark, folder):
    """Four uploads of each id: one that does not replay, the right one, that again, another seed."""
    decided, models, slots = upload_fixture(spark, folder)
    parts = upload_parts(decided, pmf=F.col("pmf"), blurred=blurred())
    sent = parts.withColumn("n", F.explode(F.array(*map(F.lit, range(4))))).withColumn(
        "arrival", F.col("arrival") * 4 + F.col("n")
    )
    copy = F.col("arrival") % 4
    lines = lines_of(
        sent, F.when(copy == 3, F.col("seed") + 1).otherwise(F.col("seed")),
        F.when(copy == 0, F.col("blurred")).otherwise(F.col("pmf")),
    )
    uploads = written(logs.parse_uploaded_decisions(lines), "claims")
    out = verify_uploads(uploads, uploads.limit(0), models, slots, SPEC, int(NOW))
    return out.groupBy("capsule", "status", "why").agg(F.count(F.lit(1)).alias("n"))


def blurred():
    """A PMF that no longer is the one that was drawn from."""
    return F.transform("pmf", lambda p: 0.9 * p + 0.1 / F.size("pmf") + 1e-3)


def upload_fixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions of one published model per capsule, with models and slots."""
    d = event_decisions(spark, folder)
    # a few rows of all events, read once
    models = written(d.select(*KEY).distinct().select(
        *KEY, F.lit("tag0").alias("model_tag"), F.lit(400).cast("bigint").alias("n_updates")
    ), "published")
    slots = weight_table(models, BITS).withColumn("model_tag", F.lit("tag0"))
    signup = F.array(F.lit("signup"))
    requests = d.drop("pmf", "probability", "chosen_index", "chosen_id", "mode").withColumn(
        "excluded_ids", F.when(F.size("eligible") == 4, signup).otherwise(F.slice(signup, 1, 0))
    ).withColumn("model_tag", F.lit("tag0"))
    # no line holds these: they need not pass through the scoring
    ready = X.featurize(requests).drop("derived", "reason", "request_sha256", "program_sha256")
    decided = L.decide(ready, slots, models, SPEC, model_key=[*KEY, "model_tag"])
    return decided, models, slots


@query("F20_model_tag")
def f20(spark, folder):
    """Tag of each capsule's learned model: spec text plus a digest of its sorted slots."""
    _, slots = header_and_slots(spark, folder)
    line = F.concat_ws(":", "slot", F.hex(F.encode(F.col("u").cast("string"), "UTF-8")), "s", "a")
    # slots are digested in blocks of 2^16, then the digests, so no group grows with the model
    blocks = slots.groupBy(*KEY, F.floor(F.col("slot") / 65536).alias("b")).agg(
        F.sha2(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("slot", line.alias("t")))), lambda e: e["t"]
        ), "\n"), 256).alias("d")
    )
    digest = blocks.groupBy(*KEY).agg(
        F.unhex(F.sha2(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("b", "d"))), lambda e: e["d"]
        ), ""), 256)).alias("checksum")
    )
    return digest.select(
        "capsule", X.model_tag(F.lit(SPEC.decide_json()), F.col("checksum")).alias("model_tag")
    )


# --- sources and sinks -------------------------------------------------------------------

def row_lines(d: DataFrame) -> DataFrame:
    """Row-shaped JSON lines: eligible as ids, one reward field."""
    c = F.col
    doc = F.struct(
        c("id").alias("decisionId"), c("ts_ms").alias("tsMs"),
        F.parse_json("context").alias("context"),
        F.transform("actions", lambda a: F.struct(a["id"].alias("id"))).alias("actions"),
        F.transform("eligible", lambda i: F.get(c("actions"), i)["id"]).alias("eligible"),
        "pmf", c("chosen_index").alias("chosen"), "probability", "reward",
    )
    return d.select(*KEY, F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))


@query("S1_read_logged_rows", LOG + """
SELECT capsule, id, ts_ms, chosen_id, k::INT AS n_eligible, round(probability, 9) AS probability,
  round(reward, 6) AS reward, event_id % 2 = 0 AND reward IS NOT NULL AS aggregated,
  CASE WHEN legacy THEN 'legacy' END AS problem FROM lg""")
def s1(spark, folder):
    d = logged(spark, folder)
    server = exports.export_decisions(
        d.filter(F.col("arrival") % 2 == 0), event_rewards(spark, folder)
    )
    lines = server.select(*KEY, "value").unionByName(row_lines(d.filter(F.col("arrival") % 2 == 1)))
    rows = logs.parse_logged_rows(lines)
    return rows.select(
        "capsule", "id", "ts_ms", "chosen_id", F.size("eligible").alias("n_eligible"),
        r("probability", 9).alias("probability"), r("reward").alias("reward"), "aggregated",
        "problem",
    )


@query("S2_read_event_log", LOG + f"""
SELECT capsule, id, ts_ms, chosen_id FROM log
WHERE capsule = 'router1' AND ts_ms >= {NOW} - 86400000 AND ts_ms < {NOW}""")
def s2(spark, folder):
    path = shared_folder(spark, "event-log")
    logs.write_event_log(event_decisions(spark, folder), path)
    return logs.read_event_log(
        spark, path, ("acme", "default", "router1"), int(NOW) - 86400000, int(NOW)
    ).select("capsule", "id", "ts_ms", "chosen_id")


def dsjson_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking-service events rendered from the event log, with every special case."""
    d = event_decisions(spark, folder).drop("pmf", "probability")
    n = F.col("arrival")
    value = table(spark, folder, "events").select(
        F.col("event_id").alias("arrival"), "value", "ts"
    )
    d = d.join(value, "arrival")
    others = F.filter("eligible", lambda i: i != F.col("chosen_index"))
    ranked = F.concat(F.array(F.col("chosen_index") + 1), F.transform(others, lambda i: i + 1))
    k = F.size("eligible")
    probs = F.concat(F.array(F.lit(0.6)), F.transform(others, lambda _: 0.4 / (k - 1)))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    outcomes = F.when(
        n % 3 == 1,
        F.concat(
            F.lit(',"o":[{"v":'), F.col("value"), F.lit(',"ActionTaken":true},{"v":'),
            F.col("value") / 2, F.lit("}]"),
        ),
    ).otherwise("")
    text = F.concat(
        F.lit('{"EventId":"'), F.col("id"), F.lit('"'),
        F.when(n % 19 == 0, "").otherwise(F.concat(F.lit(',"Timestamp":"'), stamp, F.lit('"'))),
        F.lit(',"a":'), F.to_json(ranked), F.lit(',"p":'), F.to_json(probs),
        F.lit(',"c":{"User":[{"seg":"old","hour":1},'), F.col("context"), F.lit("],"),
        F.when(n % 13 == 0, '"_slots":[1],').otherwise(""),
        F.lit('"_multi":[{"_tag":"click","i":{"constant":1,"id":"x"},"T":[{"c":1}]},'
              '{"i":{"constant":1,"id":"error"}},{"id":"purchase","i":{"w":1}},{"S":{"q":2}},'
              '{"_tag":"view"}]}'),
        F.when(n % 3 == 0, F.concat(F.lit(',"_label_cost":'), -F.col("value"))).otherwise(""),
        outcomes,
        F.when(n % 11 == 0, ',"DeferredAction":true').otherwise(""),
        F.when(n % 17 == 0, ',"_skipLearn":true').otherwise(""),
        F.lit("}"),
    )
    return d.select(*KEY, "arrival", text.alias("value"))


DS = """ds AS (SELECT logp.*, CASE WHEN event_id % 13 = 0 THEN 'multislot'
    WHEN event_id % 11 = 0 AND event_id % 3 <> 1 THEN 'deferred'
    WHEN event_id % 19 = 0 THEN 'invalid' ELSE 'event' END AS status,
    CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN value * 1.5 END AS paid FROM logp)"""


def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return dsjson.parse_dsjson(dsjson_lines(spark, folder))


@query("S3_import_dsjson", LOG + f""", {DS}
SELECT capsule, id, CASE WHEN status = 'event' THEN ts_ms END AS ts_ms, status FROM ds""")
def s3(spark, folder):
    when = F.when(F.col("status") == "event", F.col("ts_ms"))
    return parsed(spark, folder).select("capsule", "id", when.alias("ts_ms"), "status")


def status_count(name: str, status: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        p = parsed(spark, folder).filter(F.col("status") == status)
        return p.groupBy("capsule").agg(F.count(F.lit(1)).alias("n"))

    query(name, LOG + f""", {DS}
SELECT capsule, count(*) AS n FROM ds WHERE status = '{status}' GROUP BY ALL""")(run)


status_count("S3a_multislot_skipped", "multislot")
status_count("S3b_deferred_skipped", "deferred")


@query("S3c_namespaces", LOG + f""", {DS}
SELECT capsule, concat('{{"User":{{"hour":', hour, ',"seg":"s', seg, '"}}}}') AS context, count(*) AS n
FROM ds WHERE status = 'event' GROUP BY ALL""")
def s3c(spark, folder):
    d = dsjson.import_decisions(parsed(spark, folder))
    return d.groupBy("capsule", "context").agg(F.count(F.lit(1)).alias("n"))


@query("S3d_action_ids", LOG + f""", {DS},
a(action, features) AS (VALUES ('click', '{{"T":{{"c":1}}}}'), ('error', '{{}}'), ('purchase', '{{"i":{{"w":1}}}}'),
  ('action3', '{{"S":{{"q":2}}}}'), ('view', '{{}}'))
SELECT capsule, action, features, count(*) AS n FROM ds, a WHERE status = 'event' GROUP BY ALL""")
def s3d(spark, folder):
    d = dsjson.import_decisions(parsed(spark, folder))
    return d.select("capsule", F.inline("actions")).groupBy(
        "capsule", F.col("id").alias("action"), "features"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("S3e_ranked_pmf", LOG + f""", {DS}
SELECT ds.capsule, ds.id, acts.idx::INT AS action,
  round(CASE WHEN idx = chosen_index THEN 0.6::DOUBLE ELSE 0.4::DOUBLE / (k - 1) END, 9) AS p,
  idx = chosen_index AS chosen
FROM ds JOIN acts ON NOT (seg = 3 AND acts.action = 'signup') WHERE status = 'event'""")
def s3e(spark, folder):
    d = dsjson.import_decisions(parsed(spark, folder))
    return d.select(
        "capsule", "id", "chosen_index",
        F.inline(F.arrays_zip(F.col("eligible").alias("action"), F.col("pmf").alias("p"))),
    ).select(
        "capsule", "id", "action", r("p", 9).alias("p"),
        (F.col("action") == F.col("chosen_index")).alias("chosen"),
    )


@query("S3f_event_reward", LOG + f""", {DS}
SELECT capsule, id AS decision_id, round(paid, 6) AS value FROM ds
WHERE status = 'event' AND paid IS NOT NULL""")
def s3f(spark, folder):
    w = dsjson.import_rewards(parsed(spark, folder), 0.0, 500.0)
    return w.select("capsule", "decision_id", r("value").alias("value"))


@query("S3g_event_time", LOG + f""", {DS}
SELECT capsule, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, sum(ts_ms % 1000)::BIGINT AS ms_total
FROM ds WHERE status = 'event' GROUP BY ALL""")
def s3g(spark, folder):
    return dsjson.import_decisions(parsed(spark, folder)).groupBy("capsule").agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.sum(F.col("ts_ms") % 1000).alias("ms_total"),
    )


@query("S3h_not_learned", LOG + f""", {DS}
SELECT capsule, event_id % 17 <> 0 AS learned, count(*) AS n FROM ds
WHERE status = 'event' AND paid IS NOT NULL GROUP BY ALL""")
def s3h(spark, folder):
    w = dsjson.import_rewards(parsed(spark, folder), 0.0, 500.0, learn=True)
    return w.groupBy("capsule", L.was_learned(F.col("detail")).alias("learned")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("S3i_import_report", LOG + f""", {DS}
SELECT count(*) AS lines, count(*) FILTER (status = 'event' AND event_id % 4 <> 0) AS decisions,
  count(*) FILTER (status = 'event' AND paid IS NOT NULL AND event_id % 4 <> 0) AS rewards,
  count(*) FILTER (status = 'event' AND event_id % 4 = 0) AS already_present,
  count(*) FILTER (status = 'deferred') AS skipped_deferred,
  count(*) FILTER (status = 'multislot') AS skipped_multislot,
  count(*) FILTER (status = 'invalid') AS invalid FROM ds""")
def s3i(spark, folder):
    p = checkpointed(parsed(spark, folder))
    d = dsjson.import_decisions(p)
    w = dsjson.import_rewards(p, 0.0, 500.0)
    stored = d.filter(F.col("arrival") % 4 == 0)
    paid = I.next_seq(w.filter(F.col("arrival") % 4 == 0))
    return dsjson.import_report(
        p, I.ingest_decisions(d, stored), I.ingest_rewards(w, d, paid)
    )


@query("S4_decision_export", LOG + """,
n AS (SELECT capsule, decision_id, count(*) AS n, arg_min(value, seq) AS first,
  arg_max(idempotency_key, seq) AS last_key FROM rw GROUP BY ALL)
SELECT logp.capsule, logp.id, ts_ms::VARCHAR AS ts, chosen_id AS action, coalesce(n, 0)::INT AS n_rewards,
  round(first, 6) AS first_reward, last_key, event_id::VARCHAR AS seed
FROM logp LEFT JOIN n ON n.capsule = logp.capsule AND n.decision_id = logp.id""")
def s4(spark, folder):
    out = exports.export_decisions(event_decisions(spark, folder), event_rewards(spark, folder))
    doc = F.from_json(
        "value",
        "tsMs string, action string, seed string, "
        "rewards array<struct<reward:double,idempotencyKey:string>>",
    )
    return out.select("capsule", "id", doc.alias("d")).select(
        "capsule", "id", F.col("d.tsMs").alias("ts"), F.col("d.action").alias("action"),
        F.size("d.rewards").alias("n_rewards"),
        r(F.get("d.rewards", F.lit(0))["reward"]).alias("first_reward"),
        F.get("d.rewards", F.size("d.rewards") - 1)["idempotencyKey"].alias("last_key"),
        F.col("d.seed").alias("seed"),
    )


@query("S5_read_uploads", LOG + """
SELECT capsule, id, ts_ms, event_id AS seed, chosen_id, round(probability, 9) AS probability,
  CASE WHEN event_id % 21 = 1 THEN 'seed_invalid' END AS problem FROM logp WHERE NOT legacy""")
def s5(spark, folder):
    d = event_decisions(spark, folder).filter(F.col("pmf").isNotNull()).withColumns(
        {"model_tag": F.lit("t"), "excluded_ids": F.lit(None).cast("array<string>")}
    )
    seed = F.when(F.col("arrival") % 21 == 1, "x").otherwise(F.col("seed").cast("string"))
    got = logs.parse_uploaded_decisions(upload_lines(d.withColumn("seed", seed)))
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    return got.select(
        "capsule", "id", "ts_ms", F.coalesce("seed", n).alias("seed"), "chosen_id",
        r("probability", 9).alias("probability"), "problem",
    )

