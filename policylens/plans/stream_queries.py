"""Streaming forms, run over a table as a file stream until it is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylens.operators.validate import upload_window
from policylens.plans import nag_sql as N
from policylens.plans.learn_queries import BITS, SPEC, upload_fixture, upload_lines
from policylens.plans.log_queries import LOG, MEANS, NOW, with_means
from policylens.plans.registry import query, r, rounded
from policylens.plans.sample_log import event_decisions, event_rewards
from policylens.schema import DECISIONS, KEY, REWARDS
from policylens.session import shared_folder, written
from policylens.streaming import ingest as S
from policylens.streaming.timers import with_timers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def as_stream(df: DataFrame, name: str) -> DataFrame:
    """The rows of a batch table as a file stream; the tests feed several micro-batches."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


#: Files that make a micro-batch of `in_batches` at least, each written by a task of its own, and rows of a file, about.
FILES, FILE_ROWS = 4, 50_000


def in_batches(df: DataFrame, name: str, order: str, cuts: int, last: DataFrame | None = None) -> DataFrame:
    """The rows as a file stream of about `cuts` micro-batches that follow each other by `order` (nulls in the first).

    `last` comes after all others.  The rows are computed once; a micro-batch has more files with more rows, so that its
    reading spreads over the cluster.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    rows = written(df, f"{name}-rows")
    files = max(FILES, -(-rows.count() // (cuts * FILE_ROWS)))
    bounds = rows.approxQuantile(order, [k / cuts for k in range(1, cuts)], 0.01) if cuts > 1 else []
    at = sum((F.when(F.col(order) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    for k in range(cuts):
        rows.filter(at == k).repartition(files).write.mode("append").parquet(path)
    if last is not None:
        last.select(*df.columns).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream until its source is used up; the rows it wrote."""
    spark = df.sparkSession
    out, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")
    q = (
        df.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def drain_batches(df: DataFrame, run, name: str) -> None:
    state = shared_folder(df.sparkSession, f"{name}-state")
    q = (
        df.writeStream.foreachBatch(run)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def ingest_events(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions and rewards in one arrival order, a reward right after its decision; every
    20th decision and every 15th reward is sent again at the end."""
    d = event_decisions(spark, folder)
    w = event_rewards(spark, folder)
    n = F.floor(F.col("seq") / 2)
    d = d.select(
        F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DECISIONS.fields]).alias(
            "decision"
        ),
        (F.col("arrival") * 4).alias("arrival"), F.col("arrival").alias("n"),
    )
    w = w.select(
        F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REWARDS.fields]).alias(
            "reward"
        ),
        (n * 4 + 1 + F.col("seq") % 2).alias("arrival"), n.alias("n"),
    )
    both = d.unionByName(w, allowMissingColumns=True)
    again = both.filter(
        (F.col("decision").isNotNull() & (F.col("n") % 20 == 0))
        | (F.col("reward").isNotNull() & (F.col("n") % 15 == 0))
    ).withColumn("arrival", F.col("arrival") + 10**10)
    return both.unionByName(again).select("decision", "reward", "arrival")


@query("T1_stream_ingest", LOG + """
SELECT 'decision' AS kind, capsule, count(*) AS n, NULL::BIGINT AS last FROM log GROUP BY ALL
UNION ALL SELECT 'reward', rw.capsule, count(*), count(*) FROM rw
JOIN log ON log.capsule = rw.capsule AND log.id = rw.decision_id GROUP BY ALL""")
def t1(spark, folder):
    """Five micro-batches and more; later ones repeat decisions and rewards of earlier ones."""
    stream = in_batches(ingest_events(spark, folder), "t1-in", "arrival", 5)
    root = shared_folder(spark, "t1")
    drain_batches(stream, S.ingest_batch(root), "t1")
    d, w = (h.all() for h in S.histories(spark, root))
    nd = d.groupBy(F.lit("decision").alias("kind"), "capsule").agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("last")
    )
    nw = w.groupBy(F.lit("reward").alias("kind"), "capsule").agg(
        F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")
    )
    return nd.unionByName(nw)


@query("T2_stream_join", LOG + """
SELECT logp.capsule, logp.id, rw.seq, round(rw.value, 6) AS value
FROM logp LEFT JOIN rw ON rw.capsule = logp.capsule AND rw.decision_id = logp.id
  AND rw.ts_ms BETWEEN logp.ts_ms AND logp.ts_ms + 600000""")
def t2(spark, folder):
    stamp = F.timestamp_millis("ts_ms").alias("ts")
    d = event_decisions(spark, folder).select(*KEY, "id", stamp, "arrival")
    w = event_rewards(spark, folder).select(*KEY, "decision_id", stamp, "value", "seq")
    # a last event far ahead moves both watermarks past every wait
    far = F.timestamp_millis(F.lit(4102444800000))
    d = d.unionByName(_flush(d, far, "arrival"))
    w = w.unionByName(_flush(w, far, "seq"))
    left = as_stream(d, "t2-d")
    right = as_stream(w, "t2-w")
    out = drain(S.join_streams(left, right, "600 seconds"), "t2")
    return out.filter(F.col("capsule") != "flush").select(
        "capsule", "id", "seq", r("value").alias("value")
    )


def _flush(df: DataFrame, far, order: str) -> DataFrame:
    """One row per table in a capsule of its own, later than everything else."""
    top = df.agg(F.max(order).alias(order))
    return top.select(
        *[
            (F.col(order) + 1).alias(c) if c == order
            else far.alias(c) if c == "ts"
            else F.lit("flush").cast(df.schema[c].dataType).alias(c)
            if df.schema[c].dataType.simpleString() == "string"
            else F.lit(None).cast(df.schema[c].dataType).alias(c)
            for c in df.columns
        ]
    )


T3_SQL = LOG + """,
dec AS (SELECT *, event_id % 4 = 1 AS deferred, event_id % 8 = 1 AS activated FROM logp),
live AS (SELECT * FROM dec WHERE NOT deferred OR activated),
paid AS (SELECT live.capsule, live.id, min(rw.ts_ms) AS t, arg_min(rw.value, rw.ts_ms) AS v FROM live JOIN rw
  ON rw.capsule = live.capsule AND rw.decision_id = live.id AND rw.seq % 2 = 0
  WHERE rw.ts_ms <= live.ts_ms + 600000 GROUP BY ALL)
SELECT capsule, id, 'decision' AS kind, ts_ms, NULL::DOUBLE AS value FROM live
UNION ALL SELECT live.capsule, live.id, 'reward', t, round(v, 6) FROM live JOIN paid
  ON paid.capsule = live.capsule AND paid.id = live.id
UNION ALL SELECT live.capsule, live.id, 'default_reward', live.ts_ms + 600000, 5.0 FROM live
  LEFT JOIN paid ON paid.capsule = live.capsule AND paid.id = live.id WHERE paid.id IS NULL
UNION ALL SELECT rw.capsule, decision_id, 'unmatched', ts_ms, round(value, 6) FROM rw
  WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.capsule = rw.capsule AND log.id = rw.decision_id)"""


def timer_events(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions, a quarter of them deferred, half of those activated, and all their rewards."""
    n = F.col("arrival")
    d = event_decisions(spark, folder)
    none = F.lit(None).cast("double").alias("value")
    idem = F.lit(None).cast("string").alias("idempotency_key")
    made = d.select(
        *KEY, "id", F.when(n % 4 == 1, "deferred").otherwise("decision").alias("kind"), "ts_ms",
        none, idem,
    )
    acts = d.filter(n % 8 == 1).select(
        *KEY, "id", F.lit("activation").alias("kind"), (F.col("ts_ms") + 1000).alias("ts_ms"),
        none, idem,
    )
    paid = event_rewards(spark, folder).select(
        *KEY, F.col("decision_id").alias("id"), F.lit("reward").alias("kind"), "ts_ms", "value",
        "idempotency_key",
    )
    return made.unionByName(acts).unionByName(paid).withColumn("ts", F.timestamp_millis("ts_ms"))


def _timed(spark: SparkSession, events: DataFrame, cuts: int, mode: str = "first") -> DataFrame:
    """The timers over a stream of `cuts` micro-batches that follow each other in time, written by many tasks."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    far = F.timestamp_millis(F.lit(4102444800000))
    last = _flush(events.drop("ts_ms").withColumn("order", F.lit(0)), far, "order").drop("order")
    last = last.withColumn("ts_ms", F.lit(4102444800000)).withColumn("kind", F.lit("decision")).select(*events.columns)
    stream = in_batches(events, "t3-in", "ts_ms", cuts, last)
    out = drain(with_timers(stream, 5.0, 600, mode), "t3")
    return out.filter(F.col("capsule") != "flush").select(
        "capsule", "id", "kind", "ts_ms", r("value").alias("value")
    )


@query("T3_reward_timers", T3_SQL)
def t3(spark, folder):
    return _timed(spark, timer_events(spark, folder), 4)


@query("T3_reward_timers_one_batch", T3_SQL)
def t3_one(spark, folder):
    return _timed(spark, timer_events(spark, folder), 1)


#: Every fifth reward comes days late.
LATE = "(rw.event_id % 5) * 43200000::BIGINT * (rw.event_id % 3)"


@query("T3_late_rewards", LOG + f""",
dec AS (SELECT *, event_id % 4 = 1 AS deferred, event_id % 8 = 1 AS activated FROM logp),
live AS (SELECT * FROM dec WHERE NOT deferred OR activated),
paid AS (SELECT rw.capsule, rw.decision_id AS id, rw.ts_ms + {LATE} AS t, rw.value, live.ts_ms + 600000 AS due,
    live.id IS NOT NULL AS met, log.id IS NOT NULL AS known
  FROM rw LEFT JOIN live ON live.capsule = rw.capsule AND live.id = rw.decision_id
  LEFT JOIN log ON log.capsule = rw.capsule AND log.id = rw.decision_id)
SELECT capsule, id, 'decision' AS kind, ts_ms, NULL::DOUBLE AS value FROM live
UNION ALL SELECT capsule, id, CASE WHEN t <= due + 86400000 THEN 'reward' ELSE 'unmatched' END, t, round(value, 6) FROM paid WHERE met
UNION ALL SELECT capsule, id, 'unmatched', t, round(value, 6) FROM paid WHERE NOT known
UNION ALL SELECT paid.capsule, paid.id, 'unmatched', t, round(paid.value, 6) FROM paid JOIN log ON log.capsule = paid.capsule AND log.id = paid.id
  WHERE known AND NOT met AND t >= log.ts_ms + 86400000
UNION ALL SELECT live.capsule, live.id, 'default_reward', live.ts_ms + 600000, 5.0 FROM live
  WHERE NOT EXISTS (SELECT 1 FROM paid WHERE paid.capsule = live.capsule AND paid.id = live.id AND t <= due)""")
def t3_late(spark, folder):
    """Rewards that add up, many of them days late: all of them leave the stream, matched or not."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    late = F.when(F.col("kind") == "reward", n % 5 * F.lit(43200000).cast("bigint") * (n % 3)).otherwise(0)
    events = timer_events(spark, folder).withColumn("ts_ms", F.col("ts_ms") + late).withColumn("ts", F.timestamp_millis("ts_ms"))
    return _timed(spark, events, 4, "sum")


@query("T4_stream_dedupe", LOG + """
SELECT capsule, count(*) AS n, round(sum(value), 4) AS total FROM rw GROUP BY ALL""")
def t4(spark, folder):
    w = event_rewards(spark, folder)
    w = w.unionByName(w.filter(F.col("seq") % 5 == 0)).withColumn("ts", F.timestamp_millis("ts_ms"))
    stream = as_stream(w, "t4-in")
    out = drain(S.dedupe_stream(stream, "ts", "2 days"), "t4")
    return out.groupBy("capsule").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total")
    )


@query("T5_upload_window_stream", LOG + f"""
SELECT capsule, ts_ms BETWEEN {NOW} - 7 * 24 * 3600 * 1000::BIGINT AND {NOW} + 300000 AS on_time,
  count(*) AS n FROM log GROUP BY ALL""")
def t5(spark, folder):
    stream = as_stream(event_decisions(spark, folder).select(*KEY, "id", "ts_ms"), "t5-in")
    out = drain(upload_window(stream, int(NOW)), "t5")
    return out.groupBy("capsule", "on_time").agg(F.count(F.lit(1)).alias("n"))


@query("T6_incremental_model", N.models(BITS) + """,
top AS (SELECT rw.capsule, max(seq) AS reward_seq FROM rw JOIN logp ON logp.capsule = rw.capsule AND logp.id = rw.decision_id GROUP BY ALL)
SELECT model.capsule, n AS n_updates, reward_seq, slot, round(slots.u::DOUBLE, 4) AS u, round(slots.s::DOUBLE, 4) AS s, round(slots.a::DOUBLE, 3) AS a
FROM model JOIN top ON top.capsule = model.capsule JOIN slots ON slots.capsule = model.capsule""")
def t6(spark, folder):
    """Models learned over four micro-batches, each from the snapshot before: the weights of learning in one go."""
    d = event_decisions(spark, folder).drop("ts_ms", "arrival")
    w = event_rewards(spark, folder).withColumnRenamed("decision_id", "id")
    stream = in_batches(w.join(d, [*KEY, "id"]), "t6-in", "seq", 4)
    root = shared_folder(spark, "t6")
    drain_batches(stream, S.learn_batch(root, SPEC), "t6")
    heads, slots = S.current_models(spark, root)
    weights = slots.select(*KEY, "slot", *[r(F.col(c).cast("double"), n).alias(c) for c, n in (("u", 4), ("s", 4), ("a", 3))])
    return heads.join(weights, KEY).select("capsule", "n_updates", "reward_seq", "slot", "u", "s", "a")


@query("S5_upload_stream", LOG + f""",
sent AS (SELECT capsule, id, event_id, CASE WHEN event_id % 21 = 1 THEN 'seed_invalid'
    WHEN NOT (ts_ms BETWEEN {NOW} - 7 * 24 * 3600 * 1000::BIGINT AND {NOW} + 300000) THEN 'outside_upload_window' END AS why FROM log),
paid AS (SELECT rw.capsule, rw.decision_id, rw.seq, sent.id IS NOT NULL AND why IS NULL AS known
  FROM rw LEFT JOIN sent ON sent.capsule = rw.capsule AND sent.id = rw.decision_id)
SELECT 'decision' AS item, capsule, 'stored' AS why, count(*) AS n FROM sent WHERE why IS NULL GROUP BY ALL
UNION ALL SELECT 'decision', capsule, why, count(*) FROM sent WHERE why IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'reward', capsule, 'stored', count(DISTINCT decision_id) FROM paid WHERE known GROUP BY ALL
UNION ALL SELECT 'reward', capsule, 'unknown_decision', count(*) FROM paid WHERE NOT known GROUP BY ALL
UNION ALL SELECT 'reward', capsule, 'value_missing', count(*) FROM rw WHERE event_id % 11 = 0 AND seq % 2 = 0 GROUP BY ALL""")
def s5_stream(spark, folder):
    """Uploads of decisions and rewards in three micro-batches, bad items among good ones, to store and quarantine."""
    decided, models, slots = upload_fixture(spark, folder)
    seed = F.when(F.col("arrival") % 21 == 1, "x").otherwise(F.col("seed").cast("string"))
    made = upload_lines(decided.withColumn("seed", seed)).select(*KEY, (F.col("arrival") * 4).alias("arrival"), F.lit(int(NOW)).alias("ts_ms"), "value")
    n = F.floor(F.col("seq") / 2)
    item = F.struct(F.col("decision_id").alias("decisionId"), F.col("value").alias("reward"), F.col("idempotency_key").alias("idempotencyKey"))
    bad = F.struct(F.col("decision_id").alias("decisionId"), F.lit(None).cast("double").alias("reward"), F.lit("k").alias("idempotencyKey"))
    items = F.when((n % 11 == 0) & (F.col("seq") % 2 == 0), F.array(bad, item)).otherwise(F.array(item))
    paid = event_rewards(spark, folder).select(
        *KEY, (F.col("seq") * 2 + 1).alias("arrival"), F.lit(int(NOW)).alias("ts_ms"), F.to_json(F.struct(items.alias("rewards"))).alias("value")
    )
    stream = in_batches(made.unionByName(paid), "s5-in", "arrival", 3)
    root = shared_folder(spark, "s5")
    drain_batches(stream, S.upload_batch(root, models, slots, SPEC, int(NOW)), "s5")
    d, w = (h.all() for h in S.histories(spark, root))
    bad_items = spark.read.schema(S.QUARANTINE).parquet(f"{root}/quarantine").select("item", "capsule", "why")
    good = [df.select(F.lit(item).alias("item"), "capsule", F.lit("stored").alias("why")) for item, df in (("decision", d), ("reward", w))]
    return bad_items.unionByName(good[0]).unionByName(good[1]).groupBy("item", "capsule", "why").agg(F.count(F.lit(1)).alias("n"))


@query("T7_best_share_windows", LOG + f""", {MEANS}
SELECT epoch_us(time_bucket(INTERVAL 10 SECOND, ts)) // 1000 AS start_ms, count(*) AS n,
  round(sum(got) / nullif(sum(best), 0), 6) AS share FROM mn GROUP BY ALL""")
def t7(spark, folder):
    d = with_means(event_decisions(spark, folder)).withColumn("ts", F.timestamp_millis("ts_ms"))
    got = F.get("means", F.col("chosen_index"))
    d = d.select("tenant", "ts_ms", "ts", got.alias("got"), F.array_max("means").alias("best"))
    far = F.timestamp_millis(F.lit(4102444800000))
    d = d.unionByName(_flush(d, far, "ts_ms"))
    stream = as_stream(d, "t7-in")
    out = drain(
        S.best_share(stream, F.col("ts"), F.col("got"), F.col("best"), "10 minutes"), "t7"
    )
    return rounded(
        out.select(F.unix_millis("start").alias("start_ms"), "n", "share").filter(
            F.col("start_ms") < 4102444800000
        )
    )

