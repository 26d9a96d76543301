"""Structured Streaming forms of ingest, joins and learning.

Every micro-batch writes its own `batch=<id>` folder with overwrite and reads only the folders
of earlier batches, so a batch that is run again after a failure replaces exactly its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylens.functions.features import featurize
from policylens.operators.ingest import ingest_decisions, ingest_rewards, last_seq
from policylens.operators.joins import rewards_since
from policylens.operators.learner import fold_models
from policylens.operators import specs as P
from policylens.operators.uploads import verify_uploads
from policylens.schema import DECISIONS, KEY, MODEL_HEADER, MODEL_SLOTS, REWARDS, UNVERIFIED
from policylens.session import checkpointed
from policylens.sources.logs import parse_uploaded_decisions, parse_uploaded_rewards
from policylens.spec import PolicySpec
from policylens.streaming.history import History


def numbered(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """Rows of the batches before `batch_id` with their `batch`; empty when there is none."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    if batch_id == 0:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path).filter(F.col("batch") < batch_id)


def earlier(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """Rows of the batches before `batch_id`; empty when there is none."""
    return numbered(spark, path, batch_id, schema).drop("batch")


def write_batch(df: DataFrame, path: str, batch_id: int, schema: T.StructType) -> None:
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def histories(spark: SparkSession, root: str) -> tuple[History, History]:
    """Where a stream keeps decisions, by id, and rewards, by idempotency key."""
    return (
        History(spark, f"{root}/decisions", DECISIONS, [*KEY, "id"]),
        History(spark, f"{root}/rewards", REWARDS, [*KEY, "idempotency_key"]),
    )


#: The highest sequence number of each capsule after a batch, for those that the batch gave numbers.
MARKS = T.StructType([*[T.StructField(k, T.StringType()) for k in KEY], T.StructField("last_seq", T.LongType())])


def ingest_batch(root: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: decisions first, then the rewards that name them.

    The stream's rows hold `arrival` and either `decision` or `reward`, structs with the stored
    columns.  Earlier rows are looked up by key (see `history`): a batch reads the folders that may hold its own
    ids and keys, and of the sequence numbers one row per capsule.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        decisions, rewards = histories(spark, root)
        batch = checkpointed(batch)  # read by lookups and writes
        new = batch.filter("decision is not null").select("decision.*", "arrival")
        paid = batch.filter("reward is not null").select("reward.*", "arrival")
        named = paid.select(*KEY, F.col("decision_id").alias("id"))
        old = decisions.near(new.select(*KEY, "id").unionByName(named), batch_id)
        stored = decisions.write(ingest_decisions(new, old).filter("outcome = 'inserted'"), batch_id)
        known = old.select(*KEY, "id").unionByName(stored.select(*KEY, "id"))
        marks = last_marks(spark, f"{root}/marks", batch_id)
        applied = ingest_rewards(paid, known, rewards.near(paid, batch_id), last=marks).filter("outcome = 'applied'")
        given = rewards.write(applied, batch_id)
        # marks of all capsules so far, so that the next batch reads this batch's folder only
        write_batch(last_seq(given).unionByName(marks).groupBy(*KEY).agg(F.max("last_seq").alias("last_seq")), f"{root}/marks", batch_id, MARKS)

    return run


def last_marks(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The marks that the batch before left."""
    if not batch_id:
        return spark.createDataFrame([], MARKS)
    return spark.read.schema(MARKS).parquet(f"{path}/batch={batch_id - 1}")


#: The model in force of every capsule, and the batch that wrote its slots.
POINTERS = T.StructType([*MODEL_HEADER.fields, T.StructField("of_batch", T.LongType())])


def pointers(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The models in force before a batch: one row per capsule, in one folder."""
    if not batch_id:
        return spark.createDataFrame([], POINTERS)
    return spark.read.schema(POINTERS).parquet(f"{root}/pointers/batch={batch_id - 1}")


def learn_batch(root: str, spec: PolicySpec | DataFrame) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that learns from a batch of joined rewards.

    The batch holds one row per applied reward with its decision (see `fold_models`); each
    batch writes one snapshot per capsule that learned something, and the table of all capsules' models in force.  It
    reads that table as the batch before left it, and the slots of its own capsules from the folders named there;
    no other header or slot.  A batch that is run again replaces its own folders.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = pointers(spark, root, batch_id)
        here = batch.select(*KEY).distinct()
        last = checkpointed(before.join(here, KEY, "left_semi"))
        folders = [f"{root}/slots/batch={row['of_batch']}" for row in last.select("of_batch").distinct().collect()]
        now = spark.read.schema(MODEL_SLOTS).parquet(*folders) if folders else spark.createDataFrame([], MODEL_SLOTS)
        now = now.join(last.select(*KEY, "version"), [*KEY, "version"], "left_semi")
        header, learned = fold_models(featurize(batch), spec, now, last.drop("of_batch"))
        write_batch(header, f"{root}/headers", batch_id, MODEL_HEADER)
        versions = header.select(*KEY, "version")
        write_batch(learned.join(versions, KEY), f"{root}/slots", batch_id, MODEL_SLOTS)
        new = header.withColumn("of_batch", F.lit(batch_id))
        kept = before.join(versions, KEY, "left_anti")
        write_batch(new.unionByName(kept), f"{root}/pointers", batch_id, POINTERS)

    return run


def current_models(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Headers and slots of the models in force after the last batch."""
    batches = numbered_folders(spark, f"{root}/pointers")
    heads = pointers(spark, root, max(batches, default=-1) + 1)
    slots = spark.read.schema(T.StructType([*MODEL_SLOTS.fields, T.StructField("batch", T.LongType())])).parquet(f"{root}/slots")
    held = heads.select(*KEY, "version", F.col("of_batch").alias("batch"))
    return heads.drop("of_batch"), slots.join(held, [*KEY, "version", "batch"], "left_semi").drop("batch")


def numbered_folders(spark: SparkSession, path: str) -> list[int]:
    """The batches that wrote whole folders under a path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{path}/batch=*/_SUCCESS"))
    return [int(f.getPath().getParent().getName().split("=")[1]) for f in found or []]


def upload_batch(
    root: str, models: DataFrame, slots: DataFrame, spec: PolicySpec | DataFrame, now_ms: int
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function over lines of uploads (KEY, arrival, ts_ms, value): decisions and rewards.

    Decisions are replayed on the models their tags name (L6) and join the stored ones if new or unverified; rewards then
    join the decisions they name, under the key of their capsule's mode (E2, E4).  Every item is judged on its own: what is
    refused goes to `quarantine` with its reason, the items beside it do not.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        decisions, rewards = histories(spark, root)
        batch = checkpointed(batch)
        sent = checkpointed(parse_uploaded_decisions(batch.drop("ts_ms")))
        paid = P.with_settings(parse_uploaded_rewards(batch), spec)
        own = F.col("settings")
        unit = (F.col("value") - own["low"]) / (own["high"] - own["low"])
        fresh = F.concat_ws(":", "decision_id", F.lpad(F.hex(F.xxhash64("decision_id", "value", "arrival", "position")), 16, "0"))
        key = F.when(own["rewards"] == "first", F.col("decision_id")).otherwise(F.coalesce("given_key", fresh))
        paid = checkpointed(
            paid.withColumn("value_norm", F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0))).withColumn("idempotency_key", key)
            .withColumn("arrival", F.col("arrival") * MOST_ITEMS + F.col("position")).drop("settings", "given_key", "position")
        )
        ids = sent.select(*KEY, "id").unionByName(paid.select(*KEY, F.col("decision_id").alias("id")))
        old = checkpointed(decisions.near(ids.filter("id is not null"), batch_id))
        judged = checkpointed(verify_uploads(sent, old, models, slots, spec, now_ms))
        new = judged.filter(F.col("status").isin("new", "unverified")).withColumns({
            "mode": F.when(F.col("status") == "unverified", UNVERIFIED).otherwise("learner"), "derived": F.lit("{}"),
            "reason": F.lit(None).cast("string"), "program_sha256": F.lit(None).cast("string"),
        })
        stored = decisions.write(new, batch_id)
        known = old.select(*KEY, "id").unionByName(stored.select(*KEY, "id"))
        marks = last_marks(spark, f"{root}/marks", batch_id)
        readable = paid.filter("item_problem is null").drop("item_problem")
        outcomes = checkpointed(ingest_rewards(readable, known, rewards.near(readable, batch_id), last=marks))
        given = rewards.write(outcomes.filter("outcome = 'applied'"), batch_id)
        write_batch(last_seq(given).unionByName(marks).groupBy(*KEY).agg(F.max("last_seq").alias("last_seq")), f"{root}/marks", batch_id, MARKS)
        bad = judged.filter("status = 'rejected'").select(*KEY, F.lit("decision").alias("item"), F.col("id"), F.col("why"))
        bad = bad.unionByName(outcomes.filter(F.col("outcome").isin("invalid", "unknown_decision")).select(
            *KEY, F.lit("reward").alias("item"), F.col("decision_id").alias("id"), F.coalesce("problem", "outcome").alias("why")
        )).unionByName(paid.filter("item_problem is not null").select(
            *KEY, F.lit("reward").alias("item"), F.col("decision_id").alias("id"), F.col("item_problem").alias("why")
        ))
        write_batch(bad, f"{root}/quarantine", batch_id, QUARANTINE)

    return run


#: Arrival numbers that are kept free for the rewards of one line.
MOST_ITEMS = 1 << 20
QUARANTINE = T.StructType([T.StructField(c, T.StringType()) for c in (*KEY, "item", "id", "why")])


def later_rewards(rewards: DataFrame, decisions: DataFrame, mark: int) -> DataFrame:
    """The joined rewards after a watermark, as `learn_batch` takes them."""
    return rewards_since(rewards, decisions, mark)


def dedupe_stream(rewards: DataFrame, event_time: str, horizon: str) -> DataFrame:
    """Drop repeats of an idempotency key that arrive within `horizon` (T4)."""
    return rewards.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(
        [*KEY, "idempotency_key"]
    )


def join_streams(
    decisions: DataFrame, rewards: DataFrame, wait: str, lateness: str = "10 minutes"
) -> DataFrame:
    """Each decision with the rewards that come within `wait`, or with none.

    Both inputs carry an event-time column `ts`.  Either side may come first; state is dropped
    once the watermarks pass the wait.
    """
    left = decisions.withWatermark("ts", lateness).alias("d")
    right = (
        rewards.withColumnRenamed("ts", "reward_ts")
        .withWatermark("reward_ts", lateness)
        .withColumnRenamed("decision_id", "id")
        .alias("r")
    )
    on = F.expr(
        f"d.id = r.id and d.reward_ts_key = r.reward_ts_key and r.reward_ts >= d.ts "
        f"and r.reward_ts <= d.ts + interval {wait}"
    )
    left = left.withColumn("reward_ts_key", F.struct(*[F.col(f"d.{k}") for k in KEY])).alias("d")
    right = right.withColumn("reward_ts_key", F.struct(*[F.col(f"r.{k}") for k in KEY])).alias("r")
    return left.join(right, on, "left_outer").select(
        *[F.col(f"d.{k}").alias(k) for k in KEY], F.col("d.id").alias("id"),
        F.col("d.ts").alias("ts"), F.col("r.reward_ts").alias("reward_ts"),
        *[F.col(f"r.{c}").alias(c) for c in rewards.columns if c not in (*KEY, "decision_id", "ts")],
    )


def best_share(df: DataFrame, ts: Column, got: Column, best: Column, lateness: str) -> DataFrame:
    """Share of the best possible expected reward per 10-second window."""
    rows = df.select(ts.alias("ts"), got.alias("got"), best.alias("best"))
    if df.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", "10 seconds")).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum("got"), F.sum("best")).alias("share"),
    ).select(F.col("window.start").alias("start"), "n", "share")
