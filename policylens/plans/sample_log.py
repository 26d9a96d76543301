"""Decision logs derived from the generic tables, for queries, bench and tests.

Every log grows with its source table: one decision per event or per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Actions of the event log, in index order, with their features.
EVENT_ACTIONS = [
    ("click", 0.1), ("error", 0.9), ("purchase", 0.2), ("signup", 0.4), ("view", 0.05),
]
REWARD_RANGE = (0.0, 500.0)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a table that one task works on, about.
PIECE_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """A table in pieces of about `PIECE_ROWS` rows, in as many as there are cores at least.

    How many pieces a scan has says little: a large row group is one task's work, however finely its file is split.
    The rows of a Parquet table are counted from the files' footers.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PIECE_ROWS)))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def event_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """One decision per event: three capsules, five actions, a favourite per segment."""
    seg = F.col("user_id") % 4
    fourth = seg == 3
    names = F.array(*[F.lit(n) for n, _ in EVENT_ACTIONS])
    actions = F.array(
        *[
            F.struct(F.lit(n).alias("id"), F.lit(f'{{"cost":{c}}}').alias("features"))
            for n, c in EVENT_ACTIONS
        ]
    )
    favourite = F.element_at(F.array(*[F.lit(i) for i in (0, 1, 2, 4)]), (seg + 1).cast("int"))
    k = F.when(fourth, 4).otherwise(5)
    other = F.lit(0.6) / (k - 1)
    chosen = (F.array_position(names, F.col("event_type")) - 1).cast("int")

    def pmf(indices: tuple[int, ...]) -> Column:
        return F.array(
            *[F.when(F.lit(i) == F.col("favourite"), F.lit(0.4)).otherwise(other) for i in indices]
        )

    every, three = (0, 1, 2, 3, 4), (0, 1, 2, 4)
    legacy = F.col("event_id") % 40 == 3
    events = spread(table(spark, folder, "events")).filter(~(fourth & (F.col("event_type") == "signup")))
    return (
        events.withColumn("favourite", favourite)
        .select(
            F.lit("acme").alias("tenant"),
            F.lit("default").alias("job"),
            F.concat(F.lit("router"), F.col("user_id") % 3).alias("capsule"),
            F.concat(F.lit("dec_"), F.col("event_id")).alias("id"),
            epoch_ms(F.col("ts")).alias("ts_ms"),
            F.floor(F.col("event_id") / 100).alias("model_version"),
            F.when(F.col("event_id") % 50 == 1, "unverified").otherwise("learner").alias("mode"),
            F.concat(
                F.lit('{"hour":'), F.hour("ts"), F.lit(',"seg":"s'), seg, F.lit('"}')
            ).alias("context"),
            actions.alias("actions"),
            F.when(fourth, F.array(*[F.lit(i) for i in three]))
            .otherwise(F.array(*[F.lit(i) for i in every]))
            .alias("eligible"),
            F.when(~legacy, F.when(fourth, pmf(three)).otherwise(pmf(every))).alias("pmf"),
            chosen.alias("chosen_index"),
            F.col("event_type").alias("chosen_id"),
            F.when(~legacy, F.when(chosen == F.col("favourite"), 0.4).otherwise(other)).alias(
                "probability"
            ),
            F.col("event_id").alias("seed"),
            F.lit("{}").alias("derived"),
            F.lit(None).cast("string").alias("reason"),
            F.sha2(F.concat(F.lit("request "), F.col("event_id")), 256).alias("request_sha256"),
            F.lit(None).cast("string").alias("program_sha256"),
            F.col("event_id").alias("arrival"),
        )
    )


def event_rewards(spark: SparkSession, folder: str) -> DataFrame:
    """A reward for nine of ten events, and half of it again for one in seven."""
    events = table(spark, folder, "events").filter(F.col("event_id") % 10 != 0)
    low, high = REWARD_RANGE
    nth = F.explode(F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    ))
    value = F.when(F.col("nth") == 0, F.col("value")).otherwise(F.col("value") / 2)
    did = F.concat(F.lit("dec_"), F.col("event_id"))
    norm = F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return events.select("*", nth.alias("nth")).select(
        F.lit("acme").alias("tenant"),
        F.lit("default").alias("job"),
        F.concat(F.lit("router"), F.col("user_id") % 3).alias("capsule"),
        did.alias("decision_id"),
        (F.col("event_id") * 2 + F.col("nth")).alias("seq"),
        (epoch_ms(F.col("ts")) + 1000 * (F.col("event_id") % 1200)).alias("ts_ms"),
        value.alias("value"),
        norm.alias("value_norm"),
        F.when(F.col("nth") == 0, did).otherwise(F.concat(did, F.lit(":2"))).alias(
            "idempotency_key"
        ),
        F.col("props").alias("detail"),
    )


def document_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """One decision per document: the source is the action, the label the reward.

    The actions are the sources that the documents have.
    """
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    found = docs.select("source").distinct().filter("source is not null").collect()
    names = sorted(row["source"] for row in found)
    sources = len(names)
    actions = F.array(
        *[F.struct(F.lit(n).alias("id"), F.lit("{}").alias("features")) for n in names]
    )
    chosen = (
        F.array_position(F.array(*[F.lit(n) for n in names]), F.col("source")) - 1
    ).cast("int")
    return docs.join(labels, "doc_id", "left").select(
        F.lit("acme").alias("tenant"),
        F.lit("default").alias("job"),
        F.lit("docs").alias("capsule"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"),
        F.col("doc_id").alias("ts_ms"),
        F.lit("learner").alias("mode"),
        F.concat(F.lit('{"seg":"'), F.col("lang"), F.lit('"}')).alias("context"),
        F.lit("{}").alias("derived"),
        actions.alias("actions"),
        F.array(*[F.lit(i) for i in range(sources)]).alias("eligible"),
        F.array(*[F.lit(1.0 / sources) for _ in range(sources)]).alias("pmf"),
        chosen.alias("chosen_index"),
        F.col("source").alias("chosen_id"),
        F.lit(1.0 / sources).alias("probability"),
        F.col("quality").cast("double").alias("reward"),
        F.col("doc_id").alias("arrival"),
    )
