"""Streams in several micro-batches, replays of a batch, and timers."""

import os

import pytest
from pyspark.sql import functions as F
from test_log import decision, decisions, reward, rewards

from policylens.plans.stream_queries import ROCKS
from policylens.schema import DECISIONS, KEY
from policylens.streaming.history import History
from policylens.streaming.ingest import histories, ingest_batch
from policylens.streaming.timers import with_timers


def events(spark, d, w):
    left = d.select(F.struct(*d.columns).alias("decision"), F.col("ts_ms").alias("arrival"))
    right = w.select(F.struct(*w.columns).alias("reward"), F.col("ts_ms").alias("arrival"))
    return left.unionByName(right, allowMissingColumns=True).select("decision", "reward", "arrival")


def stored(spark, root):
    return [h.all() for h in histories(spark, root)]


def test_history_reads_only_what_may_match(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), DECISIONS, [*KEY, "id"], buckets=8)
    parts = [decisions(spark, *[decision(f"{n}-{i}", i) for i in range(40)]) for n in "abcd"]
    for n, part in enumerate(parts):
        assert history.near(part, n).count() == 0 or n  # nothing before the first
        history.write(part, n)
    assert history.all().count() == 160
    asked = parts[1].filter("id in ('b-3', 'b-7')")
    folders = history.candidates(asked, 4)
    assert {b for b, _ in folders} >= {1} and len(folders) <= 6
    found = history.near(asked, 4)
    assert {"b-3", "b-7"} <= {r.id for r in found.collect()}
    assert all("batch=1/" in f or len(found.inputFiles()) <= 6 for f in found.inputFiles())
    assert history.near(asked, 1).count() == 0 and history.near(parts[3], 3).count() <= 40
    # every key is found, whatever the size of its bucket's filter
    many = spark.range(30_000).select(*[F.lit("k").alias(k) for k in KEY], F.col("id").cast("string").alias("id"))
    big = History(spark, str(tmp_path / "b"), many.schema, [*KEY, "id"], buckets=2)
    big.write(many, 0)
    assert len(big.candidates(many.filter("id % 1000 = 1"), 1)) == 2
    absent = many.withColumn("id", F.concat(F.lit("no"), "id")).filter("id like 'no77%'").limit(20)
    assert big.near(absent, 1).count() <= 30_000


def test_ingest_over_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [
        events(spark, decisions(spark, decision("a", 1), decision("a", 2), decision("b", 3)),
               rewards(spark, reward("a", 0, 1, ts=4), reward("zz", 0, 1, ts=5))),
        events(spark, decisions(spark, decision("b", 11), decision("c", 12)),
               rewards(spark, reward("a", 0, 9, ts=13), reward("c", 0, 2, ts=14))),
    ]
    os.makedirs(source)
    stream = spark.readStream.schema(batches[0].schema).parquet(source)
    for b in batches:
        b.write.mode("append").parquet(source)
        drain_batches_at(stream, root, str(tmp_path / "state"))
    d, w = stored(spark, root)
    assert sorted(r["id"] for r in d.collect()) == ["a", "b", "c"]
    assert sorted((r["decision_id"], r["seq"], r["value"]) for r in w.collect()) == [
        ("a", 1, 1.0), ("c", 2, 2.0),
    ]
    # the last batch runs again, as after a failure before its commit
    ingest_batch(root)(batches[1], 1)
    d2, w2 = stored(spark, root)
    assert d2.count() == 3 and sorted(r["seq"] for r in w2.collect()) == [1, 2]


def drain_batches_at(stream, root, state):
    q = (
        stream.writeStream.foreachBatch(ingest_batch(root))
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    q.awaitTermination()


@pytest.mark.parametrize("mode,cut", [("first", True), ("sum", True), ("first", False), ("sum", False)])
def test_timers(spark, tmp_path, mode, cut):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    minute = 60_000
    schema = ("tenant string, job string, capsule string, id string, kind string, ts_ms bigint, "
              "value double, idempotency_key string")

    def batch(*rows):
        df = spark.createDataFrame([("t", "j", "c", *r) for r in rows], schema)
        df = df.withColumn("ts_ms", F.col("ts_ms") + 1_700_000_000_000)
        return df.withColumn("ts", F.timestamp_millis("ts_ms"))

    batches = [
        batch(("a", "decision", 0, None, None), ("b", "decision", 0, None, None),
              ("d", "deferred", 0, None, None), ("d", "reward", 1000, 3.0, "k1"),
              ("x", "deferred", 0, None, None)),
        batch(("a", "reward", 5 * minute, 2.0, "k2"), ("a", "reward", 6 * minute, 1.0, "k3"),
              ("d", "activation", 2 * minute, None, None), ("a", "reward", 7 * minute, 1.0, "k3"),
              ("e", "activation", 5 * minute, None, None), ("f", "deferred", 5 * minute, None, None),
              ("f", "activation", 5 * minute, None, None)),
        batch(("e", "deferred", 6 * minute, None, None)),
        batch(("z", "decision", 90 * minute, None, None)),
        batch(("b", "reward", 95 * minute, 7.0, "late"), ("z", "reward", 96 * minute, 1.0, "k")),
        batch(("far", "decision", 60 * 24 * 3 * minute, None, None)),
    ]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(source)
    stream = with_timers(
        spark.readStream.schema(batches[0].schema).parquet(source), 0.5, 600, mode
    )
    if not cut:
        whole = batches[0]
        for b in batches[1:-1]:
            whole = whole.unionByName(b)
        batches = [whole, batches[-1]]
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
        q = (
            stream.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        q.awaitTermination()
    def order(r):
        return r[0], r[1], r[2] or 0, r[3] or ""

    got = [
        (r["id"], r["kind"], r["value"], r["idempotency_key"])
        for r in spark.read.parquet(out).collect() if r["id"] != "far"
    ]

    def key(i, k):
        return i if mode == "first" else k

    want = [
        ("a", "decision", None, None), ("a", "reward", 2.0, key("a", "k2")),
        ("b", "decision", None, None),
        ("b", "default_reward", 0.5, key("b", "b:default")),
        ("d", "decision", None, None), ("d", "reward", 3.0, key("d", "k1")),
        ("e", "decision", None, None), ("e", "default_reward", 0.5, key("e", "e:default")),
        ("f", "decision", None, None), ("f", "default_reward", 0.5, key("f", "f:default")),
        ("z", "decision", None, None), ("z", "reward", 1.0, key("z", "k")),
    ]
    if mode == "sum":
        want += [("a", "reward", 1.0, "k3"), ("b", "reward", 7.0, "late")]
    assert sorted(got, key=order) == sorted(want, key=order)
    # three days on, only the last decision is still remembered
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert rows[-1] <= 8


def test_timers_keep_few_states(spark, tmp_path):
    """A thousand open ids are a few states with one timer each; ids with parts that are null stay apart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    n, at = 1000, 1_700_000_000_000
    stamped = (
        spark.range(n).select(
            *[F.lit("k").alias(k) for k in KEY[:2]], F.when(F.col("id") % 2 == 0, "c").alias("capsule"),
            F.floor(F.col("id") / 2).cast("string").alias("id"), F.explode(F.array(F.lit("decision"), F.lit("reward"))).alias("kind"),
            (F.col("id") + at).alias("ts_ms"), F.col("id").cast("double").alias("value"), F.lit("i").alias("idempotency_key"),
        ).withColumn("ts", F.timestamp_millis("ts_ms"))
    )
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    stamped.coalesce(1).write.parquet(source)
    q = (
        with_timers(spark.readStream.schema(stamped.schema).parquet(source), 0.5, 600, "sum", buckets=4)
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert 0 < rows[-1] <= 3 * 4
    got = spark.read.parquet(out).groupBy("kind", F.col("capsule").isNull().alias("none")).agg(
        F.count_distinct("id").alias("n"), F.sum("value").alias("total")
    )
    assert {(r["kind"], r["none"], r["n"], r["total"]) for r in got.collect()} == {
        ("decision", False, 500, None), ("decision", True, 500, None),
        ("reward", False, 500, 249_500.0), ("reward", True, 500, 250_000.0),
    }


def test_in_batches_computes_its_rows_once(spark, monkeypatch):
    """Micro-batches follow each other by the order, their rows are computed once, and more rows make more files."""
    from policylens.plans import stream_queries as Q

    calls = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(n):
        calls.add(1)
        return n

    monkeypatch.setattr(Q, "FILE_ROWS", 20)
    rows = spark.range(600).select(seen("id").alias("n"))
    stream, found = Q.in_batches(rows, "once", "n", 3), []

    def note(batch, batch_id):
        files = batch.select(F.input_file_name()).distinct().count()
        found.append((files, *batch.agg(F.min("n"), F.max("n"), F.count("n")).first()))

    Q.drain_batches(stream, note, "once")
    assert calls.value == 600
    assert [files for files, *_ in found] == [10, 10, 10] and sum(n for *_, n in found) == 600
    assert all(a[2] < b[1] for a, b in zip(found, found[1:]))
