"""Streamed groups, spec tables, unusable features, and the store with its manifest."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_log import decision, decisions, reward, rewards

from policylens.functions.features import MAX_TERMS, FeatureError, decidable, featurize, featurized
from policylens.operators import learner as L
from policylens.operators import specs as P
from policylens.operators import streamed
from policylens.operators.reward_model import cross_fit
from policylens.operators.store import RefusedError, Store
from policylens.plans.learn_queries import SPEC, learning_rows
from policylens.schema import KEY
from policylens.session import checkpointed
from policylens.sources.logs import parse_uploaded_rewards


# --- streamed groups ---------------------------------------------------------------------


class Lines:
    """Notes what a state is given."""

    def __init__(self, key):
        self.key, self.seen = key, []

    def add(self, part):
        self.seen += part.column("v").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([f"{self.key}+{part.num_rows}"])], ["said"])

    def close(self):
        yield pa.RecordBatch.from_arrays([pa.array([f"{self.key}={self.seen}"])], ["said"])


def test_states_follow_keys_across_batches():
    def batch(*rows):
        return pa.RecordBatch.from_pylist([{"k": k, "v": v} for k, v in rows], pa.schema([("k", pa.string()), ("v", pa.int64())]))

    batches = [batch((None, 1), ("a", 2)), batch(), batch(("a", 3)), batch(("a", 4), ("b", 5), ("b", 6)), batch(("c", 7))]
    said = [b.column(0)[0].as_py() for b in streamed.by_group(iter(batches), ["k"], Lines)]
    assert said == [
        "(None,)+1", "(None,)=[1]", "('a',)+1", "('a',)+1", "('a',)+1", "('a',)=[2, 3, 4]", "('b',)+2", "('b',)=[5, 6]",
        "('c',)+1", "('c',)=[7]",
    ]
    assert list(streamed.by_group(iter([]), ["k"], Lines)) == []


def bits_of(slots):
    return {(r.capsule, r.slot): (r.u, r.s, r.a) for r in slots.collect()}


def test_models_do_not_depend_on_batches_or_partitions(spark, folder, monkeypatch):
    data = checkpointed(learning_rows(spark, folder))
    want = bits_of(L.fold_models(data, SPEC)[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = bits_of(L.fold_models(data.repartition(13), SPEC)[1])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    assert got == want


def test_cross_fit_does_not_depend_on_batches(spark, folder):
    data = checkpointed(learning_rows(spark, folder).withColumnRenamed("value", "reward").withColumn("id", F.concat("id", F.lit("/"), "seq")))

    def fit(rows):
        out = cross_fit(rows, SPEC, F.col("seq") % 3, 3, shards=2, order=("seq", "id"), keep=[*KEY, "id"])
        return {r.id: (r.rhat, r.n_updates) for r in out.collect()}

    want = fit(data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "41")
    try:
        assert fit(data.repartition(5)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    assert len(want) == data.count()


# --- specs -------------------------------------------------------------------------------


def spec_table(spark, *rows):
    return spark.createDataFrame([("acme", "default", c, s) for c, s in rows], "tenant string, job string, capsule string, spec string")


def test_spec_tables(spark, folder):
    table = spec_table(
        spark, ("router0", '{"mode":"frozen"}'), ("router1", '{"learner":{"bits":30}}'), ("router2", "[1]"), ("other", None)
    )
    got = {r.capsule: r for r in P.compiled(table).collect()}
    assert got["router0"].settings["mode"] == "frozen" and got["router0"].problem is None
    assert got["router1"].settings is None and "bits" in got["router1"].problem
    assert got["router2"].settings is None and got["router2"].problem
    assert got["other"].settings.asDict() == P.settings_of(L.PolicySpec.of())
    data = learning_rows(spark, folder)
    with pytest.raises(Exception, match="spec of acme"):
        L.fold_models(data, table)[0].collect()
    # frozen capsules learn nothing, one without a row has the default spec
    head, _ = L.fold_models(data, spec_table(spark, ("router0", '{"mode":"frozen"}'), ("router1", SPEC.json())))
    assert {r.capsule: r.bits for r in head.collect()} == {"router1": 12, "router2": 18}


# --- features that cannot be ---------------------------------------------------------------


def test_unusable_records_are_set_aside(spark):
    wide = "{" + ",".join(f'"f{i}":1' for i in range(1100)) + "}"
    rows = [("ok", '{"x":1}', "{}", '{"c":1}'), ("no json", "{", "{}", "{}"), ("list", "[1]", "{}", "{}"), ("derived", "{}", '{"a":1e99}', "{}"),
            ("action", "{}", "{}", '{"x":' * 9 + "1" + "}" * 9), ("wide", wide, "{}", wide), ("null", None, None, None)]
    df = spark.createDataFrame(
        [(i, c, d, [("a", f), ("b", None)], [0, 1]) for i, c, d, f in rows],
        "id string, context string, derived string, actions array<struct<id:string,features:string>>, eligible array<int>",
    )
    good, bad = featurized(df)
    assert {r.id for r in good.collect()} == {"ok", "null"}
    problems = {r.id: r.problem for r in bad.collect()}
    assert set(problems) == {"no json", "list", "derived", "action", "wide"}
    assert str(MAX_TERMS) in problems["wide"] and "nested" in problems["action"]
    alone = featurize(df.filter("id in ('ok', 'null')")).collect()
    mixed = {r.id: r.features for r in good.collect()}
    assert all(r.features == mixed[r.id] for r in alone)
    with pytest.raises(Exception, match=FeatureError.__name__):
        featurize(df).collect()


def test_a_bad_uploaded_reward_stands_alone(spark):
    text = '{"rewards":[{"decisionId":"a","reward":1.5},{"decisionId":"b","reward":"x"},7,{"reward":2},{"decisionId":"c","value":2,"odd":1},{"decisionId":"d","value":3,"detail":{"k":1}}]}'
    got = parse_uploaded_rewards(spark.createDataFrame([(text,), ("no json",), ('{"rewards":5}',)], "value string")).orderBy("position").collect()
    assert [(r.position, r.decision_id, r.value, r.item_problem) for r in got] == [
        (0, "a", 1.5, None), (1, "b", None, "value_missing"), (2, None, None, "no_reward_record"), (3, None, 2.0, "decision_id_missing"),
        (4, "c", 2.0, "unknown_field"), (5, "d", 3.0, None),
    ]


def test_rules_that_leave_no_choice(spark):
    rows = [("fine", ["a"], None), ("none", None, None), ("all", ["a", "b"], None), ("odd", ["x"], None), ("only", None, ["b"]), ("only odd", None, ["y"])]
    df = spark.createDataFrame(
        [(i, [("a", "{}"), ("b", "{}")], e, o) for i, e, o in rows],
        "id string, actions array<struct<id:string,features:string>>, excluded_ids array<string>, only_ids array<string>",
    )
    good, bad = decidable(df)
    assert {r.id: r.eligible for r in good.collect()} == {"fine": [1], "none": [0, 1], "only": [1]}
    assert {r.id: r.problem for r in bad.collect()} == {"all": "nothing_eligible", "odd": "unknown_action", "only odd": "unknown_action"}


# --- the store -----------------------------------------------------------------------------


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet") and "/manifest" not in d}


def heads(spark, mark):
    return decisions(spark, decision("a", 1)).select(*KEY).distinct().select(
        *KEY, F.lit(1).alias("version"), F.lit(mark).alias("reward_seq"), F.lit(0).alias("ts_ms"), F.lit(12).alias("bits"),
        F.lit(0.5).alias("learning_rate"), F.lit(1).alias("n_updates"), F.lit(1.0).alias("total_weight"), F.lit(1.0).alias("norm_sum"),
    )


def test_store(spark, tmp_path):
    day, root = 86_400_000, str(tmp_path / "store")
    store = Store(spark, root)
    assert store.read("decisions").count() == 0 and store.version == 0
    store.append(decisions=decisions(spark, *[decision(f"d{i}", i * day // 2) for i in range(8)]),
                 rewards=rewards(spark, reward("d0", 1, 1, ts=10), reward("d5", 2, 1, ts=3 * day)))
    with pytest.raises(RefusedError):
        store.prune(day, 0)
    before = files(root)
    assert store.read("decisions").count() == 8 and Store(spark, root).version == 1
    store.append(models=heads(spark, 2))
    # the cut falls inside the second day: the first goes by name, the second is written again
    counts = store.prune(day + day // 2, 99).collect()
    assert [(r.removedDecisions, r.removedRewards) for r in counts] == [(3, 1)]
    assert {r.id for r in store.read("decisions").collect()} == {f"d{i}" for i in range(3, 8)}
    assert [r.decision_id for r in store.read("rewards").collect()] == ["d5"]
    live = {f.removeprefix("file:") for f in store.read("decisions").inputFiles()}
    kept = [f for f in before if "day=1970-01-03" in f or "day=1970-01-04" in f]
    assert kept and all(f in files(root) for f in kept) and len(live) >= 3
    assert [(r.event, r.seq) for r in store.read("audit").collect()] == [("logs_pruned", 1)]
    assert store.vacuum() > 0 and not [f for f in files(root) if "day=1970-01-01" in f]
    # a change that did not reach its manifest is not there
    store._write("decisions", decisions(spark, decision("zz", 1)), store.version + 1)
    assert Store(spark, root).read("decisions").count() == 5
    key = tuple(store.read("decisions").select(*KEY).first())
    store.append(rewards=rewards(spark, reward("d6", 9, 1, ts=3 * day)))
    with pytest.raises(RefusedError):
        store.purge(key, 100)
    store.append(models=heads(spark, 9).withColumn("version", F.lit(2)))
    store.keep_newest_models(1, 101)
    assert [r.version for r in store.read("models").collect()] == [2]
    store.purge(key, 102)
    assert store.read("decisions").count() == store.read("rewards").count() == 0 and store.read("models").count() == 1
    store.erase(key[:1], 103)
    assert store.read("models").count() == 0
    assert [r.event for r in store.read("audit").orderBy("seq").collect()] == ["logs_pruned", "models_pruned", "logs_purged", "capsule_deleted"]
