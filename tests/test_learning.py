"""The learner against a plain loop, incremental folding, scoring and replay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from policylens.functions.features import featurize
from policylens.operators import ingest as I
from policylens.operators import joins as J
from policylens.operators import learner as L
from policylens.operators.learner import Nag
from policylens.plans.learn_queries import learning_rows
from policylens.plans.sample_log import event_decisions
from policylens.schema import KEY
from policylens.session import checkpointed
from policylens.spec import PolicySpec

SPEC = PolicySpec.of({"learner": {"bits": 12}, "reward": {"range": [0.0, 500.0]}})


def plain(rows, on, rates, models, slots):
    """The published update, one feature and one model at a time."""
    u, s, a = (np.zeros((slots, models), np.float32) for _ in range(3))
    t, n = np.zeros(models), np.zeros(models)
    for rate in rates:
        for i, (at, x, y, h) in enumerate(rows):
            for k in np.flatnonzero(on[i]):
                for j, v in zip(at, x, strict=True):
                    mag = np.float32(abs(v))
                    if mag > s[j, k]:
                        if s[j, k] > 0:
                            a[j, k] *= (float(s[j, k]) / float(mag)) ** 2
                        s[j, k] = mag
                xn = x / s[at, k].astype(float)
                gap = float((u[at, k] * xn).sum()) - y
                t[k] += h
                n[k] += h * float((xn * xn).sum())
                g = h * gap * xn
                acc = a[at, k] + g * g
                a[at, k] = acc
                u[at, k] = u[at, k] - rate * np.sqrt(t[k] / n[k]) * g / np.sqrt(acc)
    return u, s, a, t, n


def test_pass_matches_the_plain_update():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(200):
        at = np.unique(rng.integers(0, 20, 6))
        x = np.where(at % 3 == 0, 1.0, rng.normal(size=len(at)) * 10).astype(np.float32).astype(float)
        rows.append((at, x, rng.random(), 1.0 + rng.integers(0, 3)))
    on = np.ones((200, 3))
    on[np.arange(200), np.arange(200) % 3] = 0
    want = plain(rows, on, [0.5, 0.125], 3, 20)
    model = Nag(20, 3)
    for rate in (0.5, 0.125):
        model.learn(
            np.array([len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows]),
            np.concatenate([r[1] for r in rows]), np.array([r[2] for r in rows]),
            np.array([r[3] for r in rows]), on, rate,
        )
    for got, ref in zip((model.u, model.s, model.a, model.t, model.norm), want, strict=True):
        assert got == pytest.approx(ref, rel=1e-4, abs=1e-6)
    assert model.n.tolist() == (2 * on.sum(axis=0)).astype(int).tolist()


def slot_map(slots):
    return {(r["capsule"], r["slot"]): (r["u"], r["s"], r["a"]) for r in slots.collect()}


def test_folding_in_two_steps_equals_one(spark, folder):
    data = learning_rows(spark, folder).persist()
    head, slots = L.fold_models(data, SPEC)
    h1, s1 = L.fold_models(data.filter("seq <= 900"), SPEC)
    h1, s1 = checkpointed(h1), checkpointed(s1)
    h2, s2 = L.fold_models(data, SPEC, s1, h1)
    want, got = slot_map(slots), slot_map(s2)
    assert set(want) == set(got)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-4, abs=1e-5)
    a = {r["capsule"]: r["n_updates"] for r in head.collect()}
    assert a == {r["capsule"]: r["n_updates"] for r in h2.collect()}
    data.unpersist()


def test_sharded_fold_learns_all_rewards(spark, folder):
    data = learning_rows(spark, folder)
    exact, whole = L.fold_models(data, SPEC)
    head, slots = L.fold_models(data, SPEC, block=400)
    assert {r["capsule"]: r["n_updates"] for r in head.collect()} == {
        r["capsule"]: r["n_updates"] for r in exact.collect()
    }
    want, got = slot_map(whole), slot_map(slots)
    assert set(got) == set(want)
    assert all(got[k][1] == want[k][1] for k in want)


def test_grouped_scoring_equals_the_join(spark, folder):
    d = featurize(event_decisions(spark, folder))
    _, slots = L.fold_models(learning_rows(spark, folder), SPEC)
    slots = checkpointed(slots)
    joined = {
        (r["id"], r["position"]): r["prediction"]
        for r in L.score(d, slots, [*KEY, "id"], 12).collect()
    }
    for rows in (100_000, 60):
        got = L.predict(d, slots, KEY, ["id"], 12, shard_rows=rows)
        flat = {
            (r["id"], r["pos"]): r["col"]
            for r in got.select("id", F.posexplode("predictions")).collect()
        }
        assert set(flat) == set(joined)
        assert all(flat[k] == pytest.approx(joined[k], abs=1e-9) for k in joined)


def test_replay_of_a_decision_is_exact(spark, folder):
    requests = featurize(event_decisions(spark, folder).drop(
        "pmf", "probability", "chosen_index", "chosen_id", "mode"
    ))
    header, slots = L.fold_models(learning_rows(spark, folder), SPEC)
    header, slots = checkpointed(header), checkpointed(slots)
    cols = ["id", "chosen_index", "probability"]
    one = {tuple(r) for r in L.decide(requests, slots, header, SPEC).select(cols).collect()}
    two = {
        tuple(r)
        for r in L.decide(requests.repartition(5), slots, header, SPEC).select(cols).collect()
    }
    assert one == two and all(p >= 0.05 / 5 for _, _, p in one)


def test_frozen_rewards_are_not_learned(spark, folder):
    data = learning_rows(spark, folder).withColumn("detail", F.lit('{"learned":false}'))
    head, slots = L.fold_models(data, SPEC)
    assert head.count() == 0 and slots.count() == 0
    assert J.KEY == KEY


def test_frozen_capsules_are_marked(spark):
    rows = [("t", "j", c, d) for c in "ab" for d in (None, "{}", '{"x":1}', '{"learned":true}', "[1]", "text", '{"y":{"z":2}}')]
    r = spark.createDataFrame(rows, "tenant string, job string, capsule string, detail string")
    specs = spark.createDataFrame(
        [("t", "j", "a", SPEC.patched({"mode": "frozen"}).json()), ("t", "j", "b", SPEC.json())],
        "tenant string, job string, capsule string, spec string",
    )
    got = I.mark_frozen(r, specs).withColumn("ok", L.was_learned(F.col("detail"))).collect()
    assert {x["ok"] for x in got if x["capsule"] == "a"} == {False}
    assert {x["detail"] for x in got if x["capsule"] == "b"} == {d for _, _, c, d in rows if c == "b"}
