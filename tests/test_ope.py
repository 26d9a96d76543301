"""Estimators on hand-computed rows, with known truth, and the cross-fitting leak."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from policylens.functions.features import featurize, fold_of
from policylens.operators import estimators as S
from policylens.operators import gates as G
from policylens.operators import policies as T
from policylens.operators.bootstrap import counts, intervals
from policylens.operators.reward_model import cell_means, cross_fit
from policylens.plans.evaluate import EvalConfig, evaluate
from policylens.operators.validate import data_summary, require_valid, validate_logged
from policylens.spec import PolicySpec

SCHEMA = (
    "tenant string, job string, capsule string, id string, ts_ms bigint, mode string, "
    "context string, derived string, actions array<struct<id:string,features:string>>, "
    "eligible array<int>, pmf array<double>, chosen_index int, probability double, "
    "reward double, reward_count bigint"
)


def frame(spark, rows, capsule="c"):
    return spark.createDataFrame(
        [
            ("t", "j", capsule, f"r{i}", i, "learner", context, "null",
             [(f"a{k}", "{}") for k in range(len(pmf))], list(range(len(pmf))), list(pmf), chosen,
             None if pmf is None else float(pmf[chosen]), reward, 1)
            for i, (context, pmf, chosen, reward) in enumerate(rows)
        ],
        SCHEMA,
    )


FOUR = [
    ('{"u":1}', [0.5, 0.5], 0, 1.0), ('{"u":2}', [0.8, 0.2], 1, 0.0),
    ('{"u":3}', [0.25, 0.75], 0, 1.0), ('{"u":4}', [0.9, 0.1], 1, 1.0),
]


def test_four_rows(spark):
    half = F.transform("eligible", lambda _: F.lit(0.5))
    d = frame(spark, FOUR).withColumn("rhat", half)
    m = S.metrics(S.terms(T.sweep(d, [T.constant("a0")]))).first()
    assert (m["ips"], m["snips"], m["dm"], m["dr"], m["logged_mean"]) == (1.5, 1.0, 0.5, 1.25, 0.75)
    assert m["ess"] == pytest.approx(1.8) and m["coverage"] == 0.5 and m["max_weight"] == 4.0
    logged = S.metrics(S.terms(T.sweep(d, [T.logged()]))).first()
    assert logged["ips"] == logged["logged_mean"] == 0.75
    clipped = S.metrics(S.terms(T.sweep(d, [T.constant("a0")]), 3.0)).first()
    assert clipped["clipped_rows"] == 1 and clipped["ips"] == 5 / 4


def test_undefined_is_null_and_fails_gates(spark):
    d = frame(spark, [("{}", [0.5, 0.5], 1, 1.0), ("{}", [0.5, 0.5], 1, 0.0)])
    m = S.metrics(S.terms(T.sweep(d, [T.constant("a0")])))
    row = m.first()
    assert row["snips"] is None and row["snips_se"] is None and row["dr_se"] is None
    gates = G.check_gates(m, ["snips.estimate >= -100", "ips.estimate >= 0", "n == 2"]).collect()
    assert [g["pass"] for g in sorted(gates, key=lambda g: g["gate"])] == [False, True, True]


def test_gate_grammar():
    for bad in ("lift.dr.lower = 0", "dm.lower >= 0", "foo >= 1", "ess >=", "ess >= 1 2",
                "1 >= ess", "ess >= 1 + ess"):
        with pytest.raises(G.GateError):
            G.parse_check(bad)
    assert G.read_gates('{"gates": ["n >= 10"]}', as_json=True) == ["n >= 10"]
    with pytest.raises(G.GateError):
        G.read_gates("   ")


def test_validation_and_strict_mode(spark):
    d = frame(spark, FOUR)
    bad = d.withColumn("probability", F.when(F.col("id") == "r2", 0.3).otherwise(
        F.col("probability")
    ))
    got = {r["id"]: r["problem"] for r in validate_logged(bad).collect()}
    assert got["r2"] == "probability_mismatch" and got["r0"] is None
    with pytest.raises(Exception, match="probability_mismatch"):
        require_valid(validate_logged(bad)).collect()


def test_constant_reward_range_is_widened(spark):
    d = frame(spark, [("{}", [1.0], 0, 3.0), ("{}", [1.0], 0, 3.0)])
    s = data_summary(d).first()
    assert (s["range_lo"], s["range_hi"]) == (2.5, 3.5)


def known_log(spark, n, seed, capsule="c"):
    """Uniform logging over three actions; mean reward 0.2, 0.5, 0.8 rotated by segment."""
    rng = np.random.default_rng(seed)
    means = np.array([[0.2, 0.5, 0.8], [0.8, 0.2, 0.5], [0.5, 0.8, 0.2]])
    seg, act = rng.integers(0, 3, n), rng.integers(0, 3, n)
    reward = (rng.random(n) < means[seg, act]).astype(float)
    rows = [
        (f'{{"segment":"s{s}"}}', [1 / 3] * 3, int(a), float(r))
        for s, a, r in zip(seg, act, reward, strict=True)
    ]
    return frame(spark, rows, capsule)


def test_linear_model_recovers_the_truth(spark):
    d = featurize(known_log(spark, 6000, 1))
    fitted = cross_fit(d, PolicySpec.of(), fold_of(F.col("id"), 5), 5, shards=1)
    m = S.metrics(
        S.terms(T.sweep(fitted, [T.greedy(), T.constant("a0")]))
    ).orderBy("policy").collect()
    assert [r["policy"] for r in m] == ["constant:a0", "greedy"]
    assert m[1]["dr"] == pytest.approx(0.8, abs=0.04) and m[0]["dr"] == pytest.approx(0.5, abs=0.04)
    assert m[1]["dm"] == pytest.approx(0.8, abs=0.05)
    assert all(r["dr_se"] < r["ips_se"] for r in m)
    assert m[1]["lift_dr_lower"] > 0.2


def test_in_sample_greedy_overestimates(spark):
    rng = np.random.default_rng(3)
    rows = [
        (f'{{"u":"{i}"}}', [0.25] * 4, int(rng.integers(0, 4)), float(rng.random() < 0.5))
        for i in range(600)
    ]
    d = featurize(frame(spark, rows))
    values = {}
    for leak in (False, True):
        fitted = cross_fit(
            d, PolicySpec.of(), fold_of(F.col("id"), 5), 5, with_context=False, in_sample=leak,
            shards=1,
        )
        values[leak] = S.metrics(S.terms(T.sweep(fitted, [T.greedy()]))).first()["ips"]
    assert values[True] > 0.65 and abs(values[False] - 0.5) < 0.12


def test_sharded_cross_fit_scores_every_row(spark):
    d = featurize(known_log(spark, 3000, 5))
    fitted = cross_fit(d, PolicySpec.of(), fold_of(F.col("id"), 5), 5, shards=6)
    assert fitted.count() == 3000 and fitted.select("id").distinct().count() == 3000
    m = S.metrics(S.terms(T.sweep(fitted, [T.greedy()]))).first()
    assert m["dr"] == pytest.approx(0.8, abs=0.08)


def test_cells_match_a_plain_loop(spark):
    d = known_log(spark, 400, 7).withColumn("f", (F.col("ts_ms") % 4).cast("int"))
    rows = d.collect()
    got = {
        r["id"]: r["rhat"]
        for r in cell_means(d, F.get_json_object("context", "$.segment"), F.col("f"), 4).collect()
    }
    for r in rows[:60]:
        for a in range(3):
            same = [
                o["reward"] for o in rows
                if o["f"] != r["f"] and o["context"] == r["context"] and o["chosen_index"] == a
            ]
            assert got[r["id"]][a] == pytest.approx(np.mean(same), abs=1e-12)


def test_poisson_counts():
    c = counts(np.arange(2000, dtype=np.uint64) * np.uint64(7919), 400, 7).astype(float)
    assert c.mean() == pytest.approx(1.0, abs=0.005) and c.var() == pytest.approx(1.0, abs=0.01)
    assert abs(np.corrcoef(c[:, 0], c[:, 1])[0, 1]) < 0.08
    again = counts(np.arange(2000, dtype=np.uint64) * np.uint64(7919), 400, 7)
    assert (again == c).all()


def test_bootstrap_agrees_with_normal_and_multinomial(spark):
    d = known_log(spark, 1500, 11)
    half = F.transform("eligible", lambda _: F.lit(0.5))
    t = S.terms(T.sweep(d.withColumn("rhat", half), [T.constant("a1")]))
    m = S.metrics(t).first()
    b = intervals(t, 1000, 7).first()
    again = intervals(t.repartition(7), 1000, 7).first()
    assert b["dr_lower"] == pytest.approx(again["dr_lower"], abs=1e-9)
    values = np.array([r["dr"] for r in t.select("dr").collect()])
    rng = np.random.default_rng(0)
    exact = values[rng.integers(0, len(values), (2000, len(values)))].mean(axis=1)
    for side, q in (("lower", 0.025), ("upper", 0.975)):
        assert b[f"dr_{side}"] == pytest.approx(m[f"dr_{side}"], abs=0.3 * m["dr_se"])
        assert b[f"dr_{side}"] == pytest.approx(np.quantile(exact, q), abs=0.3 * m["dr_se"])
        assert b[f"snips_{side}"] == pytest.approx(m[f"snips_{side}"], abs=0.3 * m["snips_se"])


@pytest.mark.parametrize("trial", range(1))
def test_intervals_cover_the_truth(spark, trial):
    """60 logs as 60 capsules of one job."""
    logs = None
    for s in range(60):
        one = known_log(spark, 300, 100 + s, f"c{s}")
        logs = one if logs is None else logs.unionByName(one)
    d = cell_means(
        logs, F.get_json_object("context", "$.segment"), (F.col("ts_ms") % 5).cast("int"), 5
    )
    m = S.metrics(S.terms(T.sweep(d, [T.constant("a2")]))).collect()
    assert len(m) == 60
    for e in ("ips", "snips", "dr"):
        hit = np.mean([r[f"{e}_lower"] <= 0.5 <= r[f"{e}_upper"] for r in m])
        assert hit >= 0.85
        bias = np.mean([r[e] for r in m]) - 0.5
        assert abs(bias) < 3 * np.std([r[e] for r in m]) / np.sqrt(60)


@pytest.mark.parametrize(
    "fault,message",
    [
        ("repeat", "repeated"), ("null_target", "no PMF"), ("scaled_target", "no PMF"),
        ("unknown", "never eligible"), ("one_row", "fewer than two"), ("pmf", "contradicts"),
    ],
)
def test_evaluation_refuses_faulty_input(spark, fault, message):
    d = known_log(spark, 60, 3).withColumn("target_pmf", F.col("pmf")).withColumn("reward_count", F.lit(1))
    some = F.col("ts_ms") % 7 == 0
    targets = [T.target_column()]
    if fault == "repeat":
        d = d.unionByName(d.filter(some))
    elif fault == "null_target":
        d = d.withColumn("target_pmf", F.when(~some, F.col("pmf")))
    elif fault == "scaled_target":
        d = d.withColumn("target_pmf", F.transform("pmf", lambda p: p / 2))
    elif fault == "unknown":
        targets = [T.constant("does_not_exist")]
    elif fault == "one_row":
        d = d.limit(1)
    else:
        d = d.withColumn("pmf", F.transform("pmf", lambda p: p * 1.5))
    config = EvalConfig(bootstrap=0)
    run = lambda c: evaluate(d, lambda x: x.withColumn("rhat", F.transform("eligible", lambda e: F.lit(0.5))), targets, c)
    with pytest.raises(Exception, match=message):
        run(config).collect()
    lenient = run(dataclasses.replace(config, strict=False)).collect()
    if fault == "null_target":
        assert lenient[0]["n"] == d.filter("target_pmf is not null").count()
    else:
        assert lenient == []


def test_resample_blocks_are_one_draw():
    h = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)
    assert np.array_equal(counts(h, 2400, 7)[:, 800:1300], counts(h, 500, 7, 800))


def test_bootstrap_memory_bounds_change_nothing(spark, monkeypatch):
    from policylens.operators import bootstrap as B

    d = known_log(spark, 300, 2).withColumn("capsule", F.concat(F.lit("c"), F.col("ts_ms") % 9))
    t = S.terms(T.sweep(d, [T.constant("a0"), T.logged()]))
    want = {tuple(r[:5]): r[5:] for r in B.resample_sums(t, 120, 3).collect()}
    for name, value in (("RESAMPLES", 40), ("KEYS", 2), ("HELD", 3)):
        monkeypatch.setattr(B, name, value)
    got = {tuple(r[:5]): r[5:] for r in B.resample_sums(t, 120, 3).collect()}
    assert set(got) == set(want) and len(want) == 9 * 2 * 120
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, nan_ok=True) for k in want)
