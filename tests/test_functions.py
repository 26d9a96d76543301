"""Pinned constants and invariants of hashing, draws, PMFs, specs and small helpers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from policylens.functions import features as X
from policylens.functions import kernels as K
from policylens.functions import pmf as P
from policylens.functions import values as V
from policylens.sources.exports import shown
from policylens.spec import PolicySpec, SpecError, merge_patch


def test_hash_goldens():
    # Published FNV-1a vectors and feature hashes.
    assert [int(h) for h in K.fnv1a([b"", b"a", b"foobar", b"c\0segment=A", b"a\0id=small"])] == [
        0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8, 0xBF118B5AB4F38095,
        0x4879A872137A8AE3,
    ]
    assert int(K.BIAS_HASH) == 0x37AEA6A311064846
    pair = K.pair_hash(
        np.array([0xBF118B5AB4F38095], np.uint64), np.array([0x4879A872137A8AE3], np.uint64)
    )
    assert int(pair[0]) == 0xF0BE0DD0BD4E094D
    assert int(K.mix64(np.array([0], np.uint64))[0]) == 0


def test_splitmix_goldens():
    state = np.uint64(1234567) + np.arange(3, dtype=np.uint64) * K.GOLDEN
    assert [int(v) for v in K.splitmix(state)] == [
        6457827717110365317, 3203168211198807973, 9817491932198370423,
    ]


def test_folds_are_balanced(spark):
    ids = spark.range(20000).select(F.concat(F.lit("dec_"), F.col("id")).alias("i"))
    counts = [r["count"] for r in ids.groupBy(X.fold_of(F.col("i"), 5)).count().collect()]
    assert len(counts) == 5 and all(3700 < c < 4300 for c in counts)


def pmf(spark, values, fn):
    df = spark.createDataFrame([(values,)], "v array<double>")
    return df.select(fn(F.col("v"))).first()[0]


def test_pmf_goldens(spark):
    got = pmf(spark, [0.5, 0.3], lambda v: P.squarecb(v, F.lit(10.0)))
    assert got == pytest.approx([0.75, 0.25], abs=1e-12)
    got = pmf(spark, [0.5, 0.3], lambda v: P.floor_mix(P.squarecb(v, F.lit(10.0)), 0.05))
    assert got == pytest.approx([0.7375, 0.2625], abs=1e-12)
    got = pmf(spark, [0.2, 0.7, 0.7], lambda v: P.squarecb(v, F.lit(100.0)))
    assert got == pytest.approx([1 / 53, 1 - 1 / 53 - 1 / 3, 1 / 3], abs=1e-12)
    got = pmf(spark, [0.1, 0.9, 0.5, 0.9], lambda v: P.epsilon_greedy(v, 0.2))
    assert got == pytest.approx([0.05, 0.85, 0.05, 0.05], abs=1e-12)
    got = pmf(spark, [0.0] * 4, lambda v: P.baseline_explore(F.size(v), F.lit(2), 0.1))
    assert got == pytest.approx([0.025, 0.025, 0.925, 0.025], abs=1e-12)
    assert pmf(spark, [0.3], lambda v: P.floor_mix(P.epsilon_greedy(v, 0.2), 0.05)) == [1.0]


def test_pmf_invariants(spark):
    rng = np.random.default_rng(5)
    rows = [
        (np.round(rng.random(int(rng.integers(1, 40))) * 2 - 0.5, 1).tolist(), float(g), float(f))
        for g, f in zip(10 ** rng.uniform(0, 12, 300), rng.random(300), strict=True)
    ]
    df = spark.createDataFrame(rows, "v array<double>, g double, f double")
    out = df.select(
        "v", "f", P.squarecb(F.col("v"), F.col("g")).alias("p"),
    ).withColumn("q", P.floor_mix(F.col("p"), F.col("f"))).collect()
    for r in out:
        for p, low in ((r["p"], 0.0), (r["q"], r["f"] / len(r["v"]))):
            assert sum(p) == pytest.approx(1.0, abs=1e-12)
            assert all(low <= x <= 1 + 1e-15 for x in p)
        assert max(r["p"]) == pytest.approx(r["p"][int(np.argmax(r["v"]))], abs=1e-15)


def test_draw_skips_zero_and_takes_the_last_positive(spark):
    assert pmf(spark, [0.1, 0.1, 0.0], lambda v: P.draw(v, F.lit(0.95))) == 1
    assert pmf(spark, [0.0, 0.5, 0.5], lambda v: P.draw(v, F.lit(0.0))) == 1


def test_flatten_rules(spark):
    text = '{"a":[1,2],"b":{"c":null,"d":"x"},"t":["u","u",true,{"k":2}],"z":false}'
    assert X.named_values(text) == [
        ("a[0]", 1.0), ("a[1]", 2.0), ("b.d=x", 1.0), ("t=u", 1.0), ("t=u", 1.0),
        ("t[2]=true", 1.0), ("t[3].k", 2.0), ("z=false", 1.0),
    ]
    deep = '{"a":' * 8 + "1" + "}" * 8
    assert len(X.named_values(deep)) == 1
    with pytest.raises(X.FeatureError):
        X.named_values('{"a":' * 9 + "1" + "}" * 9)
    with pytest.raises(X.FeatureError):
        X.named_values('{"a": 1e300}')
    with pytest.raises(X.FeatureError):
        X.named_values("[1]")
    assert X.named_values("null") == [] and X.named_values(None) == []


def test_canonical_vectors_merge_slots():
    one = np.array([1], dtype=np.int64)
    h = K.fnv1a([b"c\0x"])
    pair, slot, value = K.phi(
        one, h, np.array([2.0]), np.array([2]), np.repeat(K.fnv1a([b"a\0id=q"]), 2),
        np.array([1.0, -1.0]), np.array([0]), 10, True,
    )
    # the two action features cancel, and so do their interactions: bias and context remain
    assert sorted(value.tolist()) == [1.0, 2.0] and len(set(slot.tolist())) == 2
    assert pair.tolist() == [0, 0]


def test_model_tag_golden(spark):
    text = '{"actions":[{"id":"a"},{"id":"b"}],"bits":10,"seed":18446744073709551615,"version":1}'
    spec = PolicySpec.of({"seed": 2**64 - 1})
    assert json.loads(spec.decide_json())["seed"] == 2**64 - 1
    tag = spark.range(1).select(
        X.model_tag(F.lit(text), F.unhex(F.lit(bytes(range(52, 84)).hex())))
    ).first()[0]
    assert tag == "5b441bd2fa0e248f"


def test_spec_is_strict():
    with pytest.raises(SpecError):
        PolicySpec.of({"exploration": {"gama": 5}})
    with pytest.raises(SpecError):
        PolicySpec.of({"exploration": {"floor": 0.0}})
    with pytest.raises(SpecError):
        PolicySpec.of({"actions": [{"id": "a"}, {"id": "a"}]})
    spec = PolicySpec.of({"exploration": {"epsilon": 0.2}})
    assert spec.patched({"exploration": {"epsilon": None}}).get("exploration", "epsilon") == 0.05
    assert merge_patch({"a": {"b": 1, "c": 2}}, {"a": {"b": None}, "d": [1]}) == {
        "a": {"c": 2}, "d": [1],
    }


def test_json_helpers(spark):
    df = spark.createDataFrame([('{"a":[1,{"b":"xyz"}],"n":null}',), ("nope",)], "t string")
    got = df.select(
        V.json_get(F.col("t"), "$.a[1].b"), V.json_has(F.col("t"), "$.n"),
        V.json_len(F.col("t"), "$.a"), V.json_len(F.col("t"), "$.a[1].b"),
    ).collect()
    assert tuple(got[0]) == ("xyz", True, 2, 3) and tuple(got[1]) == (None, False, None, None)


def test_shown_numbers():
    assert [shown(v) for v in (None, 0.0, 9.9996, 1234567.0, 0.00001234, -2.5)] == [
        "-", "0", "10", "1.235e+06", "1.234e-05", "-2.5",
    ]
