"""The event-log contract on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from policylens.operators import ingest as I
from policylens.operators import joins as J
from policylens.operators import reports as R
from policylens.operators import retention as H
from policylens.operators import uploads  # noqa: F401
from policylens.operators.validate import health, validate_decisions
from policylens.schema import DECISIONS, REWARDS
from policylens.sources import dsjson, exports, logs

KEYS = ("t", "j", "c")


def decision(i, ts, capsule="c", **other):
    row = dict(
        tenant="t", job="j", capsule=capsule, id=i, ts_ms=ts, model_version=0, mode="learner",
        context="{}", actions=[("a", "{}"), ("b", "{}")], eligible=[0, 1], pmf=[0.5, 0.5],
        chosen_index=0, chosen_id="a", probability=0.5, seed=1, derived="null", reason=None,
        request_sha256="h", program_sha256=None,
    )
    row.update(other)
    return tuple(row[f.name] for f in DECISIONS.fields)


def reward(i, seq, value, key=None, capsule="c", ts=0, detail=None):
    return ("t", "j", capsule, i, seq, ts, float(value), float(value), key or i, detail)


def decisions(spark, *rows):
    return spark.createDataFrame(list(rows), DECISIONS)


def rewards(spark, *rows):
    return spark.createDataFrame(list(rows), REWARDS)


def test_fold_first_and_sum(spark):
    d = decisions(
        spark, decision("before", 99), decision("none", 100), decision("a", 100),
        decision("b", 150), decision("legacy", 160, pmf=None, probability=None),
        decision("until", 200),
    )
    w = rewards(
        spark, reward("b", 3, 1, "b"), reward("b", 4, 2, "b2"), reward("b", 5, 4, "b4"),
        reward("a", 2, 9),
    )
    window = R.in_window(d, 100, 200)
    for mode, want in (("first", 1.0), ("sum", 7.0)):
        got = {r["id"]: r for r in J.logged_rows(window, w, mode).collect()}
        assert set(got) == {"none", "a", "b", "legacy"}
        assert got["b"]["reward"] == want and got["b"]["reward_count"] == 3
        assert got["none"]["reward"] is None and got["none"]["reward_count"] == 0
        assert got["legacy"]["pmf"] is None


@pytest.mark.parametrize("n", [5, 17, 5000])
def test_sum_adds_in_sequence_order(spark, n):
    rng = np.random.default_rng(n)
    values = (rng.random(n) * 10.0 ** rng.integers(-8, 8, n)).tolist()
    w = rewards(spark, *[reward("x", i + 1, v, f"k{i}") for i, v in enumerate(values)])
    d = decisions(spark, decision("x", 1))
    left_to_right = 0.0
    for v in values:
        left_to_right += v
    for parts in (1, 5):
        got = J.logged_rows(d, w.repartition(parts), "sum").first()
        assert (got["reward"], got["reward_count"]) == (left_to_right, n)


def test_limit_is_per_capsule(spark):
    d = decisions(spark, decision("a", 1), decision("b", 1, capsule="other"))
    w = rewards(spark, *[reward("a", i, 1, f"k{i}") for i in range(1, 6)])
    other = w.withColumn("capsule", F.lit("other")).withColumn("decision_id", F.lit("b"))
    got = J.rewards_since(w.unionByName(other), d, 1, 2).collect()
    assert sorted((r["capsule"], r["seq"]) for r in got) == sorted(
        [(d.first()["capsule"], 2), (d.first()["capsule"], 3), ("other", 2), ("other", 3)]
    )


def test_decisions_are_write_once(spark):
    new = decisions(
        spark, decision("a", 1), decision("a", 2), decision("b", 3), decision("", 4),
        decision("a", 5, capsule="other"), decision("c", 6, context="{bad"),
    ).withColumn("arrival", F.col("ts_ms"))
    got = I.ingest_decisions(new, decisions(spark, decision("b", 0)))
    assert {r["ts_ms"]: r["outcome"] for r in got.collect()} == {
        1: "inserted", 2: "duplicate", 3: "duplicate", 4: "invalid", 5: "inserted", 6: "invalid",
    }


def test_rewards_count_once(spark):
    d = decisions(spark, decision("a", 1), decision("b", 1))
    old = rewards(spark, reward("b", 41, 1, "used"))
    new = rewards(
        spark, reward("a", None, 1, "k", ts=1), reward("a", None, 2, "k", ts=2),
        reward("zz", None, 1, "z", ts=3), reward("a", None, float("nan"), "n", ts=4),
        reward("b", None, 1, "used", ts=5), reward("b", None, 7, "fresh", ts=6),
    ).withColumn("arrival", F.col("ts_ms"))
    out = I.ingest_rewards(new, d, old)
    got = {r["arrival"]: (r["outcome"], r["seq"]) for r in out.collect()}
    assert got == {
        1: ("applied", 42), 2: ("duplicate", None), 3: ("unknown_decision", None),
        4: ("invalid", None), 5: ("duplicate", None), 6: ("applied", 43),
    }
    stored = old.unionByName(out.filter("outcome = 'applied'").select(old.columns))
    dup = {r["arrival"]: r["stored_seq"] for r in I.duplicate_of(out, stored).collect()}
    assert dup == {2: 42, 5: 41}


def test_running_an_ingest_again_changes_nothing(spark):
    new = decisions(spark, decision("a", 1), decision("b", 2)).withColumn("arrival", F.col("ts_ms"))
    first = I.ingest_decisions(new).filter("outcome = 'inserted'")
    again = I.ingest_decisions(new, first.select([f.name for f in DECISIONS.fields]))
    assert again.filter("outcome = 'inserted'").count() == 0


def test_sequence_blocks(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", 10)
    df = spark.range(0, 300, 3).select(
        F.lit("t").alias("tenant"), F.lit("j").alias("job"),
        F.concat(F.lit("c"), F.col("id") % 2).alias("capsule"), F.col("id").alias("arrival"),
    )
    rows = I.next_seq(df).orderBy("capsule", "arrival").collect()
    for c in ("c0", "c1"):
        assert [r["seq"] for r in rows if r["capsule"] == c] == list(range(1, 51))


def test_one_copy_may_hold_most_rows(spark):
    """A hot id: outcomes stay exact when nearly all rows are copies of one decision."""
    base = decisions(spark, decision("hot", 1))
    df = base.join(spark.range(5000).withColumnRenamed("id", "arrival"))
    df = df.withColumn("id", F.when(F.col("arrival") % 100 == 7, F.concat(F.lit("d"), "arrival"))
                       .otherwise(F.col("id")))
    got = dict(I.ingest_decisions(df).groupBy("outcome").count().collect())
    assert got == {"inserted": 51, "duplicate": 4949}


def test_paging(spark):
    d = decisions(spark, *[decision(f"d{i}", 10 * (i // 2)) for i in range(10)])
    first = R.page(d, KEYS, 4).collect()
    assert [r["id"] for r in first] == ["d0", "d1", "d2", "d3"]
    second = R.page(d, KEYS, 4, after_id="d3").collect()
    assert [r["id"] for r in second] == ["d4", "d5", "d6", "d7"]
    newest = R.page(d, KEYS, 3, newest=True, after_id="d8").collect()
    assert [r["id"] for r in newest] == ["d7", "d6", "d5"]
    with pytest.raises(R.UnknownCursor):
        R.page(d, KEYS, 3, after_id="gone")


def test_retention(spark):
    d = decisions(spark, decision("old", 1), decision("new", 100))
    w = rewards(spark, reward("old", 1, 1, ts=500), reward("new", 2, 1, ts=0))
    kept, kept_w, counts = H.prune(d, w, 50)
    assert [r["id"] for r in kept.collect()] == ["new"]
    assert [r["decision_id"] for r in kept_w.collect()] == ["new"]
    assert tuple(counts.first()[3:]) == (1, 1)
    heads = spark.createDataFrame([("t", "j", "c", 1, 0)], "tenant string, job string, capsule "
                                  "string, version bigint, reward_seq bigint")
    assert H.unlearned_losses(d, w, heads, 50).count() == 1
    assert H.unlearned_losses(d, w, heads.withColumn("reward_seq", F.lit(1)), 50).count() == 0
    both, audit = H.erase({"d": d, "w": w}, ("t", "j"), 7)
    assert both["d"].count() == 0 and json.loads(audit.first()["detail"]) == {"removedRows": 4}


def test_default_reward_and_late_reward(spark):
    d = decisions(spark, decision("a", 0), decision("b", 900_000))
    none = rewards(spark)
    due = I.default_rewards(d, none, 1_000_000, 0.0, 600)
    assert [r["decision_id"] for r in due.collect()] == ["a"]
    assert due.first()["idempotency_key"] == "a"
    late = rewards(spark, reward("a", None, 1, "a", ts=9)).withColumn("arrival", F.col("ts_ms"))
    stored = due.withColumn("seq", F.lit(1).cast("bigint")).select(none.columns)
    assert I.ingest_rewards(late, d, stored).first()["outcome"] == "duplicate"
    again = I.default_rewards(d, stored, 1_000_000, 0.0, 600)
    assert again.count() == 0


def test_activation_window(spark):
    day = 24 * 3600 * 1000
    d = decisions(spark, decision("a", 0), decision("b", 0), decision("c", 0))
    acts = spark.createDataFrame(
        [("t", "j", "c", "a", day - 1), ("t", "j", "c", "b", day)],
        "tenant string, job string, capsule string, id string, ts_ms bigint",
    )
    held = rewards(spark, reward("a", 1, 1), reward("b", 2, 1), reward("c", 3, 1))
    live, released = I.activate(d, acts, held)
    assert [r["id"] for r in live.collect()] == ["a"]
    assert [r["decision_id"] for r in released.collect()] == ["a"]


def test_key_rules(spark):
    bad = decisions(
        spark, decision("a", 1, capsule=""), decision("a", 2, capsule=".."),
        decision("a", 3, capsule="x/y"), decision("a", 4, capsule="é" * 128),
        decision("a\0", 5), decision("x" * 257, 6), decision("ok", 7, probability=1.5),
    )
    got = {r["ts_ms"]: r["problem"] for r in validate_decisions(bad).collect()}
    assert got == {
        1: "capsule_invalid", 2: "capsule_invalid", 3: "capsule_invalid", 4: None,
        5: "id_invalid", 6: "id_invalid", 7: "probability_range",
    }


def test_health_of_a_clean_log(spark):
    d, w = decisions(spark, decision("a", 1)), rewards(spark, reward("a", 1, 0.5))
    assert all(r["n"] == 0 for r in health(d, w, 0.0, 1.0).collect())


def test_event_log_round_trip(spark, tmp_path):
    d = decisions(spark, *[decision(f"d{i}", i * 3_600_000, capsule=f"c{i % 2}") for i in range(99)])
    path = str(tmp_path / "log")
    logs.write_event_log(d, path)
    got = logs.read_event_log(spark, path, ("t", "j", "c1"), 36_000_000, 90_000_000)
    assert sorted(r["ts_ms"] for r in got.collect()) == [h * 3_600_000 for h in range(11, 25, 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "GreaterThanOrEqual(ts_ms" in plan


def test_jsonl_file(spark, tmp_path):
    rows = [
        {"decisionId": "d1", "context": {"u": 1}, "actions": [{"id": "a"}, {"id": "b"}],
         "eligible": ["b", "a"], "pmf": [0.2, 0.8], "chosenIndex": 1, "action": "b",
         "probability": 0.2, "rewards": [{"seq": 9, "reward": 2}, {"seq": 3, "reward": 1.5}]},
        {"decisionId": "d2", "actions": [{"id": "a"}], "eligible": [0], "pmf": None, "chosen": 0},
        {"decisionId": "d3", "actions": [{"id": "a"}], "eligible": [0], "pmf": [1.0], "chosen": 0,
         "probability": 1.0, "rewrd": 1},
        {"decisionId": "d4", "actions": [{"id": "a"}], "eligible": ["q"], "pmf": [1.0], "chosen": 0,
         "probability": 1.0},
    ]
    path = tmp_path / "rows.jsonl"
    path.write_text("﻿" + "\n\n".join(json.dumps(r) for r in rows) + "\njunk\n", encoding="utf-8")
    for how, want in (("first", 1.5), ("sum", 3.5)):
        got = {
            r["id"]: r for r in logs.read_logged_rows(spark, str(path), KEYS, how).collect()
        }
        assert got["d1"]["reward"] == want and list(got["d1"]["eligible"]) == [1, 0]
        assert got["d1"]["problem"] is None and got["d2"]["problem"] == "legacy"
        assert got["d3"]["problem"] == "unknown_field"
        assert got["d4"]["problem"] == "eligible_unknown_id"
        assert got[None]["problem"] == "not_json"


def test_dsjson_import_is_idempotent(spark):
    def event(i, **other):
        doc = {
            "EventId": f"e{i}", "Timestamp": "2024-01-01T00:00:00.1234567Z", "a": [2, 1],
            "p": [0.8, 0.2], "_label_cost": -1.5, "VWState": {"m": "x"},
            "c": {"User": [{"tier": "x"}, {"tier": "y"}],
                  "_multi": [{"_tag": "A", "Topic": {"k": 1}}, {"i": {"constant": 1, "id": "B"}}]},
        }
        doc.update(other)
        return json.dumps(doc)

    lines = [event(i) for i in range(20)] + [
        event(90, DeferredAction=True), event(91, c={"_slots": [], "_multi": []}), "junk",
        event(92, p=[0.5, 0.2]), event(93, Timestamp="2024-01-01 00:00"),
    ]
    df = spark.createDataFrame(
        [("t", "j", "c", i, v) for i, v in enumerate(lines)],
        "tenant string, job string, capsule string, arrival bigint, value string",
    )
    p = dsjson.parse_dsjson(df)
    d, w = dsjson.import_decisions(p), dsjson.import_rewards(p, 0.0, 1.0)
    one = d.filter("id = 'e0'").first()
    assert (one["chosen_id"], one["probability"], list(one["pmf"])) == ("B", 0.8, [0.2, 0.8])
    assert one["ts_ms"] == 1704067200123 and json.loads(one["context"]) == {"User": {"tier": "y"}}
    report = dsjson.import_report(p, I.ingest_decisions(d), I.ingest_rewards(w, d)).first()
    assert report.asDict() == {
        "lines": 25, "decisions": 20, "rewards": 20, "already_present": 0, "skipped_deferred": 1,
        "skipped_multislot": 1, "invalid": 3,
    }
    paid = I.ingest_rewards(w, d).filter("outcome = 'applied'")
    again = dsjson.import_report(p, I.ingest_decisions(d, d), I.ingest_rewards(w, d, paid)).first()
    assert (again["decisions"], again["rewards"], again["already_present"]) == (0, 0, 20)
    assert [r["problem"] for r in dsjson.first_errors(p).collect()] == [
        "not_json", "pmf_sum", "timestamp_invalid",
    ]


def test_export_gives_each_decision_once(spark, tmp_path):
    d = decisions(spark, decision("a", 1, seed=-1), decision("b", 2))
    w = rewards(spark, *[reward("a", i + 1, i, f"k{i}", detail='{"x":1}') for i in range(3000)])
    lines = exports.export_decisions(d, w)
    one = {r["id"]: json.loads(r["value"]) for r in lines.collect()}
    assert set(one) == {"a", "b"} and [e["seq"] for e in one["a"]["rewards"]] == list(range(1, 3001))
    assert one["a"]["seed"] == str(2**64 - 1) and one["b"]["rewards"] == []
    assert one["a"]["rewards"][3]["detail"] == {"x": 1}
    exports.write_lines(lines, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_audit_of_promotions_is_spec_history(spark):
    def row(seq, event, detail, capsule="c"):
        return ("t", "j", capsule, seq, event, detail)

    audit = spark.createDataFrame(
        [
            row(1, "capsule_created", '{"patch":{"exploration":{"epsilon":0.2}}}'),
            row(2, "promotion_refused", '{"patch":{"mode":"frozen"}}'),
            row(3, "spec_promoted", '{"patch":"{\\"exploration\\":{\\"epsilon\\":0.05}}"}'),
            row(4, "spec_changed", '{"patch":{"mode":"nonsense"}}'),
            row(1, "spec_changed", '{"patch":{"mode":"frozen"}}', "d"),
        ],
        "tenant string, job string, capsule string, seq bigint, event string, detail string",
    )
    got = {r["capsule"]: (json.loads(r["spec"]), r["refused"]) for r in H.spec_history(audit).collect()}
    assert got["c"][0]["mode"] == "learner" and got["c"][0]["exploration"]["epsilon"] == 0.05
    assert got["c"][1] == 1 and got["d"][0]["mode"] == "frozen"


def test_ewma_stretches(spark):
    values = np.random.default_rng(2).random(100)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(values)],
                               "g string, o bigint, v double")
    want = values[0]
    for v in values[1:]:
        want = 0.3 * v + 0.7 * want
    for window in (1, 7, 1000):
        got = R.ewma(df, ["g"], "o", "v", 0.3, window).first()["forecast"]
        assert got == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("percent", [0, 12.5, 50, 99, 100])
def test_percentiles_are_exact(spark, percent, monkeypatch):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=501), None: rng.integers(0, 5, 200) * 1.0, "one": np.array([3.5]), "flat": np.ones(9)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for ranges in (4096, 3):
        monkeypatch.setattr(R, "RANGES", ranges)
        got = {r["g"]: r for r in R.column_stats(df, ["g"], "v", percent).collect()}
        assert set(got) == {*groups, "empty"} and got["empty"]["percentile"] is None
        for g, values in groups.items():
            assert got[g]["percentile"] == pytest.approx(np.percentile(values, percent), rel=1e-12)
            assert got[g]["mean"] == pytest.approx(values.mean())


def test_a_large_row_group_is_spread(spark, tmp_path, monkeypatch):
    """However a file is cut into splits, tasks get about the same number of rows, and their number grows with the rows."""
    from policylens.plans import sample_log

    spark.range(2000).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(sample_log, "PIECE_ROWS", 100)
    pieces = sample_log.spread(spark.read.parquet(str(tmp_path / "t")))
    sizes = [r["count"] for r in pieces.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 200 and sum(sizes) == 2000


def test_shared_parts_of_a_line_are_parsed_once(spark):
    """What several rules read of a line is in the plan once."""
    from policylens.sources import dsjson, logs

    lines = spark.createDataFrame([("{}",)], "value string")
    made = lines.select(F.reverse("value").alias("value"))

    def times(df, what):
        return df._jdf.queryExecution().optimizedPlan().toString().count(what)

    rows = logs.parse_logged_rows(lines)
    assert times(rows, "json_object_keys(value") + times(rows, "jsonObjectKeys(value") == 1
    assert times(logs.parse_uploaded_decisions(lines), "try_to_number(") == 1
    assert times(dsjson.parse_dsjson(lines), "parseJson(value") == 1
    assert times(logs.clean_lines(made), "reverse(") == 1


def test_byte_order_marks_and_blank_lines(spark):
    from policylens.sources.logs import clean_lines

    lines = spark.createDataFrame([("﻿{}",), ("﻿",), ("  ",), (None,), ("a﻿",), ("﻿﻿b",)], "value string")
    assert [r["value"] for r in clean_lines(lines).collect()] == ["{}", "a﻿", "﻿b"]


def upload_line(**other):
    item = {
        "decisionId": "d1", "tsMs": 5, "modelTag": "t", "modelVersion": 4, "seed": "7",
        "input": {"context": {"z": 0.1, "a": [1, {"y": 2, "b": None}]}, "actions": [{"id": "x", "features": {"q": 1, "c": 0.25}}]},
        "chosenIndex": 0, "chosenId": "x", "probability": 0.75, "pmf": [0.75, 0.25], "eligible": [0, 1],
    }
    return json.dumps({"decisions": [{**item, **other}]}, separators=(",", ":"), ensure_ascii=False)


def test_plain_upload_lines_are_read_as_any_other(spark):
    """A line that skips the variants gives the rows that the variants give; a blank behind it sends it to them."""
    one, given = upload_line(), {"context": {"k": 0.5}, "actions": []}
    plain = [
        one, one[:-2] + "," + upload_line(decisionId="d2")[14:], upload_line(extra=1), upload_line(seed=12), upload_line(seed=0.5),
        upload_line(input={**given, "more": 1}), upload_line(input={**given, "baselineAction": None}), upload_line(tsMs="5"),
        upload_line(seed="18446744073709551615"), upload_line(tsMs=12345678901234567890), upload_line(pmf=[0.1, "x"]),
        upload_line(pmf=None), upload_line(chosenId=["a", {"b": 1, "a": 0.001}]), upload_line(eligible=[0, 1.5]),
        upload_line(decisionId=0.1234567890123456), upload_line(input={**given, "context": [1]}), '{"decisions":[]}',
        upload_line(input={**given, "context": {"k": 0.0001, "a/b": "e-1", "": True}}),
        one.replace('"z":0.1', '"z":0.30000000000000005'), upload_line(probability=-0.5, tsMs=-5),
    ]
    left = [
        upload_line(tsMs=5.0), upload_line(probability=1e-7), upload_line(pmf=[1.0, 0]), upload_line(decisionId="é"),
        upload_line(decisionId="a\"b"), upload_line(input="{\"context\":null}"), upload_line(input=None), upload_line(seed=int("9" * 39)),
        one.replace('"tsMs":5', '"tsMs":5,"tsMs":6'), one.replace('"z":0.1', '"z":0.1,"z":0.1'), one.replace("0.75,0.25", "0.75, 0.25"),
        one.replace('"z":0.1', '"z":0.10'), one.replace('"z":0.1', '"z":NaN'), one.replace('"tsMs":5', '"tsMs":1e3'),
        one.replace('"z":0.1', '"z":12345678901234567.5'), one.replace('"tsMs":5', '"tsMs":-0'), '{"decisions":[null]}', '{"decisions":[5]}',
        '{"decisions":{"a":1}}', '{"decisions":[],"a":1}', "[" + one + "]", one + one, one[:-1], "no json", '"text"', one[:-1] + ',"more":1}',
        one.replace('"z":0.1', '"z":' + "[" * 1100 + "]" * 1100), upload_line(chosenId="x" * 50_000),
    ]

    def frame(lines):
        return spark.createDataFrame(list(enumerate(lines)), "n int, value string")

    def read(lines):
        return logs.parse_uploaded_decisions(frame(lines)).orderBy("n", "id").collect()

    tried = plain + left
    skips = {r["n"]: r["plain"] is not None for r in frame(tried).select("n", logs.plain_items(F.col("value")).alias("plain")).collect()}
    assert [skips[n] for n in range(len(tried))] == [True] * len(plain) + [False] * len(left)
    assert read(tried) == read([line + " " for line in tried])
    assert [r["problem"] for r in read([one])] == [None]


def test_upload_lines_share_what_their_copies_share(spark):
    """The text of a line is that of `to_json`, and what several lines of a decision share is made once."""
    from policylens.plans.learn_queries import lines_of, upload_lines, upload_parts

    rows = [
        ("t", "j", "c", 1, "d1", 5, "m", 4, 7, '{"b":1.50,"a":"\\"}\\n{"}', [("x", '{"q":1}'), ("y", None)], ["y"], 0, "x", 0.5, [0.5, 1e-7], [0]),
        ("t", "j", "c", 2, "{d\n}", None, None, None, None, None, [], None, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, (
        "tenant string, job string, capsule string, arrival bigint, id string, ts_ms bigint, model_tag string, model_version bigint, "
        "seed bigint, context string, actions array<struct<id:string,features:string>>, excluded_ids array<string>, chosen_index int, "
        "chosen_id string, probability double, pmf array<double>, eligible array<int>"
    ))
    item = F.struct(
        F.col("id").alias("decisionId"), F.col("ts_ms").alias("tsMs"), F.col("model_tag").alias("modelTag"),
        F.col("model_version").alias("modelVersion"), F.col("seed").cast("string").alias("seed"),
        F.struct(
            F.parse_json("context").alias("context"),
            F.transform("actions", lambda a: F.struct(a["id"].alias("id"), F.parse_json(a["features"]).alias("features"))).alias("actions"),
            F.col("excluded_ids").alias("excludedActions"),
        ).alias("input"),
        F.col("chosen_index").alias("chosenIndex"), F.col("chosen_id").alias("chosenId"), "probability", "pmf", "eligible",
    )
    whole = d.select("arrival", F.to_json(F.struct(F.array(item).alias("decisions"))).alias("value"))
    assert {tuple(r) for r in upload_lines(d).select("arrival", "value").collect()} == {tuple(r) for r in whole.collect()}
    copies = upload_parts(d, pmf=F.col("pmf")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4))))
    above, below = lines_of(copies, F.col("seed"), F.col("pmf"))._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")
    assert "parseJson" in below and "parseJson" not in above


def test_decisions_stay_where_they_are_to_meet_few_models(spark):
    decisions = spark.createDataFrame([("t", "j", "c", "m", 1), ("t", "j", "c", "gone", 2), ("t", "j", "c", None, 3)], "tenant string, job string, capsule string, model_tag string, n int")
    models = decisions.filter("n = 1").select("tenant", "job", "capsule", "model_tag").distinct().withColumn("version", F.lit(4))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = J.with_model(decisions, models)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r["n"], r["version"]) for r in got.collect()} == {(1, 4), (2, None), (3, None)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_verdict_leaves_the_upload_where_it_is(spark, folder, monkeypatch):
    """Of an upload, only what the replay compares and what a claim keeps is written with its verdict."""
    from policylens.plans import learn_queries as Q

    tables = {}

    def kept(df, name, write=uploads.written):
        tables[name] = df.columns
        return write(df, name)

    monkeypatch.setattr(uploads, "written", kept)
    out = Q.l6_claims(spark, folder)
    assert "context" in tables["uploads"] and {*tables["verdicts"]} == {"row_", "tenant", "job", "capsule", "id", "arrival", *uploads.SAME, "replays"}
    assert out.columns == ["capsule", "status", "why", "n"]
