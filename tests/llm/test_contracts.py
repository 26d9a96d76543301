"""Cases that the queries' contracts settle: rows without an id, repeated rows, ties, and models that ignore how tables are cut."""

from __future__ import annotations

import random

import compare
import duckdb
import helpers
import numpy as np

from policylens.llm import common, decontaminate, revisits, simhash, substrings, toxicity
from policylens.llm import queries as Q


def in_duckdb(sql: str, **tables):
    """A twin over small tables."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con, sql


def test_items_without_an_id_hit_words(spark):
    rng = random.Random(1)
    item, named = helpers.sentence(rng, 14), helpers.sentence(rng, 12)
    docs = helpers.documents(spark, [(1, "x " + item + " y"), (2, named + " " + item), (3, helpers.sentence(rng, 30)), (None, item), (4, None)])
    items = spark.createDataFrame([(None, item), (7, named), (8, ""), (None, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.item_ids) for r in decontaminate.report(docs, items).collect()}
    assert got == {1: (14, 0, []), 2: (26, 1, ["7"]), 3: (0, 0, []), None: (14, 0, []), 4: (0, 0, [])}
    con, sql = in_duckdb(Q.OP1_SQL, documents=docs.where("doc_id is not null"), benchmark=items)
    told = {r[0]: (r[2], r[3]) for r in con.execute(sql).fetchall()}
    assert told == {k: v[:2] for k, v in got.items() if k is not None}


def test_repeated_rows_of_the_word_windows(spark):
    rng = random.Random(2)
    text, other = helpers.sentence(rng, 30), helpers.sentence(rng, 25)
    docs = helpers.documents(spark, [(1, text), (1, text), (2, other), (2, other), (3, "a " + text), (4, "b")], extra=False)
    found = substrings.deduplicate(docs.select("doc_id", "text"), keep=["doc_id"])
    mine = found.selectExpr("doc_id", "n_words", "n_removed", "sha2(cast(kept as binary), 256) as kept_sha256")
    con, sql = in_duckdb(Q.OP7_SQL, documents=docs)
    assert compare.mismatch(mine, con, sql) is None
    assert sorted((r.doc_id, r.n_removed) for r in found.collect()) == [(1, 0), (1, 0), (2, 0), (2, 0), (3, 30), (4, 0)]


def test_records_of_one_time_and_id_have_an_order(spark):
    rows = [(1, "http://a/", 5, "response", 200, {"etag": '"x"'}, d, None) for d in ("d1", "d2")]
    rows += [(1, "http://a/", 5, "revisit", 304, {"etag": '"x"'}, None, None), (2, "http://a/", 9, "revisit", 304, {"etag": '"x"'}, None, None)]
    kinds = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, key string"
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = revisits.resolve(spark.createDataFrame(rows, kinds).repartition(1 + seed)).collect()
        assert {(r.record_id, r.outcome, r.response_digest) for r in got} == {(1, "resolved", "d2"), (2, "resolved", "d2")}


def test_toxicity_does_not_depend_on_how_tables_are_cut(spark):
    rng = random.Random(3)
    bad = ["vile", "scum", "rot"]
    rows, marks = [], []
    for i in range(240):
        words = helpers.sentence(rng, rng.randint(3, 20)).split()
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), "en" if i % 2 else "es"))
        marks.append((i, int(i % 3 == 0)))
    docs, labels = helpers.documents(spark, rows, extra=False), spark.createDataFrame(marks, "doc_id long, toxic int")
    models = [toxicity.fit(docs.repartition(n), labels.repartition(m)) for n, m in ((1, 1), (7, 3), (23, 11))]
    for other in models[1:]:
        assert other.thresholds == models[0].thresholds and other.base == models[0].base
        assert np.array_equal(other.embedding, models[0].embedding) and np.array_equal(other.out, models[0].out)
        assert all(np.array_equal(other.filters[w], f) for w, f in models[0].filters.items())
    # the pooled response is the largest over all places, padding at both ends included
    assert 0 < min(models[0].thresholds.values()) < 1


def test_many_groups_do_not_lift_the_bound_of_a_sample(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_GROUPS", 5)
    rows = spark.range(6000).selectExpr("id", "case when id < 3000 then 'large' else concat('g', id % 1500) end as g", "xxhash64(id) as hash")
    got = common.bounded_sample(rows, ["g"], 400).groupBy("g").count().collect()
    n = {r.g: r["count"] for r in got}
    assert sum(n.values()) <= 520 and n["large"] >= 200 and len(n) > 20
    assert common.bounded_sample(rows.where("id < 100"), ["g"], 400).count() == 100


def test_repeated_and_linked_rows_stay_once(spark):
    rng = random.Random(9)
    a, b = helpers.sentence(rng, 60), helpers.sentence(rng, 60)
    kept = simhash.keep_first(helpers.documents(spark, [(2, a), (2, a), (1, a), (3, b), (3, b), (None, b), (None, b), (4, None), (4, None)]))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (3, b), (None, b), (None, b), (4, None)], key=str)
