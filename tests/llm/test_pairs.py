"""Operators that compare documents, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import helpers
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from policylens.llm import components, decontaminate, simhash, substrings, suffix_array




# ---- SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aAbÉ \n\t \x1f", max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("seed", range(6))
def test_trie_links_are_the_pairs_within_the_budget(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(48, rng.integers(0, 7), replace=False)) for _ in range(400)], np.uint64)
    leaves = np.unique(base[rng.integers(0, 4, 400)] ^ flips)
    near = np.bitwise_count(leaves[:, None] ^ leaves[None, :]) <= 3
    near &= (leaves[:, None] >> np.uint64(48)) == (leaves[None, :] >> np.uint64(48))
    a, b = np.nonzero(near)
    assert np.array_equal(simhash.trie_links(leaves), simhash.forest(len(leaves), a, b))


def test_a_dense_ball_is_one_component():
    leaves = np.sort(np.array([a << 20 | b for a in range(16) for b in range(256)], np.uint64))
    assert set(simhash.trie_links(leaves)) == {0}


def plain_groups(prints):
    ids = list(prints)
    fp = np.array([prints[i] for i in ids], np.uint64)
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    root = simhash.forest(len(ids), a, b)
    return {i: min(ids[k] for k in range(len(ids)) if root[k] == root[j]) for j, i in enumerate(ids)}


def near_copies(n=160):
    rng = random.Random(1)
    rows, texts = [], [helpers.sentence(rng, 200) for _ in range(12)]
    for i in range(n):
        words = texts[i % 12].split() if i % 3 else helpers.sentence(rng, 50).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "zz"
        rows.append((1000 - i, " ".join(words)))
    return rows


@pytest.mark.parametrize("part", [2048, 5])
def test_simhash_groups(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rows = near_copies()
    got = simhash.near_duplicates(helpers.documents(spark, rows)).collect()
    expected = plain_groups({i: plain_fingerprint(t) for i, t in rows})
    assert {r.doc_id: r.component_id for r in got} == expected
    assert len(set(expected.values())) < len(rows)


def test_simhash_odd_rows(spark):
    rows = helpers.odd_rows()
    got = simhash.near_duplicates(helpers.documents(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[5] == 4
    assert sorted(r.component_id for r in got if r.doc_id is None) == [1, 4]
    empty = helpers.documents(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_keep_first(spark):
    docs = helpers.documents(spark, helpers.odd_rows())
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 6, 7, 8, 9, 10, None, None])


def test_keep_first_tells_texts_of_one_id_apart(spark):
    rng = random.Random(6)
    a, b, c, d = (helpers.sentence(rng, 80) for _ in range(4))
    rows = [(3, a), (5, a), (5, b), (5, c), (5, c), (8, c), (5, d), (9, d), (None, a)]
    kept = Counter((r.doc_id, r.text) for r in simhash.keep_first(helpers.documents(spark, rows)).collect())
    assert kept == Counter([(3, a), (5, b), (5, c), (5, d), (None, a)])
    # two linked texts of the smallest id: one stays
    words = b.split()
    options = [" ".join(words[:i] + ["zz"] + words[i + 1 :]) for i in range(len(words))]
    near = next(t for t in options if (plain_fingerprint(t) ^ plain_fingerprint(b)).bit_count() <= 3)
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(helpers.documents(spark, [(1, b), (1, near), (2, b)])).collect()]
    assert len(kept) == 1 and kept[0][0] == 1


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    root = simhash.forest(len(nodes), np.array([at[a] for a, b in links if a != b]), np.array([at[b] for a, b in links if a != b]))
    assert got == {x: nodes[root[i]] for x, i in at.items()}


# ---- repeated bytes and words ----------------------------------------------------------------------


def passages(n=40, seed=3):
    """Texts that share passages, copies, edited copies and periodic runs."""
    rng = random.Random(seed)
    shared = [helpers.sentence(rng, k) for k in (30, 45, 80, 200)]
    rows = []
    for i in range(n):
        parts = [helpers.sentence(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), helpers.sentence(rng, rng.randint(0, 30))]
        if i % 9 == 0:
            parts.append("na " * rng.randint(1, 200))
        text = " ".join(parts)
        rows.append((i, text))
        if i % 5 == 0:
            cut = rng.randrange(max(1, len(text)))
            rows.append((1000 + i, text[:cut] + "é" + text[cut:]))
        if i % 7 == 0:
            rows.append((500 - i, text))
    return rows


def plain_repeats(texts: dict, length: int):
    """Per key which symbols a string that also starts elsewhere covers."""
    places = defaultdict(set)
    for key, symbols in texts.items():
        for i in range(len(symbols) - length + 1):
            places[tuple(symbols[i : i + length])].add((key, i))
    out = {k: np.zeros(len(s), bool) for k, s in texts.items()}
    later = {k: np.zeros(len(s), bool) for k, s in texts.items()}
    for found in places.values():
        if len(found) > 1:
            for key, i in found:
                out[key][i : i + length] = True
                if (key, i) != min(found):
                    later[key][i : i + length] = True
    return out, later


def test_suffix_array(spark):
    rows = passages()
    got = {r.doc_id: r for r in suffix_array.deduplicate(helpers.documents(spark, rows)).collect()}
    texts = {i: t.encode() for i, t in rows}
    expected, _ = plain_repeats(texts, 200)
    assert sum(e.sum() for e in expected.values()) > 1000
    for i, raw in texts.items():
        gone = expected[i]
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(raw), gone.sum(), runs), i
        assert bytes(got[i].kept) == np.frombuffer(raw, np.uint8)[~gone].tobytes()


def test_substrings(spark):
    rows = passages(seed=8)
    got = {r.doc_id: r for r in substrings.deduplicate(helpers.documents(spark, rows)).collect()}
    texts = {i: t.split() for i, t in rows}
    _, later = plain_repeats(texts, 20)
    assert sum(e.sum() for e in later.values()) > 500
    for i, words in texts.items():
        kept = " ".join(w for w, g in zip(words, later[i]) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(words), later[i].sum(), kept), i


@pytest.mark.parametrize("block,held", [(700, 1_000_000), (1 << 20, 50)])
def test_results_do_not_depend_on_block_sizes(spark, monkeypatch, block, held):
    from policylens.llm import anchors

    monkeypatch.setattr(anchors, "BLOCK", block)
    monkeypatch.setattr(anchors, "HELD", held)
    monkeypatch.setattr(substrings, "HELD", held)
    rows = passages(n=25, seed=5)
    docs = helpers.documents(spark, rows).repartition(5)
    found, later = plain_repeats({i: t.encode() for i, t in rows}, 200)[0], plain_repeats({i: t.split() for i, t in rows}, 20)[1]
    assert {r.doc_id: r.n_removed for r in suffix_array.deduplicate(docs).collect()} == {i: g.sum() for i, g in found.items()}
    assert {r.doc_id: r.n_removed for r in substrings.deduplicate(docs).collect()} == {i: g.sum() for i, g in later.items()}


def test_repeats_odd_rows(spark):
    rows = helpers.odd_rows()
    docs = helpers.documents(spark, rows)
    text = rows[3][1]
    found = suffix_array.deduplicate(docs, keep=["doc_id", "text"]).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(r[:2] for r in rows)
    # the repeated row of document 4 is no repetition of itself, document 5 is one of it
    assert {(r.doc_id, r.n_removed) for r in found if r.text == text} == {(4, len(text)), (5, len(text)), (None, len(text))}
    assert {r.doc_id: r.n_removed for r in found}[6] == len(helpers.LONG) * 30_000
    assert {r.doc_id: r.n_bytes for r in found}[1] == 0
    words = substrings.deduplicate(docs, keep=["doc_id", "text"]).collect()
    assert {(r.doc_id, r.n_removed) for r in words if r.text == text} == {(4, 0), (5, 120), (None, 0)}
    cut = suffix_array.removed(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert {r.doc_id: r.text for r in cut.collect()}[9] == "one two"
    assert {(r.kept, r.row, r.n) for r in cut.collect()} == {("kept", "row", "n")}
    empty = helpers.documents(spark, [])
    assert suffix_array.deduplicate(empty).count() == substrings.deduplicate(empty).count() == 0


def test_same_id_with_other_texts(spark):
    rng = random.Random(6)
    shared = helpers.sentence(rng, 90)
    docs = helpers.documents(spark, [(1, shared), (1, "x " + shared), (2, helpers.sentence(rng, 90))])
    found = suffix_array.deduplicate(docs, keep=["doc_id", "text"]).collect()
    assert {r.text[:2]: r.n_removed > 0 for r in found if r.doc_id == 1} == {shared[:2]: True, "x ": True}
    words = substrings.deduplicate(docs, keep=["doc_id", "text"]).collect()
    assert sorted(r.n_removed for r in words) == [0, 0, 90]


def test_a_cut_character_goes_whole(spark):
    rng = random.Random(7)
    shared = helpers.sentence(rng, 60)
    docs = helpers.documents(spark, [(1, "é" + shared), (2, "ĩ" + shared)], extra=False)
    # both letters have the same second byte in UTF-8, so only their first one is left of the texts
    assert [r.text for r in suffix_array.removed(docs).collect()] == ["", ""]


# ---- decontamination -------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items):
    found, hit, named = plain_words(text), set(), set()
    for item, test in items:
        w = plain_words(test)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if item is not None and n else 0):
            for j in range(len(found) - n + 1):
                if found[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    named.add(str(item))
    return len(found), len(hit), sorted(named)


def leaks():
    rng = random.Random(9)
    items = [(i, helpers.sentence(rng, n)) for i, n in enumerate((40, 25, 10, 3, 1))] + [(10, None), (11, "!?"), (None, "b c d"), (0, "q")]
    rows = []
    for i in range(30):
        words = helpers.sentence(rng, 60).split()
        at = rng.randrange(50)
        test = (items[i % 5][1]).split()
        words[at : at + 3] = test[: rng.randint(1, len(test))]
        rows.append((i, ", ".join(words).title() if i % 2 else "(" + "-".join(words)))
    return rows, items


@pytest.mark.parametrize("stretch,most,around", [(2048, 500_000, 20_000), (7, 500_000, 20_000), (2048, 0, 3), (7, 500_000, 3)])
def test_decontamination(spark, monkeypatch, stretch, most, around):
    monkeypatch.setattr(decontaminate, "TRIGGERS", around)
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    rows, items = leaks()
    rows += [r for r in helpers.odd_rows() if r[0] != 6]
    tests = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as key", "2 as window")
    got = decontaminate.report(helpers.documents(spark, rows), tests).collect()
    expected = Counter((r[0], *plain_hits(r[1], items)[:2], ",".join(plain_hits(r[1], items)[2])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids)) for r in got) == expected
    assert sum(r.n_hit > 0 for r in got) > 10


def test_decontamination_removes(spark):
    rows, items = leaks()
    docs = helpers.documents(spark, rows)
    tests = spark.createDataFrame(items, "item_id long, text string")
    clean = {i for i, t in rows if not plain_hits(t, items)[1]}
    kept = decontaminate.remove_documents(docs, tests)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    cut = decontaminate.remove_spans(docs, tests)
    assert cut.columns == docs.columns
    for r in cut.collect():
        text = dict(rows)[r.doc_id]
        n, hit, _ = plain_hits(text, items)
        assert (r.text == text) == (hit == 0) and len(plain_words(r.text)) == n - hit
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_documents(docs, none).count() == len(rows)
    assert {r.n_hit for r in decontaminate.report(docs, none).collect()} == {0}
    assert decontaminate.report(helpers.documents(spark, []), tests).count() == 0


def test_items_without_an_id_are_removed_as_well(spark):
    rng = random.Random(12)
    secret = helpers.sentence(rng, 14)
    rows = [(i, helpers.sentence(rng, 40) + (" " + secret if i % 3 == 0 else "")) for i in range(12)]
    docs = helpers.documents(spark, rows)
    tests = spark.createDataFrame([(None, secret), (1, helpers.sentence(rng, 12))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.remove_documents(docs, tests).collect()} == {i for i, _ in rows if i % 3}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, tests).collect()}
    assert all((secret in t) == (i % 3 == 0) and secret not in cut[i] for i, t in rows)
    # its words are hit in the report, too; only its id is left out
    assert {(r.doc_id % 3 == 0, r.n_hit, r.n_items) for r in decontaminate.report(docs, tests).collect()} == {(True, 14, 0), (False, 0, 0)}
