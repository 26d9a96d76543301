"""Operators on single documents, vectors and archive records."""

from __future__ import annotations

import math
import random
import struct
import tracemalloc
from collections import Counter
from string import ascii_lowercase

import compare
import helpers
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from policylens.llm import bpe, common, langid, quality, revisits, topk, toxicity
from policylens.llm import queries as Q

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


# ---- byte-level BPE --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def reference(tokens):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_ids_equal_rank_merging(tokens, reference):
    rng = random.Random(1)
    texts = ["", "<|endoftext|> x", " " * 40, "a" * 5000, "\x00\x01é漢字🙂 \n\n x", "it's we'll"]
    texts += ["".join(rng.choice("ab \n\t'sé1🙂　th") for _ in range(80)) for _ in range(400)]
    encoder = bpe.Encoder(bpe.serialised_model(tokens), PATTERN)
    for text in texts:
        ids = reference.encode_ordinary(text)
        got = encoder.encode(text)
        assert got == struct.pack(f"<{len(ids)}I", *ids)
        assert bpe.decode(got, tokens) == text.encode()


def test_encode_documents(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    rows = helpers.odd_rows()
    got = bpe.encode_documents(helpers.documents(spark, rows), PATH, PATTERN).collect()
    expected = Counter((i, len(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in got) == expected
    assert bpe.encode_documents(helpers.documents(spark, []), PATH, PATTERN).count() == 0


def test_other_rank_files_are_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "x"))


# ---- language --------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, folder):
    docs = {r.doc_id: r.lang for r in Q.table(spark, folder, "documents").collect()}
    got = Q.op10(spark, folder).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in held]) > 0.9


def test_language_odd_rows(spark):
    rows = helpers.odd_rows()
    train = [(100 + i, helpers.sentence(random.Random(i), 30).replace("a", "xo" if i % 2 else "a"), "xx" if i % 2 else "yy") for i in range(40)]
    docs = helpers.documents(spark, train)
    model = langid.fit(docs.unionByName(helpers.documents(spark, [(1, None, "xx"), (2, "abc", None), (None, "x", "xx")])))
    assert model.groups == {"only xx": ["xx"], "only yy": ["yy"]}
    right = langid.identify(docs, model).collect()
    assert all(r.lang_pred == ("xx" if (r.doc_id - 100) % 2 else "yy") for r in right)
    got = langid.identify(helpers.documents(spark, rows), model)
    assert got.columns.count("score") == 1
    und = {r.doc_id for r in got.collect() if r.lang_pred == "und"}
    assert und == {1, 2, 3, 8, None}
    assert {r.score for r in got.collect() if r.lang_pred == "und"} == {0.0}
    empty = helpers.documents(spark, [])
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
    one = langid.fit(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.identify(docs, one).collect()} == {"xx"}


OUTSIDE = [
    "Hallitus päätti eilen että uusi laki tulee voimaan ensi vuoden alussa koko maassa",
    "Rząd zdecydował wczoraj że nowa ustawa wejdzie w życie na początku przyszłego roku",
    "Правительство вчера решило что новый закон вступит в силу",
    "xqzkj wvbnq kjhgf zxcvb qwrtp mnbvc lkjhg",
]


def plain_fits(train, texts):
    """The rule of `langid.Profiles`, text by text with dictionaries."""
    def trigrams(text):
        x, n = langid.counted([text])
        return {int(i): float(x[0, i]) ** 2 for i in np.flatnonzero(x[0])}, int(n[0])

    known, reached = [], []
    for lang in sorted({r[2] for r in train}):
        rows = [trigrams(t) for _, t, l in train if l == lang]
        back = rows[langid.HELD_BACK - 1 :: langid.HELD_BACK]
        rest = [r for i, r in enumerate(rows) if (i + 1) % langid.HELD_BACK]
        share = [langid.SPREAD / langid.DIMS] * langid.DIMS
        for r, _ in rest:
            for i, f in r.items():
                share[i] += (1 - langid.SPREAD) * f / len(rest)
        mean = sum(p * math.log(p) for p in share)
        unit = math.sqrt(sum(p * (math.log(p) - mean) ** 2 for p in share))
        score = lambda r, share=share: sum(f * math.log(share[i]) for i, f in r.items())
        usual = float(np.median([score(r) for r, _ in back]))
        far = lambda r, n, score=score, usual=usual, unit=unit: (score(r) - usual) / unit / math.sqrt(1 / n + 1 / langid.ENOUGH)
        known.append(far)
        reached += [far(*r) for r in back]
    least = min(sorted(reached)[int((1 - langid.FITTING) * (len(reached) - 1))], -langid.SURE)
    return [max(far(*trigrams(t)) for far in known) >= least for t in texts]


def test_texts_that_no_language_fits(spark, folder):
    import corpus_pipeline as pipeline

    docs = Q.table(spark, folder, "documents")
    clean = ["The and of the.", "Der die und ein heit.", "Que de la ción.", "La les des ment."]
    odd = helpers.documents(spark, [(10_000_000 + i, t, None) for i, t in enumerate([*OUTSIDE, *clean])], extra=False)
    kept = pipeline.language_id(spark, docs.unionByName(odd), folder).collect()
    assert {r.text for r in kept if r.doc_id >= 10_000_000} == set(clean)
    lettered = [r for r in docs.collect() if any(map(str.isalpha, r.text or ""))]
    assert sum(r.doc_id < 10_000_000 for r in kept) >= 0.97 * len(lettered)
    # a language that is left out does not fit the others
    model = langid.fit(docs.where("lang <> 'de'"))
    left = langid.identify(docs.where("lang = 'de' and n_chars > 200"), model).collect()
    assert left and sum(r.fits for r in left) <= 0.05 * len(left)


def test_what_fits_equals_the_plain_rule():
    rng = random.Random(8)
    train = [(i, helpers.sentence(rng, rng.randint(2, 60)).replace("a", "xo" if i % 3 else "a"), "xx" if i % 3 else "yy") for i in range(60)]
    x, n = langid.counted([t for _, t, _ in train])
    found, few = langid.profiles(x, n, np.array([r[2] for r in train], object))
    texts = [*OUTSIDE, *(helpers.sentence(rng, k) for k in (1, 2, 9, 50)), *(t[: 40 * k] + OUTSIDE[3] for k, (_, t, _) in enumerate(train[:8]))]
    got = (found.deviation(*langid.counted(texts)) >= found.least).any(1).tolist()
    assert not few and got == plain_fits(train, texts) and len(set(got)) == 2
    assert langid.profiles(x[:1], n[:1], np.array(["xx"], object)) == (None, {"xx"})
    alone, few = langid.profiles(x[:3], n[:3], np.array(["xx"] * 3, object))  # each held back in turn
    assert not few and (alone.deviation(x[:3], n[:3]) >= alone.least).all()


def test_samples_are_drawn_by_language(spark, monkeypatch):
    assert common.room([5, 1000, 3000], 400) == 197 and common.room([5, 7], 400) == 7 and common.room([], 9) == 0
    assert common.room([100] * 50, 60) == common.LEAST_ROWS
    rng = random.Random(5)
    rows = [(i, helpers.sentence(rng, 8), "nl" if i % 600 == 0 else "en" if i % 2 else "de") for i in range(3000)]
    rows += [(7_000_000, helpers.sentence(rng, 8), "en") for _ in range(1500)] + [(8, "same", "de")] * 1500
    docs = helpers.documents(spark, rows).withColumn("hash", common.sample_hash("doc_id", "text"))
    got = common.bounded_sample(docs, ["lang"], 400).collect()
    of = Counter(r.lang for r in got)
    assert of["nl"] == 5 and all(130 <= of[x] <= 270 for x in ("en", "de"))
    assert len({(r.doc_id, r.text) for r in got}) == len(got)
    assert 50 <= sum(r.doc_id == 7_000_000 for r in got) <= 150
    assert len(common.bounded_sample(docs, ["lang"], 10_000).collect()) == len(set(rows))
    monkeypatch.setattr(langid, "TRAIN_ROWS", 400)
    assert "nl" in langid.fit(docs).groups["germanic"]


def test_language_model_takes_little_of_the_driver(spark, monkeypatch):
    """Rows reach the driver packed, and stand there once: no second copy for the profiles or the machines."""
    rng = random.Random(8)
    alphabet = [str.maketrans("abcdefgh", ascii_lowercase[3 * k : 3 * k + 8]) for k in range(6)]
    rows = [(i, helpers.sentence(rng, 40).translate(alphabet[i % 6]), f"q{i % 6}") for i in range(1800)]
    sent, plain = [], langid.arrow_map

    def seen(*of):
        sent.append(plain(*of))
        return sent[-1]

    monkeypatch.setattr(langid, "arrow_map", seen)
    docs = helpers.documents(spark, rows, extra=False).localCheckpoint()
    tracemalloc.start()
    model = langid.fit(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.of_family) == 6
    got = sent[0].toArrow()
    assert got.num_rows == len(rows) and got.nbytes < len(rows) * langid.DIMS * 2 / 4
    assert peak < 1.6 * len(rows) * langid.DIMS * 4


def test_families():
    assert langid.family("en") == langid.family("DE-at") == "germanic" and langid.family("qq") == "only qq"


def test_three_languages_of_a_family_vote():
    texts = [w * 6 for w in ("abc ", "def ", "ghi ")]
    x = np.vstack([langid.vectors([t]) for t in texts for _ in range(5)])
    names = np.repeat(["en", "de", "nl"], 5)
    model = langid.LanguageModel({"germanic": ["de", "en", "nl"]})
    for a, b in (("de", "en"), ("de", "nl"), ("en", "nl")):
        here = (names == a) | (names == b)
        model.of_pair[a, b] = langid.train_svm(x[here], names[here] == a)
    assert model.predict(texts)[0] == ["en", "de", "nl"]


# ---- toxicity and quality --------------------------------------------------------------------------


def labelled(rows, n=400):
    rng = random.Random(3)
    out, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = helpers.sentence(rng, rng.randint(5, 60)).split()
        if bad:
            for _ in range(2):
                words[rng.randrange(len(words))] = "zorkling" + rng.choice("abcdefgh")
        out.append((i, " ".join(words), rng.choice(["en", "de"])))
        labels.append((i, int(not bad), int(bad)))
    return out + rows, labels


def test_toxicity_learns_a_prefix(spark):
    rows, labels = labelled([])
    docs = helpers.documents(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i].score >= 0.5, bool(t)) for i, _, t in labels if i % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert set(model.thresholds) == {"en", "de"}
    odd = toxicity.score(helpers.documents(spark, helpers.odd_rows()), model).collect()
    assert len(odd) == len(helpers.odd_rows()) and all(0 <= r.score <= 1 for r in odd)
    assert len({round(r.score, 5) for r in odd if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(helpers.documents(spark, []), model).count() == 0
    none = toxicity.fit(docs, marks.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_whole_texts_count(spark):
    rows, labels = labelled([])
    model = toxicity.fit(helpers.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    tail = "ab cd " * 20_000
    got = {r.doc_id: r.score for r in toxicity.score(helpers.documents(spark, [(1, tail), (2, tail + "zorklinga zorklingb")]), model).collect()}
    assert got[2] > got[1]


def test_long_texts_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SEEN", 300)
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(80):
        words = helpers.sentence(rng, 4000 if i % 2 else 20).split()
        if i % 4 == 1:
            words[rng.randrange(len(words))] = "zorkling"
        rows.append((i, " ".join(words), "fr" if i % 2 else "en"))
        labels.append((i, 1, int(i % 4 == 1)))
    assert sum(len(t) > 12_000 for _, t, _ in rows) == 40
    docs = helpers.documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(model.thresholds) == {"en", "fr"}
    sent = toxicity._sequences(docs.selectExpr("doc_id as hash", "lang", "1d as y", "text")).collect()
    texts = {i: t for i, t, _ in rows}
    assert all(list(map(tuple, np.frombuffer(r.slots, np.uint16).reshape(-1, 3))) == [toxicity.slots(w) for w in toxicity.words(texts[r.hash])] for r in sent)
    told = docs.selectExpr("lang", "xxhash64(doc_id) as hash", "octet_length(text) as bytes")
    assert len(common.bounded_sample(told, ["lang"], 80, 10**9).collect()) == 80
    fewer = Counter(r.lang for r in common.bounded_sample(told, ["lang"], 80, 400_000).collect())
    assert all(10 <= fewer[x] <= 35 for x in ("en", "fr"))


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Chunks of a few rows each: every labelled row is in one, once, and the model does not depend on how tables are cut."""
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 80)
    monkeypatch.setattr(toxicity, "SEEN", 5000)
    rng = random.Random(5)
    bad = [f"{a}{b}vile" for a in "qrst" for b in "uvwxy"]
    rows, marks = [], []
    for i in range(640):
        words = helpers.sentence(rng, rng.randint(3, 12)).split()
        if i % 2:
            words[rng.randrange(len(words))] = bad[i // 2 % len(bad)]
        rows.append((i, " ".join(words), [None, "en", "es"][i % 3]))
        marks.append((i, i % 2))
    marks += [(9999, 1), (None, 1), (1, None)]
    docs = helpers.documents(spark, [*rows, *rows[:100], (None, "x y"), (5000, "z")], extra=False)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    made, chunks = [], toxicity._chunks
    monkeypatch.setattr(toxicity, "_chunks", lambda *a: made.append(chunks(*a)) or made[-1])
    models = [toxicity.fit(docs.repartition(n), labels.repartition(m)) for n, m in ((1, 2), (9, 5))]
    assert np.array_equal(packed(models[0]), packed(models[1])) and models[0].thresholds == models[1].thresholds
    for held in made:
        found = held.collect()
        assert len(found) == 8 and all(r.n == len(r.y) - -(-len(r.y) // 5) for r in found)
        got = Counter((lang, y, n) for r in found for lang, y, n in zip(r.lang, r.y, r.words))
        assert got == Counter((lang, float(i % 2), len(toxicity.words(t))) for i, t, lang in rows)
    tests = [(i, f"abc {w} de") for i, w in enumerate(["", *bad])]
    got = {r.doc_id: r.score for r in toxicity.score(helpers.documents(spark, tests), models[0]).collect()}
    assert np.mean([got[i] for i in range(1, len(tests))]) > got[0]


def test_toxicity_chunks_make_no_large_rows(spark, monkeypatch):
    """A chunk of long texts goes on over small rows, and is learned from as if it were one."""
    monkeypatch.setattr(toxicity, "SEEN", 200)
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 100)
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 1_000_000)
    rng = random.Random(8)
    rows = [(i, helpers.sentence(rng, 12_000 if i == 7 else 3000 if i % 3 else 0), [None, "en", "es"][i % 3]) for i in range(160)]
    docs = helpers.documents(spark, rows, extra=False)
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, toxic int")
    made, chunks = [], toxicity._chunks
    monkeypatch.setattr(toxicity, "_chunks", lambda *a: made.append(chunks(*a)) or made[-1])
    models = [toxicity.fit(docs, labels)]
    found = made[0].collect()
    assert max(len(r.slots) for r in found) <= 1 << 17
    assert sum(len(r.slots) for r in found) == sum(6 * len(toxicity.words(t)) for _, t, _ in rows) > 1_500_000
    heads = [r for r in found if r.y is not None]
    assert 2 < len(heads) < len(found) and sum(len(r.y) for r in heads) == 160
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 1 << 30)
    models.append(toxicity.fit(docs.repartition(5), labels))
    assert made[1].count() == len(heads)
    assert np.array_equal(packed(models[0]), packed(models[1])) and models[0].thresholds == models[1].thresholds


def packed(model):
    return toxicity.packed(model, toxicity.fresh(1, 0)[1])


def test_thresholds():
    scores, labels = np.array([0.9, 0.8, 0.4, 0.3, 0.2]), np.array([1, 1, 1, 0, 0])
    assert toxicity.best_threshold(scores, labels) == 0.4
    assert toxicity.best_threshold(scores, labels * 0) == 0.5


def test_quality(spark, folder):
    truth = {r.doc_id: r.quality for r in Q.table(spark, folder, "labels").collect()}
    got = Q.op9(spark, folder).collect()
    assert len(got) == Q.table(spark, folder, "documents").count() and all(0 <= r.score <= 1 for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.85


def test_quality_odd_rows(spark):
    rows = helpers.documents(spark, helpers.odd_rows())
    none = quality.fit(quality.measured(rows.where("doc_id < 0")).selectExpr("x", "n_chars as quality"))
    got = quality.score(quality.measured(rows), none).collect()
    assert len(got) == len(helpers.odd_rows()) and {r.score for r in got} == {0.5}
    assert all(map(math.isfinite, quality.statistics(None))) and len(quality.statistics("a b")) == len(quality.STATISTICS)


def test_normal_equations_do_not_depend_on_partitions(spark, folder):
    docs = Q.table(spark, folder, "documents").join(Q.table(spark, folder, "labels"), "doc_id")
    a, b = (quality.fit(quality.measured(docs.repartition(n))).weights for n in (1, 7))
    assert np.allclose(a, b, atol=1e-6)


def test_isotonic():
    n = np.array([0, 2, 1, 0, 1, 4, 0])
    ones = np.array([0, 0, 1, 0, 0, 4, 0])
    fit = quality.isotonic(ones, n)
    assert np.allclose(fit, [0, 0, 0.5, 0.5, 0.5, 1, 1]) and (np.diff(fit) >= 0).all()


# ---- top-k -----------------------------------------------------------------------------------------


def plain_top(vectors, queries, k):
    out = set()
    for q, x in set(queries):
        scored = sorted({(-sum(a * b for a, b in zip(x, y)), i, y) for i, y in set(vectors) if i != q and len(y) == len(x)})
        out |= {(q, r + 1, i, -s) for r, (s, i, _) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("block,shard,crowd,seeds", [(256, 32, 4096, 2048), (5, 2, 3, 2048), (5, 2, 3, 4)])
def test_search(spark, monkeypatch, block, shard, crowd, seeds):
    for name, value in (("BLOCK", block), ("TASK_BLOCKS", shard), ("TASK_QUERIES", crowd), ("SEEDS", seeds)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(2)
    vectors = [(i, tuple(rng.randint(-9, 9) for _ in range(4))) for i in range(120)]
    vectors += [(200 + i, (3, 1, 2, 0)) for i in range(30)] + [(300, (1, 2)), (301, (5, 5)), (302, (5, 5)), (7, (1, 1, 1, 1)), (400, ())]
    repeated = vectors + vectors[:10] + [(None, (1, 2, 3, 4)), (500, None)]
    df = spark.createDataFrame([(i, None if v is None else list(v)) for i, v in repeated], "id long, x array<long>")
    got = topk.search(df, df.where("id % 3 = 0"), 7).collect()
    expected = plain_top(vectors, [(i, v) for i, v in vectors if i % 3 == 0 and v], 7)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == expected and len(got) == len(expected)


def test_pruning_skips_blocks():
    rng = np.random.default_rng(1)
    blocks = [(np.arange(i * 50, i * 50 + 50), rng.integers(0, 9, (50, 8)) + 40 * i) for i in range(20)]
    ids, rows = np.array([-1, -2]), np.ones((2, 8), np.int64)
    search = topk.Search(ids, rows, np.full(2, topk._LOWEST), 10)
    assert search.run(blocks) < 2 * len(blocks)
    flat = np.concatenate([b[1] for b in blocks]).sum(1)
    assert list(search.scores[0]) == sorted(flat.tolist(), reverse=True)[:10]


def test_products_beyond_doubles():
    a = np.array([[2**31, 1]])
    assert topk.product(a, a)[0, 0] == 2**62 + 1


def test_quantised(spark):
    rows = [(1, [0.5, -0.0001]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf")]), (6, [])]
    df = spark.createDataFrame(rows, "id long, e array<float>")
    got = {r.id: r.x for r in df.select("id", topk.quantised(df["e"]).alias("x")).collect()}
    assert got == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_no_vectors(spark):
    df = spark.createDataFrame([], "id long, x array<long>")
    assert topk.search(df, df, 3).count() == 0


# ---- revisits --------------------------------------------------------------------------------------


def record(i, ts, kind="revisit", url="http://a.b/c", status=200, digest=None, **headers):
    return (i, url, ts, kind, status, {k.replace("_", "-"): v for k, v in headers.items()} or None, digest, "clash")


RECORDS = "record_id long, url string, ts long, kind string, status int, headers map<string,string>, digest string, key string"


@pytest.mark.parametrize("block", [1, 10, 3600])
def test_revisits(spark, block):
    rows = [
        record(1, 5, "response", digest="d1", etag='"x"', content_type="t", date="then"),
        record(2, 5, etag='W/"x"', date="now", server="no"),
        record(3, 3, etag='"x"'),
        record(4, 40, "response", status=500, etag='"z"'),
        record(5, 41, etag='"y"'),
        record(6, 42, last_modified="m"),
        record(7, 50, "response", digest="d7", last_modified="m"),
        record(8, 9000, url="HTTPS://www.A.B:443/c/?utm_source=q#f", last_modified="m"),
        record(8, 9000, url="HTTPS://www.A.B:443/c/?utm_source=q#f", last_modified="m"),
        record(9, 9001),
        record(10, None, etag='"x"'),
        record(11, 60, url=None, etag='"x"'),
    ]
    got = revisits.resolve(spark.createDataFrame(rows, RECORDS), block).collect()
    told = Counter((r.record_id, r.outcome, r.response_id, r.response_digest) for r in got)
    assert told == Counter([
        (2, "resolved", 1, "d1"), (3, "no_response", None, None), (5, "mismatch", 1, None), (6, "unverified", 1, None),
        (8, "resolved", 7, "d7"), (8, "resolved", 7, "d7"), (9, "unverified", 7, None), (10, "no_response", None, None),
        (11, "no_response", None, None),
    ])
    merged = next(r.merged for r in got if r.record_id == 2)
    assert merged == {"etag": 'W/"x"', "date": "now", "content-type": "t"}
    assert all(r.key == "clash" for r in got)
    assert revisits.resolve(spark.createDataFrame([], RECORDS)).count() == 0


def test_revisit_query_does_not_depend_on_the_block(spark, folder):
    records = revisits.captures(Q.table(spark, folder, "pages"))
    a, b = (sorted(map(str, revisits.resolve(records, n).collect())) for n in (7, 10**9))
    assert a == b


# ---- the registered queries ------------------------------------------------------------------------


def test_all_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names
    assert set(compare.TABLES) > {"documents", "embeddings", "pages"}


def test_pipeline_stages(spark, folder):
    import corpus_pipeline as pipeline

    docs = Q.table(spark, folder, "documents")
    columns = docs.columns
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "leaked_tests", "byte_bpe"]
    odd = helpers.documents(spark, [(10_000_000 + (i or 7), t) for i, t in helpers.odd_rows()], extra=False)
    for table in (docs.unionByName(odd), odd.limit(0)):
        rows = table
        for _, stage in pipeline.STAGES[:-1]:
            rows = pipeline.written(stage(spark, rows, folder), "test")
            assert rows.columns == columns
        last = pipeline.STAGES[-1][1](spark, rows, folder).collect()
        assert len(last) == rows.count() and all(r.round_trip for r in last)
