"""Clustering by bit planes, BPE with word ends and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import json
import random
import struct
import zlib
from collections import Counter
from itertools import combinations

import helpers
import numpy as np
import public_tokenizers
import pytest
import tokenizers

from policylens.llm import clustering, spelling, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


# ---- BPE with word ends ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return word_bpe.read_vocabulary(PATH)


def texts():
    rng = random.Random(3)
    out = [chr(i) for i in range(256)] + ["a" + chr(i) + "b" for i in range(256)]
    out += ["", " " * 9, "aaaa" * 700, "ab" * 900, "!" * 500, "x<|endoftext|><|startoftext|>y <|endoftext", "<|EndOfText|>", "漢字かな" * 60]
    out += ["".join(rng.choice("ab \n\t'sé1🙂　thİΣσςﬁ́\x1c\x85") for _ in range(70)) for _ in range(300)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(32, 0xD800)])) for _ in range(40)) for _ in range(300)]
    return out


@pytest.mark.parametrize("block", [65_536, 3])
def test_words_equal_the_library(library, vocabulary, monkeypatch, block):
    monkeypatch.setattr(word_bpe, "BLOCK", block)
    monkeypatch.setattr(word_bpe, "LONG", 1 << 20 if block > 3 else 10)
    monkeypatch.setattr(word_bpe, "CACHE", 1 << 20 if block > 3 else 5)
    encoder = word_bpe.Encoder(vocabulary)
    all_texts = texts()
    for text, got in zip(all_texts, encoder.encode(all_texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(ids)}I", *ids), text
        assert word_bpe.decode(got, vocabulary.tokens) == library.decode(ids, skip_special_tokens=False)


def test_encode_words_of_documents(spark, library):
    rows = helpers.odd_rows()
    got = word_bpe.encode_documents(helpers.documents(spark, rows), PATH).collect()
    plain = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    expected = Counter((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)) for i, ids in plain)
    assert Counter((r.doc_id, r.n_tokens, bytes(r.token_ids), r.decoded) for r in got) == expected
    assert word_bpe.encode_documents(helpers.documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("change", ["suffix", "normalizer", "order"])
def test_other_files_are_refused(tmp_path, change):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    if change == "suffix":
        spec["model"]["end_of_word_suffix"] = "@"
    elif change == "normalizer":
        spec["normalizer"]["normalizers"].pop()
    else:
        spec["model"]["merges"].reverse()
    (tmp_path / "x").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        word_bpe.read_vocabulary(str(tmp_path / "x"))


# ---- clustering ------------------------------------------------------------------------------------


def test_plane_arithmetic_is_exact():
    rng = np.random.default_rng(1)
    for least, most in ((-5, 5), (-(1 << 26), 1 << 26), (0, 1), (-1, 0), (0, 900)):
        a, b = rng.integers(least, most + 1, (40, 64)), rng.integers(least, most + 1, (7, 64))
        bits = max(int(abs(least)).bit_length(), int(most).bit_length()) + 1
        x, y = clustering.planes_of(a, bits), clustering.planes_of(b, bits)
        assert (clustering.products(x, y) == a @ b.T).all()
        assert (clustering.plane_sums(x) == a.sum(0)).all()


def plain_clusters(rows, k=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, tuple(int(np.floor(1024 * float(x))) for x in v)))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in first[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds if centroids else 0):
        at = [nearest(v)[0] for _, v in kept]
        for c in range(len(centroids)):
            members = [v for (_, v), a in zip(kept, at) if a == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    out = [(i, *nearest(v)) for i, v in kept]
    per = Counter()
    for _, c, d in out:
        per[c] += d
    return Counter((i, c, d, per[c], sum(per.values()), tuple(centroids[c])) for i, c, d in out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id string, x int, planes int")


@pytest.mark.parametrize("case", ["random", "few", "ties"])
def test_clusters_equal_the_plain_version(spark, monkeypatch, case):
    monkeypatch.setattr(clustering, "SLICE", 7)
    rng = np.random.default_rng(2)
    if case == "random":
        rows = [(i, (rng.normal(size=64) * 3).astype(np.float32).tolist()) for i in range(60)]
        rows += [(100, None), (101, [1.0] * 63), (102, [None, *[1.0] * 63]), (103, [float("nan"), *[1.0] * 63]), (104, [float("inf"), *[1.0] * 63])]
        rows += [(None, rows[3][1]), (None, rows[4][1]), (5, rows[5][1]), (104, [float("-inf"), *[1.0] * 63]), (105, [])]
    elif case == "few":
        rows = [(1, [0.5] * 64), (2, [-0.25] * 64), (None, [0.0] * 64)]
    else:
        rows = [(i, [float(i % 3)] * 64) for i in range(40)]
    got = clustering.cluster(vectors(spark, rows)).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got) == plain_clusters(rows)


def test_no_vectors_and_too_large_ones(spark):
    assert clustering.cluster(vectors(spark, [])).count() == 0
    assert clustering.cluster(vectors(spark, [(1, None)])).count() == 0
    with pytest.raises(Exception, match="not within"):
        clustering.cluster(vectors(spark, [(1, [2.0**18] * 64)])).collect()


# ---- spelling --------------------------------------------------------------------------------------


def plain_words(rows):
    counts = Counter()
    upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c.translate(upper) <= "z" or "À" <= c <= "ÿ":
                run += c.translate(upper)
            elif run:
                if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 97 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                counts[run] += 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows):
    n = plain_words(rows)
    around = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if near(a, b):
            around[a].append(b)
            around[b].append(a)
    form = {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("partition,open_", [(4096, 48), (3, 48), (2, 1)])
def test_variants_equal_the_plain_version(spark, monkeypatch, partition, open_):
    monkeypatch.setattr(spelling, "PARTITION", partition)
    monkeypatch.setattr(spelling, "OPEN", open_)
    rng = random.Random(5)
    words = ["".join(rng.choice("abÀé") for _ in range(rng.randint(4, 9))) for _ in range(90)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ab×cd÷"]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=60))) for i in range(60)]
    long = "abcdefghij" * 12
    rows += [(900 + i, f"{long} {long[:50]}x{long[50:]}. {long[:-1]}, {long}z Zz{long}") for i in range(3)]
    rows += [(700, "mmmmmm " * 26 + "mmmmmn " * 13 + "mmmmnn " * 6 + "mmmnnn " * 3)]
    rows += [(None, "aaaaab AAAAAB aaaaab, aaaaab"), (7, None), (8, ""), (9, " \n"), (9, "häßlich häßlich Häßlich")] * 2
    got = spelling.variants(helpers.documents(spark, rows)).collect()
    assert Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == Counter(plain_variants(rows))
    assert any(r.form is not None and r.form != r.root for r in got)


def test_variants_odd_rows(spark):
    rows = helpers.odd_rows()
    got = spelling.variants(helpers.documents(spark, rows)).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(rows)
    assert spelling.variants(helpers.documents(spark, [])).count() == 0


def test_acceptors_are_minimal():
    machine = spelling.Acceptor()
    start = machine.add(sorted(["tapas", "topas", "tapes", "topes"]))
    assert machine.add(["xs", "ys"]) != start
    assert len({machine.arcs[s] for s in range(len(machine.arcs))}) == len(machine.arcs)
    pairs = set(machine.pairs(start, None, True))
    assert pairs == {("tapas", "topas"), ("tapes", "topes"), ("tapas", "tapes"), ("topas", "topes")}
