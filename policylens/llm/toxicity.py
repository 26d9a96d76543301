"""A convolutional toxicity classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its first four and five
characters.  Filters of width one to three slide over the words, each filter's largest value over
the whole text counts (max pooling), and a logistic layer weighs these.  Thresholds for a yes are
calibrated per language on labelled rows; the score itself never sees the language.

All labelled rows take part.  They are dealt into chunks by a hash of their content; in every round each
chunk descends on its own from the same model, and Spark averages what the chunks have changed.  Sums are sums
of integers, so the model does not depend on how the tables are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylens.llm.common import column, give_back, sample_hash, sigmoid, written
from policylens.session import shared_folder

#: Positive rows of all languages that a language's own threshold is weighed against.
SHRINK = 20
#: Embedding slots (a power of two), embedding size, filters per width, filter widths.
SLOTS, SIZE, FILTERS, WIDTHS = 1 << 16, 16, 12, (1, 2, 3)
#: Labelled rows of a chunk (about), and bytes of their slots (at most, unless one text alone has more).
TRAIN_ROWS, TRAIN_BYTES = 6000, 24 << 20
#: Bytes of a chunk's slots in a row, so that the executors handle no large rows, and a size that no chunk's file reaches.
PIECE_BYTES, FILE_BYTES = 1 << 17, 1 << 30
#: Texts per step, texts that the descent sees in all (at least), and how often it sees each of several chunks (at least).
BATCH, SEEN, PASSES = 48, 36_000, 3
#: Rounds at most: beyond, a chunk passes several times over its rows in a round.
ROUNDS = 8
#: Bits of the map of labelled rows (a power of two), at most.
MAP_BITS = 1 << 26
#: Averages are taken of whole multiples of 1 / SCALE, thresholds of 1 / STEPS in log-odds.
SCALE, STEPS = 1 << 28, 64
#: Distinct words a task remembers before it starts afresh.
CACHE = 150_000

_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and non-ASCII characters of the whole text."""
    return (text or "").lower().encode().translate(_SPACED).decode().split()


def slots(word: str) -> tuple[int, int, int]:
    """The embedding slots of a word: itself, its first four and its first five characters."""
    return tuple(
        zlib.crc32(f"{kind}{part}".encode()) & (SLOTS - 1)
        for kind, part in (("w", word), ("4", word[:4]), ("5", word[:5]))
    )


@dataclass
class ToxicityModel:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def projected(self, ids: np.ndarray) -> np.ndarray:
        """Per word, what it adds to every filter at every place of its window."""
        e = self.embedding[ids].sum(1)
        return np.hstack([e @ self.filters[w][j] for w in WIDTHS for j in range(w)])

    def pooled(self, p: np.ndarray) -> np.ndarray:
        """The largest response of every filter over one text's projected words."""
        best, at = [], 0
        for w in WIDTHS:
            response = np.zeros((max(len(p) - w + 1, 1), FILTERS), np.float32)
            if len(p) >= w:
                for j in range(w):
                    c = at + j * FILTERS
                    response += p[j : len(p) - w + 1 + j, c : c + FILTERS]
            best.append(np.maximum(response.max(0) + self.bias[w], 0))
            at += w * FILTERS
        return np.concatenate(best)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.base


def untrained(seed: int = 5) -> ToxicityModel:
    rng = np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    return ToxicityModel(
        (rng.normal(size=(SLOTS, SIZE)) * 0.1).astype(np.float32),
        {w: (rng.normal(size=(w, SIZE, FILTERS)) * (0.5 / w)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        (rng.normal(size=n) * 0.3).astype(np.float32),
        0.0,
    )


def _update(state: dict, name, value: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """An Adagrad step in place."""
    total = state.setdefault(name, np.full(value.shape, 1e-3, np.float32))
    total += gradient * gradient
    value -= rate * gradient / np.sqrt(total)


def descend(
    model: ToxicityModel, state: dict, texts: list[np.ndarray], labels: np.ndarray, passes: int, rate: float = 0.05, seed: int = 3
) -> None:
    """Passes in place over word-slot arrays (words x 3); `state` keeps Adagrad's sums.  The gradient of max
    pooling reaches one window per filter and text, so a step costs one forward pass."""
    rng, seen = np.random.default_rng(seed), state["seen"]
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            g_out = np.zeros_like(model.out)
            g_bias = {w: np.zeros_like(b) for w, b in model.bias.items()}
            g_filters = {w: np.zeros_like(f) for w, f in model.filters.items()}
            g_base, at_slots, at_grads = 0.0, [], []
            for i in chosen:
                ids = texts[i]
                e = model.embedding[ids].sum(1) if len(ids) else np.zeros((0, SIZE), np.float32)
                pooled, places = [], []
                for w in WIDTHS:
                    if len(e) >= w:
                        response = sum(e[j : len(e) - w + 1 + j] @ model.filters[w][j] for j in range(w)) + model.bias[w]
                        place = response.argmax(0)
                        pooled.append(np.maximum(response[place, np.arange(FILTERS)], 0))
                    else:
                        place = None
                        pooled.append(np.maximum(model.bias[w], 0))
                    places.append(place)
                z = np.concatenate(pooled)
                error = float(sigmoid(np.float64(model.logit(z)))) - labels[i]
                g_base += error
                g_out += error * z
                for k, w in enumerate(WIDTHS):
                    cut = slice(k * FILTERS, (k + 1) * FILTERS)
                    g = (error * model.out[cut] * (z[cut] > 0)).astype(np.float32)
                    g_bias[w] += g
                    if places[k] is None:
                        continue
                    for j in range(w):
                        at = places[k] + j
                        g_filters[w][j] += e[at].T * g
                        at_slots.append(ids[at].ravel())
                        at_grads.append(np.repeat(model.filters[w][j].T * g[:, None], ids.shape[1], 0))
            n = len(chosen)
            _update(state, "out", model.out, g_out / n, rate)
            model.base -= rate * g_base / n
            for w in WIDTHS:
                _update(state, f"b{w}", model.bias[w], g_bias[w] / n, rate)
                _update(state, f"f{w}", model.filters[w], g_filters[w] / n, rate)
            if at_slots:
                slot, where = np.unique(np.concatenate(at_slots), return_inverse=True)
                g = np.zeros((len(slot), SIZE), np.float32)
                np.add.at(g, where, np.concatenate(at_grads) / n)
                seen[slot] += (g * g).mean(1)
                model.embedding[slot] -= rate * g / np.sqrt(seen[slot])[:, None]


def _dense(model: ToxicityModel, state: dict) -> list[np.ndarray]:
    """All parameters but the embedding, and their sums."""
    names = ["out", *[f"b{w}" for w in WIDTHS], *[f"f{w}" for w in WIDTHS]]
    return [model.out, *[model.bias[w] for w in WIDTHS], *[model.filters[w] for w in WIDTHS], *[state[n] for n in names]]


def fresh(rows: int, ones: float) -> tuple[ToxicityModel, dict]:
    """Where the descent starts, with `ones` of `rows` rows positive."""
    model = untrained()
    model.base = float(np.log((ones + 1) / (rows - ones + 1)))
    state = {"seen": np.full(SLOTS, 1e-3, np.float32), "out": np.full(model.out.shape, 1e-3, np.float32)}
    for w in WIDTHS:
        state[f"b{w}"], state[f"f{w}"] = (np.full(x[w].shape, 1e-3, np.float32) for x in (model.bias, model.filters))
    return model, state


def packed(model: ToxicityModel, state: dict) -> np.ndarray:
    """A model and its sums as rows of one width: a row per slot, then the rest."""
    rest = np.concatenate([[model.base], *[x.ravel() for x in _dense(model, state)]])
    table = np.zeros((SLOTS + -(-len(rest) // (SIZE + 1)), SIZE + 1))
    table[:SLOTS, :SIZE], table[:SLOTS, SIZE] = model.embedding, state["seen"]
    table[SLOTS:].ravel()[: len(rest)] = rest
    return table


def unpacked(table: np.ndarray) -> tuple[ToxicityModel, dict]:
    rest, at = table[SLOTS:].ravel(), 1
    n, names = FILTERS * len(WIDTHS), ["out", *[f"b{w}" for w in WIDTHS], *[f"f{w}" for w in WIDTHS]]
    shapes = [(n,), *[(FILTERS,) for _ in WIDTHS], *[(w, SIZE, FILTERS) for w in WIDTHS]]
    found = []
    for shape in shapes * 2:
        size = int(np.prod(shape))
        found.append(rest[at : at + size].reshape(shape).astype(np.float32))
        at += size
    held, state = dict(zip(names, found)), dict(zip(names, found[len(names) :]))
    state["seen"] = table[:SLOTS, SIZE].astype(np.float32)
    filters, bias = ({w: held[f"{kind}{w}"] for w in WIDTHS} for kind in "fb")
    return ToxicityModel(table[:SLOTS, :SIZE].astype(np.float32), filters, bias, held["out"], float(rest[0])), state


def best_threshold(scores: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The score from which on a yes gives the best F1 on these rows; 0.5 without a positive row.

    With `rows`, a score stands for so many rows, `labels` of them positive.
    """
    if not labels.sum():
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.cumsum((np.ones(len(order)) if rows is None else rows)[order]) + labels.sum())
    ends = np.append(np.diff(scores[order]) != 0, True)
    return float(scores[order][np.where(ends, f1, -1).argmax()])


def _bitmap(told: DataFrame, n: int) -> np.ndarray:
    """One bit for each hash of `told`, in 64-bit words: rows whose bit is unset have no label."""
    bits = min(MAP_BITS, 1 << max(10, (16 * n).bit_length()))
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    held = told.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
    words_ = np.zeros(bits // 64, np.int64)
    words_[held["at"].to_numpy()] = held["word"].to_numpy()
    return words_


def _sequences(texts: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(hash, lang, y, slots): the slots of all words of a text, three numbers of two bytes per word.

    With `wanted`, rows whose bit is unset are left out, and repeated hashes of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int, int]] = {}
        sent: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                if wanted is not None:
                    at = column(part, "hash").to_numpy() & (64 * len(wanted) - 1)
                    part = part.filter(pa.array((wanted[at >> 6] >> (at & 63)) & 1 == 1))
                    new = []
                    for h in column(part, "hash").to_pylist():
                        new.append(h not in sent)
                        sent.add(h)
                    part = part.filter(pa.array(new, pa.bool_()))
                    if len(sent) > CACHE:
                        sent.clear()
                found = []
                for t in column(part, "text").to_pylist():
                    in_text = words(t)
                    for w in set(in_text).difference(known):
                        known[w] = slots(w)
                    found.append(np.array([known[w] for w in in_text], np.uint16).tobytes())
                    if len(known) > CACHE:
                        known.clear()
                kept = [column(part, c) for c in ("hash", "lang", "y")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], ["hash", "lang", "y", "slots"])
        known.clear()
        give_back()

    return texts.mapInArrow(run, f"hash long, lang {texts.schema['lang'].dataType.simpleString()}, y double, slots binary")


def _held_back(n: int) -> np.ndarray:
    """Which rows of a chunk calibrate the thresholds: every fifth."""
    return np.arange(n) % 5 == 0


def _chunks(texts: DataFrame, told: DataFrame, n: int) -> DataFrame:
    """(n, ones, lang, y, words, piece, slots, shard, cut): the labelled rows in chunks, and how many the descent sees in each.

    `told` has the labels of `n` rows by hash.  Slots are cut before they are shuffled, once, and only of rows that may
    have a label.  The table is written, a file per chunk (shard, cut) with one row group, so that one task reads it.  The
    slots of a chunk go on over as many rows (piece) as they need; all else is in its first.
    """
    kind = texts.schema["lang"].dataType
    found = _sequences(texts.withColumn("y", F.lit(None).cast("double")), _bitmap(told, n))
    marks = told.select("hash", F.lit(None).cast(kind).alias("lang"), "y", F.lit(None).cast("binary").alias("slots"))
    shards = -(-n // TRAIN_ROWS)
    both = found.unionByName(marks).withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    doc = F.when(F.col("slots").isNotNull(), F.struct("lang", "slots"))
    rows = both.repartition(shards, "shard").groupBy("shard", "hash").agg(
        F.first(doc, ignorenulls=True).alias("doc"), F.array_distinct(F.array(F.min("y"), F.max("y"))).alias("y")
    )
    rows = rows.where(F.col("doc").isNotNull() & F.col("y")[0].isNotNull())
    # in the order of the hash: the descent sees the same rows in the same order however the table is cut
    rows = rows.select("shard", "hash", "doc.lang", "doc.slots", F.explode("y").alias("y")).sortWithinPartitions("shard", "hash", "y")

    names = ["n", "ones", "lang", "y", "words", "piece", "slots", "shard", "cut"]

    def chunk(held: list[tuple], like: pa.DataType, shard: int, cut: int) -> Iterator[pa.RecordBatch]:
        lang, y, sent = zip(*held)
        learned = ~_held_back(len(y))
        first, flat = [int(learned.sum()), float(np.array(y)[learned].sum()), lang, y, [len(b) // 6 for b in sent]], b"".join(sent)
        kinds = [pa.int64(), pa.float64(), pa.list_(like), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
        for piece, at in enumerate(range(0, max(len(flat), 1), PIECE_BYTES)):
            values = [*(first if not piece else [None] * len(first)), piece, flat[at : at + PIECE_BYTES], shard, cut]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, cut, held, size, like = None, 0, [], 0, pa.null()
        for batch in batches:
            like = column(batch, "lang").type
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for s, *row in zip(*(column(part, c).to_pylist() for c in ("shard", "lang", "y", "slots"))):
                    if held and (s != shard or size + len(row[-1]) > TRAIN_BYTES):
                        yield from chunk(held, like, shard, cut)
                        held, size, cut = [], 0, cut + 1
                    if s != shard:
                        shard, cut = s, 0
                    held.append(row)
                    size += len(row[-1])
        if held:
            yield from chunk(held, like, shard, cut)
        del held
        give_back()

    schema = f"n long, ones double, lang array<{kind.simpleString()}>, y array<double>, words array<int>, piece int, slots binary, shard int, cut int"
    path = shared_folder(texts.sparkSession, "op6-chunks")
    pieces = rows.mapInArrow(run, schema).sortWithinPartitions("shard", "cut", "piece")
    pieces.write.option("parquet.block.size", FILE_BYTES).partitionBy("shard", "cut").parquet(path)
    return texts.sparkSession.read.schema(schema).parquet(path)


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Of each chunk the languages, labels and word-slot arrays, and which rows are held back."""

    def chunk() -> tuple[pa.Array, np.ndarray, list[np.ndarray], np.ndarray]:
        lang, y, sizes = first
        flat = b"".join(pieces[i] for i in sorted(pieces))
        pieces.clear()
        if len(flat) != 6 * sizes.sum():
            raise ValueError(f"chunk {at} is not whole")
        ids = np.frombuffer(flat, np.uint16).reshape(-1, 3)
        return lang, y, np.split(ids, np.cumsum(sizes)[:-1]), _held_back(len(y))

    at, first, pieces = None, None, {}
    for batch in batches:
        for i, here in enumerate(zip(column(batch, "shard").to_pylist(), column(batch, "cut").to_pylist())):
            if pieces and here != at:
                yield chunk()
            at, piece = here, column(batch, "piece")[i].as_py()
            if not piece:
                lang, y, sizes = (column(batch, c)[i].values for c in ("lang", "y", "words"))
                first = lang, y.to_numpy(), sizes.to_numpy()
            pieces[piece] = column(batch, "slots")[i].as_buffer()
    if pieces:
        yield chunk()


def _round(chunks: DataFrame, start: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """The model after all chunks have descended from `start`: of every row of the table the mean over the chunks
    that changed it, weighted by their rows."""
    base, start = float(start[SLOTS, 0]), start.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(start.shape, np.int64), np.zeros(len(start), np.int64)
        for _, y, texts, back in _texts_of(batches):
            learned = np.flatnonzero(~back)
            if not len(learned):
                continue
            model, state = unpacked(start)
            model.base = base
            descend(model, state, [texts[i] for i in learned], y[learned], passes, seed=seed)
            change = packed(model, state)
            change -= start
            weight[change.any(1)] += len(learned)
            change *= len(learned) * SCALE
            total += np.rint(change, out=change).astype(np.int64)
            del model, state, texts, change
            give_back()
        touched = np.flatnonzero(weight).astype(np.int32)
        for i in range(0, len(touched), 8192):
            at = touched[i : i + 8192]
            ends = np.arange(len(at) + 1, dtype=np.int32) * (SIZE + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(weight[at]), pa.ListArray.from_arrays(pa.array(ends), pa.array(total[at].ravel()))], ["at", "w", "v"]
            )
        del total, weight
        give_back()

    sent = chunks.mapInArrow(run, "at int, w long, v array<long>")
    sums = sent.groupBy("at").agg(F.sum("w").alias("w"), *[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(SIZE + 1)]).toArrow()
    change = np.stack([sums[f"v{j}"].to_numpy() for j in range(SIZE + 1)], 1)
    out = start.astype(np.float64)
    out[sums["at"].to_numpy()] += change / (sums["w"].to_numpy()[:, None] * float(SCALE))
    return out


def _calibrate(chunks: DataFrame, model: ToxicityModel, kind: str) -> None:
    """Thresholds per language, from counts per step of the log-odds over all rows held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, y, texts, back in _texts_of(batches):
            held = np.flatnonzero(back)
            at = [int(np.floor(np.clip(model.logit(model.pooled(model.projected(texts[i]))), -40, 40) * STEPS)) for i in held]
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(held)), pa.array(at, pa.int32()), pa.array(y[held])], ["lang", "step", "y"])

    counts = chunks.mapInArrow(run, f"lang {kind}, step int, y double").groupBy("lang", "step")
    # in one order: equal sums are weighed alike however they arrive
    got = counts.agg(F.sum("y").alias("ones"), F.count("y").alias("rows")).toArrow().sort_by([("lang", "ascending"), ("step", "ascending")])
    langs = np.array(got["lang"].to_pylist(), object)
    scores, ones, rows = sigmoid(got["step"].to_numpy() / STEPS), got["ones"].to_numpy(), got["rows"].to_numpy()
    pooled = best_threshold(scores, ones, rows)
    for name in sorted({x for x in langs if x is not None}):
        here = langs == name
        own, n = best_threshold(scores[here], ones[here], rows[here]), ones[here].sum()
        # few positive rows say little: their threshold is drawn to that of all languages
        model.thresholds[name] = float((n * own + SHRINK * pooled) / (n + SHRINK))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", lang: str = "lang", doc_id: str = "doc_id") -> ToxicityModel:
    """A model from all documents that `labels` (one row per id) marks.

    Rows that are equal in id, text, language and label are one.  They are learned from in chunks of about
    `TRAIN_ROWS` rows, or fewer with long texts; a task holds one chunk's slots, the driver a model and what Spark sums.
    A fifth of the rows, held back from the descent, calibrates the thresholds.  Up to `TRAIN_ROWS` rows are one
    chunk and one round.  Without labelled rows the model knows nothing and scores 0.5.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id"), (F.col(label) > 0).cast("double").alias("y")
    )
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    texts = texts.withColumn("hash", sample_hash("id", "text", "lang"))
    told = written(texts.select("id", "hash").join(marked, "id").select("hash", "y").distinct(), "op6-labelled")
    n = told.count()
    if not n:
        model = untrained()
        model.out[:] = 0
        return model
    chunks = _chunks(texts.select("hash", "text", "lang"), told, n)
    held = chunks.agg(F.count("y").alias("chunks"), F.sum("n").alias("rows"), F.sum("ones").alias("ones")).first()
    model, state = fresh(held["rows"], held["ones"])
    if held["rows"]:
        passes = -(-SEEN // held["rows"])
        rounds = 1 if held["chunks"] == 1 else min(max(passes, PASSES), ROUNDS)
        table = packed(model, state)
        for i in range(rounds):
            table = _round(chunks, table, -(-max(passes, rounds) // rounds), 3 + i)
        model, _ = unpacked(table)
    _calibrate(chunks, model, texts.schema["lang"].dataType.simpleString())
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns) with `score` (0 to 1, from the whole text alone) and `flagged`, the
    answer at the threshold of the row's language (0.5 for a language without one, and for null).

    Null, empty and word-less texts get one and the same score.  Rows stand for themselves: repeated
    rows get equal scores, null ids are kept.  Columns of `docs` named like a new one are replaced.
    """
    kept = [c for c in keep or docs.columns if c.lower() not in ("score", "flagged")]
    held = docs.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        table = np.zeros((1024, FILTERS * sum(WIDTHS)), np.float32)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                pooled = []
                for t in column(part, "text").to_pylist():
                    found = words(t)
                    if new := list(set(found).difference(number)):
                        first = len(number)
                        number.update(zip(new, range(first, first + len(new))))
                        while len(number) > len(table):
                            # rows that no word has yet are not touched: they take no memory
                            grown = np.zeros((2 * len(table), table.shape[1]), np.float32)
                            grown[:first] = table[:first]
                            table = grown
                            del grown
                        table[first : first + len(new)] = model.projected(np.array(list(map(slots, new))))
                    ids = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
                    pooled.append(model.pooled(table[ids]))
                    if len(number) > CACHE:
                        number.clear()
                scores = sigmoid(model.logit(np.stack(pooled)).astype(np.float64))
                least = [model.thresholds.get(x, 0.5) for x in column(part, "lang").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "row"), pa.array(scores), pa.array(scores >= np.array(least))], ["row", "score", "flagged"]
                )
        number.clear()
        del table
        give_back()

    out = held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, score double, flagged boolean")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "score", "flagged")
