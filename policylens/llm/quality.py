"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel.  Normal equations are summed per partition and then by
Spark, so all labelled rows take part and the driver only sees matrices of a fixed size; the
calibration works on counts per score step, of which there is a fixed number as well.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylens.llm.common import SLICE_ROWS, arrow_map, column

#: Fourier features, ridge penalty per row, kernel width in standard deviations, calibration steps.
FEATURES, PENALTY, WIDTH, STEPS = 256, 1e-4, 3.0, 1000

#: Names of the statistics, in the order of `statistics`.
STATISTICS = [
    "log_bytes", "log_words", "mean_word", "spread_word", "distinct_words", "top_word", "repeated_neighbour",
    "short_words", "letters", "upper", "digits", "marks", "odd_marks", "spaces", "line_length", "repeated_lines",
    "exclamations", "bars", "marked_words", "capital_words",
]

_UPPER = np.array([chr(b).isupper() and b < 128 for b in range(256)])
_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_ODD = np.array([chr(b) in "#$%&*<>@\\^_`{|}~=+" for b in range(256)])
_MARK = ~(_LETTER | _DIGIT | _SPACE)
_LAST_MARK = frozenset(np.flatnonzero(_MARK).tolist())


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; a null text counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, b = max(len(words), 1), max(len(raw), 1)
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / b
    upper, letters = float(share[_UPPER].sum()), float(share[_LETTER].sum())
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        min(float(sizes.mean()), 50.0),
        min(float(sizes.std()), 50.0),
        len(counts) / n**0.8,
        max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        float((sizes <= 3).mean()),
        letters,
        upper / max(letters, 1e-9),
        float(share[_DIGIT].sum()),
        float(share[_MARK].sum()),
        float(share[_ODD].sum()),
        float(share[_SPACE].sum()),
        min(np.log1p(len(raw) / max(len(lines), 1)), 12.0),
        1 - len(set(lines)) / max(len(lines), 1),
        float(share[33]),
        float(share[124]),
        sum(w[-1] in _LAST_MARK for w in words) / n,
        sum(w[:1].isupper() for w in words) / n,
    ]


def fourier(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Fixed random frequencies and phases."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(len(STATISTICS), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


@dataclass
class QualityModel:
    """`steps` holds the calibrated score of each of `STEPS` equal parts of the raw range [0, 1]."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        frequency, phase = fourier()
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ frequency + phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def step(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.clip((raw * STEPS).astype(np.int64), 0, STEPS - 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.steps[self.step(stats)]


def isotonic(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to rates `ones / n` with weights `n` (pooling of adjacent violators);
    steps without rows take the value between their neighbours."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(n > 0):
        blocks.append([float(ones[i]), float(n[i]), float(i), float(i)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            o, m, _, last = blocks.pop()
            blocks[-1][0] += o
            blocks[-1][1] += m
            blocks[-1][3] = last
    if not blocks:
        return np.full(len(n), 0.5)
    at = [x for b in blocks for x in (b[2], b[3])]
    value = [b[0] / b[1] for b in blocks for _ in range(2)]
    return np.interp(np.arange(len(n)), at, value)


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns) with `x`, the statistics of the whole text."""
    kept = [c for c in keep or docs.columns if c.lower() != "x"]
    held = docs.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t) for t in column(batch, "text").to_pylist()]
        return pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(x, pa.list_(pa.float64()))], ["row", "x"])

    out = arrow_map(held, work, f"row {held.schema['row'].dataType.simpleString()}, x array<double>")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "x")


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(column(batch, "x").flatten()).reshape(-1, len(STATISTICS))


def fit(rows: DataFrame, label: str = "quality") -> QualityModel:
    """A model from all rows of `measured` that have a label.  Without any, every score is 0.5."""
    k = len(STATISTICS)
    stats = rows.where(F.col(label).isNotNull()).select("x", (F.col(label) > 0).cast("double").alias("y")).persist()
    moments = stats.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)],
    ).first()
    n = moments["n"]
    if not n:
        stats.unpersist()
        return QualityModel(np.zeros(k), np.ones(k), np.zeros(FEATURES + 1), np.full(STEPS, 0.5))
    mean = np.array([moments[f"m{i}"] for i in range(k)])
    scale = np.array([moments[f"s{i}"] for i in range(k)])
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), np.zeros(STEPS))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's sum of [features, label]' [features, label], one row of the matrix per row."""
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                z = model.features(_stacked(part))
                total += z.T @ np.hstack([z, np.array(column(part, "y"))[:, None]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"]
        )

    width = FEATURES + 2
    sums = (
        stats.mapInArrow(normal, "i int, v array<double>")
        .groupBy("i")
        .agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v"))
        .collect()
    )
    matrix = np.stack([r["v"] for r in sorted(sums, key=lambda r: r["i"])])
    model.weights = np.linalg.solve(matrix[:, :-1] + PENALTY * n * np.eye(FEATURES + 1), matrix[:, -1])

    def steps(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = model.step(_stacked(batch))
        return pa.RecordBatch.from_arrays([pa.array(at), column(batch, "y")], ["step", "y"])

    counted = arrow_map(stats, steps, "step long, y double").groupBy("step").agg(F.sum("y").alias("o"), F.count("y").alias("n"))
    ones, rows_in = np.zeros(STEPS), np.zeros(STEPS)
    for r in counted.collect():
        ones[r["step"]], rows_in[r["step"]] = r["o"], r["n"]
    model.steps = np.clip(isotonic(ones, rows_in), 0.0, 1.0)
    stats.unpersist()
    return model


def score(rows: DataFrame, model: QualityModel) -> DataFrame:
    """Rows of `measured` with `score` (0 to 1) in place of the statistics.

    A null text scores like an empty one.  Rows stand for themselves: repeated rows get equal scores,
    null ids are kept.  A column named `score` is replaced.
    """
    kept = [c for c in rows.columns if c.lower() not in ("score", "x")]
    held = rows.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), "x")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(model.score(_stacked(batch)))], ["row", "score"])

    out = arrow_map(held, work, f"row {held.schema['row'].dataType.simpleString()}, score double")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "score")
