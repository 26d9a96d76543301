"""Language identification in two steps: the family first, then the language within it.

A text is a unit vector of square-rooted counts of hashed byte trigrams.  A one-versus-rest linear
support vector machine per family picks the family; inside it, one machine per pair of languages
votes.  All machines are trained here, in numpy, on a bounded sample of labelled rows whose vectors
(not texts) reach the driver, packed; there they stand once, as the one matrix that all machines learn from.

Machines only tell the learned languages from each other.  Whether a text is in one of them at all is
told by its trigrams' mean log likelihood under each language's profile, as a deviation from what labelled
texts outside the profile reach, in units that allow for the text's length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylens.llm.common import arrow_map, bounded_sample, column, flat_bytes, give_back, sample_hash, sigmoid

#: Hashed trigrams.
DIMS = 4096
#: Labelled rows that are learned from, at most about.
TRAIN_ROWS = 4000
#: Every so manieth labelled row of a language is kept out of its profile, to calibrate what fits.
HELD_BACK = 5
#: Share of the rows held back that fits, at least, and the deviation up to which every text fits.
FITTING, SURE = 0.995, 3.0
#: Part of a profile that is spread over all trigrams; trigrams after which a text's length tells no more.
SPREAD, ENOUGH = 0.02, 50
#: Answer for a text that is null or holds no letter, and when nothing could be learned.
UNDETERMINED = "und"

#: Language families by code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "semitic": ["ar", "he", "am", "mt"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"],
}


def family(lang: str) -> str:
    """The family of a code; a code that no family lists is a family of its own."""
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if base in codes), f"only {lang}")


#: ASCII bytes that are no letters count as a space.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def vectors(texts: list[str | None]) -> np.ndarray:
    """One float32 row per text; zeros for a text without trigrams."""
    return counted(texts)[0]


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of texts, and how many trigrams each has."""
    plain = [b" ".join((t or "").lower().encode().translate(_SPACED).split()) for t in texts]
    flat, ends = flat_bytes([b" " + p + b" " for p in plain])
    b = flat.astype(np.uint32)
    code = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    slot = (code >> np.uint32(20)).astype(np.int64)
    out = np.zeros((len(texts), DIMS), np.float32)
    for i in range(len(texts)):
        counts = np.bincount(slot[ends[i] : max(ends[i], ends[i + 1] - 2)], minlength=DIMS)
        out[i] = np.sqrt(counts)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), np.maximum(np.diff(ends) - 2, 0)


def train_svm(x: np.ndarray, positive: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated descent.

    Both classes weigh the same, whatever their sizes.
    """
    return descend(np.hstack([x, np.ones((len(x), 1), np.float32)]), positive, rounds, decay)


def descend(x: np.ndarray, positive: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> np.ndarray:
    """`train_svm` on rows that end in a one, for the bias, so that they need no copy."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, step = w.copy(), np.float32(0.2)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = decay * ahead - 2 * (x.T @ (weight * y * slack))
        following = ahead - step * gradient
        ahead = following + np.float32(k / (k + 3)) * (following - w)
        w = following
    return w


@dataclass
class Profiles:
    """Per calibrated language the log likelihood of trigrams, with its usual mean and its deviation per trigram.

    A text fits if some language's deviation is at least `least`.
    """

    log: np.ndarray
    usual: np.ndarray
    spread: np.ndarray
    least: float

    def deviation(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """By text and language: how many deviations the text lies above the usual likelihood."""
        unit = np.sqrt(1 / np.maximum(n, 1) + 1 / ENOUGH)[:, None] * self.spread
        return ((x * x) @ self.log.T - self.usual) / unit


def profiles(x: np.ndarray, n: np.ndarray, langs: np.ndarray) -> tuple[Profiles | None, set[str]]:
    """The profiles of the languages with two rows or more, and the names of the others.

    The bound is such that `FITTING` of the rows held back fit; a language with fewer than `HELD_BACK` rows holds back
    each of them in turn, and has a say in the bound only if all languages are like that.
    """
    logs, usual, spread, held, few = [], [], [], [], set()

    def log_share(rows: np.ndarray) -> np.ndarray:
        return np.log((np.square(x[rows]).mean(0) * (1 - SPREAD) + SPREAD / DIMS).astype(np.float64))

    for name in sorted(set(langs)):
        rows = np.flatnonzero((langs == name) & (n > 0))
        if len(rows) < 2:
            few.add(name)
            continue
        large = len(rows) >= HELD_BACK
        back = rows[HELD_BACK - 1 :: HELD_BACK] if large else rows
        log = log_share(np.setdiff1d(rows, back) if large else rows)
        reached = np.square(x[back]) @ log if large else np.array([np.square(x[i]) @ log_share(np.setdiff1d(rows, [i])) for i in rows])
        share = np.exp(log)
        logs.append(log)
        usual.append(np.median(reached))
        spread.append(np.sqrt((share * np.square(log - (share * log).sum())).sum()))
        held.append((large, back, reached))
    if not logs:
        return None, few
    found = Profiles(np.stack(logs).astype(np.float32), np.array(usual), np.maximum(spread, 1e-3), -np.inf)
    any_large = any(large for large, _, _ in held)
    deviations = [
        (reached - usual[k]) / (np.sqrt(1 / np.maximum(n[back], 1) + 1 / ENOUGH) * found.spread[k])
        for k, (large, back, reached) in enumerate(held) if large or not any_large
    ]
    found.least = min(float(np.quantile(np.concatenate(deviations), 1 - FITTING, method="lower")), -SURE)
    return found, few


@dataclass
class LanguageModel:
    """`groups`: languages by family.  `of_family`: one machine each.  `of_pair`: one per pair of a family.

    `profiles` say which texts fit a language; `few` are the languages with a single row, which have none.
    """

    groups: dict[str, list[str]] = field(default_factory=dict)
    of_family: dict[str, np.ndarray] = field(default_factory=dict)
    of_pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    profiles: Profiles | None = None
    few: set[str] = field(default_factory=set)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether the text fits a learned language.

        A text fits if it fits some language's profile; only where no language has one, there is nothing to judge by, and all fit.
        """
        lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        if not self.groups:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
        plain, n = counted(texts)
        near = (self.profiles.deviation(plain, n) >= self.profiles.least).any(1) if self.profiles else np.ones(len(texts), bool)
        x = np.hstack([plain, np.ones((len(texts), 1), np.float32)])
        names = sorted(self.groups)
        margins = np.stack([x @ self.of_family[n] for n in names], 1) if len(names) > 1 else np.full((len(x), 1), 1.0)
        chosen = margins.argmax(1)
        pairs = {pair: x @ w for pair, w in self.of_pair.items()}
        langs, scores = [], []
        for i, has_letter in enumerate(lettered):
            if not has_letter:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            members = self.groups[names[chosen[i]]]
            votes, against = Counter(), Counter()
            for a, b in combinations(members, 2):
                m = float(pairs[a, b][i])
                votes[a if m > 0 else b] += 1
                against[a] += m
                against[b] -= m
            best = max(members, key=lambda lang: (votes[lang], against[lang]))
            mean = against[best] / max(1, len(members) - 1) if len(members) > 1 else 1.0
            langs.append(best)
            scores.append(float(sigmoid(4 * margins[i, chosen[i]]) * sigmoid(4 * mean)))
        fits = [has and bool(near[i]) for i, has in enumerate(lettered)]
        return langs, scores, fits


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel:
    """A model from rows with text and language (others are left out).

    `TRAIN_ROWS` bounds the sample, which is drawn by language: rare languages come whole.
    """
    labelled = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(
        doc_id, text, lang, sample_hash(doc_id, text).alias("hash")
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, n = counted(column(batch, text).to_pylist())
        sent = pa.array([zlib.compress(r.tobytes(), 1) for r in x.astype(np.float16)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [column(batch, lang).cast(pa.string()), column(batch, "hash"), pa.array(n, pa.int64()), sent], ["lang", "hash", "n", "x"]
        )

    sample = bounded_sample(labelled, [lang], TRAIN_ROWS)
    langs, n, x = _gathered(arrow_map(sample, work, "lang string, hash long, n long, x binary", 128))
    give_back()
    if not len(langs):
        return LanguageModel()
    groups: dict[str, list[str]] = {}
    for name in sorted(set(langs)):
        groups.setdefault(family(name), []).append(name)
    families = np.array([family(name) for name in langs], object)
    model = LanguageModel(groups)
    model.profiles, model.few = profiles(x[:, :DIMS], n, langs)
    if len(groups) > 1:
        model.of_family = {name: descend(x, families == name) for name in groups}
    for members in groups.values():
        for a, b in combinations(members, 2):
            here = (langs == a) | (langs == b)
            model.of_pair[a, b] = descend(x[here], langs[here] == a)
    return model


def _gathered(sent: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages, numbers of trigrams and vectors, each followed by a one, in the order of `hash`."""
    got = sent.toArrow().sort_by("hash")
    x = np.ones((got.num_rows, DIMS + 1), np.float32)
    for i, row in enumerate(got["x"]):
        x[i, :DIMS] = np.frombuffer(zlib.decompress(row.as_buffer()), np.float16)
    return np.array(got["lang"].to_pylist(), object), np.array(got["n"].to_pylist(), np.int64), x


def identify(
    docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None, inside: str | None = None
) -> DataFrame:
    """`keep` (default: all columns) with `lang_pred`, `score` (0 to 1) and `fits` (whether the text is in
    a learned language at all), from the whole text alone.

    A text that is null, empty or without a letter gets `und`, 0 and false, and so does every text if
    nothing could be learned.  Rows stand for themselves: repeated rows get equal answers, null ids
    are kept.  Columns of `docs` named `lang_pred`, `score` or `fits` are replaced.  With `inside`, the text is a field
    of that struct column.  A text that is kept goes through Python once, as part of its row.
    """
    kept = [c for c in keep or docs.columns if c.lower() not in ("lang_pred", "score", "fits")]
    carried = [inside, text] if inside is not None else [text]
    in_row = carried[0] in kept
    own = [] if in_row else [F.col(".".join(f"`{c}`" for c in carried)).alias("text")]
    held = docs.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), *own)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = column(batch, "row")
        texts = row if in_row else column(batch, "text")
        for name in carried if in_row else []:
            texts = texts.field(name)
        langs, scores, fits = model.judge(texts.to_pylist())
        return pa.RecordBatch.from_arrays(
            [row, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())],
            ["row", "lang_pred", "score", "fits"],
        )

    row_type = held.schema["row"].dataType.simpleString()
    out = arrow_map(held, work, f"row {row_type}, lang_pred string, score double, fits boolean")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "lang_pred", "score", "fits")
