"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random

LONG = "long " * 9 + "text. "


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def documents(spark, rows: list[tuple], extra: bool = True):
    """(doc_id, text[, lang]) as a table; `extra` adds columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, 7) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if not extra:
        return df
    clash = ["row", "doc", "loc", "key", "w", "g", "crc", "x", "n", "score", "fingerprint", "node", "id", "kept", "token_ids"]
    for name in clash:
        df = df.selectExpr("*", f"'{name}' as {name}")
    return df


def odd_rows() -> list[tuple]:
    """Null, empty, blank, very long, repeated and id-less texts."""
    rng = random.Random(4)
    text = sentence(rng, 120)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, text), (4, text), (5, text), (6, LONG * 30_000), (None, text), (None, None),
        (7, "é" * 300 + " ß"), (8, "\x00\x01 \x7f"), (9, "one two"), (10, sentence(rng, 60) + " " + text[:400]),
    ]
