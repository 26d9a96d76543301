"""From raw documents to token ids: language, near copies, repeated passages, leaked tests, encoding.

Every stage takes (spark, documents, folder of the tables) and works on all rows that the stage
before it kept.  SQL can express neither the classifier nor the hashes, so there is no twin; the
stages are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylens.llm import bpe, decontaminate, langid, simhash, suffix_array
from policylens.llm.common import bucket_of, written
from policylens.llm.queries import byte_vocabulary, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a recognised language.

    The model learns from the rows of the stage's input outside a fixed third.  Texts that are null,
    empty or without a letter go, and so do texts that no language fits: the bound lets 99.5 % of labelled
    rows outside the profiles pass (`langid.FITTING`).
    """
    model = langid.fit(docs.where(bucket_of(F.col("doc_id"), 3) != 1))
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    judged = langid.identify(row, model, inside="row")
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & F.col("fits"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints: that of the smallest id."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings that also start elsewhere; documents without any stay as they are.

    `n_chars`, where there is one, counts what is left of a text.
    """
    cut = suffix_array.removed(docs)
    if "n_chars" not in docs.columns:
        return cut
    left = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars")
    return cut.select(*[left.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def leaked_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    # a digest stands for the text in what goes through the encoder beside it
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")
    encoded = bpe.encode_documents(docs.select("doc_id", "text", digest), *byte_vocabulary(), keep=["doc_id", "digest"])
    return encoded.select("doc_id", "n_tokens", "token_ids", (F.sha2("decoded", 256) == F.col("digest")).alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("leaked_tests", leaked_tests),
    ("byte_bpe", byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
