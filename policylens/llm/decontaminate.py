"""Benchmark decontamination: a broadcast hash set of test n-grams against training token windows.

Only DataFrame functions are used.  Texts are lower-cased in A-Z and cut into words; the windows of
`WINDOW` consecutive words of every test item (the whole item, if it has fewer) form a set that goes
to every executor while it is small, and documents' windows are looked up in it by their words, so a
hit is verified by the match itself.  Only windows that hold the longest word of a test window are put
together for that.  Hits merge into spans of words, which or whose documents can then be removed.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylens.llm.common import with_columns, written

#: Words of a window.
WINDOW = 10
#: Window starts that are spread out from one row at a time, whatever the length of a text.
STRETCH = 2048
#: Distinct test windows up to which the set is broadcast; beyond that it is joined by shuffle.
BROADCAST_WINDOWS = 500_000

#: Words that windows are looked for around, at most; with more all windows are looked up.
TRIGGERS = 20_000

#: What separates words, after lower-casing and before.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECES = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    lowered = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATOR), "")


def _window(part: Column, at: Column, length: int) -> Column:
    words_here = F.array_join(F.slice(part, at + 1, length), " ")
    return F.struct(at.alias("at"), F.lit(length).alias("length"), words_here.alias("window"))


def _windows(part: Column, length: int, most: int | None = None) -> Column:
    """Windows of `length` words of the array `part`, with where they start in it (at most `most`)."""
    last = F.size(part) - length
    last = last if most is None else F.least(last, F.lit(most - 1))
    return F.when(
        F.size(part) >= length,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: _window(part, i, length),
        ),
    ).otherwise(F.array().cast("array<struct<at:int,length:int,window:string>>"))


def item_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", nameless: bool = False) -> DataFrame:
    """Distinct (window, length, item_id).  Items without words have none; items without an id only if `nameless`."""
    taken = benchmark if nameless else benchmark.where(F.col(item_id).isNotNull())
    items = taken.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w"))
    long = items.where(F.size("w") >= WINDOW).select("item_id", F.explode(_windows(F.col("w"), WINDOW)).alias("x"))
    short = items.where((F.size("w") > 0) & (F.size("w") < WINDOW)).select(
        "item_id", F.struct(F.lit(0).alias("at"), F.size("w").alias("length"), F.array_join("w", " ").alias("window")).alias("x")
    )
    return long.unionByName(short).select("x.window", "x.length", "item_id").distinct()


def triggers(items: DataFrame) -> list[str] | None:
    """The longest word of every test window; None if there are more than `TRIGGERS`.

    A window can only occur where its longest word does, and long words are rare.
    """
    word = F.array_max(F.transform(F.split("window", " "), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("word"))))
    found = [r["word"] for r in items.select(word["word"].alias("word")).distinct().limit(TRIGGERS + 1).collect()]
    return found if len(found) <= TRIGGERS else None


def document_windows(docs: DataFrame, lengths: list[int], around: list[str] | None = None) -> DataFrame:
    """Windows of the given lengths of every document, (key, start, length, window): all of them, or
    those that hold a word of `around`."""
    texts = docs.select("key", "w")
    stretches = texts.where(F.size("w") > 0).select(
        "key",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("w") - 1, F.lit(STRETCH)),
                lambda at: F.struct(at.alias("from"), F.slice("w", at + 1, STRETCH + max(lengths) - 1).alias("part")),
            )
        ).alias("s"),
    ).select("key", F.col("s.from").alias("from"), F.col("s.part").alias("part"))
    part, size = F.col("part"), F.size("part")
    if around is None:
        found = F.concat(*[_windows(part, n, STRETCH) for n in lengths])
    else:
        places = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get(part, i).isin(around))
        stretches = stretches.select("*", places.alias("places")).where(F.size("places") > 0)

        def near(n: int) -> Column:
            def starts(i: Column) -> Column:
                least, most = F.greatest(i - n + 1, F.lit(0)), F.least(i, size - n, F.lit(STRETCH - 1))
                return F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))

            return F.transform(F.array_distinct(F.flatten(F.transform("places", starts))), lambda i: _window(part, i, n))

        found = F.concat(*[near(n) for n in lengths])
    return stretches.select("key", "from", F.explode(found).alias("x")).select(
        "key", (F.col("from") + F.col("x.at")).alias("start"), "x.length", "x.window"
    )


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(key, w): a document is told apart by its id and text, so repeated or missing ids do no harm."""
    return docs.select(document_key(doc_id, text).alias("key"), words(F.col(f"`{text}`")).alias("w"))


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"))


def find(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Hits (key, start, length, window) of the windows of `items` (see `item_windows`)."""
    distinct = items.select("window", "length").distinct()
    sizes = distinct.groupBy("length").count().collect()  # at most WINDOW rows
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"key {_key_type(docs, doc_id, text)}, start int, length int, window string")
    small = sum(r["count"] for r in sizes) <= BROADCAST_WINDOWS
    tests = distinct.select("window")
    scanned = document_windows(keyed(docs, text, doc_id), sorted(r["length"] for r in sizes), triggers(distinct))
    return scanned.join(F.broadcast(tests) if small else tests, "window").select("key", "start", "length", "window").distinct()


def _key_type(docs: DataFrame, doc_id: str, text: str) -> str:
    return docs.select(document_key(doc_id, text).alias("k")).schema["k"].dataType.simpleString()


def spans(hits: DataFrame) -> DataFrame:
    """Maximal runs of hit words: (key, start, end), end exclusive."""
    end = F.col("start") + F.col("length")
    order = Window.partitionBy("key").orderBy("start", "length")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before >= F.col("start"), 0).otherwise(1)
    runs = hits.withColumn("opens", opens).withColumn(
        "run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max(end).alias("end")).drop("run")


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: id, `n_words`, `n_hit`, `n_items`, `item_ids` (sorted strings).

    Null and empty texts have no words and no hits.  Rows that share an id and a text get the same
    result each; rows that share only an id are told apart; a null id is kept.  Without test items
    nothing is hit.  Items without an id hit words like any other and are left out of `n_items` and `item_ids` only.
    Other columns play no part.
    """
    items = written(item_windows(benchmark, nameless=True), "test-windows")
    hits = written(find(docs, items, text, doc_id), "test-hits")
    covered = spans(hits).groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    named = (
        hits.select("key", "window").distinct().join(items.where("item_id is not null").select("window", "item_id"), "window")
        .groupBy("key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    named = named.withColumnRenamed("key", "of")  # both come from the hits: told apart by name
    found = covered.join(named, F.col("key").eqNullSafe(F.col("of")), "left").drop("of")
    counted = keyed(docs, text, doc_id).select("key", F.size("w").cast("long").alias("n_words"))
    return counted.join(found, counted["key"].eqNullSafe(found["key"]), "left").select(
        counted["key"]["id"].alias(doc_id),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` without the documents that hold a window of any test item, with an id or not; clean rows are
    returned unchanged."""
    hits = find(docs, written(item_windows(benchmark, nameless=True), "test-windows"), text, doc_id).select("key").distinct()
    return docs.join(hits, document_key(doc_id, text).eqNullSafe(hits["key"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with the hit words, and what separates them from the next word, cut out of the text; items
    without an id count as well."""
    hits = find(docs, written(item_windows(benchmark, nameless=True), "test-windows"), text, doc_id)
    cuts = spans(hits).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("__cuts"))
    joined = docs.join(cuts, document_key(doc_id, text).eqNullSafe(cuts["key"]), "left").drop(cuts["key"])
    pieces = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(_PIECES), F.lit(0))
    lead = F.col("__pieces")[0].rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").cast("int")
    kept = F.filter(
        "__pieces",
        lambda _, i: ~F.exists(
            "__cuts", lambda c: (F.floor((i - F.col("__lead")) / 2) >= c["start"]) & (F.floor((i - F.col("__lead")) / 2) < c["end"])
        ),
    )
    cut = joined.withColumn("__pieces", pieces).withColumn("__lead", lead)
    out = with_columns(cut, **{text: F.when(F.col("__cuts").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, ""))})
    return out.select(*[f"`{c}`" for c in docs.columns])
