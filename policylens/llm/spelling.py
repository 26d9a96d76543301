"""Spelling variants by finite-state composition.

Two words are near if one inserted, deleted or replaced code point apart: the pairs that the vocabulary's
acceptor, composed with a one-edit transducer and with the acceptor again, accepts.  A state of the composed
machine is (state of the first acceptor, state of the second, edits so far).  The composition is partitioned
by where it starts: a partition fixes a word's first half and leaves the second half open, or fixes the second
half and starts at the first one; an edit leaves one of the halves as it is.  The words of a partition then differ in the
open part only, and its minimised acceptor holds just that.  Partitions with too many words, or with long open
parts, are cut again, each into two with half the open part, until they fit: what they fix grows, so no pair is
lost, and the smallest open part (one code point) has few words by nature.

An edit's place is the first code point in which the two words differ.  It lies in exactly one open part, so every pair
is found once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.llm.common import column, written
from policylens.session import checkpointed

#: Words of a partition that one task composes, and code points of an open part, before a partition is cut in two.
PARTITION, OPEN = 4096, 48
#: Code points and occurrences that a word has at least; a form occurs so many times as often as its word.
SHORTEST, RAREST, RATIO = 5, 3, 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["length", "start", "stop", "before", "after"]


def runs(text: Column) -> Column:
    """Maximal runs of letters from A to Z and U+00C0 to U+00FF, with A to Z in lower case; none for null."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-z\\u00C0-\\u00FF]+"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def thinned(doc_id: Column, run: Column, every: int = 97) -> Column:
    """`run` without the code point at h modulo its length, if `every` divides h, the CRC-32 of "id:run"."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(words: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n) of the column `word`, counted before the shuffle; short and rare words go."""
    counts = words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= rarest)


class Acceptor:
    """Minimised acceptors of sets of words of one length each; equal states of all sets are one state."""

    def __init__(self) -> None:
        #: Arcs (symbol, state) by state; state 0 ends words.
        self.arcs: list[tuple[tuple[str, int], ...]] = [()]
        self.register: dict[tuple[tuple[str, int], ...], int] = {(): 0}
        self._common: dict[tuple[int, int], list[str]] = {(0, 0): [""]}

    def _state(self, arcs: list[tuple[str, int]]) -> int:
        key = tuple(arcs)
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.arcs)
            self.arcs.append(key)
        return found

    def add(self, words: list[str]) -> int:
        """The start state of sorted, distinct words of one length."""
        path: list[list[tuple[str, int]]] = [[]]
        before = ""
        for word in words:
            same = 0
            while same < len(before) and before[same] == word[same]:
                same += 1
            self._close(path, before, same)
            path.extend([] for _ in range(len(word) - same))
            before = word
        self._close(path, before, 0)
        return self._state(path[0])

    def _close(self, path: list[list[tuple[str, int]]], word: str, depth: int) -> None:
        """States of `word` deeper than `depth` get no more arcs."""
        while len(path) - 1 > depth:
            state = self._state(path.pop())
            path[-1].append((word[len(path) - 1], state))

    def common(self, p: int, q: int) -> list[str]:
        """What both states accept: the composed machine after its edit."""
        key = (p, q) if p < q else (q, p)
        found = self._common.get(key)
        if found is None:
            other = dict(self.arcs[q])
            found = [a + rest for a, s in self.arcs[p] if (t := other.get(a)) is not None for rest in self.common(s, t)]
            self._common[key] = found
        return found

    def pairs(self, short: int, long: int | None, at_end: bool) -> Iterator[tuple[str, str]]:
        """Pairs of words one edit apart: both of `short`, or one of `short` and one of `long`, one code point longer.

        `at_end`: the words end where the open part does, so that a code point may also be added after the last one.
        """
        stack: list[tuple[int, int | None, str]] = [(short, long, "")]
        while stack:
            p, q, read = stack.pop()
            arcs = self.arcs[p]
            for i, (a, s) in enumerate(arcs):
                for b, t in arcs[i + 1 :]:
                    for rest in self.common(s, t):
                        yield read + a + rest, read + b + rest
            if q is None:
                if p:
                    stack.extend((s, None, read + a) for a, s in arcs)
                continue
            for c, t in self.arcs[q]:
                if p == 0:
                    if at_end:
                        yield read, read + c
                    continue
                for rest in self.common(p, t):
                    if rest[0] != c:  # else the words agree here, and the edit is further on
                        yield read + rest, read + c + rest
            follow = dict(self.arcs[q])
            stack.extend((s, follow.get(a), read + a) for a, s in arcs)


def _entries(words: DataFrame) -> DataFrame:
    """Every word in the partitions of its own length and, as the longer one, of that less one: each with one half open."""
    size = F.char_length("word")
    classes = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("extra"))
    classes = classes.withColumn("length", size - F.col("extra")).where(F.col("length") > 0)
    whole = classes.withColumn("start", F.lit(0)).withColumn("stop", F.col("length"))
    return _halves(whole)


def _halves(entries: DataFrame) -> DataFrame:
    """Two entries for each, with half the open part; an open part of one code point stays."""
    middle = ((F.col("start") + F.col("stop")) / 2).cast("int")
    parts = F.array(
        F.struct(F.col("start").alias("start"), middle.alias("stop")), F.struct(middle.alias("start"), F.col("stop").alias("stop"))
    )
    cut = entries.select("word", "n", "extra", "length", F.explode(parts).alias("part")).where("part.start < part.stop")
    return cut.select(
        "word", "n", "extra", "length", "part.start", "part.stop",
        F.expr("substring(word, 1, part.start)").alias("before"),
        F.expr("substring(word, part.stop + extra + 1)").alias("after"),
    )


def partitions(words: DataFrame) -> DataFrame:
    """Words in partitions that a task can compose: one row per word and partition."""
    entries = written(_entries(words), "spelling-partitions")
    while True:
        many = (F.col("size") > PARTITION) | (F.col("stop") - F.col("start") > OPEN)
        sizes = entries.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"))
        large = checkpointed(sizes.where(many & (F.col("size") > 1) & (F.col("stop") - F.col("start") > 1)).drop("size"))
        if large.isEmpty():
            return entries
        again = entries.join(large, _KEY, "left_semi").select(entries.columns)
        rest = entries.join(large, _KEY, "left_anti").select(entries.columns)
        entries = written(rest.unionByName(_halves(again).select(entries.columns)), "spelling-partitions")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all pairs of `words` (word, n; distinct) at one edit, in both directions."""
    entry = F.struct(F.expr("substring(word, start + 1, stop - start + extra)").alias("part"), "n")
    groups = partitions(words).groupBy(*_KEY).agg(
        F.collect_list(F.when(F.col("extra") == 0, entry)).alias("short"), F.collect_list(F.when(F.col("extra") == 1, entry)).alias("long")
    )
    groups = groups.where((F.size("short") > 0) & (F.size("short") + F.size("long") > 1))
    flat = groups.select(
        "before", "after", (F.col("stop") == F.col("length")).alias("at_end"),
        F.col("short.part").alias("short"), F.col("short.n").alias("short_n"), F.col("long.part").alias("long"), F.col("long.n").alias("long_n"),
    )

    names = flat.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            columns = [column(batch, c) for c in names]
            for row in range(batch.num_rows):
                before, after, at_end, short, short_n, long, long_n = (c[row].as_py() for c in columns)
                counts = dict(zip(short + long, short_n + long_n, strict=True))  # their lengths differ
                machine = Acceptor()
                first, second = machine.add(sorted(short)), machine.add(sorted(long)) if long else None
                for a, b in machine.pairs(first, second, at_end):
                    u, v = before + a + after, before + b + after
                    out += (u, v, counts[b]), (v, u, counts[a])
                if len(out) > 50_000 or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                        ["word", "near", "near_n"],
                    )
                    out = []

    return flat.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every (word, form): where following forms ends.  Every round doubles the steps taken at once.

    Forms must not lead in a circle; theirs occur ever more often.
    """
    found = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        hop = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = found.join(hop, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = written(step, "spelling-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        found = step.select("word", "root")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ratio: int = RATIO) -> DataFrame:
    """One row per word of the whole texts: word, form, root, n, n_near, form_n.

    A word's form is its near word that occurs most (ties: the smallest in code-point order), if it occurs `ratio` times as
    often as the word at least (`ratio` is over 1); else null.  `root` follows forms to the last one and is the word itself
    without a form.  Null and empty texts hold no words.  In a row without an id no code point is deleted.  Repeated
    rows count as often as they come.  Runs of any length are words; an empty table gives no rows.  Other columns
    of `docs` are not read, so their names do not matter.
    """
    if ratio < 2:
        raise ValueError("ratio has to be 2 or more")
    found = docs.select(F.col(f"`{doc_id}`").alias("id"), F.explode(runs(F.col(f"`{text}`"))).alias("run"))
    words = written(vocabulary(found.select(thinned(F.col("id"), F.col("run")).alias("word"))), "spelling-vocabulary")
    near = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    is_form = -F.col("best.less") >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    judged = written(judged, "spelling-forms")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
