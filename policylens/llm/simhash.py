"""SimHash near-duplicates: a binary trie joined with itself.

Fingerprints within `ERRORS` differing bits of each other link.  Of the four 16-bit blocks of two such
fingerprints one is equal, so the trie is grown four times, each time with another block in front: all
links of a trie then lie below its nodes at depth 16, and those subtrees are what Spark deals out.  In
a task, pairs of nodes of a subtree are traversed together from its root: their children pair up, a bit
in which they differ is charged to the pair, and a pair goes when its charge exceeds the budget.  A pair
whose open bits can no longer exceed it links all its leaves at once.  Subtrees with very many leaves
are cut in parts, and every pair of parts is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.llm.common import arrow_map, column, written
from policylens.llm.components import components

#: Words of a shingle, seed of its hash, differing bits that still link, bits of a block.
SHINGLE, SEED, ERRORS, BLOCK = 3, 42, 3, 16
#: Leaves of a part of a subtree, and node pairs that are expanded at a time.
PART, PAIRS = 2048, 1 << 17
#: Subtrees in parts up to which their list is broadcast.
BROADCAST_SUBTREES = 100_000


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text; zero for a text without words."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = zip(*[found[i:] for i in range(SHINGLE)]) if len(found) >= SHINGLE else [tuple(found)]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        block = hashes[start : start + (1 << 15)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint), the fingerprint's 64 bits as a long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t) for t in column(batch, "text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "fingerprint"])

    held = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return arrow_map(held, work, f"doc_id {held.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b connect it with."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up


def _products(lo_a, n_a, lo_b, n_b) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the ranges, one range pair after the other."""
    size = n_a * n_b
    pair = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return lo_a[pair] + k // n_b[pair], lo_b[pair] + k % n_b[pair]


def trie_links(leaves: np.ndarray, depth: int = BLOCK, errors: int = ERRORS) -> np.ndarray:
    """For each of the sorted distinct `leaves` the first one in its component of links.

    Leaves are compared if they agree in their first `depth` bits.
    """
    n = len(leaves)
    cuts = np.flatnonzero(np.diff(leaves >> np.uint64(64 - depth))) + 1 if n else np.zeros(0, np.int64)
    lo, hi = np.append(0, cuts), np.append(cuts, n)
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    root, links_a, links_b, held = np.arange(n), [], [], 0

    def link(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal held
        links_a.append(a)
        links_b.append(b)
        held += len(a)

    def settle() -> None:
        nonlocal root, held
        if held:
            everyone = np.arange(n)
            root = forest(n, np.concatenate([everyone, *links_a]), np.concatenate([root, *links_b]))
            links_a.clear()
            links_b.clear()
            held = 0

    while stack:
        at, a0, a1, b0, b1, charge = stack.pop()
        if len(a0) > PAIRS:
            for s in range(0, len(a0), PAIRS):
                stack.append((at, *(x[s : s + PAIRS] for x in (a0, a1, b0, b1, charge))))
            continue
        # few leaves: compare them one by one
        few = (a1 - a0) * (b1 - b0) <= 32
        if few.any():
            x, y = _products(a0[few], (a1 - a0)[few], b0[few], (b1 - b0)[few])
            near = (x < y) & (np.bitwise_count(leaves[x] ^ leaves[y]) <= errors)
            link(x[near], y[near])
        # the open bits fit in the budget: all leaves of both nodes link
        sure = ~few & (charge + 64 - at <= errors)
        for i in np.flatnonzero(sure):
            mine = np.concatenate([np.arange(a0[i], a1[i]), np.arange(b0[i], b1[i])])
            link(mine, np.full(len(mine), a0[i]))
        if held > 1 << 20:
            settle()
        rest = ~few & ~sure
        if not rest.any():
            continue
        a0, a1, b0, b1, charge = (x[rest] for x in (a0, a1, b0, b1, charge))
        bit = np.uint64(1 << (63 - at))
        below = ~np.uint64((1 << (64 - at)) - 1)
        am = np.searchsorted(leaves, (leaves[a0] & below) | bit)
        bm = np.searchsorted(leaves, (leaves[b0] & below) | bit)
        same = a0 == b0
        other = ~same
        children = [
            (a0, am, b0, bm, charge),
            (am, a1, bm, b1, charge),
            (a0, am, bm, b1, charge + 1),
            tuple(x[other] for x in (am, a1, b0, bm, charge + 1)),
        ]
        c = [np.concatenate(x) for x in zip(*children)]
        alive = (c[1] > c[0]) & (c[3] > c[2]) & (c[4] <= errors) & ~((c[0] == c[2]) & (c[1] - c[0] == 1))
        if alive.any():
            stack.append((at + 1, *(x[alive] for x in c)))
    settle()
    return root


def _turned(value: np.ndarray, by: int) -> np.ndarray:
    """The bits moved left by `by` places, those that fall out coming in again on the right."""
    return value if by == 0 else (value << np.uint64(by)) | (value >> np.uint64(64 - by))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect what lies within `ERRORS` bits, at most one per leaf, trie and part pair."""
    block = F.lit((1 << BLOCK) - 1)
    tries = 64 // BLOCK
    leaves = distinct.select(
        "fingerprint", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("trie")
    ).withColumn("node", F.expr(f"shiftrightunsigned(fingerprint, 64 - {BLOCK} * (trie + 1))").bitwiseAND(block))
    large = written(
        leaves.groupBy("trie", "node").count().where(F.col("count") > PART)
        .select("trie", "node", F.ceil(F.col("count") / PART).cast("int").alias("parts")), "subtrees")
    small_list = large.count() <= BROADCAST_SUBTREES
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("fingerprint"), parts).cast("int")
    dealt = (
        leaves.join(F.broadcast(large) if small_list else large, ["trie", "node"], "left")
        .withColumn("mine", mine)
        .withColumn("theirs", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("trie", "node", F.least("mine", "theirs").alias("i"), F.greatest("mine", "theirs").alias("j"), "fingerprint")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(group: tuple[int, ...], held: list[np.ndarray]) -> pa.RecordBatch:
            by = group[0] * BLOCK
            turned = np.unique(_turned(np.concatenate(held).view(np.uint64), by))
            root = trie_links(turned)
            at = np.flatnonzero(root != np.arange(len(root)))
            back = _turned(turned, (64 - by) % 64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(back[at]), pa.array(back[root[at]])], ["a", "b"])

        # rows come sorted; groups of a trie that hold whole subtrees are worked on together
        open_group, held, size = None, [], 0
        for batch in batches:
            cols = [column(batch, k).to_numpy() for k in ("trie", "i", "j", "node", "fingerprint")]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols[:4]], axis=0)) + 1
            for s, e in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
                if s == e:
                    continue
                group = tuple(int(c[s]) for c in cols[:3])
                if held and (group != open_group or (size > 1 << 17 and int(cols[3][s]) != node)):
                    yield close(open_group, held)
                    held, size = [], 0
                open_group, node = group, int(cols[3][s])
                held.append(cols[4][s:e])
                size += int(e - s)
        if held:
            yield close(open_group, held)

    sorted_rows = dealt.repartition("trie", "node", "i", "j").sortWithinPartitions("trie", "i", "j", "node")
    return sorted_rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of `docs`, groups of linked fingerprints.

    `component_id` is the smallest id that links lead to.  Texts without words, null ones too, have the
    fingerprint zero and link like any other.  Rows without an id get their group's smallest id, null if
    the group has none.  Repeated rows share a group.  Other columns play no part.
    """
    prints = written(fingerprints(docs, text, doc_id), "fingerprints")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    found = components(links(distinct.select("fingerprint")))
    grouped = (
        distinct.join(found, distinct["fingerprint"] == found["node"], "left")
        .select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    )
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    of = grouped.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with one document of each group: that of the smallest id, and of its texts that of the smallest hash.

    A document is told apart by its id and text, so texts that share an id are judged each on its own.
    A row without an id stays.  Of rows equal in id and text one stays.
    """
    named = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(_key(text, doc_id).alias("key"), F.col(f"`{text}`").alias("text"))
    groups = near_duplicates(named, "text", "key").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("component_id").alias("top"))
    # one narrow row per id and text decides everything; texts move once, to meet what goes
    narrow = written(groups.select(F.col("doc_id.id").alias("__id"), F.col("doc_id.hash").alias("__hash"), "n", (F.col("doc_id") == F.col("top")).alias("stays")), "groups")
    kept = docs.join(narrow.where("not stays"), _same(docs, narrow, text, doc_id), "left_anti")
    again = narrow.where("stays and n > 1")
    if again.isEmpty():
        return kept
    same = _same(kept, again, text, doc_id)
    return _once(kept.join(again, same, "left_semi"), text, doc_id).unionByName(kept.join(again, same, "left_anti"))


def _same(docs: DataFrame, named: DataFrame, text: str, doc_id: str) -> Column:
    """Whether a row of `docs` is the document of a row (__id, __hash); the hash of a null text is a number too."""
    return (docs[f"`{doc_id}`"] == named["__id"]) & (F.xxhash64(docs[f"`{text}`"]) == named["__hash"])


def _key(text: str, doc_id: str) -> Column:
    return F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"))


def _once(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One row per id and text (rows without an id stay), chosen by its content."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = docs.where(F.col(f"`{doc_id}`").isNotNull())
    named = held.groupBy(_key(text, doc_id).alias("key")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return named.select(*[F.col("row")[c].alias(c) for c in docs.columns]).unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
