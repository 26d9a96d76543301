"""Content-defined anchors: which few positions have to be compared to find all repeated windows.

A window is `length` consecutive symbols (bytes or words) of one text.  Every window picks the one of
its strings of `gram` symbols that hashes smallest, the first one among equals; neighbouring windows
mostly pick the same, and the starts of windows that share their pick form a cell.  Equal windows make
equal picks wherever they are, so a window can only recur where its cell's gram recurs.  Names of
strings are 64-bit polynomial hashes of random symbol values; what is compared always agrees in two
independent ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Symbols that are worked on at a time, and those of one text in them at most.
BLOCK = 1 << 20

_ALL = (1 << 64) - 1
_RNG = np.random.default_rng(20240917)
#: Two odd bases of the polynomials and a random value per byte for each.
_BASES = [int(x) | 1 for x in _RNG.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
BYTE_VALUES = _RNG.integers(0, _ALL, (2, 256), dtype=np.uint64, endpoint=True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of both bases and of their inverses, as far as they were needed."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> Powers:
        if n > self.n:
            self.n = n + n // 4
            self.up = [_powers(b, self.n) for b in _BASES]
            self.down = [_powers(pow(b, -1, 1 << 64), self.n) for b in _BASES]
        return self


class Names:
    """Names of all substrings of a sequence of symbol values, by one of the two bases."""

    def __init__(self, values: np.ndarray, which: int, powers: Powers) -> None:
        powers.upto(len(values) + 1)
        self.down = powers.down[which]
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers.up[which][: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def sliding(self, length: int) -> np.ndarray:
        """Names of all substrings of one length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


@dataclass
class Cells:
    """Cells by first and last window start, with the name of the gram and of all symbols covered."""

    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    cover: np.ndarray


def cells(values: np.ndarray, ends: np.ndarray, length: int, gram: int, powers: Powers) -> Cells:
    """Cells of texts laid end to end: `values` has two symbol values per symbol (2 x n), text i is
    `ends[i]:ends[i + 1]`."""
    one, two = Names(values[0], 0, powers), Names(values[1], 1, powers)
    n = values.shape[1]
    none = np.zeros(0, np.int64)
    if n < length:
        return Cells(none, none, none.astype(np.uint64), none.astype(np.uint64))
    grams = one.sliding(gram)
    bits = np.uint64((1 << max(1, n.bit_length())) - 1)
    ranked = (grams & ~bits) | np.arange(len(grams), dtype=np.uint64)
    pick = (sliding_min(ranked, length - gram + 1) & bits).astype(np.int64)
    room = np.repeat(ends[1:], np.diff(ends))[: len(pick)] - np.arange(len(pick)) >= length
    at = np.flatnonzero(room)
    if not len(at):
        return Cells(none, none, none.astype(np.uint64), none.astype(np.uint64))
    chosen = pick[at]
    cut = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(at) != 1)) + 1
    first, last = at[np.append(0, cut)], at[np.append(cut, len(at)) - 1]
    return Cells(first, last, grams[chosen[np.append(0, cut)]], two.of(first, last + length))


def blocks(texts: Iterator[tuple[int, bytes]], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Byte texts put together to about `BLOCK` bytes: (numbers, offsets, parts).  A longer text is cut
    into parts that overlap by one symbol less than a window."""
    numbers, offsets, parts, size = [], [], [], 0
    for number, text in texts:
        for offset in range(0, max(1, len(text) - length + 1), BLOCK):
            part = text[offset : offset + BLOCK + length - 1]
            if size and size + len(part) > BLOCK:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
            numbers.append(number)
            offsets.append(offset)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, offsets, parts


#: Cells that a task holds to combine equal ones before they are shuffled.
HELD = 1_000_000
#: What a row of `cell_rows` is: a cell that has to be looked up, notice that a gram has several covers,
#: a cell of such a gram, a copy of another cell of the task.
ALONE, NOTICE, KNOWN, COPY = range(4)
#: Bits of a packed number: kind, whether the task holds a copy, window starts; the offset is above them.
KIND_BITS, N_BITS = 2, 21

CELL_SCHEMA = "g long, cover long, doc {id}, loc long, bits long"


def byte_blocks(texts: Iterator[tuple[int, bytes]], length: int):
    """Symbol values of byte texts, block by block: (numbers, offsets, values, ends)."""
    for numbers, offsets, parts in blocks(texts, length):
        flat = np.frombuffer(b"".join(parts), np.uint8)
        yield numbers, offsets, BYTE_VALUES[:, flat], np.append(0, np.cumsum([len(p) for p in parts]))


def word_blocks(texts: Iterator[tuple[int, bytes]], length: int, powers: Powers):
    """The same with words (runs of what is not ASCII white space) as symbols."""

    def short() -> Iterator[tuple[int, int, bytes]]:
        for number, text in texts:
            if len(text) <= BLOCK:
                yield number, 0, text
                continue
            words = text.split()
            step = BLOCK // 8
            for at in range(0, max(1, len(words) - length + 1), step):
                yield number, at, b" ".join(words[at : at + step + length - 1])

    def put_together():
        numbers, offsets, parts, size = [], [], [], 0
        for number, offset, part in short():
            if size and size + len(part) > BLOCK:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
            numbers.append(number)
            offsets.append(offset)
            parts.append(part)
            size += len(part)
        if parts:
            yield numbers, offsets, parts

    for numbers, offsets, parts in put_together():
        flat = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        space = (flat == 32) | ((flat >= 9) & (flat <= 13))
        edge = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        names = [Names(BYTE_VALUES[k][flat], k, powers).of(start, end) for k in (0, 1)]
        ends = np.searchsorted(start, np.append(0, np.cumsum([len(p) + 1 for p in parts])))
        yield numbers, offsets, np.stack(names), ends


def combined(g, cover, doc, loc, n, offset) -> dict[str, np.ndarray]:
    """Rows for the cells of one task: equal ones are combined, and a gram that the task already knows
    with several covers is announced once, so that no key brings many rows from one task.

    `doc` numbers the documents in the order of their ids, so the first of equal cells is the earliest.
    """
    order = np.lexsort((loc, doc, cover, g))
    g, cover, doc, loc, n, offset = (x[order] for x in (g, cover, doc, loc, n, offset))
    same_class = np.append(False, (np.diff(g) == 0) & (np.diff(cover) == 0))
    repeated_row = same_class & np.append(False, (np.diff(doc) == 0) & (np.diff(loc) == 0))
    g, cover, doc, loc, n, offset, same_class = (x[~repeated_row] for x in (g, cover, doc, loc, n, offset, same_class))
    new_gram = np.append(True, np.diff(g) != 0)[: len(g)]
    gram_no = np.cumsum(new_gram) - 1
    covers = np.bincount(gram_no, ~same_class)[gram_no] if len(g) else np.zeros(0)
    kind = np.where(same_class, COPY, np.where(covers > 1, KNOWN, ALONE))
    has_copy = np.append(same_class[1:], False)[: len(g)] & ~same_class
    scattered = mixed(loc.astype(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key = np.where(kind == COPY, scattered, np.where(kind == KNOWN, g ^ cover, g))
    bits = kind | has_copy.astype(np.int64) << KIND_BITS | n << (KIND_BITS + 1) | offset << (KIND_BITS + 1 + N_BITS)
    told = new_gram & (covers > 1)
    return {
        "g": np.concatenate([key, g[told]]),
        "cover": np.concatenate([cover, cover[told]]),
        "doc": np.concatenate([doc, doc[told]]),
        "loc": np.concatenate([loc, loc[told]]),
        "bits": np.concatenate([bits, np.full(told.sum(), NOTICE, np.int64)]),
    }
