"""Vectorized numpy kernels for 64-bit hashing and draws, used inside Arrow functions.

Spark's bigint arithmetic is checked, so wrapping 64-bit products are done here on whole
batches of unsigned integers.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

# The published constants of FNV-1a, MurmurHash3's finalizer and SplitMix64.
FNV_BASIS = np.uint64(0xCBF29CE484222325)
FNV_PRIME = np.uint64(0x00000100000001B3)
MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SPLIT_1 = np.uint64(0xBF58476D1CE4E5B9)
SPLIT_2 = np.uint64(0x94D049BB133111EB)
BIAS_NAME = b"b\0bias"

U33, U30, U27, U31, U11, U8 = (np.uint64(v) for v in (33, 30, 27, 31, 11, 8))
BYTE = np.uint64(0xFF)


def fnv1a(texts: Iterable[bytes]) -> np.ndarray:
    """FNV-1a 64 of every byte string, one vector step per byte position."""
    items = list(texts)
    lengths = np.fromiter((len(t) for t in items), dtype=np.int64, count=len(items))
    out = np.full(len(items), FNV_BASIS, dtype=np.uint64)
    if not len(items) or not lengths.max(initial=0):
        return out
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(items[i] for i in order), dtype=np.uint8).astype(np.uint64)
    sizes = lengths[order]
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    state = out.copy()
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    for step, live in enumerate(active):
        state[:live] = (state[:live] ^ flat[starts[:live] + step]) * FNV_PRIME
    out[order] = state
    return out


def fnv1a_words(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Continue FNV-1a over the eight little-endian bytes of each word."""
    for shift in range(0, 64, 8):
        state = (state ^ ((words >> np.uint64(shift)) & BYTE)) * FNV_PRIME
    return state


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a quadratic interaction: FNV-1a over both hashes' bytes."""
    start = np.full(first.shape, FNV_BASIS, dtype=np.uint64)
    return fnv1a_words(fnv1a_words(start, first), second)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U33)) * MIX_1
    h = (h ^ (h >> U33)) * MIX_2
    return h ^ (h >> U33)


def splitmix(state: np.ndarray) -> np.ndarray:
    """The first SplitMix64 output of a generator in each given state."""
    z = state + GOLDEN
    z = (z ^ (z >> U30)) * SPLIT_1
    z = (z ^ (z >> U27)) * SPLIT_2
    return z ^ (z >> U31)


def unit_interval(bits: np.ndarray) -> np.ndarray:
    """Top 53 bits as a double in [0, 1)."""
    return (bits >> U11).astype(np.float64) * 2.0**-53


BIAS_HASH = fnv1a([BIAS_NAME])[0]


def ragged_positions(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position inside owner) of every element of a ragged array."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    return owner, np.arange(len(owner)) - starts[owner]


def phi(
    x_len: np.ndarray, x_hash: np.ndarray, x_val: np.ndarray,
    a_len: np.ndarray, a_hash: np.ndarray, a_val: np.ndarray,
    a_row: np.ndarray, bits: int, with_context: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed feature vectors of (row, action) pairs, canonical.

    `x_*` is the ragged list of request features per row, `a_*` the ragged list of action
    features per pair and `a_row` the row of each pair.  Returns (pair, slot, value) sorted by
    pair and slot, colliding slots summed in doubles and exact zeros dropped.
    """
    pairs = len(a_len)
    x_start = np.concatenate(([0], np.cumsum(x_len)))[:-1]
    a_owner, _ = ragged_positions(a_len)
    owners = [np.arange(pairs), a_owner]
    hashes = [np.full(pairs, BIAS_HASH, dtype=np.uint64), a_hash]
    values = [np.ones(pairs), a_val.astype(np.float64)]
    # every action feature meets every request feature of its row
    fan = x_len[a_row[a_owner]]
    left, pos = ragged_positions(fan)
    right = x_start[a_row[a_owner[left]]] + pos
    owners.append(a_owner[left])
    hashes.append(pair_hash(x_hash[right], a_hash[left]))
    product = x_val[right].astype(np.float64) * a_val[left].astype(np.float64)
    values.append(clip_float(product).astype(np.float64))
    if with_context:
        owner, pos = ragged_positions(x_len[a_row])
        at = x_start[a_row[owner]] + pos
        owners.append(owner)
        hashes.append(x_hash[at])
        values.append(x_val[at].astype(np.float64))
    owner = np.concatenate(owners)
    slot = (mix64(np.concatenate(hashes)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = np.concatenate(values)
    order = np.lexsort((value, slot, owner))
    owner, slot, value = owner[order], slot[order], value[order]
    if not len(owner):
        return owner, slot, value.astype(np.float32)
    first = np.flatnonzero(
        np.concatenate(([True], (owner[1:] != owner[:-1]) | (slot[1:] != slot[:-1])))
    )
    summed = clip_float(np.add.reduceat(value, first))
    keep = summed != 0
    return owner[first][keep], slot[first][keep], summed[keep]


def clip_float(values: np.ndarray) -> np.ndarray:
    """To float32, saturating instead of overflowing."""
    top = float(np.finfo(np.float32).max)
    return np.clip(values, -top, top).astype(np.float32)
