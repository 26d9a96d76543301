"""Features of JSON records: flattening, hashing and derived columns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylens.functions import kernels as K

# How deep a record may nest and how many features it may have.
MAX_DEPTH = 8
MAX_FEATURES = 4096
MAX_TERMS = 1 << 20


class FeatureError(ValueError):
    """A record cannot be turned into features."""


def _named_values(node: Any, name: str, depth: int, out: list[tuple[str, float]]) -> None:
    """Append (feature name, value) for everything below `node`."""
    if node is None:
        return
    if isinstance(node, bool):
        out.append((f"{name}={'true' if node else 'false'}", 1.0))
    elif isinstance(node, (int, float)):
        if not np.isfinite(np.float32(node)):
            raise FeatureError(f"{name} = {node} is not a finite 32-bit number")
        out.append((name, float(np.float32(node))))
    elif isinstance(node, str):
        out.append((f"{name}={node}", 1.0))
    else:
        if depth >= MAX_DEPTH:
            raise FeatureError(f"nested more than {MAX_DEPTH} levels at {name}")
        if isinstance(node, dict):
            for key, child in node.items():
                _named_values(child, f"{name}.{key}" if name else key, depth + 1, out)
        else:
            for i, child in enumerate(node):
                # strings form a bag under the array's own name
                inner = name if isinstance(child, str) else f"{name}[{i}]"
                _named_values(child, inner, depth + 1, out)
    if len(out) > MAX_FEATURES:
        raise FeatureError(f"more than {MAX_FEATURES} features")


def named_values(text: str | None) -> list[tuple[str, float]]:
    doc = json.loads(text) if text else None
    if doc is None:
        return []
    if not isinstance(doc, dict):
        raise FeatureError("features must be a JSON object or null")
    out: list[tuple[str, float]] = []
    with np.errstate(over="ignore"):
        _named_values(doc, "", 0, out)
    return out


def _gather(starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each wanted piece of a flat array, and where its entries stand in it."""
    size = lengths[which]
    owner, at = K.ragged_positions(size)
    return size, starts[which][owner] + at


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))[:-1]


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())


def _codes(texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
    """The distinct values of a string array, null for null, and each row's place among them."""
    coded = texts.dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _parsed(texts: Sequence[str | None]) -> tuple[list[list[tuple[str, float]]], list[str | None]]:
    """Features of each text, and what keeps it from having any."""
    out, problems = [], []
    for text in texts:
        try:
            out.append(named_values(text))
            problems.append(None)
        except (ValueError, OverflowError, RecursionError) as error:  # FeatureError, and JSON that cannot be read
            out.append([])
            problems.append(str(error))
    return out, problems


def _flat(named: list[list[tuple[str, float]]]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of features of each text, names, values)."""
    lengths = np.fromiter((len(n) for n in named), np.int64, len(named))
    names = [n for features in named for n, _ in features]
    return lengths, names, np.fromiter((v for features in named for _, v in features), np.float32, len(names))


def _named_hashes(space: str, names: list[str]) -> np.ndarray:
    """Hash of each name in a namespace; equal names are hashed once."""
    seen = sorted(set(names))
    place = dict(zip(seen, range(len(seen)), strict=True))
    prefix = space.encode() + b"\0"
    codes = K.fnv1a(prefix + n.encode() for n in seen).view(np.int64)
    return codes[np.fromiter(map(place.__getitem__, names), np.int64, len(names))] if names else codes


def _first(problems: list[str | None]) -> None:
    for problem in problems:
        if problem is not None:
            raise FeatureError(problem)


def flatten_features(column: Column) -> Column:
    """JSON object text -> array of (name, value) features (F1).  Equal texts of a batch are read once."""

    @F.arrow_udf("array<struct<name:string,value:float>>")
    def flat(texts: pa.Array) -> pa.Array:
        distinct, code = _codes(texts)
        named, problems = _parsed(distinct)
        _first(problems)
        lengths, names, values = _flat(named)
        size, at = _gather(_starts(lengths), lengths, code)
        pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(at)), pa.array(values[at], pa.float32())], ["name", "value"])
        return pa.ListArray.from_arrays(_offsets(size), pairs)

    return flat(column)


def hash_features(names: Column, namespace: str) -> Column:
    """64-bit hashes, as signed bits, of an array of feature names (F2).  Equal names of a batch are hashed once."""
    prefix = namespace.encode() + b"\0"

    @F.arrow_udf("array<bigint>")
    def hashed(lists: pa.Array) -> pa.Array:
        distinct, code = _codes(lists.flatten())
        codes = K.fnv1a(prefix + n.encode() for n in distinct).view(np.int64)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(_offsets(size), pa.array(codes[code]))

    return hashed(names)


def text_hash(column: Column) -> Column:
    """FNV-1a 64 of a string's UTF-8 bytes, as signed bits."""

    @F.pandas_udf("bigint")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(K.fnv1a(t.encode() for t in texts).view(np.int64))

    return hashed(column)


def interaction_hash(first: Column, second: Column) -> Column:
    """Hash of a quadratic interaction of two features (F2)."""

    @F.pandas_udf("bigint")
    def hashed(a: pd.Series, b: pd.Series) -> pd.Series:
        left = a.to_numpy(np.int64).view(np.uint64)
        right = b.to_numpy(np.int64).view(np.uint64)
        return pd.Series(K.pair_hash(left, right).view(np.int64))

    return hashed(first, second)


def slot_of(hashes: Column, bits: int) -> Column:
    """Model slot of a hash: the low bits of its mix."""

    @F.pandas_udf("bigint")
    def slots(h: pd.Series) -> pd.Series:
        mixed = K.mix64(h.to_numpy(np.int64).view(np.uint64))
        return pd.Series((mixed & np.uint64((1 << bits) - 1)).astype(np.int64))

    return slots(hashes)


def fold_of(column: Column, folds: int) -> Column:
    """Cross-fitting fold of a decision id: mixed FNV-1a modulo `folds`."""
    if not 2 <= folds <= 100:
        raise ValueError("folds must be in [2, 100]")

    @F.pandas_udf("int")
    def fold(ids: pd.Series) -> pd.Series:
        mixed = K.mix64(K.fnv1a(i.encode() for i in ids))
        return pd.Series((mixed % np.uint64(folds)).astype(np.int32))

    return fold(column)


def uniform_of_seed(seed: Column) -> Column:
    """The first SplitMix64 draw in [0, 1) of a seed stored as signed bits."""

    @F.pandas_udf("double")
    def uniform(seeds: pd.Series) -> pd.Series:
        return pd.Series(K.unit_interval(K.splitmix(seeds.to_numpy(np.int64).view(np.uint64))))

    return uniform(seed)


def stream_seed(base: int, n: Column) -> Column:
    """Seed number `n` of a policy with a fixed base seed, as signed bits."""

    @F.pandas_udf("bigint")
    def seeds(counter: pd.Series) -> pd.Series:
        steps = counter.to_numpy(np.int64).view(np.uint64) * K.GOLDEN
        return pd.Series(K.splitmix(np.uint64(base) ^ steps).view(np.int64))

    return seeds(n)


def featurize(df: DataFrame, declared: dict[str, dict] | None = None, strict: bool = True) -> DataFrame:
    """Add `features`: hashed request features `x` and one list per eligible action `a`.

    Done once per row; every model reuses the column (F1, F2, F5).  `declared` replaces the
    features of the actions it names.  A record that is no JSON object, nests too deep or has too many
    features or terms (`MAX_TERMS`, F3) fails the job; without `strict` it has no features, and `features.problem`
    tells why (null in all other rows), see `featurized`.

    Texts are read, and names hashed, once per distinct value of a batch; all else moves as whole arrays.
    """
    own = {name: named_values(json.dumps(features)) for name, features in (declared or {}).items()}

    @F.arrow_udf(
        "x array<struct<hash:bigint,value:float>>, a array<array<struct<hash:bigint,value:float>>>, problem string"
    )
    def hashed(context: pa.Array, derived: pa.Array, ids: pa.Array, features: pa.Array) -> pa.Array:
        rows = len(context)
        parts = [_request("c", context), _request("d", derived)]
        per_row = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        a_size, a_hash, a_value, a_problem = _actions(ids.flatten(), features.flatten(), own)
        a_row = np.repeat(np.arange(rows), per_row)
        x_size = parts[0][0] + parts[1][0]
        first_bad = np.full(rows, "", object)
        for bad, at in ((a_problem, a_row), (parts[1][3], np.arange(rows)), (parts[0][3], np.arange(rows))):
            hit = np.flatnonzero(bad != "")
            first_bad[at[hit]] = bad[hit]
        wide = np.zeros(rows, bool)
        wide[a_row[1 + a_size + x_size[a_row] * (1 + a_size) > MAX_TERMS]] = True
        first_bad[wide & (first_bad == "")] = f"more than {MAX_TERMS} terms"
        bad = first_bad != ""
        if strict and bad.any():
            raise FeatureError(first_bad[bad][0])
        # what belongs to a bad row goes
        starts = _starts(np.where(bad, 0, x_size))
        x_hash, x_value = (np.empty(int(np.where(bad, 0, x_size).sum()), t) for t in (np.int64, np.float32))
        for (size, codes, values, _), before in zip(parts, (np.zeros(rows, np.int64), parts[0][0])):
            owner, pos = K.ragged_positions(size)
            good = ~bad[owner]
            to = (starts + before)[owner] + pos
            x_hash[to[good]], x_value[to[good]] = codes[good], values[good]
        a_good = ~bad[a_row]
        e_good = np.repeat(a_good, a_size)
        x = pa.ListArray.from_arrays(_offsets(np.where(bad, 0, x_size)), _entries(x_hash, x_value))
        inner = pa.ListArray.from_arrays(_offsets(a_size[a_good]), _entries(a_hash[e_good], a_value[e_good]))
        a = pa.ListArray.from_arrays(_offsets(np.where(bad, 0, per_row)), inner)
        told = pa.array(np.where(bad, first_bad, None).tolist(), pa.string())
        return pa.StructArray.from_arrays([x, a, told], ["x", "a", "problem"])

    picked = F.transform("eligible", lambda i: F.get(F.col("actions"), i))
    return df.withColumn(
        "features",
        hashed(
            F.col("context"),
            F.col("derived"),
            F.transform(picked, lambda a: a["id"]),
            F.transform(picked, lambda a: a["features"]),
        ),
    )


def featurized(df: DataFrame, declared: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with `features`, and the rows that cannot have any with `problem`."""
    both = featurize(df, declared, strict=False)
    told = F.col("features.problem")
    return both.filter(told.isNull()), both.filter(told.isNotNull()).withColumn("problem", told).drop("features")


def _entries(codes: np.ndarray, values: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(codes, pa.int64()), pa.array(values, pa.float32())], ["hash", "value"])


def _told(problems: list[str | None]) -> np.ndarray:
    return np.array([p or "" for p in problems] + [""], object)[:-1]


def _request(space: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of features per row, hashes, values, problem per row or "") of request features."""
    distinct, code = _codes(texts)
    named, problems = _parsed(distinct)
    lengths, names, values = _flat(named)
    size, at = _gather(_starts(lengths), lengths, code)
    return size, _named_hashes(space, names)[at], values[at], _told(problems)[code]


def _actions(ids: pa.Array, texts: pa.Array, own: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of actions, which have their id as a feature."""
    (names, name), (distinct, code) = _codes(ids), _codes(texts)
    named, problems = _parsed(distinct)
    told = _told(problems)
    pair, back = np.unique(name.astype(np.int64) * max(len(distinct), 1) + code, return_inverse=True)
    full, bad = [], []
    for n, t in zip((pair // max(len(distinct), 1)).tolist(), (pair % max(len(distinct), 1)).tolist()):
        declared = names[n] in own
        full.append([(f"id={names[n]}", 1.0), *(own[names[n]] if declared else named[t])])
        bad.append("" if declared else told[t])
    lengths, flat, values = _flat(full)
    size, at = _gather(_starts(lengths), lengths, back)
    return size, _named_hashes("a", flat)[at], values[at], np.array([*bad, ""], object)[:-1][back]


def with_derived(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Publish derived features; a NULL value publishes nothing."""
    fields = [value.alias(name) for name, value in columns.items()]
    return df.withColumn("derived", F.to_json(F.struct(*fields)))


def exclude(df: DataFrame, action: str, when: Column) -> DataFrame:
    """Rule an action out where `when` holds."""
    return _named_when(df, "excluded_ids", action, when)


def only(df: DataFrame, action: str, when: Column) -> DataFrame:
    """Restrict the choice to the actions named by `only` rules that hold."""
    return _named_when(df, "only_ids", action, when)


def _named_when(df: DataFrame, column: str, action: str, when: Column) -> DataFrame:
    empty = F.array().cast("array<string>")
    before = F.coalesce(F.col(column), empty) if column in df.columns else empty
    add = F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(action))).otherwise(empty)
    return df.withColumn(column, F.concat(before, add))


def restrict(df: DataFrame) -> DataFrame:
    """Turn exclusion and only rules into `eligible` (F6, F7); an empty list means an error."""
    from policylens.functions.pmf import eligible_positions

    ids = F.transform("actions", lambda a: a["id"])
    allowed = None
    if "only_ids" in df.columns:
        allowed = F.when(F.size("only_ids") > 0, F.col("only_ids"))
    banned = F.col("excluded_ids") if "excluded_ids" in df.columns else None
    return df.withColumn("eligible", eligible_positions(ids, allowed, banned))


def restriction_problem() -> Column:
    """Why a row's rules leave no valid choice (F7): `unknown_action` if a rule names an id that is no action of the row,
    `nothing_eligible` if no action is left; null for a valid row.  Reads `eligible`, `excluded_ids` and `only_ids`."""
    ids = F.transform("actions", lambda a: a["id"])

    def strange(column: str) -> Column:
        named = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.exists(named, lambda n: ~F.array_contains(ids, n))

    return F.when(F.coalesce(strange("excluded_ids") | strange("only_ids"), F.lit(False)), "unknown_action").when(
        F.coalesce(F.size("eligible"), F.lit(0)) < 1, "nothing_eligible"
    )


def decidable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`df` restricted by its rules (`restrict`): the rows with a valid choice, and those without one with `problem`."""
    none = F.lit(None).cast("array<string>")
    both = df.withColumns({c: none for c in ("excluded_ids", "only_ids") if c not in df.columns})
    told = restrict(both).withColumn("problem", restriction_problem())
    return told.filter("problem is null").drop("problem"), told.filter("problem is not null")


def merge_objects(texts: Column) -> Column:
    """Merge an array of JSON object texts recursively, later entries win."""

    def merged(into: dict, other: dict) -> dict:
        for key, value in other.items():
            if isinstance(value, dict) and isinstance(into.get(key), dict):
                merged(into[key], value)
            else:
                into[key] = value
        return into

    @F.arrow_udf("string")
    def merge(lists: pa.Array) -> pa.Array:
        distinct, code = _codes(lists.flatten())
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        known: dict[bytes, str] = {}  # rows that merge the same texts are merged once
        out = []
        for lo, hi in zip((ends - size).tolist(), ends.tolist()):
            key = code[lo:hi].tobytes()
            if key not in known:
                into: dict = {}
                for i in code[lo:hi].tolist():
                    doc = json.loads(distinct[i])
                    if not isinstance(doc, dict):
                        raise FeatureError("only objects can be merged")
                    merged(into, doc)
                known[key] = json.dumps(into, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
            out.append(known[key])
        return pa.array(out, pa.string())

    return merge(texts)


def model_tag(decide_json: Column, checksum: Column) -> Column:
    """16 hex digits naming a decide section and a snapshot checksum (binary)."""
    payload = F.concat(F.encode(decide_json, "UTF-8"), F.unhex(F.lit("00")), checksum)
    return F.substring(F.sha2(payload, 256), 1, 16)
