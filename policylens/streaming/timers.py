"""Default rewards and deferred activation with event-time timers.

One state per (capsule, decision id): the pending decision, what came before it could be used, the
reward keys seen and whether a reward was given.  The states of a bucket of ids are read, taken through a micro-batch and
written together, and a bucket has one timer, set to the first wait that ends in it: a call to the state store
costs far more than an event.  Events of a micro-batch are taken in time order and
a wait that ends before an event is settled before it, so results do not depend on how the stream is
cut.  A finished decision's state goes `KEEP_MS` after its wait.  No reward is lost with it: one that comes later, or
that never meets its decision, leaves as an `unmatched` row, for the batch join of rewards with stored decisions (E2), which
counts it however late it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from policylens.schema import DEFERRED_TTL_MS, KEY

#: How long a decision whose wait is over still answers rewards.
KEEP_MS = DEFERRED_TTL_MS

OUTPUT = T.StructType(
    [
        *[T.StructField(k, T.StringType()) for k in KEY],
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("idempotency_key", T.StringType()),
    ]
)
#: Input events: kind is decision, deferred, activation or reward.
INPUT_COLUMNS = [*KEY, "id", "kind", "ts", "ts_ms", "value", "idempotency_key"]

#: What is kept of a bucket: its open ids, the rewards that wait for their decision, the reward keys seen (the latter
#: two by the row of their id), each as an Arrow stream, and the time its timer is set to.
STATE = "open binary, held binary, seen binary, timer bigint"
OPEN = pa.schema([
    *[(k, pa.string()) for k in (*KEY, "id")], ("ts", pa.int64()), ("live", pa.bool_()), ("paid", pa.bool_()),
    ("due", pa.int64()), ("activated", pa.bool_()), ("orphan", pa.int64()),
])
HELD = pa.schema([("of", pa.int32()), ("ts", pa.int64()), ("value", pa.float64()), ("idem", pa.string())])
SEEN = pa.schema([("of", pa.int32()), ("idem", pa.string())])
#: Buckets of ids.  What a task holds at a time is one bucket's open ids and its events of a micro-batch.
BUCKETS = 1024
#: Order of events of the same millisecond.
ORDER = {"decision": 0, "deferred": 0, "activation": 1, "reward": 2}
KINDS = list(ORDER)
CODES = {kind: i for i, kind in enumerate(KINDS)}


#: Rows that leave a bucket at a time.
OUT_ROWS = 10_000
#: The time of an event without one: before all others.
NO_TIME = -(1 << 63)


def _table(out: list) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[f.name for f in OUTPUT.fields])


def _in_order(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, int, str, float, str | None]]:
    """A bucket's events of one micro-batch id by id, each id's by time, kind and key, as (id, time, kind, value, key).

    Of each event its arrays are held; a wide frame is held of one part only, and rows of `OUT_ROWS` events.
    """
    ts, rank, value = [], [], []
    texts: dict[str, list] = {c: [] for c in (*KEY, "id", "idempotency_key")}
    for part in parts:
        ts.append(pa.array(part["ts_ms"], pa.int64(), from_pandas=True).fill_null(NO_TIME).to_numpy())
        rank.append(part["kind"].map(CODES).to_numpy(np.int8))
        value.append(part["value"].to_numpy(np.float64, na_value=np.nan))
        for c, held in texts.items():
            held.append(pa.array(part[c], pa.string(), from_pandas=True))
    if not ts:
        return
    t, k, v = (np.concatenate(x) for x in (ts, rank, value))
    named = {c: pa.chunked_array(held) for c, held in texts.items()}
    rows = pa.table({**named, "t": t, "r": np.array([ORDER[c] for c in KINDS], np.int8)[k], "k": k, "v": v})
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("id", *KEY, "t", "r", "idempotency_key")])
    for lo in range(0, len(order), OUT_ROWS):
        part = rows.take(order[lo : lo + OUT_ROWS])
        ids = zip(*(part[c].to_pylist() for c in (*KEY, "id")), strict=True)
        kinds = [KINDS[c] for c in part["k"].to_pylist()]
        yield from zip(ids, part["t"].to_pylist(), kinds, part["v"].to_pylist(), part["idempotency_key"].to_pylist(), strict=True)


def _packed(columns: list, schema: pa.Schema) -> bytes | None:
    """Columns as an Arrow stream; nothing for no rows."""
    if not columns or not len(columns[0]):
        return None
    sink = pa.BufferOutputStream()
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    with pa.ipc.new_stream(sink, schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes | None) -> Iterator[tuple]:
    if packed is None:
        return iter(())
    return zip(*(c.to_pylist() for c in pa.ipc.open_stream(bytes(packed)).read_all().columns), strict=True)


class Pending:
    """One id: its decision, made at `ts` (if it came), in use or still deferred, paid or not, and when its time is over;
    what came before the decision and how long that waits; the reward keys seen."""

    __slots__ = ("ts", "live", "paid", "due", "activated", "orphan", "held", "seen")

    def __init__(
        self, ts: int | None = None, live: bool = False, paid: bool = False, due: int | None = None, activated: bool = False,
        orphan: int | None = None,
    ) -> None:
        self.ts, self.live, self.paid, self.due, self.activated, self.orphan = ts, live, paid, due, activated, orphan
        self.held: list[tuple] = []
        self.seen: set[str] = set()

    def facts(self) -> tuple:
        return self.ts, self.live, self.paid, self.due, self.activated, self.orphan


class RewardTimers(StatefulProcessor):
    """Emits decision, reward, default_reward and unmatched rows; see the module text."""

    def __init__(self, default: float | None, wait_ms: int, mode: str) -> None:
        self.default, self.wait_ms, self.mode = default, wait_ms, mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", STATE)

    def row(self, key: tuple, kind: str, ts: int, value: float | None, idem: str | None) -> list:
        return [*key, kind, ts, value, idem]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any):
        states, timer = self._read()
        out: list = []
        for name, ts, kind, value, idem in _in_order(rows):
            state = states.get(name)
            if state is None:
                state = states[name] = Pending()
            if kind in ("decision", "deferred"):
                if state.ts is None:
                    self._made(name, state, ts, kind == "decision", out)
            elif kind == "activation":
                if state.ts is None:
                    self._wait_for_decision(state, ts)
                    state.activated = True
                elif not state.live:
                    self._go_live(name, state, out)
            else:
                self._reward(name, state, (ts, value, idem), out)
            if len(out) >= OUT_ROWS:
                yield _table(out)
                out = []
        for name in list(states):
            self._expire(states, name, timerValues.getCurrentWatermarkInMs() - 1, out)
        self._write(states, timer)
        yield from self._parts(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any):
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now = max(timerValues.getCurrentWatermarkInMs() - 1, fired)
        states, timer = self._read()
        out: list = []
        for name in list(states):
            self._expire(states, name, now, out)
        self._write(states, None if timer == fired else timer)  # a timer that fired is gone
        yield from self._parts(out)

    def _parts(self, out: list) -> Iterator[pd.DataFrame]:
        for lo in range(0, max(len(out), 1), OUT_ROWS):
            yield _table(out[lo : lo + OUT_ROWS])

    def _read(self) -> tuple[dict[tuple, Pending], int | None]:
        if not self.bucket.exists():
            return {}, None
        opened, held, seen, timer = self.bucket.get()
        states = {row[:4]: Pending(*row[4:]) for row in _unpacked(opened)}
        at = list(states.values())
        for of, *reward in _unpacked(held):
            at[of].held.append(tuple(reward))
        for of, idem in _unpacked(seen):
            at[of].seen.add(idem)
        return states, timer

    def _write(self, states: dict[tuple, Pending], timer: int | None) -> None:
        """Keep the open ids and set the bucket's timer to the first wait that ends."""
        first = min((self._next(state) for state in states.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if not states:
            self.bucket.clear()
            return
        opened = list(zip(*((*key, *state.facts()) for key, state in states.items()), strict=True))
        held = list(zip(*((of, *r) for of, state in enumerate(states.values()) for r in state.held), strict=True))
        seen = list(zip(*((of, i) for of, state in enumerate(states.values()) for i in state.seen), strict=True))
        self.bucket.update((_packed(opened, OPEN), _packed(held, HELD), _packed(seen, SEEN), first))

    def _next(self, state: Pending) -> int:
        """When something happens to an id even if no event comes."""
        if state.ts is None:
            return state.orphan
        if state.live and (state.paid or self.default is None):
            return state.due + KEEP_MS
        return state.due

    def _expire(self, states: dict[tuple, Pending], key: tuple, now: int, out: list) -> None:
        """What ends by itself up to `now`: waits are settled, states that are over go."""
        state = states[key]
        if now < self._next(state):
            return
        if state.ts is None:
            # no decision came, or its state has gone: the batch join has what is left
            out += [self.row(key, "unmatched", *reward) for reward in state.held]
            del states[key]
        elif not state.live:
            del states[key]  # never activated: dropped with what it held
        else:
            self._settled(key, state, out)
            if now >= state.due + KEEP_MS:
                del states[key]

    def _wait_for_decision(self, state: Pending, ts: int) -> None:
        """What comes before its decision waits as long as a deferred decision would."""
        if state.orphan is None:
            state.orphan = ts + DEFERRED_TTL_MS

    def _made(self, key: tuple, state: Pending, ts: int, live: bool, out: list) -> None:
        state.orphan = None
        state.ts, state.due = ts, ts + DEFERRED_TTL_MS
        if live or state.activated:
            self._go_live(key, state, out)

    def _go_live(self, key: tuple, state: Pending, out: list) -> None:
        state.live, state.due = True, state.ts + self.wait_ms
        out.append(self.row(key, "decision", state.ts, None, None))
        waiting = sorted(state.held, key=lambda r: (r[0], r[2] or ""))
        state.held, state.activated = [], False
        for reward in waiting:
            self._reward(key, state, reward, out)

    def _settled(self, key: tuple, state: Pending, out: list) -> None:
        """The decision after its wait: with the default reward if none was given."""
        if state.paid or self.default is None:
            return
        idem = key[3] if self.mode == "first" else f"{key[3]}:default"
        out.append(self.row(key, "default_reward", state.due, self.default, idem))
        state.paid = True

    def _reward(self, key: tuple, state: Pending, reward: tuple, out: list) -> None:
        ts, value, idem = reward
        if state.ts is None:
            state.held.append(reward)
            self._wait_for_decision(state, ts)
            return
        if not state.live:
            if ts >= state.due:
                out.append(self.row(key, "unmatched", ts, value, idem))  # the decision's time to be activated is over
            else:
                state.held.append(reward)
            return
        if ts > state.due:
            self._settled(key, state, out)
        if ts > state.due + KEEP_MS:
            out.append(self.row(key, "unmatched", ts, value, idem))
            return
        if self.mode == "first":
            if state.paid:
                return
            idem = key[3]
        elif idem is not None:
            if idem in state.seen:
                return
            state.seen.add(idem)
        out.append(self.row(key, "reward", ts, value, idem))
        state.paid = True

    def close(self) -> None:
        return None


def with_timers(
    events: DataFrame, default: float | None, wait_seconds: int, mode: str = "first",
    lateness: str = "10 minutes", buckets: int = BUCKETS,
) -> DataFrame:
    """The decided, rewarded and defaulted events of a stream.

    A micro-batch reads and writes the whole state of the buckets that it has events of or whose time has come: with more
    `buckets` that is less per bucket, with fewer there are fewer calls.

    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    return (
        events.select(*INPUT_COLUMNS, F.pmod(F.xxhash64(*KEY, "id"), F.lit(buckets)).alias("bucket"))
        .withWatermark("ts", lateness)
        .groupBy("bucket")
        .transformWithStateInPandas(
            RewardTimers(default, wait_seconds * 1000, mode), OUTPUT, "Append", "EventTime"
        )
    )
