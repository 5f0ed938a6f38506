"""Keyed state with event-time timers, right across micro-batches.

Rows of a key may come in any order the watermark allows, also over several micro-batches.
Keys are dealt to a fixed number of buckets, and a bucket's rows wait in its map state, one
entry for each slot of time and batch they fall into.  A timer at the slot's end fires once
the watermark has passed it; the slot's rows are then folded key by key in (time, id) order
and its entries removed, so the result is that of the whole sorted stream.  A batch writes its
own rows and reads the slots of the timers that fire, never what else waits.  What waits is
bounded by the watermark's delay.

Calls of the state store and timers grow with buckets and slots, not with keys: a bucket's
keys are remembered in one value, which is read and written when a slot of the bucket ends.

A key that was silent for ``forget_s`` loses its state, and its next row starts afresh.  State
is kept by the RocksDB provider, so it may outgrow an executor's memory.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

US = 1_000_000
FORGET_S = 90 * 86400.0
SLOT_S = 60.0
#: Part of the layout of the state: a checkpoint goes on with the number it began with.
BUCKETS = 512
FRAME = 10_000  # rows out at once
NEVER = 2**62
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(series) -> np.ndarray:
    return series.astype("datetime64[us]").astype("int64").to_numpy()


def _longs(x) -> bytes:
    return np.asarray(x, np.int64).tobytes()


class InOrder(StatefulProcessor):
    """``fold(key, memory, times, ids, values)`` for a key's rows of a slot, in order, and
    ``quiet(key, memory, now)`` when all rows before ``now`` are folded; for the keys of a bucket."""

    def __init__(self, key, values, names, start, fold, quiet, ts, tie, slot_us, forget_us):
        self.key, self.values, self.names, self.start, self.fold, self.quiet = key, values, names, start, fold, quiet
        self.ts, self.tie, self.slot_us, self.forget_us = ts, tie, slot_us, forget_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, part long", "keys array<string>, places binary, times binary, ids binary, held binary")
        self.standing = handle.getValueState("standing", "slots array<long>, parts array<long>, timer_ms long")
        self.memory = handle.getValueState("memory", "keys array<string>, numbers binary, latest binary, due binary")

    def _end_ms(self, us: int) -> int:
        """End of the slot that holds a time."""
        return -(-((us // self.slot_us + 1) * self.slot_us) // 1000)

    def _standing(self) -> tuple[dict, int]:
        """Slots that wait with their numbers of parts, and the quiet or forgetting timer that stands."""
        found = self.standing.get()
        return (dict(zip(found[0], found[1])), found[2]) if found else ({}, -1)

    def _known(self) -> dict:
        """For each key its memory, the time of its last row folded and when to ask ``quiet`` again."""
        found = self.memory.get()
        if not found:
            return {}
        keys, numbers, latest, due = found
        numbers = np.frombuffer(numbers, float).reshape(len(keys), len(self.start)).tolist()
        return {k: [*own] for k, *own in zip(keys, numbers, np.frombuffer(latest, np.int64).tolist(), np.frombuffer(due, np.int64).tolist())}

    def _keep(self, slots: dict, timer_ms: int, known: dict) -> None:
        if slots or known:
            self.standing.update((list(slots), list(slots.values()), timer_ms))
        else:
            self.standing.clear()
        if known:
            numbers, latest, due = zip(*known.values())
            self.memory.update((list(known), np.array(numbers, float).tobytes(), _longs(latest), _longs(due)))
        else:
            self.memory.clear()

    def _taken(self, slot: int, parts: int):
        """The rows of a slot (keys, and for each row a place among them, time, id and values), removed."""
        index, taken = {}, []
        for part in range(parts):
            keys, places, times, ids, held = self.waiting.getValue((slot, part))
            self.waiting.removeKey((slot, part))
            own = np.array([index.setdefault(k, len(index)) for k in keys], np.int64)
            taken.append((own[np.frombuffer(places, np.int64)], np.frombuffer(times, np.int64), np.frombuffer(ids, np.int64),
                          np.frombuffer(held, float).reshape(-1, len(self.values)) if self.values else np.zeros((len(times) // 8, 0))))
        return list(index), *(np.concatenate(x) for x in zip(*taken))

    def handleInputRows(self, key, rows, timerValues):
        slots, timer_ms = self._standing()
        for pdf in rows:
            times, ids = _micros(pdf[self.ts]), pdf[self.tie].to_numpy(np.int64)
            held = pdf[self.values].to_numpy(float).reshape(len(pdf), len(self.values))
            keys, own_slot = pdf[self.key].to_numpy(object), times // self.slot_us
            for slot in np.unique(own_slot).tolist():
                own, index = own_slot == slot, {}
                places = [index.setdefault(k if isinstance(k, str) else None, len(index)) for k in keys[own].tolist()]
                if slot not in slots:
                    self.handle.registerTimer(self._end_ms(slot * self.slot_us))
                part = slots.get(slot, 0)
                self.waiting.updateValue((slot, part), (list(index), _longs(places), _longs(times[own]), _longs(ids[own]), held[own].tobytes()))
                slots[slot] = part + 1
        self.standing.update((list(slots), list(slots.values()), timer_ms))
        return iter([])

    def _fold_slot(self, known: dict, slot: int, parts: int) -> list:
        keys, places, times, ids, held = self._taken(slot, parts)
        order = np.lexsort((ids, times, places))
        places, times, ids, held = places[order], times[order], ids[order], held[order]
        first, before, made = np.diff(places, prepend=-1) != 0, np.concatenate([times[:1], times[:-1]]), []
        for i in np.flatnonzero(first).tolist():
            own = known.setdefault(keys[places[i]], [list(self.start), None, NEVER])
            before[i] = times[i] if own[1] is None else own[1]
        cut = times - before > self.forget_us
        begins = np.flatnonzero(first | cut).tolist()
        for a, b in zip(begins, [*begins[1:], len(times)]):
            k = keys[places[a]]
            own = known[k]
            if cut[a]:  # silent for too long before this row
                if self.quiet is not None:
                    made.extend(self.quiet(k, own[0], int(times[a]))[1])
                own[0] = list(self.start)
            own[0], rows = self.fold(k, own[0], times[a:b], ids[a:b], held[a:b])
            made.extend(rows)
            own[1:] = int(times[b - 1]), -NEVER
        return made

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        fired_ms, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() * 1000
        slot = (fired_ms * 1000 - 1) // self.slot_us
        (slots, timer_ms), known = self._standing(), self._known()
        made = self._fold_slot(known, slot, slots.pop(slot)) if slot in slots else []
        now = min([mark, *[s * self.slot_us for s in slots]])
        for k, own in known.items():
            if own[2] <= now:  # also where rows were folded
                own[2] = NEVER
                if self.quiet is not None:
                    own[0], rows, due = self.quiet(k, own[0], now)
                    made.extend(rows)
                    own[2] = NEVER if due is None else int(due)
        known = {k: own for k, own in known.items() if own[1] + self.forget_us >= now}
        if known:  # one timer stands at a time, for the earlier of both needs
            wanted = min(max(own[1] for own in known.values()) + self.forget_us, *(own[2] for own in known.values()))
            wanted_ms = self._end_ms(max(wanted, mark))
            if timer_ms * 1000 <= mark or wanted_ms < timer_ms:
                timer_ms = wanted_ms
                self.handle.registerTimer(timer_ms)
        self._keep(slots, timer_ms, known)
        return iter([pd.DataFrame(made[k:k + FRAME], columns=self.names) for k in range(0, len(made), FRAME)])

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, values: list[str], out: str, start: list[float], fold: Callable, quiet: Callable | None = None,
             ts: str = "ts", tie: str = "id", forget_s: float = FORGET_S, slot_s: float = SLOT_S, buckets: int | None = None) -> DataFrame:
    """``fold(key, memory, times, ids, values)`` for every key's rows in order, some at a time,
    giving the new memory and rows out; ``values`` has a row of numbers for each.

    ``memory`` is a list of numbers that begins as ``start``.  ``quiet(key, memory, now)`` gives
    the new memory, rows out and the next time to ask, or None; all rows before ``now`` are
    folded by then.  Times are microseconds.  Rows leave ``slot_s`` late at most; longer slots
    mean fewer entries and timers.  Keys come as text and leave as the type that ``out`` names.
    A bucket's rows of a slot are folded in one task's memory: more ``buckets`` for larger streams.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    fields = StructType.fromDDL(out).fields
    processor = InOrder(key, values, [f.name for f in fields], start, fold, quiet, ts, tie, int(slot_s * US), int(forget_s * US))
    dealt = stream.withColumn(key, F.col(key).cast("string")).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets or BUCKETS)))
    made = StructType([StructField(f.name, StringType() if f.name == key else f.dataType) for f in fields])
    folded = dealt.groupBy("_bucket").transformWithStateInPandas(processor, made, "append", "EventTime")
    return folded.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def _stamp(us: float) -> pd.Timestamp:
    return pd.Timestamp(int(us), unit="us")


def cooldown(stream: DataFrame, key: str, key_type: str, seconds: float, ts: str = "ts", tie: str = "id", slot_s: float = SLOT_S) -> DataFrame:
    """Alerts that fire when each firing silences its key."""
    silence = max(int(seconds * US), 0)

    def fold(k, memory, times, ids, _):
        until, made = memory[0], []
        at = int(np.searchsorted(times, until))
        while at < len(times):  # from firing to firing
            made.append((k, ids[at], _stamp(times[at])))
            until = int(times[at]) + silence
            at = max(at + 1, int(np.searchsorted(times, until)))
        return [until], made

    return in_order(stream, key, [], f"{key} {key_type}, {tie} long, {ts} timestamp", [-float(2**62)], fold, ts=ts, tie=tie, forget_s=max(seconds, 1.0), slot_s=slot_s)


def escalation(stream: DataFrame, schedule_seconds: list[int], ts: str = "ts", slot_s: float = SLOT_S) -> DataFrame:
    """Alert events (alert_id, closes, ts): alerts that nothing closes emit level k at its cumulative delay.

    ``closes`` is 0 for the creation and 1 for an answer, which may come first.
    """
    due = (np.cumsum(schedule_seconds) * US).tolist()

    def reach(k, memory, limit):
        opened, level, made = memory[0], int(memory[1]), []
        while opened >= 0 and level < len(due) and opened + due[level] < limit:
            level += 1
            made.append((k, level, _stamp(opened + due[level - 1])))
        return [opened, level], made

    def fold(k, memory, times, _, values):
        made = []
        for at, closes in zip(times.tolist(), values[:, 0].tolist()):
            memory, reached = reach(k, memory, at)
            made += reached
            memory = [-1.0, 0.0] if closes else [float(at), 0.0]
        return memory, made

    def quiet(k, memory, now):
        memory, made = reach(k, memory, now)
        opened, level = memory[0], int(memory[1])
        return memory, made, opened + due[level] if opened >= 0 and level < len(due) else None

    return in_order(stream, "alert_id", ["closes"], "alert_id long, level int, due_ts timestamp", [-1.0, 0.0], fold, quiet, ts=ts, tie="closes", forget_s=sum(schedule_seconds), slot_s=slot_s)


def presence(stream: DataFrame, key: str, silence_seconds: float, ts: str = "ts", tie: str = "id", slot_s: float = SLOT_S) -> DataFrame:
    """ACTIVE at the first message, LOST after the silence, RECOVERED at the next message."""
    silence = int(silence_seconds * US)

    def fold(k, memory, times, *_):
        last, lost = memory
        made = [(k, "ACTIVE", _stamp(times[0]))] if last < 0 else []
        before = np.concatenate([[times[0] if last < 0 else int(last)], times[:-1]])
        breaks = times - before > silence
        if lost:
            breaks[0] = True
        for i in np.flatnonzero(breaks).tolist():
            if i or not lost:
                made.append((k, "LOST", _stamp(before[i] + silence)))
            made.append((k, "RECOVERED", _stamp(times[i])))
        return [times[-1], 0], made

    def quiet(k, memory, now):
        last, lost = memory
        if last < 0 or lost:
            return memory, [], None
        if last + silence < now:
            return [last, 1], [(k, "LOST", _stamp(last + silence))], None
        return memory, [], last + silence + 1000

    return in_order(stream, key, [], f"{key} string, state string, {ts} timestamp", [-1.0, 0.0], fold, quiet, ts=ts, tie=tie, slot_s=slot_s)


def kalman(stream: DataFrame, key: str, dt: float = 0.1, q: float = 0.1, r: float = 1.0, ts: str = "ts", tie: str = "id", slot_s: float = SLOT_S) -> DataFrame:
    """Constant-velocity smoothing of latitude and longitude, one small state per track."""
    f, noise = np.array([[1.0, dt], [0.0, 1.0]]), np.diag([q * dt**4 / 4, q * dt**2 / 2])

    def fold(k, memory, _, ids, values):
        begun, x, p, made = memory[0], np.array(memory[1:5]).reshape(2, 2), np.array(memory[5:]).reshape(2, 2), []
        for i, z in zip(ids.tolist(), values):
            if not begun:
                begun, x = 1.0, np.vstack([z, [0.0, 0.0]])
            else:
                x, p = f @ x, f @ p @ f.T + noise
                g = p[:, 0] / (p[0, 0] + r)
                x, p = x + np.outer(g, z - x[0]), p - np.outer(g, p[0])
            made.append((k, i, x[0, 0], x[0, 1]))
        return [begun, *x.ravel(), *p.ravel()], made

    start = [0.0] * 5 + [100.0, 0.0, 0.0, 100.0]
    return in_order(stream, key, ["latitude", "longitude"], f"{key} string, {tie} long, latitude double, longitude double", start, fold, ts=ts, tie=tie, slot_s=slot_s)


def noise_trigger(stream: DataFrame, key: str, key_type: str, value: str, margin: float = 10.0, weight: float = 0.05, initial: float | None = None, ts: str = "ts", tie: str = "id", slot_s: float = SLOT_S) -> DataFrame:
    """Running floor per key and the flag ``value > floor + margin``."""
    def fold(k, memory, _, ids, values):
        floor, floors, x = memory[0], [], values[:, 0]
        for v in x.tolist():
            floor = v if floor != floor else (1 - weight) * floor + weight * v
            floors.append(floor)
        return [floor], list(zip([k] * len(x), ids.tolist(), floors, (x > np.array(floors) + margin).tolist()))

    return in_order(stream, key, [value], f"{key} {key_type}, {tie} long, floor double, triggered boolean", [float("nan") if initial is None else initial], fold, ts=ts, tie=tie, slot_s=slot_s)


def duplicates(stream: DataFrame, key: str, window_s: float, ts: str = "ts", tie: str = "id", slot_s: float = SLOT_S) -> DataFrame:
    """Rows whose key was not seen within ``window_s`` before; every row renews the window."""
    width = int(window_s * US)

    def fold(k, memory, times, ids, _):
        before = np.concatenate([[memory[0]], times[:-1]])
        fresh = times - before > width
        return [times[-1]], [(k, i, _stamp(t)) for i, t in zip(ids[fresh].tolist(), times[fresh].tolist())]

    return in_order(stream, key, [], f"{key} string, {tie} long, {ts} timestamp", [-float(2**62)], fold, ts=ts, tie=tie, forget_s=max(window_s, 1.0), slot_s=slot_s)
