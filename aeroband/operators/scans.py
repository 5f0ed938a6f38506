"""Sequential per-key recurrences over keys of any size.

A recurrence is cut into time slices.  Pass one reduces every ``(key, slice)`` to a small
summary of its effect on the state, pass two chains the summaries of a key (as many as
there are slices), pass three replays each slice from its known entry state.  A hot key
is therefore spread over its slices instead of being sorted and folded in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from aeroband.functions.timing import epoch_us
from aeroband.operators.ordered import SEG, time_slice


def _field(df: DataFrame, name: str) -> T.StructField:
    return next(f for f in df.schema.fields if f.name == name)


def _whole_groups(batches, names: list[str]):
    """Batches cut so that none splits a group, with the group bounds of each.

    Input is sorted by the group columns; the open last group waits for the next batch.
    """
    pieces: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        keys = pdf[names]
        starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
        continues = bool(pieces) and tuple(pieces[0][names].iloc[0]) == tuple(keys.iloc[0])
        if continues and len(starts) == 1:
            pieces.append(pdf)
            continue
        cut = starts[-1]
        if cut or pieces:
            ready = pd.concat([*pieces, pdf.iloc[:cut]], ignore_index=True)
            if len(ready):
                k = ready[names]
                yield ready, np.flatnonzero((k != k.shift()).any(axis=1).to_numpy())
        pieces = [pdf.iloc[cut:]]
    if pieces:
        yield pd.concat(pieces, ignore_index=True), np.array([0])


def _scan(df: DataFrame, keys: list[str], order: list[str], segment: Column, needs: list[str], summary_fields, summarise, entry_fields, chain,
          output_fields, emit) -> DataFrame:
    """``summarise(columns)`` → summary values; ``chain(state, *summary)`` → a slice's entry state and the
    next slice's state, from None on; ``emit(columns, state)`` → (row mask or None, new columns).  Columns are NumPy arrays of ``needs``."""
    key_fields = [_field(df, k) for k in keys]
    seg_field = T.StructField(SEG, T.LongType())
    group = [*keys, SEG]
    work = df.withColumn(SEG, segment.cast("long"))
    summary_names, entry_names, new_names = ([f.name for f in fs] for fs in (summary_fields, entry_fields, output_fields))

    def summaries_of(batches):
        for pdf, starts in _whole_groups(batches, group):
            cols = {c: pdf[c].to_numpy() for c in {*needs, SEG}}
            rows = [summarise({c: a[lo:hi] for c, a in cols.items()}) for lo, hi in zip(starts, [*starts[1:], len(pdf)])]
            out = pdf[group].iloc[starts].reset_index(drop=True)
            for k, name in enumerate(summary_names):
                out[name] = [r[k] for r in rows]
            yield out

    summaries = work.select(*dict.fromkeys([*group, *order, *needs])).repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(
        summaries_of, T.StructType([*key_fields, seg_field, *summary_fields]))

    def entries_of(batches):
        held, state = None, None
        for pdf in batches:
            out, states = pdf[group].copy(), []
            for key, row in zip(pdf[keys].itertuples(index=False, name=None), pdf[summary_names].itertuples(index=False, name=None)):
                if held != key:
                    held, state = key, None
                entry, state = chain(state, *row)
                states.append(entry)
            for k, name in enumerate(entry_names):
                out[name] = [s[k] for s in states]
            yield out

    entries = summaries.repartition(*keys).sortWithinPartitions(*group).mapInPandas(
        entries_of, T.StructType([*key_fields, seg_field, *entry_fields]))

    # Rows and entry states meet in one exchange: the state sorts first in its group.
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in entry_fields]
    both = work.select("*", *nothing, F.lit(1).alias("_data")).unionByName(
        entries.withColumn("_data", F.lit(0)), allowMissingColumns=True)
    fields = [*df.schema.fields, *output_fields]
    keep = [f.name for f in fields]

    def replayed(batches):
        for pdf, starts in _whole_groups(batches, group):
            cols = {c: pdf[c].to_numpy() for c in {*needs, SEG}}
            state_cols = [pdf[n].to_numpy() for n in entry_names]
            picked, new = [], {n: [] for n in new_names}
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                mask, values = emit({c: a[lo + 1:hi] for c, a in cols.items()}, [s[lo] for s in state_cols])
                at = np.arange(lo + 1, hi)
                picked.append(at if mask is None else at[mask])
                for n in new_names:
                    new[n].append(values[n])
            out = pdf.iloc[np.concatenate(picked)].reset_index(drop=True)
            for n in new_names:
                out[n] = np.concatenate(new[n])
            yield out[keep]

    return both.repartition(*group).sortWithinPartitions(*group, "_data", *order).mapInPandas(replayed, T.StructType(fields))


def _double(name):
    return T.StructField(name, T.DoubleType())


def exponential_mean(df: DataFrame, keys, ts: str, tie: str, value: str, weight: float = 0.05,
                     slice_seconds: int = 3600, name: str = "ema") -> DataFrame:
    """``(1-w)·previous + w·value`` per key; the first value starts the mean."""
    keys, keep = list(keys), 1 - weight

    def fold(values, state):
        out = np.empty(len(values))
        for i, x in enumerate(values.tolist()):
            state = keep * state + weight * x
            out[i] = state
        return out

    def summarise(cols):
        x = cols[value]
        return len(x), float(x[0]), float(fold(x, 0.0)[-1])

    def chain(state, n, first, local):
        state = first if state is None else state
        return (float(state),), keep**int(n) * state + local

    def emit(cols, entry):
        return None, {name: fold(cols[value], entry[0])}

    return _scan(df, keys, [ts, tie], time_slice(ts, slice_seconds), [value], [T.StructField("n", T.LongType()), _double("first"), _double("local")],
                 summarise, [_double("_entry")], chain, [_double(name)], emit)


def cooldown(df: DataFrame, keys, ts: str, tie: str, seconds: str, slice_seconds: int = 3600) -> DataFrame:
    """Rows that fire when each firing silences its key for the row's ``seconds`` (constant per key).

    A slice is summarised as a step function from the entry silence end to the exit one, a
    point for each step; only rows within one cooldown of the slice start can be the first to
    fire in it, and firings that meet later share a step.  The functions are applied one after
    another as they stream by, never gathered per key.
    """
    keys = list(keys)
    work = df.withColumn("_us", epoch_us(ts))
    width = slice_seconds * 1_000_000

    def micros(cols):
        return cols["_us"].astype(np.int64), int(round(float(cols[seconds][0]) * 1_000_000))

    def summarise(cols):
        t, c = micros(cols)
        nxt = np.searchsorted(t, t + max(c, 1), side="left")
        exits = t + c
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                exits[i] = exits[nxt[i]]
        start = int(cols[SEG][0]) * width
        cut = min(int(np.searchsorted(t, start + c, side="left")) + 1, len(t))
        step = np.append(exits[1:cut] != exits[:cut - 1], True)  # the last time of each step stands for it
        return t[:cut][step].tolist(), exits[:cut][step].tolist()

    def chain(state, times, exits):
        state = -(2**62) if state is None else state
        at = int(np.searchsorted(np.asarray(times, dtype=np.int64), state, side="left"))
        return (int(state),), int(exits[at]) if at < len(times) else state

    def emit(cols, entry):
        t, c = micros(cols)
        fired = np.zeros(len(t), bool)
        i = int(np.searchsorted(t, int(entry[0]), side="left"))
        while i < len(t):
            fired[i] = True
            i = int(np.searchsorted(t, t[i] + max(c, 1), side="left"))
        return fired, {}

    long_list = T.ArrayType(T.LongType())
    out = _scan(work, keys, ["_us", tie], F.floor(F.col("_us") / F.lit(width)), ["_us", seconds],
                [T.StructField("times", long_list), T.StructField("exits", long_list)],
                summarise, [T.StructField("_until", T.LongType())], chain, [], emit)
    return out.drop("_us")


class KalmanGains:
    """Position and velocity gain of the k-th update; identical for every axis and key.

    The covariance is carried on as far as asked for, until it repeats to the bit.
    """

    def __init__(self, dt: float, q: float, r: float, initial: float = 100.0):
        self.p, self.r, self.known, self.settled = np.eye(2) * initial, r, [], False
        self.f = np.array([[1.0, dt], [0.0, 1.0]])
        self.noise = np.diag([q * dt**4 / 4, q * dt**2 / 2])

    def __call__(self, k: int) -> np.ndarray:
        while k >= len(self.known) and not self.settled:
            p = self.f @ self.p @ self.f.T + self.noise
            g = p[:, 0] / (p[0, 0] + self.r)
            after = p - np.outer(g, p[0])
            self.settled = bool((after == self.p).all())
            self.p = after
            self.known.append(g)
        return self.known[min(k, len(self.known) - 1)]


def kalman_smooth(df: DataFrame, keys, ts: str, tie: str, axes: list[str], dt: float = 0.1, q: float = 0.1, r: float = 1.0,
                  slice_seconds: int = 3600) -> DataFrame:
    """Constant-velocity filter per axis; the first fix of a key starts it at rest.

    The gains depend only on the number of updates, so a slice acts on (position,
    velocity) as one 2x2 matrix and an offset per axis, which chain exactly.
    """
    from aeroband.operators.ordered import _along
    from pyspark.sql import Window

    keys = list(keys)
    seg = time_slice(ts, slice_seconds)
    work = df.withColumn(SEG, seg)
    counts = work.groupBy(*keys, SEG).agg(F.count("*").alias("_m"))
    before = _along(keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, SEG, F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_k0"))
    indexed = work.join(starts, [*keys, SEG]).drop(SEG)

    gain = KalmanGains(dt, q, r)

    def advance(state, z, k):
        px, v = state[0] + dt * state[1], state[1]
        g = gain(k)
        e = z - px
        return np.array([px + g[0] * e, v + g[1] * e])

    def summarise(cols):
        k0 = int(cols["_k0"][0])
        zs = np.column_stack([cols[x].astype(float) for x in axes])
        a, b, begin = np.eye(2), np.zeros((2, len(axes))), 0
        if k0 == 0:
            a, b, begin = np.zeros((2, 2)), np.vstack([zs[0], np.zeros(len(axes))]), 1
        for i in range(begin, len(zs)):
            g = gain(k0 + i - 1)
            m = np.array([[1 - g[0], (1 - g[0]) * dt], [-g[1], 1 - g[1] * dt]])
            a, b = m @ a, m @ b + np.outer(g, zs[i])
        return a.ravel().tolist(), b.ravel().tolist()

    def chain(state, a, b):
        state = np.zeros((2, len(axes))) if state is None else state
        return (state.ravel().tolist(),), np.asarray(a).reshape(2, 2) @ state + np.asarray(b).reshape(2, -1)

    def emit(cols, entry):
        k0 = int(cols["_k0"][0])
        zs = np.column_stack([cols[x].astype(float) for x in axes])
        state = np.asarray(entry[0], float).reshape(2, -1)
        out = np.empty_like(zs)
        for i, z in enumerate(zs):
            state = np.vstack([z, np.zeros(len(axes))]) if k0 + i == 0 else advance(state, z, k0 + i - 1)
            out[i] = state[0]
        return None, {f"{axis}_smooth": out[:, j] for j, axis in enumerate(axes)}

    doubles = T.ArrayType(T.DoubleType())
    out = _scan(indexed, keys, [ts, tie], seg, ["_k0", *axes], [T.StructField("a", doubles), T.StructField("b", doubles)], summarise,
                [T.StructField("_state", doubles)], chain, [_double(f"{a}_smooth") for a in axes], emit)
    return out.drop("_k0")
