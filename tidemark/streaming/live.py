"""Single-pass operators with bounded state, as Structured Streaming.

Keyed state holds a few scalars a session. Rows of a session that arrive in one
micro-batch are put in time order; across batches they are taken to arrive in order, as a recording's do. live_in_order() makes no such
assumption, and drops the state of sessions that have ended.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.shared import shared_dir


def _together(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(order, kind="stable")


def live_dedup(events: DataFrame, window: float, time: str = "time_s", key: str = "session_id") -> DataFrame:
    """Times at least a window after the last kept one of their session; the state is that time."""
    kind = dict(events.dtypes)[key]

    def each(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in _together(parts, [time])[time].astype(float):
            if last is None or t - last >= window:
                kept.append(t)
                last = t
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), time: kept})

    return events.select(key, F.col(time).cast("double").alias(time)).groupBy(key).applyInPandasWithState(each, f"{key} {kind}, {time} double", "last double", "append", GroupStateTimeout.NoTimeout)


def live_transitions(frames: DataFrame, confirm: int = 2, none_run: int = 8, back: float = 0.0, time: str = "time_s", label: str = "label", key: str = "session_id") -> DataFrame:
    """Confirmed changes of a nullable label, one row a change: time, from_count, to_count; the state is the automaton's four numbers."""
    kind = dict(frames.dtypes)[key]

    def each(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        confirmed, candidate, run, nones = state.get if state.exists else (None, None, 0, 0)
        made = []
        for t, x in _together(parts, [time])[[time, label]].itertuples(index=False):
            if pd.isna(x):
                nones += 1
                if nones >= none_run:
                    candidate, run = None, 0
                continue
            x, nones = int(x), 0
            if confirmed is None:
                confirmed = x
            elif x == confirmed:
                candidate, run = None, 0
            else:
                run = run + 1 if x == candidate else 1
                candidate = x
                if run >= confirm:
                    made.append((k[0], round(t - back, 4), confirmed, x))
                    confirmed, candidate, run = x, None, 0
        state.update((confirmed, candidate, run, nones))
        yield pd.DataFrame(made, columns=[key, time, "from_count", "to_count"])

    rows = frames.select(key, F.col(time).cast("double").alias(time), F.col(label).cast("double").alias(label))
    schema = f"{key} {kind}, {time} double, from_count int, to_count int"
    return rows.groupBy(key).applyInPandasWithState(each, schema, "confirmed int, candidate int, run int, nones int", "append", GroupStateTimeout.NoTimeout)


def live_delta(signal: DataFrame, time: str = "time_s", value: str = "value", key: str = "session_id") -> DataFrame:
    """Difference of each value to the one before; the state is that value."""
    kind = dict(signal.dtypes)[key]

    def each(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _together(parts, [time])
        before = rows[value].shift(1)
        if state.exists and len(rows):
            before.iloc[0] = state.get[0]
        state.update((float(rows[value].iloc[-1]),))
        yield pd.DataFrame({key: [k[0]] * len(rows), time: rows[time].to_numpy(), "delta": (rows[value] - before.fillna(rows[value])).to_numpy()})

    rows = signal.select(key, F.col(time).cast("double").alias(time), F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(each, f"{key} {kind}, {time} double, delta double", "last double", "append", GroupStateTimeout.NoTimeout)


def live_energy(samples: DataFrame, length: str = "10 milliseconds", hop: str = "5 milliseconds", late: str = "1 second", ts: str = "ts", value: str = "value", key: str = "session_id") -> DataFrame:
    """Root mean square over sliding event-time windows; windows close once the watermark has passed them."""
    windows = samples.withWatermark(ts, late).groupBy(key, F.window(ts, length, hop).alias("w"))
    return windows.agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("energy"), F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "energy", "n")


def live_fusion(kills: DataFrame, shots: DataFrame, within: str = "500 milliseconds", late: str = "10 seconds", key: str = "session_id") -> DataFrame:
    """Pairs of a kill and each shot of its session in the time before it: an interval join of two streams with watermarks.

    Each shot is given as it comes; which of a kill's shots is the last is known only once the watermark has passed the kill.
    """
    k = kills.select(F.col(key), F.col("ts").alias("kill_ts")).withWatermark("kill_ts", late)
    s = shots.select(F.col(key).alias("_key"), F.col("ts").alias("shot_ts")).withWatermark("shot_ts", late)
    near = F.expr(f"{key} = _key and shot_ts <= kill_ts and shot_ts >= kill_ts - interval {within}")
    return k.join(s, near).drop("_key")


def live_last_shot(kills: DataFrame, shots: DataFrame, within: str = "500 milliseconds", late: str = "10 seconds", key: str = "session_id") -> DataFrame:
    """kill_ts, fused_ts: each kill with the last shot of its session in the time before it, or with its own time where there is none.

    An outer interval join and a count of what it gives, each kept until the watermark has passed the kill; so a row comes once, and is final.
    """
    k = kills.select(F.col(key), F.col("ts").alias("kill_ts")).withWatermark("kill_ts", late)
    s = shots.select(F.col(key).alias("_key"), F.col("ts").alias("shot_ts")).withWatermark("shot_ts", late)
    near = F.expr(f"{key} = _key and shot_ts <= kill_ts and shot_ts >= kill_ts - interval {within}")
    last = k.join(s, near, "leftOuter").groupBy(key, "kill_ts").agg(F.max("shot_ts").alias("_shot"))
    return last.select(key, "kill_ts", F.coalesce("_shot", "kill_ts").alias("fused_ts"))


def live_patch_delta(frames: DataFrame, time: str = "time_s", patch: str = "patch", key: str = "session_id") -> DataFrame:
    """delta: mean absolute difference of each patch to the one before; null for the first, and where their sizes differ. The state is that patch."""
    kind = dict(frames.dtypes)[key]

    def each(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _together(parts, [time])
        before = np.asarray(state.get[0], float) if state.exists else None
        made = []
        for now in map(lambda x: np.asarray(x, float), rows[patch]):
            made.append(float(np.abs(now - before).mean()) if before is not None and len(before) == len(now) and len(now) else None)
            before = now
        state.update((before.tolist(),))
        yield pd.DataFrame({key: [k[0]] * len(rows), time: rows[time].to_numpy(), "delta": pd.array(made, "Float64")})

    rows = frames.where(F.col(patch).isNotNull()).select(key, F.col(time).cast("double").alias(time), F.col(patch).cast("array<double>").alias(patch))
    return rows.groupBy(key).applyInPandasWithState(each, f"{key} {kind}, {time} double, delta double", "last array<double>", "append", GroupStateTimeout.NoTimeout)


NONE = float("nan")


class Dedup:
    """Times at least a window after the last kept one."""

    schema, start = "", (NONE,)

    def __init__(self, window: float):
        self.window = window

    def step(self, state: tuple, t: float, _: float) -> tuple[tuple, list[tuple]]:
        if not t - state[0] < self.window:  # nothing kept yet: no number
            return (t,), [(t,)]
        return state, []


class Delta:
    """Difference of each value to the one before; 0 for the first."""

    schema, start = ", delta double", (NONE,)

    def step(self, state: tuple, t: float, x: float) -> tuple[tuple, list[tuple]]:
        return (x,), [(t, x - state[0] if state[0] == state[0] else 0.0)]


class Transitions:
    """Confirmed changes of a nullable label."""

    schema, start = ", from_count int, to_count int", (NONE, NONE, 0.0, 0.0)

    def __init__(self, confirm: int = 2, none_run: int = 8):
        self.confirm, self.none_run = confirm, none_run

    def step(self, state: tuple, t: float, x: float) -> tuple[tuple, list[tuple]]:
        confirmed, candidate, run, nones = state
        if x != x:
            gone = nones + 1 >= self.none_run
            return (confirmed, NONE if gone else candidate, 0.0 if gone else run, nones + 1), []
        if confirmed != confirmed:
            return (x, candidate, run, 0.0), []
        if x == confirmed:
            return (confirmed, NONE, 0.0, 0.0), []
        run = run + 1 if x == candidate else 1.0
        if run >= self.confirm:
            return (x, NONE, 0.0, 0.0), [(t, int(confirmed), int(x))]
        return (confirmed, x, run, 0.0), []


def live_in_order(rows: DataFrame, walk: Dedup | Delta | Transitions, late: str, idle: float, value: str | None = None, ts: str = "ts", key: str = "session_id") -> DataFrame:
    """time_s and what the walk makes of each session's rows in time order, however late they come within the watermark's delay.

    Rows wait in the state until the watermark has passed them; later ones Spark drops. A timer wakes a session when its first waiting row is
    due, and drops its state once nothing has come for `idle` seconds beyond the watermark. So the state holds the delay's rows and a few numbers for
    sessions that are alive, and nothing for the others.
    """
    kind = dict(rows.dtypes)[key]

    def each(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, times, values, last = state.get if state.exists else (list(walk.start), [], [], -math.inf)
        waiting = list(zip(times, values, strict=True))
        if not state.hasTimedOut:
            for part in parts:
                waiting += zip(part["_t"].tolist(), part["_v"].tolist(), strict=True)
        waiting.sort(key=lambda x: x[0])
        passed = state.getCurrentWatermarkMs()
        due = bisect_right(waiting, passed / 1000, key=lambda x: x[0])
        now, made = tuple(known), []
        for t, x in waiting[:due]:
            now, found = walk.step(now, t, x)
            made += [(k[0], *row) for row in found]
            last = max(last, t)
        rest = waiting[due:]
        if not rest and passed >= (last + idle) * 1000:
            state.remove()
        else:
            state.update((list(now), [t for t, _ in rest], [x for _, x in rest], last))
            state.setTimeoutTimestamp(max(passed + 1, math.ceil(rest[0][0] * 1000) if rest else math.ceil((last + idle) * 1000)))
        yield pd.DataFrame(made, columns=names)

    names = [key, "time_s", *[x.split()[0] for x in walk.schema.split(", ")[1:]]]
    timed = rows.withWatermark(ts, late).select(key, ts, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t"), (F.col(value) if value else F.lit(None)).cast("double").alias("_v"))
    return timed.groupBy(key).applyInPandasWithState(each, f"{key} {kind}, time_s double{walk.schema}", "known array<double>, times array<double>, waiting array<double>, last double", "append", GroupStateTimeout.EventTimeTimeout)


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of part files.

    The name is given as a pattern that it alone meets: a streamed path that is none must be a folder.
    """
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that its source has now, into Parquet in the shared folder, and reads that."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
