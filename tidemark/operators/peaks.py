"""Peaks of signals, and the clean-up of event times.

Candidates are found by windows; choices that depend on earlier choices are made by blocks of a signal (distance, prominence)
or in a walk through an island's events (anchored merging, votes).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import islands
from tidemark.operators.prominence import with_prominence
from tidemark.operators.thinning import thinned
from tidemark.operators.walks import Walk, walked

BY = ["session_id"]


def local_maxima(signal: DataFrame, value: str = "value", by: list[str] = BY) -> DataFrame:
    """idx, height of samples above both neighbours; a plateau counts at its middle, rounded down; edges never."""
    order = Window.partitionBy(*by).orderBy("idx")
    # a row a run, its first, in the order that the rows are sorted in already
    rows = signal.select(*by, "idx", F.col(value).alias("height"), F.coalesce(F.col(value) != F.lag(value).over(order), F.lit(True)).alias("_begins"), F.lag("idx").over(order).alias("_before"))
    runs = rows.where("_begins").withColumns({"_lower": F.lag("height").over(order), "_higher": F.lead("height").over(order), "_last": F.lead("_before").over(order)})
    found = runs.where((F.col("height") > F.col("_lower")) & (F.col("height") > F.col("_higher")))
    return found.select(*by, F.floor((F.col("idx") + F.col("_last")) / 2).alias("idx"), "height")


def find_peaks(signal: DataFrame, height: float | str | None = None, distance: int | None = None, prominence: float | None = None, value: str = "value", by: list[str] = BY) -> DataFrame:
    """idx, height (and prominence): conditions in the order height, distance, prominence. height: a number or a column."""
    extra = [height] if isinstance(height, str) else []
    peaks = local_maxima(signal, value, by)
    if extra:
        levels = signal.groupBy(*by).agg(F.first(height).alias("_level"))
        peaks = peaks.join(levels, by).where("height >= _level").drop("_level")
    elif height is not None:
        peaks = peaks.where(F.col("height") >= height)
    if distance is not None and distance > 1:
        peaks = thinned(peaks, distance, by)
    if prominence is not None:
        peaks = with_prominence(peaks, signal, value, by).where(F.col("prominence") >= prominence)
    return peaks


def narrow(peaks: DataFrame, signal: DataFrame, threshold: float, longest: int, value: str = "value", by: list[str] = BY) -> DataFrame:
    """Peaks whose run of samples above half the threshold is no longer than `longest`; the peak's own sample counts as above."""
    marked = signal.join(peaks.select(*by, "idx", F.lit(True).alias("_is")), [*by, "idx"], "left")
    above = (F.col(value) > threshold / 2) | F.coalesce("_is", F.lit(False))
    order = Window.partitionBy(*by).orderBy("idx")
    marked = marked.withColumn("_above", above)
    runs = islands(marked, by, ["idx"], F.col("_above") != F.lag("_above").over(order), "run")
    sized = runs.withColumn("width", F.count("*").over(Window.partitionBy(*by, "run")))
    return sized.where("_is").where(F.col("width") <= longest).select(*by, "idx", F.col(value).alias("height"), "width")


DOUBLE = ("double", pa.float64())


def _by_island(events: DataFrame, values: dict[str, Column], walk: Walk, made: dict[str, tuple], by: list[str], time: str, gap: float, closed: bool = True) -> DataFrame:
    """A walk over events in order; after a pause of `gap` (closed: or more) it keeps nothing of what came before, so a session's islands are walked apart."""
    rows = events.select(*by, *[c.alias(name) for name, c in values.items()]).where(F.col(time).isNotNull())
    pause = F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(time))
    parts = islands(rows, by, [time], pause >= gap if closed else pause > gap, "_island")
    return walked(parts, [*by, "_island"], list(values), walk, made, by)


def keep_louder(peaks: DataFrame, gap: float, time: str = "time_s", loudness: str = "energy", by: list[str] = BY) -> DataFrame:
    """Peaks nearer than gap to the last kept one replace it if louder, else go; the anchor moves with the replacement."""

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = next(rows)
        for t, e in rows:
            if t - last[0] >= gap:
                yield last
                last = t, e
            elif e > last[1]:
                last = t, e
        yield last

    return _by_island(peaks, {time: F.col(time).cast("double"), loudness: F.col(loudness).cast("double")}, walk, {time: DOUBLE, loudness: DOUBLE}, by, time, gap)


def anchored_dedup(events: DataFrame, window: float, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """Times at least a window after the last kept one."""

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = float("-inf")
        for (t,) in rows:
            if t - last >= window:
                yield (t,)
                last = t

    return _by_island(events, {time: F.col(time).cast("double")}, walk, {time: DOUBLE}, by, time, window)


def vote_clusters(peaks: DataFrame, window: float, votes: int, min_gap: float, time: str = "time_s", roi: str = "roi", by: list[str] = BY) -> DataFrame:
    """Mean times of clusters (peaks within the window of a cluster's first) that at least `votes` regions share, and then min_gap apart."""

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        start, n, total, regions = None, 0, 0.0, set()
        for t, region in rows:
            if start is None or t - start > window:
                if len(regions) >= votes and n:
                    yield (total / n,)
                start, n, total, regions = t, 0, 0.0, set()
            n, total = n + 1, total + t
            regions.add(region)
        if len(regions) >= votes:
            yield (total / n,)

    clusters = _by_island(peaks, {time: F.col(time).cast("double"), roi: F.col(roi).cast("string")}, walk, {time: DOUBLE}, by, time, window, closed=False)
    return anchored_dedup(clusters, min_gap, time, by)


def audio_peaks(energy: DataFrame, percent: float = 98.7, distance: int = 20, merge_gap: float = 0.12, by: list[str] = BY) -> DataFrame:
    """time_s, energy, confidence: peaks of at least the session's percentile, thinned, merged; confidence over that threshold."""
    from tidemark.operators.signals import percentile_threshold

    level = percentile_threshold(energy, percent, "energy", by)
    peaks = find_peaks(energy.join(level, by), "threshold", distance, value="energy", by=by)
    timed = peaks.join(energy.select(*by, "idx", "time_s"), [*by, "idx"]).select(*by, "time_s", F.col("height").alias("energy"))
    return keep_louder(timed, merge_gap, by=by).join(level, by).withColumn("confidence", F.col("energy") / F.col("threshold"))


def session_type(energy: DataFrame, presets: dict[str, float], expected: int = 100, closer: int = 5, many: int = 115, distance: int = 20, merge_gap: float = 0.12, by: list[str] = BY) -> DataFrame:
    """kind, n_tap, n_spray: which of two percentile presets gives a count near the expected; if neither is much nearer, many peaks are spray."""
    counts = energy.select(*by).distinct()
    for name in ("tap", "spray"):
        n = audio_peaks(energy, presets[name], distance, merge_gap, by).groupBy(*by).agg(F.count("*").alias(f"n_{name}"))
        counts = counts.join(n, by, "left")
    counts = counts.na.fill(0, ["n_tap", "n_spray"])
    tap, spray = F.abs(F.col("n_tap") - expected), F.abs(F.col("n_spray") - expected)
    kind = F.when(tap < spray - closer, "tap").when(spray < tap - closer, "spray").when(F.col("n_tap") > many, "spray").otherwise("tap")
    return counts.withColumn("kind", kind)


def rejected(raw: DataFrame, accepted: DataFrame, by: list[str] = BY) -> DataFrame:
    """Raw peaks that are not among the accepted ones."""
    return raw.join(accepted.select(*by, "idx"), [*by, "idx"], "left_anti")
