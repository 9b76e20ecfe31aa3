"""Prominence of peaks over signals of any length, by blocks of samples and blocks of blocks.

A peak looks to each side for the next strictly higher sample, and how low the signal gets before it. Its own block is
searched in one pass for all peaks; a side that finds nothing there goes on over the highest and lowest values of the blocks
around, then over those of the stretches of FAN blocks, and from where something higher is, back down to the samples.
So a side meets a few arrays of bounded length, and most sides none but their own block's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.thinning import _arrays, _regrouped

#: Blocks in a stretch; of stretches a session has one for each FAN blocks.
FAN = 1024


def lows(values: list[float]) -> tuple[list[float], list[bool]]:
    """For each value the least one from the last strictly higher value before it (or the start) on, and whether there is such a higher one."""
    low, found, open_ = [], [], []
    for v in values:
        least = v
        while open_ and open_[-1][0] <= v:
            least = min(least, open_.pop()[1])
        low.append(least)
        found.append(bool(open_))
        open_.append((v, least))
    return low, found


def _sides(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """idx, height, side (-1, 1), low, done: both sides of each block's peaks as far as the block tells."""
    for batch in batches:
        found = []
        for idx, value, peak, height in zip(*(_arrays(batch.column(c)) for c in ("at", "value", "idx", "height")), strict=True):
            place, n = np.searchsorted(idx, peak), len(idx)
            plain, parts = value.tolist(), []
            for side in (-1, 1):
                low, done = lows(plain if side < 0 else plain[::-1])
                own = place if side < 0 else n - 1 - place
                parts.append((peak, height, np.full(len(peak), side, np.int32), np.array(low)[own], np.array(done)[own]))
            found.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield _regrouped(batch, [*by, "_b"], found, ["idx", "height", "side", "low", "done"])


def _scan(array: str, place: str, high: str, low: str, near: Column | str | None = None) -> Column:
    """at, low: the first item of the array, walking away from the peak on its side, with a value over its height, and the least value up to there."""
    sided = f"if(side < 0, reverse(filter({array}, s -> s.{place} < {near})), filter({array}, s -> s.{place} > {near}))" if near else f"if(side < 0, reverse({array}), {array})"
    step = f"if(a.at is not null or x.{high} > height, named_struct('at', coalesce(a.at, x.{place}), 'low', a.low), named_struct('at', a.at, 'low', least(a.low, x.{low})))"
    return F.expr(f"if({array} is null, named_struct('at', cast(null as bigint), 'low', low), aggregate({sided}, named_struct('at', cast(null as bigint), 'low', low), (a, x) -> {step}))")


def with_prominence(peaks: DataFrame, signal: DataFrame, value: str = "value", by: list[str] | None = None, block: int = 4096, fan: int = FAN) -> DataFrame:
    """peaks with prominence: height over the higher of the least values to either side, as far as the next strictly higher sample.

    peaks: by, idx, height and any more; each stands at a sample of its signal, of that height.
    """
    by = by or ["session_id"]
    kinds = dict(peaks.dtypes)
    samples = signal.select(*by, F.col("idx").cast("long").alias("at"), F.col(value).cast("double").alias("v")).withColumn("_b", F.floor(F.col("at") / F.lit(block)))
    blocks = samples.groupBy(*by, "_b").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("_own"))  # a block's samples
    points = peaks.select(*by, F.col("idx").cast("long").alias("idx"), F.col("height").cast("double").alias("height")).withColumn("_b", F.floor(F.col("idx") / F.lit(block)))
    points = points.groupBy(*by, "_b").agg(F.array_sort(F.collect_list(F.struct("idx", "height"))).alias("_peaks"))  # a block's peaks
    met = points.join(blocks, [*by, "_b"]).select(*by, "_b", F.col("_own.at").alias("at"), F.col("_own.v").alias("value"), F.col("_peaks.idx").alias("idx"), F.col("_peaks.height").alias("height"))
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    sides = met.mapInArrow(lambda batches: _sides(batches, by), f"{keys}, _b long, idx long, height double, side int, low double, done boolean")

    summary = samples.groupBy(*by, "_b").agg(F.max("v").alias("h"), F.min("v").alias("l")).withColumn("_c", F.floor(F.col("_b") / F.lit(fan)))
    near = summary.groupBy(*by, "_c").agg(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("b"), "h", "l"))).alias("_near"))  # fan blocks
    far = summary.groupBy(*by, "_c").agg(F.max("h").alias("h"), F.min("l").alias("l"))
    far = far.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_c").alias("c"), "h", "l"))).alias("_far")).withColumn("_k", F.lit(0).cast("long"))  # one for each block * fan samples

    def looked_up(rows: DataFrame, arrays: DataFrame, key: str, wanted: Column) -> DataFrame:
        """rows with the array of the wanted key; those that want none have keys that nothing has, many, so that they don't meet in one task."""
        wanted = F.coalesce(wanted.cast("long"), -1 - F.pmod("idx", F.lit(997)))
        return rows.withColumn("_k", wanted).join(arrays.withColumnRenamed(key, "_k"), [*by, "_k"], "left").drop("_k")

    own = F.floor(F.col("_b") / F.lit(fan))
    rows = looked_up(sides, near, "_c", F.when(~F.col("done"), own)).withColumn("_f", _scan("_near", "b", "h", "l", "_b")).drop("_near")
    rows = rows.withColumns({"_at": F.col("_f.at"), "low": F.col("_f.low")})
    rows = looked_up(rows, far, "_k", F.when(~F.col("done") & F.col("_at").isNull(), F.lit(0))).withColumn("_c", own)
    rows = rows.withColumn("_f", _scan("_far", "c", "h", "l", "_c")).drop("_far", "_c").withColumns({"_there": F.col("_f.at"), "low": F.col("_f.low")})
    rows = looked_up(rows, near, "_c", F.col("_there")).withColumn("_f", _scan("_near", "b", "h", "l")).drop("_near")
    rows = rows.withColumns({"_at": F.coalesce("_at", "_f.at"), "low": F.col("_f.low")})
    rows = looked_up(rows, blocks.select(*by, "_b", "_own"), "_b", F.col("_at")).withColumn("low", _scan("_own", "at", "v", "v")["low"])
    found = rows.groupBy(*by, "idx").agg((F.first("height") - F.max("low")).alias("prominence")).withColumn("idx", F.col("idx").cast(kinds["idx"]))
    return peaks.withColumn("height", F.col("height").cast("double")).join(found, [*by, "idx"]).select(*peaks.columns, "prominence")
