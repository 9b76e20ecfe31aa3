"""Thinning of peaks by distance, tallest first, over blocks of a signal that may be of any length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Peaks by what is known of them.
OPEN, KEPT, GONE = 0, 1, 2


def decided(idx: np.ndarray, height: np.ndarray, kept: np.ndarray, distance: int, low: float = -np.inf, high: float = np.inf) -> np.ndarray:
    """What becomes of peaks (places ascending) between low and high, some of them known as kept, if lower ones go first, of equals the earlier.

    The tallest comes first. One nearer than the distance to a kept one goes; one nearer to an edge, or to a taller one that is
    open itself, is open; else it is kept. A stretch as long as the distance holds one kept peak at most,
    and of its open ones the first and last tell, so a peak costs a few looks.
    """
    state = np.where(kept, KEPT, OPEN)
    places = idx.tolist()
    kept_in = {places[i] // distance: places[i] for i in np.flatnonzero(kept).tolist()}
    open_in: dict[int, list[int]] = {}
    for i in np.lexsort((-idx, -height)).tolist():
        if state[i] == KEPT:
            continue
        at = places[i]
        b = at // distance
        if any(abs(kept_in[c] - at) < distance for c in (b - 1, b, b + 1) if c in kept_in):
            state[i] = GONE
        elif (
            at - low < distance
            or high - at <= distance
            or b in open_in
            or b - 1 in open_in
            and at - open_in[b - 1][1] < distance
            or b + 1 in open_in
            and open_in[b + 1][0] - at < distance
        ):
            first = open_in.setdefault(b, [at, at])
            first[:] = min(first[0], at), max(first[1], at)
        else:
            state[i], kept_in[b] = KEPT, at
    return state


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))


def _regrouped(batch: pa.RecordBatch, keys: list[str], found: list[tuple], names: list[str]) -> pa.RecordBatch:
    """The rows found for each row of the batch, beside its keys."""
    row = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
    columns = [batch.column(k).take(row) for k in keys] + [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [*keys, *names])


def thinned(peaks: DataFrame, distance: int, by: list[str], block: int | None = None) -> DataFrame:
    """idx, height of peaks so that none is nearer than `distance` to another: lower ones go first, of equals the earlier.

    A signal is taken in blocks of samples, with a margin of further peaks to both sides. Most peaks of a block are decided
    there: what hangs on a chain of peaks that leaves the margin stays open. Then each session's open peaks are decided
    together, with the kept ones near the blocks' edges: one in thousands, but for signals that rise
    or fall peak by peak for longer than a block, whose peaks are then one group (an index and a height each, in time about linear).
    """
    block = block or max(1 << 16, 64 * distance)
    margin = 8 * distance
    width, kinds = F.lit(block), dict(peaks.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    schema = f"{keys}, _block long, idx long, height double, _state int"

    rows = peaks.select(*by, F.col("idx").cast("long").alias("idx"), F.col("height").cast("double").alias("height"))
    around = F.sequence(F.floor((F.col("idx") - margin) / width), F.floor((F.col("idx") + margin) / width))
    spread = rows.withColumn("_block", F.explode(around))
    first = spread.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(F.struct("idx", "height"))).alias("_all"))  # of one block and its margins
    first = first.select(*by, "_block", F.col("_all.idx").alias("idx"), F.col("_all.height").alias("height"))

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for b, idx, height in zip(batch.column("_block").to_pylist(), *(_arrays(batch.column(c)) for c in ("idx", "height")), strict=True):
                start, end = b * block, (b + 1) * block
                state = decided(idx, height, np.zeros(len(idx), bool), distance, start - margin - 1, end + margin)
                own = (idx >= start) & (idx < end) & (state != GONE)
                found.append((idx[own], height[own], state[own].astype(np.int32)))
            yield _regrouped(batch, [*by, "_block"], found, ["idx", "height", "_state"])

    met = first.mapInArrow(by_block, schema)
    # what is open, and what is kept so near an edge that it may stand against something open beyond, meets in one group; the rest passes by in its block's
    inside = F.col("idx") - F.col("_block") * width
    together = (F.col("_state") == OPEN) | (inside < distance) | (inside >= block - distance)
    second = met.groupBy(*by, F.when(~together, F.col("_block")).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("idx", "height", "_state"))).alias("_all"))
    second = second.select(*by, "_block", *[F.col(f"_all.{c}").alias(c) for c in ("idx", "height", "_state")])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for idx, height, state in zip(*(_arrays(batch.column(c)) for c in ("idx", "height", "_state")), strict=True):
                kept = state == KEPT
                if not kept.all():
                    kept = decided(idx, height, kept, distance) == KEPT
                found.append((idx[kept], height[kept]))
            yield _regrouped(batch, by, found, ["idx", "height"])

    return second.mapInArrow(whole, f"{keys}, idx long, height double").select(*by, F.col("idx").cast(kinds["idx"]).alias("idx"), F.col("height").cast(kinds["height"]).alias("height"))
