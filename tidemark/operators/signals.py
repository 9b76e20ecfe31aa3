"""Operators on sampled signals (session_id, idx, time_s, value): differences, smoothing, filling, energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import WIDTH, by_blocks, carried

BY = ["session_id"]


def _order(by: list[str], order: str) -> object:
    return Window.partitionBy(*by).orderBy(order)


def first_difference(value: str = "value", by: list[str] = BY, order: str = "idx") -> Column:
    """Difference to the sample before; 0 for the first."""
    return F.col(value) - F.coalesce(F.lag(value).over(_order(by, order)), F.col(value))


def rises(value: str = "value", by: list[str] = BY, order: str = "idx") -> Column:
    """First difference, falls as 0."""
    return F.greatest(first_difference(value, by, order), F.lit(0.0))


def boxcar(width: int, value: str = "value", by: list[str] = BY, order: str = "idx") -> Column:
    """Centred moving sum over width, divided by width at the edges too; an even width reaches one further back."""
    back, ahead = width // 2, (width - 1) // 2
    return F.sum(value).over(_order(by, order).rowsBetween(-back, ahead)) / width


def median3(value: str = "value", by: list[str] = BY, order: str = "idx") -> Column:
    """Median of a sample and its neighbours; end samples stay."""
    w = _order(by, order)
    a, b, c = F.coalesce(F.lag(value).over(w), F.col(value)), F.col(value), F.coalesce(F.lead(value).over(w), F.col(value))
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def filled(value: str = "value", default: object = None, by: list[str] = BY, order: str = "idx") -> Column:
    """Nulls take the last value before, or else the first after, or else the default."""
    w = _order(by, order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(before, after, F.lit(default)) if default is not None else F.coalesce(before, after)


def differenced(signal: DataFrame, value: str = "value", by: list[str] = BY, order: str = "idx", width: float = WIDTH) -> DataFrame:
    """difference to the sample before (0 for the first), and rise (falls as 0), by blocks of a signal."""
    made = {"difference": lambda keys: first_difference(value, keys, order), "rise": lambda keys: rises(value, keys, order)}
    return by_blocks(signal, made, 1, 0, by, order, width)


def enveloped(signal: DataFrame, widths: dict[str, int], value: str = "value", by: list[str] = BY, order: str = "idx", width: float = WIDTH) -> DataFrame:
    """Centred moving means, by name and width of the mean, by blocks of a signal."""
    made = {name: lambda keys, n=n: boxcar(n, value, keys, order) for name, n in widths.items()}
    most = max(widths.values())
    return by_blocks(signal, made, most // 2, (most - 1) // 2 if len(widths) == 1 else most // 2, by, order, width)


def smoothed(signal: DataFrame, value: str = "value", by: list[str] = BY, order: str = "idx", width: float = WIDTH) -> DataFrame:
    """smooth: the median of a sample and its neighbours, by blocks of a signal."""
    return by_blocks(signal, {"smooth": lambda keys: median3(value, keys, order)}, 1, 1, by, order, width)


def without_gaps(signal: DataFrame, value: str = "value", default: object = None, by: list[str] = BY, order: str = "idx", width: float = WIDTH) -> DataFrame:
    """The signal, nulls of the value filled from before, or else from after, or else the default; by blocks, each carrying its last value on."""
    met = carried(carried(signal, {"_filled": F.col(value)}, by, [order], width), {"_later": F.col(value)}, by, [order], width, descending=True)
    return met.withColumn(value, F.coalesce("_filled", "_later", F.lit(default))).drop("_filled", "_later")


def rms_energy(chunks: DataFrame, samples: str = "samples", rate: int = 44100, window_ms: float = 10, hop_ms: float = 5, keep: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """frame, time_s, energy of each sample array: root mean square of windows that hop along; the last that would fit is left out."""
    width, hop = int(rate * window_ms / 1000), int(rate * hop_ms / 1000)
    frames = F.floor((F.size(samples) - width) / F.lit(hop)).cast("int")
    each = chunks.where(frames > 0).select(*keep, samples, F.explode(F.sequence(F.lit(0), frames - 1)).alias("frame"))
    window = F.slice(F.col(samples), F.col("frame") * hop + 1, width)
    energy = F.sqrt(F.aggregate(window, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / width)
    return each.select(*keep, "frame", (F.col("frame") * hop / F.lit(float(rate))).alias("time_s"), energy.alias("energy"))


def frame_delta(frames: DataFrame, patch: str = "patch", order: str = "idx", by: list[str] = BY, width: float = WIDTH) -> DataFrame:
    """delta: mean absolute difference of a frame's values to those of the frame before; null for the first. By blocks of frames."""

    def delta(keys: list[str]) -> Column:
        before = F.lag(patch).over(_order(keys, order))
        difference = F.zip_with(F.col(patch), before, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
        return F.when(before.isNotNull(), F.aggregate(difference, F.lit(0.0), lambda a, x: a + x) / F.size(patch))

    return by_blocks(frames, {"delta": delta}, 1, 0, by, order, width)


def crop(patch: Column, width: int, top: int, bottom: int, left: int, right: int) -> Column:
    """The values of a region (bottom and right excluded) of an image kept row by row in one array; the region is cut at the image's edges."""
    rows = F.sequence(F.lit(max(0, top)), F.greatest(F.least(F.lit(bottom), F.floor(F.size(patch) / width).cast("int")) - 1, F.lit(max(0, top))))
    first, n = max(0, left), max(0, min(right, width) - max(0, left))
    return F.flatten(F.transform(rows, lambda r: F.slice(patch, r * width + first + 1, n)))


def zone_motion(frames: DataFrame, width: int, x: int, y: int, reach: int, patch: str = "patch", order: str = "idx", by: list[str] = BY) -> DataFrame:
    """delta: mean absolute change in the square around (x, y) since the frame before; null for the first."""
    zone = frames.withColumn("_zone", crop(F.col(patch), width, y - reach, y + reach, x - reach, x + reach))
    return frame_delta(zone, "_zone", order, by).drop("_zone")


def padded_delta(signal: DataFrame, deltas: DataFrame, by: list[str] = BY) -> DataFrame:
    """The signal with `delta`, 0 where there is none."""
    return signal.join(deltas.select(*by, "idx", "delta"), [*by, "idx"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))


def effective_rate(times: DataFrame, time: str = "time_s", fallback: float = 30.0, by: list[str] = BY) -> DataFrame:
    """rate: one over the time between the first two samples; the fallback where there are fewer, or no time between them."""
    order = Window.partitionBy(*by).orderBy(time)
    first = times.select(*by, F.col(time).cast("double").alias("_t"), F.row_number().over(order).alias("_n")).where("_n <= 2")
    gap = first.groupBy(*by).agg((F.max("_t") - F.min("_t")).alias("_gap"))
    return gap.select(*by, F.when(F.col("_gap") > 0, 1 / F.col("_gap")).otherwise(F.lit(fallback)).alias("rate"))


def array_mean(values: Column) -> Column:
    """Mean of an array, 0 if it is empty."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def pooled(signal: DataFrame, every: int, value: str = "value", by: list[str] = BY) -> DataFrame:
    """bucket, peak: the largest value since the last kept sample; bucket 0 is 0, samples after the last kept one are dropped."""
    last = Window.partitionBy(*by)
    rows = signal.withColumn("bucket", F.ceil(F.col("idx") / every)).withColumn("_last", F.max("idx").over(last))
    rows = rows.where(F.col("bucket") * every <= F.col("_last"))
    return rows.groupBy(*by, "bucket").agg(F.max(F.when(F.col("bucket") > 0, F.col(value)).otherwise(0.0)).alias("peak"))


def percentile_threshold(signal: DataFrame, percent: float, value: str = "value", by: list[str] = BY, rounds: int = 0, bins: int = 4096) -> DataFrame:
    """threshold: the exact, interpolated percentile of each session's values; nulls don't count.

    By percentile(), which holds a session's distinct values in memory; or, for signals too long for that, in rounds: each counts the values
    between the bounds so far in bins of equal width and keeps the bin that the wanted rank lies in, all sessions at once.
    What the last round leaves is counted by value.
    """
    if not rounds:
        return signal.groupBy(*by).agg(F.percentile(value, percent / 100).alias("threshold"))
    rows = signal.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    ends = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    at = (F.col("_n") - 1) * F.lit(percent / 100)
    wanted = ends.select(*by, at.alias("_at"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("_wanted"), F.col("_low"), F.col("_high")).distinct()
    wanted = wanted.withColumn("_rank", F.col("_wanted"))
    key, state = [*by, "_wanted"], ["_at", "_rank", "_low", "_high"]
    for n in range(rounds + 1):
        inside = rows.join(wanted, by).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        place = F.when(F.col("_high") > F.col("_low"), F.floor(share * bins).cast("double")).otherwise(F.lit(0.0)) if n < rounds else F.col("_v")
        counted = inside.groupBy(*key, "_at", "_rank", place.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        so_far = Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # bins of a session
        counted = counted.withColumn("_before", F.sum("_n").over(so_far) - F.col("_n"))
        met = counted.where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        wanted = met.withColumn("_rank", F.col("_rank") - F.col("_before")).select(*key, *state)
    return wanted.groupBy(*by).agg(
        F.when(F.count("*") == 1, F.max("_low")).otherwise((F.max("_wanted") - F.max("_at")) * F.min_by("_low", "_wanted") + (F.max("_at") - F.min("_wanted")) * F.max_by("_low", "_wanted")).alias("threshold")
    )


def subsampled(signal: DataFrame, every: int) -> DataFrame:
    return signal.where(F.col("idx") % every == 0)
