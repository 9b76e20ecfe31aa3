"""What a timeline shows at each moment: acquisition, running scores, tallies, proximity, step values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof, band_join, islands, range_join
from tidemark.operators.blocks import WIDTH, running

BY = ["session_id"]


def window_frames(frames: DataFrame, engagements: DataFrame, offset: float = 0.0, width: float = 60.0, by: list[str] = BY) -> DataFrame:
    """Frames from an engagement's start to its first shot (excluded), both moved by the offset, the start not before 0."""
    spans = engagements.select(*by, "engagement_id", F.greatest(F.col("start") + offset, F.lit(0.0)).alias("_lo"), (F.col("first_shot") + offset).alias("_hi"))
    return range_join(frames, spans, by, "time_s", "_lo", "_hi", width).drop("_lo", "_hi")


def settle_time(frames: DataFrame, threshold: float = 4.0, motion: str = "motion", by: list[str] = BY) -> DataFrame:
    """acquired: where the last run of motion within the threshold begins, or else the first frame of least motion."""
    order = Window.partitionBy(*by).orderBy("time_s")
    rows = frames.withColumn("_low", F.col(motion) <= threshold)
    runs = islands(rows, by, ["time_s"], F.col("_low") != F.lag("_low").over(order), "run")
    starts = runs.where("_low").groupBy(*by, "run").agg(F.min("time_s").alias("_start"))
    settled = starts.groupBy(*by).agg(F.max_by("_start", "run").alias("_settled"))
    least = frames.groupBy(*by).agg(F.min_by("time_s", F.struct(motion, "time_s")).alias("_least"))
    return least.join(settled, by, "left").select(*by, F.coalesce("_settled", "_least").alias("acquired"))


def with_degenerate(rows: DataFrame, frame: float) -> DataFrame:
    """acquired of windows shorter than a frame: their start, as nothing can be seen in them."""
    return rows.withColumn("acquired", F.when(F.col("first_shot") - F.col("start") < frame, F.col("start")).otherwise(F.col("acquired")))


def motion_profile(frames: DataFrame, engagements: DataFrame, least: float, offset: float = 0.0, width: float = 60.0, by: list[str] = BY) -> DataFrame:
    """engagement_id, relative_ms, motion of the frames of each engagement's window, those of windows shorter than `least` left out."""
    long = engagements.where(F.col("first_shot") - F.col("start") >= least)
    found = window_frames(frames, long, offset, width, by).join(long.select(*by, "engagement_id", "start"), [*by, "engagement_id"])
    return found.select(*by, "engagement_id", ((F.col("time_s") - offset - F.col("start")) * 1000).alias("relative_ms"), "motion")


def acquisition_metrics(rows: DataFrame) -> DataFrame:
    """acquisition_ms and true_ttff_ms from start, acquired and first_shot in seconds."""
    return rows.withColumn("acquisition_ms", F.bround((F.col("acquired") - F.col("start")) * 1000, 1)).withColumn("true_ttff_ms", F.bround((F.col("first_shot") - F.col("acquired")) * 1000, 1))


def scoreboard(labelled: DataFrame, time: str = "t", by: list[str] = BY, width: float = WIDTH) -> DataFrame:
    """tp, fp, fn, recall, precision, f1 up to and with each event's time; summed by blocks of time, each with the totals of those before."""
    counts = {name: F.when(F.col(column) == kind, 1).otherwise(0) for name, column, kind in (("tp", "label", "tp"), ("fp", "label", "fp"), ("fn", "label", "fn"), ("n_gt", "side", "truth"))}
    rows = running(labelled.select(*by, time, "side", "label"), counts, by, time, width)
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")) * 100).otherwise(0.0)
    recall = F.when(F.col("n_gt") > 0, F.col("tp") / F.col("n_gt") * 100).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.withColumns({"recall": recall, "precision": precision, "f1": f1}).drop("n_gt")


def tally(frames: DataFrame, events: DataFrame, time: str = "time_s", by: list[str] = BY, width: float = WIDTH) -> DataFrame:
    """n: events up to and with each frame's time; counted by blocks of time, each with the totals of those before."""
    both = frames.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_e"), F.struct(*frames.columns).alias("_row")).unionByName(
        events.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_e")), allowMissingColumns=True
    )
    return running(both, {"n": F.col("_e")}, by, "_t", width).where("_row is not null").select("_row.*", "n")


def visible(frames: DataFrame, events: DataFrame, before: float, after: float, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """event_time, offset: for each frame the events that a strip around it shows, from `before` earlier to `after` later."""
    near = band_join(frames, events.select(*by, F.col(time).alias("event_time")), by, time, "event_time", before, after)
    return near.withColumn("offset", F.col("event_time") - F.col(time))


def latest(frames: DataFrame, events: DataFrame, within: float, time: str = "time_s", by: list[str] = BY, width: float = WIDTH) -> DataFrame:
    """latest: the last event up to each frame that is no older than `within`; null without one."""
    return asof(frames, events.select(*by, F.col(time).alias("_e"), F.col(time).alias("latest")), by, time, "_e", ["latest"], "backward", tolerance=within, width=width)


def within_duration(events: DataFrame, sessions: DataFrame, time: str = "time_s", duration: str = "duration", by: list[str] = BY) -> DataFrame:
    """n: events of each session up to its duration."""
    counted = events.join(sessions, by).where(F.col(time) <= F.col(duration)).groupBy(*by).agg(F.count("*").alias("n"))
    return sessions.select(*by).join(counted, by, "left").na.fill(0, ["n"])


def tail(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows in that order; each task sends its own n at most."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def proximity(frames: DataFrame, events: DataFrame, ramp: float, fade: float, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """intensity: the largest of ramps up to an event and fades after it; 0 away from any."""
    near = band_join(frames, events.select(*by, F.col(time).alias("_e")), by, time, "_e", fade, ramp)
    gap = F.col(time) - F.col("_e")
    strength = F.when((gap < 0) & (gap >= -ramp), 1 + gap / ramp).when(gap.between(0, fade), 1 - gap / fade).otherwise(0.0)
    best = near.groupBy(*by, time).agg(F.max(strength).alias("intensity"))
    return frames.join(best, [*by, time], "left").withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))


def pulse(timeline: DataFrame, label: str = "label", decay: float = 0.08, order: str = "idx", by: list[str] = BY) -> DataFrame:
    """pulse: 1 where the value changes, then less by the decay each row, not below 0; 0 before the first change."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = timeline.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.lag(label).over(w))
    rows = rows.withColumn("_at", F.last(F.when(F.col("_b").isNotNull() & (F.col(label) != F.col("_b")), F.col("_n")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("pulse", F.coalesce(F.greatest(F.lit(0.0), 1 - decay * (F.col("_n") - F.col("_at"))), F.lit(0.0))).drop("_n", "_b", "_at")


def step_value(frames: DataFrame, steps: DataFrame, value: str, time: str = "time_s", by: list[str] = BY, width: float = WIDTH) -> DataFrame:
    """The value of the last step at or before each frame; before the first step, its value."""
    first = steps.groupBy(*by).agg(F.min_by(value, time).alias("_first"))
    met = asof(frames, steps.select(*by, F.col(time).alias("_st"), value), by, time, "_st", [value], "backward", width=width)
    return met.join(first, by, "left").withColumn(value, F.coalesce(value, "_first")).drop("_first")


def even_sample(frames: DataFrame, n: int, frame: str = "frame_n", by: list[str] = BY) -> DataFrame:
    """n frames spread evenly from the first to the last, by number; numbers that no frame has are passed over."""
    last = frames.groupBy(*by).agg(F.max(frame).alias("_last"))
    wanted = last.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"), "_last").withColumn(frame, F.bround(F.col("sample") * F.col("_last") / max(1, n - 1)).cast("long")).drop("_last")
    return wanted.join(frames, [*by, frame])
