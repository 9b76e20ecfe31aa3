"""Label streams: the confirming automaton, clean-up of counts, transitions, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof, islands

BY = ["session_id"]


def label_runs(timeline: DataFrame, none_run: int, most: int, time: str, label: str, order: str, by: list[str], block: int = 1 << 16) -> DataFrame:
    """by, label, first, last (places among the session's frames), n, times: parts of runs of one known label, nulls between them passed over unless
    none_run follow each other; times: the first `most`. Runs are made by blocks of the order column, so a run over several blocks has a part in each.
    """
    rows = timeline.select(*by, F.col(order).alias("_o"), F.floor(F.col(order) / F.lit(block)).alias("_b"), F.col(time).cast("double").alias("_t"), F.col(label).cast("int").alias("label"))
    own = [*by, "_b"]
    placed = rows.withColumn("_p", F.row_number().over(Window.partitionBy(*own).orderBy("_o", "_t", "label")).cast("long"))
    sizes = placed.groupBy(*own).agg(F.max("_p").alias("_n"))  # a row a block
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*own, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    known, in_order = placed.where("label is not null"), Window.partitionBy(*own).orderBy("_p")
    begins = (F.col("label") != F.lag("label").over(in_order)) | (F.col("_p") - F.lag("_p").over(in_order) > none_run)
    runs = islands(known, own, ["_p"], begins, "_run")
    runs = runs.withColumn("_k", F.row_number().over(Window.partitionBy(*own, "_run").orderBy("_p")))
    early = F.when(F.col("_k") <= most, F.struct("_p", "_t"))
    parts = runs.groupBy(*own, "_run").agg(F.first("label").alias("label"), F.min("_p").alias("first"), F.max("_p").alias("last"), F.count("*").alias("n"), F.array_sort(F.collect_list(early)).alias("_early"))  # `most` frames
    parts = parts.join(starts, own)
    return parts.select(*by, "label", *[(F.col(c) + F.col("_before")).alias(c) for c in ("first", "last")], "n", F.col("_early._t").alias("times"))


def transitions(timeline: DataFrame, confirm: int = 2, none_run: int = 8, back: float = 0.0, time: str = "time_s", label: str = "label", order: str = "idx", by: list[str] = BY, block: int = 1 << 16) -> DataFrame:
    """time, from_count, to_count, delta, direction, multi_step of confirmed changes of a nullable label.

    The first label is taken silently. A change counts once `confirm` labels in a row (nulls between
    them don't break the row, `none_run` nulls do) agree on it; its time is taken back by `back`. A change by more than one is
    told in unit steps towards the new label.

    Whatever the state was, `confirm` labels that agree leave their label confirmed, and nothing else changes what is confirmed. So
    the runs of that length tell all: each confirms its label at its confirm-th frame, a change if the run
    of that length before it (or the first label) had another. Frames are only looked at by blocks, sessions only by their runs.
    """
    parts = label_runs(timeline, none_run, confirm, time, label, order, by, block)
    in_order = Window.partitionBy(*by).orderBy("first")
    parts = parts.withColumn("_first", F.first("label").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    begins = (F.col("label") != F.lag("label").over(in_order)) | (F.col("first") - F.lag("last").over(in_order) > none_run)
    runs = islands(parts, by, ["first"], begins, "_run")
    so_far = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "_run").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    there = runs.withColumn("_so_far", so_far).where((F.col("_so_far") < confirm) & (F.col("_so_far") + F.col("n") >= confirm))
    confirmed = there.withColumn("_was", F.coalesce(F.lag("label").over(in_order), "_first"))
    at = F.element_at("times", (F.lit(confirm) - F.col("_so_far")).cast("int"))
    changed = confirmed.where("label <> _was").select(*by, F.struct(at.alias("t"), F.col("_was").alias("f"), F.col("label").alias("g")).alias("_c"))
    sign = F.when(F.col("_c.f") > F.col("_c.g"), -1).otherwise(1)
    steps = changed.select(*by, F.col("_c.t").alias("_t"), F.col("_c.f").alias("_f"), F.col("_c.g").alias("_g"), sign.alias("delta"), F.explode(F.sequence(F.lit(0), F.abs(F.col("_c.f") - F.col("_c.g")) - 1)).alias("_k"))
    return steps.select(
        *by,
        F.bround(F.col("_t") - back, 4).alias("time_s"),
        (F.col("_f") + F.col("delta") * F.col("_k")).alias("from_count"),
        (F.col("_f") + F.col("delta") * (F.col("_k") + 1)).alias("to_count"),
        "delta",
        F.when(F.col("delta") < 0, "kill").otherwise("respawn").alias("direction"),
        (F.abs(F.col("_f") - F.col("_g")) > 1).alias("multi_step"),
    )


def decrements(counts: DataFrame, count: str = "label", order: str = "idx", by: list[str] = BY) -> DataFrame:
    """Rows whose count is below the last known one, nulls passed over; a drop by several is one event."""
    known = counts.where(F.col(count).isNotNull())
    return known.withColumn("_before", F.lag(count).over(Window.partitionBy(*by).orderBy(order))).where(F.col(count) < F.col("_before")).drop("_before")


def stabilized(counts: DataFrame, raw: str = "raw", default: int = 12, order: str = "idx", by: list[str] = BY) -> DataFrame:
    """stable: counts 10 to 12 read from digits that may have lost one.

    0 is 10, 2 is 12, 10 to 12 stand; a lone 1 is 12 between 12s (or before the first, a 12), else 11; others are
    unknown and filled from before, else after, else the default. A median over three samples ends it.
    """
    w = Window.partitionBy(*by).orderBy(order)
    clear = F.when(F.col(raw) == 0, 10).when(F.col(raw) == 2, 12).when(F.col(raw).isin(10, 11, 12), F.col(raw).cast("int"))
    rows = counts.withColumn("_clear", clear)
    rows = rows.withColumn("_left", F.last("_clear", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_right", F.first("_clear", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    lone = F.when((F.col("_right") == 12) & (F.col("_left").isNull() | (F.col("_left") == 12)), 12).otherwise(11)
    rows = rows.withColumn("_fixed", F.when(F.col(raw) == 1, lone).otherwise(F.col("_clear")))
    filled = F.coalesce(F.last("_fixed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("_fixed", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(default))
    rows = rows.withColumn("_filled", filled)
    a, b, c = F.coalesce(F.lag("_filled").over(w), F.col("_filled")), F.col("_filled"), F.coalesce(F.lead("_filled").over(w), F.col("_filled"))
    rows = rows.withColumn("stable", F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)))
    return rows.drop("_clear", "_left", "_right", "_fixed", "_filled")


def step_counts(timeline: DataFrame, label: str = "label", order: str = "idx", by: list[str] = BY) -> DataFrame:
    """n, n_null, least, median, largest, n_up, n_down: steps between neighbours that are both known."""
    before = F.lag(label).over(Window.partitionBy(*by).orderBy(order))
    rows = timeline.withColumn("_b", before)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label).isNull()).alias("n_null"),
        F.min(label).alias("least"),
        F.max(label).alias("largest"),
        F.median(label).alias("median"),
        F.count_if(F.col(label) > F.col("_b")).alias("n_up"),
        F.count_if(F.col(label) < F.col("_b")).alias("n_down"),
    )


def segments(timeline: DataFrame, label: str = "label", time: str = "time_s", order: str = "idx", by: list[str] = BY) -> DataFrame:
    """label, start, end of runs of one value; a run ends where the next begins, the last with the last sample."""
    w = Window.partitionBy(*by).orderBy(order)
    runs = islands(timeline, by, [order], ~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(order).over(w).isNull(), "run")
    ends = runs.groupBy(*by, "run").agg(F.first(label).alias(label), F.min(time).alias("start"), F.max(time).alias("_last"))
    return ends.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(*by).orderBy("run")), "_last")).drop("_last")


def sanity(changes: DataFrame, lo: float = 0.0, hi: float = float("inf"), states: tuple[int, ...] = (8, 9, 10, 11, 12), ghost: float = 0.08, expected: int = 100, by: list[str] = BY) -> DataFrame:
    """Counts of kills (in all and within the challenge) and respawns, states out of range, the least gap, gaps that are too short, and whether the count is near the expected."""
    kills = F.col("direction") == "kill"
    gaps = changes.where(kills).withColumn("_gap", F.col("time_s") - F.lag("time_s").over(Window.partitionBy(*by).orderBy("time_s"))).groupBy(*by).agg(F.min("_gap").alias("min_gap"), F.count_if(F.col("_gap") < ghost).alias("n_ghost"))
    seen = F.array_except(F.array_distinct(F.concat(F.collect_set("from_count"), F.collect_set("to_count"))), F.array(*[F.lit(s) for s in states]))
    counts = changes.groupBy(*by).agg(
        F.count_if(kills).alias("n_kills"), F.count_if(kills & F.col("time_s").between(lo, hi)).alias("n_challenge"), F.count_if(~kills).alias("n_respawns"), F.array_sort(seen).alias("bad_states")
    )
    return counts.join(gaps, by, "left").withColumn("count_ok", F.abs(F.col("n_challenge") - expected) <= 15)


def benchmark_lookup(labels: DataFrame, timeline: DataFrame, frame: str = "frame_n", by: list[str] = BY) -> DataFrame:
    """pred: the timeline's label at each labelled frame, or at the nearest frame (of two the earlier)."""
    frames = timeline.select(*by, F.col(frame).alias("_fn"), F.col("label").alias("_l"))
    back = asof(labels, frames.withColumn("_bl", F.struct("_l")), by, frame, "_fn", ["_fn", "_bl"], "backward").withColumnsRenamed({"_fn": "_bfn"})
    both = asof(back, frames.withColumn("_al", F.struct("_l")), by, frame, "_fn", ["_fn", "_al"], "forward")
    use_back = F.col("_bfn").isNotNull() & (F.col("_fn").isNull() | (F.col(frame) - F.col("_bfn") <= F.col("_fn") - F.col(frame)))
    return both.withColumn("pred", F.when(use_back, F.col("_bl._l")).otherwise(F.col("_al._l"))).drop("_bfn", "_fn", "_bl", "_al")


def confusion(evaluated: DataFrame, truth: str, pred: str, labels: list[int]) -> DataFrame:
    """A row for each true label: counts by prediction, those without one as pred_none."""
    counted = [F.count_if(F.col(pred) == x).alias(f"pred_{x}") for x in labels]
    return evaluated.where(F.col(truth).isin(*labels)).groupBy(F.col(truth).alias("truth")).agg(*counted, F.count_if(F.col(pred).isNull()).alias("pred_none"))


def correct(truth: str, pred: str) -> Column:
    return F.coalesce(F.col(truth) == F.col(pred), F.lit(False))
