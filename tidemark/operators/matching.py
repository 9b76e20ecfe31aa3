"""One-to-one matching of detections to truths, time offsets, and scores.

det and truth: session_id and a time. Times further apart than the tolerance from all others of their session never
meet, so a session falls into islands, which are matched in parallel, each by its two arrays of times and in time about linear in them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import assignment
from tidemark.operators.asof import band_join, islands

BY = ["session_id"]


def in_islands(det: DataFrame, truth: DataFrame, tolerance: float | None, time: str, by: list[str]) -> DataFrame:
    """_t, _det, _island of the times of both sides: a new island after each gap wider than the tolerance (None: one a session)."""
    both = det.select(*by, F.col(time).alias("_t"), F.lit(True).alias("_det")).unionByName(truth.select(*by, F.col(time).alias("_t"), F.lit(False).alias("_det")))
    if tolerance is None:
        return both.withColumn("_island", F.lit(0).cast("long"))
    return islands(both, by, ["_t"], F.col("_t") - F.lag("_t").over(Window.partitionBy(*by).orderBy("_t")) > tolerance, "_island")


def sides(det: DataFrame, truth: DataFrame, tolerance: float | None, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """d, g: sorted times of both sides of each island; empty arrays for none."""
    times = [F.array_sort(F.collect_list(F.when(side, F.col("_t")))).alias(name) for name, side in (("d", F.col("_det")), ("g", ~F.col("_det")))]  # of one island
    return in_islands(det, truth, tolerance, time, by).groupBy(*by, "_island").agg(*times)


def _paired(both: DataFrame, det: DataFrame, pairs: Callable, by: list[str]) -> DataFrame:
    """det_time, truth_time of pairs(d, g): places in the two arrays of each row of sides()."""
    kinds, kind = dict(det.dtypes), dict(both.dtypes)["d"].removeprefix("array<").removesuffix(">")

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        made = []
        for *key, d, g in rows[[*by, "d", "g"]].itertuples(index=False):
            d, g = np.asarray(d), np.asarray(g)
            if len(d) and len(g):
                made += [(*key, d[i], g[j]) for i, j in pairs(d, g)]
        return pd.DataFrame(made, columns=[*by, "det_time", "truth_time"])

    return both.mapInPandas(lambda parts: map(each, parts), ", ".join(f"{c} {kinds[c]}" for c in by) + f", det_time {kind}, truth_time {kind}")


def greedy_in_order(det: DataFrame, truth: DataFrame, tolerance: float, time: str = "time_s", by: list[str] = BY, first: bool = False) -> DataFrame:
    """det_time, truth_time: each detection in time order takes the nearest truth not yet taken (first: the earliest)."""
    return _paired(sides(det, truth, tolerance, time, by), det, lambda d, g: assignment.greedy(d, g, tolerance, first), by)


def closest_pairs(det: DataFrame, truth: DataFrame, tolerance: float, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """det_time, truth_time: pairs within the tolerance, the closest of all first, each time used once."""
    return _paired(sides(det, truth, tolerance, time, by), det, lambda d, g: assignment.closest(d, g, tolerance), by)


def optimal_assignment(det: DataFrame, truth: DataFrame, tolerance: float, time: str = "time_s", by: list[str] = BY, most: bool = True) -> DataFrame:
    """det_time, truth_time: best one-to-one pairs within the tolerance.

    most: the most pairs, then the least total distance, of each island by itself; else the least total distance with the
    smaller side wholly matched, pairs beyond the tolerance dropped afterwards: those may span any gap, so a session's times are one group then.
    Either takes a group's two arrays of times and, beside them, its band times twice the root of its smaller side.
    """
    det, truth = (x.withColumn(time, F.col(time).cast("double")) for x in (det, truth))
    both = sides(det, truth, tolerance if most else None, time, by)
    return _paired(both, det, lambda d, g: [(i, j) for i, j in assignment.assign(d, g, tolerance, most) if abs(d[i] - g[j]) <= tolerance], by)


def scored(det: DataFrame, truth: DataFrame, pairs: DataFrame, by: list[str] = BY, scale: float = 1000.0) -> DataFrame:
    """tp, fp, fn, recall, precision, f1 (percent, 0 where undefined), mean and median error (times scale) of each session."""
    n_det, n_gt = det.groupBy(*by).agg(F.count("*").alias("n_det")), truth.groupBy(*by).agg(F.count("*").alias("n_gt"))
    error = F.abs(F.col("det_time") - F.col("truth_time")) * scale
    matched = pairs.groupBy(*by).agg(F.count("*").alias("tp"), F.avg(error).alias("mean_error"), F.median(error).alias("median_error"))
    all_three = n_det.join(n_gt, by, "full_outer").join(matched, by, "left").na.fill(0, ["n_det", "n_gt", "tp"])
    return all_three.select(*by, "n_det", "n_gt", "tp", (F.col("n_det") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), *rates("tp", "n_det", "n_gt"), "mean_error", "median_error")


def rates(tp: str, n_det: str, n_gt: str) -> list[Column]:
    recall = F.when(F.col(n_gt) > 0, 100.0 * F.col(tp) / F.col(n_gt)).otherwise(0.0)
    precision = F.when(F.col(n_det) > 0, 100.0 * F.col(tp) / F.col(n_det)).otherwise(0.0)
    f1 = F.when(F.col(tp) > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [recall.alias("recall"), precision.alias("precision"), f1.alias("f1")]


def _best_offset(rows: DataFrame, offsets: list[int], count: Callable, by: list[str]) -> DataFrame:
    """_best (o, tp): the first offset with the most pairs, of rows (d, g, and _at, what the offsets are added to); nothing where no offset has a pair.

    count(d, g, offsets) gives an island's pairs at each offset; a session's islands are counted in parallel and summed, a row an offset.
    """
    tried, kinds = np.array(offsets, np.int64), dict(rows.dtypes)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        made = []
        for *key, d, g, at in part[[*by, "d", "g", "_at"]].itertuples(index=False):
            found = count(np.asarray(d, np.int64) - at, np.asarray(g, np.int64), tried)
            made += [(*key, at, n, tried[n], found[n]) for n in np.flatnonzero(found).tolist()]
        return pd.DataFrame(made, columns=[*by, "_at", "_n", "_offset", "_tp"])

    found = rows.mapInPandas(lambda parts: map(each, parts), ", ".join(f"{c} {kinds[c]}" for c in by) + ", _at long, _n int, _offset long, _tp long")
    sums = found.groupBy(*by, "_at", "_n", "_offset").agg(F.sum("_tp").alias("_tp"))
    return sums.groupBy(*by).agg(F.max_by(F.struct((F.col("_at") + F.col("_offset")).alias("o"), F.col("_tp").alias("tp")), F.struct("_tp", -F.col("_n"))).alias("_best"))


def _whole_sides(det: DataFrame, truth: DataFrame, reach: int, time: str, by: list[str]) -> DataFrame:
    return sides(det.withColumn(time, F.col(time).cast("long")), truth.withColumn(time, F.col(time).cast("long")), reach, time, by)


def offset_grid(det: DataFrame, truth: DataFrame, offsets: list[int], tolerance: int, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """best_offset, best_tp: the offset (whole units) to take off the detections that matches the most, in order; of equals the first that beats none before."""
    both = _whole_sides(det, truth, max(abs(o) for o in offsets) + tolerance, time, by)
    found = _best_offset(both.withColumn("_at", F.lit(0).cast("long")), offsets, lambda d, g, tried: np.array([len(assignment.greedy(d - o, g, tolerance)) for o in tried]), by)
    made = both.select(*by).distinct().join(found, by, "left")
    return made.select(*by, F.coalesce("_best.o", F.lit(0)).alias("best_offset"), F.coalesce("_best.tp", F.lit(0)).alias("best_tp"))


def offset_search(det: DataFrame, truth: DataFrame, coarse: range, fine: range, tolerance: int, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """best_offset, best_tp: the offset (whole units) to take off the detections that allows the most pairs within the tolerance.

    Tried are the coarse offsets, then the fine ones about the best of them; of equals the first, and a fine one only if it beats
    the coarse. 0 where nothing pairs. No pair of any offset spans a gap wider than the reach and the tolerance, so islands
    end there. Sessions with one side only are there.
    """
    both = _whole_sides(det, truth, max(abs(o) for o in coarse) + max(abs(o) for o in fine) + tolerance, time, by)
    first = _best_offset(both.withColumn("_at", F.lit(0).cast("long")), coarse, lambda d, g, tried: assignment.pair_counts(d, g, tried, tolerance), by)
    start = both.select(*by).distinct().join(first, by, "left").select(*by, F.coalesce("_best.o", F.lit(0)).alias("_at"), F.coalesce("_best.tp", F.lit(0)).alias("_tp"))
    second = _best_offset(both.join(start.select(*by, "_at"), by), fine, lambda d, g, tried: assignment.pair_counts(d, g, tried, tolerance), by)
    best = start.join(second, by, "left")
    better = F.coalesce(F.col("_best.tp") > F.col("_tp"), F.lit(False))
    return best.select(*by, F.when(better, F.col("_best.o")).otherwise(F.col("_at")).alias("best_offset"), F.when(better, F.col("_best.tp")).otherwise(F.col("_tp")).alias("best_tp"))


def shifted(det: DataFrame, offsets: DataFrame, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """The detections with their session's best_offset taken off, where it has one."""
    return det.join(offsets.select(*by, "best_offset"), by, "left").withColumn(time, F.col(time) - F.coalesce("best_offset", F.lit(0))).drop("best_offset")


def offset_correlation(det: DataFrame, truth: DataFrame, reach: int, step: int, sigma: float, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """best_offset: the lag whose Gaussian-blurred trains correlate most, from differences of whole times within reach plus four widths.

    Differences are counted first, so a session meets the lags with as many rows as it has distinct differences, however many pairs.
    """
    slack = 4 * sigma * 2**0.5
    left, right = det.select(*by, F.col(time).alias("dt")), truth.select(*by, F.col(time).alias("gt"))
    differences = band_join(left, right, by, "dt", "gt", reach + slack, reach + slack).groupBy(*by, (F.col("dt") - F.col("gt")).alias("x")).agg(F.count("*").alias("n"))
    lags = differences.withColumn("lag", F.explode(F.sequence(F.lit(-reach), F.lit(reach), F.lit(step))))
    kernel = F.exp(-((F.col("x") - F.col("lag")) ** 2) / F.lit(4 * sigma * sigma))
    sums = lags.groupBy(*by, "lag").agg(F.round(F.sum(F.col("n") * kernel), 6).alias("strength"))
    return sums.groupBy(*by).agg(F.max_by("lag", F.struct("strength", -F.col("lag"))).alias("best_offset"), F.max("strength").alias("strength"))


def matches_at(det: DataFrame, truth: DataFrame, offsets: DataFrame, tolerance: float, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """offsets with n_matches: detections that take a truth, in order, once the offset is taken off."""
    pairs = greedy_in_order(shifted(det, offsets, time, by), truth, tolerance, time, by)
    return offsets.join(pairs.groupBy(*by).agg(F.count("*").alias("n_matches")), by, "left").na.fill(0, ["n_matches"])


def in_range(det: DataFrame, truth: DataFrame, margin: float, time: str = "time_s", by: list[str] = BY, outside: bool = False) -> DataFrame:
    """Detections between the first and last truth, widened by the margin; outside: those that are not. Sessions without truths have none of either."""
    bounds = truth.groupBy(*by).agg((F.min(time) - margin).alias("_lo"), (F.max(time) + margin).alias("_hi"))
    inside = F.col(time).between(F.col("_lo"), F.col("_hi"))
    return det.join(bounds, by).where(~inside if outside else inside).drop("_lo", "_hi")


def labelled(det: DataFrame, truth: DataFrame, pairs: DataFrame, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """side, time, label: detections as tp or fp, truths as matched or fn. Times are unique within a session."""
    d = det.select(*by, F.col(time).alias("t")).join(pairs.select(*by, F.col("det_time").alias("t"), F.lit(1).alias("_m")), [*by, "t"], "left")
    g = truth.select(*by, F.col(time).alias("t")).join(pairs.select(*by, F.col("truth_time").alias("t"), F.lit(1).alias("_m")), [*by, "t"], "left")
    return d.select(*by, F.lit("detection").alias("side"), "t", F.when(F.col("_m").isNotNull(), "tp").otherwise("fp").alias("label")).unionByName(
        g.select(*by, F.lit("truth").alias("side"), "t", F.when(F.col("_m").isNotNull(), "matched").otherwise("fn").alias("label"))
    )


def full_outer_alignment(kills: DataFrame, audio: DataFrame, window: float, time: str = "time_s", by: list[str] = BY) -> DataFrame:
    """time, audio_time, delta, match_status: kills in order take the nearest audio event; both sides' rest stays."""
    pairs = greedy_in_order(kills, audio, window, time, by)
    left = kills.select(*by, F.col(time).alias("det_time")).join(pairs, [*by, "det_time"], "left")
    rest = audio.select(*by, F.col(time).alias("truth_time")).join(pairs, [*by, "truth_time"], "left_anti")
    both = left.unionByName(rest, allowMissingColumns=True)
    status = F.when(F.col("det_time").isNull(), "audio_only").when(F.col("truth_time").isNull(), "bot_count_only").otherwise("matched")
    return both.select(*by, F.col("det_time").alias("time"), F.col("truth_time").alias("audio_time"), (F.col("det_time") - F.col("truth_time")).alias("delta"), status.alias("match_status"))


def error_histogram(pairs: DataFrame, bins: int, by: list[str] = BY) -> DataFrame:
    """bin (1 to bins), n of the signed errors, in equal bins from the least to the largest."""
    e = pairs.select(*by, (F.col("det_time") - F.col("truth_time")).cast("double").alias("e"))
    bounds = e.groupBy(*by).agg(F.min("e").alias("_lo"), F.max("e").alias("_hi"))
    inside = e.join(bounds, by).where("_lo < _hi")
    place = F.least(F.floor((F.col("e") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)) + 1, F.lit(bins))
    return inside.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
