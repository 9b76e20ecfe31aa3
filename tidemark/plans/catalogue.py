"""The queries over the event tables, by name; oracle.py has their SQL.

Stand-ins: a user is a session; clicks are shots, views hits, purchases kills, sign-ups detections; all events of a
user in order are a sampled signal. Times are whole ticks of four hours, or whole minutes, so both engines
compare equal numbers; other numbers are rounded to six places at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import asof, automaton, engagement, frames, matching, peaks, signals, timeline
from tidemark.plans.oracle import ORACLES
from tidemark.streaming import live

KEY = ["session_id"]
#: Rows that a shuffle deals to a task, and its settings in bytes: of shuffled rows and of files that a task takes. A task of a long query sorts its
#: rows some fifteen times, each in one page of memory (64 MB) at least; so many rows still fit into that.
TASK_ROWS, TASK_BYTES = 1 << 18, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20, "spark.sql.files.maxPartitionBytes": 16 << 20}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sized(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table, and shuffles dealt over as many tasks as its rows need, so that a task's memory does not grow with it.

    A size that the application was started with stays, and a number where it is larger; Spark merges what is too small for a task.
    """
    df, conf = read(spark, sf, name), spark.conf
    started = spark.sparkContext.getConf()
    for setting, most in TASK_BYTES.items():
        if not started.contains(setting):
            conf.set(setting, str(most))
    given = started.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", conf.get("spark.sql.shuffle.partitions"))
    conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(int(given), -(-df.count() // TASK_ROWS))))  # counted from the footers of its files
    return df


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame) -> DataFrame:
    """All doubles at six places, -0 as 0; ints and flags as longs."""
    made = []
    for name, kind in df.dtypes:
        c = F.col(name)
        made.append({"double": F.round(c, 6) + 0.0, "float": F.round(c.cast("double"), 6) + 0.0, "int": c.cast("long"), "smallint": c.cast("long"), "boolean": c.cast("int").cast("long")}.get(kind, c).alias(name))
    return df.select(*made)


def events(spark: SparkSession, sf: str) -> DataFrame:
    us = scalars.epoch_micros("ts")
    rows = sized(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), "event_id", F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"), us.alias("us")
    )
    return rows.withColumn("tick", F.expr("us div 14400000000")).withColumn("m", F.expr("us div 60000000"))


def of_kind(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    return events(spark, sf).where(F.col("kind").isin(*kinds))


def shots(spark: SparkSession, sf: str) -> DataFrame:
    return of_kind(spark, sf, "click").select(*KEY, "event_id", "tick")


def hits(spark: SparkSession, sf: str) -> DataFrame:
    return of_kind(spark, sf, "view").select(*KEY, "event_id", "tick", F.floor("value").alias("damage"), (F.col("k") % 8).alias("hit_group"))


def kills(spark: SparkSession, sf: str) -> DataFrame:
    return of_kind(spark, sf, "purchase").select(*KEY, "event_id", "tick", (F.col("k") % 2 == 0).alias("headshot"), F.concat(F.lit("w"), F.col("k") % 5).alias("weapon"))


def signal(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy(*KEY).orderBy("us", "event_id")
    label = F.when(F.col("k") % 11 != 0, (8 + F.col("k") % 5).cast("int"))
    raw = F.element_at(F.array(*[F.lit(x).cast("int") for x in (0, 1, 2, 7, 10, 11, 12, None)]), (F.col("k") % 8 + 1).cast("int"))
    rows = events(spark, sf).withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return rows.withColumn("label", label).withColumn("raw", raw).withColumn("time_s", F.col("idx").cast("double"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return sized(spark, sf, "lineitem").select(F.col("l_suppkey").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.col("l_quantity").alias("value"))


def minutes(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Distinct minutes of a kind's events."""
    return of_kind(spark, sf, kind).select(*KEY, F.col("m").alias("time_s")).distinct()


def both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return minutes(spark, sf, "signup"), minutes(spark, sf, "purchase")


def engagements(spark: SparkSession, sf: str) -> DataFrame:
    return engagement.engagement_map(shots(spark, sf), hits(spark, sf), kills(spark, sf))


# engagements


@query
def player_mode(spark: SparkSession, sf: str) -> DataFrame:
    return engagement.modal_actor(events(spark, sf).withColumn("actor", F.col("k") % 7))


@query
def player_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("actor", F.col("k") % 7)
    return engagement.of_actor(rows, engagement.modal_actor(rows)).select(*KEY, "event_id", "actor")


@query
def shot_to_kill_asof(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(engagement.attach_shots(shots(spark, sf), kills(spark, sf)))


@query
def hit_match_greedy(spark: SparkSession, sf: str) -> DataFrame:
    matched = engagement.match_hits(engagement.attach_shots(shots(spark, sf), kills(spark, sf)), hits(spark, sf))
    return rounded(matched.select(*KEY, "engagement_id", F.array_join("flags", ",").alias("flags")))


@query
def damage_asof(spark: SparkSession, sf: str) -> DataFrame:
    return engagement.first_hits(shots(spark, sf), hits(spark, sf))


@query
def hit_tick_groups(spark: SparkSession, sf: str) -> DataFrame:
    return engagement.hit_metadata(hits(spark, sf))


@query
def kill_meta(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(engagement.kill_metadata(kills(spark, sf)))


@query
def engagement_map(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(engagements(spark, sf).drop("shots"))


@query
def kpi_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(engagement.session_summary(engagements(spark, sf)))


@query
def one_tap_streak(spark: SparkSession, sf: str) -> DataFrame:
    return engagement.one_tap_streak(engagements(spark, sf))


@query
def shot_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = engagement.wide_shots(engagements(spark, sf), 15)
    return rounded(wide.select(*KEY, "engagement_id", *[f"shot_{k}_{c}" for k in range(1, 16) for c in ("time_s", "hit")]))


@query
def rolling_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(engagement.rolling_hit_rate(engagements(spark, sf)))


# signals


@query
def first_diff_clip(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.differenced(items(spark, sf)).select(*KEY, "idx", "difference", "rise"))


@query
def boxcar_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.enveloped(items(spark, sf), {"envelope4": 4, "envelope5": 5}).select(*KEY, "idx", "envelope4", "envelope5"))


@query
def median3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.smoothed(items(spark, sf)).select(*KEY, "idx", "smooth"))


@query
def ffill_bfill(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.without_gaps(signal(spark, sf), "label", 12).select(*KEY, "idx", "label"))


@query
def rms_energy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.rms_energy(read(spark, sf, "embeddings"), "embedding", 1000, 8, 4, ("vec_id",)))


@query
def frame_delta(spark: SparkSession, sf: str) -> DataFrame:
    frames = read(spark, sf, "embeddings").select(F.expr("vec_id div 50").alias("session_id"), "vec_id", "embedding")
    return rounded(signals.frame_delta(frames, "embedding", "vec_id").select("vec_id", "delta"))


@query
def zone_motion(spark: SparkSession, sf: str) -> DataFrame:
    frames = read(spark, sf, "embeddings").select(F.expr("vec_id div 50").alias("session_id"), "vec_id", "embedding")
    return rounded(signals.zone_motion(frames, 8, 4, 3, 2, "embedding", "vec_id").select("vec_id", "delta"))


@query
def padded_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = items(spark, sf)
    deltas = rows.select(*KEY, "idx", signals.first_difference().cast("double").alias("delta")).where("idx > 0")  # the first sample has none
    return rounded(signals.padded_delta(rows.select(*KEY, "idx", "value"), deltas))


@query
def effective_rate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.effective_rate(minutes(spark, sf, "click")))


@query
def text_labels(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey").cast("int")
    name = F.concat(F.lit("raw_"), F.translate(F.lower("n_name"), " ", "_"), F.when(key % 2 == 0, ".mp4").otherwise(""))
    made = [scalars.titled(F.lower("n_name")), scalars.renamed(name, "raw_", "clip_"), scalars.with_suffix(name, ".mp4", "_kills.csv"), scalars.numbered("nation", key), F.upper(name)]
    names = ("label", "clip", "path", "number", "upper")
    return read(spark, sf, "nation").select("n_nationkey", *[c.alias(n) for c, n in zip(made, names, strict=True)])


@query
def brightness(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: scalars.brightness(at(3 * i + 1), at(3 * i + 2), at(3 * i + 3)))
    grays = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: scalars.gray(100 * at(3 * i + 1), 100 * at(3 * i + 2), 100 * at(3 * i + 3)))
    return rounded(read(spark, sf, "embeddings").select("vec_id", signals.array_mean(pixels).alias("brightness"), signals.array_mean(grays).alias("gray")))


@query
def red_share(spark: SparkSession, sf: str) -> DataFrame:
    red = scalars.reddish(F.col("k") * 2, F.col("value"), F.col("value") + 10)
    return rounded(events(spark, sf).groupBy(*KEY).agg((F.avg(F.when(red, 1.0).otherwise(0.0)) * 100).alias("red_pct")))


@query
def maxpool_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.pooled(signal(spark, sf), 4))


@query
def subsample(spark: SparkSession, sf: str) -> DataFrame:
    return signals.subsampled(items(spark, sf), 8)


@query
def percentile_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(signals.percentile_threshold(signal(spark, sf), 98.7, rounds=1))


# peaks


@query
def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(peaks.local_maxima(items(spark, sf)))


@query
def peaks_height_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(peaks.find_peaks(signal(spark, sf), height=20.0, distance=4))


@query
def peaks_prominence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(peaks.find_peaks(signal(spark, sf), distance=3, prominence=30.0))


@query
def rise_peaks(spark: SparkSession, sf: str) -> DataFrame:
    rise = signal(spark, sf).select(*KEY, "idx", signals.rises().alias("value"))
    return rounded(peaks.find_peaks(rise, distance=3, prominence=30.0))


@query
def rise_height_peaks(spark: SparkSession, sf: str) -> DataFrame:
    rise = signal(spark, sf).select(*KEY, "idx", signals.rises().alias("value"))
    return rounded(peaks.find_peaks(rise, height=20.0, distance=4))


@query
def width_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf)
    return rounded(peaks.narrow(peaks.find_peaks(rows, height=40.0, distance=3), rows, 40.0, 2))


@query
def rejected_peaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf)
    raw = peaks.find_peaks(rows, height=40.0, distance=3)
    return rounded(peaks.rejected(raw, peaks.narrow(raw, rows, 40.0, 2)))


@query
def red_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf)
    gated = peaks.find_peaks(rows, height=20.0, distance=4).join(rows.select(*KEY, "idx", "k"), [*KEY, "idx"])
    return rounded(gated.where("k >= 30").select(*KEY, "idx", "height"))


@query
def audio_detect(spark: SparkSession, sf: str) -> DataFrame:
    energy = signal(spark, sf).select(*KEY, "idx", "time_s", F.col("value").alias("energy"))
    return rounded(peaks.audio_peaks(energy, 80.0, 3, 6.0).select(*KEY, "time_s", "energy", "confidence"))


@query
def confidence_stats(spark: SparkSession, sf: str) -> DataFrame:
    energy = signal(spark, sf).select(*KEY, "idx", "time_s", F.col("value").alias("energy"))
    c = F.col("confidence")
    return rounded(peaks.audio_peaks(energy, 80.0, 3, 6.0).groupBy(*KEY).agg(F.min(c).alias("least"), F.median(c).alias("median"), F.avg(c).alias("mean"), F.count_if(c < 1.05).alias("n_low"), F.count_if(c >= 1.08).alias("n_sure")))


@query
def session_type(spark: SparkSession, sf: str) -> DataFrame:
    energy = signal(spark, sf).select(*KEY, "idx", "time_s", F.col("value").alias("energy"))
    return peaks.session_type(energy, {"tap": 70.0, "spray": 90.0}, 8, 2, 9, 3, 4.0).select(*KEY, "kind", "n_tap", "n_spray")


@query
def merge_keep_louder(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(peaks.keep_louder(of_kind(spark, sf, "signup", "error").select(*KEY, F.col("m").alias("time_s"), F.col("value").alias("energy")), 1500.0))


@query
def dedup_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return peaks.anchored_dedup(of_kind(spark, sf, "signup", "purchase").select(*KEY, F.col("m").alias("time_s")), 1440.0)


@query
def vote_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(peaks.vote_clusters(of_kind(spark, sf, "signup", "error", "view").select(*KEY, F.col("m").alias("time_s"), F.col("kind").alias("roi")), 900.0, 2, 1440.0))


@query
def peaks_per_roi(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of each region's signal in each session, counted by region."""
    by = [*KEY, "roi"]
    order = Window.partitionBy(*by).orderBy("us", "event_id")
    rows = events(spark, sf).select(*KEY, F.col("kind").alias("roi"), "us", "event_id", "value").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return peaks.local_maxima(rows, by=by).groupBy("roi").agg(F.count("*").alias("n"))


@query
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The rows behind a calibration chart, by panel: the brightness, its envelope and rises, accepted and rejected peaks, counts, and truths."""
    rows = signals.enveloped(signals.differenced(signal(spark, sf)), {"envelope": 5})
    long = automaton.stabilized(rows).select(*KEY, "idx", F.inline(F.array(*[F.struct(F.lit(n).alias("panel"), F.col(c).cast("double").alias("value")) for n, c in (("brightness", "value"), ("envelope", "envelope"), ("rise", "rise"), ("count", "stable"), ("count_raw", "raw"))])))
    rise = rows.select(*KEY, "idx", F.col("rise").alias("value"))
    found = peaks.find_peaks(rise, distance=3, prominence=30.0)
    raw = peaks.find_peaks(rows, height=40.0, distance=3)
    accepted = peaks.narrow(raw, rows, 40.0, 2)
    marks = {"kill_peak": found, "shot": accepted, "shot_rejected": peaks.rejected(raw, accepted)}
    drops = automaton.decrements(automaton.stabilized(rows), "stable").select(*KEY, "idx", F.lit("count_kill").alias("panel"), F.col("stable").cast("double").alias("value"))
    truth = rows.where("kind = 'purchase'").select(*KEY, "idx", F.lit("truth").alias("panel"), F.lit(None).cast("double").alias("value"))
    made = long.where("value is not null").unionByName(drops).unionByName(truth)
    for panel, peak in marks.items():
        made = made.unionByName(peak.select(*KEY, "idx", F.lit(panel).alias("panel"), F.col("height").cast("double").alias("value")))
    return rounded(made)


# matching


@query
def fuse_asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    truth = minutes(spark, sf, "purchase")
    last = minutes(spark, sf, "click").select(*KEY, F.col("time_s").alias("shot"))
    met = asof.asof(truth, last, KEY, "time_s", "shot", ["shot"], "backward", tolerance=720, width=1 << 16)
    return met.select(*KEY, "time_s", F.coalesce("shot", "time_s").alias("fused"))


@query
def refinement_count(spark: SparkSession, sf: str) -> DataFrame:
    fused = fuse_asof_backward(spark, sf)
    return fused.groupBy(*KEY).agg(F.count_if(F.col("fused") != F.col("time_s")).alias("n_refined"), F.max(F.col("time_s") - F.col("fused")).alias("largest"))


@query
def fuse_band(spark: SparkSession, sf: str) -> DataFrame:
    return matching.greedy_in_order(*both(spark, sf), 1440, first=True)


@query
def align_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    return matching.full_outer_alignment(*both(spark, sf), 1440)


@query
def aligned_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The alignment's rows as numbered in a report: by the audio's time, or else the count's; detections are in video time, an hour after the demo's."""
    det, truth = both(spark, sf)
    moved = scalars.to_demo(det.withColumn("time_s", F.col("time_s") + 60), 60)
    rows = matching.full_outer_alignment(moved, truth, 1440)
    order = Window.partitionBy(*KEY).orderBy(F.coalesce("audio_time", "time"), "match_status", "time")
    return rows.withColumn("row", F.row_number().over(order).cast("long")).withColumn("video_time", scalars.video_time("time", 60))


@query
def alignment_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = matching.full_outer_alignment(*both(spark, sf), 1440)
    n = {s: F.count_if(F.col("match_status") == s) for s in ("matched", "bot_count_only", "audio_only")}
    made = rows.groupBy(*KEY).agg(*[c.alias(f"n_{s}") for s, c in n.items()], F.avg(F.abs("delta")).alias("mean_abs_delta"), F.median("delta").alias("median_delta"))
    total = F.col("n_matched") + F.col("n_audio_only")
    rate = F.when(total > 0, 100.0 * F.col("n_matched") / total).otherwise(0.0)
    return rounded(made.withColumn("rate", rate).withColumn("passes", rate >= 85))


@query
def greedy_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return matching.greedy_in_order(*both(spark, sf), 1440)


@query
def greedy_closest_pair(spark: SparkSession, sf: str) -> DataFrame:
    return matching.closest_pairs(*both(spark, sf), 1440)


@query
def optimal_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return matching.optimal_assignment(*both(spark, sf), 1440)


@query
def min_cost_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return matching.optimal_assignment(*both(spark, sf), 1440, most=False)


@query
def optimal_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the optimal pairs, without an offset."""
    det, truth = both(spark, sf)
    return rounded(matching.scored(det, truth, matching.optimal_assignment(det, truth, 1440), scale=60.0))


#: A unit of time is 12 minutes: offsets of 700 units either way in steps of ten, then 50 about the best of them in single ones, pairs within 50.
COARSE, FINE = range(-8400, 8400, 120), range(-600, 600, 12)


@query
def offset_search(spark: SparkSession, sf: str) -> DataFrame:
    return matching.offset_search(*both(spark, sf), COARSE, FINE, 600)


@query
def validated_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each session's offset, and the scores of the optimal pairs of the detections that it is taken off."""
    det, truth = both(spark, sf)
    offsets = matching.offset_search(det, truth, COARSE, FINE, 600)
    moved = matching.shifted(det, offsets)
    made = matching.scored(moved, truth, matching.optimal_assignment(moved, truth, 540), scale=60.0)
    return rounded(made.join(offsets.drop("best_tp"), KEY))


@query
def offset_grid(spark: SparkSession, sf: str) -> DataFrame:
    return matching.offset_grid(*both(spark, sf), list(range(-600, 601, 120)), 360)


@query
def offset_xcorr(spark: SparkSession, sf: str) -> DataFrame:
    det, truth = both(spark, sf)
    return rounded(matching.matches_at(det, truth, matching.offset_correlation(det, truth, 600, 60, 90.0), 180))


@query
def nearest_diag(spark: SparkSession, sf: str) -> DataFrame:
    det, truth = both(spark, sf)
    return asof.nearest(det, truth, KEY, "time_s", "time_s")


@query
def misses_diag(spark: SparkSession, sf: str) -> DataFrame:
    """Truths without a detection, with the nearest detection of any kind and how far it is."""
    det, truth = both(spark, sf)
    missed = truth.join(matching.closest_pairs(det, truth, 1440).select(*KEY, F.col("truth_time").alias("time_s")), [*KEY, "time_s"], "left_anti")
    return asof.nearest(missed, det, KEY, "time_s", "time_s")


@query
def in_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    return matching.in_range(*both(spark, sf), 60)


@query
def out_of_range(spark: SparkSession, sf: str) -> DataFrame:
    return matching.in_range(*both(spark, sf), 60, outside=True)


@query
def tp_fp_fn_labels(spark: SparkSession, sf: str) -> DataFrame:
    det, truth = both(spark, sf)
    return matching.labelled(det, truth, matching.closest_pairs(det, truth, 1440))


@query
def match_scores(spark: SparkSession, sf: str) -> DataFrame:
    det, truth = both(spark, sf)
    return rounded(matching.scored(det, truth, matching.closest_pairs(det, truth, 1440), scale=60.0))


@query
def pass_gates(spark: SparkSession, sf: str) -> DataFrame:
    det, truth = both(spark, sf)
    made = matching.scored(det, truth, matching.closest_pairs(det, truth, 1440))
    return rounded(made.select(*KEY, ((F.col("recall") >= 60) & (F.col("precision") >= 60)).alias("passes")))


@query
def signal_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of three kinds of detection, each session's offset found and taken off first."""
    truth = minutes(spark, sf, "purchase")
    one, two = minutes(spark, sf, "signup"), minutes(spark, sf, "error")
    merged = peaks.anchored_dedup(one.unionByName(two), 200.0).withColumn("time_s", F.col("time_s").cast("long"))
    by = ["signal", *KEY]
    det = one.withColumn("signal", F.lit("delta")).unionByName(two.withColumn("signal", F.lit("red"))).unionByName(merged.withColumn("signal", F.lit("merged")))
    truths = truth.withColumn("signal", F.explode(F.array(*[F.lit(s) for s in ("delta", "red", "merged")])))
    offsets = matching.offset_correlation(det, truths, 600, 60, 90.0, by=by)
    kept = matching.in_range(matching.shifted(det, offsets, by=by), truths, 60, by=by)
    pairs = matching.closest_pairs(kept, truths, 720, by=by)
    error = F.abs(F.col("det_time") - F.col("truth_time"))  # at most 720 values
    found = pairs.groupBy("signal").agg(F.count("*").alias("tp"), F.median(error).alias("median_error"))
    totals = kept.groupBy("signal").agg(F.count("*").alias("n_det")).join(truths.groupBy("signal").agg(F.count("*").alias("n_gt")), "signal").join(found, "signal")
    return rounded(totals.select("signal", "n_det", "n_gt", "tp", *matching.rates("tp", "n_det", "n_gt"), "median_error"))


@query
def error_hist(spark: SparkSession, sf: str) -> DataFrame:
    return matching.error_histogram(matching.closest_pairs(*both(spark, sf), 1440).withColumn("session_id", F.col("session_id") % 10), 30)


@query
def running_scoreboard(spark: SparkSession, sf: str) -> DataFrame:
    det, truth = both(spark, sf)
    return rounded(timeline.scoreboard(matching.labelled(det, truth, matching.closest_pairs(det, truth, 1440))))


# labels and the automaton


def changes(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf).withColumn("label", F.when(F.col("k") % 11 != 0, (8 + F.floor(F.col("k") / 40) * 2).cast("int")))
    return automaton.transitions(rows, 2, 8, 0.5)


@query
def state_machine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(changes(spark, sf))


@query
def sanity(spark: SparkSession, sf: str) -> DataFrame:
    made = automaton.sanity(changes(spark, sf), 5.0, 50.0, (8, 9, 10, 11), 3.0, 20)
    return rounded(made.withColumn("bad_states", F.array_join(F.col("bad_states").cast("array<string>"), ",")))


@query
def set_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = changes(spark, sf)
    seen = rows.select(F.col("from_count").alias("state")).union(rows.select("to_count")).distinct()
    return rounded(seen.exceptAll(spark.createDataFrame([(8,), (9,), (10,)], "state int")))


@query
def challenge_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = changes(spark, sf).where((F.col("direction") == "kill") & F.col("time_s").between(5.0, 40.0))
    return rounded(rows.select(*KEY, "time_s", "from_count"))


@query
def decrement_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(automaton.decrements(signal(spark, sf)).select(*KEY, "idx", "label"))


@query
def stabilize_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(automaton.stabilized(signal(spark, sf)).select(*KEY, "idx", "stable"))


@query
def step_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(automaton.step_counts(signal(spark, sf)))


@query
def step_segments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(automaton.segments(signal(spark, sf)).select(*KEY, "label", "start", "end"))


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", (8 + F.col("k") % 5).alias("truth"), F.when(F.col("k") % 11 != 0, 8 + F.col("event_id") % 5).alias("pred"), F.when(F.col("k") % 3 == 0, "high").otherwise("medium").alias("confidence"))


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return automaton.confusion(evaluated(spark, sf), "truth", "pred", [8, 9, 10, 11, 12])


@query
def accuracy_by_conf(spark: SparkSession, sf: str) -> DataFrame:
    right = F.avg(F.when(automaton.correct("truth", "pred"), 100.0).otherwise(0.0))
    return rounded(evaluated(spark, sf).groupBy("confidence").agg(F.count("*").alias("n"), right.alias("accuracy")))


@query
def disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).where(~automaton.correct("truth", "pred")).orderBy("event_id").limit(20)


@query
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).groupBy("truth", "confidence").agg(F.count("*").alias("n"))


@query
def benchmark_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf)
    wanted = rows.where("kind = 'click'").select(*KEY, F.col("idx").alias("frame_n"))
    rows = rows.where("kind = 'view'").select(*KEY, F.col("idx").alias("frame_n"), "label")
    return rounded(automaton.benchmark_lookup(wanted, rows))


@query
def json_label(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit('{"label": '), F.when(F.col("k") % 4 == 0, F.lit('"unclear"')).otherwise((F.col("k") % 16).cast("string")), F.lit(', "confidence": "high", "notes": "n'), F.col("k"), F.lit('"}'))
    reply = F.when(F.col("k") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rounded(events(spark, sf).select("event_id", scalars.checked_label(reply).alias("l")).select("event_id", "l.*"))


# timelines


@query
def step_lookup(spark: SparkSession, sf: str) -> DataFrame:
    steps = of_kind(spark, sf, "signup").groupBy(*KEY, F.col("m").alias("time_s")).agg(F.max("k").alias("k"))
    return timeline.step_value(minutes(spark, sf, "purchase"), steps, "k")


def spans(spark: SparkSession, sf: str) -> DataFrame:
    made = engagements(spark, sf)
    return made.select(*KEY, "engagement_id", (F.col("engagement_start_s") * 64).alias("start"), ((F.col("engagement_start_s") + F.col("ttff_ms") / 1000) * 64).alias("first_shot"))


def motion(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("kind = 'error'").groupBy(*KEY, F.col("tick").cast("double").alias("time_s")).agg(F.max("value").alias("motion"))


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """session_id, engagement_id, start (the kill before, or else the first shot), first_shot."""
    ticks = engagement.attach_shots(shots(spark, sf), kills(spark, sf)).where("engagement_id is not null").groupBy(*KEY, "engagement_id").agg(F.min("tick").alias("first_shot"), F.first("prev_kill_tick").alias("prev"))
    return ticks.select(*KEY, "engagement_id", F.coalesce("prev", "first_shot").cast("double").alias("start"), F.col("first_shot").cast("double").alias("first_shot"))


@query
def range_window_frames(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeline.window_frames(motion(spark, sf), windows(spark, sf), 0.0, 16.0).select(*KEY, "engagement_id", "time_s", "motion"))


@query
def motion_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeline.motion_profile(motion(spark, sf), windows(spark, sf), 2.0, 0.0, 16.0))


@query
def settle_time(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeline.settle_time(motion(spark, sf), 10.0))


def acquired(spark: SparkSession, sf: str) -> DataFrame:
    made, by = windows(spark, sf), [*KEY, "engagement_id"]
    found = timeline.settle_time(timeline.window_frames(motion(spark, sf), made, 0.0, 16.0), 10.0, by=by)
    return timeline.acquisition_metrics(timeline.with_degenerate(made.join(found, by, "left"), 1.0))


@query
def acquisition(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(acquired(spark, sf).select(*KEY, "engagement_id", "acquired", "acquisition_ms", "true_ttff_ms"))


@query
def acquisition_means(spark: SparkSession, sf: str) -> DataFrame:
    ttff = F.bround((F.col("first_shot") - F.col("start")) * 1000, 1)
    return rounded(acquired(spark, sf).groupBy(*KEY).agg(F.avg("true_ttff_ms").alias("mean_true_ttff_ms"), F.avg(ttff).alias("mean_ttff_ms")))


@query
def running_tally(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.tally(minutes(spark, sf, "purchase"), of_kind(spark, sf, "click").select(*KEY, F.col("m").alias("time_s")))


@query
def visible_events(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.visible(minutes(spark, sf, "purchase"), minutes(spark, sf, "signup"), 4320, 7200)


@query
def latest_event(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.latest(minutes(spark, sf, "purchase"), minutes(spark, sf, "signup"), 2160)


@query
def within_duration(spark: SparkSession, sf: str) -> DataFrame:
    det, truth = both(spark, sf)
    return timeline.within_duration(det, truth.groupBy(*KEY).agg(F.max("time_s").alias("duration")))


@query
def last_events(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.tail(events(spark, sf).select(*KEY, "event_id", "us"), 20, "us", "event_id")


@query
def proximity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeline.proximity(minutes(spark, sf, "purchase"), minutes(spark, sf, "signup"), 900.0, 600.0))


@query
def pulse_decay(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(timeline.pulse(automaton.stabilized(signal(spark, sf)), "stable").select(*KEY, "idx", "pulse"))


@query
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = signal(spark, sf).select(*KEY, F.col("idx").alias("frame_n"), "value")
    return rounded(timeline.even_sample(rows, 10))


# scalars


@query
def ocr_normalize(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("p_name", "p_size")
    return rounded(read(spark, sf, "part").select("p_partkey", scalars.read_digits(text).alias("digits"), scalars.read_count(text).alias("n")))


@query
def parse_ratio(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size"), F.lit(" / 100"))).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ammo "), F.col("p_size"), F.lit("|90"))).otherwise("none")
    return rounded(read(spark, sf, "part").select("p_partkey", scalars.of_hundred(text).alias("kills"), scalars.first_number(text).alias("ammo")))


@query
def roi_resolve(spark: SparkSession, sf: str) -> DataFrame:
    box = scalars.corners(0.5063, 0.06, 0.5235, 0.0775, F.col("c_custkey") + 640, F.col("c_custkey") % 700 + 360)
    return rounded(read(spark, sf, "customer").select("c_custkey", box.alias("b")).select("c_custkey", "b.*"))


@query
def digit_classify(spark: SparkSession, sf: str) -> DataFrame:
    profile = F.transform(F.slice("embedding", 1, 15), lambda x: F.floor(F.abs(x) * 40).cast("int"))
    return rounded(read(spark, sf, "embeddings").select("vec_id", scalars.classify_profile(profile).alias("digit")))


@query
def scanned_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Frames classified one by one, and the confirmed changes of what they show."""
    profile = F.transform(F.slice("embedding", 1, 15), lambda x: F.floor(F.abs(x) * 40).cast("int"))
    frames_ = read(spark, sf, "embeddings").select(F.expr("vec_id div 50").alias("session_id"), F.col("vec_id").alias("idx"), F.col("vec_id").cast("double").alias("time_s"), scalars.classify_profile(profile).alias("label"))
    return rounded(automaton.transitions(frames_, 2, 8, 0.5))


@query
def axis_maps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(events(spark, sf).select("event_id", scalars.to_pixel(F.col("value"), 0.0, 500.0, 40, 1280).alias("x"), scalars.confidence_bar(1 + F.col("value") / 100, 90).alias("bar")))


@query
def tick_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).groupBy(*KEY).agg(F.sum("k").alias("ticks"), (F.count("*") / 2).alias("seconds"))
    return rounded(rows.select(*KEY, scalars.tick_rate(F.when(F.col("session_id") % 5 != 0, F.col("ticks")), F.col("seconds")).alias("rate")))


# streams, run over what the source has now


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.table_stream(spark, sf, "events")
    return rows.withColumn("us", scalars.epoch_micros("ts")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


@query
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_stream(spark, sf).where(F.col("event_type").isin("signup", "purchase")).select(F.col("user_id").alias("session_id"), F.expr("us div 60000000").cast("double").alias("time_s"))
    return live.drained(live.live_dedup(rows, 1440.0), "dedup")


@query
def stream_transitions(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("k") % 11 != 0, 8 + F.floor(F.col("k") / 40) * 2)
    rows = event_stream(spark, sf).select(F.col("user_id").alias("session_id"), F.col("us").cast("double").alias("time_s"), label.alias("label"))
    made = live.drained(live.live_transitions(rows), "transitions")
    return rounded(made.select(*KEY, F.col("time_s").cast("long").alias("us"), "from_count", "to_count"))


@query
def stream_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_stream(spark, sf).select(F.col("user_id").alias("session_id"), F.col("us").cast("double").alias("time_s"), "value")
    made = live.drained(live.live_delta(rows), "delta")
    return rounded(made.select(*KEY, F.col("time_s").cast("long").alias("us"), "delta"))


@query
def stream_energy(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that a day's watermark has closed: those that end a day before the last event, or earlier."""
    rows = event_stream(spark, sf).select(F.col("user_id").alias("session_id"), F.timestamp_micros("us").alias("ts"), "value")
    made = live.drained(live.live_energy(rows, "2 days", "1 day", "1 day"), "energy")
    return rounded(made.select(*KEY, F.unix_micros("start").alias("start_us"), "energy", "n"))


@query
def stream_fusion(spark: SparkSession, sf: str) -> DataFrame:
    def of(kind: str) -> DataFrame:
        return event_stream(spark, sf).where(F.col("event_type") == kind).select(F.col("user_id").alias("session_id"), F.timestamp_micros("us").alias("ts"))

    made = live.drained(live.live_fusion(of("purchase"), of("click"), "12 hours", "1 day"), "fusion")
    return made.select(*KEY, F.unix_micros("kill_ts").alias("kill_us"), F.unix_micros("shot_ts").alias("shot_us"))


@query
def stream_last_shot(spark: SparkSession, sf: str) -> DataFrame:
    """Kills that end four days before the last event, or earlier: all of these the watermark has passed."""

    def of(kind: str) -> DataFrame:
        return event_stream(spark, sf).where(F.col("event_type") == kind).select(F.col("user_id").alias("session_id"), F.timestamp_micros("us").alias("ts"))

    made = live.drained(live.live_last_shot(of("purchase"), of("click"), "12 hours", "1 day"), "last-shot")
    rows = made.select(*KEY, F.unix_micros("kill_ts").alias("kill_us"), F.unix_micros("fused_ts").alias("fused_us"))
    return rows.join(events(spark, sf).agg((F.max("us") - 4 * 86_400_000_000).alias("_end")).hint("broadcast"), F.col("kill_us") <= F.col("_end")).drop("_end")  # one row


@query
def stream_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Change of each embedding since the one before, of 50 that follow each other."""
    rows = live.table_stream(spark, sf, "embeddings")
    frames = rows.select(F.expr("vec_id div 50").alias("session_id"), F.col("vec_id").alias("time_s"), F.col("embedding").alias("patch"))
    made = live.drained(live.live_patch_delta(frames), "patches")
    return rounded(made.select(F.col("time_s").cast("long").alias("vec_id"), "delta"))


@query
def stream_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Kept events and confirmed changes by time, of what a day's watermark has passed: up to a day before the last event."""
    rows = event_stream(spark, sf).select(F.col("user_id").alias("session_id"), F.timestamp_micros("us").alias("ts"), F.when(F.col("k") % 11 != 0, 8 + F.floor(F.col("k") / 40) * 2).alias("label"))
    made = live.drained(live.live_in_order(rows, live.Transitions(), "1 day", 3 * 86_400.0, "label"), "in-order")
    return rounded(made.select(*KEY, F.round(F.col("time_s") * 1e6).cast("long").alias("us"), "from_count", "to_count"))


# pixels


@query
def otsu_levels(spark: SparkSession, sf: str) -> DataFrame:
    values = F.transform("embedding", lambda x: F.least(F.floor(F.abs(x) * 512), F.lit(255)).cast("int"))
    return rounded(read(spark, sf, "embeddings").select("vec_id", frames.otsu_threshold(values).alias("level")))


@query
def column_profiles(spark: SparkSession, sf: str) -> DataFrame:
    mask = F.transform(frames.fixed_threshold(F.transform("embedding", lambda x: F.abs(x) * 512), 60), lambda v: (v > 0).cast("int"))
    sums = frames.column_sums(frames.blanked(mask, 16), 16)
    return read(spark, sf, "embeddings").select("vec_id", F.array_join(sums.cast("array<string>"), ",").alias("profile"))
