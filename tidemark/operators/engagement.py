"""Shots, hits and kills to engagements, and engagements to session figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import share, tick_millis, tick_seconds
from tidemark.operators.asof import asof, islands, range_join

KEY = ["session_id"]


def modal_actor(events: DataFrame, actor: str = "actor", order: str = "us") -> DataFrame:
    """session_id, actor: the most frequent actor of each session, of equals the one seen first; nulls are none."""
    counted = events.where(F.col(actor).isNotNull()).groupBy(*KEY, actor).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counted.groupBy(*KEY).agg(F.min_by(actor, F.struct(-F.col("n"), "first_seen")).alias(actor))


def of_actor(events: DataFrame, chosen: DataFrame, actor: str = "actor") -> DataFrame:
    """Events of the chosen actor; sessions without one keep all."""
    wanted = chosen.select(*KEY, F.col(actor).alias("_actor"))
    return events.join(wanted, KEY, "left").where(F.col("_actor").isNull() | (F.col(actor) == F.col("_actor"))).drop("_actor")


def numbered_kills(kills: DataFrame) -> DataFrame:
    """engagement_id, kill_tick, prev_kill_tick: over all kills of a session, those without shots too."""
    order = Window.partitionBy(*KEY).orderBy("tick", "event_id")
    return kills.select(*KEY, F.col("tick").alias("kill_tick"), F.row_number().over(order).alias("engagement_id"), F.lag("tick").over(order).alias("prev_kill_tick"))


def attach_shots(shots: DataFrame, kills: DataFrame) -> DataFrame:
    """Shots with the engagement that they belong to: the first kill at or after them; later shots have none."""
    numbered = numbered_kills(kills)
    return asof(shots, numbered, KEY, "tick", "kill_tick", ["engagement_id", "kill_tick", "prev_kill_tick"], "forward", tie="engagement_id")


def hit_metadata(hits: DataFrame) -> DataFrame:
    """Damage of all hits at a tick, and the group of the first."""
    return hits.groupBy(*KEY, F.col("tick").alias("hit_tick")).agg(F.sum("damage").alias("damage"), F.min_by("hit_group", "event_id").alias("hit_group"))


def first_hits(shots: DataFrame, hits: DataFrame, window: int = 8) -> DataFrame:
    """Shots with the first hit tick within the window and its damage; one hit may serve several shots."""
    return asof(shots, hit_metadata(hits), KEY, "tick", "hit_tick", ["hit_tick", "damage"], "forward", tolerance=window)


def match_hits(attached: DataFrame, hits: DataFrame, window: int = 8) -> DataFrame:
    """shot_ticks, flags (Y or M) of each engagement: each shot in turn takes the least hit tick in its window not yet taken."""
    hit_ticks = hits.groupBy(*KEY, F.col("tick").alias("hit_tick")).agg(F.lit(1).alias("one")).drop("one")
    shots = attached.where("engagement_id is not null").groupBy(*KEY, "engagement_id").agg(F.array_sort(F.collect_list("tick")).alias("shot_ticks"))
    spans = shots.select(*KEY, "engagement_id", F.array_min("shot_ticks").alias("_low"), (F.array_max("shot_ticks") + window).alias("_high"))
    near = range_join(hit_ticks, spans.withColumn("_high", F.col("_high") + 1), KEY, "hit_tick", "_low", "_high", 64.0)
    near = near.groupBy(*KEY, "engagement_id").agg(F.array_sort(F.collect_list("hit_tick")).alias("hit_ticks"))
    both = shots.join(near, [*KEY, "engagement_id"], "left").withColumn("hit_ticks", F.coalesce("hit_ticks", F.expr("cast(array() as array<bigint>)")))
    fold = f"""aggregate(shot_ticks, cast(array() as array<bigint>),
        (taken, f) -> concat(taken, array(array_min(filter(hit_ticks, h -> h between f and f + {window} and not coalesce(array_contains(filter(taken, t -> t is not null), h), false))))))"""
    return both.withColumn("taken", F.expr(fold)).withColumn("flags", F.expr("transform(taken, t -> if(t is null, 'M', 'Y'))")).select(*KEY, "engagement_id", "shot_ticks", "flags")


def kill_metadata(kills: DataFrame) -> DataFrame:
    """headshot and weapon of the last kill row at each tick."""
    last = F.max_by(F.struct("headshot", "weapon"), "event_id")
    return kills.groupBy(*KEY, F.col("tick").alias("kill_tick")).agg(last.alias("_m")).select(*KEY, "kill_tick", "_m.headshot", "_m.weapon")


def engagement_map(shots: DataFrame, hits: DataFrame, kills: DataFrame, rate: float = 64.0, window: int = 8) -> DataFrame:
    """One row for each kill with shots: its sixteen figures; kills without shots keep their number but have no row.

    All three kinds are dealt out by session once; what a shot has to do with hits and kills is found by windows over
    the session in order of ticks (at one tick shots, hits, kills), a shot's hits being the few ticks of its own window.
    """
    rows = shots.select(*KEY, "tick", "event_id", F.lit(0).alias("_side"))
    rows = rows.unionByName(hits.select(*KEY, "tick", "event_id", F.lit(1).alias("_side"), "damage"), allowMissingColumns=True)
    rows = rows.unionByName(kills.select(*KEY, "tick", "event_id", F.lit(2).alias("_side"), "headshot", "weapon"), allowMissingColumns=True)
    shot, hit, kill = (F.col("_side") == i for i in range(3))
    by_tick = Window.partitionBy(*KEY).orderBy("tick")
    columns = ("tick", "_side", "event_id")
    up = Window.partitionBy(*KEY).orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*KEY).orderBy(*[F.desc(c) for c in columns]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"engagement_id": F.count_if(kill).over(up) + 1, "prev_kill_tick": F.last(F.when(kill, F.col("tick")), ignorenulls=True).over(up)})
    rows = rows.withColumns(
        {
            "_meta": F.max_by(F.struct("headshot", "weapon"), F.when(kill, F.col("event_id"))).over(by_tick.rangeBetween(0, 0)),
            "_damage": F.sum("damage").over(by_tick.rangeBetween(0, 0)),
            "_hits": F.array_sort(F.collect_set(F.when(hit, F.col("tick"))).over(by_tick.rangeBetween(0, window))),
        }
    )
    rows = rows.withColumns({name: F.last(F.when(side, F.struct("tick", column)), ignorenulls=True).over(down) for name, side, column in (("_kill", kill, "_meta"), ("_hit", hit, "_damage"))})
    joined = (
        rows.where(shot & F.col("_kill").isNotNull())
        .groupBy(*KEY, "engagement_id")
        .agg(
            F.first("_kill.tick").alias("kill_tick"),
            F.first("_kill._meta.headshot").alias("headshot"),
            F.first("_kill._meta.weapon").alias("weapon"),
            F.first("prev_kill_tick").alias("prev_kill_tick"),
            F.min("tick").alias("first_shot"),
            F.count("*").alias("shots_fired"),
            F.coalesce(F.sum(F.when(F.col("_hit.tick") - F.col("tick") <= window, F.col("_hit._damage"))), F.lit(0)).alias("damage_dealt"),
            F.array_sort(F.collect_list(F.struct("tick", "_hits"))).alias("_shots"),  # of one engagement
        )
    )
    free = "array_min(filter(s._hits, h -> not coalesce(array_contains(filter(taken, t -> t is not null), h), false)))"
    flags = F.expr(f"transform(aggregate(_shots, cast(array() as array<bigint>), (taken, s) -> concat(taken, array({free}))), t -> if(t is null, 'M', 'Y'))")
    joined = joined.withColumn("flags", flags).withColumn("shot_ticks", F.col("_shots.tick"))
    start = F.coalesce("prev_kill_tick", "first_shot")
    hit = F.size(F.filter("flags", lambda x: x == "Y"))
    return joined.select(
        *KEY,
        "engagement_id",
        "kill_tick",
        F.bround(tick_seconds(F.col("kill_tick"), rate), 3).alias("kill_time_s"),
        F.bround(tick_seconds(start, rate), 3).alias("engagement_start_s"),
        F.bround(tick_millis(F.col("first_shot") - start, rate), 1).alias("ttff_ms"),
        F.bround(tick_millis(F.col("kill_tick") - F.col("first_shot"), rate), 1).alias("ttk_ms"),
        F.bround(tick_millis(F.col("kill_tick") - start, rate), 1).alias("total_duration_ms"),
        "shots_fired",
        hit.cast("long").alias("shots_hit"),
        (F.col("shots_fired") - hit).alias("shots_missed"),
        share(hit, F.col("shots_fired")).alias("hit_rate"),
        F.coalesce("headshot", F.lit(False)).alias("headshot"),
        "damage_dealt",
        F.coalesce("weapon", F.lit("unknown")).alias("weapon"),
        F.array_join("flags", ",").alias("hit_sequence"),
        F.bround(tick_millis(F.col("first_shot") - F.col("prev_kill_tick"), rate), 1).alias("inter_engagement_gap_ms"),
        F.transform("shot_ticks", lambda t, i: F.struct((i + 1).alias("n"), F.bround(tick_seconds(t, rate), 3).alias("time_s"), F.element_at("flags", i + 1).alias("hit"))).alias("shots"),
    )


def wide_shots(engagements: DataFrame, most: int = 15) -> DataFrame:
    """Columns shot_k_time_s and shot_k_hit for the first shots of an engagement, null beyond the last."""
    columns = []
    for k in range(1, most + 1):
        shot = F.try_element_at("shots", F.lit(k))
        columns += [shot["time_s"].alias(f"shot_{k}_time_s"), shot["hit"].alias(f"shot_{k}_hit")]
    return engagements.select(*[c for c in engagements.columns if c != "shots"], *columns)


def with_one_taps(engagements: DataFrame) -> DataFrame:
    """one_taps: of a one-shot engagement, how many of them follow each other there; else 0."""
    one = F.col("shots_fired") == 1
    change = F.col("shots_fired") != F.lag("shots_fired").over(Window.partitionBy(*KEY).orderBy("engagement_id"))
    runs = islands(engagements, KEY, ["engagement_id"], ~(one & ~change))
    return runs.withColumn("one_taps", F.when(one, F.count("*").over(Window.partitionBy(*KEY, "island"))).otherwise(0)).drop("island")


def one_tap_streak(engagements: DataFrame) -> DataFrame:
    """The longest run of one-shot engagements of each session, 0 if it has none."""
    return with_one_taps(engagements).groupBy(*KEY).agg(F.max("one_taps").alias("best_one_tap_streak"))


def settled(value: Column, digits: int) -> Column:
    """Half-even rounding of a computed mean, its last binary places put right first."""
    return F.bround(F.round(value, 6), digits)


def session_summary(engagements: DataFrame) -> DataFrame:
    """A row of figures for each session with engagements."""
    n = F.count("*")
    figures = with_one_taps(engagements).groupBy(*KEY).agg(
        F.max("one_taps").alias("best_one_tap_streak"),
        n.alias("total_engagements"),
        F.sum("shots_fired").alias("total_shots"),
        F.sum("shots_hit").alias("total_hits"),
        share(F.sum("shots_hit"), F.sum("shots_fired")).alias("overall_hit_rate"),
        share(F.count_if("headshot"), n).alias("headshot_rate"),
        share(F.count_if(F.col("shots_fired") == 1), n).alias("one_tap_rate"),
        settled(F.avg("shots_fired"), 2).alias("mean_shots"),
        *[settled(f, 1).alias(f"{name}_{column}") for column in ("ttff_ms", "ttk_ms", "total_duration_ms") for name, f in (("mean", F.avg(column)), ("median", F.median(column)), ("min", F.min(column)), ("max", F.max(column)))],
        settled(F.stddev_samp("ttff_ms"), 1).alias("std_ttff_ms"),
        settled(F.median("inter_engagement_gap_ms"), 1).alias("median_gap_ms"),
        settled(F.avg("inter_engagement_gap_ms"), 1).alias("mean_gap_ms"),
    )
    return figures.withColumn("ttff_cv", F.when(F.col("mean_ttff_ms") > 0, F.bround(F.col("std_ttff_ms") / F.col("mean_ttff_ms"), 3)))


def rolling_hit_rate(engagements: DataFrame, window: int = 10) -> DataFrame:
    """Mean hit rate of the last `window` engagements, and the session's mean of rates."""
    order = Window.partitionBy(*KEY).orderBy("engagement_id")
    return engagements.select(
        *KEY, "engagement_id", "hit_rate", F.avg("hit_rate").over(order.rowsBetween(1 - window, 0)).alias("rolling_hit_rate"), F.avg("hit_rate").over(Window.partitionBy(*KEY)).alias("session_hit_rate")
    )
