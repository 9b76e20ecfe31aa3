"""Windows by blocks against windows by session, for any width of block, and their plans."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, blocks, signals, timeline


def sessions(spark, rng, n=12, most=60):
    """Samples with gaps in their places, nulls among their values; sessions of any length, one row included."""
    rows = []
    for s in range(n):
        for idx in sorted(rng.sample(range(200), rng.choice([1, 2, 7, most]))):
            rows.append((f"s{s}", idx, rng.choice([None, None, float(rng.randrange(9))]), float(rng.randrange(50))))
    return spark.createDataFrame(rows, "session_id string, idx long, holes double, value double")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("width", [1, 3, 16, 1000])
def test_any_width_gives_the_same(spark, width):
    df = sessions(spark, random.Random(width))
    by = ["session_id"]
    plain = df.select("*", signals.first_difference().alias("difference"), signals.rises().alias("rise"))
    assert rows(signals.differenced(df, width=width)) == rows(plain)
    assert rows(signals.enveloped(df, {"a": 4, "b": 5}, width=width)) == rows(df.select("*", signals.boxcar(4).alias("a"), signals.boxcar(5).alias("b")))
    assert rows(signals.enveloped(df, {"a": 6}, width=width)) == rows(df.select("*", signals.boxcar(6).alias("a")))
    assert rows(signals.smoothed(df, width=width)) == rows(df.select("*", signals.median3().alias("smooth")))
    assert rows(signals.without_gaps(df, "holes", 7.0, width=width)) == rows(df.withColumn("holes", signals.filled("holes", 7.0)))
    so_far = Window.partitionBy(*by).orderBy("idx").rangeBetween(Window.unboundedPreceding, 0)
    assert rows(blocks.running(df, {"n": F.col("value")}, width=width)) == rows(df.withColumn("n", F.sum("value").over(so_far)))
    patches = df.select("session_id", "idx", F.array("value", "value").alias("patch"))
    assert rows(signals.frame_delta(patches, width=width).select("session_id", "idx", "delta")) == rows(df.select("session_id", "idx", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy(*by).orderBy("idx"))).alias("delta")))


@pytest.mark.parametrize("width", [1, 10, 1000])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_by_blocks(spark, direction, width):
    rng = random.Random(7)
    left = spark.createDataFrame([(f"s{rng.randrange(6)}", n, rng.choice([None, *range(100)])) for n in range(80)], "session_id string, n long, t long")
    right = spark.createDataFrame([(f"s{rng.randrange(6)}", rng.choice([None, *range(100)]), n) for n in range(40)], "session_id string, r long, v long")
    for more in ({}, {"tie": "v"}, {"tie": "v", "tolerance": 9.0}):
        made, plain = (asof.asof(left, right, ["session_id"], "t", "r", ["r"] if not more else ["r", "v"], direction, width=w, **more) for w in (width, None))
        assert rows(made) == rows(plain)


def test_no_window_takes_a_session_of_rows(spark):
    """Each window over all rows is by session and block; those by session alone stand above a filter to edges or an aggregate by block."""
    df = sessions(spark, random.Random(1))
    for made in (blocks.running(df, {"n": F.col("value")}), blocks.carried(df, {"last": F.col("holes")}, ["session_id"], ["idx"])):
        plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
        by_session = [i for i, line in enumerate(plan) if "Window [" in line and "_block" not in line.split("specifiedwindowframe")[-1].split("], [", 1)[1].split("]")[0]]
        assert by_session and all("Aggregate" in plan[i + 1] or "Aggregate" in plan[i + 2] for i in by_session)


def test_tally_and_scores_by_blocks(spark):
    rng = random.Random(5)
    frames, events = (spark.createDataFrame([(f"s{rng.randrange(4)}", float(rng.randrange(60))) for _ in range(70)], "session_id string, time_s double") for _ in range(2))
    assert rows(timeline.tally(frames, events, width=7)) == rows(timeline.tally(frames, events, width=10**6))
    labelled = spark.createDataFrame([(f"s{rng.randrange(3)}", *rng.choice([("detection", "tp"), ("detection", "fp"), ("truth", "fn"), ("truth", "matched")]), float(rng.randrange(40))) for _ in range(90)], "session_id string, side string, label string, t double")
    assert rows(timeline.scoreboard(labelled, width=5)) == rows(timeline.scoreboard(labelled, width=10**6))


@pytest.mark.parametrize("rounds, bins", [(1, 3), (2, 4), (1, 4096)])
def test_percentile_in_rounds(spark, rounds, bins):
    rng = random.Random(bins)
    of = {"one": [5.0], "same": [2.0] * 9, "two": [1.0, 7.0], "nulls": [None, None, 3.0], "wide": [rng.choice([-1e300, 1e-300, 0.0, 1e300]) for _ in range(50)]}
    of |= {f"s{i}": [rng.choice([rng.random() * 10**6, float(rng.randrange(4))]) for _ in range(rng.randrange(1, 200))] for i in range(8)}
    df = spark.createDataFrame([(s, v) for s, x in of.items() for v in x], "session_id string, value double")
    for percent in (0, 12.5, 50, 98.7, 100):
        made, plain = ({r["session_id"]: r["threshold"] for r in signals.percentile_threshold(df, percent, rounds=n, bins=bins).collect()} for n in (rounds, 0))
        assert made == pytest.approx(plain, rel=1e-12)
