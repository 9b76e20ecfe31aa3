"""Thinning by distance over blocks against the plain rule, tallest first."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import peaks, thinning


def plain(peaks, distance):
    kept = []
    for i, h in sorted(peaks, key=lambda p: (-p[1], -p[0])):
        if all(abs(i - k) >= distance for k, _ in kept):
            kept.append((i, h))
    return sorted(kept)


def shape(rng, kind, n):
    """Random heights, ramps both ways, a hill, equal heights, saw teeth."""
    if kind == "ramp":
        return [float(i) for i in range(n)]
    if kind == "fall":
        return [float(-i) for i in range(n)]
    if kind == "hill":
        return [float(-abs(i - n // 2)) for i in range(n)]
    if kind == "flat":
        return [1.0] * n
    if kind == "saw":
        return [float(i % 7) for i in range(n)]
    return [float(rng.randrange(6)) for _ in range(n)]


@pytest.mark.parametrize("distance, block", [(1, 8), (3, 8), (4, 16), (7, 64), (5, None)])
def test_blocks_choose_as_the_whole(spark, distance, block):
    rng = random.Random(distance)
    sessions = {}
    for n, kind in enumerate(["ramp", "fall", "hill", "flat", "saw", "any", "any", "any", "any"]):
        places = sorted(rng.sample(range(400), rng.choice([1, 60, 150])))
        sessions[f"s{n}"] = list(zip(places, shape(rng, kind, len(places)), strict=True))
    df = spark.createDataFrame([(s, i, h) for s, x in sessions.items() for i, h in x], "session_id string, idx long, height double")
    made = thinning.thinned(df, distance, ["session_id"], block).collect()
    for s, x in sessions.items():
        assert sorted((r["idx"], r["height"]) for r in made if r["session_id"] == s) == plain(x, distance)
    assert thinning.thinned(df.limit(0), distance, ["session_id"], block).collect() == []


def test_what_is_decided_in_part_is_right():
    """Of any stretch of a signal, what is decided without the rest is so with the rest too."""
    rng = random.Random(11)
    for _ in range(300):
        places = sorted(rng.sample(range(150), rng.randrange(1, 90)))
        heights = shape(rng, rng.choice(["ramp", "fall", "hill", "flat", "saw", "any"]), len(places))
        distance = rng.randrange(1, 9)
        kept = {i for i, _ in plain(list(zip(places, heights, strict=True)), distance)}
        low, high = sorted(rng.sample(range(-1, 151), 2))
        part = [n for n, i in enumerate(places) if low < i < high]
        idx, height = np.array([places[n] for n in part], np.int64), np.array([heights[n] for n in part], float)
        state = thinning.decided(idx, height, np.zeros(len(part), bool), distance, low, high)
        for i, s in zip(idx.tolist(), state.tolist(), strict=True):
            assert s == thinning.OPEN or (s == thinning.KEPT) == (i in kept)


def test_a_million_peaks_in_one_session(spark):
    """Random heights, and a ramp, whose peaks hang on each other from end to end."""
    n = 1_000_000
    for height in (F.rand(3), F.col("id").cast("double")):
        peaks = spark.range(n).select(F.lit("s").alias("session_id"), (F.col("id") * 2).alias("idx"), height.alias("height"))
        start = time.perf_counter()
        row = thinning.thinned(peaks, 20, ["session_id"]).agg(F.count("*").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high")).first()
        assert time.perf_counter() - start < 60
        assert n / 20 < row["n"] <= n / 10 + 1 and row["low"] < 40 and row["high"] > 2 * n - 41


def test_prominence_of_a_long_session(spark):
    """Samples of many blocks in one session; a ramp with saw teeth, where the next higher sample is near on one side and nowhere on the other."""
    n = 300_000
    teeth = F.when(F.col("id") % 2 == 1, 1.5).otherwise(0.0)
    for value in (F.rand(3), F.col("id") / 10 + teeth):
        signal = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("idx"), value.alias("value"))
        found = peaks.local_maxima(signal)
        start = time.perf_counter()
        row = peaks.with_prominence(found, signal).agg(F.count("*").alias("n"), F.min("prominence").alias("low"), F.max("prominence").alias("high")).first()
        assert time.perf_counter() - start < 90
        assert row["n"] > n / 4 and 0 < row["low"] and row["high"] <= n
