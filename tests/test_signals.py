"""Peaks, signals and the automaton against plain Python on random input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, automaton, engagement, frames, peaks, signals, timeline


def signal(spark, sessions):
    return spark.createDataFrame([(s, i, float(i), v) for s, x in sessions.items() for i, v in enumerate(x)], "session_id string, idx long, time_s double, value double")


def maxima(x):
    found, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    return found


def thinned(x, found, distance):
    kept = []
    for i in sorted(found, key=lambda i: (-x[i], -i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return sorted(kept)


def prominence(x, i):
    sides = []
    for part in (x[:i][::-1], x[i + 1 :]):
        low = x[i]
        for v in part:
            if v > x[i]:
                break
            low = min(low, v)
        sides.append(low)
    return x[i] - max(sides)


def test_find_peaks(spark):
    rng = random.Random(1)
    sessions = {f"s{i}": [float(rng.randrange(8)) for _ in range(rng.randrange(1, 40))] for i in range(30)}
    df = signal(spark, sessions)
    found = peaks.find_peaks(df, height=3.0, distance=4, prominence=2.0).collect()
    for s, x in sessions.items():
        kept = thinned(x, [i for i in maxima(x) if x[i] >= 3], 4)
        expected = [(i, prominence(x, i)) for i in kept if prominence(x, i) >= 2]
        assert sorted((r["idx"], r["prominence"]) for r in found if r["session_id"] == s) == expected


def test_dedup_keeps_its_anchor(spark):
    df = spark.createDataFrame([("s", t) for t in (0.0, 0.15, 0.3)], "session_id string, time_s double")
    assert sorted(r["time_s"] for r in peaks.anchored_dedup(df, 0.2).collect()) == [0.0, 0.3]


def test_louder_peak_moves_the_anchor(spark):
    df = spark.createDataFrame([("s", 0.0, 1.0), ("s", 0.1, 2.0), ("s", 0.2, 1.5), ("s", 0.25, 0.5)], "session_id string, time_s double, energy double")
    assert [(r["time_s"], r["energy"]) for r in peaks.keep_louder(df, 0.12).orderBy("time_s").collect()] == [(0.1, 2.0), (0.25, 0.5)]


def test_boxcar_and_energy_match_numpy(spark):
    x = np.random.default_rng(2).normal(size=50)
    df = signal(spark, {"s": x.tolist()})
    for width in (3, 4):
        made = [r["e"] for r in df.select("idx", signals.boxcar(width).alias("e")).orderBy("idx").collect()]
        assert made == pytest.approx(np.convolve(x, np.ones(width) / width, "same").tolist())
    chunk = spark.createDataFrame([("s", x.tolist())], "session_id string, samples array<double>")
    rows = signals.rms_energy(chunk, rate=1000, window_ms=8, hop_ms=4).orderBy("frame").collect()
    assert len(rows) == (50 - 8) // 4
    assert [r["energy"] for r in rows] == pytest.approx([float(np.sqrt(np.mean(x[i * 4 : i * 4 + 8] ** 2))) for i in range((50 - 8) // 4)])


def test_pool_drops_the_trailing_part(spark):
    made = signals.pooled(signal(spark, {"s": [9.0, 1.0, 2.0, 3.0, 8.0]}), 2).orderBy("bucket").collect()
    assert [(r["bucket"], r["peak"]) for r in made] == [(0, 0.0), (1, 2.0), (2, 8.0)]


def labels(spark, values):
    return spark.createDataFrame([("s", i, i / 10, v) for i, v in enumerate(values)], "session_id string, idx long, time_s double, label int")


def steps(df):
    return [(r["from_count"], r["to_count"], r["delta"], r["multi_step"]) for r in df.orderBy("time_s", F.desc("from_count")).collect()]


def test_automaton(spark):
    assert steps(automaton.transitions(labels(spark, [12, 12, 11, None, 11, 12]))) == [(12, 11, -1, False)]
    assert steps(automaton.transitions(labels(spark, [12, 10, 10]))) == [(12, 11, -1, True), (11, 10, -1, True)]
    assert steps(automaton.transitions(labels(spark, [12, 11] + [None] * 7 + [11]))) == [(12, 11, -1, False)]
    assert steps(automaton.transitions(labels(spark, [12, 11] + [None] * 8 + [11]))) == []


def test_automaton_against_a_loop(spark):
    rng = random.Random(6)
    sessions = {f"s{i}": [rng.choice([10, 11, 12, None, None]) if rng.random() < 0.5 else 11 for _ in range(40)] for i in range(20)}
    df = spark.createDataFrame([(s, i, float(i), v) for s, x in sessions.items() for i, v in enumerate(x)], "session_id string, idx long, time_s double, label int")
    found = automaton.transitions(df, 2, 3).groupBy("session_id").agg(F.count("*").alias("n")).collect()
    made = {r["session_id"]: r["n"] for r in found}
    for s, x in sessions.items():
        state = candidate = None
        run = nones = n = 0
        for v in x:
            if v is None:
                nones += 1
                if nones >= 3:
                    candidate, run = None, 0
                continue
            nones = 0
            if state is None:
                state = v
            elif v == state:
                candidate, run = None, 0
            else:
                run = run + 1 if v == candidate else 1
                candidate = v
                if run >= 2:
                    n += abs(state - v)
                    state, candidate, run = v, None, 0
        assert made.get(s, 0) == n


def test_stabilized(spark):
    def stable(raw):
        df = spark.createDataFrame([("s", i, v) for i, v in enumerate(raw)], "session_id string, idx long, raw int")
        return [r["stable"] for r in automaton.stabilized(df).orderBy("idx").collect()]

    assert stable([12, 1, 12]) == [12, 12, 12]
    assert stable([11, 11, 1, 12, 12]) == [11, 11, 11, 12, 12]
    assert stable([None, 7, None]) == [12, 12, 12]
    assert stable([0, 0, 2, 2]) == [10, 10, 12, 12]


def test_two_kills_on_one_tick_use_two_numbers(spark):
    kills = spark.createDataFrame([("s", 1, 10, True, "a"), ("s", 2, 10, False, "b"), ("s", 3, 20, True, "c")], "session_id string, event_id long, tick long, headshot boolean, weapon string")
    shots = spark.createDataFrame([("s", 4, 8), ("s", 5, 18), ("s", 6, 19), ("s", 7, 30)], "session_id string, event_id long, tick long")
    hits = spark.createDataFrame([("s", 8, 19, 30, 1)], "session_id string, event_id long, tick long, damage long, hit_group long")
    rows = engagement.engagement_map(shots, hits, kills).orderBy("engagement_id").collect()
    assert [r["engagement_id"] for r in rows] == [1, 3]
    assert rows[0]["weapon"] == "b"  # the last kill row of the tick
    assert rows[1]["hit_sequence"] == "Y,M"  # a hit serves one shot
    assert rows[1]["damage_dealt"] == 60  # but its damage counts for each
    assert rows[1]["ttff_ms"] == 125.0


def test_settle_time(spark):
    def acquired(motion):
        df = spark.createDataFrame([("s", float(i), m) for i, m in enumerate(motion)], "session_id string, time_s double, motion double")
        return timeline.settle_time(df).first()["acquired"]

    assert acquired([9.0, 2.0, 9.0, 3.0, 1.0, 8.0]) == 3.0
    assert acquired([9.0, 7.0, 8.0]) == 1.0


def test_nearest(spark):
    left = spark.createDataFrame([("s", 5.0), ("s", 0.0), ("t", 1.0)], "session_id string, time_s double")
    right = spark.createDataFrame([("s", 4.0), ("s", 6.0)], "session_id string, time_s double")
    made = {(r["session_id"], r["time_s"]): r["nearest"] for r in asof.nearest(left, right, ["session_id"], "time_s", "time_s").collect()}
    assert made == {("s", 5.0): 4.0, ("s", 0.0): 4.0, ("t", 1.0): None}


def test_blur_keeps_a_flat_patch():
    assert frames.blurred(np.full((5, 7), 3.0), 3.0) == pytest.approx(np.full((5, 7), 3.0))


def test_digit_profile(spark):
    patch = np.zeros((6, 8))
    patch[:, 2] = 200
    df = spark.createDataFrame([(patch.reshape(-1).tolist(),)], "patch array<double>")
    assert df.select(frames.digit_profile(8)("patch").alias("p")).first()["p"] == [0, 0, 6, 0, 0, 0, 0, 0]


def test_enlarged(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "v array<int>")
    assert df.select(frames.enlarged(F.col("v"), 2, 2, 2).alias("e")).first()["e"] == [1, 1, 2, 2, 1, 1, 2, 2, 3, 3, 4, 4, 3, 3, 4, 4]
