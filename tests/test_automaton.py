"""The confirming automaton by runs, and clean-up by walks, against one loop over each session."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import automaton, peaks


def looped(frames, confirm, none_run, back):
    state, cand, run, nones, made = None, None, 0, 0, []
    for t, x in frames:
        if x is None:
            nones += 1
            if nones >= none_run:
                cand, run = None, 0
            continue
        nones = 0
        if state is None:
            state = x
        elif x == state:
            cand, run = None, 0
        else:
            run = run + 1 if x == cand else 1
            cand = x
            if run >= confirm:
                step = -1 if state > x else 1
                made += [(round(t - back, 4), v, v + step, step, "kill" if step < 0 else "respawn", abs(state - x) > 1) for v in range(state, x, step)]
                state, cand, run = x, None, 0
    return made


@pytest.mark.parametrize("confirm, none_run, block", [(1, 3, 5), (2, 3, 4), (2, 8, 1 << 16), (3, 2, 7), (4, 5, 3)])
def test_runs_tell_what_the_loop_tells(spark, confirm, none_run, block):
    rng = random.Random(confirm * 10 + none_run)
    sessions = {}
    for s in range(25):
        x, held = [], None
        for _ in range(rng.randrange(1, 90)):
            held = rng.choice([held, held, rng.randrange(4), None, None])
            x.append(held)
        sessions[f"s{s}"] = x
    sessions["none"] = [None] * 20
    df = spark.createDataFrame([(s, i, i * 0.5, v) for s, x in sessions.items() for i, v in enumerate(x)], "session_id string, idx long, time_s double, label int")
    made = automaton.transitions(df, confirm, none_run, 0.25, block=block).collect()
    for s, x in sessions.items():
        own = sorted(tuple(r)[1:] for r in made if r["session_id"] == s)
        assert own == sorted(looped([(i * 0.5, v) for i, v in enumerate(x)], confirm, none_run, 0.25))
    assert automaton.transitions(df.limit(0), confirm, none_run).collect() == []


def test_gaps_in_the_order_are_no_frames(spark):
    rows = [("s", i * 1000, float(i), v) for i, v in enumerate([5, 4, None, 4, 4, 5, None, None, None, 5, 5])]
    df = spark.createDataFrame(rows, "session_id string, idx long, time_s double, label int")
    made = sorted(tuple(r)[1:] for r in automaton.transitions(df, 2, 3, block=2500).collect())
    assert made == sorted(looped([(t, v) for _, _, t, v in rows], 2, 3, 0.0))


def test_a_long_session(spark):
    """Two million frames of one session over many blocks; labels change every 100 frames."""
    n = 2_000_000
    frames = spark.range(n).select(F.lit("s").alias("session_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("time_s"), F.when(F.col("id") % 7 > 0, F.floor(F.col("id") / 100) % 3).cast("int").alias("label"))
    start = time.perf_counter()
    row = automaton.transitions(frames).agg(F.count("*").alias("n"), F.count_if("multi_step").alias("m")).first()
    assert time.perf_counter() - start < 90
    changes = n // 100 - 1
    assert (row["n"], row["m"]) == (changes + changes // 3, 2 * (changes // 3))  # from 2 to 0 in two steps


def test_one_chain_of_many_events(spark):
    """Events nearer to each other than the window, so that one anchor leads to the next from end to end."""
    n = 300_000
    events = spark.range(n).select(F.lit("s").alias("session_id"), (F.col("id") * 0.5).alias("time_s"), (F.col("id") % 10).cast("double").alias("energy"), (F.col("id") % 2).cast("string").alias("roi"))
    start = time.perf_counter()
    assert peaks.anchored_dedup(events, 2.0).count() == n // 4
    assert peaks.keep_louder(events, 1.0).agg(F.sum("energy")).first()[0] > 0
    assert peaks.vote_clusters(events, 1.0, 2, 0.5).count() == n // 3
    assert time.perf_counter() - start < 90
    nulls = spark.createDataFrame([("s", None), ("s", 1.0), ("s", 1.5)], "session_id string, time_s double")
    assert [r["time_s"] for r in peaks.anchored_dedup(nulls, 1.0).collect()] == [1.0]
