"""Folds by island, and prominences by block, against one fold over all."""

import random

from tidemark.operators import asof, assignment, engagement, matching, peaks, signals, timeline


def sessions(rng, n, most, reach):
    return {f"s{i}": sorted(rng.sample(range(reach), rng.randrange(most))) for i in range(n)}


def frame(spark, of, kind="long"):
    return spark.createDataFrame([(s, type(1.5)(t) if kind == "double" else t) for s, x in of.items() for t in x], f"session_id string, time_s {kind}")


def closest(det, truth, tolerance):
    made, used, taken = [], set(), set()
    for _, i, j in sorted((abs(d - g), i, j) for i, d in enumerate(det) for j, g in enumerate(truth) if abs(d - g) <= tolerance):
        if i not in used and j not in taken:
            used.add(i)
            taken.add(j)
            made.append((det[i], truth[j]))
    return sorted(made)


def best_offset(det, truth, offsets, tolerance):
    best = (0, 0)
    for o in offsets:
        free, n = list(truth), 0
        for d in det:
            near = [(abs(d - o - g), k) for k, g in enumerate(free) if abs(d - o - g) <= tolerance]
            if near:
                free.pop(min(near)[1])
                n += 1
        if n > best[1]:
            best = (o, n)
    return best


def test_matchers(spark):
    rng = random.Random(1)
    det, truth = sessions(rng, 30, 25, 120), sessions(rng, 30, 25, 120)
    d, g = frame(spark, det), frame(spark, truth)
    found = matching.closest_pairs(d, g, 2).collect()
    offsets = list(range(-6, 7, 3))
    moved = {r["session_id"]: (r["best_offset"], r["best_tp"]) for r in matching.offset_grid(d, g, offsets, 1).collect()}
    optimal = matching.optimal_assignment(d, g, 2.0).collect()
    for s in det:
        assert sorted((r["det_time"], r["truth_time"]) for r in found if r["session_id"] == s) == closest(det[s], truth[s], 2)
        if det[s] or truth[s]:
            assert moved[s] == best_offset(det[s], truth[s], offsets, 1)
        import numpy as np

        whole = [abs(det[s][i] - truth[s][j]) for i, j in assignment.assign(np.array(det[s], float), np.array(truth[s], float), 2.0, True)]
        own = [abs(r["det_time"] - r["truth_time"]) for r in optimal if r["session_id"] == s]
        assert (len(own), sum(own)) == (len(whole), sum(whole))


def test_clean_up_of_event_times(spark):
    rng = random.Random(2)
    of = sessions(rng, 25, 40, 150)
    rows = [(s, float(t), float(rng.randrange(9)), rng.choice("abc")) for s, x in of.items() for t in x]
    df = spark.createDataFrame(rows, "session_id string, time_s double, energy double, roi string")
    louder = {(r["session_id"], r["time_s"], r["energy"]) for r in peaks.keep_louder(df, 3.0).collect()}
    thin = {(r["session_id"], r["time_s"]) for r in peaks.anchored_dedup(df, 3.0).collect()}
    votes = {(r["session_id"], round(r["time_s"], 6)) for r in peaks.vote_clusters(df, 2.0, 2, 4.0).collect()}
    wanted = set(), set(), set()
    for s in of:
        own = sorted((t, e, r) for k, t, e, r in rows if k == s)
        kept, last, clusters = [], [], []
        for t, e, r in own:
            if not kept or t - kept[-1][0] >= 3:
                kept.append((t, e))
            elif e > kept[-1][1]:
                kept[-1] = (t, e)
            if not last or t - last[-1] >= 3:
                last.append(t)
            if clusters and t - clusters[-1][0][0] <= 2:
                clusters[-1].append((t, r))
            else:
                clusters.append([(t, r)])
        means, chosen = [sum(t for t, _ in c) / len(c) for c in clusters if len({r for _, r in c}) >= 2], []
        for t in means:
            if not chosen or t - chosen[-1] >= 4:
                chosen.append(t)
        wanted[0].update((s, *x) for x in kept)
        wanted[1].update((s, t) for t in last)
        wanted[2].update((s, round(t, 6)) for t in chosen)
    assert (louder, thin, votes) == wanted


def test_prominence_by_blocks(spark):
    rng = random.Random(3)
    values = {f"s{i}": [float(rng.randrange(12)) for _ in range(rng.choice([3, 40, 200]))] for i in range(8)}
    signal = spark.createDataFrame([(s, i, v) for s, x in values.items() for i, v in enumerate(x)], "session_id string, idx long, value double")
    for block, fan in ((2, 3), (4, 8), (16, 1024), (1024, 1024)):
        made = {(r["session_id"], r["idx"]): r["prominence"] for r in peaks.with_prominence(peaks.local_maxima(signal), signal, block=block, fan=fan).collect()}
        assert len(made) > 50
        for (s, i), prominence in made.items():
            x, lows = values[s], []
            for side in (x[:i][::-1], x[i + 1 :]):
                low = x[i]
                for v in side:
                    if v > x[i]:
                        break
                    low = min(low, v)
                lows.append(low)
            assert prominence == x[i] - max(lows)


def test_engagements_against_loops(spark):
    rng = random.Random(4)
    shots, hits, kills, n = [], [], [], 0
    for s in range(12):
        for rows, most in ((shots, 40), (hits, 30), (kills, 8)):
            for _ in range(rng.randrange(most)):
                n += 1
                rows.append((f"s{s}", n, rng.randrange(100), *((rng.randrange(9), n % 3) if rows is hits else (n % 2 == 0, f"w{n % 3}") if rows is kills else ())))
    made = engagement.engagement_map(
        spark.createDataFrame(shots, "session_id string, event_id long, tick long"),
        spark.createDataFrame(hits, "session_id string, event_id long, tick long, damage long, hit_group long"),
        spark.createDataFrame(kills, "session_id string, event_id long, tick long, headshot boolean, weapon string"),
    ).collect()
    wanted = {}
    for s in {x[0] for x in shots}:
        own = sorted((t, e, h, w) for k, e, t, h, w in kills if k == s)
        ticks = sorted({x[2] for x in hits if x[0] == s})
        for number, (tick, *_) in enumerate(own, 1):
            prev = own[number - 2][0] if number > 1 else None
            mine = sorted(t for k, _, t in shots if k == s and next((i for i, x in enumerate(own, 1) if x[0] >= t), None) == number)
            if not mine:
                continue
            taken, flags, damage = set(), [], 0
            for t in mine:
                free = [h for h in ticks if t <= h <= t + 8 and h not in taken]
                flags.append("Y" if free else "M")
                taken.update(free[:1])
                first = next((h for h in ticks if t <= h <= t + 8), None)
                damage += sum(x[3] for x in hits if x[0] == s and x[2] == first)
            last = max((x for x in own if x[0] == tick), key=lambda x: x[1])
            wanted[s, number] = (tick, len(mine), ",".join(flags), damage, last[2], last[3], None if prev is None else round((mine[0] - prev) / 64 * 1000, 1))
    got = {(r["session_id"], r["engagement_id"]): (r["kill_tick"], r["shots_fired"], r["hit_sequence"], r["damage_dealt"], r["headshot"], r["weapon"], r["inter_engagement_gap_ms"]) for r in made}
    assert {k: v[:6] for k, v in got.items()} == {k: v[:6] for k, v in wanted.items()}
    assert all(v[6] is None and got[k][6] is None or abs(v[6] - got[k][6]) <= 0.1 for k, v in wanted.items())


def test_asof_both_ways(spark):
    rng = random.Random(5)
    left, right = sessions(rng, 10, 20, 60), sessions(rng, 10, 20, 60)
    for direction in ("backward", "forward"):
        made = asof.asof(frame(spark, left), frame(spark, right).withColumnRenamed("time_s", "other").selectExpr("*", "other as seen"), ["session_id"], "time_s", "other", ["seen"], direction).collect()
        assert len(made) == sum(map(len, left.values()))
        for r in made:
            near = [t for t in right[r["session_id"]] if (t <= r["time_s"] if direction == "backward" else t >= r["time_s"])]
            assert r["seen"] == ((max if direction == "backward" else min)(near) if near else None)


def test_regions_and_rates(spark):
    image = list(range(30))  # five rows of six
    df = spark.createDataFrame([("s", 0, image), ("s", 1, [v + 2 * (v == 14) for v in image])], "session_id string, idx long, patch array<int>")
    from pyspark.sql import functions as F

    cropped = df.select(signals.crop(F.col("patch"), 6, 1, 3, 2, 5).alias("a"), signals.crop(F.col("patch"), 6, -4, 99, 4, 99).alias("b")).first()
    assert cropped["a"] == [8, 9, 10, 14, 15, 16] and cropped["b"] == [4, 5, 10, 11, 16, 17, 22, 23, 28, 29]
    assert {r["idx"]: r["delta"] for r in signals.zone_motion(df, 6, 2, 2, 1).collect()} == {0: None, 1: 0.5}
    times = spark.createDataFrame([("a", 2.0), ("a", 2.5), ("a", 9.0), ("b", 1.0)], "session_id string, time_s double")
    assert {r["session_id"]: r["rate"] for r in signals.effective_rate(times).collect()} == {"a": 2.0, "b": 30.0}
    spans = spark.createDataFrame([("s", 1, 5.0, 5.01, 7.0), ("s", 2, 5.0, 9.0, 7.0)], "session_id string, engagement_id long, start double, first_shot double, acquired double")
    assert [r["acquired"] for r in timeline.with_degenerate(spans, 1 / 30).orderBy("engagement_id").collect()] == [5.0, 7.0]
