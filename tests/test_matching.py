"""Matchers on cases with known outcomes, and against brute force."""

import itertools
import random
import time

import numpy as np
import pytest

from tidemark.operators import matching as m
from tidemark.operators.assignment import assign, bands, closest, pair_counts
from tidemark.operators.assignment import greedy as in_order


def frame(spark, times, name="time_s"):
    return spark.createDataFrame([("s", float(t)) for t in times], f"session_id string, {name} double")


def pairs(df):
    return sorted((r["det_time"], r["truth_time"]) for r in df.collect())


CLOSEST = [
    ([1, 2, 3], [1, 2, 3], 0.5, 3),
    ([1, 2, 3], [10, 20], 0.5, 0),
    ([], [1, 2], 0.5, 0),
    ([1.05, 2.1], [1, 2], 0.15, 2),
    ([1.5], [1], 0.1, 0),
    ([1.0, 1.3], [1.2], 0.5, 1),
]


@pytest.mark.parametrize("det, truth, tolerance, n", CLOSEST)
def test_closest_pairs(spark, det, truth, tolerance, n):
    d, g = frame(spark, det), frame(spark, truth)
    found = m.closest_pairs(d, g, tolerance)
    assert len(pairs(found)) == n
    score = m.scored(d, g, found).first()
    assert (score["fp"], score["fn"]) == (len(det) - n, len(truth) - n)
    assert score["recall"] == pytest.approx(100 * n / len(truth))
    if det:
        assert score["precision"] == pytest.approx(100 * n / len(det))


def test_the_closer_detection_wins(spark):
    assert pairs(m.closest_pairs(frame(spark, [1.0, 1.3]), frame(spark, [1.2]), 0.5)) == [(1.3, 1.2)]


OPTIMAL = [([1, 2, 3], [1, 2, 3], 0.5, 3), ([], [1, 2], 0.5, 0), ([1, 2], [], 0.5, 0), ([1, 5, 10], [1.1, 5.2], 0.5, 2), ([1.0], [1.5], 0.5, 1), ([1.0], [1.5], 0.4, 0)]


@pytest.mark.parametrize("most", [True, False])
@pytest.mark.parametrize("det, truth, tolerance, n", OPTIMAL)
def test_optimal_assignment(spark, det, truth, tolerance, n, most):
    assert len(pairs(m.optimal_assignment(frame(spark, det), frame(spark, truth), tolerance, most=most))) == n


def brute(det, truth, tolerance, most):
    small, large = (det, truth) if len(det) <= len(truth) else (truth, det)
    best = None
    for chosen in itertools.permutations(range(len(large)), len(small)):
        gaps = [abs(small[i] - large[j]) for i, j in enumerate(chosen)]
        inside = [g for g in gaps if g <= tolerance]
        key = (-len(inside), sum(inside)) if most else (sum(gaps),)
        best = key if best is None or key < best else best
    return best


def test_assignment_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        det, truth = (sorted(rng.randrange(12) for _ in range(rng.randrange(1, 6))) for _ in range(2))
        for most in (True, False):
            found = assign(np.array(det, float), np.array(truth, float), 2.0, most)
            gaps = [abs(det[i] - truth[j]) for i, j in found]
            assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
            key = (-len(gaps), sum(gaps)) if most else (sum(gaps),)
            assert key == pytest.approx(brute(det, truth, 2.0, most))


def table_assign(d, g, tolerance, most):
    """The same choice of equals, by whole tables: out goes the last column first, then the last row."""
    if not most and len(d) > len(g):
        return [(i, j) for j, i in table_assign(g, d, tolerance, most)]
    best = {(0, j): (0, 0, 0) for j in range(len(g) + 1)} | ({(i, 0): (0, 0, 2) if most else (0, float("inf"), 2) for i in range(1, len(d) + 1)})
    for i, x in enumerate(d, 1):
        for j, y in enumerate(g, 1):
            options = [(*best[i, j - 1][:2], 1)]
            if most:
                options.append((*best[i - 1, j][:2], 2))
            if not most or abs(x - y) <= tolerance:
                options.append((best[i - 1, j - 1][0] - most, best[i - 1, j - 1][1] + abs(x - y), 3))
            best[i, j] = min(options)
    pairs, i, j = [], len(d), len(g)
    while i and j:
        k = best[i, j][2]
        if k == 3:
            pairs.append((i - 1, j - 1))
        i, j = i - (k != 1), j - (k != 2)
    return pairs[::-1]


def test_bands_choose_as_tables_do():
    rng = random.Random(6)
    for _ in range(400):
        det, truth = (sorted(rng.randrange(rng.choice([10, 60])) for _ in range(rng.randrange(25))) for _ in range(2))
        for most in (True, False):
            assert assign(np.array(det, float), np.array(truth, float), 2.0, most) == table_assign(det, truth, 2, most)


def test_bands_go_by_differences():
    d, g = np.array([0.3, 0.7, 1.5, 2.0]), np.array([0.1, 0.6, 1.0, 1.1, 2.5])
    for tolerance in (0.1, 0.2, 0.4, 0.5, 0.0):
        low, high = bands(d, g, tolerance)
        for i, x in enumerate(d):
            assert [j for j, y in enumerate(g) if abs(x - y) <= tolerance] == list(range(low[i], high[i]))


def test_long_sides_in_one_island():
    """100,000 times in one island, a band of about a hundred; and 50,000 of which 30,000 are wholly paired."""
    rng = np.random.default_rng(1)
    d, g = (np.sort(rng.uniform(0, 5000, 50_000)) for _ in range(2))
    start = time.perf_counter()
    found = assign(d, g, 5.0, True)
    assert len(found) == pair_counts(d, g, np.array([0]), 5.0)[0] > 49_000
    assert len(assign(d[:30_000], g[:32_000], 5.0, False)) <= 30_000
    assert time.perf_counter() - start < 60


def test_counts_of_all_offsets():
    rng = random.Random(8)
    for _ in range(60):
        det, truth = (sorted({rng.randrange(rng.choice([40, 200])) for _ in range(rng.randrange(14))}) for _ in range(2))
        offsets = np.arange(-70, 70, rng.choice([1, 5]))
        found = pair_counts(np.array(det, np.int64), np.array(truth, np.int64), offsets, 3)
        assert found.tolist() == [len(table_assign([x - o for x in det], truth, 3, True)) for o in offsets.tolist()]
        assert (pair_counts(np.array(det, float), np.array(truth, float), offsets / 10, 0.3) == [len(table_assign([x - o for x in det], truth, 0.3, True)) for o in (offsets / 10).tolist()]).all()


def closest_of_all(det, truth, tolerance):
    made = []
    for _, i, j in sorted((abs(x - y), i, j) for i, x in enumerate(det) for j, y in enumerate(truth) if abs(x - y) <= tolerance):
        if all(i != a and j != b for a, b in made):
            made.append((i, j))
    return made


def first_or_nearest(det, truth, tolerance, first):
    made = []
    for i, x in enumerate(det):
        left = [(0 if first else abs(x - y), j) for j, y in enumerate(truth) if abs(x - y) <= tolerance and all(j != b for _, b in made)]
        if left:
            made.append((i, min(left)[1]))
    return made


def test_pointers_and_queue_choose_as_scans_do():
    rng = random.Random(16)
    for _ in range(500):
        reach = rng.choice([8, 40, 200])
        det, truth = (sorted(rng.randrange(reach) / rng.choice([1, 4]) for _ in range(rng.randrange(25))) for _ in range(2))
        d, g = np.array(det, float), np.array(truth, float)
        for tolerance in (0, 2, 7.5):
            times = lambda pairs: sorted((det[i], truth[j]) for i, j in pairs)  # noqa: E731  equal times are alike
            assert times(closest(d, g, tolerance)) == times(closest_of_all(det, truth, tolerance))
            for first in (False, True):
                assert times(in_order(d, g, tolerance, first)) == times(first_or_nearest(det, truth, tolerance, first))


def test_dense_island_in_order_and_closest_first():
    """100,000 of each side in one island."""
    rng = np.random.default_rng(1)
    d, g = (np.sort(rng.uniform(0, 1000, 100_000)) for _ in range(2))
    start = time.perf_counter()
    assert len(in_order(d, g, 100.0)) > 90_000 and len(in_order(d, g, 100.0, True)) > 90_000 and len(closest(d, g, 100.0)) > 90_000
    assert time.perf_counter() - start < 60


def searched(det, truth, coarse, fine, tolerance):
    """Every offset tried by a match of its own."""
    best, most = 0, 0
    for tried in (coarse, fine):
        at = best if tried is fine else 0
        for o in tried:
            n = len(table_assign([x - at - o for x in det], truth, tolerance, True))
            if n > most:
                best, most = at + o, n
    return best, most


def test_offset_search_against_a_match_of_each_offset(spark):
    rng = random.Random(9)
    sessions = {f"s{i}": [sorted({rng.randrange(3000) for _ in range(rng.randrange(12))}) for _ in range(2)] for i in range(40)}
    sessions["hit"] = [[x + 37 for x in (100, 250, 300, 470, 600)], [100, 250, 300, 470, 600]]
    sessions["far"] = [[10, 5000], [20, 5030]]
    d = spark.createDataFrame([(s, t) for s, (x, _) in sessions.items() for t in x], "session_id string, time_s long")
    g = spark.createDataFrame([(s, t) for s, (_, y) in sessions.items() for t in y], "session_id string, time_s long")
    coarse, fine = range(-70, 70, 10), range(-10, 10, 1)
    found = {r["session_id"]: (r["best_offset"], r["best_tp"]) for r in m.offset_search(d, g, coarse, fine, 4).collect()}
    assert found == {s: searched(x, y, coarse, fine, 4) for s, (x, y) in sessions.items() if x or y}
    moved = {tuple(r) for r in m.shifted(d, m.offset_search(d, g, coarse, fine, 4)).where("session_id = 'hit'").collect()}
    assert moved == {("hit", x + 37 - found["hit"][0]) for x in (100, 250, 300, 470, 600)}
    assert m.offset_search(d.limit(0), g.limit(0), coarse, fine, 4).collect() == []


def greedy(det, truth, tolerance):
    free, made = list(truth), []
    for d in sorted(det):
        near = [g for g in free if abs(g - d) <= tolerance]
        if near:
            g = min(near, key=lambda g: (abs(g - d), g))
            free.remove(g)
            made.append((d, g))
    return sorted(made)


def test_greedy_against_brute_force(spark):
    rng = random.Random(4)
    sessions = {f"s{i}": [sorted({float(rng.randrange(30)) for _ in range(rng.randrange(6))}) for _ in range(2)] for i in range(40)}
    d = spark.createDataFrame([(s, t) for s, (x, _) in sessions.items() for t in x], "session_id string, time_s double")
    g = spark.createDataFrame([(s, t) for s, (_, y) in sessions.items() for t in y], "session_id string, time_s double")
    found = m.greedy_in_order(d, g, 3.0).collect()
    for s, (x, y) in sessions.items():
        assert sorted((r["det_time"], r["truth_time"]) for r in found if r["session_id"] == s) == greedy(x, y, 3.0)


def test_offset_is_found(spark):
    truth = [100, 250, 300, 470, 600]
    d = spark.createDataFrame([("s", t + 120) for t in truth], "session_id string, time_s long")
    g = spark.createDataFrame([("s", t) for t in truth], "session_id string, time_s long")
    assert m.offset_grid(d, g, list(range(-240, 241, 60)), 10).first()["best_offset"] == 120
    assert m.offset_correlation(d, g, 240, 20, 10.0).first()["best_offset"] == 120
