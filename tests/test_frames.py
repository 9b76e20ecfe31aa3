"""The grey level that parts an array, against all 256 levels in a loop."""

import random
import time

from pyspark.sql import functions as F

from tidemark.operators import frames


def looped(values):
    best, level, total = -1.0, 0, len(values)
    for b in range(256):
        below = [v for v in values if 0 <= v <= b]
        n, s = float(len(below)), float(sum(below))
        if 0 < n < total and (spread := (sum(values) * n - s * total) ** 2 / (n * (total - n))) > best:
            best, level = spread, b
    return level


def test_otsu_threshold_against_all_levels(spark):
    rng = random.Random(4)
    rows = [[], [7], [7, 7], [0, 255], [255, 255], [300, 300, 5], [-1, 4, 9], [256], [1, 1, 3, 3]]
    rows += [[rng.choice([rng.randrange(256), rng.randrange(-20, 300), rng.randrange(4)]) for _ in range(rng.randrange(1, 70))] for _ in range(300)]
    rows += [[rng.randrange(k) for _ in range(64)] for k in range(1, 256, 5)]
    made = spark.createDataFrame([(r,) for r in rows], "v array<int>").select("v", frames.otsu_threshold(F.col("v")).alias("level")).collect()
    assert [(list(r["v"]), r["level"]) for r in made] == [(r, looped(r)) for r in rows]


def test_otsu_threshold_takes_one_pass(spark):
    """40,000 arrays of 64 values; with a pass for each level this takes minutes."""
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.pmod(F.hash("id", i), F.lit(256)))
    began = time.time()
    assert spark.range(40_000).select(frames.otsu_threshold(values).alias("level")).agg(F.count("level")).first()[0] == 40_000
    assert time.time() - began < 20
