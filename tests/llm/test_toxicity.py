import random
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity as tox


def test_gradients_against_differences():
    shape = tox.Shape(window=6, stride=4, words=32, word_size=3, char_buckets=16, char_size=2, hidden=3, attention=2)
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in tox.fresh(shape, rng).items()}
    kinds = tox.features([b"ab", b"cde", b"f", b"ghij"], {b"ab": 1, b"cde": 2, b"ghij": 3}, shape)
    ids, label = rng.integers(0, 4, (5, 6)), np.array([0, 1, 0, 1, 1.0])
    mask = np.arange(6) < np.array([6, 3, 6, 1, 5])[:, None]
    keep = (np.array([1.0, 0, 1, 1]), np.array([1.0, 1, 0, 1]))
    _, g = tox.gradients(weights, shape, ids, mask, kinds, label, keep)
    for name, w in weights.items():
        flat, made = w.reshape(-1), g[name].reshape(-1)
        for j in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old, sides = flat[j], []
            for e in (1e-3, -1e-3):
                flat[j] = old + e
                sides.append(tox.gradients(weights, shape, ids, mask, kinds, label, keep)[0])
            flat[j] = old
            assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(made[j], abs=1e-5)


def test_windows_cover_the_text_and_overlap():
    shape = tox.Shape(window=10, stride=7)
    for n in range(1, 60):
        begin = tox.starts_of(n, shape)
        assert set(range(n)) <= {b + k for b in begin for k in range(10)}
        assert begin[-1] + 10 <= max(n, 10) and all(np.diff(begin) <= 7)


def test_trigrams_are_those_of_each_word():
    shape = tox.Shape()
    words = [b"a", b"the", "é".encode()]
    _, char, starts = tox.features(words, {}, shape)
    for w, part in zip(words, np.split(char, starts[1:]), strict=True):
        assert part.tolist() == tox.features([w], {}, shape)[1].tolist() and len(part) == len(w)


def test_batches_score_like_single_texts():
    shape = tox.Shape(window=8, stride=6)
    weights = tox.fresh(shape, np.random.default_rng(1))
    rng = random.Random(1)
    batch = [" ".join(rng.choice(["alpha", "beta", "Gamma!", "x9y"]) for _ in range(rng.randrange(40))) for _ in range(50)]
    whole = tox.Scorer(weights, {b"alpha": 1}, shape).highest(batch)
    alone = [tox.Scorer(weights, {b"alpha": 1}, shape).highest([t])[0] for t in batch]
    assert whole == pytest.approx(np.array(alone), nan_ok=True, abs=1e-5)


def test_learns_from_labels_that_are_not_held_out(spark):
    rng = random.Random(2)
    bad = ["grumble", "vile", "rotten"]
    rows, labels = [], []
    for d in range(700):
        toxic = int(d % 5 == 0)
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 150))]
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad).upper()
        rows.append((d, " ".join(words)))
        held = zlib.crc32(str(d).encode()) % 4 == 2
        labels.append((d, 1 - toxic if held else toxic))  # labels of held-out texts are wrong
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = tox.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    right = sum((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in made)
    assert right >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in made)


def test_held_out(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in df.select("doc_id", tox.held_out().alias("h")).collect())


def rank_area(scores, labels):
    """Area under the ROC curve, ties as halves."""
    pos, neg = ([s for s, y in zip(scores, labels, strict=True) if y == k] for k in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_held_out_labels_are_told(spark):
    sf = "/root/testdata/sf0.1"
    made = {r["doc_id"]: r for r in tox.op9_toxicity(spark, sf).collect()}
    rows = [(made[r["doc_id"]]["score"], r["toxic"], made[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if made[r["doc_id"]]["held_out"]]
    assert rank_area([r[0] for r in rows], [r[1] for r in rows]) >= 0.92
    flagged = [r[1] for r in rows if r[2] == 1]
    assert sum(flagged) >= 0.75 * len(flagged) and sum(flagged) >= 0.7 * sum(r[1] for r in rows)
