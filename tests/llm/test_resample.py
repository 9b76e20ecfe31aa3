import random

import numpy as np

from tidemark.llm import resample


def test_the_threshold_is_the_kth_value(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 500) for _ in range(400)] + [3.5] * 20 + [-7.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 5, 200, 420):
        expected = sorted(values, reverse=True)[k - 1]
        assert abs(resample.top_threshold(df, "v", k) - expected) < 1e-6
    assert resample.top_threshold(df, "v", 421) == -np.inf


def test_features_of_a_batch_are_those_of_its_texts():
    rng = random.Random(2)
    batch = ["".join(rng.choice(["a ", "b! ", "c", " ", "é ", "\n"]) for _ in range(rng.randrange(25))) for _ in range(60)]
    features, text = resample.Hasher(500).features(batch)
    for i, t in enumerate(batch):
        alone, _ = resample.Hasher(500).features([t])
        assert sorted(features[text == i]) == sorted(alone)


def test_repeats_are_told():
    features, _ = resample.Hasher(10).features(["a a a b c b d"])
    assert [int((features == 10 + k).sum()) for k in range(3)] == [4, 2, 1]


def corpus(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(300)]
    rows += [(300 + i, " ".join(rng.choice(words) + "$$$" for _ in range(80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i < 300)) for i in range(0, 360, 2)], "doc_id long, quality int")


def test_junk_goes_and_clean_texts_stay(spark):
    docs, labels = corpus(spark)
    kept = {r["doc_id"] for r in resample.select(docs, labels).where("kept").collect()}
    assert set(range(300)) <= kept and len(kept) <= 310
    again = {r["doc_id"] for r in resample.select(docs.repartition(7), labels).where("kept").collect()}
    assert again == kept
    assert {r["doc_id"] for r in resample.keep_good(docs, labels).collect()} == kept


def test_a_hot_temperature_samples_otherwise(spark):
    docs, labels = corpus(spark)
    kept = {r["doc_id"] for r in resample.select(docs, labels, temperature=1e4).where("kept").collect()}
    assert any(d >= 300 for d in kept) and any(d not in kept for d in range(300))


def test_held_out_labels_are_told(spark):
    """Fitted on half of the labels, tried on the others."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    known = labels.orderBy("doc_id").collect()
    half = [(r["doc_id"], r["quality"]) for r in known[::2]]
    made = {r["doc_id"]: r for r in resample.select(docs, spark.createDataFrame(half, "doc_id long, quality int")).collect()}
    good, bad = ([made[r["doc_id"]] for r in known[1::2] if r["quality"] == q] for q in (1, 0))
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.15 * len(bad)
