import random

import numpy as np

from tidemark.llm import decontaminate as dc


def brute(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_against_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 30))
        score, first, end = dc.align(a, b)
        assert score == brute(a, b)
        if score:
            assert brute(a, b[first:end]) == score


def corpus(rng, n):
    return [[rng.choice(["the", "of", "and", f"w{rng.randrange(4000)}", f"w{rng.randrange(4000)}"]) for _ in range(120)] for _ in range(n)]


def test_copies_edits_and_clean_texts(spark):
    rng = random.Random(2)
    items = corpus(rng, 12)
    items = [(i, x[: 20 + 3 * i]) for i, x in enumerate(items)]
    docs, expected = [], set()
    for d, words in enumerate(corpus(rng, 200)):
        if d % 5 == 0:
            i, item = rng.choice(items)
            item = list(item)
            for _ in range(len(item) // 8):  # edits: words replaced, dropped, put in
                k = rng.randrange(len(item))
                item[k : k + 1] = rng.choice([["new"], [], [item[k], "more"]])
            at = rng.randrange(120)
            words = words[:at] + [w.upper() + "," for w in item] + words[at:]
            expected.add((d, i))
        docs.append((d, " ".join(words)))
    docs += [(1000 + k, "x y z. " + " ".join(items[3][1])) for k in range(300)]  # an item that leaked often
    expected |= {(1000 + k, 3) for k in range(300)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    for block in (8_000_000, 900):  # one block, several blocks
        made = {(r["doc_id"], r["item_id"]) for r in dc.find(df, bench, block_chars=block).collect()}
        assert made == expected
    kept = {r["doc_id"] for r in dc.keep_clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in expected}


def test_the_passage_is_returned(spark):
    df = spark.createDataFrame([(1, "aa bb cc One two, THREE four five six dd ee")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    row = dc.find(df, bench).first()
    assert (row["passage"], row["start_word"], row["end_word"], row["similarity"]) == ("one two three four five six", 3, 9, 1.0)


def test_one_edited_copy_in_many_texts(spark):
    rng = random.Random(5)
    item = [f"v{k}" for k in range(38)]
    edited = [f"new{k}" if k % 8 == 4 else w for k, w in enumerate(item)]  # 1 word in 8: over a quarter of the trigrams occur nowhere
    partial = item[:24]
    docs = [(d, " ".join(x[:60] + (edited if d < 1000 else partial) + x[60:])) for d, x in enumerate(corpus(rng, 1100))]
    docs += [(2000 + d, " ".join(x)) for d, x in enumerate(corpus(rng, 50))]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    made = {r["doc_id"]: r["similarity"] for r in dc.find(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert set(made) == set(range(1100))
    assert min(made[d] for d in range(1000)) > 0.75 and min(made[d] for d in range(1000, 1100)) > 0.6


def test_bounds_lose_no_alignment():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(4, 14)))) for k in range(30)]
    seeds = dc.Seeds(items, 3)
    for _ in range(60):
        text = [*rng.choice(vocabulary, 12), "x", *rng.choice(vocabulary, 12)]
        _, ids, _, where, place = seeds.hits([" ".join(text)])
        kept = set(seeds.candidates(ids[0], np.unique(place), 0.5).tolist())
        for item in range(len(items)):
            starts = [int(w) - int(i) for w, p in zip(where, place, strict=True) for i in np.flatnonzero(seeds.places[item] == p)]
            if starts:
                most = dc.passages_of(item, seeds, ids[0], np.array(starts), 0.0)
                assert most[0] < 0.5 or item in kept and dc.passages_of(item, seeds, ids[0], np.array(starts), 0.5) == most


def test_blocks_with_too_many_words_to_pack():

    packed, hashed = (dc.Seeds([(1, "one two three four"), (2, "two three four five six")], 3) for _ in range(2))
    hashed.bits = 40
    hashed.all = np.unique(np.concatenate([hashed.keys(i) for i in hashed.ids]))
    texts = ["x one two three four five", "six five four", ""]
    for a, b in zip(packed.hits(texts)[2:4], hashed.hits(texts)[2:4], strict=True):
        assert a.tolist() == b.tolist()
