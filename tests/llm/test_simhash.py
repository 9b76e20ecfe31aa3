import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, simhash


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_four_positions_always_hold_a_posting():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << bit for bit in rng.sample(range(64), 4))
        same = {p for p in range(8) if (a >> 8 * p) % 256 == (b >> 8 * p) % 256}
        assert any(set(s) <= same for s in simhash.POSTINGS)


def test_fingerprint():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "B ", "c\n", "É ", "\t", "dd ", "e f "]) for _ in range(rng.randrange(30)))
        assert simhash.fingerprint(text) == brute(text)


def edited(rng, words):
    words = list(words)
    for _ in range(rng.randrange(1, 4)):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def test_components_against_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(rng.choice([1, 2, 25])):
            rows.append((len(rows), " ".join(base if rng.random() < 0.3 else edited(rng, base))))
    rows += [(len(rows) + i, "") for i in range(3)]
    rng.shuffle(rows)
    fps = {d: brute(t) for d, t in rows}
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in made} == {d: find(d) for d in fps}
    kept = {r["doc_id"] for r in simhash.keep_first(docs).collect()}
    assert kept == {find(d) for d in fps}


def test_null_ids_and_repeated_rows(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text), (None, text), (7, "other words that differ from those above"), (7, "other words that differ from those above"), (None, "")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_first(docs).collect()) == sorted([text, "other words that differ from those above", ""])


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def linked(fps):
    """Components of all pairs within 4 bits, by numpy."""
    fps = np.array(sorted(fps), np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4).tolist():
            a, b = find(i), find(i + 1 + j)
            root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), set()).add(int(fps[i]))
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_finer_keys_are_shared_by_what_links(spark):
    rng = random.Random(12)
    pairs = []
    for _ in range(300):
        fp = rng.getrandbits(64)
        pairs.append((fp, fp ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))))
    rows = spark.createDataFrame([(signed(fp), 1) for p in pairs for fp in p], "fp long, weight int")
    fine = simhash.finer(simhash.postings(rows)).select("key", "node").distinct()
    other = fine.select("key", fine["node"].alias("b"))
    met = {(r["node"], r["b"]) for r in fine.join(other, "key").where("node <> b").select("node", "b").distinct().collect()}
    assert {(signed(a), signed(b)) for a, b in pairs} <= met and len(met) < 4 * len(pairs)


def test_crowded_bucket(spark, monkeypatch):
    """Unlike fingerprints that share four bytes, some linked pairs and chains among them: few of them are compared."""
    rng, shared = random.Random(13), 0x0123456700000000
    fps = {shared | rng.getrandbits(32) for _ in range(6000)}
    for fp in rng.sample(sorted(fps), 150):
        for _ in range(rng.randrange(1, 4)):
            fp ^= 1 << rng.randrange(32) ^ 1 << rng.randrange(64)
            fps.add(fp)
    nodes = spark.createDataFrame([(signed(fp), 1) for fp in sorted(fps)], "fp long, weight int")
    compared = spark.sparkContext.accumulator(0)

    def distance(a, b):
        @F.udf("int")
        def counted(x, y):
            compared.add(1)
            return bin((x ^ y) & (1 << 64) - 1).count("1")

        return counted(a["node"], b["node"])

    found = common.bucket_components(simhash.postings(nodes), distance, 4, nodes.select(F.col("fp").alias("node")), finer=simhash.finer).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["node"] & (1 << 64) - 1)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == linked(fps)
    assert compared.value < 2_000_000  # of 18 million pairs; most in lists of some 23 that share a further byte


def test_few_sets_lie_outside_any_three_positions():
    assert len(simhash.SOONER) == 14
    assert all(any(not set(s) & set(other) for s in simhash.SOONER) for other in combinations(range(8), 3))


def test_near_copies_take_few_rows(spark, monkeypatch):
    """A group of near copies, with chains and unlike fingerprints beside it: rows that meet their roots are a few a node, not one a posting."""
    rng = random.Random(21)
    base, fps = rng.getrandbits(64), {rng.getrandbits(64) for _ in range(300)}
    for _ in range(600):
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    for fp in rng.sample(sorted(fps), 60):
        fps.add(fp ^ sum(1 << b for b in rng.sample(range(64), 4)))
    met, with_root = [], common.with_root

    def counted(rows, of, roots):
        met.append(rows.count())
        return with_root(rows, of, roots)

    for module in (common, simhash):
        monkeypatch.setattr(module, "with_root", counted)
    nodes = spark.createDataFrame([(signed(fp), 1) for fp in sorted(fps)], "fp long, weight int")
    groups = {}
    for r in simhash.components_of(nodes).collect():
        groups.setdefault(r["root"], set()).add(r["node"] & (1 << 64) - 1)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == linked(fps)
    assert sum(met) < 25 * len(fps)
