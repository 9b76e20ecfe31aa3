import random

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm.common import HashedWords, bucket_components, components, slices


def union_find(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_random_links_and_a_long_chain(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    made = components(spark.createDataFrame(links, "src long, dst long")).collect()
    expected = {x: r for x, r in union_find(links).items() if (x, x) not in links or len({a for a, b in links if b == x} | {b for a, b in links if a == x}) > 1}
    assert {r["node"]: r["root"] for r in made} == expected


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_buckets_lose_no_chain(spark):
    rng = random.Random(2)
    value = {i: rng.randrange(400) for i in range(200)}
    rows = [(key, i, 1) for i in value for key in {rng.randrange(8) for _ in range(2)}]
    members = spark.createDataFrame(rows, "key long, node long, weight long")
    facts = spark.createDataFrame(list(value.items()), "node long, value long")
    made = bucket_components(members, lambda a, b: F.abs(a["value"] - b["value"]), 2, facts).collect()
    by_key = {}
    for key, i, _ in rows:
        by_key.setdefault(key, []).append(i)
    links = [(a, b) for own in by_key.values() for a in own for b in own if a < b and abs(value[a] - value[b]) <= 2]
    assert {r["node"]: r["root"] for r in made} == union_find(links)


def test_two_large_components_in_one_bucket(spark):
    # two runs of values that lie 3 apart at their ends, so they are compared but not linked, and a third that is linked by one pair
    value = {i: i for i in range(60)} | {i: i + 2 for i in range(60, 120)} | {i: i + 3 for i in range(120, 180)}
    members = spark.createDataFrame([(1, i, 1) for i in value] + [(2, i, 1) for i in (0, 60)], "key long, node long, weight long")
    facts = spark.createDataFrame(list(value.items()), "node long, value long")
    for most in (2, 3):
        made = bucket_components(members, lambda a, b: F.abs(a["value"] - b["value"]), most, facts).collect()
        links = [(i, i + 1) for i in range(179) if value[i + 1] - value[i] <= most]
        assert {r["node"]: r["root"] for r in made} == union_find(links)


def test_slices_are_bounded_by_bytes():
    texts = ["x" * n for n in (10, 0, 5000, 30, 30, 9000, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["doc_id", "text"])
    parts = list(slices([batch, batch.slice(0, 0)], 4096))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") + 16 for t in p.column(1).to_pylist()) <= 4096 for p in parts)


def test_words_are_hashed_alike_when_the_table_is_emptied():
    one, other = HashedWords(3), HashedWords(3)
    other.places.most = 500
    rng = random.Random(4)
    for _ in range(20):
        words = [b"w%d" % rng.randrange(60) for _ in range(40)]
        assert one.of(words).tolist() == other.of(words).tolist()
    assert len(other.places.place) < len(one.places.place)
