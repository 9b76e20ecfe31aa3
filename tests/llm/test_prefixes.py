import hashlib
import random
import zlib

import pytest

from tidemark.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, node string, parent string, base string"


def brute(rows):
    """The result's rows from lists of all prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = (abs(c) - abs(c) % 5) * (1 if c > 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    made = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        made.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), kids.get(path, 0), sum(p not in kids for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(made, key=str)


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-20, 120), n):
        for turn in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "a", "éé", "", None, "b c"])))
    rows += rows[:5] + [(None, 1, "user", "a"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def plain(made):
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in made.collect()), key=str)


@pytest.mark.parametrize(("seed", "most"), [(1, 1 << 18), (2, 1 << 18), (3, 1), (4, 4)])
def test_against_lists_of_prefixes(spark, seed, most):
    rows = conversations(seed)
    assert plain(prefixes.prefix_trie(table(spark, rows), most)) == brute(rows)


def test_families_meet(spark):
    """Copies in other families, a base that is absent, one that a family only partly begins with, and conversations without turns of their own."""
    talk = [("user", "hello"), ("assistant", "hi there"), ("user", "bye")]
    rows = [(c, t, r, x) for c in (0, 5, 7, 1000, 1001, 1004, 2002, 2003) for t, (r, x) in enumerate(talk)]
    rows += [(c, 0, "user", "hello") for c in range(3000, 3040)]
    assert plain(prefixes.prefix_trie(table(spark, rows))) == brute(rows)


def test_many_ends_at_one_node(spark):
    rows = [(5 * c, 0, "user", "same") for c in range(3000)]
    made = plain(prefixes.prefix_trie(table(spark, rows)))
    ids = ",".join(str(5 * c) for c in range(3000))
    assert made == sorted([(0, 0, None, 3000, 1, 1, 2999 * 4, hashlib.sha256().hexdigest()), (0, 1, 0, 3000, 0, 1, 2999 * 4, hashlib.sha256(ids.encode()).hexdigest())], key=str)


def test_long_conversation_and_empty_table(spark):
    rows = [(5, t, "user", "x" * 50 if t % 2 else "y") for t in range(3000)] + [(10, t, "user", "x" * 50 if t % 2 else "y") for t in range(2500)]
    made = {(r[0], r[1]): r for r in plain(prefixes.prefix_trie(table(spark, rows)))}
    assert len(made) == 3001 and made[5, 0][6] == sum(50 if t % 2 else 1 for t in range(2500)) and made[5, 0][5] == 1 and made[5, 2501][3] == 1
    assert prefixes.prefix_trie(table(spark, rows).limit(0)).collect() == []
    assert prefixes.prefix_trie(table(spark, [(None, 1, "user", "a")])).collect() == []


def test_surrogate_free_digests():
    assert prefixes._turn("ab", "c") != prefixes._turn("a", "bc")
    assert prefixes._turn("", "é")[1] == 2
