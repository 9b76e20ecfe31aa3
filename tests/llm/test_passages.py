import random
import time
from itertools import groupby

import numpy as np
import xxhash

from tidemark.llm import passages


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in passages.repeats(df, **options).collect())


def test_a_passage_inside_other_text_is_caught(spark):
    rng = random.Random(1)
    rows, planted = [], prose(rng, 60)
    for i in range(40):
        text = prose(rng, 150)
        if i % 4 == 0:
            at = rng.randrange(150)
            text = text[:at] + planted + text[at:]
        rows.append((i, " ".join(text)))
    made = found(spark, rows)
    assert {r[0] for r in made} == {i for i in range(40) if i % 4 == 0}
    assert all(r[4] == 0 and r[5] == (r[0] != 0) and 32 <= r[3] <= 60 for r in made)


def test_short_repeats_are_left_alone(spark):
    rng = random.Random(2)
    line = " ".join(prose(rng, 12))
    assert found(spark, [(i, " ".join(prose(rng, 80)) + "\n" + line) for i in range(30)]) == []


def test_edited_lines_are_tied(spark):
    rng = random.Random(3)
    rows = []
    for group in range(30):
        base = prose(rng, 100)
        other = list(base)
        other[10] = "changed"  # Jaccard 91 / 101 of the shingles
        rows += [(2 * group, " ".join(base)), (2 * group + 1, " ".join(other))]
    made = found(spark, rows)
    whole = {r[0] for r in made if r[3] == 100}
    assert len(whole) >= 58  # a band collides with 99.5 in 100 at 0.8


def test_repeats_inside_one_document_are_none(spark):
    rng = random.Random(4)
    line = " ".join(prose(rng, 70))
    assert found(spark, [(1, line + "\n" + line), (2, " ".join(prose(rng, 70)))]) == []


def test_winnowing_guarantee():
    rng = np.random.default_rng(5)
    shingle = rng.integers(1 << 62, size=4000, dtype=np.uint64)
    place = passages.anchors(shingle, np.ones(4000, bool), 16)
    assert place[0] < 16 and place[-1] >= 4000 - 16 and np.diff(place).max() <= 16
    expected = {int(i + 15 - np.argmin((shingle[i : i + 16] >> np.uint64(24))[::-1])) for i in range(4000 - 15)}
    assert set(place.tolist()) == expected


def test_bands_reach_the_recall():
    b = passages.bands_for(0.8, 3, 0.995)
    assert 1 - (1 - 0.8**3) ** b >= 0.995 > 1 - (1 - 0.8**3) ** (b - 1)


def test_cutting():
    assert passages.without("a b  c\nd e", [(1, 3)]) == "a\nd e"
    assert passages.without("a b c", [(0, 1)]) == " b c"
    assert passages.without("a b c", [(0, 3)]).strip() == ""
    assert passages.without("a b c", []) == "a b c"


def test_the_first_occurrence_stays(spark):
    rng = random.Random(6)
    planted, own = " ".join(prose(rng, 90)), [" ".join(prose(rng, 60)) for _ in range(3)]
    rows = [(i, f"{own[i]}\n{planted}", 0) for i in range(3)] + [(3, planted, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    made = {r["doc_id"]: r for r in passages.cut_repeats(docs).collect()}
    assert set(made) == {0, 1, 2}
    assert made[0]["text"] == rows[0][1] and made[0]["n_chars"] == 0
    assert made[1]["text"] == own[1] and made[1]["n_chars"] == len(own[1])


def test_exact_passages_are_found_whole(spark):
    rng = random.Random(7)
    rows, bounds = [], {}
    for n in [36, 40, *[51] * 40, 60, 200]:
        planted = prose(rng, n)
        for _ in range(2):
            at, doc = rng.randrange(100), len(rows)
            text = prose(rng, 100)
            rows.append((doc, " ".join(text[:at] + planted + text[at:])))
            bounds[doc] = (at, at + n)
    made = found(spark, rows)
    assert {r[0]: (r[1], r[2]) for r in made} == bounds and len(made) == len(rows)
    assert all(r[4] == r[0] // 2 * 2 and r[5] == bool(r[0] % 2) for r in made)


def test_longer_runs_with_later_documents_are_whole_too(spark):
    rng = random.Random(8)
    planted = prose(rng, 90)
    texts = [prose(rng, 40) + part + prose(rng, 40) for part in (planted[25:65], planted, planted)]
    made = found(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    assert (0, 40, 80, 40, 0, False) in made
    assert {w for r in made if r[0] == 2 and r[5] for w in range(r[1], r[2])} == set(range(40, 130))
    assert {w for r in made if r[0] == 1 for w in range(r[1], r[2])} == set(range(40, 130))


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_lines_against_all_pairs(spark):
    # lines of one template share half of their words; some have near copies, some of these as a chain
    rng = random.Random(9)
    template, lines = prose(rng, 30), []
    for _ in range(40):
        base = prose(rng, 15) + template + prose(rng, 15)
        lines.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            base = list(base)
            base[rng.randrange(60)] = prose(rng, 1)[0]
            lines.append(base)
    rng.shuffle(lines)
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for k in range(i):
            if jaccard(lines[i], lines[k]) >= 0.8:
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(lines)):
        groups.setdefault(find(i), []).append(i)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    rows = df.select("doc_id", "text")
    found = passages.scanned(rows, 16, 20, 32, passages.bands_for(0.8, 3, 0.995), 3).where("kind = 'line'").withColumnRenamed("hash", "line")
    tied = passages.line_clusters(rows, found, 0.8)
    of_line = {r["line"]: r["doc_id"] for r in found.collect()}
    made = {}
    for r in tied.collect():
        made.setdefault(r["root"], []).append(of_line[r["node"]])
    made = {frozenset(g) for g in made.values()}
    wanted = {frozenset(g) for g in groups.values() if len(g) > 1}
    assert all(any(m <= w for w in wanted) for m in made)  # no link below the threshold
    assert len(made & wanted) >= 0.9 * len(wanted)


def test_prefixes_meet_where_lines_are_alike(spark):
    rng = random.Random(10)
    template = prose(rng, 40)
    sets = {i: set(template) | set(prose(rng, 20)) for i in range(30)}
    sets |= {100 + i: set(list(sets[i])[:-2]) | {"x"} for i in range(0, 30, 3)}
    table = spark.createDataFrame([(i, sorted(hash(w) for w in s)) for i, s in sets.items()], "node long, shingles array<long>")
    left = table.selectExpr("node", "node as root")
    met = {frozenset((r["a"], r["b"])) for r in passages.prefix_pairs(left, table, 0.8).collect()}
    wanted = {frozenset((a, b)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert wanted <= met and len(met) < 40


def test_rows_of_one_doc_id_are_cut_by_their_own_text(spark):
    rng = random.Random(3)
    passage, *texts = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n)) for n in (60, 80, 200, 70, 90))
    rows = [(1, f"{texts[0]}\n{passage}"), (2, f"{texts[1]} {passage}"), (2, f"{texts[2]}"), (2, f"{passage} {texts[3]}"), (2, f"{passage} {texts[3]}"), (None, passage), (None, passage), (7, None)]
    made = sorted(str(r["text"]) for r in passages.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert made == sorted(str(x) for x in [rows[0][1], texts[1], texts[2], f" {texts[3]}", f" {texts[3]}", passage, passage, None])


def test_words_are_those_of_split_with_their_xxh64():
    rng = random.Random(11)
    texts = ["", " \n", "\x00 A\x0bb\x1cc", "é\u3000一 \ud800", *(" ".join("aBé一"[k % 4] * n for n in range(1, 70)) for k in range(4))]
    texts += ["".join(rng.choice("ab\n \tZ") for _ in range(200)) for _ in range(20)]
    batch = [t.encode("utf-8", "surrogatepass") for t in texts]
    made, lower = passages.Words(batch), [t.translate(passages.LOWER) for t in batch]
    assert made.hashes.tolist() == [xxhash.xxh64_intdigest(w, 3) for t in lower for w in t.split()]
    assert made.text.tolist() == [n for n, t in enumerate(lower) for _ in t.split()]
    lines = [x for t in lower for x in t.split(b"\n") if len(x.split()) >= 3]
    assert [made.data[a:b] for a, b, _, _ in zip(*made.lines(3), strict=True)] == lines
    assert made.lines(3)[3].tolist() == [len(x.split()) for x in lines]


def test_words_not_met_before_are_hashed_in_the_time_of_some_splits():
    # a dictionary of the words met took over twenty times as long
    batch = [b" ".join(b"%x" % random.getrandbits(40) for _ in range(2000)) for _ in range(50)]

    def took(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert min(took(lambda: passages.Words(batch)) for _ in range(5)) < 8 * min(took(lambda: [t.split() for t in batch]) for _ in range(5)) + 0.005


def test_blocks_reach_as_far_as_with_any_other_document(spark):
    # contexts that agree in part: by brute force each number of words on a side is a key of its own
    rng = random.Random(12)
    core, sides, texts = prose(rng, 40), [prose(rng, 30) for _ in range(4)], []
    for _ in range(30):
        left, right = (list(rng.choice(sides)) for _ in range(2))
        for side in (left, right):
            if rng.random() < 0.6:
                side[rng.randrange(30)] = prose(rng, 1)[0]
        texts.append(prose(rng, rng.choice([0, 40])) + left[rng.randrange(30) :] + core + right[: rng.randrange(30)] + prose(rng, rng.choice([0, 40])))
    rows = [(i // 2 if i < 8 else i, " ".join(t)) for i, t in enumerate(texts) if i % 2 or i >= 8]
    words = {i: t.split() for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = passages.scanned(df, 16, 20, 50, 8, 3).where("kind = 'block'").collect()
    keys = {}
    for b in blocks:
        own = words[b["doc_id"]]
        for n in range(16):
            for key, start, end in ((("l", *own[b["start"] - n : b["end"]]), b["start"] - n, b["end"]), (("r", *own[b["start"] : b["end"] + n]), b["start"], b["end"] + n)):
                if start >= 0 and end <= len(own):
                    keys.setdefault((b["hash"], n, *key), set()).add((b["doc_id"], start, end))
    spans = set()
    for found_at in keys.values():
        first = min(d for d, _, _ in found_at)
        if any(d != first for d, _, _ in found_at):
            spans |= {((d, d != first), start, end, first) for d, start, end in found_at}
    wanted = []
    for (doc, removed), own in groupby(sorted(spans), lambda x: x[0]):
        merged = []
        for _, start, end, first in own:
            if merged and start <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(end, merged[-1][1]), min(first, merged[-1][2])]
            else:
                merged.append([start, end, first])
        wanted += [(doc, a, b, b - a, first, removed) for a, b, first in merged if b - a >= 32]
    assert found(spark, rows, line_words=10**6) == sorted(wanted) and len({r[3] for r in wanted}) > 10
