import random
import re
from collections import Counter

import pytest

from tidemark.llm import licenses


def dice(a, b):
    words = [re.findall(r"[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in (a, b)]
    bags = [Counter(zip(w, w[1:], strict=False)) for w in words]
    total = sum(map(sum, (b.values() for b in bags)))
    return 2 * sum((bags[0] & bags[1]).values()) / total if total else 0.0


def test_nearest_template_against_all():
    rng = random.Random(1)
    known = licenses.Templates(licenses.TEMPLATES, 0.6)
    for _ in range(300):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["the", "x", "License", "of"])
        text = " ".join(words)
        scores = [dice(text, t) for _, t in licenses.TEMPLATES]
        found = known.nearest(licenses.words_of(text))
        if max(scores) < 0.6:
            assert found is None
        else:
            assert found[0] == scores.index(max(scores)) and found[1] == pytest.approx(max(scores))


def test_lines_paragraphs_and_whole_texts(spark):
    mit = licenses.TEMPLATES[4][1]
    half = mit.split()
    docs = spark.createDataFrame(
        [(1, "prose\nReleased under the MIT License.\nmore"), (2, " ".join(half[:90]) + "\n" + " ".join(half[90:])), (3, " ".join(half[:90]) + "\n\n" + " ".join(half[90:])), (4, "all rights were not reserved"), (5, "All rights reserved.")],
        "doc_id long, text string",
    )
    made = {(r["doc_id"], r["passage"], r["license"]) for r in licenses.scan(docs).collect()}
    assert made == {(1, "line", "MIT"), (2, "paragraph", "MIT"), (3, "text", "MIT"), (5, "line", "All-Rights-Reserved")}
    first = licenses.scan(docs.where("doc_id = 1")).first()
    assert "prose\nReleased under the MIT License.\nmore"[first["start"] : first["end"]] == "Released under the MIT License."


def test_notices_inside_other_text(spark):
    mit = licenses.TEMPLATES[4][1]
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and t.startswith("This program"))
    cc = next(t for n, t in licenses.TEMPLATES if n == "CC-BY-4.0" and "Creative" in t)
    half, prose = mit.split(), "some words of prose before and after it " * 12
    rows = [
        (1, f"{prose}\n\n{' '.join(half[:90])}\n\n{' '.join(half[90:])}\n\n{prose}"),
        (2, f"é {prose}{cc} {prose}"),
        (3, prose + "\n" + "\n".join(" * " + " ".join(gpl.split()[k : k + 9]) for k in range(0, 90, 9)) + f"\n * {prose}"),
        (4, "Copyright 2020 the authors and their friends and heirs. All rights reserved."),
        (5, prose),
    ]
    made = {(r["doc_id"], r["passage"], r["license"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(made) == {(1, "span", "MIT"), (2, "span", "CC-BY-4.0"), (3, "span", "GPL-3.0"), (4, "span", "All-Rights-Reserved")}
    r = made[2, "span", "CC-BY-4.0"]
    assert rows[1][1][r["start"] : r["end"]] == cc.rstrip(".") and r["dice"] == 1.0


def test_planted_notices_are_found(spark):
    """Each licence inside prose, on its own lines, wrapped, and with a word in twenty edited."""
    rng = random.Random(2)
    rows, wanted = [], {}
    prose = lambda n: " ".join(rng.choice(["river", "stone", "walked", "under", "and", "the", "of"]) for _ in range(n))
    for name, text in licenses.TEMPLATES:
        words = text.split()
        edited = [w if rng.random() > 0.05 or len(words) < 30 else "word" for w in words]
        wrapped = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
        halves = " ".join(words[: len(words) // 2]) + "\n\n" + " ".join(words[len(words) // 2 :])
        for shown in (f"{prose(60)}\n{text}\n{prose(60)}", f"{prose(50)}\n\n{wrapped}\n\n{prose(50)}", f"{prose(40)}\n{' '.join(edited)}\n{prose(9)}", f"{prose(40)}\n\n{halves}\n\n{prose(9)}"):
            wanted[len(rows)] = name
            rows.append((len(rows), shown))
    clean = [(10_000 + i, prose(300)) for i in range(50)]
    found = {}
    for r in licenses.scan(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    hit = sum(name in found.get(doc, ()) for doc, name in wanted.items())
    assert hit >= 0.95 * len(wanted), [(licenses.TEMPLATES[d // 4][0], d % 4) for d, n in wanted.items() if n not in found.get(d, ())]
    assert not any(doc >= 10_000 for doc in found)


def test_many_paragraphs_take_linear_time():
    import time

    known = licenses.Templates(licenses.TEMPLATES, 0.85)
    took = []
    for n in (2000, 16000):
        began = time.perf_counter()
        licenses.scan_text("a line of words\nand another line\n\n" * n, known)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 1
