import random
import re

from tidemark.llm import rules

NAMES = [x.split()[0] for x in rules.MEASURES.split(", ")]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(covered),
        "n_wordy": sum(bool(re.search(r"[^!-@\[\\\]^_`{|}~]", w)) for w in words),
    }


def test_measurements():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["a ", "b ", "c ", "#", "| ", "\n", "\x0b", "É", "9 ", "!! ", "a\n", " "]) for _ in range(rng.randrange(60)))
        made = dict(zip(NAMES, rules.measured(text), strict=True))
        expected = brute(text)
        assert {k: made[k] for k in expected} == expected, text


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good), (2, "too short"), (3, good + " # $ % & | < > ***"), (4, "same words here " * 40)], "doc_id long, text string")
    ledger = rules.judge(rules.measure(docs))
    kept = {p: {r["doc_id"] for r in ledger.where(rules.passes(p)).collect()} for p in rules.POLICIES}
    assert kept == {"base": {1, 3}, "v1": {1}, "v2": {1}}
    made = {r["rule"]: (r["n_failed"], r["n_only"]) for r in rules.ablation(ledger, "v1").collect()}
    assert made == {"few_words": (1, 1), "repeated_windows": (1, 1), "symbols": (1, 1), "repeated_lines": (0, 0)}
