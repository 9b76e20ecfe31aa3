import random
import zlib

import numpy as np
import pytest

from tidemark.llm import langid


def brute_path(scores, switch):
    """The best path's value, by all states at each word."""
    best = list(scores[0])
    for row in scores[1:]:
        best = [x + max(b - switch * (i != j) for j, b in enumerate(best)) for i, x in enumerate(row)]
    return max(best)


def value(scores, labels, switch):
    return sum(scores[i][x] for i, x in enumerate(labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:], strict=False))


def test_paths_are_best():
    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes = rng.integers(0, 30, rng.integers(1, 12))
        scores = rng.normal(0, rng.choice([0.5, 3, 9]), (int(sizes.sum()), int(rng.integers(1, 5))))
        scores += np.repeat(rng.normal(0, 2, (len(sizes), scores.shape[1])), sizes, axis=0)
        if not len(scores):
            continue
        scores -= scores.max(axis=1, keepdims=True)
        labels, at = langid.viterbi(scores, sizes, 5.0), 0
        for n in sizes.tolist():
            part = scores[at : at + n].tolist()
            if n:
                assert value(part, labels[at : at + n].tolist(), 5.0) == pytest.approx(brute_path(part, 5.0))
            at += n


def test_words():
    words = langid.words_of(["Ab, c1d Привет-λόγος", "", "İx 日本ご"])
    found = list(zip(words.text.tolist(), words.start.tolist(), words.end.tolist(), strict=True))
    assert found == [(0, 0, 2), (0, 4, 5), (0, 6, 7), (0, 8, 14), (0, 15, 20), (2, 0, 2), (2, 3, 5), (2, 5, 6)]
    assert len(words.grams) == words.sizes.sum()
    assert langid.words_of([]).text.tolist() == []


def test_pieces():
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("ab  ,") for _ in range(rng.randrange(60)))
        parts = list(langid.pieces(text, 7))
        assert "".join(p for _, p in parts) == text and all(len(p) <= 7 for _, p in parts)
        assert all(text[at : at + len(p)] == p for at, p in parts)


WORDS = {
    "en": "the quick brown fox jumps over a lazy dog while they were walking through this forest together and nothing happened".split(),
    "de": "der schnelle braune fuchs springt über den faulen hund während sie zusammen durch diesen wald gingen und nichts geschah".split(),
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку пока они вместе гуляли по этому лесу и ничего не случилось".split(),
}


def sentence(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def learned(i):
    return zlib.crc32(str(i).encode()) % 3 != 1


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, sentence(lang, 30, rng), lang) for i, lang in enumerate(list(WORDS) * 40) if learned(i)]
    rows += [(10_000 + i, sentence("en", 30, rng), "zz") for i in range(500) if not learned(10_000 + i)]  # held out: a language that must not be learned
    rows += [(None, "x y z", "null id"), (1, None, "null text"), (2, "qq", None)]
    return langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_learned_languages(model):
    assert model.languages == ["de", "en", "ru"]


def test_spans_of_mixed_text(spark, model):
    rng = random.Random(4)
    parts = [("en", sentence("en", 20, rng)), ("ru", sentence("ru", 20, rng)), ("de", sentence("de", 35, rng))]
    text = " ".join(p for _, p in parts)
    (row,) = langid.label(spark.createDataFrame([(7, text)], "doc_id long, text string"), model).collect()
    assert [(s["lang"], text[s["start"] : s["end"]]) for s in row["spans"]] == parts
    letters = {lang: sum(map(str.isalpha, p)) for lang, p in parts}
    assert row["lang_pred"] == "de" and row["score"] == pytest.approx(letters["de"] / sum(letters.values()))


def test_long_text_goes_in_parts(spark, model, monkeypatch):
    rng = random.Random(4)
    text = sentence("de", 300, rng)
    whole = langid._labelled([text], model)
    monkeypatch.setattr(langid, "PART", 400)
    assert langid._labelled([text], model) == whole
    assert whole[2] == [[{"start": 0, "end": len(text), "lang": "de"}]]


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " 12 -- ."), (4, "ชื่อ"), (None, "the dog"), (5, "the lazy dog"), (5, "the lazy dog"), (6, "дом")]
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], "doc_id long, text string, lang string, lang_pred string, score string, spans string")
    made = {(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.label(docs, model, spans=False).collect()}
    assert made == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "de", 0.0), (None, "en", 1.0), (5, "en", 1.0), (6, "ru", 1.0)}
    assert langid.label(docs, model).count() == len(rows)
    assert langid.label(docs.limit(0), model).collect() == []
    assert langid.learn(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.label(docs, None).collect()} == {"und"}


def test_one_language(spark):
    docs = spark.createDataFrame([(i, "some words here", "en") for i in range(9)], "doc_id long, text string, lang string")
    made = langid.label(docs, langid.learn(docs)).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in made] == [("en", 1.0)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    made = langid.op13_langid(spark, sf)
    assert made.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = made.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 300
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.99
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (not learned(r["doc_id"])) for r in rows)
