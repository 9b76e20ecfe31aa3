"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from tidemark.llm import decontaminate, extract, ledger, licenses, passages, pieces, resample, rules, simhash, toxicity

CLASH = "key string, node string, root string, start string, hash string, _id string, fp string, weight string"
LONG = "the quick brown fox jumps over the lazy dog and runs away from it all " * 3000


def documents(spark, rows):
    full = [(d, t, "en", s, None if t is None else len(t), *["x"] * 8) for d, t, s in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


ROWS = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, LONG, "a"), (4, LONG, "a"), (5, "Licensed under the Apache License, Version 2.0.", "b"), (None, "one two three four five six", "b"), (6, "é ▁ \x00 ##", "b")]


def labels(spark, rows=((1, 1, 0), (4, 1, 1), (5, 0, 0), (5, 1, 0), (None, 1, 1), (6, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=((1, "one two three four five six"), (2, None), (3, ""), (4, "ab"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def small_scores(docs, marks):
    return toxicity.score(docs, marks, most=50, steps=5)


def words(tokenizer_batch):
    return [len(t.split()) for t in tokenizer_batch]


def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


BY_ROW = {
    "pieces": lambda s, d: pieces.encode(d, model()),
    "rules": lambda s, d: rules.judge(rules.measure(d)),
    "tokens": lambda s, d: ledger.count_tokens(d, "words", lambda: words),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "resample": lambda s, d: resample.select(d, labels(s)),
    "resample_unlabelled": lambda s, d: resample.select(d, labels(s, ()).limit(0)),
    "toxicity": lambda s, d: small_scores(d, labels(s)),
    "toxicity_unlabelled": lambda s, d: small_scores(d, labels(s, ()).limit(0)),
}
OTHERS = {
    "licenses": (lambda s, d: licenses.scan(d), 1),
    "passages": (lambda s, d: passages.repeats(d), 0),
    "decontaminate": (lambda s, d: decontaminate.find(d, benchmark(s)), 1),
    "decontaminate_nothing": (lambda s, d: decontaminate.find(d, benchmark(s, ()).limit(0)), 0),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_a_row_for_each_row(spark, name):
    docs = documents(spark, ROWS)
    made = BY_ROW[name](spark, docs).collect()
    assert len(made) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in made) == sorted(str(r[0]) for r in ROWS)
    assert BY_ROW[name](spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", OTHERS)
def test_rows_found(spark, name):
    find, n = OTHERS[name]
    docs = documents(spark, ROWS)
    assert len(find(spark, docs).collect()) == n
    assert find(spark, docs.limit(0)).collect() == []


def test_filters_keep_all_columns(spark):
    docs = documents(spark, ROWS)
    for kept, n in (
        (resample.keep_good(docs, labels(spark, ()).limit(0)), 8),
        (simhash.keep_first(docs), 5),
        (passages.cut_repeats(docs), 8),
        (decontaminate.keep_clean(docs, benchmark(spark)), 7),
    ):
        assert kept.columns == docs.columns
        assert kept.count() == n
    for kept in (resample.keep_good(docs.limit(0), labels(spark)), simhash.keep_first(docs.limit(0)), passages.cut_repeats(docs.limit(0)), decontaminate.keep_clean(docs.limit(0), benchmark(spark))):
        assert kept.count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p"), (3, "u", "<article><p>Short.</p></article>"), (3, "u", "<article><p>Short.</p></article>")], "page_id long, url string, html string")
    made = extract.extract(pages).collect()
    assert sorted(r["text"] for r in made) == ["", "", "", "Short.", "Short."]
    assert extract.extract(pages.limit(0)).collect() == []
