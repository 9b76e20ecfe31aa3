import random
import re

import public_tokenizers
import tiktoken

from tidemark.llm import ledger


def words():
    return lambda batch: [len(t.split()) for t in batch]


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, text string")


def totals(book):
    return {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in book.totals().collect()}


def test_inserts_deletes_revisions(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/l")
    assert totals(book) == {}
    first = changes(spark, [("insert", 1, "a", "en", "one two"), ("insert", 2, "a", "en", "three"), ("insert", 3, None, "de", None)])
    assert book.commit("b1", book.signed(first, "words", words))
    assert totals(book) == {("a", "en"): (2, 3), (None, "de"): (1, 0)}
    assert not book.commit("b1", book.signed(first, "words", words))
    assert totals(book) == {("a", "en"): (2, 3), (None, "de"): (1, 0)}
    second = changes(spark, [("revise", 1, "b", "en", "a b c d"), ("delete", 2, None, None, None), ("delete", 9, None, None, None)])
    assert book.commit("b2", book.signed(second, "words", words))
    assert totals(book) == {("b", "en"): (1, 4), (None, "de"): (1, 0)}
    assert {r["doc_id"] for r in book.held("words").collect()} == {1, 3}
    other = changes(spark, [("insert", 1, "b", "en", "a b c d")])
    assert book.commit("b3", book.signed(other, "words-2", words))
    assert {r["tokenizer"] for r in book.totals().collect()} == {"words", "words-2"}


def test_a_batch_that_broke_off_is_written_anew(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/l")
    signed = book.signed(changes(spark, [("insert", 1, "a", "en", "one")]), "words", words)
    signed.write.parquet(f"file://{tmp_path}/l/rows/b1/attempt")  # no marker
    assert totals(book) == {}
    assert book.commit("b1", signed)
    assert totals(book) == {("a", "en"): (1, 1)}


def test_counts_are_the_tokenizer_s(spark, tmp_path):
    setup = ledger.byte_pair_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = {r["doc_id"]: r["n_tokens"] for r in ledger.count_tokens(docs, "t", setup).collect()}
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert made == {r["doc_id"]: len(coder.encode_ordinary(r["text"])) for r in docs.collect()}
    book = ledger.Ledger(spark, f"file://{tmp_path}/l")
    assert book.apply("all", docs.selectExpr("*", "'insert' as op"), "t", setup)
    assert sum(r["n_tokens"] for r in book.totals().collect()) == sum(made.values())


def random_changes(rng, n, seqs):
    made = []
    for _ in range(n):
        op = rng.choice(["insert", "delete", "revise"])
        text = None if op == "delete" else rng.choice(["", "a", "a b", "a b c", None])
        made.append((op, rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(["s", "t", None]), rng.choice(["en", None]), text, rng.randrange(6) if seqs else 0))
    return made


def apply(held, batch):
    """Brute force: each document's changes one after the other."""
    order = {"insert": 0, "revise": 1, "delete": 2}
    for op, doc, source, lang, text, _ in sorted(batch, key=lambda c: (c[5], order[c[0]], c[4] is not None, c[4] or "", c[2] is not None, c[2] or "", c[3] is not None, c[3] or "")):
        if op != "insert":
            held = [h for h in held if h[0] != doc]
        if op != "delete":
            held = [*held, (doc, source, lang, len((text or "").split()))]
    return held


def test_random_batches_against_one_by_one(spark, tmp_path):
    rng = random.Random(1)
    for seqs in (True, False):
        book, held = ledger.Ledger(spark, f"file://{tmp_path}/{seqs}", buckets=3), []
        for n in (12, 0, 9, 14):
            batch = random_changes(rng, n, seqs)
            df = spark.createDataFrame(batch, "op string, doc_id long, source string, lang string, text string, seq long")
            assert book.commit(f"b{n}", book.signed(df if seqs else df.drop("seq"), "words", words))
            held = apply(held, batch)
            wanted = {}
            for _, source, lang, tokens in held:
                d, t = wanted.get((source, lang), (0, 0))
                wanted[source, lang] = (d + 1, t + tokens)
            assert totals(book) == wanted


def test_of_two_attempts_at_a_batch_one_counts(spark, tmp_path):
    one, other = (ledger.Ledger(spark, f"file://{tmp_path}/l") for _ in range(2))
    signed = one.signed(changes(spark, [("insert", 1, "a", "en", "one two")]), "words", words)
    other.committed = lambda: {}  # it looked before the first was done
    assert one.commit("b", signed) and not other.commit("b", signed)
    assert totals(one) == {("a", "en"): (1, 2)}
    assert len(list((tmp_path / "l/rows/b").iterdir())) == 1


def test_a_batch_is_taken_back(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/l")
    assert book.commit("b1", book.signed(changes(spark, [("insert", 1, "a", "en", "one two"), ("insert", None, "a", "en", "three")]), "words", words))
    assert book.commit("b2", book.signed(changes(spark, [("delete", None, None, None, None), ("revise", 1, "b", "de", "x")]), "words", words))
    assert totals(book) == {("b", "de"): (1, 1)}
    assert book.reversal("b9").count() == 0
    assert book.commit("b3", book.reversal("b2"))
    assert totals(book) == {("a", "en"): (2, 3)}


def test_many_batches_are_few_tables(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", buckets=2, most_tables=3)
    wanted = {}
    for n in range(8):
        change = [("insert", n, "a", "en", "one two three"), ("delete", n - 2, None, None, None)]
        assert book.apply(f"b{n}", changes(spark, change), "words", words)
        wanted = {"a": (min(n + 1, 2), 3 * min(n + 1, 2))}
        assert {r["source"]: (r["n_docs"], r["n_tokens"]) for r in book.totals().collect()} == wanted
        assert len(book._live()) <= 3
    assert sorted(book.committed()) == [f"b{n}" for n in range(8)]
    assert not book.apply("b3", None, "words", None)  # passed over unread
    assert book.commit("undo", book.reversal("b7"))
    assert {r["source"]: r["n_docs"] for r in book.totals().collect()} == {"a": 2}
    assert {r["doc_id"] for r in book.held("words").collect()} == {5, 6}
    number = sum(name.startswith(ledger.COMPACT) for name in book._markers())
    assert book._mark(f"{ledger.COMPACT}{number:09d}", "x", ["b0"]) and not book._mark(f"{ledger.COMPACT}{number:09d}", "y")
    book.drop()
    assert not (tmp_path / "ledger").exists()


def test_the_query_leaves_its_changes_in(spark):
    import duckdb
    import public_tokenizers

    sf = "/root/testdata/sf0.001"
    count = ledger.byte_pair_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)()
    quality = {}
    for doc, good in duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet' where quality is not null").fetchall():
        quality[doc] = min(good, quality.get(doc, 1))
    wanted = {}
    for doc, text, lang, source in duckdb.sql(f"select doc_id, text, lang, source from '{sf}/documents.parquet'").fetchall():
        if quality.get(doc) != 0:
            text = text or ""
            n = wanted.setdefault((source, lang), [0, 0])
            n[0] += 1
            n[1] += count([re.sub(r"[\x20\x09-\x0D]+", " ", text) if doc in quality else text])[0]
    made = ledger.op1_token_counts(spark, sf).collect()
    assert 0 in quality.values() and 1 in quality.values()
    assert {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in made} == wanted
