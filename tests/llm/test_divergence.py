import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, counts string, sources string"


def brute(rows, least, ranks):
    docs = [(lang or "", source or "", re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    made = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in in_docs.items() if n >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())

        def shares(c, kept=kept):
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                made += [(lang, s, part, item, v, n) for n, (item, v) in enumerate(items[:most], 1)]
    return sorted(made)


def documents(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def plain(made):
    assert made.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in made.collect())


def test_against_plain_counts(spark):
    rng = random.Random(7)
    words = ["The", "the", "ÉTÉ", "été", "ab1c", "ß", "x", "zz", "語", "Ω", "a-b", "un"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "s2", "s10", None, ""])) for i in range(150)]
    rows += rows[:10] + [(None, None, "en", "s3"), (500, "", "de", "only"), (501, "12 !", "xx", "b"), (502, None, "xx", "a"), (503, "\x00the\x7fthe", "en", "s1")]
    for least, ranks in ((3, 50), (8, 2), (1000, 5)):
        assert plain(divergence.audit(documents(spark, rows), least, ranks)) == brute(rows, least, ranks)


def test_equal_values_rank_by_bytes(spark):
    rows = [(i, "same words", "en", s) for i, s in enumerate(["b", "a", "é", "Z", "c"] * 4)]
    made = plain(divergence.audit(documents(spark, rows), 1))
    assert [r[3] for r in made if r[1] == "a"] == ["Z", "b", "c", "é"] and {r[4] for r in made} == {0}
    assert made == brute(rows, 1, 50)


def test_empty_table_and_long_text(spark):
    rows = [(1, "Word " * 300_000 + "end", "en", "a"), (2, "x" * 500_000, "en", "b")]
    assert divergence.audit(documents(spark, rows).limit(0)).collect() == []
    assert plain(divergence.audit(documents(spark, rows), 1)) == brute(rows, 1, 50)


def test_shares_beyond_64_bits(spark):
    """Counts of a corpus far larger than a test's: products go beyond 2^63."""
    n = [10**15 + 7, 3, 0]
    kept = spark.createDataFrame([("en", "t", [("a", n[0]), ("b", n[1])])], "lang string, term string, counts array<struct<source:string,n:long>>")
    groups = spark.createDataFrame([("en", ["a", "b", "c"], [2 * 10**15, 10**12, 0], 2 * 10**15 + 10**12, 40_000)], "lang string, sources array<string>, totals array<long>, total long, n_terms long")
    row = divergence.shares(kept, groups).first()
    assert row["p"] == [1 + 10**9 * (c + 5) // (t + 200_000) for c, t in zip(n, [2 * 10**15, 10**12, 0], strict=True)]
    assert row["q"] == 1 + 10**9 * (sum(n) + 5) // (2 * 10**15 + 10**12 + 200_000)


def test_term_ranks_are_cut_before_the_shuffle(spark):
    wide = spark.createDataFrame([("en", "t", ["a"], [1], [3], 2)], "lang string, term string, sources array<string>, n array<long>, p array<long>, q long")
    order = divergence.Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    plan = divergence.term_divergence(wide).withColumn("rank", F.row_number().over(order)).where("rank <= 50")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
