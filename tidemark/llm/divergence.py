"""Source divergence audit: how far each source's use of words lies from the other sources and from its language.

Each text's terms are counted where it is read, and summed by (lang, source, term) with a map-side combine. Then each
kept term becomes one wide row: an array with a place for each source of its language. Higher-order functions make
smoothed shares of it and emit a contribution for each pair of sources, which a map-side aggregation sums. Nothing is
collected but a term's array and a language's, which are as long as the language has sources, as is each `pair` group
of the result.

A null text, lang or source is ''. A text without terms counts nowhere, but its group exists. Repeated rows count as
often as they stand. Ties rank by the item's UTF-8 bytes. An empty table gives no rows. Columns are taken by name, so
others of any name pass by unread. Shares are whole numbers, in parts of SCALE, and exact at any count.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, map_batches, materialize, table

#: A term is a run of letters: A to Z, a to z, and everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What becomes of each byte of a text in UTF-8: A to Z are lowered, what parts terms becomes a space. Characters beyond ASCII have bytes from 128 on alone.
LOWERED = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))

#: Parts that a share is counted in, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 5
#: Documents of a language that a term stands in at least, and the ranks of the term part.
LEAST_DOCS, RANKS = 30, 50


def _counted(columns: dict[str, list]) -> pa.RecordBatch:
    """lang, source, term, n of each text's terms."""
    own = [Counter(text.encode("utf-8", "surrogatepass").translate(LOWERED).split()) for text in columns["text"]]
    row = pa.array(np.repeat(np.arange(len(own)), np.fromiter(map(len, own), np.int64, len(own))))
    made = [pa.array(columns[c], pa.string()).take(row) for c in ("lang", "source")]
    made.append(pa.array(list(chain.from_iterable(own)), pa.binary()).cast(pa.string()))
    made.append(pa.array(list(chain.from_iterable(c.values() for c in own)), pa.int64()))
    return pa.RecordBatch.from_arrays(made, ["lang", "source", "term", "n"])


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term, n_docs, counts (source, n): the terms in at least so many documents of their language."""
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    met = map_batches(named, _counted, "lang string, source string, term string, n long")
    counted = met.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    wide = counted.groupBy("lang", "term").agg(F.sum("docs").alias("n_docs"), F.collect_list(F.struct("source", "n")).alias("counts"))  # a source each
    return wide.where(F.col("n_docs") >= least)


def source_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, sources (sorted), totals (of kept terms, by source), total, n_terms: a row for each language."""
    present = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    sums = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    by_lang = present.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    return by_lang.join(sizes, "lang", "left").select("lang", F.col("all.source").alias("sources"), F.col("all.n").alias("totals"), F.expr("aggregate(all.n, 0L, (a, x) -> a + x)").alias("total"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))


def _share(count: str, total: str) -> str:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * n_terms)), in decimals, so that no product overflows."""
    return f"1 + (cast({count} + {ADDED} as decimal(19, 0)) * {SCALE}) div cast({total} + {ADDED} * n_terms as decimal(20, 0))"


def shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, sources, n (counts by place in sources), p (their shares), q (the language's share).

    groups has a row for each language; whether it is small enough to be broadcast is for Spark to see from its size.
    """
    rows = kept.select("lang", "term", F.map_from_entries("counts").alias("_n")).join(groups, "lang")
    rows = rows.withColumn("n", F.expr("transform(sources, s -> coalesce(_n[s], 0L))"))
    rows = rows.withColumn("p", F.expr(f"transform(n, (c, i) -> {_share('c', 'totals[i]')})"))
    rows = rows.withColumn("q", F.expr(_share("aggregate(n, 0L, (a, x) -> a + x)", "total")))
    return rows.select("lang", "term", "sources", "n", "p", "q")


def pair_divergence(wide: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the summed difference of shares between each source and each other of its language."""
    first = wide.select("lang", "p", F.posexplode("p").alias("a", "x"))
    apart = first.select("lang", "a", F.explode(F.expr("transform(slice(p, a + 2, size(p)), (y, j) -> struct(a + 1 + j as b, abs(x - y) as f))")).alias("e"))
    sums = apart.select("lang", "a", "e.b", "e.f").groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    sides = groups.select("lang", "sources", F.posexplode("sources").alias("_i", "source")).select("lang", "source", "_i", F.posexplode("sources").alias("_j", "item")).where("_i <> _j")
    sides = sides.withColumns({"a": F.least("_i", "_j"), "b": F.greatest("_i", "_j")})
    return sides.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def term_divergence(wide: DataFrame) -> DataFrame:
    """lang, source, item, value: each term that a source has, by how much its share there is above the language's."""
    above = F.expr("filter(transform(sources, (s, i) -> struct(s as source, n[i] as n, p[i] - q as value)), x -> x.n > 0 and x.value > 0)")
    return wide.select("lang", F.col("term").alias("item"), F.explode(above).alias("x")).select("lang", "x.source", "item", "x.value")


def audit(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` whole, part `term` to so many ranks."""
    kept = materialize(term_counts(docs, least))
    groups = materialize(source_groups(docs, kept))
    wide = shares(kept, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = materialize(pair_divergence(wide, groups).withColumn("rank", F.row_number().over(order)))
    # ranked within each task before the shuffle: a group sends so many rows a task at most
    terms = materialize(term_divergence(wide).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks))
    discard(kept, groups)
    parts = [rows.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for name, rows in (("pair", pairs), ("term", terms))]
    return parts[0].unionByName(parts[1])


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


#: The same in SQL; sums of counts are HUGEINT there, so products don't overflow.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM t JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) x QUALIFY part = 'pair' OR rank <= 50
"""
