"""Quality rules as a ledger of failure bits, with versioned policies and ablations.

measure() reads each text once and stores what the rules need; judge() evaluates
every rule once and stores the failures as bits beside the measurements. Policies
are masks over those bits, so changing a policy, or asking what a rule contributes,
reads the ledger alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, table, texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_bangs long, n_unspaced long, n_wordy long"


@dataclass(frozen=True)
class Rule:
    """A rule fails a text if `fails` holds; its bit in the ledger is its place in RULES and never changes."""

    name: str
    fails: str


#: Append only: a stored ledger refers to these places.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("shouting", "2 * n_upper > n_letters"),
    Rule("exclamations", "5 * n_bangs > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("long_runs", "n_unspaced > 5 * n_words"),
    Rule("few_letters", "100 * n_wordy < 70 * n_words"),
)

#: Versions of the policy: the rules whose failure rejects a text.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    places = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << places[name] for name in POLICIES[policy])


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
    pair = ids[:-1] * len(place) + ids[1:]
    if len(place) >= 1 << 20:  # keep the product of three below 2^63
        pair = np.unique(pair, return_inverse=True)[1]
    _, where, count = np.unique(pair[:-1] * len(place) + ids[2:], return_inverse=True, return_counts=True)
    starts = count[where] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(starts)] |= starts
    return int(covered.sum())


def measured(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    ascii_letters = raw.translate(None, bytes(set(range(256)) - {*range(65, 91), *range(97, 123)}))
    upper = len(ascii_letters.translate(None, bytes(range(97, 123))))
    wordy = len(b" ".join(words).translate(None, b"".join(bytes([b]) for b in range(33, 65)) + b"[\\]^_`{|}~").split())
    longest = max(map(len, words), default=0)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        len(ascii_letters),
        raw.count(b"!"),
        longest,
        wordy,
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text; a null text measures as the empty one. Repeated rows and null ids keep rows of their own; an empty table gives none."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def each(columns: dict[str, list]) -> pa.RecordBatch:
        rows = np.array([measured(t) for t in columns["text"]], np.int64).reshape(-1, len(names))
        return pa.RecordBatch.from_arrays([pa.array(columns["doc_id"], pa.int64()), *(pa.array(rows[:, i]) for i in range(len(names)))], ["doc_id", *names])

    return map_batches(texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, f"doc_id long, {MEASURES}")


def judge(measures: DataFrame) -> DataFrame:
    """The ledger: the measurements and `failures`, a bit for each rule that fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measures.withColumn("failures", total.cast("long"))


def passes(policy: str, failures: Column | str = "failures") -> Column:
    failures = F.col(failures) if isinstance(failures, str) else failures
    return failures.bitwiseAND(F.lit(mask(policy))) == 0


def ablation(ledger: DataFrame, policy: str) -> DataFrame:
    """rule, n_failed, n_only: texts that a rule of the policy fails, and those that it alone fails.

    n_only is what the policy would keep in addition without the rule. One pass:
    rows are first counted by their failure bits, of which there are few kinds.
    """
    kinds = ledger.groupBy(F.col("failures").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r.name in POLICIES[policy]])
    each = kinds.select("bits", "n", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(F.expr("bits & r.bit") != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.expr("bits = r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
    )


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = judge(measure(table(spark, sf_dir, "documents")))
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v2").alias("kept"))


#: The same in SQL, with the rules of policy v2 spelt out.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT r, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) > 1 AS again FROM g WHERE w3 IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, (VALUES (0), (1), (2)) v(k) WHERE again GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines,
    length(regexp_replace(d.text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(d.text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(d.text, '[^!]', '', 'g')) AS n_bangs,
    coalesce(list_max(list_transform(w.words, lambda x: octet_length(encode(x)))), 0) AS n_unspaced,
    coalesce(len(list_filter(w.words, lambda x: regexp_matches(x, '[^!-@\[\\\]^_`{|}~]'))), 0) AS n_wordy
  FROM d JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN c USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_upper > n_letters OR 5 * n_bangs > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_unspaced > 5 * n_words OR 100 * n_wordy < 70 * n_words) AS kept
FROM m
"""
