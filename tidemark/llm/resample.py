"""Quality classifier by importance resampling over hashed n-grams.

Two generative models of hashed n-grams are counted: one of target text (labelled
good), one of the raw corpus, all of it. A text's importance weight is the ratio of
its probabilities under the two; sampling the texts without replacement in
proportion to their weights is the Gumbel top-k: the k highest of log weight plus
Gumbel noise. k is the share of good texts among the labels, at its upper
confidence bound (one standard error), times the number of texts.

N-grams are words and marks, pairs of them, and for each place whether it repeats
the token before it, or the one before that.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import HashedWords, identified, map_batches, materialize, same_rows, slices, table, texts

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Added to the hashed buckets: a token like none, the last, the last but one.
REPEATS = 3


class Hasher:
    """Buckets of all n-grams of a batch of texts."""

    def __init__(self, buckets: int):
        self.buckets, self.words = buckets, HashedWords(7)

    def features(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams' buckets and the texts that they belong to."""
        tokens: list[bytes] = []
        counts = np.zeros(len(batch), np.int64)
        for n, text in enumerate(batch):
            found = TOKEN.findall(text)
            counts[n] = len(found)
            tokens += [t.encode("utf-8", "surrogatepass") for t in found]
        h = self.words.of(tokens)
        text = np.repeat(np.arange(len(batch), dtype=np.int32), counts)
        one = (h % np.uint64(self.buckets)).astype(np.int32)
        same = text[1:] == text[:-1]
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
        pair ^= pair >> np.uint64(29)
        two = (pair % np.uint64(self.buckets)).astype(np.int32)[same]
        last = np.zeros(len(h), bool)
        last[1:] = same & (h[1:] == h[:-1])
        before = np.zeros(len(h), bool)
        before[2:] = (text[2:] == text[:-2]) & (h[2:] == h[:-2])
        repeat = (self.buckets + np.where(last, 1, np.where(before, 2, 0))).astype(np.int32)
        return np.concatenate([one, two, repeat]), np.concatenate([text, text[1:][same], text])


def count_models(docs: DataFrame, target: str, buckets: int) -> DataFrame:
    """bucket, raw, target: n-grams of all texts, and of those where the column `target` is true."""
    size = buckets + REPEATS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, raw, good = Hasher(buckets), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for part in slices(batches):
            wanted = np.array([bool(x) for x in part.column(1).to_pylist()])
            features, text = hasher.features(part.column(0).to_pylist())
            raw += np.bincount(features, minlength=size)
            good += np.bincount(features[wanted[text]], minlength=size)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "target"])

    counted = docs.select("text", target).mapInArrow(run, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(models: DataFrame, buckets: int) -> np.ndarray:
    """log of target over raw probability by bucket, one added to each count; a fixed, small number of rows."""
    size = buckets + REPEATS
    raw, target = np.ones(size), np.ones(size)
    for row in models.collect():  # one row a bucket
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    if target.sum() == size:  # no target text: nothing is told apart
        return np.zeros(size)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratios: np.ndarray, buckets: int) -> DataFrame:
    """doc_id, text_hash, log_weight: the log importance weight of each whole text, 0 for one without tokens."""

    def each(columns: dict[str, list], hasher: Hasher) -> pa.RecordBatch:
        features, text = hasher.features(columns["text"])
        weights = np.bincount(text, weights=ratios[features], minlength=len(columns["text"])).astype(float)  # whole numbers where no text has a token
        return pa.RecordBatch.from_arrays([pa.array(columns["doc_id"], pa.int64()), pa.array(columns["text_hash"], pa.int64()), pa.array(weights)], ["doc_id", "text_hash", "log_weight"])

    return map_batches(identified(docs), each, "doc_id long, text_hash long, log_weight double", lambda: Hasher(buckets))


def gumbel(seed: int, *keys: str) -> Column:
    """Standard Gumbel noise, a function of the keys and the seed."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def top_threshold(keys: DataFrame, column: str, k: int) -> float:
    """The k-th highest value, exactly: its bits are found 16 at a time by counts, over all rows.

    -inf if there are no more than k rows. No row is sorted or sent to the driver, only counts by digit.
    """
    raw = keys.select(double_order(F.col(column)).alias("order"))
    total = raw.count()
    if k >= total:
        return -math.inf
    left, prefix = max(k, 1), 0
    for shift in (48, 32, 16, 0):
        inside = raw if shift == 48 else raw.where(F.shiftright("order", shift + 16) == F.lit(prefix))
        digit = F.shiftright("order", shift).bitwiseAND(F.lit(0xFFFF)) if shift < 48 else F.shiftright("order", 48)
        counts = sorted(((r["digit"], r["n"]) for r in inside.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for value, n in counts:
            if left <= n:
                prefix = (prefix << 16) + value if shift < 48 else value
                break
            left -= n
    return order_double(prefix)


SCALE = 1 << 32


def double_order(value: Column) -> Column:
    """A whole number in the order of the values: fixed point with 32 binary places, held within 64 bits."""
    return F.greatest(F.least(F.round(value * F.lit(float(SCALE))), F.lit(9.2e18)), F.lit(-9.2e18)).cast("long")


def order_double(order: int) -> float:
    return order / SCALE


def select(docs: DataFrame, labels: DataFrame, buckets: int = 10_000, max_labelled: int = 20_000, temperature: float = 1.0, seed: int = 7) -> DataFrame:
    """doc_id, text_hash, log_weight, key, kept: a row for each row of docs.

    labels: doc_id, quality (1: good). The target model is counted on at most
    max_labelled labelled good texts, those of the lowest hash of doc_id; the raw
    model on all texts. Labels that differ for one doc_id count as good. Without
    labels of either kind all are kept, with empty labels too. Nulls: an empty
    text has weight 1; a null doc_id is a row like any other.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    n_labels, n_good = known.agg(F.count("*"), F.sum((F.col("quality") == 1).cast("long"))).first()
    good = known.where("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    wanted = F.broadcast(good.withColumn("target", F.lit(True)))  # at most max_labelled ids
    models = count_models(texts(docs).join(wanted, "doc_id", "left").select("text", "target"), "target", buckets)
    ratios = log_ratios(models, buckets)
    scored = materialize(log_weights(docs, ratios, buckets).withColumn("key", F.col("log_weight") + F.lit(float(temperature)) * gumbel(seed, "doc_id", "text_hash")))
    share = (n_good or 0) / n_labels if n_labels else 1.0
    if n_labels:
        share = min(1.0, share + math.sqrt(share * (1 - share) / n_labels))
    n = scored.count()
    threshold = top_threshold(scored, "key", math.ceil(share * n)) if n_good else -math.inf
    return scored.withColumn("kept", double_order(F.col("key")) >= F.lit(-(1 << 63) if threshold == -math.inf else round(threshold * SCALE)).cast("long"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are selected, with all their columns."""
    return same_rows(docs, select(docs, labels, **options).where("kept"), "left_semi")


def op7_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the resampling selects."""
    made = select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return made.where("kept").select("doc_id", F.round("log_weight", 6).alias("log_weight"), "kept")
