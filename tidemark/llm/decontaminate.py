"""Benchmark decontamination: word n-grams as seeds, then Smith-Waterman alignment.

Every n-gram of a test item is a seed, however many texts hold it: the copies of an
item that leaked often make its n-grams common, so rarity tells nothing. A text that
shares one n-gram with an item is held against bounds that no alignment can exceed
(the item's words that the text has at all; those of the passage around the seeds),
which common phrases alone do not reach. What is left is aligned: the local
alignment's score, over that of the item with itself, tells copies, edited and
paraphrased ones too.

Items are taken in blocks of bounded size, so the tables that tasks hold don't grow
with the benchmark; one block is one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import identified, same_rows, slices, table

NORMAL = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
FOUND = "doc_id long, text_hash long, item_id long, similarity double, start_word int, end_word int, passage string"


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII marks part words."""
    return text.lower().encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Seeds:
    """The n-grams of a block of items, as sorted keys of word numbers."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width = width
        self.words = [words_of(t) for _, t in items]
        vocabulary: dict[bytes, int] = {}
        for words in self.words:
            for w in words:
                vocabulary.setdefault(w, len(vocabulary))
        self.vocabulary, self.bits = vocabulary, max(1, len(vocabulary).bit_length())
        self.ids = [np.array([vocabulary[w] for w in words], np.int64) for words in self.words]
        keys = [self.keys(i) for i in self.ids]
        self.all = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]))
        #: of each item the place in all of its n-grams, in order
        self.places = [np.searchsorted(self.all, k) for k in keys]
        # the items that hold each n-gram, each n-gram's together
        place, item = np.concatenate([np.zeros(0, np.int64), *self.places]), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(place, kind="stable")
        self.holders, self.held = item[order], np.searchsorted(place[order], np.arange(len(self.all) + 1))
        self.flat = np.concatenate([np.zeros(0, np.int64), *self.ids])
        self.sizes = np.array([len(i) for i in self.ids], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def keys(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) < self.width:
            return np.zeros(0, np.int64)
        key = np.zeros(len(ids) - self.width + 1, np.int64)
        for k in range(self.width):
            key = self.joined(key, ids[k : k + len(key)])
        return key

    def joined(self, key: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Keys with one word more: packed, or hashed where so many words don't fit; what two n-grams of one hash seed wrongly, alignment drops."""
        return (key << self.bits) | ids if self.bits * self.width <= 62 else key * np.int64(0x1E3779B97F4A7C15) + ids

    def hits(self, batch: list[str]) -> tuple[list[list[bytes]], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text and their numbers (-1: in no item); and of each n-gram found: its text, its place there, its place in all."""
        get = self.vocabulary.get
        words = [words_of(t) for t in batch]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter((get(w, -1) for text in words for w in text), np.int64, int(counts.sum()))
        of_text = np.split(ids, np.cumsum(counts)[:-1])
        n = len(ids) - self.width + 1
        if n < 1 or not len(self.all):
            none = np.zeros(0, np.int64)
            return words, of_text, none, none, none
        text = np.repeat(np.arange(len(batch)), counts)
        known = ids >= 0
        whole = text[self.width - 1 :] == text[:n]
        for k in range(self.width):
            whole &= known[k : k + n]
        at = np.flatnonzero(whole)
        key = np.zeros(len(at), np.int64)
        for k in range(self.width):
            key = self.joined(key, ids[at + k])
        place = np.minimum(np.searchsorted(self.all, key), len(self.all) - 1)
        met = self.all[place] == key
        at, place = at[met], place[met]
        starts = np.cumsum(counts) - counts
        return words, of_text, text[at], at - starts[text[at]], place

    def candidates(self, text_ids: np.ndarray, place: np.ndarray, least: float) -> np.ndarray:
        """Items that share an n-gram with a text, and of whose words the text has a share of `least`: no fewer are matched where an alignment reaches it."""
        items = np.unique(self.holders[_ranges(self.held[place], self.held[place + 1])])
        has = np.zeros(len(self.vocabulary) + 1, np.int64)
        has[text_ids] = 1
        has[-1] = 0
        sizes = self.sizes[items]
        met = np.add.reduceat(has[self.flat[_ranges(self.begins[items], self.begins[items] + sizes)]], np.cumsum(sizes) - sizes)
        return items[met >= least * sizes - 1e-9]


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each begin up to its end, one range after the other."""
    sizes = ends - begins
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def align(item: np.ndarray, passage: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Score of the best local alignment, and where it begins and ends in the passage."""
    score, end, row = _rows(item, passage, match, mismatch, gap, local=True)
    if not score:
        return 0, 0, 0
    # the same alignment from its end backwards is the best one that begins there
    _, back, _ = _rows(item[: row + 1][::-1], passage[: end + 1][::-1], match, mismatch, gap, local=False)
    return score, end - back, end + 1


def _rows(item: np.ndarray, passage: np.ndarray, match: int, mismatch: int, gap: int, local: bool) -> tuple[int, int, int]:
    """Best score, its column and its row; local: an alignment may begin anywhere, else at the first cell."""
    steps = np.arange(len(passage) + 1) * -gap
    above = np.zeros(len(passage) + 1, np.int64) if local else -steps
    best = (0, 0, 0)
    for i, word in enumerate(item):
        row = np.empty_like(above)
        row[0] = 0 if local else gap * (i + 1)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, match, mismatch), above[1:] + gap)
        if local:
            np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), j - 1, i)
        above = row
    return best


def passages_of(item: int, seeds: Seeds, text_ids: np.ndarray, starts: np.ndarray, least: float) -> tuple[float, int, int]:
    """The best alignment of an item over the passages where seeds would have it begin: similarity, first and end word.

    Passages that cannot reach `least`, or better than the best so far, are not aligned; without any the similarity is 0.
    """
    ids = seeds.ids[item]
    pad = len(ids) // 4 + 3
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > len(ids))
    low = np.maximum(0, starts[np.append(0, cut + 1)] - pad)
    high = np.minimum(len(text_ids), starts[np.append(cut, len(starts) - 1)] + len(ids) + pad)
    own = np.zeros(len(seeds.vocabulary) + 1, bool)
    own[ids] = True
    so_far = np.append(0, np.cumsum(own[text_ids]))
    best = (0.0, 0, 0)
    for k in np.flatnonzero(so_far[high] - so_far[low] >= least * len(ids) - 1e-9).tolist():
        passage = text_ids[low[k] : high[k]]
        # each of the item's words adds 2 if the passage has it, else takes 1, so the best stretch of the item bounds the score
        gains = np.append(0, np.cumsum(np.where(np.isin(ids, passage), 2, -1)))
        bound = int((gains - np.minimum.accumulate(gains)).max()) / (2 * len(ids))
        if bound < least or bound <= best[0]:
            continue
        score, first, end = align(ids, passage)
        if score / (2 * len(ids)) > best[0]:
            best = (score / (2 * len(ids)), int(low[k]) + first, int(low[k]) + end)
    return best


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about block_chars characters, cut by hash."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(total / block_chars)
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()  # bounded by block_chars
        yield sorted((r["item_id"], r["text"]) for r in rows)


def find(docs: DataFrame, benchmark: DataFrame, width: int = 3, least: float = 0.5, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, start_word, end_word, passage: each item's best passage in each text
    that reaches `least` of the item's own score.

    An item of common words alone reaches 0.46 in unrelated texts by chance; one with an eighth of its words edited, 0.8.
    Texts that are null or empty hold nothing; a text that shares no `width` words in a row with an item, as one with
    every third word edited, does not hold it, so items of fewer words are never found.
    Items that repeat with one id count once; equal items of different ids are each found; repeated rows of docs
    are each searched.
    """
    rows = identified(docs)
    parts = [_search(rows, items, width, least) for items in _blocks(benchmark, block_chars)]
    found = docs.sparkSession.createDataFrame([], FOUND)
    for part in parts:
        found = found.unionByName(part)
    return found


def _search(rows: DataFrame, items: list[tuple[int, str]], width: int, least: float) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Seeds(items, width))
    names = [i for i, _ in items]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for part in slices(batches):
            words, ids, text, where, place = seeds.hits(part.column(2).to_pylist())
            made = []
            for own in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1) if len(text) else []:
                t = int(text[own[0]])
                own = own[np.argsort(place[own], kind="stable")]
                at, seed = where[own], place[own]
                for item in seeds.candidates(ids[t], np.unique(seed), least).tolist():
                    low, high = np.searchsorted(seed, seeds.places[item]), np.searchsorted(seed, seeds.places[item], "right")
                    begins = at[_ranges(low, high)] - np.repeat(np.arange(len(low)), high - low)
                    similarity, first, end = passages_of(item, seeds, ids[t], begins, least)
                    if similarity >= least:
                        made.append((t, names[item], similarity, first, end, b" ".join(words[t][first:end]).decode("utf-8", "replace")))
            if made:
                t, item, similarity, first, end, passage = map(list, zip(*made, strict=True))
                own = part.take(pa.array(t))
                columns = [own.column(0), own.column(1), pa.array(item, pa.int64()), pa.array(similarity), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(passage)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FOUND.split(", ")])

    return rows.mapInArrow(search, FOUND)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no item was found, with all their columns."""
    return same_rows(docs, find(docs, benchmark, **options), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"))
