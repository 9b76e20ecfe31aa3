"""Language identification: a letter model of words, script ranges, and a path through a text's words that seldom switches.

A word is a run of letters of one script. Each of its letters is judged with both neighbours (the word's ends included)
by the shares that these three have in each language's training texts; a word's score is the sum over its letters.
Languages that hardly use the word's script are no candidates for it. A Viterbi path through the words, with a penalty
for each switch, labels spans; a text's language is that with most letters in its spans.

Learning reads at most `most` distinct texts of a language (fewer languages than MOST_LANGUAGES, those with most texts),
taken by a hash of the text, so by neither place nor id, and copies count once; the counts are made in the tasks, summed by Spark, and
of bounded size. Every whole text is then labelled; one of more than PART code points in parts that are cut between
words, each with a path of its own, whose spans join where the language goes on.

A null text, an empty one and one without letters have the language `und`, score 0 and no spans; so has every text if
there is nothing to learn from. Texts of scripts that no language was learned in are labelled by their first learned
language, with score 0. Repeated rows are rows of their own; a null doc_id is never held out and never learned from;
of languages that are as likely the first by name counts. Further columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table, texts, tuned

# Blocks of the Unicode standard by script; letters elsewhere form a script of their own.
SCRIPTS = {
    "Latin": "0041-024F 1E00-1EFF 2C60-2C7F A720-A7FF AB30-AB6F FF21-FF5A",
    "Greek": "0370-03FF 1F00-1FFF",
    "Cyrillic": "0400-052F 1C80-1C8F 2DE0-2DFF A640-A69F",
    "Armenian": "0530-058F FB13-FB17",
    "Hebrew": "0590-05FF FB1D-FB4F",
    "Arabic": "0600-06FF 0750-077F 08A0-08FF FB50-FDFF FE70-FEFF",
    "Devanagari": "0900-097F",
    "Bengali": "0980-09FF",
    "Gurmukhi": "0A00-0A7F",
    "Gujarati": "0A80-0AFF",
    "Oriya": "0B00-0B7F",
    "Tamil": "0B80-0BFF",
    "Telugu": "0C00-0C7F",
    "Kannada": "0C80-0CFF",
    "Malayalam": "0D00-0D7F",
    "Sinhala": "0D80-0DFF",
    "Thai": "0E00-0E7F",
    "Lao": "0E80-0EFF",
    "Tibetan": "0F00-0FFF",
    "Myanmar": "1000-109F",
    "Georgian": "10A0-10FF 1C90-1CBF 2D00-2D2F",
    "Hangul": "1100-11FF 3130-318F AC00-D7AF",
    "Ethiopic": "1200-139F",
    "Khmer": "1780-17FF",
    "Kana": "3040-30FF 31F0-31FF FF66-FF9F",
    "Han": "3400-4DBF 4E00-9FFF F900-FAFF 20000-3FFFF",
}

UNDETERMINED = "und"
#: Distinct texts of a language that are learned from, and languages.
MOST_TEXTS, MOST_LANGUAGES = 4000, 256
#: Share of a language's letters that a script must have for the language to be a candidate there.
LEAST_SHARE = 0.01
#: What a switch of language costs, in nats; what is added to each count.
SWITCH, ADDED = 14.0, 0.1
#: Entries of the model over all languages, and bytes of text that a task labels at a time.
ENTRIES, PART = 1 << 22, 1 << 21


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case (itself where that is not one code point), and its script (0: no letter)."""
    points = [chr(i) for i in range(0x110000)]
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in points), np.uint32, 0x110000)
    script = np.where(np.fromiter(map(str.isalpha, points), bool, 0x110000), len(SCRIPTS) + 1, 0).astype(np.uint8)
    for n, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in (x.split("-") for x in ranges.split()):
            part = script[int(a, 16) : int(b, 16) + 1]
            part[part > 0] = n
    return lower, script


@dataclass
class Words:
    """The words of texts: text, start and end (in code points, of its text), script; and of each letter its gram and its word."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    grams: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return self.end - self.start


def words_of(batch: list[str]) -> Words:
    lower, scripts = letters()
    lengths = np.fromiter(map(len, batch), np.int64, len(batch))
    points = np.frombuffer(" ".join(["", *batch, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)  # a space before, between and after
    script = scripts[points]
    letter = script > 0
    first = letter[1:-1] & (script[1:-1] != script[:-2])
    last = letter[1:-1] & (script[1:-1] != script[2:])
    start, end = np.flatnonzero(first) + 1, np.flatnonzero(last) + 2
    folded = np.where(letter, lower[points], 32).astype(np.uint64)
    middle = np.flatnonzero(letter[1:-1]) + 1
    before = np.where(first[middle - 1], np.uint64(32), folded[middle - 1])
    after = np.where(last[middle - 1], np.uint64(32), folded[middle + 1])
    grams = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (folded[middle] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after * np.uint64(0x165667B19E3779F9))
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    offsets = np.cumsum(lengths + 1) - lengths  # of each text in points
    text = np.searchsorted(offsets, start, "right") - 1
    return Words(text, start - offsets[text], end - offsets[text], script[start], grams)


def pieces(text: str, most: int) -> Iterator[tuple[int, str]]:
    """The text in parts of at most so many code points, each with its place, cut where no word is."""
    at = 0
    while len(text) - at > most:
        end = at + most
        while end > at and text[end - 1].isalpha() and text[end].isalpha():
            end -= 1
        end = end if end > at else at + most  # a word that long is cut
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def _grouped(batch: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Place in the batch, place in the text and text of parts to be taken up together: all of a batch of slices(), or one part of its only text."""
    parts = ((n, at, part) for n, text in enumerate(batch) for at, part in pieces(text, PART))
    if sum(map(len, batch)) <= PART:
        yield list(parts)
    else:
        yield from ([x] for x in parts)


def _tops(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Log shares of grams by language (rows: grams), and which languages are candidates for a script (rows: scripts)."""

    languages: list[str]
    bits: int
    shares: np.ndarray
    allowed: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Of each word (rows) in each language, 0 for the best: what is no candidate has the worst of the word's scores and a switch's cost below it; a word without candidates tells nothing."""
        ends = np.cumsum(words.sizes)
        made = np.empty((len(ends), len(self.languages)))
        step = 1 << 18  # words at a time
        for at in range(0, len(ends), step):
            part = slice(at, at + step)
            low = ends[at - 1] if at else 0
            grams = _tops(words.grams[low : ends[part][-1]], self.bits)
            made[part] = np.add.reduceat(self.shares[grams], np.r_[0, ends[part][:-1] - low], axis=0, dtype=np.float64)
        allowed = self.allowed[words.script]
        made = np.where(allowed, made, made.min(axis=1, keepdims=True) - SWITCH)
        made[~allowed.any(axis=1)] = 0
        return made - made.max(axis=1, keepdims=True, initial=-np.inf)


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each word on its text's best path. scores: a row a word; sizes: words of each text, in order.

    All texts take their steps together. Texts whose best path surely has one label are decided without steps:
    no run of words gains as much as a switch by another label.
    """
    labels = np.zeros(len(scores), np.int64)
    starts = np.cumsum(sizes) - sizes
    some = np.flatnonzero(sizes > 0)
    if not len(some):
        return labels
    best = np.add.reduceat(scores, starts[some], axis=0).argmax(axis=1)
    own = np.repeat(np.arange(len(some)), sizes[some])
    labels[:] = best[own]
    gain = scores - scores[np.arange(len(scores)), labels][:, None]
    run = np.cumsum(gain, axis=0)
    apart = np.ptp(run, axis=0) + 1.0  # the running sum of each text starts lower than all before it
    run -= own[:, None] * apart
    low = np.minimum.accumulate(np.r_[np.zeros((1, run.shape[1])), run[:-1]])
    low[starts[some]] = run[starts[some]] - gain[starts[some]]
    low = np.minimum.accumulate(low)
    most = np.maximum.reduceat((run - low).max(axis=1), starts[some])
    hard = some[most >= switch * 0.999]
    hard = hard[np.argsort(-sizes[hard], kind="stable")]
    if len(hard):
        _stepped(scores, starts[hard], sizes[hard], switch, labels)
    return labels


def _stepped(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, switch: float, labels: np.ndarray) -> None:
    """Sets the labels of texts (longest first) by the best path."""
    n = scores.shape[1]
    value = scores[starts].copy()
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # texts with at least so many words
    back = np.empty((int(sizes.sum()), n), np.int16)
    rows = np.cumsum(active) - active
    stay = np.arange(n)
    for t in range(1, sizes[0]):
        k = active[t]
        top = value[:k].argmax(axis=1)
        jump = value[np.arange(k), top] - switch
        jumps = value[:k] < jump[:, None]
        back[rows[t] : rows[t] + k] = np.where(jumps, top[:, None], stay)
        value[:k] = np.where(jumps, jump[:, None], value[:k]) + scores[starts[:k] + t]
    now = value.argmax(axis=1)
    for t in range(sizes[0] - 1, -1, -1):
        k = active[t]
        labels[starts[:k] + t] = now[:k]
        if t:
            now[:k] = back[rows[t] + np.arange(k), now[:k]]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label is never learned from; not for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _sampled(docs: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """lang, text of at most about `most` distinct texts of each language, and the languages."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    known = known.select("lang", "text", F.xxhash64("text").alias("hash"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return known.select("lang", "text").limit(0), []
    shares = known.sparkSession.createDataFrame([(r["lang"], min(1.0, most / max(1, r["n"]))) for r in sizes], "lang string, share double")
    chosen = known.join(F.broadcast(shares), "lang").where((F.shiftrightunsigned("hash", 32) / F.lit(2.0**32)) <= F.col("share"))  # 256 rows at most
    return chosen.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text"), sorted(r["lang"] for r in sizes)


def learn(docs: DataFrame, most: int = MOST_TEXTS) -> Model | None:
    """A model of the languages of docs, from rows that are not held out; None if there are none."""
    sample, languages = _sampled(docs, most)
    if not languages:
        return None
    bits = min(16, (ENTRIES // len(languages)).bit_length() - 1)
    place = {x: i for i, x in enumerate(languages)}
    n_scripts = len(SCRIPTS) + 2

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = {}, {}
        for part in slices(batches, PART):
            langs = np.array([place[x] for x in part.column(0).to_pylist()], np.int64)
            for group in _grouped(part.column(1).to_pylist()):
                words = words_of([x[2] for x in group])
                of_word = langs[[x[0] for x in group]][words.text]
                of_letter = np.repeat(of_word, words.sizes)
                for x in np.unique(of_word).tolist():
                    grams[x] = grams.get(x, 0) + np.bincount(_tops(words.grams[of_letter == x], bits), minlength=1 << bits)
                    scripts[x] = scripts.get(x, 0) + np.bincount(words.script[of_word == x], words.sizes[of_word == x], n_scripts).astype(np.int64)
        for kind, tables in enumerate((grams, scripts)):
            for x, counts in tables.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(np.full(len(at), x, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["kind", "lang", "at", "n"])

    sums = sample.mapInArrow(counted, "kind int, lang int, at int, n long").groupBy("kind", "lang", "at").agg(F.sum("n").alias("n")).toArrow()  # ENTRIES and a few at most
    kind, lang, at, n = (sums.column(c).to_numpy() for c in ("kind", "lang", "at", "n"))
    shares, scripts = np.full((1 << bits, len(languages)), ADDED), np.zeros((n_scripts, len(languages)))
    shares[at[kind == 0], lang[kind == 0]] += n[kind == 0]
    scripts[at[kind == 1], lang[kind == 1]] += n[kind == 1]
    shares = np.log(shares / shares.sum(axis=0)).astype(np.float32)
    allowed = scripts >= np.maximum(1, LEAST_SHARE * scripts.sum(axis=0))
    return Model(languages, bits, shares, allowed)


SPANS = "array<struct<start:long,end:long,lang:string>>"


def _labelled(batch: list[str], model: Model) -> tuple[list, list, list]:
    """Language, score and spans of each text."""
    n = len(model.languages)
    seen, total, spans = np.zeros((len(batch), n)), np.zeros(len(batch)), [[] for _ in batch]
    for group in _grouped(batch):
        owner, offset = (np.array(x, np.int64) for x in list(zip(*group, strict=True))[:2])
        words = words_of([x[2] for x in group])
        if not len(words.text):
            continue
        scores = model.scores(words)
        labels = viterbi(scores, np.bincount(words.text, minlength=len(group)))
        of = owner[words.text]
        np.add.at(seen, (of, labels), words.sizes * (np.ptp(scores, axis=1) > 0 if n > 1 else model.allowed[words.script, 0]))
        total += np.bincount(of, words.sizes, len(batch))
        firsts = np.flatnonzero(np.r_[True, (words.text[1:] != words.text[:-1]) | (labels[1:] != labels[:-1])])
        ends = words.end[np.r_[firsts[1:] - 1, len(labels) - 1]]
        place = offset[words.text[firsts]]
        for text, a, b, x in zip(of[firsts].tolist(), (words.start[firsts] + place).tolist(), (ends + place).tolist(), labels[firsts].tolist(), strict=True):
            if spans[text] and spans[text][-1]["lang"] == model.languages[x]:  # goes on in the next part
                spans[text][-1]["end"] = b
            else:
                spans[text].append({"start": a, "end": b, "lang": model.languages[x]})
    best = seen.argmax(axis=1)
    lang = [model.languages[b] if t else UNDETERMINED for b, t in zip(best.tolist(), total.tolist(), strict=True)]
    return lang, (seen[np.arange(len(batch)), best] / np.maximum(total, 1)).tolist(), spans


def label(docs: DataFrame, model: Model | None, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in spans of that language), spans (start, end in code points, lang)."""
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), *[F.array().cast(SPANS).alias("spans")] * spans)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of ENTRIES at most
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART):
            lang, score, found = _labelled(part.column(1).to_pylist(), shared.value)
            columns = [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(found, kind)] * spans, ["doc_id", "lang_pred", "score", "spans"][: 3 + spans])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double" + f", spans {SPANS}" * spans)


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return label(docs, learn(docs), spans=False).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
