"""Repeated passages across documents: paragraphs banded by MinHash, verified, clustered, and cut.

Paragraphs are of two kinds. Lines of at least `line_words` words (of fewer than 49, one changed word inside takes
the Jaccard coefficient of five-word shingles under 0.8) get MinHash signatures over five-word shingles, banded so that a pair at the threshold collides
with the wanted recall; lines that collide are verified by the exact Jaccard
coefficient of their shingles. A passage that stands inside other text has no
lines of its own, so texts are also cut into short overlapping blocks that begin at
words chosen by their surroundings (the least hash among `spread` neighbouring
five-word shingles, as in winnowing): a passage of spread + block_words words or more
holds one of the same blocks wherever it stands, its first and last such blocks are
fewer than `spread` words from its ends, and those between touch. Blocks are banded by
their whole hash, and one that others hold reaches as far into the words around it,
fewer than `spread` to a side, as these are equal too: so the passage is found whole.

Equal paragraphs count as one, however many documents hold them. Clusters are the
components of verified links; of each cluster the occurrences in the smallest doc_id stay, the
others are removals. Removals and first occurrences that overlap or
touch are merged to runs, and runs shorter than `least_words` are dropped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, bucket_components, discard, materialize, of_several_nodes, slices, spare, table, texts

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
NO_SPACE = np.ones(256, bool)
NO_SPACE[[9, 10, 11, 12, 13, 32]] = False
WIDTH = 5


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """The fewest bands of so many rows in which a pair of that similarity collides with that recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class Words:
    """The words of a batch of texts: `data` holds the texts in lower case (ASCII), a newline after each; starts, ends: where each word lies
    in it; hashes; text: the text of each word; first: the first word of each text; past: the word after its last."""

    def __init__(self, batch: list[bytes]):
        self.data = b"\n".join([*batch, bytes(8)]).translate(LOWER)  # further bytes, as words are read by eight
        sizes = np.fromiter(map(len, batch), np.int64, len(batch)) + 1
        self.begins = np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(self.data, np.uint8)[: sizes.sum()]
        inside = np.zeros(len(self.bytes) + 1, bool)
        inside[1:] = NO_SPACE[self.bytes]  # the last byte is a newline
        bounds = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = bounds[::2], bounds[1::2]
        self.first = np.searchsorted(self.starts, self.begins)
        self.past = np.append(self.first[1:], len(self.starts))
        self.text = np.repeat(np.arange(len(batch)), self.past - self.first)
        self.hashes = xxh64(self.data, self.starts, self.ends, 3)

    def shingles(self) -> np.ndarray:
        """At each word the hash of the five words that begin there (of no use where the text ends before)."""
        return joined(self.hashes, WIDTH)

    def joined(self, begin: int, end: int) -> bytes:
        """Those bytes' words, joined by single spaces."""
        return b" ".join(self.data[begin:end].split())

    def lines(self, least: int) -> tuple[np.ndarray, ...]:
        """first byte, end, first word, number of words of the lines of at least so many words."""
        ends = np.flatnonzero(self.bytes == 10)
        past = np.searchsorted(self.starts, ends)
        begins, of = np.append(0, ends[:-1] + 1)[: len(ends)], np.append(0, past[:-1])[: len(ends)]
        long = np.flatnonzero(past - of >= least)
        return begins[long], ends[long], of[long], (past - of)[long]


def xxh64(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each of these parts of data, which goes on for seven bytes after the last: parts of under 32 bytes all at once, longer ones one by one."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    eight, four_bytes = (np.ndarray((len(data) - size + 1,), kind, data, strides=(1,)) for size, kind in ((8, "<u8"), (4, "<u4")))
    sizes = ends - starts
    made = sizes.astype(np.uint64) + np.uint64(seed) + five
    long, at = np.flatnonzero(sizes >= 32), starts.copy()
    for k in range(1, 4):
        of = np.flatnonzero(sizes >= 8 * k)
        if not len(of):
            break
        made[of] = turned(made[of] ^ (turned(eight[at[of]] * two, 31) * one), 27) * one + four
        at[of] += 8
    of = np.flatnonzero(sizes & 4)
    made[of] = turned(made[of] ^ (four_bytes[at[of]].astype(np.uint64) * one), 23) * two + three
    at[of] += 4
    single = np.frombuffer(data, np.uint8)
    for k in range(3):
        of = np.flatnonzero(sizes & 3 > k)
        made[of] = turned(made[of] ^ (single[at[of] + k].astype(np.uint64) * five), 11) * one
    made = (made ^ (made >> np.uint64(33))) * two
    made = (made ^ (made >> np.uint64(29))) * three
    made ^= made >> np.uint64(32)
    made[long] = np.fromiter((xxhash.xxh64_intdigest(data[starts[i] : ends[i]], seed) for i in long), np.uint64, len(long))
    return made


def mixed(x: np.ndarray, room: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """room: two arrays of that size to work in, the first of which the result is."""
    made, part = room or (np.empty_like(x), np.empty_like(x))
    np.right_shift(x, np.uint64(31), out=part)
    np.bitwise_xor(x, part, out=made)
    np.multiply(made, np.uint64(0x7FB5D329728EA185), out=made)
    np.right_shift(made, np.uint64(27), out=part)
    return np.bitwise_xor(made, part, out=made)


def joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """At each place a hash of the `width` hashes from there; past the end those there are."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out[: len(hashes) - k] += hashes[k:]
    return mixed(out)


def anchors(shingle: np.ndarray, usable: np.ndarray, spread: int) -> np.ndarray:
    """Places chosen by winnowing: the rightmost least of each `spread` neighbouring usable shingles of a text."""
    if len(shingle) < spread:
        return np.zeros(0, np.int64)
    # the place rides in the low bits, so the least is found with its place, and of equals the rightmost
    order = (shingle & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - (np.arange(len(shingle), dtype=np.uint64) & np.uint64(0xFFFFFF)))
    least, width = order, 1
    while width < spread:
        step = min(width, spread - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    so_far = np.append(0, np.cumsum(usable))
    full = so_far[spread:] - so_far[:-spread] == spread
    at = np.flatnonzero(full)
    back = (np.uint64(0xFFFFFF) - (least[at] & np.uint64(0xFFFFFF))).astype(np.int64)
    place = at + ((back - at) & 0xFFFFFF)
    return np.unique(place)


def found_blocks(words: np.ndarray, text: np.ndarray, first: np.ndarray, shingle: np.ndarray, spread: int, block_words: int) -> tuple[np.ndarray, ...]:
    """hash, text, start, end (words) of the anchored blocks of a batch; those that follow each other with one hash are one."""
    n = len(words) - block_words + 1
    if n < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    usable = np.zeros(len(words), bool)
    usable[: len(words) - WIDTH + 1] = text[WIDTH - 1 :] == text[: len(words) - WIDTH + 1]
    place = anchors(shingle, usable, spread)
    place = place[place < n]
    place = place[text[place] == text[place + block_words - 1]]
    hashes = joined(words, block_words)[place].view(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[place[1:]] != text[place[:-1]])
    begins = np.flatnonzero(new)
    ends = place[np.append(begins[1:], len(place))[: len(begins)] - 1] + block_words
    place, hashes = place[begins], hashes[begins]
    of_text = first[text[place]]
    return hashes, text[place], place - of_text, ends - of_text


def found_lines(words: Words, shingle: np.ndarray, line_words: int, factors: np.ndarray, bands: int) -> tuple[np.ndarray, ...]:
    """hash, text, start, end (words), band keys (a row each) of a batch's lines of at least line_words words. shingle: at each word of the batch, that of the five from there."""
    byte, end_byte, begins, counts = words.lines(line_words)
    if not len(begins):
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros((0, bands), np.uint64))
    # shingles of the long lines, each line's together
    sizes = counts - WIDTH + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    own = shingle[np.arange(ends[-1]) + np.repeat(begins - starts, sizes)]
    keys, rows = np.zeros((len(begins), bands), np.uint64), len(factors) // bands
    room = np.empty_like(own), np.empty_like(own)
    for k, factor in enumerate(factors):
        np.multiply(own, factor, out=room[0])
        keys[:, k // rows] = mixed(keys[:, k // rows] + np.minimum.reduceat(mixed(room[0], room), starts))
    keys = mixed(keys + np.arange(1, bands + 1, dtype=np.uint64))
    hashes = np.array([named(words.joined(a, b)) for a, b in zip(byte.tolist(), end_byte.tolist(), strict=True)], np.int64)
    owner = words.text[begins]
    start = begins - words.first[owner]
    return hashes, owner, start, start + counts, keys


def scanned(rows: DataFrame, spread: int, block_words: int, line_words: int, bands: int, band_rows: int, seed: int = 11) -> DataFrame:
    """kind (block, line), hash, doc_id, start, end (words), bands (of lines): the anchored blocks and the long lines of each text, whose words are hashed once for both."""
    factors = np.random.default_rng(seed).integers(1 << 62, size=bands * band_rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(encoded(part.column(1)))
            shingle = words.shingles()
            of_block = found_blocks(words.hashes, words.text, words.first, shingle, spread, block_words)
            *of_line, keys = found_lines(words, shingle, line_words, factors, bands)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            for kind, (hashes, owner, start, end), own in (("block", of_block, None), ("line", of_line, lists)):
                if len(hashes):
                    columns = [pa.repeat(kind, len(hashes)), pa.array(hashes), part.column(0).take(pa.array(owner)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
                    columns.append(pa.nulls(len(hashes), pa.list_(pa.int64())) if own is None else own)
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "hash", "doc_id", "start", "end", "bands"])

    return rows.select("doc_id", "text").mapInArrow(run, "kind string, hash long, doc_id long, start int, end int, bands array<long>")


def with_neighbours(rows: DataFrame, shared: DataFrame, spread: int, block_words: int) -> DataFrame:
    """The shared blocks (hash, doc_id, start, end, first_doc_id) with a 128-bit digest of their words, and left, right: hashes (four bytes each) of the
    1, 2, ... (under spread) words before and after each, as many as the text has."""
    of_doc = shared.groupBy("doc_id").agg(F.collect_list(F.struct("hash", "start", "end", "first_doc_id")).alias("spans"))  # blocks of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            of_part = Words(encoded(part.column(1)))
            words, first, past = of_part.hashes, of_part.first, of_part.past
            if len(words) < block_words:
                continue
            lists = part.column(2)
            owner, spans = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), lists.flatten()
            hashes, start, end, of = (c.to_numpy() for c in spans.flatten())
            # of the rows that repeat a doc_id only those with the block itself
            fits = first[owner] + end <= past[owner]
            at = np.where(fits, first[owner] + start, 0)
            fits &= joined(words, block_words)[at].view(np.int64) == hashes
            owner, hashes, start, end, of, at = owner[fits], hashes[fits], start[fits], end[fits], of[fits], at[fits]
            after = first[owner] + end
            sides = [around(words, at - 1, -1, np.minimum(start, spread - 1)), around(words, after, 1, np.minimum(past[owner] - after, spread - 1))]
            bounds = zip(of_part.starts[at].tolist(), of_part.ends[at + block_words - 1].tolist(), strict=True)
            told = [xxhash.xxh3_128_digest(of_part.joined(*x)) for x in bounds]
            columns = [pa.array(hashes), part.column(0).take(pa.array(owner)), pa.array(start), pa.array(end), pa.array(of), pa.array(told, pa.binary()), *sides]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "doc_id", "start", "end", "first_doc_id", "block", "left", "right"])

    schema = "hash long, doc_id long, start int, end int, first_doc_id long, block binary, left binary, right binary"
    return rows.join(of_doc, "doc_id").select("doc_id", "text", "spans").mapInArrow(run, schema)


def around(words: np.ndarray, at: np.ndarray, step: int, sizes: np.ndarray) -> pa.Array:
    """For each place the hashes of the first, the first two, ... of `sizes` words from there on in that direction."""
    most = int(sizes.max(initial=0))
    chain, made = np.zeros(len(at), np.uint64), np.zeros((len(at), most), np.int32)
    for k in range(most):
        chain = mixed(chain * np.uint64(0x9E3779B97F4A7C15) + words[np.clip(at + k * step, 0, len(words) - 1)])
        made[:, k] = (chain >> np.uint64(32)).astype(np.uint32).view(np.int32)
    bounds, held = np.append(0, 4 * np.cumsum(sizes)).astype(np.int32), made[np.arange(most) < sizes[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(held)])


def shingle_sets(rows: DataFrame, found: DataFrame, wanted: DataFrame, line_words: int = WIDTH) -> DataFrame:
    """node (the line), shingles (distinct hashes): of the wanted lines alone, each read from one document that holds it. line_words: those that all of them have at least."""
    holders = found.join(wanted, "line", "left_semi").groupBy("line").agg(F.min("doc_id").alias("doc_id"))
    holders = holders.groupBy("doc_id").agg(F.collect_list("line").alias("wanted"))  # lines of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(encoded(part.column(0)))
            shingle, some, names, sets = words.shingles().view(np.int64), [set(x) for x in part.column(1).to_pylist()], [], []
            for begin, end, first, count in zip(*(x.tolist() for x in words.lines(line_words)), strict=True):
                name, of = named(words.joined(begin, end)), some[words.text[first]]
                if name in of:
                    sets.append(np.unique(shingle[first : first + count - WIDTH + 1]))
                    names.append(name)
                    of.discard(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    made = rows.join(holders, "doc_id").select("text", "wanted").mapInArrow(run, "node long, shingles array<long>")
    return made.dropDuplicates(["node"])  # rows that repeat a doc_id


def encoded(texts: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]


def named(line: bytes) -> int:
    """Hash of a line: its words, ASCII letters in lower case, joined by single spaces."""
    return xxhash.xxh64_intdigest(line, 42) - (1 << 63)


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 less the exact Jaccard coefficient of two structs' shingles: a metric."""
    shared = F.size(F.array_intersect(a["shingles"], b["shingles"]))
    return 1 - shared / (F.size(a["shingles"]) + F.size(b["shingles"]) - shared)


def prefix_pairs(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of nodes of different roots that may reach the similarity, by prefix filtering, exactly.

    Of n shingles, the rarest n - ceil(similarity * n) + 1 are a line's prefix. Two lines of that Jaccard
    coefficient share a shingle of their prefixes, whatever the order of shingles is; by rarity, what a common template gives
    to thousands of lines of one bucket comes last, and such lines don't meet. Shingles that one root alone holds can't be
    shared, which bounds what two lines can reach: edited copies of one line, each with edits of its own, are told apart by these counts.
    """
    words = left.join(sets, "node").select("node", "root", F.explode("shingles").alias("shingle"))
    rarity = words.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    of_line = words.join(rarity, "shingle").groupBy("node", "root").agg(F.sort_array(F.collect_list(F.struct("n", "shingle", "low", "high"))).alias("ordered"))  # shingles of one line
    size = F.size("ordered")
    prefix = F.slice("ordered", 1, (size - F.ceil(size * F.lit(similarity) - F.lit(1e-9)) + 1).cast("int"))
    own = F.size(F.filter("ordered", lambda p: p["low"] == p["high"]))
    shared = F.transform(F.filter(prefix, lambda p: p["low"] < p["high"]), lambda p: p["shingle"])
    held = of_line.select("node", "root", size.alias("size"), (size - own).alias("most"), shared.alias("prefix")).select("node", "root", "size", "most", "prefix", F.posexplode("prefix").alias("n", "shingle"))
    # a pair meets at the first shingle that both prefixes have, and those before it are no part of what it shares
    held = materialize(held.select("shingle", "node", "root", "size", (F.col("most") - F.col("n")).alias("most"), F.expr("slice(prefix, 1, n)").alias("before")))
    a, b = (held.select("shingle", F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("root", "size", "most", "before")]) for side in "ab")
    most = F.least("most_a", "most_b")
    reach = most >= F.lit(similarity) * (F.col("size_a") + F.col("size_b") - most) - F.lit(1e-9)
    return a.join(b, (a["shingle"] == b["shingle"]) & (F.col("root_a") < F.col("root_b")) & reach & ~F.arrays_overlap("before_a", "before_b")).select("a", "b")


def line_clusters(rows: DataFrame, found: DataFrame, similarity: float, line_words: int = WIDTH) -> DataFrame:
    """node, root: lines that near duplicates tie together."""
    distinct = materialize(found.groupBy(F.col("line").alias("node")).agg(F.first("bands").alias("bands"), F.count("*").alias("weight")))
    members = materialize(of_several_nodes(distinct.select("node", "weight", F.explode("bands").alias("key"))))
    sets = materialize(shingle_sets(rows, found, members.select(F.col("node").alias("line")).distinct(), line_words))
    tied = bucket_components(members, jaccard_distance, 1 - similarity, sets, last=lambda left: prefix_pairs(left, sets, similarity))
    discard(distinct, members, sets)
    return tied


def repeats(docs: DataFrame, similarity: float = 0.8, recall: float = 0.995, band_rows: int = 3, line_words: int = 50, spread: int = 16, block_words: int = 20, least_words: int = 32) -> DataFrame:
    """doc_id, start, end (words, end excluded), n_words, first_doc_id, removed: runs that repeat across documents.

    first_doc_id: the smallest document that holds a part of the run; removed: whether that is another document than this one.
    A passage counts if two different doc_ids hold it: repeats inside one document, and those of a null doc_id, are none. Rows that
    repeat a doc_id are one document. A null or empty text has no passages.
    """
    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")

    scan = materialize(scanned(rows, spread, block_words, line_words, bands_for(similarity, band_rows, recall), band_rows), "kind")
    in_blocks = whole_runs(rows, scan.where("kind = 'block'").select("hash", "doc_id", "start", "end"), spread, block_words)
    found = scan.where("kind = 'line'").select(F.col("hash").alias("line"), "doc_id", "start", "end", "bands")
    tied = line_clusters(rows, found, similarity, line_words)
    placed = found.join(tied, found["line"] == tied["node"], "left").select(F.coalesce("root", "line").alias("root"), "doc_id", "start", "end")
    first = placed.groupBy("root").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_last")).where("first_doc_id < _last").drop("_last")
    in_lines = placed.join(first, "root").select("doc_id", "start", "end", "first_doc_id")
    made = materialize(runs(in_blocks.unionByName(in_lines), least_words))
    discard(scan, in_blocks, tied)
    return made


def whole_runs(rows: DataFrame, found: DataFrame, spread: int, block_words: int) -> DataFrame:
    """doc_id, start, end, first_doc_id: blocks that several documents hold, with the words around them that they share.

    A block is verified by a 128-bit digest of its words: where those of one hash differ, the blocks that have the first document's are kept.
    The words that all that hold a block have alike on a side are added. Where three or more hold it, some may share more: blocks with
    the same words on the whole side are a class, and each number of words of a class, not of each of its blocks, is a key of its own.
    A block reaches as far as its class does, if an earlier document is in that or none is in any: else as far as its keys do.
    """
    sides = ("left", "right")
    known = found.groupBy("hash").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_last")).where("first_doc_id < _last").drop("_last")
    blocks_of_several = materialize(found.join(known, "hash"))
    discard(found, part="kind=block")  # most blocks stand once, and nothing reads them again; the lines stay
    placed = materialize(with_neighbours(rows, blocks_of_several, spread, block_words))
    discard(blocks_of_several)
    ends = [f(side).alias(f"{side}_{f.__name__}") for side in sides for f in (F.min, F.max)]
    alike = [in_common(F.col(f"{side}_min"), F.col(f"{side}_max"), spread).alias(f"{side}_all") for side in sides]
    common = placed.groupBy("hash").agg(*ends, F.min_by("block", "doc_id").alias("first_block"), F.count("*").alias("n")).select("hash", "first_block", "n", *alike)
    more = [F.when((F.col("n") > 2) & (F.length(side) > 4 * F.col(f"{side}_all")), F.col(side)).alias(side) for side in sides]
    shared = materialize(placed.join(common, "hash").where("block = first_block").select("hash", "doc_id", "start", "end", "first_doc_id", "left_all", "right_all", *more))
    discard(placed)
    whole = shared.select("doc_id", (F.col("start") - F.col("left_all")).alias("start"), (F.col("end") + F.col("right_all")).alias("end"), "first_doc_id")

    def reaching(rows: DataFrame, words: Column, first: str) -> DataFrame:
        """The spans of these rows with so many words on the side."""
        start, end = (F.when(F.col("side") == side, words).otherwise(0) for side in sides)
        return rows.select("doc_id", (F.col("start") - start).alias("start"), (F.col("end") + end).alias("end"), F.col(first).alias("first_doc_id"))

    def keys(rows: DataFrame, *columns: str) -> DataFrame:
        numbers = F.sequence(F.col("all") + 1, (F.length("words") / 4).cast("int"))
        rows = rows.select("hash", "side", "words", *columns, F.explode(numbers).alias("n"))
        return rows.select(F.xxhash64("hash", "side", "n", F.substring("words", 4 * F.col("n") - 3, F.lit(4))).alias("key"), "side", "n", *columns)

    one, other = (shared.where(F.col(side).isNotNull()).select("hash", F.lit(side).alias("side"), F.col(side).alias("words"), F.col(f"{side}_all").alias("all"), "doc_id", "start", "end", "first_doc_id") for side in sides)
    apart = one.unionByName(other)
    classes = materialize(apart.groupBy("hash", "side", "words", "all").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    of_class = materialize(apart.join(classes.drop("all"), ["hash", "side", "words"]).withColumn("done", F.expr("low < high and (low < doc_id or doc_id = first_doc_id)")))
    held = keys(classes, "low", "high").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key", "low")
    by_class = reaching(of_class.where("done"), (F.length("words") / 4).cast("int"), "low")
    by_key = reaching(keys(of_class.where("not done"), "doc_id", "start", "end").join(held, "key"), F.col("n"), "low")
    return whole.unionByName(by_class).unionByName(by_key)


def in_common(low: Column, high: Column, spread: int) -> Column:
    """How many words all of a group have alike from the first on, by the least and the greatest of their hashes in a row."""
    differ = F.filter(F.sequence(F.lit(1), F.lit(spread)), lambda n: F.substring(low, 4 * n - 3, F.lit(4)) != F.substring(high, 4 * n - 3, F.lit(4)))
    return F.when(low == high, F.length(low) / 4).otherwise(F.array_min(differ) - 1).cast("int")


def runs(spans: DataFrame, least_words: int) -> DataFrame:
    """Spans of a document that overlap or touch, merged; removals and first occurrences apart."""
    spans = spans.withColumn("removed", F.col("doc_id") != F.col("first_doc_id"))
    so_far = Window.partitionBy("doc_id", "removed").orderBy("start", "end")
    begins = spans.withColumn("reach", F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = begins.withColumn("run", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "removed", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"))
    merged = merged.withColumn("n_words", F.col("end") - F.col("start"))
    return merged.where(F.col("n_words") >= least_words).select("doc_id", "start", "end", "n_words", "first_doc_id", "removed")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text but for the words of the spans; the white space before a removed word goes with it."""
    kept, at, inside, number = [], 0, iter(sorted(spans)), 0
    span = next(inside, None)
    for word in re.finditer(WORD, text):
        while span and number >= span[1]:
            span = next(inside, None)
        if span and span[0] <= number:
            kept.append(text[at : at if kept or at else at])
        else:
            kept.append(text[at : word.end()])
        at = word.end()
        number += 1
    return "".join(kept) + text[at:]


def told_apart(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column that holds doc_id as a long, but for rows that share a doc_id and differ in text: one text of these
    (the least by hash) has the doc_id, each other an id of its own, beyond all others, so that it counts as a later document."""
    known, of_text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).where("doc_id is not null"), spare(docs, "_hash")
    several = materialize(known.groupBy("doc_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low < high"))
    if several.isEmpty():
        discard(several)
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    last = known.agg(F.max("doc_id")).first()[0]
    others = known.join(several, "doc_id").where("hash > low").select("doc_id", "hash").distinct()
    others = materialize(others.withColumn("other", F.lit(last + 1) + F.monotonically_increasing_id()))
    of_row, new = spare(docs, "_id"), spare(docs, "_new")
    others = others.select(F.col("doc_id").alias(of_row), F.col("hash").alias(of_text), F.col("other").alias(new))
    same = (F.col("doc_id").cast("long") == F.col(of_row)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(of_text))
    return docs.join(others, same, "left").withColumn(name, F.coalesce(F.col(new), F.col("doc_id").cast("long"))).drop(of_row, of_text, new)


def cut_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the removals cut out of their texts and n_chars counted anew; documents left without a word go.

    Documents without removals stay as they are, empty ones included. All columns stay. Rows of one doc_id and one text are
    one document and are cut alike; rows of one doc_id and different texts are documents of their own. Rows with a null doc_id stay whole.
    """
    key = spare(docs, "_key")
    keyed = told_apart(docs, key)
    owner, own = spare(keyed, "_id"), spare(keyed, "_spans")
    gone = repeats(keyed.select(F.col(key).alias("doc_id"), "text"), **options).where("removed").groupBy(F.col("doc_id").alias(owner)).agg(F.collect_list(F.struct("start", "end")).alias(own))  # a document's own spans
    joined_docs = keyed.join(materialize(gone), F.col(key) == F.col(owner), "left").drop(owner, key)
    touched = F.col(own).isNotNull()

    @F.pandas_udf("string")
    def shortened(text, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([t if s is None else without(t or "", [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans, strict=True)])

    made = joined_docs.withColumn("text", shortened("text", own))
    made = made.where(~touched | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    whole = {c: F.col(c).cast("long") for c in ("start", "end", "n_words")}
    return found.withColumns(whole)
