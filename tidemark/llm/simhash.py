"""SimHash near-duplicates: fingerprints, an inverted index by byte positions, count filter, verification.

Two 64-bit fingerprints within 4 bits of each other agree in at least 4 of their 8
bytes, wherever the bits fall. Lists of single (position, byte) pairs hold a 256th
of all fingerprints each, and tallying them meets every pair of fingerprints again
and again. So the index posts the 70 sets of 4 positions with the bytes there: sharing one
posting is the same as a tally of 4 shared positional bytes, which is the guaranteed
minimum, and a list holds a 2^32nd of unlike fingerprints. That is the count filter;
what passes it is verified by its differing bits, and the result is exact. The index
has 70 small rows for each distinct fingerprint at every size of the corpus (14 of them
are looked at first, and what these link is one component in all lists): lists
of 3 positions would be fewer (20), but hold 256 times as many chance meetings.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bucket_components, discard, identified, map_batches, materialize, same_rows, table, with_root

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the word shingles; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype=">u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        set_bits += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed 64-bit integer): one row for each row of docs."""

    def each(columns: dict[str, list]) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width, seed) for t in columns["text"]], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(columns["doc_id"], pa.int64()), pa.array(columns["text_hash"], pa.int64()), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    return map_batches(identified(docs).select("doc_id", "text_hash", "text"), each, "doc_id long, text_hash long, fp long")


POSTINGS = tuple(combinations(range(8), 4))
#: 14 of the sets, one of which lies outside any 3 positions (a Steiner system): all but some of the links over 4 bytes share a posting of these.
SOONER = tuple(s for s in POSTINGS if s[0] ^ s[1] ^ s[2] ^ s[3] == 0)


def byte_at(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def postings(fps: DataFrame, *more: str, sets: tuple = POSTINGS) -> DataFrame:
    """key, node (the fingerprint), weight, further columns: a row for each set of positions; the key holds the set's number and the bytes there."""
    keys = []
    for positions in sets:
        number = POSTINGS.index(positions)
        key = F.lit(number).cast("long")
        for p in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte_at(F.col("fp"), p))
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("node"), "weight", *more)


def finer(rows: DataFrame) -> DataFrame:
    """Rows of postings (key, node and more) under keys of the posting and 4 of the 8 nibbles outside its positions: two fingerprints of a posting within 4 bits agree in as many."""
    rest = F.array(*[F.array(*[F.lit(p) for p in range(8) if p not in positions]) for positions in POSTINGS])
    rows = rows.withColumn("_rest", F.element_at(rest, F.shiftrightunsigned("key", 32).cast("int") + 1))
    nibbles = F.flatten(F.transform("_rest", lambda p: F.transform(F.array(F.lit(0), F.lit(4)), lambda half: F.call_function("shiftrightunsigned", F.col("node"), p * 8 + half).bitwiseAND(F.lit(15)))))
    rows = rows.withColumn("_nibbles", nibbles)
    keys = [F.xxhash64("key", F.lit(n), *[F.element_at("_nibbles", p + 1) for p in places]) for n, places in enumerate(combinations(range(8), 4))]
    return rows.withColumn("key", F.explode(F.array(*keys))).drop("_rest", "_nibbles")


def differing_bits(a: Column, b: Column) -> Column:
    """Of two structs with a fingerprint each, the field node: a metric."""
    return F.bit_count(a["node"].bitwiseXOR(b["node"]))


def components_of(fps: DataFrame) -> DataFrame:
    """node, root of the distinct fingerprints fp (with weight) that link. Most near copies are linked by the few postings of SOONER,
    so that of all postings only those go on that still hold several components."""
    sooner = postings(fps, sets=SOONER), lambda roots: postings(with_root(fps, "fp", roots), "root")
    return bucket_components(postings(fps), differing_bits, 4, fps.select(F.col("fp").alias("node")), finer=finer, sooner=sooner)


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, text_hash, fp, root, component_id: a row for each row of docs; fingerprints link at 4 or fewer differing bits.

    root is the component's smallest fingerprint. Documents without words have fingerprint zero and are linked as any other. A
    null doc_id stays a row and names no component unless it stands alone (then the
    id is null). Repeated rows have one fingerprint and so one component; an empty table has none.
    """
    marked = materialize(fingerprints(docs, width, seed))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("weight")))
    reached = components_of(distinct)
    rooted = distinct.join(reached, distinct["fp"] == reached["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "root", "component_id")
    made = materialize(marked.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id"))
    discard(marked, distinct, reached)
    return made


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs but for near copies: of each component one row with the smallest doc_id stays, with all columns.

    Rows that repeat a doc_id are copies too, if their texts are near; a component of null ids alone keeps one of its rows.
    """
    found = near_duplicates(docs, **options)
    first = found.where("doc_id <=> component_id").groupBy("root").agg(F.first("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"))
    kept = same_rows(docs, first.select("doc_id", "text_hash"), "left_semi")
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
