"""What several text operators share: reading, scratch space, Arrow batches, linking in buckets, components.

Every operator treats a null text as the empty text, keeps repeated rows as rows of
their own, and selects the columns it needs by name, so that further columns of any
name pass by unread.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_dir

#: A word is a run of characters other than ASCII white space; bytes.split() divides the UTF-8 form alike.
WORD = r"[^\x20\x09-\x0D]+"

# Settings that hold unless the application was started with its own. Arrow batches of bounded size, and
# shuffle files that go at a query's end, where else they wait for the driver's garbage collection.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
TUNED = "spark.tidemark.tuned"
#: The folder that a table of materialize() has, in the path of one of its files.
STAGE = re.compile(r".*/stage-[0-9a-f]{32}(?=/)")
#: Characters of text that a task takes up at a time, and bytes of a table that it keeps from batch to batch.
BATCH_BYTES, TABLE_BYTES = 1 << 20, 48 << 20
#: Components of a bucket that are compared with each other; buckets with more are split first, where their owner tells how. A split shuffles
#: tens of rows a member, so it pays where a member would meet many hundreds.
CROWDED = 1024


def tuned(spark: SparkSession) -> SparkSession:
    """The session with SETTINGS; they are set once a session and never put back, so threads don't race."""
    if spark.conf.get(TUNED, None) is None:
        given = spark.sparkContext.getConf()
        for name, value in SETTINGS.items():
            if not given.contains(name):
                spark.conf.set(name, value)
        spark.conf.set(TUNED, "true")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share."""
    return shared_dir(spark)


def materialize(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again: computed once, lineage cut. by: columns that become folders."""
    spark = tuned(df.sparkSession)
    path = f"{scratch_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*made: DataFrame | None, part: str = "") -> None:
    """Deletes the tables of materialize() that these rows are read from, or a folder of theirs, once nothing else will read them."""
    for df in made:
        if df is None:
            continue
        spark = df.sparkSession
        for folder in {m[0] for m in map(STAGE.match, df.inputFiles()) if m}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}".rstrip("/"))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, the text (null: empty) and any further named columns."""
    tuned(docs.sparkSession)
    return docs.select("doc_id", *columns, F.coalesce("text", F.lit("")).alias("text"))


def identified(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id (long), text_hash, text and any further named columns: what tells one row of docs from another."""
    return texts(docs, *columns).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", *columns)


def spare(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def same_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs joined (left_semi, left_anti) with rows of doc_id and text_hash; null ids are equal."""
    of_row, of_text = spare(docs, "_id"), spare(docs, "_hash")
    rows = rows.select(F.col("doc_id").alias(of_row), F.col("text_hash").alias(of_text)).distinct()
    return docs.join(rows, F.col("doc_id").cast("long").eqNullSafe(F.col(of_row)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(of_text)), how)


def slices(batches: Iterable[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `most` bytes of text, or of one row where that has more."""
    for batch in batches:
        sizes = np.full(batch.num_rows, 16, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, end - start)
            start = end


class Grown:
    """A numpy array that rows are added to; its room doubles, so that adding copies each row a few times at most."""

    def __init__(self, dtype, *shape: int):  # noqa: ANN001
        self.size, self.room = 0, np.zeros((1024, *shape), dtype)

    def add(self, rows: np.ndarray) -> None:
        end = self.size + len(rows)
        if end > len(self.room):
            room = np.zeros((max(end, 2 * len(self.room)), *self.room.shape[1:]), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : end] = rows
        self.size = end

    @property
    def rows(self) -> np.ndarray:
        return self.room[: self.size]


class Places:
    """A place for each distinct word that a task has met, in the order met, as far as a bound of bytes allows.

    An entry counts as its length, what Python keeps beside it, and `each` bytes of what the owner keeps for it.
    full() is looked at between batches, which are bounded themselves.
    """

    def __init__(self, each: int = 8, most: int = TABLE_BYTES):
        self.each, self.most = each, most
        self.clear()

    def clear(self) -> None:
        self.place, self.held = {}, 0

    def full(self) -> bool:
        return self.held > self.most

    def missing(self, words: list) -> list:
        """Words without a place, each once; they get the next places."""
        place = self.place
        found = [w for w in dict.fromkeys(words) if w not in place]
        place.update(zip(found, range(len(place), len(place) + len(found)), strict=True))
        self.held += sum(map(len, found)) + (150 + self.each) * len(found)
        return found

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


class HashedWords:
    """64-bit hashes of words, through a table of those that a task has met."""

    def __init__(self, seed: int):
        self.seed, self.places, self.hashes = seed, Places(), Grown(np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.places.full():
            self.places.clear()
            self.hashes = Grown(np.uint64)
        fresh = self.places.missing(words)
        self.hashes.add(np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in fresh), np.uint64, len(fresh)))
        return self.hashes.rows[self.places.of(words)]


def map_batches(df: DataFrame, each: Callable[..., pa.RecordBatch | None], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow over lists of bounded size; each(columns, state) gives an Arrow batch or None.

    setup() makes the state once a task.
    """
    tuned(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for part in slices(batches):
            columns = dict(zip(part.schema.names, (c.to_pylist() for c in part.columns), strict=True))
            made = each(columns, state) if setup else each(columns)
            if made is not None:
                yield made

    return df.mapInArrow(run, schema)


def bucket_components(members: DataFrame, distance: Callable[[Column, Column], Column], most: float, facts: DataFrame, rounds: int = 2, last: Callable[[DataFrame], DataFrame] | None = None, finer: Callable[[DataFrame], DataFrame] | None = None, sooner: tuple[DataFrame, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """node, root: the components of the links between nodes that share a bucket and are at most `most` apart.

    members: key, node, weight, a row for each node and bucket that it is in. facts: a row for each node with
    what distance() needs; it gets two structs of them and must be a metric. Nodes without links may be absent.

    First each bucket's members are compared with its heaviest node (of near copies, the original). From then on a
    bucket holds one row for each component in it: in a few rounds these components' heaviest nodes are
    compared with the bucket's heaviest. At last the components that still share a bucket are compared: by their
    heaviest nodes and the radius around these, beyond which (by the triangle inequality) no two members can be
    linked, and only where that leaves a link possible by those members that it leaves. last, where given, does
    this last step in their stead: from node, root of the nodes that still share a bucket with another root's, the pairs a, b that
    may be linked. So a bucket of copies costs a row a member, and no two nodes that a chain of links joins are parted.

    sooner, where given: members of a few buckets that most linked nodes share, which are compared with their heaviest nodes in the stead of all
    members, and a function that gives all members (key, node, weight, root) by the roots so found. Buckets of one component then cost no more.
    """
    facts = facts.select("node", F.struct(*facts.columns).alias("fact"))
    shared = materialize(of_several_nodes(sooner[0] if sooner else members))

    def close(pairs: DataFrame) -> DataFrame:
        """src, dst of the pairs a, b that are linked."""
        pairs = pairs.where("a <> b").select("a", "b").distinct()
        pairs = pairs.join(_facts(facts, "a"), "a").join(_facts(facts, "b"), "b")
        return materialize(pairs.where(distance(F.col("fact_a"), F.col("fact_b")) <= most).select(F.col("a").alias("src"), F.col("b").alias("dst")))

    def heaviest(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.min_by(F.struct("node", "weight"), F.struct(-F.col("weight"), "node")).alias("_top")).select(*by, "_top.node", "_top.weight")

    def several_roots(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of buckets with several components."""
        return rows.join(several_roots(rows), "key", "left_semi")

    hubs = heaviest(shared, "key").select("key", F.col("node").alias("b"))
    links = close(shared.select("key", F.col("node").alias("a")).join(hubs, "key"))
    roots = components(links)
    if sooner:
        rows = sooner[1](roots)
        keys = materialize(several_roots(rows))  # few: written, so that Spark knows their size and broadcasts them, as long as they are
        rooted = materialize(rows.join(keys, "key", "left_semi"))
        discard(keys)
    else:
        rooted = materialize(mixed(with_root(shared, "node", roots)))
    discard(links, shared)
    tops = materialize(heaviest(rooted, "key", "root"))
    for _ in range(rounds):
        hubs = heaviest(tops, "key").select("key", F.col("node").alias("b"))
        links = close(tops.select("key", F.col("node").alias("a")).join(hubs, "key"))
        if links.isEmpty():
            discard(links)
            break
        roots, step, past, before = *_merged(roots, links), tops, roots
        tops = materialize(heaviest(mixed(with_root(tops, "root", step)), "key", "root"))
        discard(links, step, past, before)
    left = materialize(mixed(with_root(rooted.drop("root"), "node", roots)))
    discard(rooted, tops)
    if finer:
        left = _split(left, finer, mixed)
    new = close(last(left.select("node", "root").distinct())) if last else _near_groups(left, close, distance, most, facts, heaviest)
    discard(left)
    if new.isEmpty():
        discard(new)
        return roots
    made, step = _merged(roots, new)
    discard(new, step, roots)
    return made


def _split(left: DataFrame, finer: Callable[[DataFrame], DataFrame], mixed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """left, the rows of crowded buckets under finer keys."""
    crowded = materialize(left.groupBy("key").agg(F.approx_count_distinct("root").alias("n")).where(F.col("n") > CROWDED).select("key"))
    made = left
    if not crowded.isEmpty():
        rows = left.join(crowded, "key", "left_anti").unionByName(finer(left.join(crowded, "key", "left_semi")).select(*left.columns))
        made = materialize(mixed(rows))
        discard(left)
    discard(crowded)
    return made


def _near_groups(left: DataFrame, close: Callable, distance: Callable, most: float, facts: DataFrame, heaviest: Callable) -> DataFrame:
    """src, dst: links between nodes of different roots that share a bucket; left: key, node, weight, root of such buckets."""
    # each component's heaviest node in each bucket, how far its members lie from it, and how many it has
    tops = heaviest(left, "key", "root").select("key", "root", F.col("node").alias("top"))
    placed = left.join(tops, ["key", "root"]).join(_facts(facts, "node"), "node").join(_facts(facts, "top"), "top")
    placed = materialize(placed.select("key", "root", "node", "top", distance(F.col("fact_node"), F.col("fact_top")).alias("off")))
    groups = placed.groupBy("key", "root", "top").agg(F.max("off").alias("radius"))
    a, b = (groups.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("root", "top", "radius")]) for side in "ab")
    pairs = a.join(b, "key").where("root_a < root_b").join(_facts(facts, "top_a"), "top_a").join(_facts(facts, "top_b"), "top_b")
    pairs = pairs.withColumn("apart", distance(F.col("fact_top_a"), F.col("fact_top_b"))).where(F.col("apart") <= F.col("radius_a") + F.col("radius_b") + F.lit(most + 1e-9))
    pairs = materialize(pairs.select("key", "root_a", "root_b", "top_a", "top_b", "radius_a", "radius_b", "apart"))
    near = pairs.where(F.col("apart") <= most).select(F.col("top_a").alias("src"), F.col("top_b").alias("dst"))
    open_pairs = pairs.where((F.col("apart") > most) & (F.col("radius_a") + F.col("radius_b") > 0))
    first = placed.select("key", F.col("root").alias("root_a"), F.col("node").alias("a"))
    first = open_pairs.join(first, ["key", "root_a"]).join(_facts(facts, "a"), "a").join(_facts(facts, "top_b"), "top_b")
    first = first.withColumn("far", distance(F.col("fact_a"), F.col("fact_top_b"))).where(F.col("far") <= F.col("radius_b") + F.lit(most + 1e-9))
    second = placed.select("key", F.col("root").alias("root_b"), F.col("node").alias("b"), "off")
    both = first.select("key", "root_b", "a", "far").join(second, ["key", "root_b"]).where(F.abs(F.col("far") - F.col("off")) <= F.lit(most + 1e-9))
    met = close(both.select("a", "b"))
    new = materialize(near.unionByName(met))
    discard(pairs, met, placed)
    return new


def of_several_nodes(members: DataFrame) -> DataFrame:
    """The rows of members (key, node, weight) whose key has two nodes or more.

    Keys are counted with a map-side combine and met by a join that Spark can split, so one key may hold any
    share of the rows. A common exchange for both would be half the shuffle, but could not be split.
    """
    members = members.select("key", "node", "weight")
    keys = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    return members.join(keys, "key", "left_semi")


def _facts(facts: DataFrame, name: str) -> DataFrame:
    return facts.select(F.col("node").alias(name), F.col("fact").alias(f"fact_{name}"))


def with_root(rows: DataFrame, of: str, roots: DataFrame) -> DataFrame:
    """rows with `root`, that of the node (or former root) in the column `of`."""
    known = roots.select(F.col("node").alias("_of"), F.col("root").alias("_root"))
    return rows.join(known, rows[of] == known["_of"], "left").withColumn("root", F.coalesce("_root", of)).drop("_of", "_root")


def _merged(roots: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, root after further links between nodes, and what became of former roots that were tied."""
    ends = [with_root(links.select(F.col(c).alias("node"), F.col(o).alias("_other")), "node", roots) for c, o in (("src", "dst"), ("dst", "src"))]
    low = ends[0].select(F.col("node").alias("src"), F.col("_other").alias("dst"), F.col("root").alias("root_src"))
    high = ends[1].select(F.col("_other").alias("src"), F.col("node").alias("dst"), F.col("root").alias("root_dst"))
    step = materialize(components(low.join(high, ["src", "dst"]).select(F.col("root_src").alias("src"), F.col("root_dst").alias("dst"))))
    fresh = step.join(roots.select("node"), "node", "left_anti")
    moved = with_root(roots.withColumnRenamed("root", "_was"), "_was", step).select("node", "root")
    return materialize(moved.unionByName(fresh.select("node", "root"))), step


def components(links: DataFrame) -> DataFrame:
    """node, root: each linked node and the smallest node that it reaches.

    Alternates the large star and the small star (Kiveris et al., 2014): in each
    round every node's larger neighbours, then its smaller ones, are tied to its
    smallest. Rounds grow with the logarithm of a component's size. Each round is
    written to the shared folder, in place of the one before.
    """
    links = links.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")).where("low < high").distinct()
    links, before = materialize(links), None
    while True:
        both = links.unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy(F.col("low").alias("mid")).agg(F.least(F.min("high"), F.first("low")).alias("root"))
        large = both.join(least, both["low"] == least["mid"]).where("high > mid").select(F.col("root").alias("low"), "high")
        large = large.where("low < high").distinct()
        least = large.groupBy(F.col("high").alias("mid")).agg(F.min("low").alias("root"))
        small = large.join(least, large["high"] == least["mid"]).select("root", F.col("low").alias("near"), F.col("high").alias("far"))
        small = small.select(F.explode(F.array("near", "far")).alias("high"), F.col("root").alias("low")).where("low < high").select("low", "high").distinct()
        shorter = materialize(small)
        discard(links)
        links = shorter
        now = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(low, high))")).first()
        if now == before:
            return links.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(links.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
        before = now
