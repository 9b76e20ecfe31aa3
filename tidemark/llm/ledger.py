"""Token counts as rollups that signed deltas maintain.

A batch of changes (inserts, deletes, revised texts) becomes signed rows: an insert
adds a document's counts, a delete takes away those that the ledger holds, a
revision does both. The rows are additive, so totals by source, language and
tokenizer version are a sum over committed batches, however they were cut. A batch
is committed once: its rows and their rollup are written to a folder of the attempt, and a
marker that names the attempt is created last, which only one attempt can do; a batch
whose marker exists is passed over, what an attempt that failed or lost has written is never read.

Rows are kept in buckets by hash of doc_id. A delete or revision reads the buckets of its documents
alone, so what a small batch costs depends on its documents' buckets, not on the corpus. Once there are more tables than a
bound they are compacted into one, whose marker names those that it stands for; so a reader opens a few tables however many batches there were.
"""

from __future__ import annotations

import base64
import functools
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, materialize, scratch_dir, table, texts, tuned

SIGNED = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long"
TOTALS = ("source", "lang", "tokenizer")
#: The last line of a marker, and how a compaction's name begins.
END, COMPACT = "end", "compact-"


def byte_pair_counter(path: str, pattern: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """Makes, in each task, a counter of a byte-level BPE's tokens (ranks in base64 lines)."""

    def setup() -> Callable[[list[str]], list[int]]:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        coder = tiktoken.Encoding("ledger", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda batch: [len(coder.encode_ordinary(t)) for t in batch]

    return setup


def count_tokens(docs: DataFrame, tokenizer: str, setup: Callable[[], Callable[[list[str]], list[int]]]) -> DataFrame:
    """A signed row of +1 document and its tokens for each row of docs; a null text has no tokens."""

    def each(columns: dict[str, list], count: Callable[[list[str]], list[int]]) -> pa.RecordBatch:
        n = len(columns["text"])
        made = [columns["doc_id"], columns["source"], columns["lang"], [tokenizer] * n, np.ones(n, np.int64), count(columns["text"])]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], [x.split()[0] for x in SIGNED.split(", ")])

    rows = texts(docs, "source", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return map_batches(rows, each, SIGNED, setup)


class Ledger:
    """Signed counts in a shared folder: a folder for each attempt at a batch, and markers of those committed.

    Null sources, languages and ids are values of their own. A delete or revision of a
    document that the ledger does not hold takes nothing away; inserting a document
    that it holds counts it twice, as a table with repeated rows does.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, most_tables: int = 32):
        self.spark, self.path, self.buckets, self.most_tables = tuned(spark), path.rstrip("/"), buckets, most_tables

    def _at(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{place}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _markers(self) -> dict[str, list[str]]:
        """By name of each committed table (a batch, or a compaction): the attempt that it was written by, then the tables that it stands for."""
        system, path = self._at("markers")
        made = {}
        for status in system.listStatus(path) if system.exists(path) else []:
            name = status.getPath().getName()
            if not name.startswith("."):
                stream = system.open(status.getPath())
                said = bytes(stream.readAllBytes()).decode().split("\n")
                stream.close()
                if said[-1] == END:  # else just being written
                    made[name] = said[:-1]
        return made

    def committed(self) -> dict[str, str]:
        """The attempt that each committed batch was written by."""
        return {name: said[0] for name, said in self._markers().items() if not name.startswith(COMPACT)}

    def _live(self) -> dict[str, str]:
        """The attempts of the tables that are read: those that no compaction stands for."""
        markers = self._markers()
        covered = {name for said in markers.values() for name in said[1:]}
        return {name: said[0] for name, said in sorted(markers.items()) if name not in covered}

    def _mark(self, name: str, attempt: str, covers: Iterable[str] = ()) -> bool:
        """Commits a table; False where another one of that name was committed before, and this one's files go."""
        system, marker = self._at(f"markers/{name}")
        try:
            stream = system.create(marker, False)  # fails where it exists
        except Py4JJavaError:
            if not system.exists(marker):
                raise
            for kind in ("rows", "rollups"):
                system.delete(self._at(f"{kind}/{name}/{attempt}")[1], True)
            return False
        stream.write(bytearray("\n".join([attempt, *covers, END]).encode()))
        stream.close()
        return True

    def _bucket(self, doc_id: str = "doc_id") -> Column:
        return F.pmod(F.xxhash64(doc_id), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{name}/{attempt}") for name, attempt in self._live().items()]  # most_tables and a few
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All signed rows of committed batches, or those of some buckets."""
        found = self._read("rows", f"{SIGNED}, bucket int")
        return (found if buckets is None else found.where(F.col("bucket").isin(buckets))).drop("bucket")

    def held(self, tokenizer: str, buckets: list[int] | None = None) -> DataFrame:
        """What the ledger holds of each document now."""
        sums = self.rows(buckets).where(F.col("tokenizer") == tokenizer).groupBy("doc_id", *TOTALS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def signed(self, changes: DataFrame, tokenizer: str, setup: Callable[[], Callable[[list[str]], list[int]]]) -> DataFrame:
        """Signed rows of changes (op: insert, delete or revise; doc_id, source, lang, text; seq, if there is such a column).

        A document's changes take effect in the order of seq; where that is equal, null or not given, inserts come
        before revisions (by text) and these before deletes. So the last delete or revision of a batch replaces what
        the ledger holds of the document and what came before in the batch; a delete after inserts leaves nothing. Null ids are one
        document in this. A batch of no changes has no rows.
        """
        rank = F.when(F.col("op") == "insert", 0).when(F.col("op") == "revise", 1).when(F.col("op") == "delete", 2)
        seq = F.coalesce(F.col("seq").cast("long"), F.lit(0)) if "seq" in changes.columns else F.lit(0).cast("long")
        columns = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text"))]
        rows = changes.select(*columns, seq.alias("seq"), rank.alias("rank")).where("rank is not null")
        last = rows.where("rank > 0").groupBy("doc_id").agg(F.max(F.struct("seq", "rank", "text", "source", "lang")).alias("last"))
        cuts = last.select(F.col("doc_id").alias("_id"), F.struct("last.seq", "last.rank").alias("_cut"))
        inserts = rows.where("rank = 0").join(cuts, F.col("doc_id").eqNullSafe(F.col("_id")), "left").where(F.col("_cut").isNull() | (F.struct("seq", "rank") > F.col("_cut")))
        revised = last.where("last.rank = 1").select("doc_id", "last.source", "last.lang", "last.text")
        added = count_tokens(inserts.select("doc_id", "source", "lang", "text").unionByName(revised), tokenizer, setup)
        touched = sorted(r["bucket"] for r in last.select(self._bucket().alias("bucket")).distinct().collect())  # at most `buckets`
        gone = last.select(F.col("doc_id").alias("_id"))
        held = self.held(tokenizer, touched)
        taken = held.join(gone, held["doc_id"].eqNullSafe(gone["_id"]), "left_semi")
        return added.unionByName(taken.select("doc_id", *TOTALS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))

    def reversal(self, batch: str) -> DataFrame:
        """Signed rows that take a committed batch back; none of one that isn't committed."""
        attempt = self.committed().get(batch)
        rows = self.spark.read.schema(SIGNED).parquet(f"{self.path}/rows/{batch}/{attempt}") if attempt else self.spark.createDataFrame([], SIGNED)
        return rows.withColumns({c: -F.col(c) for c in ("n_docs", "n_tokens")})

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Writes a batch once; False if it was committed before, or by another driver meanwhile.

        Signed rows are computed against the ledger as it was; batches that change the same documents must follow each other.
        """
        if batch in self.committed():
            return False
        made = self._mark(batch, self._written(batch, signed))
        if made and len(self._live()) > self.most_tables:
            self.compact()
        return made

    def apply(self, batch: str, changes: DataFrame, tokenizer: str, setup: Callable[[], Callable[[list[str]], list[int]]]) -> bool:
        """Commits changes as a batch; one that was committed before is passed over unread."""
        return batch not in self.committed() and self.commit(batch, self.signed(changes, tokenizer, setup))

    def _written(self, name: str, signed: DataFrame) -> str:
        """Writes a table's rows and rollups; the attempt."""
        attempt = uuid.uuid4().hex
        rows, rollups = f"{self.path}/rows/{name}/{attempt}", f"{self.path}/rollups/{name}/{attempt}"
        # a bucket's rows together, large ones in parts
        signed.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(rows)
        written = self.spark.read.schema(f"{SIGNED}, bucket int").parquet(rows)
        written.groupBy(*TOTALS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(rollups)
        return attempt

    def compact(self) -> bool:
        """Puts the tables there are into one, what cancels out left away; the batches stay committed, and their files stay for readers of before.

        A batch committed meanwhile is not among those that the new table stands for; of two compactions at once one counts.
        """
        live = self._live()
        number = sum(name.startswith(COMPACT) for name in self._markers())
        if len(live) < 2:
            return False
        parts = [self.spark.read.schema(SIGNED).parquet(f"{self.path}/rows/{name}/{attempt}") for name, attempt in live.items()]
        sums = functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id", *TOTALS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
        name = f"{COMPACT}{number:09d}"
        return self._mark(name, self._written(name, sums), live)

    def drop(self) -> None:
        """Deletes the ledger's folder."""
        system, path = self._at("")
        system.delete(path, True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over the rollups of committed batches; emptied groups go."""
        rollups = self._read("rollups", "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        sums = rollups.groupBy(*TOTALS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, the first of which comes twice: all documents are inserted; those labelled bad are deleted;
    those labelled good are revised, their white space made one space each."""
    import public_tokenizers

    ledger = Ledger(spark, f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}")
    setup = byte_pair_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    everything = docs.withColumn("op", F.lit("insert"))
    for _ in range(2):
        ledger.apply("backfill", everything, "byte_bpe_50k", setup)
    ledger.apply("review", labels.where("quality = 0").select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")], F.lit("delete").alias("op")), "byte_bpe_50k", setup)
    good = docs.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").join(labels.where("quality = 0").select("doc_id"), "doc_id", "left_anti")
    edited = good.select("doc_id", "source", "lang", F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ").alias("text"), F.lit("revise").alias("op"))
    ledger.apply("edit", edited, "byte_bpe_50k", setup)
    made = materialize(ledger.totals())
    ledger.drop()
    return made
