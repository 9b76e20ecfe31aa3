"""SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the vocabulary has a white-space marker after another character, so no
piece crosses from a word into the next marked word: the segmentation of a text is
the concatenation of those of its chunks (a run of markers and the characters up to
the next one). Each task keeps a table of the distinct chunks that it has met, with
their ids and decoded text; a text is a sequence of positions in that table, and its
ids are gathered by position for a whole batch at a time. The table is local to a task: a
table shared by all tasks would shuffle one row for each word of the corpus twice,
several times the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import TABLE_BYTES, Grown, Places, slices, table, texts

MARK = "▁"
CHUNK = re.compile(r" *[^ ]+| +$")


def cuts_at_markers(model: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no piece has a marker after another character."""
    return not any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size()))


class ChunkTable:
    """Ids of each distinct chunk, in one flat array; emptied when its bytes reach a bound."""

    def __init__(self, path: str, most: int = TABLE_BYTES):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if not cuts_at_markers(self.model):
            raise ValueError("pieces of this model cross white-space markers; chunks can't be encoded one by one")
        self.marker, self.places = self.model.piece_to_id(MARK), Places(32, most)
        self.clear()

    def clear(self) -> None:
        self.places.clear()
        self.ends, self.flat = Grown(np.int64), Grown(np.int32)
        self.ends.add(np.zeros(1, np.int64))

    def add(self, chunks: list[str]) -> None:
        # the model puts a marker before each text itself, in place of the chunk's first space
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)
        ids = [x or [self.marker] for x in ids]  # a lone space
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ends.add(self.ends.rows[-1] + np.cumsum(lengths))
        self.flat.add(np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum())))

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text and the ids of all, each text closed by the end id."""
        if self.places.full():
            self.clear()
        chunks, counts = [], np.zeros(len(batch), np.int64)
        for n, text in enumerate(batch):
            if text:
                found = CHUNK.findall(" " + text.replace(MARK, " "))
                counts[n] = len(found)
                chunks += found
        if missing := self.places.missing(chunks):
            self.add(missing)
        at, starts = self.places.of(chunks), self.ends.rows
        lengths = starts[at + 1] - starts[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], lengths)
        of_text = ends[np.cumsum(counts)] - ends[np.cumsum(counts) - counts]
        offsets = np.concatenate([[0], np.cumsum(of_text + 1)])
        out = np.full(offsets[-1], self.model.eos_id(), np.int32)
        inside = np.ones(offsets[-1], bool)
        inside[offsets[1:] - 1] = False
        out[inside] = self.flat.rows[take]
        return offsets, out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: the ids of each whole text with the end id, and the text that they decode to.

    A null or empty text has the end id alone and decodes to the empty text. Rows
    that repeat are encoded alike, each on its own row. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ChunkTable(path)
        for part in slices(batches):
            offsets, ids = known.encode(part.column(1).to_pylist())
            decoded = known.model.decode([ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], num_threads=1)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return texts(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return digests(done)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
