"""Conversation prefix trie: what conversations have in common at their beginning, and what sharing it would save.

Conversations that belong together (a family: those with one base id) are met in one shuffle, which carries the texts.
Each family is rebuilt and made into a small trie as its rows pass by in order; only the trie's combined nodes, with a
digest of their path in place of texts, are shuffled again, to merge families by a map-side combine. A node's sums over
its subtree take no walk through the trie: every global node lies on the path of its smallest member, so that member's
family counts it and adds it to the nodes above, within the family; these parts are then summed by node. So there
are as many shuffles however deep the trie is.

Turns are ordered by turn (null first), then role, then text; a null role or text is ''. Rows without a conv_id belong
to no conversation. Repeated rows are turns of their own. An empty table gives no rows. Further columns pass by unread.
Nodes are told apart by 128-bit digests of their paths.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, table, tuned

#: Conversations of a family have ids that differ by less than this; those that a base id begins are made from its first turns, HEADS - 1 at most.
FAMILY, HEADS = 5, 9
#: Nodes of a family that a task keeps to combine further conversations with; bits of an id within a part of a node's list of ends.
MOST_NODES, ENDS_BITS = 1 << 18, 12

NODES = "family long, place long, up long, depth long, node binary, parent binary, conv_id long, n_convs long, n_bytes long, ends array<long>"


def base_of(conv_id: str = "conv_id") -> str:
    return f"{conv_id} - {conv_id} % {FAMILY}"


def head_size(conv_id: int) -> int:
    """How many turns of its base a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _digest(*parts: bytes) -> bytes:
    made = hashlib.blake2b(digest_size=16)
    for part in parts:
        made.update(part)
    return made.digest()


def _turn(role: str, text: str) -> tuple[bytes, int]:
    """A digest that tells turns apart, and the text's length in bytes."""
    role, text = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
    return _digest(len(role).to_bytes(8, "big"), role, text), len(text)


class Family:
    """The trie of one family, made turn by turn; rows() are its nodes, each after its parent.

    Beyond `most` nodes those met so far are given away and conversations to come have nodes of their own,
    which the global merge combines as it does those of other families.
    """

    ROOT = bytes(16)

    def __init__(self, base: int, most: int):
        self.base, self.most, self.head, self.placed = base, most, [], 0
        self.nodes: dict[bytes, list] = {}
        self.conv: int | None = None
        self.out: list[list] = []

    def _visit(self, node: bytes, parent: bytes | None, depth: int, n_bytes: int) -> None:
        at = self.nodes.get(node)
        if at is None:
            if len(self.nodes) >= self.most:
                self.give()
            at = self.nodes[node] = [self.base, self.placed, self.here[1] if parent else -1, depth, node, parent, self.conv, 0, n_bytes, []]
            self.placed += 1
        at[6], at[7] = min(at[6], self.conv), at[7] + 1
        self.here = at

    def give(self) -> None:
        self.out += self.nodes.values()
        self.nodes = {}

    def _step(self, turn: tuple[bytes, int]) -> None:
        above = self.here
        self._visit(_digest(above[4], turn[0]), above[4], above[3] + 1, turn[1])

    def add(self, conv: int, role: str, text: str) -> None:
        turn = _turn(role, text)
        if conv != self.conv:
            self.close()
            self.conv, self.own, self.skip = conv, 0, head_size(conv)
            self._visit(self.ROOT, None, 0, 0)
            if conv != self.base:
                for known in self.head[: self.skip]:
                    self._step(known)
        self.own += 1
        if conv == self.base:
            if len(self.head) < HEADS - 1:
                self.head.append(turn)
            self._step(turn)
        elif self.own > self.skip:
            self._step(turn)

    def close(self) -> None:
        """The conversation at hand ends where it is."""
        if self.conv is not None:
            self.here[9].append(self.conv)
            self.conv = None


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _packed(rows: Iterable[list | tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


LONG, BYTES = pa.int64(), pa.binary()
NODE_SCHEMA = pa.schema(list(zip("family place up depth node parent conv_id n_convs n_bytes ends".split(), [LONG] * 4 + [BYTES] * 2 + [LONG] * 3 + [pa.list_(LONG)], strict=True)))


def _tries(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Nodes of families, from base, conv_id, role, text: a family's rows together, its base's conversation first, each conversation's turns in order."""

    def made() -> Iterator[list]:
        family = None
        for base, conv, role, text in _rows(batches):
            if family is None or base != family.base:
                if family:
                    family.close()
                    family.give()
                    yield from family.out
                family = Family(base, most)
            family.add(conv, role, text)
            if family.out:
                yield from family.out
                family.out = []
        if family:
            family.close()
            family.give()
            yield from family.out

    return _packed(made(), NODE_SCHEMA)


def family_nodes(conversations: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """The nodes of each family's trie (NODES): up is the parent's place, ends are the conversations that end there."""
    tuned(conversations.sparkSession)
    rows = conversations.where("conv_id is not null").select(F.expr(base_of()).alias("base"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("base").sortWithinPartitions("base", F.expr("conv_id <> base"), "conv_id", "turn", "role", "text")
    return ordered.select("base", "conv_id", "role", "text").mapInArrow(partial(_tries, most=most), NODES)


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """node, depth, parent, conv_id, n_convs, n_bytes: nodes of all families, each once."""
    return nodes.groupBy("node").agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("n_bytes").alias("n_bytes"))


def _summed_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n_leaves, saved_tokens of each family's part, from family, place, up, node and what is the node's own, the last place first.

    What waits for its parent is a row for each branch at most.
    """

    def made() -> Iterator[tuple]:
        now, waiting = None, {}
        for family, place, up, node, leaf, saved in _rows(batches):
            if family != now:
                now, waiting = family, {}
            more = waiting.pop(place, (0, 0))
            leaf, saved = leaf + more[0], saved + more[1]
            if leaf or saved:
                yield node, leaf, saved
            if up >= 0:
                there = waiting.get(up, (0, 0))
                waiting[up] = there[0] + leaf, there[1] + saved

    return _packed(made(), pa.schema([("node", BYTES), ("n_leaves", LONG), ("saved_tokens", LONG)]))


def subtree_sums(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """node, n_leaves, saved_tokens over each node's subtree. merged: node, conv_id, n_convs, n_bytes, n_children."""
    own = merged.select("node", "conv_id", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    # the row of a family whose smallest member is the smallest of all: one a node
    placed = nodes.select("family", "place", "up", "node", "conv_id").join(own, ["node", "conv_id"], "left")
    ordered = placed.repartition("family").sortWithinPartitions("family", F.desc("place"))
    parts = ordered.select("family", "place", "up", "node", *[F.coalesce(c, F.lit(0)).cast("long") for c in ("leaf", "saved")]).mapInArrow(_summed_up, "node binary, n_leaves long, saved_tokens long")
    return parts.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ends_sha256, from node and the parts of its list in order; a list is never held whole."""

    def made() -> Iterator[tuple]:
        now, sha = None, None
        for node, part in _rows(batches):
            if node != now:
                if now is not None:
                    yield now, sha.hexdigest()
                now, sha = node, hashlib.sha256(part.encode())
            else:
                sha.update(b"," + part.encode())
        if now is not None:
            yield now, sha.hexdigest()

    return _packed(made(), pa.schema([("node", BYTES), ("ends_sha256", pa.string())]))


def end_digests(nodes: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the ids that end at the node, ascending, with commas between; nodes without ends are absent.

    Ids are sorted and joined in parts of 2 ** ENDS_BITS; the digest itself goes through a node's parts one after the other, as SHA-256 must.
    """
    ends = nodes.select("node", F.explode("ends").alias("id"))
    parts = ends.groupBy("node", F.shiftright("id", ENDS_BITS).alias("part")).agg(F.array_sort(F.collect_list("id")).alias("ids"))  # 2 ** ENDS_BITS ids at most
    joined = parts.select("node", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))
    return joined.repartition("node").sortWithinPartitions("node", "part").select("node", "text").mapInArrow(_hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = materialize(family_nodes(conversations, most_nodes))
    plain = materialize(merged_nodes(nodes))
    children = plain.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = plain.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    merged = plain.join(children, "node", "left").join(parents, "parent", "left").drop("parent").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    merged = materialize(merged)
    discard(plain)
    full = merged.join(subtree_sums(nodes, merged), "node", "left").join(end_digests(nodes), "node", "left")
    made = materialize(
        full.select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )
    discard(nodes, merged)
    return made


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The same in SQL, with paths as lists; crc32 bit by bit over the digits.
ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda k, z: xor(k >> 1, 3988292384 * (k & 1))))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t) x
),
s AS (
  SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE i <= h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t USING (conv_id) WHERE i > h
),
l AS (SELECT c.conv_id, coalesce(x.path, []) AS path FROM c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, i) AS path FROM s GROUP BY conv_id) x USING (conv_id)),
p AS (SELECT conv_id, len(path) AS len, d, path[1:d] AS node FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM l) x),
n AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(octet_length(encode(node[-1].text)), 0) AS n_bytes, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = d), '') AS ends
  FROM p GROUP BY node, d
),
k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
u AS (SELECT p.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved FROM f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY p.node)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u USING (node) LEFT JOIN f o ON f.d > 0 AND o.node = f.node[1:f.d - 1]
"""
