"""Walks: what sorted rows of a key leave behind when a small state passes over them, row by row, in a task of the key's own.

Rows are shuffled by key and sorted on disk where they don't fit, and the walk holds its state and one batch, so a key
may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

#: A walk gets the rows of one key in order, as tuples, and yields rows.
Walk = Callable[[Iterator[tuple]], Iterable[tuple]]


def walked(df: DataFrame, keys: list[str], columns: list[str], walk: Walk, made: dict[str, tuple[str, pa.DataType]], show: list[str]) -> DataFrame:
    """The rows that walk() makes of each key's columns (sorted by them in that order), beside the key columns to show. made: name to SQL and Arrow type."""
    kinds = dict(df.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in show] + [f"{name} {sql}" for name, (sql, _) in made.items()])
    places, arrow = [keys.index(c) for c in show], [kind for _, kind in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [batch.column(i).type for i in places]
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def all_made() -> Iterator[tuple]:
            source = rows()
            following = next(source, None)
            while following is not None:
                key = following[: len(keys)]

                def own(first: tuple, key: tuple = key) -> Iterator[tuple]:
                    nonlocal following
                    row: tuple | None = first
                    while row is not None and row[: len(keys)] == key:
                        yield row[len(keys) :]
                        row = next(source, None)
                    following = row

                before = following
                shown = tuple(key[i] for i in places)
                for row in walk(own(before)):
                    yield shown + row
                if following is before:
                    raise ValueError("a walk must read all of its rows")

        found = all_made()
        while part := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part, strict=True), [*types, *arrow], strict=True)], [*show, *made])

    ordered = df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *columns)
    return ordered.mapInArrow(run, schema)

