"""Windows over sessions of any length: a session's rows are taken in blocks of the order column, and blocks meet by a few rows each.

A window by session puts a session in one task. Here the windows are by (session, block); only the rows next to a block's
edge, or a row a block of totals, meet in a window by session. Any block width gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ["session_id"]
WIDTH = 1 << 16


def blocked(df: DataFrame, order: str, width: float) -> DataFrame:
    """df with _block; rows without a place come first, as they do in the order."""
    return df.withColumn("_block", F.coalesce(F.floor(F.col(order) / F.lit(width)), F.lit(-(1 << 62))))


def by_blocks(df: DataFrame, made: dict[str, Callable[[list[str]], Column]], back: int, ahead: int, by: list[str] = BY, order: str = "idx", width: float = WIDTH) -> DataFrame:
    """df with columns that look at `back` rows before and `ahead` rows after a row at most; made: for each name the column, by keys of its window.

    A row nearer to its block's edge is worked out again among the rows next to all edges of its session: the first and last
    back + ahead of each block, between which nothing that such a row looks at is missing. The order column tells rows apart.
    """
    inside, reach = [*by, "_block"], back + ahead
    ranked = blocked(df, order, width)
    own = Window.partitionBy(*inside)
    ranked = ranked.withColumns({"_first": F.row_number().over(own.orderBy(order)), "_size": F.count("*").over(own)}).withColumn("_last", F.col("_size") - F.col("_first") + 1)
    beside = (F.col("_first") <= back) | (F.col("_last") <= ahead)
    inner = ranked.withColumns({name: f(inside) for name, f in made.items()}).where(~beside)
    edges = ranked.where((F.col("_first") <= reach) | (F.col("_last") <= reach))
    edges = edges.withColumns({name: f(by) for name, f in made.items()}).where(beside)
    return inner.unionByName(edges).drop("_block", "_first", "_last", "_size")


def running(df: DataFrame, sums: dict[str, Column], by: list[str] = BY, order: str = "idx", width: float = WIDTH) -> DataFrame:
    """df with the sum of each column up to and with each row's place in the order, rows of one place together."""
    inside = [*by, "_block"]
    rows = blocked(df, order, width).withColumns({f"_{name}": c for name, c in sums.items()})
    so_far = Window.partitionBy(*inside).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({name: F.sum(f"_{name}").over(so_far) for name in sums})
    totals = rows.groupBy(*inside).agg(*[F.sum(f"_{name}").alias(f"_{name}_total") for name in sums])  # a row a block
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*inside, *[F.coalesce(F.sum(f"_{name}_total").over(before), F.lit(0)).alias(f"_{name}_before") for name in sums])
    met = rows.join(starts, inside)
    return met.withColumns({name: F.coalesce(name, F.lit(0)) + F.col(f"_{name}_before") for name in sums}).select(*df.columns, *sums)


def carried(df: DataFrame, values: dict[str, Column], by: list[str], order: list[str], width: float = WIDTH, descending: bool = False) -> DataFrame:
    """df with the last value of each column that is not null, up to and with each row in the order (descending: from the end); its first column cuts the blocks."""
    inside, sided = [*by, "_block"], F.desc if descending else F.asc
    rows = blocked(df, order[0], width).withColumns({f"_{name}": c for name, c in values.items()})
    own = Window.partitionBy(*inside).orderBy(*[sided(c) for c in order])
    rows = rows.withColumns({name: F.last(f"_{name}", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for name in values})
    place, latest = F.struct(*order), F.min_by if descending else F.max_by
    ends = rows.groupBy(*inside).agg(*[latest(f"_{name}", F.when(F.col(f"_{name}").isNotNull(), place)).alias(f"_{name}_end") for name in values])  # a row a block
    before = Window.partitionBy(*by).orderBy(sided("_block")).rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*inside, *[F.last(f"_{name}_end", ignorenulls=True).over(before).alias(f"_{name}_before") for name in values])
    met = rows.join(starts, inside)
    return met.withColumns({name: F.coalesce(name, f"_{name}_before") for name in values}).select(*df.columns, *values)
