"""As-of joins, band joins and islands: the joins that sorted loops do, as windows and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import carried


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str], direction: str = "backward", tie: str | None = None, tolerance: float | None = None, width: float | None = None) -> DataFrame:
    """Each left row with the columns `take` of the nearest right row at or before it (backward), at or after it (forward).

    Of right rows at one time the first by `tie` counts forward, the last backward. Both
    sides are sorted together once by (by, time); nothing is compared pairwise. tolerance bounds
    the distance; rows without a partner have nulls. width: of time blocks, so that a key's rows are not one task's work but
    each block's, and what a block carries into the next.
    """
    forward = direction == "forward"
    mine = F.struct(*[F.col(c) for c in left.columns])
    theirs = F.struct(*[F.col(c) for c in take], F.col(right_on).alias("_time"))
    nothing = F.lit(None).cast("long")
    rows = left.select(*by, F.col(left_on).alias("_at"), F.lit(0 if forward else 1).alias("_side"), nothing.alias("_tie"), mine.alias("_left"))
    others = right.select(*by, F.col(right_on).alias("_at"), F.lit(1 if forward else 0).alias("_side"), (F.col(tie).cast("long") if tie else nothing).alias("_tie"), theirs.alias("_right"))
    both = rows.unionByName(others, allowMissingColumns=True)
    columns = ("_at", "_side", "_tie")
    # forward in descending order: a frame from each row to the end would be read anew for each row
    if width is None:
        order = Window.partitionBy(*by).orderBy(*([F.desc(c) for c in columns] if forward else columns))
        both = both.withColumn("_found", F.last("_right", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    else:
        both = carried(both, {"_found": F.col("_right")}, by, list(columns), width, forward)
    met = both.where("_left is not null")
    if tolerance is not None:
        met = met.withColumn("_found", F.when(F.abs(F.col("_found._time") - F.col("_at")) <= tolerance, F.col("_found")))
    return met.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in take])


def band_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, before: float, after: float) -> DataFrame:
    """Pairs with left - before <= right <= left + after, joined on by and a time bucket as wide as the band.

    Columns of the two sides other than `by` must differ in name.
    """
    width = max(before + after, 1e-9)
    low, high = F.floor((F.col(left_on) - before) / width), F.floor((F.col(left_on) + after) / width)
    spread = left.withColumn("_bucket", F.explode(F.sequence(low, high)))
    bucketed = right.withColumn("_bucket", F.floor(F.col(right_on) / width))
    pairs = spread.join(bucketed, [*by, "_bucket"])
    return pairs.where(F.col(right_on).between(F.col(left_on) - before, F.col(left_on) + after)).drop("_bucket")


def range_join(points: DataFrame, ranges: DataFrame, by: list[str], at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at < high, joined on by and buckets of the given width."""
    spread = ranges.where(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    bucketed = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return bucketed.join(spread, [*by, "_bucket"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bucket")


def islands(df: DataFrame, by: list[str], order: list[str], begins: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of rows: a run begins where `begins` holds (it may use lag over the same order)."""
    window = Window.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("_begins", F.when(F.coalesce(begins, F.lit(True)), 1).otherwise(0))
    return flagged.withColumn(name, F.sum("_begins").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_begins")


def previous(column: str, by: list[str], order: list[str], offset: int = 1) -> Column:
    return F.lag(column, offset).over(Window.partitionBy(*by).orderBy(*order))


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, name: str = "nearest") -> DataFrame:
    """The nearest right time of each left row and the distance; of two as near the earlier. Two as-of joins, no pairs."""
    times = right.select(*by, F.col(right_on).alias("_r"))
    before = asof(left, times.select(*by, F.col("_r").alias("_before"), F.col("_r").alias("_bt")), by, left_on, "_bt", ["_before"], "backward")
    both = asof(before, times.select(*by, F.col("_r").alias("_after"), F.col("_r").alias("_at2")), by, left_on, "_at2", ["_after"], "forward")
    pick = F.when(F.col("_after").isNull() | (F.col(left_on) - F.col("_before") <= F.col("_after") - F.col(left_on)), F.col("_before")).otherwise(F.col("_after"))
    return both.withColumn(name, F.coalesce(pick, "_before", "_after")).withColumn(f"{name}_gap", F.abs(F.col(left_on) - F.col(name))).drop("_before", "_after")
