"""Pixel operators on small patches: masks, thresholds, column profiles.

Frames reach the engine as rows of arrays; decoding them is the ingest's part. Blurring a patch
is the one operator that needs a pandas function; its patches are tiny.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _kernel(sigma: float) -> np.ndarray:
    reach = int(round(4 * sigma))
    x = np.arange(-reach, reach + 1)
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def blurred(patch: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian blur, the patch mirrored at its edges."""
    k = _kernel(sigma)
    reach = len(k) // 2

    def along(rows: np.ndarray) -> np.ndarray:
        n = rows.shape[1]
        at = np.abs((np.arange(-reach, n + reach)) % max(1, 2 * n - 2))
        at = np.where(at >= n, 2 * n - 2 - at, at) if n > 1 else np.zeros(n + 2 * reach, int)
        wide = rows[:, at]
        return np.stack([(wide[:, i : i + 2 * reach + 1] * k).sum(axis=1) for i in range(n)], axis=1)

    return along(along(patch.astype(float)).T).T


def digit_profile(width: int, sigma: float = 3.0, residual: float = 15.0, columns: int = 15):  # noqa: ANN201
    """A pandas function of brightness patches (flat, `width` wide): pixels of each column that stand out from their surroundings."""

    @F.pandas_udf("array<int>")
    def profile(patches: pd.Series) -> pd.Series:
        made = []
        for flat in patches:
            patch = np.asarray(flat, float).reshape(-1, width)
            made.append((patch - blurred(patch, sigma) > residual).sum(axis=0)[:columns].astype(int).tolist())
        return pd.Series(made)

    return profile


def otsu_threshold(values: Column) -> Column:
    """The level of 0 to 255 that parts an array's values with the largest variance between the parts; the least of equals.

    Levels at or below it are dark. One pass over the sorted values: the parts change only at levels that the array holds, so of equal
    parts the least level is one of them. A value beyond the levels closes the last part.
    """
    inside = F.concat(F.array_sort(F.filter(values, lambda v: v.between(0, 255))).cast("array<double>"), F.array(F.lit(256.0)))
    total, mass = F.size(values).cast("double"), F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(-1.0).alias("best"), F.lit(0.0).alias("level"), F.lit(-1.0).alias("last"), total.alias("total"), mass.alias("mass"))

    def step(a: Column, v: Column) -> Column:
        n, s, total, mass = a["n"], a["s"], a["total"], a["mass"]
        spread = F.when((v > a["last"]) & (n > 0) & (n < total), (mass * n - s * total) ** 2 / (n * (total - n))).otherwise(-1.0)
        better = spread > a["best"]
        best, level = F.when(better, spread).otherwise(a["best"]), F.when(better, a["last"]).otherwise(a["level"])
        return F.struct((n + 1).alias("n"), (s + v).alias("s"), best.alias("best"), level.alias("level"), v.alias("last"), total.alias("total"), mass.alias("mass"))

    return F.coalesce(F.aggregate(inside, start, step)["level"].cast("int"), F.lit(0))


def fixed_threshold(values: Column, level: int = 140, inverse: bool = False) -> Column:
    """255 above the level, else 0; inverse the other way round."""
    high, low = (0, 255) if inverse else (255, 0)
    return F.transform(values, lambda v: F.when(v > level, high).otherwise(low))


def column_sums(mask: Column, width: int) -> Column:
    """Sums of the columns of a flat mask."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.aggregate(F.filter(mask, lambda v, i: i % width == c), F.lit(0), lambda a, v: a + v.cast("int")))


def blanked(values: Column, width: int, share: float = 0.227) -> Column:
    """The patch with its left share of columns set to 0."""
    cut = int(width * share)
    return F.transform(values, lambda v, i: F.when(i % width < cut, 0).otherwise(v))


def enlarged(values: Column, width: int, height: int, times: int) -> Column:
    """Nearest-neighbour enlargement of a flat patch."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width * height * times * times - 1)),
        lambda p: F.element_at(values, (F.floor(F.floor(p / (width * times)) / times) * width + F.floor((p % (width * times)) / times) + 1).cast("int")),
    )
