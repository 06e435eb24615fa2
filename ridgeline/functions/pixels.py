"""Statistics of small grey pictures, held as arrays of brightness row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A flat frame's largest spread, the largest mean of a black and the least of a white one.
FLAT_STDDEV, BLACK_MEAN, WHITE_MEAN = 8.0, 24.0, 232.0
# Weights and bounds of the scenic score.
SKY_WEIGHT, LANDSCAPE_BONUS, SMOOTH_WEIGHT, BUSY_EDGES, BUSY_FACTOR = 2.0, 0.35, 0.6, 26.0, 0.6


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(pixels: Column) -> Column:
    return _sum(pixels) / F.size(pixels)


def stddev(pixels: Column) -> Column:
    """Of the population."""
    m = mean(pixels)
    return F.sqrt(_sum(F.transform(pixels, lambda x: (x - m) * (x - m))) / F.size(pixels))


def edges(pixels: Column, width: int) -> Column:
    """Mean absolute difference of neighbours in a row; 0 for pictures of one column."""
    pairs = F.filter(F.transform(pixels, lambda x, i: F.when((i + 1) % width != 0, F.abs(x - F.get(pixels, i + 1)))), lambda d: d.isNotNull())
    return F.when(F.size(pairs) > 0, _sum(pairs) / F.size(pairs)).otherwise(0.0)


def emptiness(mean_: Column, stddev_: Column) -> Column:
    """black, white or blank; null for a frame that is not empty."""
    return F.when(stddev_ <= FLAT_STDDEV, F.when(mean_ <= BLACK_MEAN, "black").when(mean_ >= WHITE_MEAN, "white").otherwise("blank"))


def difference_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """Of a picture of 9 by 8: one bit per neighbours in a row, set if the left one is brighter, first bit highest."""
    at = [r * width + c for r in range(height) for c in range(width - 1)]
    out = F.lit(0).cast("bigint")
    for i in at:
        out = F.shiftleft(out, 1).bitwiseOR(F.when(F.get(pixels, F.lit(i)) > F.get(pixels, F.lit(i + 1)), 1).otherwise(0).cast("bigint"))
    return out


def scenic(pixels: Column, width: int, height: int) -> Column:
    """Sky over terrain, detail and format in one score: the top third brighter and smoother than the rest, some but not too much detail."""
    cut = max(1, height // 3) * width
    top, rest = F.slice(pixels, 1, cut), F.slice(pixels, cut + 1, width * height)
    brighter = F.greatest(F.lit(0.0), (mean(top) - mean(rest)) / 128.0)
    smoother = F.greatest(F.lit(0.0), (stddev(rest) - stddev(top)) / 64.0)
    e = edges(pixels, width)
    detail = F.greatest(F.lit(0.0), F.least(F.lit(1.0), e / 18.0)) * F.when(e > BUSY_EDGES, BUSY_FACTOR).otherwise(1.0)
    return SKY_WEIGHT * F.least(F.lit(1.0), brighter + smoother * SMOOTH_WEIGHT) + detail + (LANDSCAPE_BONUS if width >= height else 0.0)
