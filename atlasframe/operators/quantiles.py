"""Exact quantiles of large groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_quantiles(df: DataFrame, by: Sequence[str], value: str | Column, quantiles: dict[str, float]) -> DataFrame:
    """(by, a column per name): quantiles of the non-null values, linear between
    neighbours as percentile() has them. Equal values are counted first, on the map
    side, and the counts run up in order of value, so a group of any number of
    different values goes through a sort that can spill, never through a map in memory."""
    v = F.col(value) if isinstance(value, str) else value
    counts = df.select(*by, v.cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumns({"_upto": F.sum("_c").over(order), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    out = []
    for name, q in quantiles.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        low, high = (F.min(F.when(F.col("_upto") > f(at), F.col("_v"))) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return rows.groupBy(*by).agg(*out)


def table_quantiles(df: DataFrame, value: str | Column, quantiles: Sequence[float], most: int = 100_000, bins: int = 4096) -> list[float | None]:
    """Quantiles over a whole table, exact and linear between neighbours as
    percentile() has them; None each without values. Each scan counts, in equal bins
    between two values, how many lie where, until the bins that hold the ranks asked for have at
    most `most` different values together; these alone are sorted. So no task and no
    driver ever holds more, however many values differ. NaN counts as no value."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(v.cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    n, low, high = rows.agg(F.count("*"), F.min("_v"), F.max("_v")).first()
    if not n:
        return [None] * len(quantiles)
    return [_ranked(rows, (n - 1) * q, low, high, n, most, bins) for q in quantiles]


def _ranked(rows: DataFrame, at: float, low: float, high: float, n: int, most: int, bins: int) -> float:
    """The value at a fractional rank (from 0) of rows between low and high."""
    first, last = math.floor(at), math.ceil(at)
    below = 0  # rows before low
    while True:
        inside = rows.where((F.col("_v") >= low) & (F.col("_v") <= high))
        if low == high:
            return low
        count = inside.select("_v").distinct().limit(most + 1).count() if n <= most else most + 1
        step = (high - low) / bins
        if count <= most or not math.isfinite(step) or step <= 0 or low + step == low:
            counts = inside.groupBy("_v").agg(F.count("*").alias("c")).orderBy("_v").collect()
            found, upto = [], below
            for r in counts:
                upto += r["c"]
                while len(found) < 2 and upto > (first, last)[len(found)]:
                    found.append(r["_v"])
            return found[0] + (found[1] - found[0]) * (at - first)
        place = F.least(F.floor((F.col("_v") - low) / step), F.lit(bins - 1))
        parts = inside.groupBy(place.alias("b")).agg(F.count("*").alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high")).orderBy("b").collect()
        upto, chosen = below, []
        for r in parts:
            if upto <= last and upto + r["c"] > first:
                chosen.append((r, upto))
            upto += r["c"]
        if len(chosen) == 2 and last - first == 1 and chosen[0][1] + chosen[0][0]["c"] == last:
            # The two ranks are a bin's greatest value and the next one's least.
            a, b = chosen[0][0]["high"], chosen[1][0]["low"]
            return a + (b - a) * (at - first)
        low, high, below = chosen[0][0]["low"], chosen[-1][0]["high"], chosen[0][1]
        n = sum(r["c"] for r, _ in chosen)
