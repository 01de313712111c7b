"""Functions of the user's own on groups, batches and tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reducers by name: built-in aggregates, on the JVM.
REDUCERS: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max, "collect": F.collect_list,
    "median": lambda c: F.percentile(c, F.lit(0.5)), "mode": lambda c: F.mode(c, True),
}


def grouped_reduce(df: DataFrame, keys: Sequence[str], value: str, reducer: str | Callable[[pd.Series], float], frame: DataFrame | None = None, fill: float | None = 0.0) -> DataFrame:
    """One value per group by a named reducer, 'robust_std' or a pandas function of
    the group's values; groups that frame lists and df lacks get fill."""
    if reducer == "robust_std":
        from atlasframe.operators.stats import robust_stats

        out = robust_stats(df, keys, value).select(*keys, F.col("robust_sd").alias("value"))
    elif callable(reducer):

        @F.pandas_udf("double")
        def own(v: pd.Series) -> float:
            return float(reducer(v))

        out = df.groupBy(*keys).agg(own(F.col(value)).alias("value"))
    else:
        out = df.groupBy(*keys).agg(REDUCERS[reducer](value).alias("value"))
    if frame is None:
        return out
    out = frame.select(*keys).distinct().join(out, list(keys), "left")
    return out if fill is None or reducer == "collect" else out.withColumn("value", F.coalesce("value", F.lit(fill)))


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(function, batches)

    return df.mapInPandas(run, schema)


def map_tiles(tiles: DataFrame, keys: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One tile to many rows."""
    return tiles.groupBy(*keys).applyInPandas(function, schema)


def map_values(df: DataFrame, array: str, function: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(array, F.transform(array, function))
