"""Tolerance joins, nearest look-ups, traces over gaps and window averages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.operators.prefix import fill


def ppm_join(left: DataFrame, right: DataFrame, x: str, y: str, ppm: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with |x - y| / y * 1e6 <= ppm, both positive.

    Values are binned on a logarithmic scale of one tolerance, so a value's partners lie in its own or a neighbouring bin: an
    equi-join on the bin in place of a cartesian product. The right side is dealt to its three bins, so each pair meets once.
    """
    step = float(ppm) * 1e-6 * 1.0001
    bin_of = lambda c: F.floor(F.log(F.col(c)) / F.lit(step)).cast("long")
    a = left.where(F.col(x) > 0).withColumn("_bin", bin_of(x))
    b = right.where(F.col(y) > 0).withColumn("_bin", F.explode(F.array(bin_of(y) - 1, bin_of(y), bin_of(y) + 1)))
    keys = [*(on or []), "_bin"]
    return a.join(b, keys).where(F.abs(F.col(x) - F.col(y)) / F.col(y) * 1e6 <= ppm).drop("_bin")


#: Grids of up to this many points are sent to all tasks.
SMALL_GRID = 100_000


def _searched(points: np.ndarray, mode: str):
    """The function from values to the nearest of the sorted points."""

    @F.pandas_udf("double")
    def find(x: pd.Series) -> pd.Series:
        v = x.to_numpy(float)
        if not len(points):
            return pd.Series(np.full(len(v), None), dtype=object)
        low = points[np.clip(np.searchsorted(points, v, side="right") - 1, 0, len(points) - 1)]
        high = points[np.clip(np.searchsorted(points, v, side="left"), 0, len(points) - 1)]
        out = {"previous": low, "next": high, "closest": np.where(v - low < high - v, low, high)}[mode]
        return pd.Series(out).where(~np.isnan(v), None)

    return find


def nearest(values: DataFrame, value: str, grid: DataFrame, point: str, mode: str = "closest") -> DataFrame:
    """Each value's nearest grid point: the closest (at a tie the higher), the previous (at or below) or the next (at or above); beyond the ends the end.

    A grid of up to SMALL_GRID points goes to all tasks and is searched there. For a larger one, points and values are ordered together, over ranges of the axis, and
    the last point before each value is carried along; no task holds the grid. Null values have no point; without a grid no value has one.
    """
    few = [r[0] for r in grid.select(F.col(point).cast("double")).where(F.col(point).isNotNull()).distinct().limit(SMALL_GRID + 1).collect()]
    if len(few) <= SMALL_GRID:
        return values.withColumn("nearest", _searched(np.sort(np.array(few, dtype=float)), mode)(F.col(value).cast("double")))
    own = values.select("*", F.col(value).cast("double").alias("_x"), F.lit(None).cast("double").alias("_p"))
    points = grid.select(F.col(point).cast("double").alias("_x")).withColumn("_p", F.col("_x"))
    both = own.unionByName(points, allowMissingColumns=True)
    first = F.col("_p").isNull()  # points come before equal values
    ends = grid.agg(F.min(point).cast("double").alias("_lo"), F.max(point).cast("double").alias("_hi"))
    out, low, high = both, F.lit(None), F.lit(None)
    if mode != "next":
        out, low = fill(out, [F.col("_x"), first], "_p", "_low"), F.coalesce("_low", "_lo")
    if mode != "previous":
        out, high = fill(out, [F.desc("_x"), first], "_p", "_high"), F.coalesce("_high", "_hi")
    pick = {"previous": low, "next": high, "closest": F.when(F.col("_x") - low < high - F.col("_x"), low).otherwise(high)}[mode]
    out = out.where("_p IS NULL").join(F.broadcast(ends))
    pick = F.when(F.col("_x") >= F.col("_hi"), F.col("_hi")).when(F.col("_x") <= F.col("_lo"), F.col("_lo")).when(F.col("_x").isNotNull(), pick)
    return out.select(*values.columns, pick.alias("nearest"))


def smooth_trace(df: DataFrame, keys: list[str], index: str, intensity: str, points: int) -> DataFrame:
    """df with `weighted` (each point of the window weighs by its own intensity) and `plain` (the mean); points too near an end for a whole window stay; a window of zeros has no weighted mean, which is NaN."""
    half = points // 2
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(index)
    near = order.rowsBetween(-half, points - 1 - half)
    place, n = F.row_number().over(order) - 1, F.count("*").over(whole)
    inside = (place >= half) & (place < n - half)
    y = F.col(intensity)
    weighted = F.coalesce(F.try_divide(F.sum(y * y).over(near), F.sum(y).over(near)), F.lit(float("nan")))
    return df.select("*", F.when(inside, weighted).otherwise(y).alias("weighted"), F.when(inside, F.avg(y).over(near)).otherwise(y).alias("plain"))


def islands(df: DataFrame, keys: list[str], index: str, missed: int) -> DataFrame:
    """df with island: the number of the run its index belongs to within its keys; more than `missed` absent indices end a run."""
    w = Window.partitionBy(*keys).orderBy(index)
    new = F.coalesce((F.col(index) - F.lag(index).over(w) > missed + 1).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def summarise_islands(df: DataFrame, keys: list[str], index: str, mz: str, intensity: str) -> DataFrame:
    """Apex, ends and intensity-weighted mean m/z of each island (AGG13); the apex is the first of the highest."""
    apex = F.max(F.struct(F.col(intensity), -F.col(index))).alias("_apex")
    out = df.groupBy(*keys, "island").agg(
        F.min(index).alias("start"), F.max(index).alias("end"), apex, F.count("*").alias("n_points"), (F.sum(F.col(mz) * F.col(intensity)) / F.sum(intensity)).alias("mean_mz")
    )
    return out.select(*keys, "island", "start", "end", (-F.col("_apex").getField("col2")).alias("apex"), F.col("_apex").getField(intensity).alias("apex_intensity"), "n_points", "mean_mz")


def backfill(df: DataFrame, keys: list[str], order: list[str], is_source: Column, value: str, name: str) -> DataFrame:
    """df with the value of the last earlier row of its keys that is a source (W5, W16, PASEF and precursor links)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(is_source, F.col(value)), ignorenulls=True).over(w))


def sliding_average(df: DataFrame, keys: list[str], order: str, value: str, size: int, overlap: int) -> DataFrame:
    """(keys, window, center, mean) of windows of `size` rows that step size - overlap; only full windows."""
    step = size - overlap
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    rows = df.withColumn("_r", rank)
    first = F.greatest(F.lit(0), F.ceil((F.col("_r") - size + 1) / step)).cast("long")
    last = F.floor(F.col("_r") / step).cast("long")
    wide = rows.withColumn("window", F.explode(F.sequence(first, last)))
    center = F.max(F.when(F.col("_r") == F.col("window") * step + size // 2, F.col(order)))
    return wide.groupBy(*keys, "window").agg(F.avg(value).alias("mean"), center.alias("center"), F.count("*").alias("_n")).where(F.col("_n") == size).drop("_n")


def boxcar(df: DataFrame, keys: list[str], order: str, value: str, points: int) -> DataFrame:
    """df with smooth: the mean of the centred `points` rows; rows without a full window go."""
    half = points // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return df.withColumn("smooth", F.avg(value).over(w)).withColumn("_n", F.count("*").over(w)).where(F.col("_n") == 2 * half + 1).drop("_n")


def binned_average(df: DataFrame, spectrum: str, mz: str, intensity: str, width: float) -> DataFrame:
    """(bin, mz, intensity): bins from the least m/z on; intensity is the mean over all spectra, an absent one being zero; bins of zero go (AGG27, ML17)."""
    head = df.agg(F.min(mz).alias("_lo"), F.count_distinct(spectrum).alias("_n"))
    binned = df.join(F.broadcast(head)).withColumn("bin", F.floor((F.col(mz) - F.col("_lo")) / width).cast("long"))
    # a spectrum's peaks of one bin count together
    own = binned.groupBy("bin", spectrum).agg(F.sum(intensity).alias("i"), F.sum(mz).alias("m"), F.count("*").alias("k"), F.first("_n").alias("_n"))
    out = own.groupBy("bin").agg((F.sum("m") / F.sum("k")).alias("mz"), (F.sum("i") / F.first("_n")).alias("intensity"))
    return out.where("intensity <> 0")
