"""Roll-up, collapse and normalisation over long matrices.

A matrix is a DataFrame of (keys..., sample, value); a missing cell is zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rollup_sum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def rollup_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median of the positive cells; the mean of the middle two where their number is even."""
    return df.groupBy(*keys).agg(F.median(F.when(F.col(value) > 0, F.col(value))).alias(value))


def group_sizes(df: DataFrame, group: str, sample: str) -> DataFrame:
    """Samples of each group: one row per group, from a partially aggregated distinct."""
    return df.select(group, sample).distinct().groupBy(group).agg(F.count("*").alias("n_samples"))


def collapse_sum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def collapse_mean(df: DataFrame, keys: list[str], value: str, samples: DataFrame) -> DataFrame:
    """Mean over all samples of the group, absent cells counted as zero."""
    group = samples.columns[0]
    return df.groupBy(*keys).agg(F.sum(value).alias(value)).join(samples, group).withColumn(value, F.col(value) / F.col("n_samples")).drop("n_samples")


def normalise_global_median(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Shift each sample's log2 median of positive cells to the median of those medians.

    Samples with fewer than two positive cells take no part and stay as they are.
    """
    positive = F.when(F.col(value) > 0, F.log2(value))
    med = df.groupBy(sample).agg(F.median(positive).alias("mv"), F.count(positive).alias("n_pos"))
    overall = med.where("n_pos >= 2").agg(F.median("mv").alias("gm"))
    factors = med.crossJoin(overall).select(F.col(sample), F.when(F.col("n_pos") >= 2, F.col("gm") - F.col("mv")).alias("shift"))
    return df.join(factors, sample, "left").withColumn(
        value, F.when((F.col(value) > 0) & F.col("shift").isNotNull(), F.pow(F.lit(2.0), F.log2(value) + F.col("shift"))).otherwise(F.col(value))
    ).drop("shift")


def normalise_reference_channel(df: DataFrame, row: list[str], channel: str, value: str, references: list[str]) -> DataFrame:
    """Ratio of each cell to the mean of the row's non-zero reference cells; references become 1, rows without reference signal 0 (ML2)."""
    ref = F.avg(F.when(F.col(channel).isin(references) & (F.col(value) > 0), F.col(value))).over(Window.partitionBy(*row))
    ratio = F.when(ref.isNull(), 0.0).when(F.col(channel).isin(references), 1.0).otherwise(F.col(value) / ref)
    return df.withColumn(value, ratio)


def combine_matrices(df: DataFrame, key: str, sample: str, value: str) -> DataFrame:
    """Full grid of row keys by samples, missing cells zero.

    The grid grows by the number of samples only: each row's cells become a map, and the sample list (one row a sample) is exploded beside it.
    """
    samples = df.select(sample).distinct().agg(F.sort_array(F.collect_set(sample)).alias("samples"))
    rows = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(sample, value))).alias("cells"))
    grid = rows.join(F.broadcast(samples)).select(key, F.explode("samples").alias(sample), "cells")
    return grid.select(key, sample, F.coalesce(F.element_at("cells", F.col(sample)), F.lit(0.0)).alias(value))


def unique_members(df: DataFrame, member: str, group: str) -> DataFrame:
    """Members that belong to exactly one group, with that group."""
    return df.groupBy(member).agg(F.min(group).alias(group), F.max(group).alias("_hi")).where(F.col(group) == F.col("_hi")).drop("_hi")


def top_n_sum(df: DataFrame, keys: list[str], item: str, value: str, n: int = 3) -> DataFrame:
    """Sum of the n largest values of each group; ties by item (AGG8)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), item)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).groupBy(*keys).agg(F.sum(value).alias(value))


def best_of(df: DataFrame, keys: list[str], value: str, by: str) -> DataFrame:
    """Largest value of each group and the smallest `by` that has it (AGG6, W13): one aggregation, no window."""
    best = F.max(F.struct(F.col(value), -F.col(by)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b").getField(value).alias(value), (-F.col("_b").getField("col2")).alias(by))


def merge_results(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Outer merge of two runs' tables: values of shared keys add up (AGG10)."""
    return a.unionByName(b).groupBy(key).agg(F.sum(value).alias(value), F.count("*").alias("n_runs"))


def remove_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a less one equal occurrence for each row of b (SET1)."""
    return a.exceptAll(b)


def group_score(df: DataFrame, group: str, member: str, score: str) -> DataFrame:
    """Sum over a group's members of their best score (AGG16)."""
    return df.groupBy(group, member).agg(F.max(score).alias("_s")).groupBy(group).agg(F.sum("_s").alias("score"))


def median_polish(df: DataFrame, group: str, row: str, column: str, value: str, rounds: int = 10) -> DataFrame:
    """(group, column, abundance) from a weighted-mean polish of the log2 matrix of each group (AGG9).

    Rows and columns are swept in turn by weighted means, weights being 1 / (1 + squared residual); non-positive cells are missing.
    A group's abundance is 2^overall * 2^column effect * number of rows; columns without any value have none. One group's matrix
    is what one protein has, so a group fits a task.
    """

    def polish(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=row, columns=column, values=value, aggfunc="mean", sort=True)
        x = np.log2(m.where(m > 0).to_numpy())
        seen = ~np.isnan(x)
        if not seen.any():
            return pd.DataFrame({group: [], column: [], "abundance": []})
        overall = np.nanmean(x)
        rows, cols = np.zeros(x.shape[0]), np.zeros(x.shape[1])
        for _ in range(rounds):
            for axis in (1, 0):
                rest = np.where(seen, x - overall - rows[:, None] - cols[None, :], 0.0)
                weight = np.where(seen, 1 / (1 + rest**2), 0.0)
                total = weight.sum(axis=axis)
                shift = np.divide((rest * weight).sum(axis=axis), total, out=np.zeros_like(total), where=total > 0)
                if axis == 1:
                    rows += shift
                else:
                    cols += shift
        out = np.exp2(overall) * np.exp2(cols) * x.shape[0]
        keep = seen.any(axis=0)
        return pd.DataFrame({group: pdf[group].iloc[0], column: m.columns[keep], "abundance": out[keep]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(group, row, column, value).groupBy(group).applyInPandas(polish, f"`{group}` {kinds[group]}, `{column}` {kinds[column]}, abundance double")
