"""Closed-form scores: electrophoretic mobility, transfer scores, composite and correlation gates."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Charge corrections by place from the N-terminus, from the C-terminus, and for residues present between.
N_TERMINAL = (
    {"D": -0.26741, "E": -0.06852, "N": 0.011699},
    {"D": -0.10947, "E": -0.04011, "N": 0.012535, "Q": 0.011699},
    {"D": -0.08022, "E": -0.03426, "N": 0.016713, "Q": 0.00585},
)
C_TERMINAL = ({"D": -0.02256, "E": -0.00418, "N": 0.010864, "Q": -0.0117}, {"D": -0.03844, "E": -0.01337, "N": 0.026741, "Q": -0.00084})
INTERNAL = {"D": -0.05014, "E": -0.01922, "N": 0.012535, "Q": -0.000251}
LEAST_SCORE = 3e-7


def corrected_charge(seq: Column) -> Column:
    """One and the basic residues, corrected for sequences of six residues or more."""
    charge = 1.0 + F.length(F.regexp_replace(seq, "[^RKH]", ""))

    def at(table: dict[str, float], letter: Column) -> Column:
        return reduce(lambda acc, kv: acc.when(letter == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)

    ends = [at(t, F.substring(seq, i + 1, 1)) for i, t in enumerate(N_TERMINAL)] + [at(t, F.substring(seq, -1 - i, 1)) for i, t in enumerate(C_TERMINAL)]
    inside = F.substring(seq, F.lit(4), F.length(seq) - 5)
    middle = [F.when(inside.contains(k), v).otherwise(0.0) for k, v in INTERNAL.items()]
    return F.when(F.length(seq) < 6, charge).otherwise(sum(ends + middle, charge))


def mobility(seq: Column, mass: Column) -> Column:
    """Predicted electrophoretic mobility; -1 for an empty sequence or a mass of 0 or less."""
    mu = 3.069 + 386 * F.log(1.0 + 0.35 * corrected_charge(seq)) / F.pow(mass, F.lit(0.411))
    return F.when((F.coalesce(F.length(seq), F.lit(0)) == 0) | (mass <= 0), -1.0).otherwise(mu)


def elution_minutes(mu: Column, meters: float = 1.0, volts_per_meter: float = 300000.0) -> Column:
    return F.when(mu > 0, meters * 1e9 / (60 * volts_per_meter * mu)).otherwise(-1.0)


def tail_score(mean: float, sd: float, x: np.ndarray) -> np.ndarray:
    """Share of a normal distribution at least as far from its mean, at least 3e-7."""
    z = np.abs(np.asarray(x, float) - mean) / (sd * math.sqrt(2))
    out = np.array([math.erfc(v) if math.isfinite(v) else 0.0 for v in z])
    return np.where(out > 0, out, LEAST_SCORE)


def transfer_score(df: DataFrame, parts: dict[str, tuple[float, float]]) -> DataFrame:
    """df with mbr_score: 100 times the geometric mean of the tail scores of its columns under (mean, sd) each."""

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        logs = sum(np.log(tail_score(m, s, c.to_numpy())) for c, (m, s) in zip(columns, parts.values()))
        return pd.Series(100 * np.exp(logs / len(parts)))

    return df.withColumn("mbr_score", score(*[F.col(c) for c in parts]))


def composite(angle: Column, matched: Column, least: int = 3) -> Column:
    """angle * log2(1 + matched), null below `least` matches."""
    return F.when(matched >= least, angle * F.log2(1 + matched))


def calibrate(df: DataFrame, observed: str, expected: str, name: str) -> DataFrame:
    """df with observed times on the expected scale, by least squares over rows that have both (ML19)."""
    fit = df.agg(F.regr_slope(expected, observed).alias("_a"), F.regr_intercept(expected, observed).alias("_b"))
    return df.join(F.broadcast(fit)).withColumn(name, F.col("_a") * F.col(observed) + F.col("_b")).drop("_a", "_b")


def tic_normalised(df: DataFrame, scan: str, intensity: str, to_mean: bool = False) -> DataFrame:
    """Intensities over their scan's sum, or scaled to the mean of all scans' sums (ML16)."""
    tic = df.groupBy(scan).agg(F.sum(intensity).alias("_tic"))
    overall = tic.agg((F.avg("_tic") if to_mean else F.lit(1.0)).alias("_mean"))
    return df.join(tic, scan).join(F.broadcast(overall)).withColumn(intensity, F.col(intensity) / F.col("_tic") * F.col("_mean")).drop("_tic", "_mean")
