"""Order-dependent algorithms, each on one group in pandas."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.functions.chemistry import PROTON, isotope_distribution, parsed
from massif.operators.envelopes import envelopes, spectra_of
from massif.runtime import ship, shuffle_partitions

C13 = 1.00335483810


def trace_labels(mass: np.ndarray, scan: np.ndarray, tolerance: float, gap: int) -> np.ndarray:
    """The trace of each envelope, in scan order: the open trace whose first mass is nearest, within tolerance; a new one otherwise.

    A trace closes when more than `gap` scans pass without it, and takes one envelope a scan; at equal distance the one opened first wins.
    """
    out = np.empty(len(mass), dtype=np.int64)
    anchors: list[float] = []
    last: list[int] = []
    open_: list[int] = []
    for i in np.lexsort((mass, scan)):
        open_ = [t for t in open_ if scan[i] - last[t] <= gap + 1]
        near = [t for t in open_ if abs(anchors[t] - mass[i]) <= tolerance and last[t] != scan[i]]
        if near:
            t = min(near, key=lambda t: (abs(anchors[t] - mass[i]), t))
        else:
            t = len(anchors)
            anchors.append(mass[i])
            last.append(scan[i])
            open_.append(t)
        last[t] = scan[i]
        out[i] = t
    return out


def mass_traces(df: DataFrame, keys: list[str], mass: str, scan: str, tolerance: float, gap: int) -> DataFrame:
    """df with trace, a number within its keys (charge and run)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(trace=trace_labels(pdf[mass].to_numpy(float), pdf[scan].to_numpy(), tolerance, gap))

    return df.groupBy(*keys).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField("trace", T.LongType())]))


def weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    order = np.argsort(x, kind="stable")
    total = np.cumsum(w[order])
    return float(x[order][np.searchsorted(total, total[-1] / 2)])


def corrected_masses(mass: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corrected mass, part) of one trace's envelopes.

    The consensus is the weighted median; members within three robust deviations (at most 0.45 of a carbon-13 step) of it stay, those at a
    whole number of steps from it are put on it; the others form a trace of their own, in turn.
    """
    out, part = mass.copy(), np.zeros(len(mass), dtype=np.int64)
    rest, k = np.arange(len(mass)), 0
    while len(rest):
        center = weighted_median(mass[rest], weight[rest])
        sigma = np.median(np.abs(mass[rest] - center)) / 0.6745
        window = min(max(1e-4, sigma) * 3, 0.45 * C13)
        off = mass[rest] - center
        steps = np.round(off / C13)
        own = np.abs(off - steps * C13) <= window
        out[rest[own & (steps != 0)]] = center
        part[rest[own]] = k
        rest, k = rest[~own], k + 1
    return out, part


def trace_correct(df: DataFrame, keys: list[str], mass: str, weight: str) -> DataFrame:
    """df with corrected and part."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, p = corrected_masses(pdf[mass].to_numpy(float), pdf[weight].to_numpy(float))
        return pdf.assign(corrected=c, part=p)

    return df.groupBy(*keys).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField("corrected", T.DoubleType()), T.StructField("part", T.LongType())]))


@lru_cache(maxsize=10_000)
def _isotopes(formula: str, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, p = isotope_distribution(parsed(formula), 1e-8)
    keep = p >= least
    return np.arange(len(m))[keep], m[keep], p[keep]


def isotope_rows(df: DataFrame, key: str, formula: str, least: float = 1e-4) -> DataFrame:
    """(key, isotope, mass, abundance) of each formula's isotope distribution. A formula that a task has met is not worked out again; rows are dealt evenly, as small tables come in few parts."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, len(x), 10_000):
                part = x.slice(at, 10_000)
                rows = [_isotopes(f, least) for f in part.column(1).to_pylist()]
                place = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
                columns = [np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0), np.zeros(0)), *rows)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(place)), *map(pa.array, columns)], [key, "isotope", "mass", "abundance"])

    named = df.select(F.col(key).alias("_k"), F.col(formula).alias("_f")).repartition(shuffle_partitions(df.sparkSession))
    return named.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, isotope long, mass double, abundance double")


def deconvolute(df: DataFrame, key: str, mz: str, intensity: str, ppm: float = 20.0, most_charge: int = 6) -> DataFrame:
    """(key, mass, charge, score, n_peaks) of the envelopes of each spectrum, given as arrays of m/z (rising) and intensity. The spectra of a batch are looked at together."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            own, mass, z, score, n, _ = envelopes(*spectra_of(x.column(1), x.column(2)), ppm, range(1, most_charge + 1))
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(own)), pa.array(mass), pa.array(z.astype(np.int32)), pa.array(score), pa.array(n.astype(np.int32))], [key, "mass", "charge", "score", "n_peaks"])

    return df.select(key, mz, intensity).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, mass double, charge int, score double, n_peaks int")


def narrowest_interval(x: np.ndarray, share: float) -> tuple[float, float]:
    """The narrowest interval over sorted samples that spans floor(share * n) steps; the first at a tie."""
    x = np.sort(x)
    k = int(share * len(x))
    k = min(k, len(x) - 1)
    widths = x[k:] - x[: len(x) - k]
    i = int(np.argmin(widths))
    return float(x[i]), float(x[i + k])


def fold_change(a: np.ndarray, b: np.ndarray, draws: int, seed: int, null: float) -> tuple[float, float, float, float]:
    """(mean log2 change, interval ends, error probability): posterior of the difference of two means under normal data, by draws."""
    if len(a) < 2 or len(b) < 2:
        return float("nan"), float("nan"), float("nan"), 1.0
    rng = np.random.default_rng(seed)

    def mean(x):
        s2 = max(x.var(ddof=1), 1e-12)
        return x.mean() + rng.standard_t(len(x) - 1, draws) * np.sqrt(s2 / len(x))

    d = mean(b) - mean(a)
    lo, hi = narrowest_interval(d, 0.95)
    return float(d.mean()), lo, hi, float((np.abs(d) <= null).mean() if d.mean() else 1.0)


def bayes_fold_change(df: DataFrame, key: str, condition: str, value: str, first: str, second: str, draws: int = 2000, null: float = 0.05) -> DataFrame:
    """(key, change, low, high, pep): log2 change between two conditions of each protein; pep is the chance of a change within +-null (ML10)."""

    side = lambda c: F.array_sort(F.collect_list(F.when((F.col(condition) == c) & (F.col(value) > 0) & ~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))))
    rows = df.groupBy(key).agg(side(first).alias("_a"), side(second).alias("_b"))

    @F.pandas_udf("struct<change:double,low:double,high:double,pep:double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = np.empty((len(a), 4))
        # groups of equal sizes share their draws, which come from one seed
        same = defaultdict(list)
        for i, (x, y) in enumerate(zip(a, b)):
            same[len(x), len(y)].append(i)
        for (n, m), own in same.items():
            if n < 2 or m < 2:
                out[own] = np.nan, np.nan, np.nan, 1.0
                continue
            rng = np.random.default_rng(1)
            # the second condition draws first, as in fold_change()
            draws_of = [rng.standard_t(k - 1, draws) for k in (m, n)][::-1]
            # at most a few million draws at once
            for at in range(0, len(own), 2000):
                part = own[at : at + 2000]
                mean = []
                for values, t in zip((a, b), draws_of):
                    x = np.log2(np.stack([values.iloc[i] for i in part]))
                    mean.append(x.mean(axis=1)[:, None] + t * np.sqrt(np.maximum(x.var(axis=1, ddof=1), 1e-12) / x.shape[1])[:, None])
                d = mean[1] - mean[0]
                change = d.mean(axis=1)
                pep = np.where(change != 0, (np.abs(d) <= null).mean(axis=1), 1.0)
                d.sort(axis=1)
                k = min(int(0.95 * draws), draws - 1)
                first_ = np.argmin(d[:, k:] - d[:, : draws - k], axis=1)
                each = np.arange(len(part))
                out[part] = np.stack([change, d[each, first_], d[each, first_ + k], pep], axis=1)
        return pd.DataFrame(out, columns=["change", "low", "high", "pep"])

    return rows.select(key, run("_a", "_b").alias("_r")).select(key, "_r.*")
