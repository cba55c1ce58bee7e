"""Peak filters, tolerances, outlier rejection and spectral similarity.

A spectrum is either an array column of intensities or a long table (scan, mz, intensity). Array forms stay inside one row; long forms use
windows keyed by scan and m/z window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- tolerances ----

#: Fixed value: mass difference of carbon 13 and carbon 12.
C13_STEP = 1.00335483810
#: Fixed value: proton mass.
PROTON = 1.007276466879


def within_ppm(experimental: Column, theoretical: Column, ppm: float) -> Column:
    return F.abs((experimental - theoretical) / theoretical) * 1e6 <= ppm


def within_abs(experimental: Column, theoretical: Column, tolerance: float) -> Column:
    return F.abs(experimental - theoretical) <= tolerance


def within_notch(experimental: Column, theoretical: Column, ppm: float, notches: int) -> Column:
    """Within ppm after a shift by any number of carbon-13 steps up to `notches`, either way."""
    hit = F.lit(False)
    for k in range(-notches, notches + 1):
        hit = hit | within_ppm(experimental + k * C13_STEP, theoretical, ppm)
    return hit


# ---- similarity of two aligned intensity arrays ----


def _fold(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def _pairwise(a: Column, b: Column, f) -> Column:
    return _fold(F.zip_with(a, b, f))


def sum_normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x / _fold(a))


def dot(a: Column, b: Column) -> Column:
    return _pairwise(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def contrast_angle(a: Column, b: Column) -> Column:
    return 1 - 2 * F.acos(F.least(F.lit(1.0), cosine(a, b))) / float(np.pi)


def euclidean(a: Column, b: Column) -> Column:
    return 1 - F.sqrt(_pairwise(a, b, lambda x, y: (x - y) * (x - y)))


def bray_curtis(a: Column, b: Column) -> Column:
    return 1 - _pairwise(a, b, lambda x, y: F.abs(x - y)) / _pairwise(a, b, lambda x, y: x + y)


def pearson(a: Column, b: Column) -> Column:
    """-1 where either side has no variance."""
    n = F.size(a)
    ma, mb = _fold(a) / n, _fold(b) / n
    cov = dot(a, b) - n * ma * mb
    va, vb = dot(a, a) - n * ma * ma, dot(b, b) - n * mb * mb
    return F.when((va <= 1e-15) | (vb <= 1e-15), -1.0).otherwise(cov / F.sqrt(va * vb))


def _entropy(a: Column) -> Column:
    return -_fold(F.transform(a, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)))


def spectral_entropy(a: Column, b: Column) -> Column:
    """1 - (2 H(mean) - H(a) - H(b)) / ln 4 of sum-normalised arrays."""
    mix = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return 1 - (2 * _entropy(mix) - _entropy(a) - _entropy(b)) / float(np.log(4))


def kl_divergence(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Sum a ln(a / b) after eps is added to all values and they are normalised anew, if any is zero."""
    zero = F.exists(a, lambda x: x == 0) | F.exists(b, lambda x: x == 0)
    pa = F.when(zero, sum_normalised(F.transform(a, lambda x: x + eps))).otherwise(a)
    pb = F.when(zero, sum_normalised(F.transform(b, lambda x: x + eps))).otherwise(b)
    return _pairwise(pa, pb, lambda x, y: x * F.log(x / y))


def searle(a: Column, b: Column) -> Column:
    """ln(1 / sum of squared differences); the largest double for identical arrays."""
    d = _pairwise(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(d == 0, F.lit(1.7976931348623157e308)).otherwise(F.log(1 / d))


SIMILARITIES = {
    "cosine": cosine, "angle": contrast_angle, "euclid": euclidean, "braycurtis": bray_curtis, "pearson": pearson, "dot": dot,
    "entropy": spectral_entropy, "kl": kl_divergence, "searle": searle,
}

# ---- long peak tables ----


def base_peak_filter(peaks: DataFrame, scan: str, intensity: str, ratio: float) -> DataFrame:
    """Peaks above ratio times their scan's largest (PF9, first step)."""
    top = peaks.groupBy(scan).agg(F.max(intensity).alias("_top"))
    return peaks.join(top, scan).where(F.col(intensity) > ratio * F.col("_top")).drop("_top")


def top_k_per_window(peaks: DataFrame, scan: str, mz: str, intensity: str, width: float, k: int) -> DataFrame:
    """The k most intense peaks of each m/z window (lo, hi] of a scan; ties by lower m/z (PF9)."""
    w = Window.partitionBy(scan, "window").orderBy(F.desc(intensity), mz)
    return peaks.withColumn("window", F.ceil(F.col(mz) / width).cast("long")).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def filter_windows(peaks: DataFrame, scan: str, mz: str, intensity: str, lo: float, hi: float, ratio: float | None = None, width: float | None = None, n_windows: int | None = None, k: int | None = None, normalise: bool = False) -> DataFrame:
    """Peaks of lo to hi that stay, by m/z windows of each scan (PF9).

    Peaks of at most `ratio` times their scan's largest go, and those without intensity. Windows are as wide as `width` (at most hi - lo), at multiples of it, the first from lo on; or n_windows equal ones
    from lo to hi; or a single one. A peak on an edge belongs to the lower window. In each the k most intense peaks stay (ties: lower m/z), scaled to a largest of 50 if normalise.
    """
    x, y = F.col(mz), F.col(intensity)
    top = peaks.groupBy(scan).agg(F.max(intensity).alias("_top"))
    good = peaks.join(top, scan).where((x >= lo) & (x <= hi) & (y > 1e-9))
    if ratio is not None:
        good = good.where(y > ratio * F.col("_top"))
    if width:
        step = min(hi - lo, width)
        number = F.greatest(F.ceil(x / step), F.lit(int(lo // step) + 1))
    elif n_windows and n_windows > 1:
        number = F.greatest(F.ceil((x - lo) / ((hi - lo) / n_windows)), F.lit(1))
    else:
        number = F.lit(1)
    own = good.drop("_top").withColumn("window", number.cast("long"))
    w = Window.partitionBy(scan, "window")
    if normalise:
        own = own.withColumn("_max", F.max(intensity).over(w))
    if k is not None:
        own = own.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(intensity), mz))).where(F.col("_rank") <= k).drop("_rank")
    if normalise:
        own = own.withColumn(intensity, y / F.col("_max") * 50).drop("_max")
    return own


def xcorr_spectrum(peaks: DataFrame, scan: str, mz: str, intensity: str, precursor: str, lo: float, hi: float, discard: float = 1.5, bin_width: float = 1.0005079, ratio: float = 0.05, reach: int = 75) -> DataFrame:
    """(scan, mz, value) of each scan's unit-mass bins from lo to hi, made ready for a cross-correlation (PF10).

    A bin has the largest square root of its peaks, but for those between the bin numbers of the precursor less and plus `discard`. Bins of at most `ratio` times the largest are zero, the others scaled to a largest of 50 in windows a tenth of the range
    wide, and the mean of the bins within reach on either side, as far as the range goes, is taken off. Values above 1e-4 stay, at their bin's m/z.
    """
    last = round((hi - lo) / bin_width)
    base = round(lo / bin_width) * bin_width
    number = F.rint((F.col(mz) - lo) / bin_width).cast("long")
    edge = lambda d: F.rint((F.col(precursor) + d) / bin_width)
    inside = number.between(0, last) & ((F.col(mz) <= edge(-discard)) | (F.col(mz) >= edge(discard))) & (F.col(intensity) >= 0)
    bins = peaks.where(inside).groupBy(scan, number.alias("bin")).agg(F.max(F.sqrt(intensity)).alias("v"))
    top = bins.groupBy(scan).agg(F.max("v").alias("_top"))
    at = F.col("bin") * bin_width + base
    high = last * bin_width + base
    step = min(high - base, float(round((hi - lo) / 10)))
    window = F.greatest(F.ceil(at / step), F.lit(int(base // step) + 1))
    strong = bins.join(top, scan).where((F.col("v") > ratio * F.col("_top")) & (F.col("v") > 0)).withColumn("_w", window)
    scaled = strong.withColumn("v", F.col("v") / F.max("v").over(Window.partitionBy(scan, "_w")) * 50)
    near = Window.partitionBy(scan).orderBy("bin").rangeBetween(-reach, reach)
    count = F.least(F.col("bin") + reach, F.lit(last)) - F.greatest(F.col("bin") - reach, F.lit(0)) + 1
    return scaled.withColumn("value", F.col("v") - F.sum("v").over(near) / count).where("value > 1e-4").select(scan, at.alias("mz"), "value")


def xcorr_preprocess(peaks: DataFrame, scan: str, mz: str, intensity: str, bin_width: float = 1.0005079, reach: int = 75) -> DataFrame:
    """(scan, bin, value): largest square root of each unit-mass bin less the mean of the bins within reach (absent bins are zero), above 1e-4 (PF10)."""
    bins = peaks.groupBy(scan, F.round(F.col(mz) / bin_width).cast("long").alias("bin")).agg(F.max(F.sqrt(intensity)).alias("v"))
    near = Window.partitionBy(scan).orderBy("bin").rangeBetween(-reach, reach)
    out = bins.withColumn("value", F.col("v") - (F.sum("v").over(near) - F.col("v")) / (2 * reach))
    return out.where("value > 1e-4").select(scan, "bin", "value")


def greedy_match(pairs: DataFrame, key: str, ppm: float) -> DataFrame:
    """(key, t_mz, t_intensity, e_intensity) of two peak lists a row (columns t_mz, t_int, e_mz, e_int arrays; J10).

    Theoretical peaks by falling intensity each take the most intense experimental peak left within ppm (of the larger m/z, strictly); a theoretical
    peak without a partner has experimental intensity 0. Order-dependent, so it runs per spectrum pair in pandas.
    """

    def one(t_mz, t_int, e_mz, e_int):
        free = np.ones(len(e_mz), dtype=bool)
        by = np.argsort(-e_int, kind="stable")
        for i in np.argsort(-t_int, kind="stable"):
            near = [j for j in by if free[j] and abs(e_mz[j] - t_mz[i]) / max(e_mz[j], t_mz[i]) * 1e6 < ppm]
            if near:
                free[near[0]] = False
            yield t_mz[i], t_int[i], e_int[near[0]] if near else 0.0

    def run(frames):
        for x in frames:
            rows = [(r[0], *m) for r in zip(x[key], x["t_mz"], x["t_int"], x["e_mz"], x["e_int"]) for m in one(*map(np.asarray, r[1:]))]
            yield pd.DataFrame(rows, columns=[key, "t_mz", "t_intensity", "e_intensity"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, "t_mz", "t_int", "e_mz", "e_int").mapInPandas(run, f"`{key}` {kind}, t_mz double, t_intensity double, e_intensity double")


# ---- outlier rejection of the intensities of one bin (ML15) ----


def min_max_clip(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows but those with the group's least or greatest value (all equal ones go together)."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_lo", F.min(value).over(w)).withColumn("_hi", F.max(value).over(w)).where((F.col(value) > F.col("_lo")) & (F.col(value) < F.col("_hi"))).drop("_lo", "_hi")


def percentile_clip(df: DataFrame, keys: list[str], value: str, percentile: float) -> DataFrame:
    """Rows strictly within median * (1 -+ (1 - (1 - p) / 2))."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    reach = 1 - (1 - percentile) / 2
    return df.join(mid, keys).where((F.col(value) > F.col("_m") * (1 - reach)) & (F.col(value) < F.col("_m") * (1 + reach))).drop("_m")


def below_threshold(df: DataFrame, keys: list[str], value: str, share: float = 0.2) -> DataFrame:
    """All values of a group become 0 when at most `share` of them are above 0."""
    n = df.groupBy(*keys).agg((F.sum((F.col(value) > 0).cast("int")) / F.count("*")).alias("_share"))
    return df.join(n, keys).withColumn(value, F.when(F.col("_share") <= share, 0.0).otherwise(F.col(value))).drop("_share")


def sigma_kept(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Mask of what stays when values outside median -low*sd..+high*sd go, again and again."""
    keep = np.ones(len(x), dtype=bool)
    while keep.sum() > 1:
        mid, sd = np.median(x[keep]), np.std(x[keep], ddof=1)
        new = keep & (x >= mid - low * sd) & (x <= mid + high * sd)
        if (new == keep).all():
            break
        keep = new
    return keep


def averaged_sigma_kept(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """The same with a standard deviation scaled by the median: s = sqrt(sum((x - m)^2 / m) / (n - 1)), sd = s * sqrt(median of non-zeros)."""
    keep = np.ones(len(x), dtype=bool)
    mid = np.median(x[x > 0]) if (x > 0).any() else 0.0
    if mid <= 0 or len(x) < 2:
        return keep
    s = np.sqrt(np.sum((x - mid) ** 2 / mid) / (len(x) - 1))
    while keep.sum() > 1:
        m = np.median(x[keep])
        sd = s * np.sqrt(m) if m > 0 else 0.0
        new = keep & (x >= m - low * sd) & (x <= m + high * sd)
        if (new == keep).all():
            break
        keep = new
    return keep


def winsorised_kept(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Sigma clipping with the deviation of values clamped to 1.5 sd of the median until it settles, times 1.134."""
    keep = np.ones(len(x), dtype=bool)
    while keep.sum() > 1:
        v = x[keep]
        m = np.median(v)
        nonzero = v[v != 0]
        sd = np.std(nonzero, ddof=1) if len(nonzero) > 1 else 0.0
        clamped = v.copy()
        for _ in range(100):
            clamped = np.clip(clamped, m - 1.5 * sd, m + 1.5 * sd)
            new_sd = np.std(clamped, ddof=1) * 1.134
            if sd == 0 or abs(new_sd - sd) / sd <= 5e-5:
                sd = new_sd
                break
            sd = new_sd
        new = keep & (x >= m - low * sd) & (x <= m + high * sd)
        if (new == keep).all():
            break
        keep = new
    return keep


def clip_groups(df: DataFrame, keys: list[str], value: str, method, low: float = 1.5, high: float = 1.5) -> DataFrame:
    """Rows that `method` keeps within their group: the values of one bin, of which there is one a scan."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[method(pdf[value].to_numpy(dtype=float), low, high)]

    return df.groupBy(*keys).applyInPandas(run, df.schema)
