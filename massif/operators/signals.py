"""Array signals: resampling by splines, alignment of traces, extrema that traces share, noise by an undecimated wavelet transform.

A signal is one row with its arrays; rows are worked on a batch at a time, and what meets are a group's reference and its traces, by a join, or the few extrema of a group.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.runtime import ship


def padded(x: np.ndarray, y: np.ndarray, count: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """The points with `count` zeros, `gap` apart, before and after."""
    k = np.arange(1, count + 1) * gap
    return np.concatenate([x[0] - k[::-1], x, x[-1] + k]), np.concatenate([np.zeros(count), y, np.zeros(count)])


def linear(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Linear interpolation; beyond the ends the end segments go on."""
    i = np.clip(np.searchsorted(x, t, side="right") - 1, 0, len(x) - 2)
    return y[i] + (y[i + 1] - y[i]) / (x[i + 1] - x[i]) * (t - x[i])


def akima(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients (c0, c1, c2, c3 by powers of the distance from its left point) of each segment of Akima's cubic spline through five points or more."""
    n = len(x)
    slope = np.diff(y) / np.diff(x)
    turn = np.abs(np.diff(slope))
    d = np.empty(n)
    for i in range(2, n - 2):
        a, b = turn[i], turn[i - 2]
        if a == 0 and b == 0:
            d[i] = ((x[i + 1] - x[i]) * slope[i - 1] + (x[i] - x[i - 1]) * slope[i]) / (x[i + 1] - x[i - 1])
        else:
            d[i] = (a * slope[i - 1] + b * slope[i]) / (a + b)
    for k, at in ((0, (0, 1, 2)), (1, (0, 1, 2)), (n - 2, (n - 3, n - 2, n - 1)), (n - 1, (n - 3, n - 2, n - 1))):
        # the parabola through the three points at this end
        p, q, r = at
        bend = ((y[r] - y[p]) / (x[r] - x[p]) - (y[q] - y[p]) / (x[q] - x[p])) / (x[r] - x[q])
        d[k] = (y[q] - y[p]) / (x[q] - x[p]) + bend * ((x[k] - x[p]) + (x[k] - x[q]))
    w = np.diff(x)
    c2 = (3 * slope - 2 * d[:-1] - d[1:]) / w
    c3 = (d[:-1] + d[1:] - 2 * slope) / (w * w)
    return np.stack([y[:-1], d[:-1], c2, c3], axis=1)


def cubic(x: np.ndarray, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    i = np.clip(np.searchsorted(x, t, side="right") - 1, 0, len(x) - 2)
    u = t - x[i]
    return c[i, 0] + u * (c[i, 1] + u * (c[i, 2] + u * c[i, 3]))


def stationary(x: np.ndarray, c: np.ndarray) -> list[tuple[float, float]]:
    """(time, second derivative) where the spline is level, by rising time, each once."""
    out = set()
    for i in range(len(c)):
        _, b, a2, a3 = c[i].tolist()
        if abs(a3) < 1e-300:
            roots = [-b / (2 * a2)] if a2 else []
        else:
            inner = a2 * a2 - 3 * a3 * b
            roots = [(-a2 + s * np.sqrt(inner)) / (3 * a3) for s in (-1, 1)] if inner > 0 else [-a2 / (3 * a3)] if inner == 0 else []
        out |= {(float(x[i] + r), float(2 * a2 + 6 * a3 * r)) for r in roots if 0 <= r <= x[i + 1] - x[i]}
    return sorted(out)


def b_spline(x: np.ndarray, y: np.ndarray, degree: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """A clamped B-spline with these control points and evenly spaced inner knots, at `points` places; the ends are added where it does not reach them."""
    n = len(x)
    if n <= degree:
        raise ValueError("a spline needs more points than its degree")
    knots = np.concatenate([np.zeros(degree), np.linspace(0, 1, n - degree + 1), np.ones(degree)])
    t = np.arange(points) / points
    base = ((knots[:-1] <= t[:, None]) & (t[:, None] < knots[1:])).astype(float)
    for p in range(1, degree + 1):
        left, right = knots[p:-1] - knots[: -p - 1], knots[p + 1 :] - knots[1:-p]
        a = np.divide(t[:, None] - knots[: -p - 1], left, out=np.zeros((points, len(left))), where=left > 0)
        b = np.divide(knots[p + 1 :] - t[:, None], right, out=np.zeros((points, len(right))), where=right > 0)
        base = a * base[:, :-1] + b * base[:, 1:]
    u, v = base @ x, base @ y
    if u[-1] < x[-1]:
        u, v = np.append(u, x[-1]), np.append(v, y[-1])
    if u[0] > x[0]:
        u, v = np.append(u, x[0]), np.append(v, y[0])
    return u, v


def resampled(x: Column, y: Column, kind: str = "linear", interval: float = 0.05, add: int = 0, gap: float = 1.0, degree: int = 3, points: int = 100) -> Column:
    """Array of (x, y): the signal at steps of `interval` from its first to its last point, `add` zeros on either side included (ML14); null for null arrays and fewer than five points.

    kind: linear, cubic (Akima) or b (a B-spline of `degree` at `points` places, without padding).
    """

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(a, b):
            if a is None or b is None or len(a) != len(b) or len(a) + 2 * add < 5 or not len(a):
                return None
            a, b = np.asarray(a, float), np.asarray(b, float)
            if kind == "b":
                t, v = b_spline(a, b, degree, points) if len(a) > degree else ([], [])
                return [{"x": float(p), "y": float(q)} for p, q in zip(t, v)]
            a, b = padded(a, b, add, gap)
            t = a[0] + np.arange(int(np.rint((a[-1] - a[0]) / interval)) + 1) * interval
            v = linear(a, b, t) if kind == "linear" else cubic(a, akima(a, b), t)
            return [{"x": float(p), "y": float(q)} for p, q in zip(t, v)]

        return pd.Series([one(*p) for p in zip(xs, ys)], dtype=object)

    return run(x, y)


def shift_of(rt: np.ndarray, y: np.ndarray, ref_rt: np.ndarray, ref_y: np.ndarray, resolution: int = 1000) -> float:
    """What to add to a trace's times to lay it on the reference: where the circular cross-correlation of both, padded and resampled, is highest; the first such place."""
    wide = lambda a, b: padded(a, b, 5, (a[-1] - a[0]) / (len(a) - 1))
    x, own = wide(rt, y)
    rx, ref = wide(ref_rt, ref_y)
    count = int((x[-1] - x[0]) * resolution + 2)
    t = x[0] + np.arange(count) / resolution
    t = t[t < x[-1]]
    a, b = np.zeros(count), np.zeros(count)
    a[: len(t)], b[: len(t)] = linear(rx, ref, t), linear(x, own, t)
    product = np.fft.ifft(np.fft.fft(a) * np.conj(np.fft.fft(b)))
    half = count // 2
    size = np.abs(np.concatenate([product[half : 2 * half], product[:half], product[2 * half :]]))
    return -(half - int(size.argmax())) / resolution


def aligned(df: DataFrame, group: list[str], rt: str, intensity: str, is_reference: Column, order: Column) -> DataFrame:
    """df with shift: what to add to each trace's times to lay it on its group's reference, the first row by `order` among those of which is_reference holds; null without one and for traces of fewer than two points (ML13)."""
    ship(df.sparkSession)
    # a window over each group, which spills, where a join would send the references to the driver
    first = F.min_by(F.struct(F.col(rt).alias("t"), F.col(intensity).alias("y")), F.when(is_reference & (F.size(rt) > 1), F.struct(order))).over(Window.partitionBy(*group))
    named = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group])

    @F.pandas_udf("double")
    def run(t: pd.Series, y: pd.Series, rt_: pd.Series, ry: pd.Series) -> pd.Series:
        good = lambda v: v is not None and len(v) > 1
        return pd.Series([shift_of(*(np.asarray(v, float) for v in p)) if all(map(good, p)) else None for p in zip(t, y, rt_, ry)], dtype=float)

    out = df.withColumn("_ref", F.when(named, first)).withColumn("shift", run(F.col(rt), F.col(intensity), F.col("_ref.t"), F.col("_ref.y")))
    return out.withColumn("shift", F.when(~F.isnan("shift"), F.col("shift"))).drop("_ref")


def smoothed(y: np.ndarray, points: int) -> np.ndarray:
    """Means of windows of `points`, weighted by the values themselves, then plain; points without a whole window stay, and so do windows of zeros."""
    for weighted in (True, False):
        out, half = y.copy(), points // 2
        for i in range(half, len(y) - half):
            w = y[i - half : i - half + points]
            total = w.sum()
            out[i] = w.mean() if not weighted else (w * w).sum() / total if total else 0.0
        y = out
    return y


def extrema(rt: Column, intensity: Column, shift: Column, points: int = 5) -> Column:
    """Array of (time, intensity, is_max): where the Akima spline of the smoothed signal is level, times shifted, intensities those of the padded signal between its points (W10); empty for fewer than five points."""

    @F.pandas_udf("array<struct<time:double,intensity:double,is_max:boolean>>")
    def run(ts: pd.Series, ys: pd.Series, shifts: pd.Series) -> pd.Series:
        def one(t, y, s):
            if t is None or y is None or len(t) < 5 or s is None or np.isnan(s):
                return []
            t, y = np.asarray(t, float), np.asarray(y, float)
            level = [(p, b) for p, b in stationary(t, akima(t, smoothed(y, points))) if b != 0]
            at = linear(*padded(t, y, 5, (t[-1] - t[0]) / (len(t) - 1)), np.array([p for p, _ in level]))
            return [{"time": p + s, "intensity": float(v), "is_max": b < 0} for (p, b), v in zip(level, at)]

        return pd.Series([one(*p) for p in zip(ts, ys, shifts)], dtype=object)

    return run(rt, intensity, shift)


def _shared(times: list[float], n_traces: int, tolerance: float, share: float) -> list[float]:
    """First times of groups that reach at most tolerance from their first, with at least share * n_traces members; the last of all never opens a group."""
    out, i = [], 0
    while i < len(times) - 1:
        j = i + 1
        while j < len(times) and times[j] - times[i] <= tolerance:
            j += 1
        if j - i >= share * n_traces:
            out.append(times[i])
        # a group that takes the rest leaves its last one to the end of the walk
        i = j if j < len(times) else len(times) - 1
    return out


def shared_regions(points: list[tuple[float, float, bool]], n_traces: int, height, share: float = 0.55, tolerance: float = 0.1, least: float = 30000.0, window: float = 0.3) -> list[tuple[float, float, float]]:
    """(apex, start, end) of the peak regions of a group, from its traces' extrema (time, intensity, is_max); height gives the reference's smoothed intensity at a time.

    Extrema of at least `least` that enough traces share come in order; of two that follow within `window`, a minimum before a higher minimum and a maximum before a lower one go. A maximum reaches to the minima, or halfway to the maxima, beside it, at
    an end a minute beyond; regions narrower than `window` go.
    """
    kept = []
    for is_max in (False, True):
        times = sorted(t for t, y, m in points if m is is_max and y >= least)
        kept += [(t, is_max) for t in _shared(times, n_traces, tolerance, share)]
    kept.sort()
    i = 0
    while i < len(kept) - 1:
        (a, x), (b, y) = kept[i], kept[i + 1]
        rise = height(b) - height(a)
        if x == y and b - a < window and (rise < 0 if x else rise > 0):
            del kept[i]
        else:
            i += 1
    out = []
    for i, (t, is_max) in enumerate(kept):
        if is_max:
            start, end = kept[0][0] - 1, kept[-1][0] + 1
            if i:
                start = (t + kept[i - 1][0]) / 2 if kept[i - 1][1] else kept[i - 1][0]
            if i + 1 < len(kept):
                end = (t + kept[i + 1][0]) / 2 if kept[i + 1][1] else kept[i + 1][0]
            out.append((t, start, end))
    return [r for r in out if r[2] - r[1] >= window]


def peak_regions(df: DataFrame, group: list[str], rt: str, intensity: str, is_reference: Column, order: Column, points: int = 5, **settings: float) -> DataFrame:
    """(group, apex, start, end): the peak regions that the traces of each group share, on the reference's times (ML13). Groups whose reference has fewer than five points have none."""
    found = aligned(df, group, rt, intensity, is_reference, order).withColumn("_e", extrema(F.col(rt), F.col(intensity), F.col("shift"), points))
    pick = F.min_by(F.struct(F.col(rt).alias("t"), F.col(intensity).alias("y")), F.when(is_reference, F.struct(order)))
    groups = found.groupBy(*group).agg(F.flatten(F.collect_list("_e")).alias("_e"), F.count("*").alias("_n"), pick.alias("_ref"))

    @F.pandas_udf("array<struct<apex:double,start:double,end:double>>")
    def run(es: pd.Series, ns: pd.Series, ts: pd.Series, ys: pd.Series) -> pd.Series:
        def one(e, n, t, y):
            if t is None or len(t) < 5:
                return []
            t = np.asarray(t, float)
            c = akima(t, smoothed(np.asarray(y, float), points))
            made = shared_regions([(p["time"], p["intensity"], bool(p["is_max"])) for p in e], n, lambda v: float(cubic(t, c, np.array([v]))[0]), **settings)
            return [{"apex": a, "start": s, "end": z} for a, s, z in made]

        return pd.Series([one(*p) for p in zip(es, ns, ts, ys)], dtype=object)

    return groups.select(*group, F.explode(run("_e", "_n", F.col("_ref.t"), F.col("_ref.y"))).alias("_r")).select(*group, "_r.*")


def noise_of(signal: np.ndarray, epsilon: float = 0.01, rounds: int = 25, z: float = 1.97) -> tuple[float, bool, int]:
    """(noise, settled, rounds): the deviation of a signal's points without a significant Haar wavelet coefficient at any scale, taken off the smooth of the last scale, until it changes by a share of at most epsilon.

    The transform is undecimated, over the signal and its mirror; a coefficient is significant from z times the deviation on. NaN for signals of fewer than two points.
    """
    n = len(signal)
    if n < 2:
        return float("nan"), False, 0
    v = np.concatenate([signal, signal[::-1]])
    significant, smooth = [], signal
    for j in range(int(np.log2(n))):
        before = np.roll(v, 1 << j)
        at = slice((1 << j) - 1, (1 << j) - 1 + n)
        significant.append(np.abs((v - before) / 2)[at])
        smooth, v = v[at], (v + before) / 2
    rest, top = signal - smooth, np.max(significant, axis=0)
    sigma, k = float(np.std(signal, ddof=1)), 0
    while True:
        own = rest[top < z * sigma]
        new = float(np.std(own, ddof=1)) if len(own) > 1 else float("nan")
        change = abs(new - sigma) / sigma if sigma else float("nan")
        k, sigma = k + 1, new
        if not (change > epsilon and k <= rounds):
            return sigma, k < rounds, k


def wavelet_noise(signal: Column, epsilon: float = 0.01, rounds: int = 25) -> Column:
    """(noise, settled, rounds) of an array column (ML18), as noise_of(); nulls inside a signal are left out; noise is null where there is none."""

    @F.pandas_udf("struct<noise:double,settled:boolean,rounds:int>")
    def run(xs: pd.Series) -> pd.DataFrame:
        made = [noise_of(np.array([v for v in ([] if x is None else x) if v is not None and v == v], float), epsilon, rounds) for x in xs]
        return pd.DataFrame(made, columns=["noise", "settled", "rounds"])

    return run(signal)
