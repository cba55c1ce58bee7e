"""Splines, alignment, shared extrema and wavelet noise against plain formulas and planted signals."""

from __future__ import annotations


import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.operators import signals as S


def bumps(t, *peaks):
    return sum(h * np.exp(-(((t - c) / w) ** 2) / 2) for c, w, h in peaks)


def test_akima_goes_through_its_points_with_matching_slopes():
    rng = np.random.default_rng(1)
    x, y = np.cumsum(rng.uniform(0.2, 1.0, 12)), rng.normal(size=12)
    c = S.akima(x, y)
    assert np.allclose(S.cubic(x, c, x[:-1]), y[:-1]) and np.allclose(S.cubic(x, c, x[1:] - 1e-12), y[1:], atol=1e-9)
    w = np.diff(x)
    slopes = c[:, 1] + w * (2 * c[:, 2] + 3 * w * c[:, 3])
    assert np.allclose(slopes[:-1], c[1:, 1])
    # quadratics come back whole where neighbouring slopes change evenly
    q = 3 - 2 * np.arange(9.0) + 0.5 * np.arange(9.0) ** 2
    t = np.linspace(0, 8, 50)
    assert np.allclose(S.cubic(np.arange(9.0), S.akima(np.arange(9.0), q), t), 3 - 2 * t + 0.5 * t**2)


def test_stationary_points_are_level():
    x = np.linspace(0, 6, 25)
    c = S.akima(x, np.sin(x))
    found = S.stationary(x, c)
    assert [round(t, 1) for t, _ in found] == [1.6, 4.7] and found[0][1] < 0 < found[1][1]
    for t, _ in found:
        assert abs(S.cubic(x, c, np.array([t + 1e-5]))[0] - S.cubic(x, c, np.array([t - 1e-5]))[0]) < 1e-9


def test_b_spline_by_recursion():
    rng = np.random.default_rng(2)
    x, y, p = np.cumsum(rng.uniform(0.5, 1, 9)), rng.normal(size=9), 3
    knots = [0.0] * p + [k / (len(x) - p) for k in range(len(x) - p + 1)] + [1.0] * p

    def base(i, p, t):
        if p == 0:
            return float(knots[i] <= t < knots[i + 1])
        a = (t - knots[i]) / (knots[i + p] - knots[i]) * base(i, p - 1, t) if knots[i + p] > knots[i] else 0
        b = (knots[i + p + 1] - t) / (knots[i + p + 1] - knots[i + 1]) * base(i + 1, p - 1, t) if knots[i + p + 1] > knots[i + 1] else 0
        return a + b

    u, v = S.b_spline(x, y, p, 40)
    want = [(sum(x[i] * base(i, p, k / 40) for i in range(9)), sum(y[i] * base(i, p, k / 40) for i in range(9))) for k in range(40)]
    assert np.allclose(list(zip(u, v))[:40], want) and (u[-1], v[-1]) == (x[-1], y[-1])


def test_resampled(spark):
    x, y = [1.0, 1.4, 2.0, 2.5, 3.0, 3.6], [0.0, 5.0, 9.0, 4.0, 2.0, 1.0]
    df = spark.createDataFrame([(x, y), (x[:3], y[:3]), (None, None), ([], [])], "x array<double>, y array<double>")
    rows = df.select(*[S.resampled(F.col("x"), F.col("y"), kind, add=add).alias(f"{kind}{add}") for kind, add in (("linear", 0), ("cubic", 2), ("b", 0))]).collect()
    t = np.array([p.x for p in rows[0].linear0])
    assert np.allclose(t, 1 + 0.05 * np.arange(53)) and np.allclose([p.y for p in rows[0].linear0], np.interp(t, x, y))
    assert len(rows[0].cubic2) == int(round((3.6 + 2 - (1 - 2)) / 0.05)) + 1 and rows[0].cubic2[0].y == 0
    assert rows[1].linear0 is None and rows[1].cubic2 is not None and rows[2].linear0 is None and rows[3].cubic2 is None


def test_shifts_are_recovered(spark):
    t = np.arange(30, 34, 0.05)
    rows = []
    for g in range(5):
        for k in range(4):
            move = 0.13 * k * (1 if g % 2 else -1)
            rows.append((g, k, (t + 0.0).tolist(), bumps(t, (31.5 + 0.1 * g + move, 0.2, 1e5), (32.4 + move, 0.15, 4e4)).tolist(), k == 0, move))
    rows += [(9, 0, [1.0, 2.0], [3.0, 4.0], False, None), (1, 9, [5.0], [1.0], False, None)]
    df = spark.createDataFrame(rows, "g int, k int, t array<double>, y array<double>, ref boolean, move double")
    got = S.aligned(df, ["g"], "t", "y", F.col("ref"), F.col("k")).collect()
    for r in got:
        assert r.shift is None if r.move is None else abs(r.shift + r.move) < 0.004


def test_correlation_by_sums():
    rng = np.random.default_rng(3)
    rt, ref_rt = np.cumsum(rng.uniform(0.01, 0.03, 14)) + 5, np.cumsum(rng.uniform(0.01, 0.03, 17)) + 5.02
    y, ref = bumps(rt, (5.15, 0.04, 1.0)), bumps(ref_rt, (5.2, 0.04, 1.0))
    wide = lambda a, b: S.padded(a, b, 5, (a[-1] - a[0]) / (len(a) - 1))
    x, own = wide(rt, y)
    n = int((x[-1] - x[0]) * 1000 + 2)
    t = x[0] + np.arange(n) / 1000
    a, b = (np.where(t < x[-1], S.linear(*wide(u, v), t), 0) for u, v in ((ref_rt, ref), (rt, y)))
    sums = [float((a * np.roll(b, k)).sum()) for k in range(-(n // 2), n // 2)]
    assert S.shift_of(rt, y, ref_rt, ref) == pytest.approx((int(np.argmax(sums)) - n // 2) / 1000)


def test_peak_regions(spark):
    t = np.arange(10, 14, 0.05)
    rows = [(k, (t + 0.1 * k).tolist(), bumps(t, (11.0, 0.15, 2e5), (12.5, 0.2, 1e5), (11.75, 0.6, 5e4)).tolist(), k == 0) for k in range(5)]
    df = spark.createDataFrame(rows, "k int, t array<double>, y array<double>, ref boolean").withColumn("g", F.lit("x"))
    got = sorted((r.apex, r.start, r.end) for r in S.peak_regions(df, ["g"], "t", "y", F.col("ref"), F.col("k")).collect())
    assert [round(a, 1) for a, _, _ in got] == [11.0, 12.5]
    assert got[0][2] == got[1][1] and 11.4 < got[0][2] < 12.1


def test_shared_groups_and_trimming():
    at = lambda times, n=4: S._shared(sorted(times), n, 0.1, 0.55)
    assert at([1.0, 1.05, 1.09, 2.0, 2.2, 2.21, 2.25]) == [1.0, 2.2]
    assert at([1.0]) == [] and at([]) == [] and at([1.0, 1.01, 1.02, 9.0]) == [1.0]
    points = [(t + 0.01 * k, 1e5, m) for k in range(4) for t, m in ((1.0, True), (1.2, True), (2.0, False), (3.0, True))]
    # the lower of two near maxima that follow stays out
    assert [r[0] for r in S.shared_regions(points, 4, lambda t: 5.0 - t)] == [1.2, 3.0]
    assert [r[0] for r in S.shared_regions(points, 4, lambda t: t)] == [1.0, 1.2, 3.0]


def plain_noise(x, epsilon=0.01, most=25):
    n = len(x)
    v, levels, smooth = list(x) + list(x)[::-1], [], None
    for j in range(1, int(math.floor(math.log2(n))) + 1):
        w = [0.5 * v[t] - 0.5 * v[t - 2 ** (j - 1)] for t in range(2 * n)]
        s = [0.5 * v[t] + 0.5 * v[t - 2 ** (j - 1)] for t in range(2 * n)]
        a = 2 ** (j - 1) - 1
        levels.append(w[a : a + n])
        smooth, v = v[a : a + n], s
    rest, sigma, k = [p - q for p, q in zip(x, smooth)], float(np.std(x, ddof=1)), 0
    while True:
        own = [rest[i] for i in range(n) if all(abs(w[i]) < 1.97 * sigma for w in levels)]
        new = float(np.std(own, ddof=1)) if len(own) > 1 else float("nan")
        gap, sigma, k = abs(new - sigma) / sigma, new, k + 1
        if not (gap > epsilon and k <= most):
            return sigma, k


def test_wavelet_noise(spark):
    rng = np.random.default_rng(4)
    signals = [rng.normal(0, s, n) + bumps(np.arange(n), (n / 2, 3, h)) for s, n, h in ((1.0, 500, 80.0), (3.0, 1000, 0.0), (0.2, 130, 5.0), (1.0, 37, 9.0))]
    rows = [(k, x.tolist()) for k, x in enumerate(signals)] + [(8, [1.0]), (9, None), (10, [None, 4.0, None])]
    got = {r.k: r.n for r in spark.createDataFrame(rows, "k int, x array<double>").select("k", S.wavelet_noise(F.col("x")).alias("n")).collect()}
    for k, x in enumerate(signals):
        want, rounds = plain_noise(x)
        assert (got[k].noise, got[k].rounds) == (pytest.approx(want), rounds)
    assert abs(got[1].noise - 3.0) < 0.6
    assert all(got[k].noise is None for k in (8, 9, 10))


def test_alignment_sends_no_references_to_the_driver(spark):
    rows = [(g, r, [0.05 * k for k in range(7)], [float((k + r) % 5 + 1) for k in range(7)], r == 0) for g in (1, 2, None) for r in range(3)]
    df = spark.createDataFrame(rows, "g long, r int, t array<double>, y array<double>, ref boolean")
    plan = S.aligned(df, ["g"], "t", "y", F.col("ref"), F.col("r"))
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    got = {(x.g, x.r): x["shift"] for x in plan.collect()}
    assert got[1, 0] == got[2, 0] == 0 and got[None, 0] is None and got[1, 1] is not None
