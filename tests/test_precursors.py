"""Refined precursors and isolated envelopes against plain loops."""

from __future__ import annotations

import random

import pytest

from massif.functions.chemistry import PROTON, averagine
from massif.operators import precursors as P


def test_refined_is_the_closest_peak(spark):
    rng = random.Random(1)
    peaks = [(s % 2, s, round(rng.uniform(400, 420), 2), rng.uniform(1, 9)) for s in range(12) for _ in range(rng.choice([0, 1, 40]))]
    picks = [(k, k % 2, rng.randrange(12), round(rng.uniform(398, 422), 2)) for k in range(200)] + [(900, 0, 0, None), (901, 0, 2, 410.0), (901, 0, 2, 410.0)]
    df = spark.createDataFrame(picks, "k int, run int, scan int, mz double").repartition(3)
    table = spark.createDataFrame(peaks, "run int, scan int, mz double, intensity double")
    for reach in (None, 0.3, 5.0):
        got = sorted(((r.k, r.refined_mz) for r in P.refined(df, table, ["run", "scan"], "mz", reach).collect()), key=str)
        want = []
        for k, run, scan, mz in picks:
            near = [m for r, s, m, _ in peaks if (r, s) == (run, scan) and mz is not None and (reach is None or abs(m - mz) <= reach)]
            want.append((k, min(near, key=lambda m: (abs(m - mz), -m)) if near else None))
        assert got == sorted(want, key=str)


def spectrum(masses):
    out = {}
    for mass, z, height in masses:
        shifts, share = averagine(mass)
        for s, a in zip(shifts, share):
            if a > 0.02 * max(share):
                out[float((mass + s) / z + PROTON)] = float(height * a)
    return sorted(out.items())


def test_isolated_envelopes(spark):
    first = spectrum([(1200.6, 2, 1e5), (1500.7, 3, 5e4), (2400.2, 3, 2e5)])
    windows = [(1, 7, 600.8, 601.8), (2, 7, 500.5, 502.0), (3, 7, 700.0, 701.0), (4, 7, None, None), (5, 8, 600.8, 601.8), (6, 7, 500.0, 900.0)]
    w = spark.createDataFrame(windows, "window int, scan int, low double, high double")
    s = spark.createDataFrame([(7, [m for m, _ in first], [y for _, y in first]), (8, [], [])], "scan int, mz array<double>, intensity array<double>")
    got = {}
    for r in P.isolated(w, s, ["scan"]).collect():
        got.setdefault(r.window, []).append((round(r.mass, 2), r.charge))
    assert got[1] == [(1200.6, 2)] and got[2] == [(1500.7, 3)]
    assert set(got) == {1, 2, 6} and {(1200.6, 2), (1500.7, 3), (2400.2, 3)} <= set(got[6])
    assert P.isolated(w.limit(0), s, ["scan"]).count() == 0


def test_averagine_has_its_apex(spark):
    shifts, share = averagine(1200.6)
    assert shifts[0] == pytest.approx(0.0) and max(share) == share[0]
