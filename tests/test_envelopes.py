"""Envelopes of many spectra at once against one loop a spectrum; isotopes and envelopes dealt to many tasks."""

from __future__ import annotations

import random
from bisect import bisect_left
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from massif.functions.chemistry import PROTON, averagine, averagine_atoms, averagine_of
from massif.operators import envelopes as E
from massif.operators import grouped
from massif.operators import precursors as P

average = lru_cache(100_000)(averagine_of)


def plain(mz, intensity, ppm, charges):
    found, values = [], mz.tolist()

    def closest(want):
        k = bisect_left(values, want)
        near = [x for x in (values[k - 1] if k else None, values[k] if k < len(values) else None) if x is not None]
        return bisect_left(values, min(near, key=lambda x: abs(x - want)))

    for i in np.flatnonzero(intensity >= 0.01 * intensity.max()) if len(mz) else ():
        for z in charges:
            shifts, share = average(*averagine_atoms((mz[i] - PROTON) * z))
            apex = int(np.argmax(share))
            mono = (mz[i] - PROTON) * z - shifts[apex]
            used = []
            for j in np.argsort(-share):
                if share[j] < 0.05 * share[apex]:
                    break
                want = (mono + shifts[j]) / z + PROTON
                at = closest(want)
                ratio = intensity[at] / intensity[i] / (share[j] / share[apex])
                if abs(mz[at] - want) / want * 1e6 > ppm or not 0.25 <= ratio <= 4:
                    break
                used.append(at)
            n = len(set(used))
            if n >= 2:
                found.append((intensity[used].sum() * n**0.4 / z**0.06, mono, z, frozenset(used)))
    out, taken = [], set()
    for score, mono, z, used in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if not used & taken:
            taken |= used
            out.append((mono, z, float(score), used))
    return out


def crowded(rng, n, width, like):
    """Envelopes at close masses, some of equal heights, and noise."""
    peaks = []
    for _ in range(n):
        z, mass, height = rng.randint(1, 4), 600 + rng.random() * width, rng.choice([1e4, 1e5, rng.uniform(1e3, 1e6)])
        shifts, share = averagine(mass)
        peaks += [((mass + s) / z + PROTON, height * a * (1 if like else rng.uniform(0.6, 1.5))) for s, a in zip(shifts.tolist(), share.tolist()) if a > 0.01]
    peaks += [(rng.uniform(200, 700), rng.uniform(1e2, 1e5)) for _ in range(3 * n)]
    peaks += [peaks[0], (peaks[1][0], peaks[1][1] / 2)]
    peaks.sort()
    return np.array([m for m, _ in peaks]), np.array([y for _, y in peaks])


def test_many_spectra_at_once(monkeypatch):
    rng = random.Random(3)
    spectra = [crowded(rng, n, w, like) for n, w, like in ((3, 900, True), (20, 900, False), (40, 200, False), (30, 3, True), (1, 3000, True))] + [(np.zeros(0), np.zeros(0)), (np.array([500.0]), np.array([1.0]))]
    mz, y = (np.concatenate([s[k] for s in spectra]) for k in (0, 1))
    ends = np.cumsum([len(s[0]) for s in spectra])
    first, last = np.append(0, ends[:-1]), ends
    # stretches that share peaks, and empty ones
    cuts = [(k, k + rng.randint(-1, 80)) for k in range(0, int(ends[3]) - 80, 7)]
    first, last = np.append(first, [max(0, a) for a, _ in cuts]), np.append(last, [max(a, b) for a, b in cuts])
    keep = [k for k, (a, b) in enumerate(zip(first, last)) if (np.diff(mz[a:b]) >= 0).all()]
    first, last = first[keep], last[keep]
    want = [(k, m, z, s, len(u), tuple(sorted(int(a) + p for p in u))) for k, (a, b) in enumerate(zip(first, last)) for m, z, s, u in plain(mz[a:b], y[a:b], 20.0, range(1, 5))]
    assert len(want) > 300
    for at_once in (400_000, 300):
        monkeypatch.setattr(E, "AT_ONCE", at_once)
        own, mass, z, score, n, used = E.envelopes(mz, y, first, last, 20.0, range(1, 5))
        got = [(k, m, c, s, int(i), tuple(sorted({p for p in u if p >= 0}))) for k, m, c, s, i, u in zip(own.tolist(), mass.tolist(), z.tolist(), score.tolist(), n, used.tolist())]
        assert got == want


def test_isolated_is_the_loop_over_each_window(spark):
    rng = random.Random(4)
    scans = {k: crowded(rng, 25, 900, False) for k in range(3)}
    rows = [(w, w % 4, lo, lo + rng.uniform(0.1, 3)) for w in range(400) for lo in [rng.uniform(180, 720)]]
    table = spark.createDataFrame([(k, m.tolist(), y.tolist()) for k, (m, y) in scans.items()], "scan int, mz array<double>, intensity array<double>")
    got = sorted(tuple(r) for r in P.isolated(spark.createDataFrame(rows, "window int, scan int, low double, high double"), table, ["scan"], most_charge=4).collect())
    want = []
    for w, k, lo, hi in rows:
        m, y = scans.get(k, (np.zeros(0), np.zeros(0)))
        cut = (m >= lo - P.REACH) & (m <= hi + P.REACH)
        m, y = m[cut], y[cut]
        want += [(w, mass, z, score, len(u)) for mass, z, score, u in plain(m, y, 20.0, range(1, 5)) if any(lo <= m[p] <= hi for p in u)]
    assert got == sorted(want) and len(want) > 30


def test_isotopes_come_from_many_tasks(spark):
    """A small table comes in one part, which would keep all isotopes and envelopes of it in one task."""
    df = spark.range(0, 3000, 1, 1).select(F.col("id").alias("k"), F.concat(F.lit("C"), F.col("id") % 30 + 5, F.lit("H9NO2S")).alias("f"))
    rows = grouped.isotope_rows(df, "k", "f", 1e-3).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) == 4 and len({r.k for r in rows}) == 3000
    own = [r for r in rows if r.k == 7]
    assert [r.isotope for r in own] == list(range(len(own))) and abs(sum(r.abundance for r in own) - 1) < 0.01
