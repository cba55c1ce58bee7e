"""The normalisation chain recovers planted factors, and its medians are those of numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from massif.operators import normalise as N

KINDS = "run int, condition string, biorep int, fraction int, techrep int"


def design_of(conditions=2, bioreps=2, fractions=3, techreps=2):
    rows, n = [], 0
    for c in range(conditions):
        for b in range(bioreps):
            for f in range(fractions):
                for t in range(techreps):
                    rows.append((n, f"c{c}", b, f, t))
                    n += 1
    return rows


def planted(seed, design, n=1500, noise=0.05):
    """(rows, true factor by (condition, biorep, fraction), true factor by run): what the machine multiplied."""
    rng = np.random.default_rng(seed)
    by_fraction = {(c, b, f): 1.0 if (c, b) == ("c0", 0) else rng.uniform(0.6, 1.7) for _, c, b, f, _ in design}
    by_run = {r: by_fraction[c, b, f] * (rng.uniform(0.8, 1.25) if t else 1.0) for r, c, b, f, t in design}
    amount, share = 2 ** rng.normal(20, 2, n), rng.dirichlet([0.4] * (max(d[3] for d in design) + 1), n)
    rows = []
    for r, c, b, f, _ in design:
        change = np.where(rng.random(n) < 0.08, rng.uniform(0.2, 5, n), 1.0) if c != "c0" else np.ones(n)
        y = amount * change * share[:, f] * by_run[r] * np.exp(rng.normal(0, noise, n))
        rows += [(f"s{i}", r, float(v)) for i, v in enumerate(y) if share[i, f] > 0.02 and rng.random() < 0.97]
    return rows, by_fraction, by_run


def tables(spark, rows, design):
    return spark.createDataFrame(rows, "sequence string, run int, intensity double").repartition(3), spark.createDataFrame(design, KINDS)


def test_fraction_factors_are_recovered(spark):
    design = design_of(techreps=1)
    rows, by_fraction, _ = planted(1, design)
    df, d = tables(spark, rows, design)
    got = {(r.condition, r.biorep, r.fraction): r.factor for r in N.fraction_factors(df, d).collect()}
    assert set(got) == set(by_fraction)
    for k, f in by_fraction.items():
        assert abs(got[k] * f - 1) < 0.03, (k, got[k], 1 / f)


def test_chain_recovers_every_run(spark):
    design = design_of()
    rows, _, by_run = planted(2, design, n=900)
    df, d = tables(spark, rows, design)
    out, factors = N.normalised(df, d)
    got = {r.run: r.factor for r in factors.collect()}
    level = np.median([got[r] * by_run[r] for r in by_run])
    assert all(abs(got[r] * f / level - 1) < 0.05 for r, f in by_run.items())
    before = {(r.sequence, r.run): r.intensity for r in df.collect()}
    assert all(abs(r.intensity - before[r.sequence, r.run] * got[r.run]) < 1e-6 * r.intensity for r in out.collect())


def test_bioreps_and_techreps_are_medians(spark):
    design = design_of(fractions=1)
    rows, _, _ = planted(3, design, n=200, noise=0.4)
    rows += [("zero", 0, 0.0), ("zero", 2, 5.0), ("none", 0, None)]
    df, d = tables(spark, rows, design)
    y = {}
    for s, r, v in rows:
        y.setdefault(r, {})[s] = v
    median = lambda a, b: 1 / float(np.median([y[a][s] / y[b][s] for s in y[a] if y[a][s] and y[b].get(s)]))
    first = {(c, b): r for r, c, b, _, t in design if t == 0}
    got = {(r.condition, r.biorep): r.factor for r in N.biorep_factors(df, d).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(median(r, 0), 9) for k, r in first.items()}
    got = {r.run: r.factor for r in N.techrep_factors(df, d).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {r: round(median(r, first[c, b]) if t else 1.0, 9) for r, c, b, _, t in design}


def test_nothing_shared_and_empty_tables(spark):
    design = design_of(1, 2, 2, 1)
    df, d = tables(spark, [("a", 0, 5.0), ("b", 2, 7.0), ("b", 3, 2.0), ("x", 99, 1.0)], design)
    out, factors = N.normalised(df, d)
    assert {r.factor for r in factors.collect()} == {1.0}
    assert sorted((r.sequence, r.intensity) for r in out.collect()) == [("a", 5.0), ("b", 2.0), ("b", 7.0)]
    assert N.normalised(df.limit(0), d)[0].count() == 0
    assert N.fraction_factors(df, d.withColumn("fraction", F.lit(0))).where("factor <> 1").count() == 0


def test_passes_read_blocks_and_sum_every_row(spark, monkeypatch):
    monkeypatch.setattr(N, "BATCH", 50)
    monkeypatch.setattr(N, "HELD", 400)
    rng = np.random.default_rng(6)
    rows = [(int(s), float(r), [float(x) for x in v]) for s, r, v in zip(rng.integers(0, 4, 3000), rng.lognormal(0, 1, 3000), rng.lognormal(0, 1, (3000, 3)))]
    rows += [(7, 2.0, [1.0, 0.0, 3.0])]
    df = spark.createDataFrame(rows, "sample long, ref double, values array<double>").repartition(3)
    blocks = N._blocks(df, 3).localCheckpoint()
    # 50 rows each, and the rest of each sample in each of three tasks
    assert blocks.count() <= 3000 // 50 + 5 * 3 and blocks.agg(F.max(F.length("data"))).first()[0] <= 50 * 4 * 8
    tried = {s: rng.uniform(0.5, 2, (2, 3)) for s in (0, 1, 2, 7)}
    got, normal = N._partials(blocks, 3, tried, False), N._partials(blocks, 3, tried, True)
    assert set(got) == set(normal) == set(tried)
    for s, f in tried.items():
        r, v = np.log([x[1] for x in rows if x[0] == s]), np.array([x[2] for x in rows if x[0] == s])
        assert np.allclose(got[s], np.abs(np.log(v @ f.T) - r[:, None]).sum(axis=0))
        part = v * f[0]
        e, j = np.log(part.sum(axis=1)) - r, part / part.sum(axis=1)[:, None]
        w = 1 / np.maximum(np.abs(e), 1e-9)
        assert np.allclose(normal[s], np.concatenate([((j * w[:, None]).T @ j).ravel(), j.T @ (w * e)]))
