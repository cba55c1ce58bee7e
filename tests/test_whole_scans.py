"""Merged peaks and shared extrema across ranges, and the queries over whole tables against brute force."""

from __future__ import annotations

import random
from collections import Counter
from statistics import median

from pyspark.sql import functions as F

from massif.operators import scans
from massif.plans import registry, sequence


def chained(values, apart):
    out = []
    for v in sorted(values):
        if out and not apart(out[-1][-1][0], v[0]):
            out[-1].append(v)
        else:
            out.append([v])
    return out


def test_merged_bins_join_across_edges(spark):
    rng = random.Random(1)
    # one cluster of 400 peaks, each within 10 ppm of the one before, then scattered ones
    peaks, m = [], 500.0
    for k in range(800):
        m *= 1 + (8e-6 if k < 400 else rng.choice([4e-6, 5e-5]))
        peaks.append((m, rng.randint(1, 9)))
    want = sorted((median(v for v, _ in c), sum(i for _, i in c), len(c)) for c in chained(peaks, lambda a, b: b > a * (1 + 10 * 1e-6)))
    out = scans.merged_bins(spark.createDataFrame(peaks, "mz double, i long").repartition(5), "mz", "i", 10.0)
    assert sorted((r.mz, r.intensity, r.n) for r in out.collect()) == want and max(n for *_, n in want) >= 400
    assert scans.merged_bins(spark.createDataFrame([], "mz double, i long"), "mz", "i", 10.0).count() == 0


def test_shared_extrema_by_ranges(spark):
    rng = random.Random(2)
    points = [(rng.randrange(6), t) for t in rng.sample(range(4000), 300)]
    groups = chained([(t, r) for r, t in points], lambda a, b: b - a > 20)
    want = sorted((c[0][0], c[-1][0], len({r for _, r in c})) for c in groups if len({r for _, r in c}) >= 0.5 * 6)
    df = spark.createDataFrame(points, "run long, time long").repartition(5)
    assert sorted((r.first, r.last, r.n_runs) for r in map(lambda x: type("R", (), x.asDict()), scans.shared_extrema(df, "run", "time", 20, 0.5).collect())) == want
    assert len(want) > 1


def test_queries_take_whole_tables(spark, sf_dir, tmp_path):
    # part keys beyond every subset, on a few rows
    part = spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").limit(8).withColumn("p_partkey", (F.col("p_partkey") + 1000).cast("long"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    keys = {r.p_partkey for r in part.collect()}
    sequences = {r.p_partkey: r.seq for r in sequence._sequences(spark, str(tmp_path)).collect()}
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    cuts = [(k, e, i, s[i:] if e == "N" else s[: max(len(s) - i, 0)]) for k, s in sequences.items() for e in "NC" for i in range(1, 5)]
    assert sorted(tuple(r) for r in run("truncation_products")) == sorted(c for c in cuts if len(c[3]) >= 5)
    for name in ("digest_semi", "fragment_masses", "deconvolute"):
        assert {r.p_partkey for r in run(name)} == keys, name
    n = {k: sum(c in "MS" for c in s) for k, s in sequences.items()}
    forms = Counter(r.p_partkey for r in run("modified_forms"))
    assert forms == {k: min(1024, 1 + m + m * (m - 1) // 2) for k, m in n.items()}


def test_closest_peak_of_equal_ones(spark):
    rows = [(1, 25.0, 9.0), (1, 25.0, 3.0), (1, 26.0, 1.0), (2, 24.9, 8.0), (2, 24.9, 4.0), (3, 90.0, 1.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "scan int, mz double, y double").coalesce(1)
        got = sorted(map(tuple, scans.closest_per_scan(df, "scan", "mz", "y", 25.0, 5000.0).collect()))
        assert got == [(1, 25.0, 3.0), (2, 24.9, 4.0), (3, None, 0.0)]


def test_expressions_are_bound_once(spark):
    """An expression that a lambda names is worked out once a row: its text does not come again and again in the plan."""
    from massif.functions import chemistry as C
    from massif.operators import sequence as Q

    df = spark.createDataFrame([("C2H6O", "MABKCDR")], "f string, s string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    for c in (C.hill(F.col("f")), C.composition_text(C.combined(C.composition(F.col("f")), C.composition(F.col("f"))))):
        assert plan(c).count("regexp_extract_all(") <= 4
    assert plan(Q.decoy_peptide(F.col("s"), "KR")).count("split(") == 1
    assert plan(Q.residue_hits(F.upper("s"), F.array(F.lit("A"), F.lit("B")))).count("upper(") <= 4
    assert df.select(C.hill(F.col("f")), Q.decoy_peptide(F.col("s"), "KR")).first() == ("C2H6O", "DCBKAMR")


def test_fold_changes_of_many_groups_are_those_of_each(spark):
    import numpy as np

    from massif.operators import grouped

    rnd = random.Random(5)
    rows = [(k, c, rnd.uniform(-1, 9)) for k in range(30) for c in "AR" for _ in range(k % 5)] + [(99, "A", float("nan")), (99, "R", None)]
    df = spark.createDataFrame(rows, "k int, c string, v double")
    out = grouped.bayes_fold_change(df, "k", "c", "v", "A", "R", 100)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r for r in out.collect()}
    assert set(got) == {k for k, _, _ in rows}
    for k, r in got.items():
        a, b = (np.log2(sorted(v for i, s, v in rows if i == k and s == c and v and v > 0)) for c in "AR")
        want = grouped.fold_change(a, b, 100, 1, 0.05)
        for x, y in zip((r.change, r.low, r.high, r.pep), want):
            assert x is None and np.isnan(y) or x is not None and (abs(x - y) < 1e-9 or np.isnan(x) and np.isnan(y))
