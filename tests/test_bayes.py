"""Chains against closed forms, planted changes, and independence of the dealing."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.operators import bayes as B


def test_log_gamma():
    x = np.concatenate([np.linspace(0.01, 5, 60), [10.0, 77.5, 1000.0]])
    assert np.allclose(B.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_density_and_prior():
    state = np.array([[0.5], [2.0], [3.0]])
    x, w = np.array([[1.0, -4.0]]), np.array([[1.0, 0.5]])
    pdf = lambda v: math.gamma(2) / (math.gamma(1.5) * math.sqrt(3 * math.pi) * 2) * (1 + ((v - 0.5) / 2) ** 2 / 3) ** -2
    assert B.log_density(state, x, w)[0] == pytest.approx(math.log(pdf(1.0)) + 0.5 * math.log(pdf(-4.0)))
    one, none = np.ones(1), np.full(1, np.nan)
    assert B.log_prior(state, one, none, none, one)[0] == pytest.approx(-math.log(math.pi * 1.25) - math.log(1000 - 0.001) - 3 / 29 - math.log(29))
    assert B.log_prior(np.array([[0.0], [2000.0], [3.0]]), one, none, none, one)[0] == -np.inf


def test_chains_find_mean_and_scale():
    rng = np.random.default_rng(1)
    data = [rng.normal(m, s, 200) for m, s in ((0.0, 1.0), (8.0, 0.2), (-3.0, 4.0))]
    data[0][:6] = 60.0
    none = np.full(3, np.nan)
    out = B.chains(data, [np.ones(200)] * 3, [1, 2, 3], np.full(3, 20.0), none, none, 1500, 2500)
    mu, scale = np.median(out[0], axis=1), np.median(out[1], axis=1)
    # outliers hardly move the first
    assert np.allclose(mu, [0, 8, -3], atol=[0.25, 0.06, 1.0]) and np.allclose(scale[1:], [0.2, 4], rtol=0.3) and 0.4 < scale[0] < 1.6, scale
    assert np.std(out[0], axis=1)[1] == pytest.approx(0.2 / math.sqrt(200), rel=0.4)
    assert (out[2] >= 1).all() and (out[1] > 0).all()
    alone = B.chains(data[1:2], [np.ones(200)], [2], np.full(1, 20.0), none[:1], none[:1], 1500, 2500)
    assert np.allclose(alone[:, 0], out[:, 1])


def test_scale_prior_is_a_floor():
    data = [np.array([1.0, 1.001, 0.999])]
    out = B.chains(data, [np.ones(3)], [4], np.full(1, 20.0), np.full(1, 0.5), np.full(1, 0.1), 300, 600)
    assert out[1].min() >= 0.5


def test_narrowest_interval():
    x = np.random.default_rng(2).exponential(size=20000)
    low, high = B.narrowest(x)
    assert low < 0.02 and high == pytest.approx(-math.log(0.05), rel=0.06)
    assert B.narrowest(np.array([3.0])) == (3.0, 3.0)


def test_planted_changes(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{k}", c, float(2 ** rng.normal(20 + (k % 3) * (c == "b"), 0.15)), 1.0) for k in range(9) for c in "ab" for _ in range(8)]
    rows += [("one", "a", 8.0, 1.0), ("one", "b", 32.0, 1.0), ("half", "a", 8.0, 1.0), ("none", "a", 0.0, 1.0), ("p0", "a", None, 1.0), ("p0", "b", 5.0, 0.0)]
    df = spark.createDataFrame(rows, "protein string, condition string, y double, w double")
    run = lambda d: {r.protein: r for r in B.fold_changes(d, "protein", "condition", "y", "a", "b", "w", burn_in=500, steps=1500).collect()}
    got = run(df.repartition(3))
    for k in range(9):
        r = got[f"p{k}"]
        assert abs(r.change - k % 3) < 0.4 and r.low < r.change < r.high and r.n_first == 8
        assert r.pep < 0.01 and r.bayes_factor > 50 if k % 3 else r.pep > 0.1
    assert got["one"].change == 2.0 and got["one"].pep == 1.0 and got["one"].low is None
    assert got["half"].change is None and got["half"].pep == 1.0 and "none" not in got
    again = run(df.repartition(1, F.rand()))
    assert {k: tuple(v) for k, v in again.items()} == {k: tuple(v) for k, v in got.items()}


def test_long_groups_run_apart():
    from massif.operators import bayes

    sizes = [5] * 100 + [bayes.CELLS] * 3 + [bayes.CELLS // 2, bayes.CELLS // 2, 1]
    got = bayes.side_by_side(sizes)
    assert [k for lo, hi in got for k in range(lo, hi)] == list(range(len(sizes))) and bayes.side_by_side([]) == []
    assert all(hi - lo == 1 or hi - lo <= bayes.ABREAST and (hi - lo) * max(sizes[lo:hi]) <= bayes.CELLS for lo, hi in got)
