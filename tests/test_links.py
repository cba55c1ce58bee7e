"""Feature links against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from massif.operators import library as L


def plain(rows, ppm):
    """(node -> least node reached) over all pairs."""
    root = {r[0]: r[0] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n = 0
    for i, (a, on, m, z, s, e) in enumerate(rows):
        for b, on2, m2, z2, s2, e2 in rows[i + 1 :]:
            if on == on2 and z != z2 and s <= e2 and s2 <= e and abs(m - m2) / min(m, m2) * 1e6 <= ppm:
                n += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}, n


@pytest.mark.parametrize(("seed", "span", "charges", "length"), [(1, 1500.0, 3, 20), (2, 200.0, 2, 4), (3, 30.0, 3, 1)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, seed, span, charges, length):
    monkeypatch.setattr(L, "NEAR", 2)
    monkeypatch.setattr(L, "PAIRS", 50)
    rng = random.Random(seed)
    rows = [(k, k % 2, round(1000 + rng.uniform(0, span), 2), rng.randrange(charges), s := rng.randrange(60), s + length) for k in range(300)]
    want, pairs = plain(rows, 5000.0)
    t = spark.createDataFrame(rows, "k long, g int, m double, z int, s int, e int")
    links = L.feature_links(t, "k", "m", "z", "s", "e", 5000.0, ["g"])
    assert {r.k: r.feature for r in L.features(t, links, "k").collect()} == want
    # a forest in each two bins, however many pairs there are
    assert links.count() < 2 * len(rows)
    assert pairs > 40 and len(set(want.values())) > 2


def test_no_links(spark):
    t = spark.createDataFrame([(1, None, 1, 0, 5), (2, -4.0, 2, 0, 5), (3, 500.0, 2, 0, 5), (4, 500.0, 2, 0, 5), (5, 500.0, 1, 6, 9)], "k long, m double, z int, s int, e int")
    links = L.feature_links(t, "k", "m", "z", "s", "e", 10.0)
    assert links.count() == 0 and {r.feature for r in L.features(t, links, "k").collect()} == {1, 2, 3, 4, 5}
    assert [len(x) for x in L.linked(*np.zeros((4, 0)), 10.0)] == [0, 0]


def test_links_of_a_crowd_grow_with_its_traces(spark):
    # all of one bin, every pair of unlike charge is linked: 22,500 pairs
    t = spark.range(300).selectExpr("id AS k", "1000.0D + id / 1000 AS m", "id % 2 AS z", "0 AS s", "9 AS e")
    links = L.feature_links(t, "k", "m", "z", "s", "e", 5000.0)
    assert links.count() < 600
    assert {r.feature for r in L.features(t, links, "k").collect()} == {0}
