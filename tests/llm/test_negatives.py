"""Hard negatives against all inner products: clustered and random vectors, ties, repeated rows, nulls, hot vectors."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.llm import negatives, registry

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, row string, part int"


def brute(rows, anchor, positives=5, want=5, low=80, scale=256):
    use = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in use), default=0)
    m = np.array([v + [0] * (width - len(v)) for _, v, _ in use], dtype=object).reshape(len(use), width)
    label = [y for _, _, y in use]
    rank = [math.inf if i is None else i for i, _, _ in use]
    out = []
    for a, (i, _, y) in enumerate(use):
        if i is None or not anchor(i):
            continue
        scores = (m @ m[a]).tolist() if width else [0] * len(use)
        order = sorted(range(len(use)), key=lambda b: (-scores[b], rank[b], b))
        for p in [b for b in order if b != a and label[b] == y][:positives]:
            ps = scores[p]
            hard = [b for b in order if label[b] != y and low * ps <= 100 * scores[b] <= 100 * ps][:want]
            out += [(i, use[p][0], k + 1, use[b][0], ps, scores[b]) for k, b in enumerate(hard)]
    return sorted(out, key=str)


def run(spark, rows, every=10, **settings):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % every == 0, **settings).collect()), key=str)


def clustered(seed, n, d, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    v = (centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, d))).astype(np.float32)
    return [(i, v[i].tolist(), int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize(("leaf", "block", "group"), [(64, 8192, 1024), (4, 50, 7), (1, 9, 2)])
def test_against_all_products(spark, monkeypatch, leaf, block, group):
    for name, x in (("LEAF", leaf), ("BLOCK", block), ("GROUP", group), ("AT_ONCE", 3)):
        monkeypatch.setattr(negatives, name, x)
    rows = clustered(leaf, 400, 6)
    rng = random.Random(leaf)
    rows += [(400 + i, rows[7][1], rng.randrange(3)) for i in range(120)]
    rows += [(None, rows[8][1], 1), (None, rows[9][1], 2), (530, None, 1), (531, [1.0], None), (532, [float("nan")] * 6, 1), (540, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (533, [float("inf")] * 6, 1)]
    rows += [(550, [0.5, -0.25], 1), (560, [], 2), (570, [0.0] * 6, 2), (580, [-x for x in rows[3][1]], 9)]
    got = run(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 500


def test_other_settings_and_repeated_rows(spark):
    rows = clustered(5, 150, 3, 3)
    rows += rows[:40]
    got = run(spark, rows, every=20, positives=2, negatives=9, low=50, scale=7)
    want = brute(rows, lambda i: i % 20 == 0, 2, 9, 50, 7)
    assert got == want


def test_no_rows_no_anchors_one_label(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(spark, [(10, [1.0], 1), (20, [1.0], 1)]) == []
    assert run(spark, [(10, [1.0], 1), (2, [1.0], 2)]) == []


def test_node_pairs_are_pruned():
    rng = np.random.default_rng(1)
    v = (rng.integers(0, 2, (4000, 1)) * 2 - 1) * 200 + rng.integers(-3, 4, (4000, 16))
    side = []
    for part in (v[:200], v):
        row = np.arange(len(part))
        _, columns = negatives._tree_columns(row, row, row * 0, part)
        side.append(negatives.Side(dict(zip(negatives.Side.NAMES, columns)).__getitem__))
    a, b = side
    a.low, a.high = np.full((200, 1), 300_000), np.full((200, 1), 10**9)
    x, y, _ = negatives._pairs(a, b)
    leaves = (a.left == 0).sum() * (b.left == 0).sum()
    assert 0 < len(x) <= 0.6 * leaves


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + (r.vec_id % 7 == 0)) % 10) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(map(tuple, registry.op13_hard_negatives(spark, sf_dir).collect()), key=str)
    assert got == brute(rows, lambda i: i % 100 == 0) and len(got) > 50


def test_trees_are_not_broadcast(spark, monkeypatch):
    """Trees have a row for each slot, so a broadcast would send many times the anchors to the driver."""
    plans, save = [], negatives.Scratch.save

    def seen(self, df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return save(self, df)

    monkeypatch.setattr(negatives.Scratch, "save", seen)
    monkeypatch.setattr(negatives, "BLOCK", 50)
    assert run(spark, clustered(3, 300, 6))
    found = [p for columns, p in plans if columns[:2] == ["anchor", "part"]]
    assert len(found) == 2 and all("Join" in p and "BroadcastExchange" not in p for p in found)
