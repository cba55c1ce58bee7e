"""Semi-specific products against a loop, without a shuffle of products."""

from __future__ import annotations

import random

import pytest

from massif.operators import sequence as S


def plain(seq, missed, least):
    n = len(seq)
    sites = sorted({0, n, *(i for i in range(1, n) if seq[i - 1] in "KR" and seq[i] != "P")})
    out = set()
    for i, a in enumerate(sites):
        for b in sites[i + 1 : i + 2 + missed]:
            out |= {(a + 1, e) for e in range(a + 1, b + 1)} | {(s, b) for s in range(a + 1, b + 1)}
    return {(s, e, seq[s - 1 : e]) for s, e in out if e - s + 1 >= least}


@pytest.mark.parametrize(("missed", "least"), [(0, 1), (0, 3), (2, 4), (1, 7)])
def test_semi_products_are_those_of_a_loop(spark, missed, least):
    rng = random.Random(missed)
    rows = [(k, "".join(rng.choice("AKRPM") for _ in range(rng.randrange(0, 25)))) for k in range(40)] + [(50, "K"), (51, "KKKK"), (52, "MAAA"), (53, None)]
    # a row that comes twice is one row
    out = S.digest_semi(spark.createDataFrame(rows + rows[:5], "k long, s string"), "s", "KR", "P", missed, least)
    got = [(r.k, r.start, r.end, r.peptide) for r in out.collect()]
    assert sorted(got) == sorted((k, *p) for k, s in rows if s for p in plain(s, missed, least))
    # what is made distinct are the rows given, before they spread to products
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and "Union" not in plan
