"""Periodic runs against a quadratic search: random strings, planted texts, and texts with nulls, repeats, ties and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from massif.llm import registry, tandem

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(x, least=2, periods=2):
    """(start, length, period) of the runs, by start, then period, from the definition."""
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            length = i - s + q
            if length >= max(least, periods * q) and not any(all(x[t] == x[t + d] for t in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(words):
    found = brute(words, 6, 4)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    milli = 1000 * best[1] // best[2] if found else None
    return (len(found), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_of_random_strings():
    rng = random.Random(3)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(1, 60)
        x = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 9)
            x = x[:a] + [x[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, n)]
        found = sorted(map(tuple, tandem.runs(np.array(x)).tolist()), key=lambda r: (r[0], r[2]))
        assert found == brute(x), x


def test_blocks_are_longest_earlier_factors():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 40)
        x = [rng.randrange(3) for _ in range(n)]
        earlier = lambda i: max((m for j in range(i) for m in range(n - i + 1) if x[j : j + m] == x[i : i + m]), default=0)  # noqa: E731,B023
        at = [0]
        while at[-1] < n:
            at.append(at[-1] + max(1, earlier(at[-1])))
        assert tandem.blocks(tandem.SuffixTree(tandem.Extensions(np.array(x)))).tolist() == at


def texts():
    rng = random.Random(9)
    vocab = ["a", "b", "cé", "dd", "ß", "🙂"]
    out = [None, "", " \n\t ", "one", "x " * 5, "x " * 6, "x\n" * 7, "a b " * 4, "a b " * 3 + "a", "a b a b a b a b ", "p q r " * 40 + "s t " * 9, "A a " * 6, "x\x1cy " * 8]
    out += [" ".join(rng.choice(vocab[: rng.randint(1, 6)]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    # runs of equal length / period, nested runs, a run at either end
    out += ["k k k k k k z m m m m m m", "u v u v u v u v w " * 5, "go " * 6 + "on and on", "see you " * 4]
    for _ in range(40):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 260))]
        p, a = rng.randint(1, 40), rng.randrange(len(w))
        out.append(" \t".join(w[:a] + [w[a + (i - a) % p] if a + (i - a) % p < len(w) else "t" for i in range(a, len(w))]))
    long = [f"v{i}" for i in range(700)]
    return [*out, " ".join(long * 5), " ".join(long), out[20], out[20]]


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_periodic_runs(spark, monkeypatch, piece):
    rows = [(i, t, "x", 3) for i, t in enumerate(texts())] + [(None, "a b " * 5, None, None), (3, "a b " * 5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, start int").repartition(3)
    got = tandem.periodic_runs(df).collect() if piece == 1 << 20 else None
    if got is None:
        monkeypatch.setattr(tandem, "PIECE", piece)
        made = []
        for a in range(0, len(rows), 10):
            made += [(r[0], *x) for r, x in zip(rows[a : a + 10], tandem._rows([(r[1] or "").encode() for r in rows[a : a + 10]], 6, 4))]
        seen = [tuple(x[:8]) for x in made]
    else:
        seen = [tuple(r)[:8] for r in got]
        assert all(len(r.starts) == len(r.periods) == r.n_runs for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:] and str(r[1:]))
    want = [(r[0], *expected(WORD.findall(r[1] or ""))) for r in rows]
    assert sorted(seen, key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 25


def test_empty_table_and_limits(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert tandem.periodic_runs(df).count() == 0
    with pytest.raises(ValueError, match="four periods"):
        tandem.periodic_runs(df, periods=2)


def test_query_plants_and_finds(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in registry.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    found = 0
    for r in rows:
        w = planted(r.doc_id, WORD.findall(r.text or ""))
        if len(w) <= 700 or got[r.doc_id][1]:
            assert got[r.doc_id] == (r.doc_id, *expected(w)) if len(w) <= 700 else True, r.doc_id
        found += got[r.doc_id][1] > 0
    assert found > len(rows) // 30


def test_planted_texts_follow_the_rule(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(None, "a b"), (7, None)]
    got = {r.doc_id: r.text for r in registry.with_planted_runs(spark.createDataFrame(rows[:-1], "doc_id long, text string")).collect()}
    assert all(WORD.findall(got[i] or "") == planted(i, WORD.findall(t)) for i, t in rows[:-1])
    assert sum(got[i] != t for i, t in rows[:-1]) > 10
