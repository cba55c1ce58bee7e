"""The n-gram Jaccard join against all pairs: near copies round the threshold, boilerplate, hot copies, and clashing columns."""

from __future__ import annotations

import random
import re

import pytest

from massif.llm import jaccard, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width=5, least=80):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and label[i] != label[j] and 100 * len(a & sets[j]) >= least * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = {}
    for (i, _), x in zip(rows, label):
        ids.setdefault(x, []).append(i)
    first = {x: min((i for i in v if i is not None), default=None) for x, v in ids.items()}
    return sorted(((i, len(s), first[x]) for (i, _), s, x in zip(rows, sets, label)), key=str)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = [None, "", " \n", "One", "one", "one two", "One two three four", "one two three four five", "x " * 60, "x " * 90, "É é ß"]
    for size in (12, 40, 150):
        base = say(size)
        out += [" ".join(base), " ".join(base).upper(), "\t ".join(base)] + [edited(rng, base, k % 5) for k in range(12)]
        # shorter and longer ones round four fifths
        out += [" ".join(base[: size * k // 100]) for k in (78, 79, 80, 81, 82, 90)] + [" ".join(base + say(size * k // 100)) for k in (20, 24, 25, 26)]
    # a crowd of near copies of one text, and of texts that are boilerplate for the most part
    base, plate = say(100), say(80)
    out += [edited(rng, base, rng.randint(1, 7)) for _ in range(90)]
    out += [" ".join(say(rng.randint(5, 40)) + plate + say(rng.randint(0, 12))) for _ in range(60)]
    out += [" ".join(plate + say(200)) for _ in range(40)]
    out += [out[30]] * 25
    rows = [(1000 - 7 * i, t) for i, t in enumerate(out)]
    return rows + [(None, out[35]), (None, "no id at all here today"), (4, "x y"), (4, "z z z")]


@pytest.mark.parametrize(("width", "least", "full"), [(5, 80, 16), (2, 60, 3)])
def test_components(spark, monkeypatch, width, least, full):
    monkeypatch.setattr(jaccard, "FULL", full)
    rows = corpus(full)
    df = spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], "doc_id long, text string, token string, node int, n int, th int").repartition(3)
    got = jaccard.near_components(df, width=width, least=least).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width, least)


def test_tables_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 0)
    monkeypatch.setattr(jaccard, "FULL", 3)
    rows = corpus(5)
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table_and_text_ids(spark):
    assert jaccard.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = jaccard.near_components(spark.createDataFrame([("b", "p q r s t u"), ("a", "P q r s t u"), ("c", None)], "doc_id string, text string")).collect()
    assert sorted(map(tuple, got)) == [("a", 2, "a"), ("b", 2, "a"), ("c", 0, "c")]
    with pytest.raises(ValueError, match="least"):
        jaccard.near_components(spark.createDataFrame([], "doc_id long, text string"), least=40)


def test_long_texts(spark):
    rng = random.Random(8)
    w = [f"w{rng.randrange(10**6)}" for _ in range(60000)]
    rows = [(2, " ".join(w)), (1, edited(rng, w, 1200)), (3, edited(rng, w, 1500)), (0, " ".join(w[:46000]))]
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op12_jaccard_join(spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
