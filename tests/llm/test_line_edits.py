"""The line query links lines of 24 characters and more by two edits, those of 12 and more by one."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from massif.llm import lines, registry


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def near(a, b):
    n = min(len(a), len(b))
    return a == b or n >= 12 and distance(a, b) <= (2 if n >= 24 else 1)


def test_line_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    forms = []
    for n in (8, 11, 12, 13, 22, 23, 24, 25, 26, 40, 70):
        for _ in range(3):
            a = "".join(rng.choice("abcdefg") for _ in range(n))
            forms.append(a)
            for edits in (1, 2, 3):
                b = list(a)
                for _ in range(edits):
                    k = rng.randrange(len(b))
                    rng.choice([lambda: b.__setitem__(k, "z"), lambda: b.insert(k, "z"), lambda: b.pop(k)])()
                forms.append("".join(b))
    forms += ["Printed on 12 March, page one", "Printed on 27 March, page one"]
    rng.shuffle(forms)
    docs = [(k, "\n".join(forms[k * 5 : k * 5 + 5])) for k in range(-(-len(forms) // 5))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    label = list(range(len(forms)))
    for a in range(len(forms)):
        for b in range(a):
            if label[a] != label[b] and near(forms[a], forms[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    want = sorted((k // 5, k % 5, m // 5, m % 5, k == m) for k, m in enumerate(label))
    assert sorted(tuple(r) for r in registry.op3_line_dedup(spark, str(tmp_path)).collect()) == want


def test_an_edit_changes_few_parities(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        a = [rng.choice("abc é🙂") for _ in range(rng.randint(0, 30))]
        b = list(a)
        k = rng.randrange(len(b) + 1)
        if b and rng.random() < 0.6:
            k = min(k, len(b) - 1)
            b[k : k + 1] = rng.choice([[], ["z"]])
        else:
            b.insert(k, rng.choice("ab "))
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", lines.parities(F.col("x")).alias("m"), lines.parities(F.col("y")).alias("n"))
    mask = (1 << 64) - 1
    for r in df.collect():
        assert ((r.m.letters ^ r.n.letters) & mask).bit_count() <= lines.LETTERS_CHANGED and ((r.m.pairs ^ r.n.pairs) & mask).bit_count() <= lines.PAIRS_CHANGED
    swapped = spark.createDataFrame([("north wind east rain over the hill", "east rain north wind over hill the")], "x string, y string")
    m, n = swapped.select(lines.parities(F.col("x")).alias("m"), lines.parities(F.col("y")).alias("n")).first()
    assert m.letters == n.letters and ((m.pairs ^ n.pairs) & mask).bit_count() > 2
