"""The pipeline on null and repeated ids, its run() against brute force, and the packing query's added tokens."""

from __future__ import annotations

import hashlib
import random
import re
import shutil
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from massif.llm import mixing, quality, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def say(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_kept(rows):
    """Of (id, source, text) rows, in their order, one of each component: the smallest id, null last."""
    fps = [fingerprint(t) for _, _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    first = {}
    for r, k in zip(rows, label):
        at = (r[0] is None, r[0] or 0)
        if k not in first or at < first[k][0]:
            first[k] = (at, r)
    return [r for _, r in first.values()]


def mixed(rows):
    """Of (id, source, text) rows the (id, text) that the mix makes; rows of one source must have different ids."""
    found = {}
    for _, source, text in rows:
        found[source] = found.get(source, 0) + len(WORD.findall(text or ""))
    names = sorted(found, key=lambda x: (x is None, x or ""))
    sizes = [found[x] for x in names]
    goal = mixing.targets(sizes)
    blocks = [-(-n // mixing.BLOCK_WORDS) for n in sizes]
    expected = np.array([t * b / n if n else 0.0 for t, b, n in zip(goal, blocks, sizes)])
    slots = max(int(round(expected.sum())), 1)
    share = expected / expected.sum()
    taken = [Counter() for _ in names]
    used = [0] * len(names)
    for shard in range(-(-slots // mixing.SHARD_SLOTS)):
        size = min(mixing.SHARD_SLOTS, slots - shard * mixing.SHARD_SLOTS)
        whole = np.floor(share * size)
        rest = share * size - whole
        n = whole.astype(int)
        if rest.sum() > 0:
            n = n + np.random.default_rng([mixing.SEED, shard]).multinomial(size - int(whole.sum()), rest / rest.sum())
        for k in range(len(names)):
            for rank in range(used[k], min(used[k] + int(n[k]), 3 * blocks[k])):
                turn, at = divmod(rank, blocks[k])
                taken[k][int(mixing.permuted(np.array([at]), blocks[k], (mixing.SEED * 1_000_003 + k) * 4 + turn)[0])] += 1
            used[k] += int(n[k])
    out = []
    for k, name in enumerate(names):
        at = 0
        for i, _, text in sorted((r for r in rows if r[1] == name), key=lambda r: (r[0] is not None, r[0] or 0)):
            w = [m.span() for m in WORD.finditer(text or "")]
            times = [taken[k][(at + j) // mixing.BLOCK_WORDS] for j in range(len(w))]
            at += len(w)
            copies = []
            for turn in (1, 2, 3):
                runs = [[j for j in range(len(w)) if times[j] >= turn]]
                if len(runs[0]) == len(w) and w:
                    copies.append(text)
                    continue
                parts, last = [], None
                for j in runs[0]:
                    if last is not None and j == last + 1:
                        parts[-1][1] = j
                    else:
                        parts.append([j, j])
                    last = j
                if parts:
                    copies.append("\n".join(text[w[a][0] : w[b][1]] for a, b in parts))
            if copies:
                out.append((i, "\n".join(copies)))
    return out


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def packed(rows):
    """Counter of (id, ids) of the documents in the pieces of a packing."""
    stream, out, current = sorted(rows, key=lambda r: (r.sequence_id, r.offset)), Counter(), []
    for r in stream:
        assert r.start == len(current)
        current += np.frombuffer(r.ids, "<u2").tolist()
        if len(current) == r.doc_tokens:
            out[r.doc_id, tuple(current)] += 1
            current = []
    return out


FIXTURE = [
    (1, "a", say(1, 300)), (2, "a", say(2, 300)), (3, "b", say(3, 200)), (None, "a", say(4, 150)), (None, "b", say(5, 80)), (9, "a", say(6, 400)), (9, "b", say(7, 20)),
    # the second row of id 2 is a near copy of id 1, its first stands alone; the last is a near copy without an id
    (2, "b", say(1, 300) + " "), (None, "c", say(3, 200).upper()),
]


def test_stages_tell_rows_apart(spark, sf_dir):
    docs = spark.createDataFrame([(i, t, s, len(t)) for i, s, t in FIXTURE], "doc_id long, text string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.simhash_near_dedup(spark, docs, sf_dir).collect()
    kept = near_kept(FIXTURE)
    assert len(kept) == 7 and Counter((r.doc_id, r.source, r.text) for r in out) == Counter(kept)
    rows = [r for r in FIXTURE if r in kept]
    again = spark.createDataFrame([(i, t, s, len(t)) for i, s, t in rows], docs.schema).repartition(3)
    made = corpus_pipeline.source_mixing(spark, again, sf_dir).collect()
    assert Counter((r.doc_id, r.text) for r in made) == Counter(mixed(rows))
    assert {None, 9} <= {r.doc_id for r in made} and all(r.n_chars == len(r.text) for r in made)


def test_run_against_brute_force(spark, sf_dir, tmp_path, encoder):
    shutil.copy(f"{sf_dir}/labels.parquet", tmp_path)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = given.agg(F.max("doc_id")).first()[0]
    extra = given.where("source IS NOT NULL").orderBy("doc_id").limit(6)
    # copies of known good texts under null and repeated ids, a literal added token among them
    odd = extra.withColumn("text", F.concat(F.reverse("text"), F.lit(" <|endoftext|> end"))).withColumn("source", F.concat(F.lit("odd"), F.col("doc_id").cast("string")))
    odd = odd.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.lit(top + 1)).cast(given.schema["doc_id"].dataType))
    given.unionByName(odd).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = [(r.doc_id, r.source, r.text) for r in quality.score(docs, model, "text").where("predicted = 1").collect()]
    assert None in {i for i, _, _ in good}
    by_text = {}
    for r in sorted(good, key=lambda r: (r[0] is None, r[0] or 0)):
        by_text.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r[2] or "").encode()).hexdigest(), r)
    want = Counter((i, (*encoder.encode(t, add_special_tokens=False).ids, 1)) for i, t in mixed(near_kept(list(by_text.values()))))
    assert packed(corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_packing_query_knows_added_tokens(spark, tmp_path, encoder):
    texts = [(1, "<|endoftext|> it's 123\n\n x"), (2, "a  <|endoftext|>\n b<|endoftext|><|endoftext|>"), (3, "<|endoftext| >"), (4, None), (None, "plain  ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((i, len(encoder.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in texts)
    assert Counter((r.doc_id, r.doc_tokens) for r in registry.op7_packing(spark, str(tmp_path)).collect()) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = Counter((i, (*encoder.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in texts)
    assert packed(corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()) == want
