"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from massif.llm import components, exact, hmm, licenses, lines, mixing, packing, phrases, quality, rules, simhash
from massif.llm.words import pieces
from massif.runtime import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, kept string, id int, _norm int, block int, node int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéüß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = say(60), say(12)
    out = [None, "", "   ", "\n\t", "one", "One", "one two three", "x " * 80, "x " * 79, passage, passage + " " + say(50), say(20) + "\n" + passage + " tail", say(5000)]
    for _ in range(40):
        out.append(say(rng.randint(1, 200)))
    near = say(150).split()
    for i in range(12):
        w = list(near)
        w[i * 7 % 150] = "changed"
        out.append(" ".join(w))
    out += [line, line[:-1], line + "s", "A\n" + line + "\nB", line + "\n" + line]
    out += [out[20], out[20].replace(" ", "  ", 1), out[20], out[21] + " 🙂 　 x", "Licensed under the Apache License, Version 2.0.\nmore. Released under the\nMIT License."]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t or ""), 1, "k", 2, 3, 4, 5) for i, t in enumerate(texts())]
    rows += [rows[-1], rows[-1], (None, "no id", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(table):
    return [(r.doc_id, r.text) for r in table.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_kernel_agrees_with_the_pattern(docs):
    import pyarrow as pa

    column = pa.array([t for _, t in docs])
    found, seen = [], {}
    for a, b, w in pieces(column, most=300):
        h = w.hashes()
        for i in range(b - a):
            found.append([w.text(k).decode() for k in range(w.first[i], w.first[i + 1])])
        for k in range(len(h)):
            seen.setdefault(w.text(k), set()).add(int(h[k]))
    assert found == [words(t) for _, t in docs]
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


@pytest.mark.parametrize("limit", [1000, 1])
def test_exact_dedup(table, docs, empty, monkeypatch, limit):
    monkeypatch.setattr(exact, "MIN_HOT_ROWS", limit)
    out = exact.exact_dedup(table).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in docs:
        groups.setdefault(norm(t), []).append(i)
    assert len(out) == len(docs) and set(out[0].asDict()) >= {"lang", "score", "keep_id"}
    for r in out:
        ids = groups[norm(r.text)]
        real = [i for i in ids if i is not None]
        assert r.keep_id == (min(real) if real else None) and r.group_size == len(ids)
        assert r.text_sha256 == hashlib.sha256(norm(r.text).encode()).hexdigest()
    assert sum(r.kept for r in out) == len(groups)
    assert exact.exact_dedup(empty).count() == 0


def brute_fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_decoding_and_keys():
    rng = np.random.default_rng(3)
    decoder = simhash._decoder()
    messages = np.arange(4096, dtype=np.int64) << 11
    codewords = messages | simhash._syndromes(messages)
    assert (simhash.golay_index(codewords, decoder) == np.arange(4096)).all()
    for k in range(1, 4):
        e = np.zeros(4096, dtype=np.int64)
        for _ in range(k):
            e |= 1 << rng.integers(0, 23, 4096)
        assert (simhash.golay_index(codewords ^ e, decoder) == np.arange(4096)).all()
    f = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    g = f.copy()
    for _ in range(4):
        g ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    keys = []
    for x in (f, g):
        at, k = simhash.golay_keys(x)
        keys.append([set(k[at == i].tolist()) for i in range(500)])
    assert all(a & b for a, b in zip(*keys))
    # a full bucket's split keeps every pair of at most four bits together, whatever the pair of segments
    for pair in range(3):
        split = []
        for x in (f, g):
            at, k = simhash.third_codewords(x, np.full(500, pair << 24))
            split.append([set(k[at == i].tolist()) for i in range(500)])
        assert all(a & b for a, b in zip(*split))


@pytest.mark.parametrize("full", [64, 1])
def test_near_dedup(table, docs, empty, monkeypatch, full):
    monkeypatch.setattr(components, "FULL", full)
    out = simhash.near_dedup(table).collect()
    rows = [(i, brute_fingerprint(t)) for i, t in docs]
    assert Counter((r.id, r.fingerprint) for r in out) == Counter((i, f"{f:016x}") for i, f in rows)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for (i, _), k in zip(rows, label):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    want = {(i, f"{f:016x}"): least.get(k) for (i, f), k in zip(rows, label)}
    assert all(r.component_id == want[r.id, r.fingerprint] for r in out)
    assert simhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize("full", [64, 1])
def test_buckets_alone_find_all_links(spark, monkeypatch, full):
    """Without rounds over representatives each link comes from its bucket, split or not."""
    monkeypatch.setattr(components, "FULL", full)
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for x in base for _ in range(6)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = spark.createDataFrame([(signed(x),) for x in fps], "fp long").mapInArrow(simhash._keys, "key long, node long")
    near = lambda pairs: pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 4).distinct()
    split = lambda full: full.mapInArrow(simhash._split, "key long, node long, label long, mark long")
    got = {(r.node, r.label) for r in components.linked_components(keys, near, Scratch(spark, "test"), split, rounds=0).collect()}
    label = {x: signed(x) for x in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    linked = {x for x in fps if any(x != y and (x ^ y).bit_count() <= 4 for y in fps)}
    assert got == {(signed(x), label[x]) for x in linked}


def test_remove_repeats(table, docs, empty):
    out = phrases.remove_repeats(table).collect()
    counts = Counter(tuple(w[i : i + 35]) for _, t in docs for w in [words(t)] for i in range(len(w) - 34))
    want = Counter()
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if counts[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    assert Counter((r.id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in out) == want
    assert any(r.n_removed for r in out) and phrases.remove_repeats(empty).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def line_classes(found, edits):
    """{(id, line_no): (that of the class, kept)} of {(id, line_no): form}; lines of any length link."""
    forms = sorted(set(found.values()))
    label = {f: f for f in forms}
    for i, a in enumerate(forms):
        for b in forms[:i]:
            if label[a] != label[b] and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                old, new = label[a], label[b]
                label = {f: new if k == old else k for f, k in label.items()}
    head = {}
    for at in sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        head.setdefault(label[found[at]], at)
    return {at: (head[label[f]], head[label[f]] == at) for at, f in found.items()}


def line_table(rng):
    """Lines of all lengths from one character on, each with copies of up to three edits, in 80 texts with a null and an empty one."""
    out = []
    for n in (1, 2, 3, 5, 8, 13, 24, 40, 90):
        for _ in range(4):
            a = "".join(rng.choice("abcde 🙂é") for _ in range(n))
            out.append(a)
            for edits in (1, 2, 3):
                b = list(a)
                for _ in range(edits):
                    k = rng.randrange(max(len(b), 1))
                    rng.choice([lambda: b.__setitem__(slice(k, k + 1), "z"), lambda: b.insert(k, "z"), lambda: b.__setitem__(slice(k, k + 1), "")])()
                out.append("".join(b))
    out += [f"row {k:03d} of a long and quite usual table, as printed" for k in range(0, 1000, 13)] + out[:20]
    rng.shuffle(out)
    return [(0, None), (1, ""), (2, out[0]), (2, out[1]), (None, out[2]), *[(i + 3, "\n".join(out[4 * i : 4 * i + 4])) for i in range(len(out) // 4)]]


@pytest.mark.parametrize(("edits", "full"), [(1, 64), (2, 64), (2, 3)])
def test_line_dedup(spark, empty, monkeypatch, edits, full):
    monkeypatch.setattr(components, "FULL", full)
    rows = line_table(random.Random(edits))
    form = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ")
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("x")).withColumn("node", F.lit(1)).repartition(3), edits=edits)
    want = Counter()
    # rows that share an id count as one document
    want_classes = line_classes({(i, k): form(x) for i, t in rows if i != 2 for k, x in enumerate((t or "").split("\n")) if form(x)} | {(2, -k): form(t) for k, t in enumerate(x for i, x in rows if i == 2)}, edits)
    for (i, k), (at, kept) in want_classes.items():
        want[i, max(k, 0), at[0], max(at[1], 0), kept or (i, max(k, 0)) == (at[0], max(at[1], 0))] += 1
    assert Counter(tuple(r) for r in got.collect()) == want
    assert lines.line_dedup(empty, edits=edits).count() == 0


def test_bit_parallel_distance(spark):
    rng = random.Random(6)
    pairs = [("", ""), ("", "a"), ("abc", ""), ("a" * 500, "a" * 250 + "b" + "a" * 249), ("🙂é", "é🙂")]
    for _ in range(300):
        a = "".join(rng.choice("ab🙂") for _ in range(rng.randint(0, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b) + 1)
            rng.choice([lambda: b.__setitem__(slice(k, k + 1), "c"), lambda: b.insert(k, "a"), lambda: b.__setitem__(slice(k, k + 1), "")])()
        pairs += [(a, "".join(b)), ("".join(b), a)]
    for edits in (1, 2, 3):
        df = spark.createDataFrame(pairs, "x string, y string").withColumn("distance", lines.edit_distance(F.col("x"), F.col("y"), edits))
        for r in df.collect():
            d = distance(r.x, r.y)
            assert r.distance == d if d <= edits else r.distance > edits, (r, d)


def test_probes_meet_all_near_pairs(spark):
    rng = random.Random(2)
    pairs = []
    for i in range(60):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
        b = list(a)
        for _ in range(2):
            k = rng.randrange(len(b) + 1)
            rng.choice([lambda: b.__setitem__(slice(k, k + 1), "z"), lambda: b.insert(k, "z"), lambda: b.__setitem__(slice(k, k + 1), "")])()
        pairs += [(2 * i, a), (2 * i + 1, "".join(b))]
    df = spark.createDataFrame(pairs, "n int, line string").withColumn("chars", F.char_length("line"))
    for found in (F.concat(*[lines.probe_keys(part, 2) for part in range(3)]), lines.run_keys(2)):
        keys = {r.n: {*r.k} - {None} for r in df.select("n", found.alias("k")).collect()}
        assert all(keys[2 * i] & keys[2 * i + 1] for i in range(60))


def test_mixing(table, docs, empty):
    out = mixing.mix(table, block_words=8, shard_slots=64)
    rows = out.collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(table, block_words=8, shard_slots=64).collect()))
    assert len(rows) == len(docs) and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert Counter((r.id, r.size) for r in rows) == Counter((i, len(words(t))) for i, t in docs)
    source = {i: (k, None) for i, k in ((None, None), *((i, None if i % 9 == 0 else f"s{i % 4}") for i, _ in docs if i is not None))}
    by = {}
    for r in rows:
        by.setdefault(source[r.id][0], []).append(r)
    total = sum(len(words(t)) for _, t in docs)
    assert math.isclose(sum(x[0].target for x in by.values()), total, rel_tol=1e-9)
    for x in by.values():
        size, target = sum(r.size for r in x), x[0].target
        assert {(r.source_size, r.target) for r in x} == {(size, target)} and target <= 3 * size
        assert abs(sum(r.taken for r in x) - target) < 0.05 * target + 32
    assert mixing.mix(empty).count() == 0
    assert mixing.targets([100, 100, 100]) == [187.5, 75.0, 37.5] and mixing.targets([10, 100, 100]) == pytest.approx([30.0, 120.0, 60.0])
    unique = table.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    taken = mixing.mix(unique, block_words=8)
    by_id = {r.id: r.taken for r in taken.collect()}
    made = mixing.realise(unique, taken).collect()
    assert {r.doc_id for r in made} == {i for i, n in by_id.items() if n}
    assert all(len(words(r.text)) == by_id[r.doc_id] and r.n_chars == len(r.text) for r in made)


def test_mixed_texts_are_cut_as_word_by_word(spark):
    rng = random.Random(5)
    rows, taken, want = [], [], {}
    for k in range(120):
        parts = [(rng.choice(["a", "éç", "日本", "x😀"]), rng.choice([" ", "\n ", "\t", "  "])) for _ in range(rng.choice([0, 1, 3, 64, 65, 700]))]
        text = rng.choice(["", " "]) + "".join(w + gap for w, gap in parts)
        found = [m.span() for m in re.finditer("[^\\x20\\x09-\\x0D]+", text)]
        spans, at = [], 0
        while at < len(found):
            n = min(rng.randint(1, 64), len(found) - at)
            spans.append((at, n, rng.randint(0, 3) if k % 2 else k % 4))
            at += n
        rows.append((k, text if parts else None))
        taken.append((k, sum(n * times for _, n, times in spans), spans))
        copies = []
        for turn in (1, 2, 3):
            on = sorted(i for first, n, times in spans if times >= turn for i in range(first, first + n))
            out = "".join((text[found[j - 1][1] : found[j][0]] if j - 1 == i else "\n") * (i is not None) + text[slice(*found[j])] for i, j in zip([None, *on], on))
            if on:
                copies.append(text if len(on) == len(found) else out)
        if copies:
            want[k] = "\n".join(copies)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mixed = spark.createDataFrame(taken, "id long, taken long, spans array<struct<start:long,words:long,times:long>>")
    assert {r.doc_id: r.text for r in mixing.realise(df, mixed).collect()} == want
    assert mixing.realise(df.limit(0), mixed).count() == 0


def test_mixing_agrees_however_rows_are_dealt(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(n))
    big = (1 << 60) + 1
    rows = [(rng.choice([None, big, big + 1, 7, 8]), say(rng.randint(1, 60)), rng.choice(["a", "b", None])) for _ in range(300)]
    seen = []
    for parts in (1, 5):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        out = mixing.mix(df, block_words=8, shard_slots=64).collect()
        assert {r.id for r in out} == {r[0] for r in rows}
        seen.append(Counter((r.id, r.size, r.source_size, r.taken) for r in out))
    assert seen[0] == seen[1]


def test_permutations_cover_their_range():
    for n in (1, 2, 3, 17, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9)) == list(range(n))


def test_packing(table, docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in [*docs, (7777, "<|endoftext|> it's 123\n\n x")]]
    extra = table.sparkSession.createDataFrame([(7777, "<|endoftext|> it's 123\n\n x")], "doc_id long, text string")
    rows = packing.pack(table.select("doc_id", "text").unionByName(extra), P.path("byte_bpe_50k.json"), P.PATTERN, sequence=64).collect()
    stream = {}
    for r in rows:
        piece = np.frombuffer(r.ids, "<u2")
        assert len(piece) == r.length and zlib.crc32(piece.astype("<u4").tobytes()) == r.ids_crc32
        stream.setdefault(r.sequence_id, {})[r.offset] = (r.id, r.start, piece.tolist(), r.doc_tokens)
    whole, at = [], []
    for s in range(max(stream) + 1):
        n = 0
        for offset in sorted(stream[s]):
            assert offset == n
            n += len(stream[s][offset][2])
            whole.append(stream[s][offset])
        assert n == 64 or s == max(stream)
    docs_back = Counter()
    current = []
    for i, start, piece, total in whole:
        assert start == len(current)
        current += piece
        if len(current) == total:
            docs_back[i, tuple(current)] += 1
            current = []
    assert docs_back == Counter((i, tuple(x)) for i, x in ids) and not current and not at
    assert packing.pack(empty, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_quality_rules(table, docs, empty, spark):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (4, 0), (4, 1)], "doc_id long, quality int")
    out = rules.judge(table, labels).collect()

    def brute(t):
        w = words(t)
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        own = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(own) - len(set(own)), len(covered)

    want = Counter((i, *brute(t)) for i, t in docs)
    assert Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.base_failed or not r.kept) for r in out)
    assert rules.judge(empty, labels).count() == 0


def test_binomial_bound_is_exact():
    assert rules.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    p = rules.binomial_upper(3, 50, 0.01)
    assert sum(math.comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) == pytest.approx(0.01, abs=1e-6)


def test_rule_risk_holds(spark):
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    good = [(i, say(30) + (" #" * 3 if i % 500 == 0 else "")) for i in range(3000)]
    bad = [(3000 + i, " ".join(w + "%%" for w in say(30).split())) for i in range(200)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3200)], "doc_id long, quality int")
    out = {r.id: r for r in rules.judge(df, labels).collect()}
    assert sum(not out[i].kept for i in range(3000)) <= 0.01 * 3000 and not any(out[i].kept for i in range(3000, 3200))


def test_rules_together_keep_the_risk():
    # each rule alone loses little; together they lose more, and only their union counts
    rng = np.random.default_rng(2)
    shape = np.array([0.35, 0.4, 0.5, 0.6])
    draw = lambda k: np.minimum(rng.geometric(1 - shape, (k, 4)) - 1, len(rules.GRID))
    future = draw(100_000)
    risks = []
    for _ in range(120):
        x = draw(2000)
        steps = rules.admitted(x, rng.random(2000) < 0.5, np.ones(2000, dtype=int), 0.05)
        risks.append((future + steps > len(rules.GRID)).any(axis=1).mean())
    assert np.mean(np.array(risks) > rules.RISK) <= 0.08 and np.median(risks) > 0
    assert not rules.admitted(draw(200), np.arange(200) % 2 == 0, np.ones(200, dtype=int), 0.05).any()


def test_quality_classifier(spark, empty):
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, say(rng.randint(20, 90)) if i % 3 else " ".join(w.upper() + "!!" for w in say(30).split())) for i in range(900)]
    df = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(900)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    out = quality.score(df, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted").collect()
    assert len(out) == 902 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.98
    nothing = quality.fit(df, labels.limit(0))
    assert {r.score for r in quality.score(df, nothing).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_forward_recursion_and_expected_counts():
    rng = np.random.default_rng(0)
    n = 12
    model = hmm.maximised(rng.gamma(1, 1, hmm.STATES + hmm.STATES**2 + hmm.STATES * n), n)
    symbols, at = rng.integers(0, n, 40), np.array([0, 5, 5 + 1, 40])
    got = model.log10_likelihood(symbols, at)
    for i in range(3):
        a = model.begin * model.emit[symbols[at[i]]]
        for s in symbols[at[i] + 1 : at[i + 1]]:
            a = (a @ model.step) * model.emit[s]
        assert got[i] == pytest.approx(np.log10(a.sum()), abs=1e-9)
    e = hmm.Expected(model)
    e.add(symbols, at)
    assert e.emit.sum() == pytest.approx(40, rel=1e-4) and e.begin.sum() == pytest.approx(3, rel=1e-4) and e.step.sum() == pytest.approx(37, rel=1e-4)
    again = hmm.Expected(model)
    after = hmm.maximised(e.values(), n)
    again.add(symbols, at)
    assert after.log10_likelihood(symbols, at).sum() > got.sum()


@pytest.mark.parametrize("cells", [1 << 18, 50])
def test_expected_counts_of_whole_texts(monkeypatch, cells):
    monkeypatch.setattr(hmm, "CELLS", cells)
    rng = np.random.default_rng(1)
    n = 9
    model = hmm.maximised(rng.gamma(1, 1, hmm.STATES + hmm.STATES**2 + hmm.STATES * n), n)
    at = np.cumsum([0, 400, 1, 130, 129, 7])
    symbols = rng.integers(0, n, at[-1])
    begin, step, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.STATES, n))
    for lo, hi in zip(at, at[1:]):
        e = model.emit[symbols[lo:hi]]
        alpha, beta = [model.begin * e[0]], [np.ones(hmm.STATES)]
        alpha[0] = alpha[0] / alpha[0].sum()
        for x in e[1:]:
            a = (alpha[-1] @ model.step) * x
            alpha.append(a / a.sum())
        for x in e[:0:-1]:
            b = model.step @ (x * beta[0])
            beta.insert(0, b / b.sum())
        gamma = np.array(alpha) * np.array(beta)
        gamma /= gamma.sum(axis=1, keepdims=True)
        begin += gamma[0]
        for t in range(hi - lo):
            emit[:, symbols[lo + t]] += gamma[t]
            if t:
                xi = alpha[t - 1][:, None] * model.step * (e[t] * beta[t])
                step += xi / xi.sum()
    got = hmm.Expected(model)
    got.add(symbols, at)
    for x, y in ((got.begin, begin), (got.step, step), (got.emit, emit)):
        assert np.allclose(x, y, rtol=1e-3, atol=1e-3)


def test_language_model(table, docs, empty, monkeypatch):
    for name, value in (("SYMBOLS", 40), ("COUNTED", 120), ("START_ROUNDS", 2), ("ROUNDS", 1)):
        monkeypatch.setattr(hmm, name, value)
    out = hmm.score(table).collect()
    tokens = [(i, [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\0"]) for i, t in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, w in tokens if not held(i) for x in w)
    total, distinct = sum(c.values()), len(c)
    want = Counter()
    for i, w in tokens:
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w), 6)] += 1
    got = Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert {k[:5] for k in got} == {k[:5] for k in want} and sum(got.values()) == len(docs)
    assert sorted(k[5] for k in got.elements()) == pytest.approx(sorted(k[5] for k in want.elements()), abs=1e-5)
    assert all(r.score < 0 for r in out) and hmm.score(empty).count() == 0


def test_language_model_learns_from_all_texts(spark, monkeypatch):
    for name, value in (("SYMBOLS", 40), ("ROUNDS", 1)):
        monkeypatch.setattr(hmm, name, value)
    read, one_round = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda texts, *more: (read.append(texts.count()), one_round(texts, *more))[1])
    rows = [(i, f"the w{i % 50} of a w{i % 7}") for i in range(6000)]
    out = hmm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6000 and read == [sum(not r.held_out for r in out)]
    lexicon = hmm.Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, int), 3)
    c = hmm.Contexts(lexicon)
    end, width = lexicon.end, 5
    c.add(np.array([0, 2, 9, end, 1, end, end]), np.array([0, 4, 6, 7]))
    got = c.values().reshape(end + 1, 2, width)
    assert got[0, 0, 3] == got[0, 1, 2] == got[2, 1, 4] == got[9, 0, 2] == got[9, 1, 3] == got[1, 0, 3] == 1 and got[end, 0].tolist() == [0, 1, 0, 1, 1]
    assert got[:, 0].sum() == got[:, 1].sum() == 7
    model = hmm.started(c.values(), end + 1)
    assert all(np.allclose(v, 1) for v in (model.begin.sum(), model.step.sum(axis=1), model.emit.sum(axis=0)))


def test_license_scan(table, empty):
    out = {r.doc_id: r for r in licenses.scan(table).collect()}
    found = {i: r.licences for i, r in out.items() if r.licences}
    assert list(found.values()) == [["Apache-2.0", "MIT"]] and out[0].sentence_ids == ""
    hint = re.compile(licenses.HINT)
    assert all(hint.search(s) for s in licenses.LETTERS) and len(set(licenses.LETTERS.values())) == len(licenses.LETTERS) and licenses.scan(empty).count() == 0


def test_longest_licence_rule_uses_its_sentences_up(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the License);\nyou may not use this file except in compliance with the License.\n"
    terms = "You may obtain a copy of the License at\n\nSee the License for the specific language governing permissions and limitations under the License.\n"
    texts = [
        (apache + terms, ["Apache-2.0"], 1),
        # the second time only the shorter rule is there
        (apache + terms + "One. Two. Three.\n" + apache, ["Apache-2.0"], 2),
        ("Released under the terms of the GNU Lesser General Public License version 2.1. This software is available under CC0 1.0 Universal.", ["CC0-1.0", "LGPL-2.1"], 2),
        ("This is free and unencumbered software released into the public domain.\n\nMore.", ["Unlicense"], 1),
        ("A licence of no kind", [], 0),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "doc_id int, text string")
    assert [(r.licences, r.n_matches) for r in licenses.scan(df).orderBy("doc_id").collect()] == [(x, n) for _, x, n in texts]
