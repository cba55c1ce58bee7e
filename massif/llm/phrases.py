"""Substring dedup with repeated-phrase automata.

A window of 35 words holds 26 anchors of 10 words; the least of them by a hash is its minimiser, and equal windows have
equal minimisers. Anchors that recur in the corpus are confirmed by counting minimisers, a fifteenth of all positions. Documents are
dealt to blocks of a few MB, and each block compiles its own Aho-Corasick automaton, a shard, of those recurring anchors that
are minimisers in it; so an automaton is bounded by its block however large the corpus is. Every document streams through its block's
automaton, which locates each occurrence. Windows whose minimiser is located are counted over the corpus by a 96-bit hash, once a block,
and the words under windows that occur twice or more are removed.

A word is one symbol of six bits in an anchor, so anchors are 60-bit numbers, and strings of ten letters in an automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.llm.words import Words, mixed, pieces, spans
from massif.runtime import Scratch, ship

WINDOW = 35
ANCHOR = 10
BLOCK_BYTES = 4 << 20
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def symbols(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(58)


def anchors(sym: np.ndarray) -> np.ndarray:
    """The number of the anchor that starts at each word."""
    n = len(sym) - ANCHOR + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(ANCHOR):
        out |= sym[j : j + n] << np.uint64(6 * j)
    return out


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def minimisers(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each anchor, least rank of each window) of one text of at least `window` words. Ranks are one-to-one with anchors."""
    ranks = mixed(anchors(symbols(hashes)))
    return ranks, least(ranks, window - ANCHOR + 1)


def _long_texts(w: Words, window: int):
    for i in np.flatnonzero(w.counts >= window).tolist():
        yield i, slice(w.first[i], w.first[i + 1])


def automaton(ranks: np.ndarray, unmixed: np.ndarray):
    """An automaton of the anchors with these numbers, or None."""
    import ahocorasick

    if not len(ranks):
        return None
    text = ((unmixed[:, None] >> (np.arange(ANCHOR, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)).astype(np.uint8) + 48
    text = text.tobytes().decode("ascii")
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for k in range(0, len(text), ANCHOR):
        out.add_word(text[k : k + ANCHOR])
    out.make_automaton()
    return out


def located(machine, sym: np.ndarray) -> np.ndarray:
    """True where an anchor of the automaton starts."""
    out = np.zeros(len(sym) - ANCHOR + 1, dtype=bool)
    if machine is not None:
        ends = [end for end, _ in machine.iter((sym.astype(np.uint8) + 48).tobytes().decode("ascii"))]
        out[np.array(ends, dtype=np.int64) - (ANCHOR - 1)] = True
    return out


def window_hashes(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and another 32-bit hash of each window."""
    return spans(hashes, window), (spans(mixed(~hashes), window) >> np.uint64(32)).astype(np.uint32)


def _candidates(w: Words, part: slice, hashes: np.ndarray, machine, window: int) -> np.ndarray:
    own = hashes[part]
    ranks, low = minimisers(own, window)
    found = located(machine, symbols(own))
    return np.flatnonzero(least(np.where(found, ranks, _LAST), window - ANCHOR + 1) == low) if found.any() else np.zeros(0, dtype=np.int64)


def _as_words(docs: pa.Table) -> tuple[pa.Table, Words]:
    docs = docs.combine_chunks()
    text = docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string())
    text = text if isinstance(text, pa.Array) else text.chunk(0)
    _, _, w = next(pieces(text, most=1 << 62))
    return docs, w


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans, kept) for each row of df.

    Removed are the words under each window of `window` words that also starts anywhere else in the corpus, the same text
    included; windows are judged on the input. spans: pairs of first and end word of what is removed; kept: the other
    words, joined by one space. Null texts have no words. Rows that repeat are texts like any others, so their windows recur. Texts
    shorter than a window keep all words. An empty table gives an empty table.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "phrases")
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = size // BLOCK_BYTES + 1
    docs = docs.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(1).to_numpy(zero_copy_only=False)
            for a, _, w in pieces(batch.column(0)):
                hashes, found, at = w.hashes(), [], []
                for i, part in _long_texts(w, window):
                    ranks, low = minimisers(hashes[part], window)
                    # an anchor counts wherever it is the least of some window: of those that hold it, one has it as its minimum
                    pad = np.full(window - ANCHOR, _LAST)
                    highest = ~least(np.concatenate([pad, ~low, pad]), window - ANCHOR + 1)
                    found.append(ranks[highest == ranks])
                    at.append(np.full(len(found[-1]), blocks[a + i]))
                if found:
                    pairs = np.rec.fromarrays([np.concatenate(at), np.concatenate(found)], names="block,rank")
                    pairs, n = np.unique(pairs, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs["block"].copy()), pa.array(pairs["rank"].copy().view(np.int64)), pa.array(n)], ["block", "rank", "n"])

    seen = docs.select("text", "block").mapInArrow(emit, "block long, rank long, n long").groupBy("block", "rank").agg(F.sum("n").alias("n"))
    seen = scratch.save(seen)
    recurring = seen.groupBy("rank").agg(F.sum("n").alias("n")).where("n > 1").select("rank")
    recurring = scratch.save(seen.join(recurring, "rank", "left_semi").select("block", "rank"))
    scratch.drop(seen)

    def locate(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)]
        if left.num_rows and right.num_rows:
            _, w = _as_words(left)
            hashes = w.hashes()
            ranks = right.column("rank").to_numpy().view(np.uint64)
            machine = automaton(ranks, unmixed(ranks))
            high, more = [], []
            for _, part in _long_texts(w, window):
                hit = _candidates(w, part, hashes, machine, window)
                if len(hit):
                    h, g = window_hashes(hashes[part], window)
                    high.append(h[hit])
                    more.append(g[hit])
            if high:
                pairs, n = np.unique(np.rec.fromarrays([np.concatenate(high), np.concatenate(more)], names="h,g"), return_counts=True)
                out = [pairs["h"].copy().view(np.int64), pairs["g"].copy().view(np.int32), n]
        return pa.table([pa.array(np.full(len(out[0]), key[0].as_py())), *map(pa.array, out)], names=["block", "h", "g", "n"])

    by_block = docs.groupBy("block")
    found = scratch.save(by_block.cogroup(recurring.groupBy("block")).applyInArrow(locate, "block long, h long, g int, n long"))
    twice = found.groupBy("h", "g").agg(F.sum("n").alias("n")).where("n > 1").select("h", "g")
    twice = scratch.save(found.join(twice, ["h", "g"], "left_semi").select("block", "h", "g"))
    scratch.drop(found)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], left.schema.field("id").type), *[pa.array([], t) for t in _CUT.values()]], names=["id", *_CUT])
        left, w = _as_words(left)
        counts, hashes = w.counts, w.hashes()
        h = right.column("h").to_numpy().view(np.uint64)
        g = right.column("g").to_numpy().view(np.uint32)
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        removed: dict[int, np.ndarray] = {}
        for i, part in _long_texts(w, window) if len(h) else ():
            own_h, own_g = window_hashes(hashes[part], window)
            at = np.searchsorted(h, own_h)
            hit = np.zeros(len(own_h), dtype=bool)
            # hashes that share their first 64 bits lie side by side
            for _ in range(len(h)):
                at_c = np.minimum(at, len(h) - 1)
                same = (at < len(h)) & (h[at_c] == own_h)
                hit |= same & (g[at_c] == own_g)
                if not (same & ~hit).any():
                    break
                at = np.where(same, at + 1, at)
            if hit.any():
                edge = np.zeros(len(own_h) + window, dtype=np.int64)
                starts = np.flatnonzero(hit)
                edge[starts] += 1
                np.subtract.at(edge, starts + window, 1)
                removed[i] = np.cumsum(edge[:-1]) > 0
        texts = left.column("text").combine_chunks()
        n_removed, sha, ranges, kept = [], [], [], []
        for i in range(left.num_rows):
            words = texts[i].as_py().encode().split()
            gone = removed.get(i)
            if gone is None:
                ranges.append([])
            else:
                flip = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                ranges.append(flip.tolist())
                words = [x for x, out in zip(words, gone) if not out]
            n_removed.append(int(counts[i]) - len(words))
            kept.append(b" ".join(words))
            sha.append(hashlib.sha256(kept[-1]).hexdigest())
        columns = [counts, n_removed, sha, ranges, pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table([left.column("id"), *[pa.array(c, t) for c, t in zip(columns, _CUT.values())]], names=["id", *_CUT])

    kind = docs.schema["id"].dataType.simpleString()
    return by_block.cogroup(twice.groupBy("block")).applyInArrow(cut, f"id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<int>, kept string")


_CUT = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.int32()), "kept": pa.string()}
_UNMIX = pow(0x7FB5D329728EA185, -1, 1 << 64), pow(0x81DADEF4BC2DD44D, -1, 1 << 64)


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of mixed()."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_UNMIX[1])
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(_UNMIX[0])
    return x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
