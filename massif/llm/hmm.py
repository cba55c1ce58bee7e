"""Language-model scoring with a hidden Markov model.

Latent states emit symbols: the most frequent training words, one symbol for each class of the other words, and the
end of the text. Within its class a word has an add-one share of the class's training count, and any unseen word the whole share
of unseen ones. Every training text is counted and learned from: the states start as groups of symbols with like neighbours, and Baum-Welch goes on
from there; counts are added up within tasks and then across them. The forward recursion, rescaled at each step, gives each text's exact likelihood.

Words are known by a 64-bit hash. Counts are tables of one row a word; only the bounded tables of frequent words and the
model's parameters go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.llm.words import Words, pieces
from massif.runtime import Scratch, ship

STATES = 16
#: Words that have a symbol of their own, and words whose counts every task holds.
SYMBOLS = 20_000
COUNTED = 200_000
CLASSES = 256
#: Most frequent symbols that are told apart as neighbours, rounds that group the symbols by them, and rounds of Baum-Welch; all are over all training texts.
NEIGHBOURS = 30
START_ROUNDS = 12
ROUNDS = 2
#: A symbol's share in its own state at the start.
OWN = 0.8
#: Tokens times texts that the expectation step holds at once.
CELLS = 1 << 18
PRIOR = 20.0
SEED = 11
VALUES = 4096


def held_out(id_col: str) -> Column:
    """True for ids whose crc32 as text leaves 2 by 7; false for null."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_classes(w: Words) -> np.ndarray:
    """The class of each word: by its last two bytes, which tell endings and punctuation."""
    last = w.buf[w.end - 1].astype(np.int64)
    before = np.where(w.end - w.start > 1, w.buf[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    return (last * 131 + before * 7919) % 1021 % CLASSES


@dataclass
class Lexicon:
    """Frequent words: sorted hashes with counts, and the symbol of each (-1: its class's)."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    n_symbols: int

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    @property
    def end(self) -> int:
        return self.n_symbols + CLASSES

    def coded(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols of all texts with their ends, offsets of the texts, hashes of the words, positions in the lexicon)."""
        h = w.hashes()
        at = self.look_up(h)
        own = np.where(at >= 0, self.symbols[at], -1) if len(self.hashes) else at
        symbols = np.where(own >= 0, own, self.n_symbols + word_classes(w))
        symbols = np.insert(symbols, w.first[1:], self.end)
        return symbols, w.first + np.arange(len(w.first)), h, at


@dataclass
class Hmm:
    begin: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbol, state

    def log10_likelihood(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text symbols[at[i]:at[i + 1]]; the longest go first, so that those still running are always in front."""
        lengths = np.diff(at)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = at[:-1][order], lengths[order]
        running = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        out = np.zeros(len(lengths))
        alpha = None
        for t, n in enumerate(running):
            alpha = (np.broadcast_to(self.begin, (n, STATES)) if t == 0 else alpha[:n] @ self.step) * self.emit[symbols[starts[:n] + t]]
            total = alpha.sum(axis=1)
            out[:n] += np.log10(total)
            alpha /= total[:, None]
        back = np.empty(len(out))
        back[order] = out
        return back


class Expected:
    """Expected counts of a task, by forward and backward messages over whole texts.

    Texts of like length are walked together. A text longer than CELLS tokens is walked in spans: the forward message into each span is kept, and
    going backward a span's own messages are worked out again from it, so that memory stays bounded however long the text is.
    """

    def __init__(self, hmm: Hmm):
        self.hmm = hmm
        self.begin, self.step = np.zeros(STATES), np.zeros((STATES, STATES))
        self.emit = np.zeros((STATES, len(hmm.emit)))
        self.begin32, self.emit32, self.step32 = (x.astype(np.float32) for x in (hmm.begin, hmm.emit, hmm.step))

    def add(self, symbols: np.ndarray, at: np.ndarray) -> None:
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        k = 0
        while k < len(order):
            i = order[k : k + max(1, CELLS // int(size[order[k]]))]
            self._batch(symbols, at[:-1][i], size[i])
            k += len(i)

    def _forward(self, seen: np.ndarray, running: np.ndarray, message: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward messages of a span, and the scales; message: that of the token before it."""
        alpha = np.zeros((*seen.shape, STATES), dtype=np.float32)
        scale = np.ones((*seen.shape, 1), dtype=np.float32)
        for t, n in enumerate(running):
            message = (np.broadcast_to(self.begin32, (n, STATES)) if message is None else message[:n] @ self.step32) * self.emit32[seen[t, :n]]
            scale[t, :n] = message.sum(axis=1, keepdims=True)
            message = message / scale[t, :n]
            alpha[t, :n] = message
        return alpha, scale

    def _batch(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        steps, b = int(size[0]), len(size)
        width = max(1, CELLS // b)
        running = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
        spans = [(k, min(k + width, steps)) for k in range(0, steps, width)]
        symbols_of = lambda lo, hi: symbols[np.minimum(start[None, :] + np.arange(lo, hi)[:, None], len(symbols) - 1)]
        messages = [None]
        for lo, hi in spans[:-1]:
            messages.append(self._forward(symbols_of(lo, hi), running[lo:hi], messages[-1])[0][-1])
        beta, ahead = np.ones((b, STATES), dtype=np.float32), None
        for (lo, hi), message in zip(reversed(spans), reversed(messages)):
            seen = symbols_of(lo, hi)
            alpha, scale = self._forward(seen, running[lo:hi], message)
            for t in range(hi - lo - 1, -1, -1):
                n = running[lo + t]
                if ahead is not None:
                    m = len(ahead)
                    self.step += (alpha[t, :m].T @ ahead) * self.hmm.step
                    beta[:m] = ahead @ self.step32.T
                ahead = self.emit32[seen[t, :n]] * beta[:n] / scale[t, :n]
                alpha[t, :n] *= beta[:n]
            if lo == 0:
                self.begin += alpha[0].sum(axis=0)
            live = np.arange(lo, hi)[:, None] < size[None, :]
            flat, weight = seen[live], alpha[live]
            for s in range(STATES):
                self.emit[s] += np.bincount(flat, weights=weight[:, s], minlength=self.emit.shape[1])

    def values(self) -> np.ndarray:
        return np.concatenate([self.begin, self.step.ravel(), self.emit.ravel()])


def maximised(values: np.ndarray, n_emit: int) -> Hmm:
    begin, step, emit = np.split(values, np.cumsum([STATES, STATES * STATES]))
    step, emit = step.reshape(STATES, STATES), emit.reshape(STATES, n_emit)
    overall = emit.sum(axis=0) + 1
    emit = emit + PRIOR * overall / overall.sum()
    step = step + 1.0 / STATES
    return Hmm((begin + 1 / STATES) / (begin.sum() + 1), step / step.sum(axis=1, keepdims=True), np.ascontiguousarray((emit / emit.sum(axis=1, keepdims=True)).T))


def _summed(frames: pd.DataFrame) -> bytes:
    return np.sum([np.frombuffer(x, dtype=np.float64) for x in frames["v"]], axis=0).tobytes()


def _totals(texts: DataFrame, scratch: Scratch, lexicon: Broadcast, hmm: Hmm | None) -> np.ndarray:
    """The values of Expected, or of Contexts without a model, summed over all texts (a column `text`)."""
    shared = texts.sparkSession.sparkContext.broadcast(hmm)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lex = shared.value, lexicon.value
        total = Expected(model) if model else Contexts(lex)
        for batch in batches:
            for _, _, w in pieces(batch.column(0), lower=True):
                symbols, at, _, _ = lex.coded(w)
                total.add(symbols, at)
        v = total.values()
        at = range(0, len(v), VALUES)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(at)), pa.int32()), pa.array([part % 64] * len(at), pa.int32()), pa.array([v[i : i + VALUES].tobytes() for i in at], pa.binary())], ["block", "salt", "v"]
        )

    # sums of at most 64 groups of tasks for each block of values, then of those; written, so that the shuffles' files go at once
    sums = texts.select("text").mapInArrow(count, "block int, salt int, v binary")
    sums = sums.groupBy("block", "salt").applyInPandas(lambda x: pd.DataFrame({"block": x["block"].iloc[:1], "v": [_summed(x)]}), "block int, v binary")
    sums = scratch.save(sums.groupBy("block").applyInPandas(lambda x: pd.DataFrame({"block": x["block"].iloc[:1], "v": [_summed(x)]}), "block int, v binary"))
    out = np.concatenate([np.frombuffer(r["v"]) for r in sorted(sums.collect(), key=lambda r: r["block"])])
    scratch.drop(sums)
    shared.destroy()
    return out


def baum_welch(texts: DataFrame, hmm: Hmm, lexicon: Broadcast, scratch: Scratch) -> Hmm:
    """One round over all texts (a column `text`)."""
    return maximised(_totals(texts, scratch, lexicon, hmm), len(hmm.emit))


class Contexts:
    """How often each symbol stands after and before each of the most frequent ones, an end of the text, and any other."""

    def __init__(self, lexicon: Lexicon):
        self.named, self.end = min(NEIGHBOURS, lexicon.n_symbols), lexicon.end
        self.counts = np.zeros((self.end + 1) * 2 * (self.named + 2))

    def add(self, symbols: np.ndarray, at: np.ndarray) -> None:
        width = self.named + 2
        kind = np.where(symbols < self.named, symbols, np.where(symbols == self.end, self.named, self.named + 1))
        # what follows an end is the next text's, if any; what comes first has an end before it
        before, after = np.insert(kind[:-1], 0, self.named), np.append(kind[1:], self.named)
        after[at[1:] - 1] = self.named
        for side, k in enumerate((before, after)):
            self.counts += np.bincount((symbols * 2 + side) * width + k, minlength=len(self.counts))

    def values(self) -> np.ndarray:
        return self.counts


def started(values: np.ndarray, n_emit: int) -> Hmm:
    """The model to start from: symbols are grouped by the distributions of their neighbours (k-means on square roots, weighted by frequency), each group makes a state, and neighbours give the steps."""
    counts = values.reshape(n_emit, 2, -1)
    named = counts.shape[2] - 2
    total = counts[:, 0].sum(axis=1)
    x = np.sqrt(counts / np.maximum(total, 1)[:, None, None]).reshape(n_emit, -1)
    rng = np.random.default_rng(SEED)
    far = lambda c: ((x - c) ** 2).sum(axis=1)
    centers, gap = [x[int(np.argmax(total))]], np.full(n_emit, np.inf)
    for _ in range(STATES - 1):
        gap = np.minimum(gap, far(centers[-1]))
        p = gap * np.sqrt(total)
        centers.append(x[rng.choice(n_emit, p=p / p.sum())] if p.sum() > 0 else centers[0] + rng.normal(0, 0.01, x.shape[1]))
    for _ in range(START_ROUNDS):
        own = np.argmin([far(c) for c in centers], axis=0)
        for k in range(STATES):
            w = np.where(own == k, total, 0)
            if w.any():
                centers[k] = w @ x / w.sum()
    own = np.argmin([far(c) for c in centers], axis=0)
    share = np.full((n_emit, STATES), (1 - OWN) / (STATES - 1))
    share[np.arange(n_emit), own] = OWN
    emit = share * total[:, None]
    # the states of each kind of neighbour
    kinds = np.vstack([emit[:named], emit[-1:], emit[named:-1].sum(axis=0)[None]])
    kinds /= np.maximum(kinds.sum(axis=1, keepdims=True), 1e-300)
    step = share[:-1].T @ counts[:-1, 1] @ kinds
    begin = share.T @ counts[:, 0, named]
    return maximised(np.concatenate([begin, step.ravel(), emit.T.ravel()]), n_emit)


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, class, n): counts of the words of a column `text`; tasks add up several million words before they emit."""

    def flush(h: list, c: list) -> pa.RecordBatch:
        all_h, all_c = np.concatenate(h), np.concatenate(c)
        u, where, n = np.unique(all_h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(all_c[where].astype(np.int32)), pa.array(n)], ["hash", "class", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, held = [], [], 0
        for batch in batches:
            for _, _, w in pieces(batch.column(0), lower=True):
                h.append(w.hashes())
                c.append(word_classes(w).astype(np.int16))
                held += len(h[-1])
                if held > 3_000_000:
                    yield flush(h, c)
                    h, c, held = [], [], 0
        if held:
            yield flush(h, c)

    return texts.select("text").mapInArrow(count, "hash long, class int, n long").groupBy("hash").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, at most `most`: counts are cut between two steps of a logarithmic scale, found from a histogram of some hundred rows."""
    step = F.floor(F.log2("n") * 32).cast("int")
    cut, held = None, 0
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("v")).collect(), key=lambda r: -r["s"]):
        held += r["v"]
        if held > most:
            break
        cut = r["s"]
    return counts.where(step >= cut) if cut is not None else counts.limit(0)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of df.

    Tokens are the words, A-Z lower-cased, and one end. Null texts count as empty: their only token is the end. Rows whose id's crc32 leaves 2 by 7 are
    scored but not learned from. With no training row every token is unknown; an empty table gives an empty table. Rows that
    repeat are counted and scored as often as they occur.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "hmm")
    docs = df.select(F.col(f"`{id_col}`").alias("id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    train = docs.where(~F.col("held_out"))
    counts = scratch.save(word_counts(train))
    n_train = train.count()
    head = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens, distinct = head["n"] + n_train, head["v"] + (n_train > 0)
    top = most_frequent(counts, COUNTED).toPandas().sort_values(["n", "hash"], ascending=[False, True], ignore_index=True)
    h = top["hash"].to_numpy().astype(np.int64).view(np.uint64)
    symbols = np.where(np.arange(len(top)) < SYMBOLS, np.arange(len(top)), -1)
    order = np.argsort(h)
    lexicon = Lexicon(h[order], top["n"].to_numpy()[order], symbols[order], min(SYMBOLS, len(top)))
    # the words without a symbol, by class
    in_class = np.zeros((CLASSES, 2))
    for r in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        in_class[r["class"]] = r["n"], r["v"]
    named = top[: lexicon.n_symbols]
    for c, n in zip(named["class"], named["n"]):
        in_class[int(c)] -= n, 1
    share = np.log10(in_class.sum(axis=1) + 1)

    n_emit = lexicon.end + 1
    words = spark.sparkContext.broadcast(lexicon)
    hmm = started(_totals(train, scratch, words, None) if n_train else Contexts(lexicon).values(), n_emit)
    for _ in range(ROUNDS if n_train else 0):
        hmm = baum_welch(train, hmm, words, scratch)
    shared = spark.sparkContext.broadcast((hmm, share))
    n_end = n_train

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (model, shares), lex = shared.value, words.value
        row = TaskContext.get().partitionId() << 33
        logs = np.log10(lex.counts + 1.0)
        for batch in batches:
            for a, b, w in pieces(batch.column(2), lower=True):
                coded, at, hashes, found = lex.coded(w)
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])
                known = found >= 0
                log_counts = np.where(known, logs[found], 0.0) if len(logs) else np.zeros(len(found))
                rare = known & (lex.symbols[found] < 0) if len(logs) else known
                outside = ~known
                plain = np.where(rare | outside, shares[word_classes(w)], 0.0)
                tail_at = np.concatenate([[0], np.cumsum(sums(outside))]).astype(np.int32)
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)),
                        batch.column(0)[a:b],
                        batch.column(1)[a:b],
                        pa.array(w.counts + 1),
                        pa.array(sums(known) + (n_end > 0)),
                        pa.array(sums(log_counts) + np.log10(n_end + 1.0)),
                        pa.array(model.log10_likelihood(coded, at) + sums(np.where(rare, log_counts, 0.0)) - sums(plain)),
                        pa.ListArray.from_arrays(pa.array(tail_at), pa.array(hashes[outside].view(np.int64))),
                    ],
                    ["row", "id", "held_out", "n_tokens", "n_known", "logs", "score", "tail"],
                )
                row += n

    kind = docs.schema["id"].dataType.simpleString()
    scored = scratch.save(docs.mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, tail array<long>"))
    tail = scored.select("row", F.explode("tail").alias("hash")).join(counts.select("hash", "n"), "hash")
    tail = tail.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    more, more_logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    return scored.drop("tail").join(tail, "row", "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more_logs - F.col("n_tokens") * float(np.log10(train_tokens + distinct + 1))).alias("base_score"),
        (F.col("score") + more_logs).alias("score"),
    )
