"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose statistic exceeds a cutoff. The rules' cutoffs in a stratum (texts of a like length) are tightened together,
one step of one rule at a time, along a path that one half of the labelled good texts chooses; the other half tests the path from
its laxest end: a step is admitted only if the exact binomial upper bound of what all rules together falsely reject stays within the
risk, and testing stops at the first that fails. As the path does not depend on the testing half, no correction for its steps is
needed; the doubt is divided by the number of strata, so that all bounds hold together with the stated confidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.llm.words import pieces, spans
from massif.runtime import Scratch, ship

SYMBOLS = b"#*$%&|<>"
REPEAT_WORDS = 5
#: Allowed share of good texts that all rules together may reject in a stratum, and the chance that any stratum's bound fails.
RISK = 0.01
DOUBT = 0.05
#: Upper ends of the strata, in words.
STRATA = (50, 200, 1000)
#: Cutoffs tried for each rule, from the laxest.
GRID = tuple(round(2.0**-k, 6) for k in range(-3, 9))
RULES = {
    "symbols_per_word": "n_symbols / n_words",
    "repeated_words": "n_repeat_words / n_words",
    "repeated_lines_per_word": "n_dup_lines / n_words * 8",
    "long_words": "word_chars / n_words / 16",
}
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def binomial_upper(bad: int, n: int, doubt: float) -> float:
    """The exact (Clopper-Pearson) upper confidence bound of a rate after `bad` of `n`."""
    if bad >= n:
        return 1.0
    i = np.arange(bad + 1)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    logs = log_factorial[n] - log_factorial[i] - log_factorial[n - i]
    lo, hi = bad / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if np.exp(logs + i * math.log(p) + (n - i) * math.log1p(-p)).sum() > doubt:
            lo = p
        else:
            hi = p
    return hi


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in pieces(batch.column(1)):
            hashes, counts = w.hashes(), w.counts
            chars = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
            symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[w.buf])])
            word_chars = np.concatenate([[0], np.cumsum(chars[w.end] - chars[w.start])])
            repeats = np.zeros(b - a, dtype=np.int64)
            lines = np.zeros(b - a, dtype=np.int64)
            text = w.buf.tobytes()
            for i in range(b - a):
                at = w.first[i]
                windows = spans(hashes[at : at + counts[i]], REPEAT_WORDS)
                if len(windows):
                    _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
                    hit = np.flatnonzero(times[back] > 1)
                    if len(hit):
                        covered = np.zeros(counts[i] + 1, dtype=np.int64)
                        np.add.at(covered, hit, 1)
                        np.add.at(covered, hit + REPEAT_WORDS, -1)
                        repeats[i] = np.count_nonzero(np.cumsum(covered[:-1]))
                own = [x for x in text[w.doc_at[i] : w.doc_at[i + 1]].split(b"\n") if x and not x.isspace()]
                lines[i] = len(own) - len(set(own))
            columns = [counts, word_chars[w.first[1:]] - word_chars[w.first[:-1]], symbols[w.doc_at[1:]] - symbols[w.doc_at[:-1]], lines, repeats]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], *[pa.array(np.asarray(x, dtype=np.int64)) for x in columns]], ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            )


def text_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each whole text; null counts as empty."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        _counts, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for i in reversed(range(len(STRATA))):
        out = F.when(F.col("n_words") < STRATA[i], i).otherwise(out)
    return out


def ratio(rule: str) -> Column:
    return F.when(F.col("n_words") > 0, F.expr(RULES[rule])).otherwise(0.0)


def admitted(levels: np.ndarray, testing: np.ndarray, n: np.ndarray, doubt: float, risk: float = RISK) -> np.ndarray:
    """Steps of GRID that each rule may take in a stratum.

    levels: for each group of good texts the number of cutoffs that each rule's statistic exceeds; n: texts of the group; testing: whether they
    are of the half that tests. The path takes, step by step, the rule whose next cutoff adds least to what the choosing half loses.
    """
    steps = np.zeros(levels.shape[1], dtype=int)
    lost = lambda s: (levels + s > len(GRID)).any(axis=1)
    total = int(n[testing].sum())
    while (steps < len(GRID)).any():
        after = [steps + (np.arange(len(steps)) == r) for r in np.flatnonzero(steps < len(GRID))]
        step = min(after, key=lambda s: (n[~testing & lost(s)].sum(), s.max(), s.tolist()))
        if binomial_upper(int(n[testing & lost(step)].sum()), total, doubt) > risk:
            break
        steps = step
    return steps


def select_cutoffs(counts: DataFrame, labels: DataFrame, label_col: str = "quality") -> dict[tuple[str, int], float]:
    """The strictest admitted cutoff of each rule and stratum; a pair without one has no entry, and rejects nothing."""
    good = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("double").alias("label")).dropna().groupBy("id").agg(F.avg("label").alias("label")).where("label > 0.5")
    seen = counts.where(~base_failed()).join(good, "id").withColumn("stratum", stratum()).withColumn("testing", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0)
    exceeded = [sum((ratio(r) > c).cast("int") for c in GRID).alias(r) for r in RULES]
    # rows of a fixed number at most: strata, halves and levels
    table = seen.select("stratum", "testing", *exceeded).groupBy("stratum", "testing", *RULES).agg(F.count("*").alias("n")).collect()
    out = {}
    for s in {x["stratum"] for x in table}:
        own = [x for x in table if x["stratum"] == s]
        levels = np.array([[x[r] for r in RULES] for x in own])
        steps = admitted(levels, np.array([x["testing"] for x in own]), np.array([x["n"] for x in own]), DOUBT / (len(STRATA) + 1))
        out |= {(r, s): GRID[k - 1] for r, k in zip(RULES, steps) if k}
    return out


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text_counts(df) with base_failed, kept and rejected_by (names of the rules that reject the text, "base" first).

    A row that fails the base rules is not kept; any other is kept unless its statistic exceeds an admitted cutoff. Too few
    labelled texts in a stratum admit no cutoff there, so nothing more is rejected. Null texts count as empty and fail the base rules. Rows that repeat are judged each
    by itself and alike, a null id has no label, a long text is read whole, and an empty table gives an empty table.
    """
    counts = Scratch(df.sparkSession, "rules").save(text_counts(df, id_col, text_col))
    cutoffs = select_cutoffs(counts, labels)
    s = stratum()
    why = [F.when(base_failed(), F.lit("base"))]
    for r in RULES:
        hit = F.lit(False)
        for (name, k), c in cutoffs.items():
            if name == r:
                hit = hit | ((s == k) & (ratio(r) > c))
        why.append(F.when(hit, F.lit(r)))
    return counts.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_compact(F.array(*why))).withColumn("kept", F.size("rejected_by") == 0)
