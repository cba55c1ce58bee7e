"""Mixing sources to target weights.

The words of each source, document after document, form one stream that is packed into blocks of a fixed number of
words. The mix is made of output shards of a fixed number of slots; each shard draws how many slots each source fills (a multinomial
draw on what whole expected counts leave over, so that the sums stay near the targets). A source's slots, counted over all
shards, are mapped to its blocks by pseudorandom permutations of the block indices, one permutation for each pass through the
source, and slots meet blocks in a join by (source, index).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massif.llm.words import Words, pieces
from massif.runtime import Scratch, ship, shuffle_partitions

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
SEED = 42
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def n_words(column: str):
    """Number of words of a text column; 0 for null."""
    return F.coalesce(F.expr(f"regexp_count(`{column}`, '{WORD}')"), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight; a target stops at `most` times its size and the excess is shared anew by weight."""
    out = [0.0] * len(sizes)
    weigh = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weigh[i] for i in open_)
        over = {i for i in open_ if unit * weigh[i] > most * sizes[i]}
        if not over:
            return [unit * weigh[i] if i in open_ else x for i, x in enumerate(out)]
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, scratch: Scratch) -> DataFrame:
    """df with `before`: the sum of value over the rows of its group that come earlier by order.

    Rows are dealt by ranges of (group, order), so a large group spans many tasks; each task sums its own rows, and the sums of
    whole tasks (one row for each task and group) are added in a second pass.
    """
    n = shuffle_partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id())

    # in Arrow, as pandas would turn a column of large ids with nulls into floats
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, 0
        for x in batches:
            g, v = (x.column(x.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (group, value))
            sums = np.cumsum(v)
            new = np.ones(len(g), dtype=bool)
            new[1:] = g[1:] != g[:-1]
            base = np.where(new, sums - v, 0)
            base = np.maximum.accumulate(base)
            before = sums - v - base
            if len(g) and g[0] == last:
                before[g == last] += carry
            if len(g):
                carry, last = int(before[-1] + v[-1]), g[-1]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(before, pa.int64())], [*x.schema.names, "_before"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    local = scratch.save(dealt.mapInArrow(run, f"{fields}, _before long"))
    sums = local.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    return local.join(bases, [group, "_part"]).withColumn("before", F.col("_before") + F.col("_base")).drop("_part", "_before", "_base")


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """The image of each index under a keyed permutation of range(size): a Feistel network on an even number of bits, walked until it falls into the range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for turn in range(6):
            f = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 8 + turn) * 0xD1B54A32D192ED03 % (1 << 64))
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> np.uint64(33)) & mask
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, key_col: str | None = None) -> DataFrame:
    """(id, size, source_size, target, taken, spans) for each row of df; spans: runs of words with the times that each is taken.

    size: words of the text (0 for null and empty texts, which nothing is taken from). Sources weigh 5, 2, 1, repeating, by
    code point, null last. taken: words the mix takes from the row, repeats counted; never over three times its size. Rows that
    repeat have their own words in the stream. The same rows give the same mix, however they are dealt: rows of one id come in the order of a hash of
    their texts. An empty table gives an empty table.
    The table of sources (not of documents) is held by the driver. key_col names a column that tells rows apart: rows of one id
    come in its order, and the result has it as `key`.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mixing")
    keys = ["key"] if key_col else []
    own = [F.col(f"`{key_col}`").alias("key")] if key_col else []
    sizes = scratch.save(df.select(*own, F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(text_col).alias("size"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie")))
    found = [(r["source"], r["size"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    found.sort(key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in found], weights)
    blocks = [-(-n // block_words) for _, n in found]
    # slots that give the target's words, as the last block of a source may be short
    expected = np.array([t * b / n if n else 0.0 for t, b, (_, n) in zip(goal, blocks, found)])
    slots = max(int(round(expected.sum())), 1)
    share = expected / expected.sum() if expected.sum() else np.zeros(len(expected))
    plan = spark.createDataFrame(
        [(k, s, n, t) for k, ((s, n), t) in enumerate(zip(found, goal))], "k int, source string, source_size long, target double"
    )
    rows = sizes.join(F.broadcast(plan), sizes["source"].eqNullSafe(plan["source"])).select("id", "tie", "size", "k", "source_size", "target", *keys)
    filled = rows.where("size > 0")
    placed = prefix_sums(filled, "k", ["id", *(keys or ["tie"])], "size", scratch)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for shard in x["id"]:
                size = min(shard_slots, slots - shard * shard_slots)
                whole = np.floor(share * size)
                rest = share * size - whole
                n = whole.astype(np.int64)
                if rest.sum() > 0:
                    n += np.random.default_rng([seed, shard]).multinomial(size - int(whole.sum()), rest / rest.sum())
                at = np.flatnonzero(n)
                yield pd.DataFrame({"shard": shard, "k": at, "n": n[at]})

    draws = spark.range(-(-slots // shard_slots)).mapInPandas(draw, "shard long, k int, n long")

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for k, part in x.groupby("k"):
                n, size = part["n"].to_numpy(), blocks[k]
                rank = np.repeat(part["before"].to_numpy() - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rank = rank[rank < MAX_REPEATS * size]
                turn = rank // size
                index = np.empty(len(rank), dtype=np.int64)
                for e in np.unique(turn):
                    index[turn == e] = permuted(rank[turn == e] % size, size, (seed * 1_000_003 + k) * 4 + int(e))
                yield pd.DataFrame({"k": k, "block": index})

    hits = prefix_sums(draws, "k", ["shard"], "n", scratch).mapInPandas(fill, "k int, block long").groupBy("k", "block").agg(F.count("*").alias("times"))
    first, last = F.floor(F.col("before") / block_words), F.floor((F.col("before") + F.col("size") - 1) / block_words)
    covered = placed.withColumn("block", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("before") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("before"), F.col("block") * block_words)
    start = F.greatest(F.col("before"), F.col("block") * block_words) - F.col("before")
    span = F.struct(start.alias("start"), overlap.alias("words"), F.coalesce("times", F.lit(0)).alias("times"))
    taken = (
        covered.join(hits, ["k", "block"], "left")
        .groupBy("k", "before")
        .agg(*[F.first(c).alias(c) for c in ("id", "size", "source_size", "target", *keys)], F.sum(overlap * F.coalesce("times", F.lit(0))).alias("taken"), F.array_sort(F.collect_list(span)).alias("spans"))
    )
    names = ["id", "size", "source_size", "target", "taken", "spans", *keys]
    none = F.array().cast(taken.schema["spans"].dataType)
    return taken.select(*names).unionAll(rows.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), none.alias("spans"), *keys))


def cut_words(w: Words, i: int, start: np.ndarray, words: np.ndarray, times: np.ndarray) -> bytes:
    """The words of text i that the mix takes, as runs of words and times: in the text's own white space and order, what is taken again once more after a line break."""
    lo, n = w.first[i], w.first[i + 1] - w.first[i]
    copies = []
    for turn in range(1, MAX_REPEATS + 1):
        on = times >= turn
        if not on.any():
            break
        first, last = start[on], start[on] + words[on]
        apart = first[1:] != last[:-1]
        first, last = first[np.append(True, apart)], last[np.append(apart, True)]
        if len(first) == 1 and last[0] - first[0] == n:
            copies.append(w.buf[w.doc_at[i] : w.doc_at[i + 1]].tobytes())
        else:
            runs = zip(w.start[lo + first].tolist(), w.end[lo + last - 1].tolist())
            copies.append(b"\n".join(w.buf[x:y].tobytes() for x, y in runs))
    return b"\n".join(copies)


def realise(df: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of df that the mix takes words of, their text being the words taken (repeats included) and length_col its length.

    id_col must tell the rows apart, as mixed's key does: mixed has each id once, and a row without an id goes. A null text has no words and goes too;
    a long one is cut in the bytes of its column. An empty table gives an empty table.
    """
    ship(df.sparkSession)

    # on the bytes of Arrow columns: a word of a long text, or a run of it, is no Python object
    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        runs = spans.flatten()
        start, words, times = (pc.struct_field(runs, c).to_numpy(zero_copy_only=False) for c in ("start", "words", "times"))
        at = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)))
        out = []
        for a, b, w in pieces(text):
            made = [cut_words(w, i - a, *(c[at[i] : at[i + 1]] for c in (start, words, times))) for i in range(a, b)]
            out.append(pa.array(made, pa.binary()).cast(pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    own = mixed.where("taken > 0").select(F.col("id").alias("_id"), F.col("spans").alias("_spans"))
    out = df.join(own, F.col(f"`{id_col}`") == F.col("_id")).withColumn(text_col, cut(F.col(f"`{text_col}`"), F.col("_spans"))).drop("_id", "_spans")
    return out.withColumn(length_col, F.char_length(text_col).cast(df.schema[length_col].dataType)) if length_col in df.columns else out
