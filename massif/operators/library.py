"""Spectral-library operators: index windows, merges with conflict policies, updates, statistics, features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from massif.operators.graph import components
from massif.runtime import Scratch, ship


def window_query(entries: DataFrame, bounds: dict[str, tuple[float, float]], decoy: Column, with_decoys: bool = False) -> DataFrame:
    """Entries within all inclusive bounds; decoys only on request. The bounds are plain comparisons, so they reach a Parquet scan."""
    out = entries
    for column, (lo, hi) in bounds.items():
        out = out.where((F.col(column) >= lo) & (F.col(column) <= hi))
    return out if with_decoys else out.where(~decoy)


def merge_keep_first(entries: DataFrame, key: list[str], source: str, order: str) -> DataFrame:
    """One entry a key: of the first source, and within it the first by order."""
    return _one(entries, key, [F.col(source), F.col(order)])


def merge_keep_last(entries: DataFrame, key: list[str], source: str) -> DataFrame:
    """All entries of the last source that has the key: duplicates inside it survive."""
    w = Window.partitionBy(*key)
    return entries.withColumn("_last", F.max(source).over(w)).where(F.col(source) == F.col("_last")).drop("_last")


def merge_lowest_q(entries: DataFrame, key: list[str], mz: str, q: str, order: list[str], near: float = 0.001) -> DataFrame:
    """Of entries of one key whose m/z lie within `near` of the previous one's, the one with the least q (NaN loses, then the order).

    The same key further apart in m/z stays several times.
    """
    w = Window.partitionBy(*key).orderBy(mz, *order)
    gap = F.coalesce((F.col(mz) - F.lag(mz).over(w) > near).cast("int"), F.lit(0))
    marked = entries.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bad = F.isnan(q) | F.col(q).isNull()
    return _one(marked, [*key, "_run"], [bad, F.col(q), *[F.col(c) for c in order]]).drop("_gap", "_run")


def _one(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: a partial aggregate of a struct, not a window, so hot keys combine before the shuffle."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("rank")
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), rank).alias("_best")
    ranked = df.select(*df.columns, rank)
    return ranked.groupBy(*key).agg(best).select(*key, *[F.col("_best").getField(c).alias(c) for c in rest]).select(*df.columns)


def update(old: DataFrame, new: DataFrame, key: str, rt: str, fragments: str) -> DataFrame:
    """(key, rt, fragments, status): the entry with more fragments stays; new retention times are put on the old scale by least squares (AGG29).

    status is retained, replaced or added. Without two shared keys times stay as they are.
    """
    o = old.select(key, F.col(rt).alias("_o_rt"), F.col(fragments).alias("_o_n"))
    n = new.select(key, F.col(rt).alias("_n_rt"), F.col(fragments).alias("_n_n"))
    fit = o.join(n, key).agg(F.regr_slope("_o_rt", "_n_rt").alias("_a"), F.regr_intercept("_o_rt", "_n_rt").alias("_b"))
    both = o.join(n, key, "full").join(F.broadcast(fit))
    calibrated = F.coalesce(F.col("_a") * F.col("_n_rt") + F.col("_b"), F.col("_n_rt"))
    keep = F.col("_n_n").isNull() | (F.col("_o_n") >= F.col("_n_n"))
    status = F.when(F.col("_o_n").isNull(), "added").when(keep, "retained").otherwise("replaced")
    return both.select(key, F.when(status == "retained", F.col("_o_rt")).otherwise(calibrated).alias(rt), F.when(status == "retained", F.col("_o_n")).otherwise(F.col("_n_n")).alias(fragments), status.alias("status"))


def statistics(entries: DataFrame, mz: str, rt: str, decoy: Column, group: str) -> DataFrame:
    """Counts of targets, decoys and groups, and the ends of m/z and retention time (AGG28)."""
    return entries.agg(
        F.sum((~decoy).cast("long")).alias("n_targets"), F.sum(decoy.cast("long")).alias("n_decoys"), F.min(mz).alias("min_mz"), F.max(mz).alias("max_mz"),
        F.min(rt).alias("min_rt"), F.max(rt).alias("max_rt"), F.count_distinct(group).alias("n_groups"),
    )


def merge_groups(df: DataFrame, keys: list[str], sets: list[str], scalars: list[str]) -> DataFrame:
    """One row a key: sorted unions of the set columns, least of the scalars (AGG15)."""
    return df.groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in sets], *[F.min(c).alias(c) for c in scalars])


def feature_links(traces: DataFrame, node: str, mass: str, charge: str, start: str, end: str, ppm: float, on: list[str] | None = None) -> DataFrame:
    """(a, b): links that join the traces as all links do, of which there are fewer than twice as many as traces. Traces are linked within ppm of the lower mass, of different charge, with overlapping times.

    Masses are cut into logarithmic bins of the tolerance, so a link lies in one bin or between two neighbours. A task has the traces of two neighbouring bins, drops links whose ends are joined already, and keeps one link for each join.
    """
    ship(traces.sparkSession)
    keys = on or []
    step = float(ppm) * 1e-6 * 1.0001
    b = F.floor(F.log(mass) / F.lit(step)).cast("long")
    x = traces.where((F.col(mass) > 0) & ~F.isnan(F.col(mass).cast("double")))
    for c in [*keys, node, charge, start, end]:
        x = x.where(F.col(c).isNotNull())
    values = [F.col(mass).cast("double").alias("m"), F.col(charge).alias("z"), F.col(start).alias("s"), F.col(end).alias("e")]
    x = x.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(keys)], F.col(node).alias("node"), *values, F.explode(F.array(b - 1, b)).alias("_bin"))
    kinds = StructType([StructField("a", traces.schema[node].dataType), StructField("b", traces.schema[node].dataType)])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        m, s, e = (t[c].to_numpy() for c in ("m", "s", "e"))
        z = np.unique(t["z"].to_numpy(), return_inverse=True)[1]
        order = np.argsort(m, kind="stable")
        one, two = linked(m[order], z[order], s[order], e[order], ppm)
        out = [t["node"].take(pa.array(order[k])) for k in (one, two)]
        return pa.table(out, names=["a", "b"])

    return x.groupBy(*[c for c in x.columns if c.startswith("_on")], "_bin").applyInArrow(run, kinds)


#: Neighbours by mass that each trace is tried with before all pairs of traces not joined yet are.
NEAR = 32
#: Pairs that are compared at once.
PAIRS = 1 << 20


def linked(m: np.ndarray, z: np.ndarray, s: np.ndarray, e: np.ndarray, ppm: float) -> tuple[np.ndarray, np.ndarray]:
    """(one, two): a forest of links that has the components of all of them; m rises.

    Each trace is first tried with its next neighbours by mass. After that pairs inside the largest component are of no interest any more, so each trace outside of it is compared with those within its reach.
    """
    n = len(m)
    root = list(range(n))
    ends: tuple[list, list] = ([], [])

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def join(one: np.ndarray, two: np.ndarray) -> None:
        for i, j in zip(one.tolist(), two.tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                ends[0].append(i)
                ends[1].append(j)

    def met(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(i, j), np.maximum(i, j)
        return (z[i] != z[j]) & (s[i] <= e[j]) & (s[j] <= e[i]) & ((m[high] - m[low]) / m[low] * 1e6 <= ppm)

    def labels() -> np.ndarray:
        return np.array([find(k) for k in range(n)], dtype=np.int64)

    for k in range(1, min(NEAR, n - 1) + 1):
        i = np.arange(n - k)
        now = labels()
        i = i[(now[i] != now[i + k]) & met(i, i + k)]
        join(i, i + k)
    if n <= NEAR + 1:
        return tuple(np.array(x, dtype=np.int64) for x in ends)
    now = labels()
    largest = np.bincount(now, minlength=n).argmax()
    # a little wider than the tolerance; met() decides
    reach = ppm * 1e-6 * (1 + 1e-9)
    low, high = np.searchsorted(m, m / (1 + reach) * (1 - 1e-12)), np.searchsorted(m, m * (1 + reach) * (1 + 1e-12), "right")
    outside = np.flatnonzero(now != largest)
    sizes = (high - low)[outside]
    at = 0
    while at < len(outside):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), PAIRS, "right")) + at)
        own, many = outside[at:stop], sizes[at:stop]
        i = np.repeat(own, many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[own], many)
        # joined meanwhile: a look at the labels spares the loop
        now = labels()
        open_ = now[i] != now[j]
        i, j = i[open_], j[open_]
        hit = met(i, j)
        join(i[hit], j[hit])
        at = stop
    return tuple(np.array(x, dtype=np.int64) for x in ends)


def features(traces: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """traces with feature: the least node linked with it, over any number of links; itself where it has none."""
    labels = components(links, Scratch(traces.sparkSession, "features"))
    return traces.join(labels.withColumnRenamed("node", node), node, "left").withColumn("feature", F.coalesce("label", node)).drop("label")
