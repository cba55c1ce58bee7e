"""Links inside buckets without all pairs, and their connected components.

Tables only: no bucket, component or link set is gathered in one task or in the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.operators.graph import components
from massif.runtime import Scratch

#: Buckets with more nodes of different components than this are split by further keys before their nodes meet.
FULL = 64

Verify = Callable[[DataFrame], DataFrame]
Near = Callable[[Column, Column], Column]


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of keys (key, node, ...) whose key two rows or more have. Counts combine before the shuffle, and the join's large keys can be split."""
    twice = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keys.join(twice, "key", "left_semi")


def bucket_labels(keys: DataFrame) -> DataFrame:
    """For each key of keys (key, node, label): its least and largest label `lo` and `hi` and its number of rows `n`."""
    return keys.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"))


def open_buckets(keys: DataFrame) -> DataFrame:
    """keys (key, node, label) of buckets that hold different labels, with the bucket's least label `lo`."""
    return keys.join(bucket_labels(keys).where("lo <> hi").select("key", "lo"), "key")


def _sides(buckets: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Two sides of open buckets that _met() takes: of two nodes of different components at least one is not of the bucket's least label.

    So a bucket of one large component and few others costs its size times the few.
    """
    return buckets.where("label <> lo"), buckets, "la <> lb AND (lb = lo OR la < lb)"


def _met(x: DataFrame, y: DataFrame, which: str) -> DataFrame:
    """Pairs (a, la, ma, b, lb, mb) of nodes of one bucket in x and y (key, node, label, mark[, lo]) of which the condition holds."""
    x = x.select("key", F.col("node").alias("a"), F.col("label").alias("la"), F.col("mark").alias("ma"))
    rest = ["lo"] if "lo" in y.columns else []
    y = y.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("mark").alias("mb"), *rest)
    return x.join(y, "key").where(which).select("a", "la", "ma", "b", "lb", "mb")


def _inside(small: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, la, ma, b, lb, mb) of rows of one open bucket, of at most FULL rows, that are near: they are compared inside the bucket's list, each once."""
    lists = small.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.collect_list(F.struct("label", "node", "mark")).alias("rows")).where("lo <> hi")
    pair = lambda x, y: F.struct(x.node.alias("a"), x.label.alias("la"), x.mark.alias("ma"), y.node.alias("b"), y.label.alias("lb"), y.mark.alias("mb"))
    met = F.transform("rows", lambda x: F.transform(F.filter("rows", lambda y: (x.label < y.label) & near(x, y)), lambda y: pair(x, y)))
    return lists.select(F.explode(F.flatten(met)).alias("p")).select("p.*")


def _stars(found: DataFrame) -> DataFrame:
    """The links (a: node, b: representative) with each node linked to its least representative alone, and that to the node's others.

    A node has no more representatives than buckets, so its set is small.
    """
    own = found.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("r"))
    ends = F.concat(F.array("a"), F.slice("r", 2, 1 << 20))
    return own.select(F.explode(ends).alias("a"), F.col("r")[0].alias("b")).distinct()


def _joined(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """labels (node, label) after links (a, b) between labels, or between nodes without one, whose label is themselves."""
    links = scratch.save(links)
    if labels is not None and links.isEmpty():
        return labels
    new = scratch.save(components(links, scratch))
    if labels is None:
        return new
    moved = new.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return scratch.save(old.unionAll(new.join(labels.select("node"), "node", "left_anti")))


def linked_components(keys: DataFrame, verify: Verify, scratch: Scratch, refine: Verify | None = None, rounds: int = 2, near: Near | None = None) -> DataFrame:
    """(node, label) of the nodes of keys (key, node[, mark][, rank]) that have links; label is the smallest node that a node reaches.

    verify takes candidate pairs (a, b, their marks ma and mb, ...), repeats included, and returns the distinct ones that are links, in the
    given order of both. First each node is compared with one representative of each of its buckets (one of the least rank in the first round), which gives a linear number of
    pairs and joins up dense groups. Then only nodes of one bucket that are still in different components are compared with one
    another, so a large group of near copies makes no pairs. Where such a bucket is full, refine splits it: it takes (key, node, label,
    mark) and returns rows with finer keys, of which two linked nodes of one bucket must still share one; a bucket that is not full is compared inside
    one list, where it still holds several components: near tells of two rows (node, label, mark) whether they may link. Every link between
    different components is found, so the components are exact.
    """
    keys = keys if "mark" in keys.columns else keys.withColumn("mark", F.lit(0).cast("long"))
    rank = ["rank"] if "rank" in keys.columns else []
    labels, named = None, keys.select("key", "node", "mark", F.col("node").alias("label"), *rank)
    for k in range(rounds):
        # one representative a bucket: the least by a hash that differs from round to round
        pick = F.min(F.struct(*(rank if k == 0 else []), F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("b"), F.col("label").alias("lb"), F.col("mark").alias("mb")))
        rep = named.groupBy("key").agg(pick.alias("pick")).select("key", "pick.b", "pick.lb", "pick.mb")
        pairs = named.select("key", F.col("node").alias("a"), F.col("label").alias("la"), F.col("mark").alias("ma")).join(rep, "key").where("la <> lb")
        found = verify(pairs.drop("key"))
        links = _stars(found) if labels is None else found.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        labels = _joined(labels, links, scratch)
        named = keys.join(labels, "node", "left").select("key", "node", "mark", F.coalesce("label", "node").alias("label"))
    if refine:
        many = scratch.save(bucket_labels(named).where(F.col("n") > FULL))
        small = named.join(many.select("key"), "key", "left_anti").select("key", "node", "label", "mark")
        met = [_inside(small, near or (lambda x, y: F.lit(True)))]
        if not many.isEmpty():
            full = named.join(many.where("lo <> hi").select("key"), "key", "left_semi").select("key", "node", "label", "mark")
            met.append(_met(*_sides(scratch.save(open_buckets(refine(full).distinct())))))
    else:
        met = [_met(*_sides(scratch.save(open_buckets(named))))]
    pairs = reduce(DataFrame.unionAll, met)
    rest = verify(pairs).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    return _joined(labels, rest, scratch)
