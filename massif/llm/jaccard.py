"""Jaccard join of word n-grams with adaptive multi-match prefixes, and its connected components.

A document is its set of distinct shingles, known by 64-bit hashes; documents of equal sets are one node. In any order of all shingles, two sets
with |A & B| >= least % of |A | B| share a shingle among their first n - ceil(least * n / 100) + 1 ones, n being a set's size, and of
longer prefixes they must share correspondingly more. The order starts as that of the hashes. A shingle costs as many candidates as nodes have it in
their first ones; where more than FULL do, it is too dear to look up. A node lengthens its prefix by one shingle for each dear one in it, so
that as many cheap ones are left as the shortest prefix has; that is the same as to put the dear ones last in the order, so no link is lost.
What a pair must share before it is verified follows from both sizes: the larger set takes its whole prefix, the smaller one what is left of its
own, and of these they must share n1 + n2 less the union's bound.

A few nodes run out of the first shingles that are kept for all; their whole sets are read again, and what is dear among these too goes
last. Sets with too few cheap shingles of their own (most of their text is common to many) fall back on the dear ones, the rarest
first. These meet one another through one representative a bucket, the set with the fewest cheap shingles first, before buckets that
still hold several components are compared. Candidate pairs are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.llm.components import linked_components
from massif.llm.words import mixed, pieces, spans
from massif.operators.graph import components
from massif.runtime import Scratch, ship

SHINGLE = 5
LEAST = 80
#: A shingle that more nodes have among their first ones is dear.
FULL = 16
#: Tables of up to this many rows of two numbers are broadcast; larger ones meet through a shuffle.
SMALL = 200_000
#: Sizes of sets are below this power of two.
_BITS = 31


def prefix_size(n, least: int = LEAST):
    """How many first shingles of a set of n hold one of any set that it is linked with."""
    return n - (n * least + 99) // 100 + 1


def kept_size(n, least: int = LEAST):
    """How many first shingles are kept for every set."""
    p = prefix_size(n, least)
    return np.minimum(n, p + p // 4 + 8)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rising signed hashes of the distinct shingles of a text, A-Z lower-cased; of all its words if they are fewer)."""
    for a, b, w in pieces(column, lower=True):
        h = w.hashes()
        for i in range(b - a):
            own = h[w.first[i] : w.first[i + 1]]
            yield a + i, np.unique(spans(own, min(width, max(1, len(own)))).view(np.int64))


def _sketch(width: int, least: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            h = np.zeros((2, batch.num_rows), dtype=np.uint64)
            parts, size = [], np.zeros(batch.num_rows + 1, dtype=np.int64)
            for i, tokens in shingle_sets(batch.column(1), width):
                n[i] = len(tokens)
                raw = tokens.view(np.uint64)
                h[0, i] = mixed(raw).sum(dtype=np.uint64) ^ np.uint64(n[i])
                h[1, i] = mixed(~raw).sum(dtype=np.uint64)
                parts.append(tokens if whole else tokens[: kept_size(n[i], least)])
                size[i + 1] = len(parts[-1])
            tokens = pa.LargeListArray.from_arrays(np.cumsum(size), np.concatenate([np.zeros(0, dtype=np.int64), *parts])).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(n), tokens], ["id", "h1", "h2", "n", "tokens"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most SMALL rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _share(na: Column, nb: Column, least: int) -> Column:
    """The least number of shingles that linked sets of these sizes share."""
    return F.ceil((na + nb) * least / F.lit(100 + least))


def _part(n: Column, least: int) -> Column:
    return F.ceil(n * least / F.lit(100))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """(id, n_shingles, component_id) for each row of df.

    A row's set is that of the distinct `width`-word shingles of its text, A-Z lower-cased; a text of fewer words is one shingle. Rows link when their sets' intersection has
    at least `least` percent (over 50) of their union; component_id is the smallest id that a row reaches, itself included. Null texts and texts without a word have
    an empty set, which is linked with nothing. Rows that repeat have equal sets and so are linked; an id that is null names no component unless no row of
    it has another. An empty table gives an empty table. Only the two named columns are read. Texts are read whole, one in memory at a time besides those of its batch.
    """
    if not 50 < least <= 100:
        raise ValueError("least must be over 50 and at most 100")
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "jaccard")
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    hashed = source.select(F.struct("id", F.xxhash64("text").alias("th")).alias("id"), "text")
    made = hashed.mapInArrow(_sketch(width, least, False), f"id struct<id:{kind},th:long>, h1 long, h2 long, n long, tokens array<long>")
    docs = scratch.save(made.select("id.id", "id.th", "h1", "h2", "n", "tokens"))
    nodes = docs.where("n > 0").groupBy("h1", "h2").agg(F.first("n").alias("n"), F.min("th").alias("th"), F.first("tokens").alias("tokens"))
    nodes = scratch.save(nodes.withColumn("node", F.monotonically_increasing_id()))
    named = scratch.save(docs.select("id", "h1", "h2", "n"))
    scratch.drop(docs)
    docs = named
    size = nodes.select("node", "n")
    p = F.col("n") - _part(F.col("n"), least) + 1

    def whole_sets(wanted: DataFrame) -> DataFrame:
        """(node, n, tokens) with the whole sets of the nodes wanted (node, th, h1, h2): one text of each is read again."""
        texts = source.withColumn("th", F.xxhash64("text")).join(_small(wanted.select("th")), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
        sets = texts.mapInArrow(_sketch(width, least, True), "id long, h1 long, h2 long, n long, tokens array<long>")
        return scratch.save(sets.join(wanted.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "n", "tokens"))

    rows = nodes.select("node", F.posexplode("tokens").alias("pos", "token"))
    shared = scratch.save(rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"))
    # what is dear among the first shingles of all, and which nodes it leaves with too few cheap ones
    dear = scratch.save(shared.where(F.col("c") > FULL))
    hit = scratch.save(rows.join(_small(dear.select("token")), "token").select("node", "pos", "token"))
    lacking = lambda hits: nodes.join(hits.groupBy("node").agg(F.count("*").alias("m")), "node").where(F.size("tokens") - F.col("m") < p).select("node", "th", "h1", "h2")
    deep = scratch.save(lacking(hit))
    sets = whole_sets(deep)
    # what is dear among those nodes' whole sets
    more = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > FULL)
    more = scratch.save(more.join(dear.select("token"), "token", "left_anti"))
    hit = scratch.save(hit.unionAll(rows.join(_small(more.select("token")), "token").select("node", "pos", "token")))
    late = scratch.save(lacking(hit).join(deep.select("node"), "node", "left_anti"))
    sets = sets.unionAll(whole_sets(late))
    dear = scratch.save(dear.unionAll(more))
    read = scratch.save(deep.select("node").unionAll(late.select("node")))

    # the prefixes of nodes whose whole sets were read: cheap shingles by hash, then dear ones by number and hash
    order = Window.partitionBy("node").orderBy(F.col("c").isNotNull(), "c", "token")
    ranked = sets.select("node", "n", F.explode("tokens").alias("token")).join(dear, "token", "left").withColumn("pos", F.row_number().over(order) - 1)
    first = scratch.save(ranked.where(F.col("pos") < p).select("token", "node", "n", "pos", F.col("c").isNotNull().alias("dear")))
    bound = scratch.save(first.where("dear").select("node").distinct())
    # those of all others: shared shingles, less the dear ones before each
    known = shared.select("token").unionAll(first.select("token")).distinct().join(dear.select("token"), "token", "left_anti")
    cheap = rows.join(known, "token").join(_small(read), "node", "left_anti").select("node", "pos", "token", F.lit(0).alias("dear"))
    both = cheap.unionAll(hit.join(read, "node", "left_anti").select("node", "pos", "token", F.lit(1).alias("dear")))
    before = F.sum("dear").over(Window.partitionBy("node").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    others = both.withColumn("pos", (F.col("pos") - F.coalesce(before, F.lit(0))).cast("int")).where("dear = 0").join(size, "node").where(F.col("pos") < p)
    own = first.where("NOT dear").join(bound.withColumn("bound", F.lit(True)), "node", "left").select("token", "node", "n", "pos", F.coalesce("bound", F.lit(False)).alias("bound"))
    keys = scratch.save(others.select("token", "node", "n", "pos", F.lit(False).alias("bound")).unionAll(own))

    # pairs that share enough cheap shingles, one of the two at least having no dear one in its prefix
    side = lambda x: keys.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "pos", "bound")])
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    at = F.when(F.col("n_a") <= F.col("n_b"), F.col("pos_a")).otherwise(F.col("pos_b"))
    met = side("a").join(side("b"), "token").where("node_a < node_b AND NOT (bound_a AND bound_b)").where(at <= low - _part(high, least))
    pairs = met.groupBy("node_a", "node_b", "n_a", "n_b").agg(F.count("*").alias("m"))
    pairs = pairs.where(F.col("m") >= _share(F.col("n_a"), F.col("n_b"), least) - _part(high, least) + 1)
    pairs = scratch.save(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    for done in (shared, hit, keys):
        scratch.drop(done)

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """pairs (a, b, ...) whose whole sets are near enough."""
        x = sets.select(F.col("node").alias("a"), F.col("n").alias("_na"), F.col("tokens").alias("_ta"))
        y = sets.select(F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("tokens").alias("_tb"))
        common = F.size(F.array_intersect("_ta", "_tb")).cast("long")
        return pairs.join(x, "a").join(y, "b").where(100 * common >= least * (F.col("_na") + F.col("_nb") - common)).drop("_na", "_ta", "_nb", "_tb")

    paired = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    links = linked(pairs, whole_sets(scratch.save(nodes.join(paired, "node", "left_semi").select("node", "th", "h1", "h2"))))

    # nodes bound to dear shingles among themselves: a mark holds size and place in the order
    crowd = first.join(bound, "node", "left_semi")
    crowd = scratch.save(crowd.select(F.col("token").alias("key"), "node", F.shiftleft("n", _BITS).bitwiseOR(F.col("pos").cast("long")).alias("mark")))
    fewest = crowd.join(first.where("NOT dear").groupBy("node").agg(F.count("*").alias("rank")), "node", "left")
    crowd = fewest.select("key", "node", "mark", F.coalesce("rank", F.lit(0)).alias("rank"))
    bound_sets = scratch.save(sets.join(bound, "node", "left_semi"))

    def verify(pairs: DataFrame) -> DataFrame:
        na, nb = F.shiftright("ma", _BITS), F.shiftright("mb", _BITS)
        place = lambda m: F.col(m).bitwiseAND(F.lit((1 << _BITS) - 1))
        share = _share(na, nb, least)
        near = pairs.where((place("ma") <= na - share) & (place("mb") <= nb - share)).drop("ma", "mb").distinct()
        return linked(near, bound_sets)

    groups = linked_components(shared_only(crowd), verify, scratch)
    every = links.select("a", "b").unionAll(groups.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    labels = components(every, scratch)

    # the smallest id of each component, by sets
    heads = docs.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("head"))
    named = nodes.select("h1", "h2", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(heads, ["h1", "h2"])
    named = scratch.save(named.select("h1", "h2", "label", "head"))
    smallest = named.groupBy("label").agg(F.min("head").alias("component_id"))
    of = scratch.save(named.join(smallest, "label").select("h1", "h2", "component_id"))
    full = docs.where("n > 0").select("id", "h1", "h2", "n").join(of, ["h1", "h2"]).select("id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionAll(docs.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def shared_only(keys: DataFrame) -> DataFrame:
    twice = keys.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    return keys.join(twice, "key", "left_semi")
