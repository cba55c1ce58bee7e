"""Hard negatives by dual-tree search.

Vectors are dealt to cells round pivots taken from a bounded sample, cells to blocks of a few thousand rows (a large cell, such as that of one vector that
a third of all rows have, to many), and each block gets a ball tree. Anchors are dealt alike and get trees of their own. For two nodes with centres c and d and radii r and s
all inner products lie within |c| s + |d| r + r s of c.d: a pair of nodes is dropped at once if that interval misses what every
anchor of the node looks for, first for whole blocks, in the join, then down both trees. Pairs of leaves are scored exactly, in
whole numbers, the most promising first, and what an anchor looks for narrows with each.

Positives are looked for above the score of the k-th that an anchor's own block holds; negatives in the interval of scores that each positive allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.runtime import Scratch, ship, shuffle_partitions

#: Rows of a leaf, of a block of candidates, of a block of anchors; leaves that are scored in one go.
LEAF = 64
BLOCK = 8192
GROUP = 1024
AT_ONCE = 16
#: At most this many cells, round pivots from a sample of at most this many rows.
CELLS = 64
SAMPLE = 2048
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_I8, _F8 = np.dtype("<i8"), np.dtype("<f8")


def pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    out = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(out) < min(count, len(sample)) and far.max() > 0:
        out.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[out[-1]]) ** 2).sum(axis=1))
    return sample[out]


def ball_tree(v: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the rows of v in the tree, and by node: begin, end, left (its left child, the right one follows; 0 in leaves), centre, radius."""
    v = v.astype(np.float64)
    order = np.arange(len(v))
    begin, end, left, centre, radius = [0], [len(v)], [], [], []
    for node in range(1 << 62):
        if node == len(begin):
            break
        own = order[begin[node] : end[node]]
        x = v[own]
        c = x.mean(axis=0)
        away = np.sqrt(((x - c) ** 2).sum(axis=1))
        centre.append(c)
        radius.append(away.max() * (1 + 1e-9) + 1e-6)
        if len(own) <= LEAF:
            left.append(0)
            continue
        p = x[away.argmax()]
        q = x[((x - p) ** 2).sum(axis=1).argmax()]
        along = x @ (q - p)
        # halfway between the two far points, unless that leaves one side with too few
        half = int((along < (along.min() + along.max()) / 2).sum())
        if min(half, len(own) - half) * 8 < len(own):
            half = len(own) // 2
        order[begin[node] : end[node]] = own[np.argpartition(along, half)]
        left.append(len(begin))
        begin += [begin[node], begin[node] + half]
        end += [begin[node] + half, end[node]]
    return order, {"begin": np.array(begin), "end": np.array(end), "left": np.array(left), "centre": np.array(centre), "radius": np.array(radius)}


class Side:
    """One block: rows, ids, labels, vectors, and its tree's nodes; of anchors also low and high, the scores looked for (a column for each interval)."""

    NAMES = {"row": _I8, "id": _I8, "label": _I8, "vector": _I8, "begin": _I8, "end": _I8, "left": _I8, "centre": _F8, "radius": _F8}

    def __init__(self, get):
        for name, kind in self.NAMES.items():
            setattr(self, name, np.frombuffer(get(name), dtype=kind))
        self.vector = self.vector.reshape(len(self.row), -1)
        self.centre = self.centre.reshape(len(self.begin), -1)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        longest = float(np.sqrt((self.vector.astype(np.float64) ** 2).sum(axis=1)).max())
        self.longest, self.exact = longest, self.vector.astype(np.float64)

    def windows(self, low: bytes, high: bytes) -> None:
        self.low, self.high = (np.frombuffer(x, dtype=_I8).reshape(len(self.row), -1).copy() for x in (low, high))


def _pairs(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf of a, leaf of b, bound of their inner products) of the pairs of leaves that hold a score looked for."""
    least = np.array([a.low[s:e].min() for s, e in zip(a.begin, a.end)])
    most = np.array([a.high[s:e].max() for s, e in zip(a.begin, a.end)])
    x, y = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    done = []
    while len(x):
        middle = np.einsum("ij,ij->i", a.centre[x], b.centre[y])
        reach = a.norm[x] * b.radius[y] + b.norm[y] * a.radius[x] + a.radius[x] * b.radius[y]
        reach += 1 + 1e-9 * (np.abs(middle) + reach)
        top = middle + reach
        open_ = (top >= least[x]) & (middle - reach <= most[x])
        x, y, top = x[open_], y[open_], top[open_]
        la, lb = a.left[x], b.left[y]
        ends = (la == 0) & (lb == 0)
        done.append((x[ends], y[ends], top[ends]))
        x, y, la, lb = x[~ends], y[~ends], la[~ends], lb[~ends]
        # the larger ball of the two is split
        first = (lb == 0) | ((la > 0) & (a.radius[x] > b.radius[y]))
        x, y = (
            np.concatenate([la[first], la[first] + 1, x[~first], x[~first]]),
            np.concatenate([y[first], y[first], lb[~first], lb[~first] + 1]),
        )
    return tuple(np.concatenate(p) for p in zip(*done))


def _best(group: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each group by falling score, then id and row."""
    order = np.lexsort((row, id_, -score, group))
    own = group[order]
    start = np.flatnonzero(np.diff(own, prepend=-1))
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[rank < k]


def search(a: Side, b: Side, k: int, same: bool) -> list[np.ndarray]:
    """[position in a, interval, score, id, row] of each anchor's first k candidates in each interval, of its own label (same) or of others."""
    x, y, top = _pairs(a, b)
    plain = a.longest * b.longest < 2**52
    out = [np.zeros(0, dtype=np.int64) for _ in range(5)]
    for leaf in np.unique(x):
        s, e = a.begin[leaf], a.end[leaf]
        mine = np.flatnonzero(x == leaf)
        mine = mine[np.argsort(-top[mine], kind="stable")]
        low, high = a.low[s:e].copy(), a.high[s:e]
        width = low.shape[1]
        best = [np.zeros(0, dtype=np.int64) for _ in range(4)]
        for at in range(0, len(mine), AT_ONCE):
            part = mine[at : at + AT_ONCE]
            part = part[top[part] >= low.min()]
            if not len(part):
                break
            c = np.concatenate([np.arange(b.begin[j], b.end[j]) for j in y[part]])
            scores = (a.exact[s:e] @ b.exact[c].T).astype(np.int64) if plain else a.vector[s:e] @ b.vector[c].T
            fits = (a.label[s:e, None] == b.label[c]) == same
            if same:
                fits &= a.row[s:e, None] != b.row[c]
            for w in range(width):
                good = fits & (scores >= low[:, w, None]) & (scores <= high[:, w, None])
                if len(c) > k:
                    # entries below the k-th best of this part are not needed
                    good &= scores >= np.partition(np.where(good, scores, _LOW), len(c) - k, axis=1)[:, len(c) - k, None]
                i, j = np.nonzero(good)
                if not len(i):
                    continue
                new = [i * width + w, scores[i, j], b.id[c[j]], b.row[c[j]]]
                best = [np.concatenate(p) for p in zip(best, new)]
                keep = _best(*best, k)
                best = [p[keep] for p in best]
            group, count = np.unique(best[0], return_counts=True)
            if len(group):
                last = np.minimum.reduceat(best[1], np.flatnonzero(np.diff(best[0], prepend=-1)))
                full = group[count >= k]
                low[full // width, full % width] = np.maximum(low[full // width, full % width], last[count >= k])
        if len(best[0]):
            made = [best[0] // width + s, best[0] % width, *best[1:]]
            out = [np.concatenate(p) for p in zip(out, made)]
    return out


_BLOCK_KIND = "row binary, id binary, label binary, vector binary, begin binary, end binary, left binary, centre binary, radius binary, middle array<double>, reach double"


def _tree_columns(row, id_, label, v) -> tuple[np.ndarray, list]:
    order, nodes = ball_tree(v)
    arrays = [row[order], id_[order], label[order], v[order], *nodes.values()]
    blobs = [np.ascontiguousarray(x.astype(kind)).tobytes() for x, kind in zip(arrays, Side.NAMES.values())]
    return order, [*blobs, nodes["centre"][0].tolist(), float(nodes["radius"][0])]


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _vectors(column, width: int) -> np.ndarray:
    """A row for each list, filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


_BLOCK_FIELDS = [(n, pa.binary()) for n in Side.NAMES] + [("middle", pa.list_(pa.float64())), ("reach", pa.float64())]


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of the rows of which `anchor` holds.

    A component x counts as floor(scale * x); scores are inner products. An anchor's positives are its first `positives` other rows of the same label by falling score, then
    id; for each, its negatives are the first `negatives` rows of other labels whose scores are at least `low` percent of the positive's and no higher. rank counts from 1.

    Rows with a null label or vector, or with a null or non-finite component, take no part; a row with a null id is no anchor and comes last among equal scores. Vectors
    that are shorter than others count as filled with zeros. Rows that repeat are rows like any others, each an anchor where that holds. Ids and labels are whole numbers;
    scaled components are below 2**24 in size, so that scores fit in 64 bits. An empty table gives an empty table; columns other than those named and those in `anchor` are not read.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "negatives")
    x = F.col(f"`{vector_col}`")
    good = F.col(f"`{label_col}`").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    named = df.where(F.coalesce(good, F.lit(False))).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("long")).alias("v"),
        (F.coalesce(anchor, F.lit(False)) & F.col(f"`{id_col}`").isNotNull()).alias("anchor"),
    )
    points = scratch.save(named.withColumn("row", F.monotonically_increasing_id()))
    n, n_anchors, width = points.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1)), F.max(F.size("v"))).first()
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], kinds)
    width = max(1, width)

    sample = points.select("v").orderBy(F.xxhash64("row")).limit(SAMPLE).toArrow().column("v")
    pivot = pivots(_vectors(sample, width).astype(np.float64), min(CELLS, max(1, n // BLOCK * 2)))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column(batch.schema.get_field_index("v")), width).astype(np.float64)
            near = (v @ (2 * pivot.T) - (pivot**2).sum(axis=1)).argmax(axis=1) if len(v) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "cell"])

    dealt = scratch.save(points.mapInArrow(cells, "id long, label long, v array<long>, anchor boolean, row long, cell int"))
    counts = {r.cell: (r.n, r.m) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("m")).collect()}
    # small cells share a group of anchors, large cells have several blocks
    parts = {c: -(-rows // BLOCK) for c, (rows, _) in counts.items()}
    group, filled = {}, 0
    for c, (_, m) in sorted(counts.items()):
        group[c] = (filled // GROUP, -(-m // GROUP))
        filled += m
    begins = {c: sum(parts[b] for b in parts if b < c) for c in parts}
    look = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("cell"))
    chunk = lambda many: F.pmod(F.xxhash64("row"), many.cast("long"))

    def block(t: pa.Table) -> pa.Table:
        row, id_, label = _numbers(t, "row"), t.column("id").combine_chunks().fill_null(_HIGH).to_numpy().astype(np.int64), _numbers(t, "label")
        order, columns = _tree_columns(row, id_, label, _vectors(t.column("v"), width))
        anchors = t.column("anchor").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)[order]
        made = [pa.array([x], kind) for x, (_, kind) in zip(columns, _BLOCK_FIELDS)]
        # numbered from 0 on, so that they can be dealt evenly
        return pa.table([pa.array([begins[t["cell"][0].as_py()] + t["part"][0].as_py()]), *made, pa.array([np.flatnonzero(anchors).astype(_I8).tobytes()], pa.binary())], names=["block", *[f for f, _ in _BLOCK_FIELDS], "anchors"])

    blocks = dealt.withColumn("part", chunk(look(parts))).groupBy("cell", "part").applyInArrow(block, f"block long, {_BLOCK_KIND}, anchors binary")
    blocks = scratch.save(blocks)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each anchor with the score that its own block's positives leave to beat."""
        for batch in batches:
            for r in range(batch.num_rows):
                b = Side(lambda name: batch.column(name)[r].as_py())  # noqa: B023
                own = np.frombuffer(batch.column("anchors")[r].as_py(), dtype=_I8)
                if not len(own):
                    continue
                for at in range(0, len(own), GROUP):
                    _, columns = _tree_columns(own[at : at + GROUP], b.id[own[at : at + GROUP]], b.label[own[at : at + GROUP]], b.vector[own[at : at + GROUP]])
                    a = Side(dict(zip(Side.NAMES, columns)).__getitem__)
                    place = a.row
                    a.row = b.row[place]
                    a.low, a.high = np.full((len(place), 1), _LOW), np.full((len(place), 1), _HIGH)
                    who, _, score, _, _ = search(a, b, positives, True)
                    floor = np.full(len(place), _LOW)
                    group, count = np.unique(who, return_counts=True)
                    if len(group):
                        floor[group] = np.where(count >= positives, np.minimum.reduceat(score, np.flatnonzero(np.diff(who, prepend=-1))), _LOW)
                    lists = pa.ListArray.from_arrays(np.arange(len(place) + 1, dtype=np.int32) * width, a.vector.ravel())
                    one = lambda v: pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32), v)
                    yield pa.RecordBatch.from_arrays([pa.array(a.row), pa.array(a.id), pa.array(a.label), lists, one(floor), one(np.full(len(place), _HIGH))], ["row", "id", "label", "v", "low", "high"])

    own_kind = "row long, id long, label long, v array<long>, low array<long>, high array<long>"
    looking = scratch.save(blocks.mapInArrow(home, own_kind).join(dealt.where("anchor").select("row", "cell"), "row"))

    n_blocks = sum(parts.values())
    slots = min(n_blocks, 4 * shuffle_partitions(spark))

    def found(looking: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, part, score, id, row) of the first k of each anchor (row) and interval over all blocks; looking: own_kind and cell."""

        def tree(t: pa.Table) -> pa.Table:
            row, id_, label = (_numbers(t, c) for c in ("row", "id", "label"))
            lows, highs = t.column("low").combine_chunks(), t.column("high").combine_chunks()
            n_parts = int(np.diff(lows.offsets.to_numpy()).max())
            # an interval that an anchor lacks holds nothing
            low_ = np.full((len(row), n_parts), _HIGH)
            high_ = np.full((len(row), n_parts), _LOW)
            there = np.arange(n_parts) < np.diff(lows.offsets.to_numpy())[:, None]
            low_[there], high_[there] = lows.flatten().to_numpy(), highs.flatten().to_numpy()
            order, columns = _tree_columns(row, id_, label, _vectors(t.column("v"), width))
            made = [pa.array([x], kind) for x, (_, kind) in zip(columns, _BLOCK_FIELDS)]
            more = [pa.array([x[order].tobytes()], pa.binary()) for x in (low_, high_)] + [pa.array([float(low_.min())]), pa.array([float(high_.max())])]
            return pa.table([*made, *more], names=[*[f for f, _ in _BLOCK_FIELDS], "low", "high", "least", "most"])

        first, many = look({c: g for c, (g, _) in group.items()}), look({c: max(1, m) for c, (_, m) in group.items()})
        trees = looking.withColumn("part", first + chunk(many)).groupBy("part").applyInArrow(tree, f"{_BLOCK_KIND}, low binary, high binary, least double, most double")
        trees = scratch.save(trees)
        names = trees.columns
        left = trees.select(*[F.col(c).alias(f"a_{c}") for c in names], F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        right = blocks.select(*[F.col(c).alias(f"b_{c}") for c in names if c in blocks.columns], (F.col("block") % slots).cast("int").alias("slot"))
        length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, z: s + z * z))
        middle = F.aggregate(F.zip_with("a_middle", "b_middle", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
        reach = length("a_middle") * F.col("b_reach") + length("b_middle") * F.col("a_reach") + F.col("a_reach") * F.col("b_reach")
        slack = 1 + 1e-9 * (F.abs(middle) + reach)
        # a tree has a row for each slot, of which a plan's estimate knows nothing: neither side may be broadcast, as the driver would hold them all
        met = left.join(right.hint("merge"), "slot").where((middle + reach + slack >= F.col("a_least")) & (middle - reach - slack <= F.col("a_most")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    get = lambda side: lambda name: batch.column(f"{side}_{name}")[r].as_py()  # noqa: E731,B023
                    a, b = Side(get("a")), Side(get("b"))
                    a.windows(get("a")("low"), get("a")("high"))
                    who, part, score, id_, row = search(a, b, k, same)
                    yield pa.RecordBatch.from_arrays([pa.array(a.row[who]), pa.array(part), pa.array(score), pa.array(id_), pa.array(row)], ["anchor", "part", "score", "id", "row"])

        made = met.mapInArrow(run, "anchor long, part long, score long, id long, row long")
        w = Window.partitionBy("anchor", "part").orderBy(F.desc("score"), "id", "row")
        return scratch.save(made.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))

    best = found(looking, positives, True)
    # each positive with the scores that its negatives may have; whole-number division that rounds up
    allowed = -F.floor(-F.col("score") * low / F.lit(100))
    each = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", allowed.alias("low"), F.col("score").alias("high")))).alias("p"))
    wanted = looking.drop("low", "high").join(each.withColumnRenamed("anchor", "row"), "row").select("row", "id", "label", "v", F.col("p.low").alias("low"), F.col("p.high").alias("high"), "cell")
    hard = found(scratch.save(wanted), negatives, False)
    ids = lambda c: F.when(F.col(c) != _HIGH, F.col(c))
    named = best.select("anchor", (F.col("rank") - 1).alias("part"), ids("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(named, ["anchor", "part"]).join(looking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", ids("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
