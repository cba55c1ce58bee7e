"""Periodic runs by the linear tandem-repeat method of Gusfield and Stoye.

A word of a run of four periods lies in a three-word window that its text holds three times or more, so a text is first cut to the
stretches that such windows cover; prose loses nearly all of itself there. The stretches of a batch of texts, each word told apart by its
text and a symbol of its own between any two, form one string, over which the method runs:

1. Ranks of all substrings of 2**k words give longest common extensions to both sides, the suffix array and the suffix tree.
2. The tree's nodes with their first leaves give the Lempel-Ziv blocks. Two scans of each block, with one common extension to either side for
   each period, yield squares that cover the leftmost occurrence of every square.
3. Each such square is located in the tree by climbing from its leaf; from there walks along suffix links, a letter further at a
   time, mark the locations of its rotations until they meet one that is marked: the complete vocabulary of squares.
4. The leaves under a marked location are all occurrences of its square; occurrences of one period that start at consecutive words merge
   into a run.

Squares whose root is itself a repetition are left out from the start: their runs are those of the shorter root.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.runtime import ship

#: Texts are split into words a piece of this many bytes at a time.
PIECE = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"


class Extensions:
    """ranks[k][i] numbers x[i : i + 2**k] in order, runs over the end being shorter and all different; 0 stands for the end."""

    def __init__(self, x: np.ndarray):
        self.n = n = len(x)
        first = np.zeros(n + 1, dtype=np.int64)
        first[:n] = np.unique(x, return_inverse=True)[1] + 1
        self.ranks = [first.astype(np.int32)]
        step = 1
        while first.max() < n:
            after = np.zeros(n, dtype=np.int64)
            after[: max(0, n - step)] = first[step:n]
            key = first[:n] * (n + 1) + after
            first[:n] = np.unique(key, return_inverse=True)[1] + 1
            self.ranks.append(first.astype(np.int32))
            step *= 2
        self.rank = self.ranks[-1][:n].astype(np.int64) - 1

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of x[i:] and x[j:], i and j being different."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.ranks) - 2, -1, -1):
            step = (self.ranks[k][i] == self.ranks[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of x[: i + 1] and x[: j + 1]."""
        i, j = i + 1, j + 1
        begin = i.copy()
        for k in range(len(self.ranks) - 2, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            inside = (a >= 0) & (b >= 0)
            step = (inside & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return begin - i


class SuffixTree:
    """The suffix tree from the suffix array: leaves 0 to n-1 in the array's order, inner nodes from n on, the root first.

    depth, lo and hi (a node's leaves), parent, first (a node's least text position), and the suffix links of the inner nodes.
    """

    def __init__(self, ext: Extensions):
        n = ext.n
        self.rank = ext.rank
        self.sa = sa = np.empty(n, dtype=np.int64)
        sa[ext.rank] = np.arange(n)
        common = np.zeros(n + 1, dtype=np.int64)
        if n > 1:
            common[1:n] = ext.forward(sa[:-1], sa[1:])
        common[n] = -1
        depth, lo, hi, parent, first = array("q", [0]), array("q", [0]), array("q", [n]), array("q", [0]) * n, array("q", [n])
        above = array("q", [-1])
        position = array("q", sa.tobytes())
        stack = [0]
        for r in range(1, n + 1):
            shared = common[r]
            node, least, begin, leaf = r - 1, position[r - 1], r - 1, True
            while True:
                top = stack[-1]
                if depth[top] > shared and len(stack) > 1:
                    if leaf:
                        parent[node] = top
                        leaf = False
                    else:
                        above[node] = top
                    if least < first[top]:
                        first[top] = least
                    stack.pop()
                    hi[top] = r
                    node, least, begin = top, first[top], lo[top]
                    continue
                if depth[top] < shared:
                    top = len(depth)
                    depth.append(shared)
                    lo.append(begin)
                    hi.append(n)
                    first.append(n)
                    above.append(-1)
                    stack.append(top)
                if leaf:
                    parent[node] = top
                else:
                    above[node] = top
                if least < first[top]:
                    first[top] = least
                break
        inner = lambda a: np.frombuffer(a, dtype=np.int64)
        self.n, self.size = n, n + len(depth)
        self.depth = np.concatenate([n - sa, inner(depth)])
        self.lo = np.concatenate([np.arange(n), inner(lo)])
        self.hi = np.concatenate([np.arange(1, n + 1), inner(hi)])
        self.parent = np.concatenate([inner(parent) + n if n else inner(parent), np.where(inner(above) >= 0, inner(above) + n, -1)])
        self.first = np.concatenate([sa, inner(first)])

    def links(self) -> np.ndarray:
        """The suffix link of each inner node, by its number less n; the root's is the root."""
        n, depth, lo = self.n, self.depth[self.n :], self.lo[self.n :]
        order = np.lexsort((lo, depth))
        key = (depth * (n + 1) + lo)[order]
        begin = np.minimum(self.sa[np.minimum(lo, n - 1)] + 1, n - 1)
        want = np.maximum(depth - 1, 0) * (n + 1) + self.rank[begin]
        out = order[np.searchsorted(key, want, side="right") - 1] + n
        out[0] = n
        return out


def blocks(tree: SuffixTree) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end: each is the longest that also starts earlier, one word at least."""
    up = tree.parent
    late = np.flatnonzero((up >= 0) & (tree.first != tree.first[np.maximum(up, 0)]))
    longest = np.zeros(tree.n, dtype=np.int64)
    longest[tree.first[late]] = tree.depth[up[late]]
    steps = array("q", np.maximum(longest, 1).tobytes())
    out, at = [], 0
    while at < tree.n:
        out.append(at)
        at += steps[at]
    return np.array([*out, tree.n], dtype=np.int64)


def _each(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index repeated by count, first[index] + 0, 1, ...)."""
    own = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return own, np.arange(len(own)) - before[own] + first[own]


def covering_squares(ext: Extensions, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cover the leftmost occurrence of each square: centres in a block, found from its end and from its start."""
    n = ext.n
    h, end = starts[:-1], starts[1:]
    size = end - h
    after = np.append(size[1:], 0)
    found = []
    own, k = _each(np.ones(len(h), dtype=np.int64), np.where(end < n, size, 0))
    at = end[own]
    ahead, back = ext.forward(at, at - k), ext.backward(at - 1, at - k - 1)
    begin = np.maximum(at - k - back, at - 2 * k + 1)
    good = (ahead + back >= k) & (ahead > 0)
    found.append((begin[good], k[good]))
    own, k = _each(np.ones(len(h), dtype=np.int64), np.minimum(size + after, n - h))
    at = h[own]
    ahead, back = ext.forward(at, at + k), ext.backward(at - 1, at + k - 1)
    # a centre at the block's very start counts here: the block before may be shorter than the period
    begin = np.maximum(at - back, at - k)
    good = (ahead + back >= k) & (begin + k < end[own])
    found.append((begin[good], k[good]))
    return tuple(np.concatenate(x) for x in zip(*found))


def primitive(ext: Extensions, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the roots of the squares are no repetitions themselves: no period that divides theirs by a prime."""
    out = np.ones(len(start), dtype=bool)
    rest = period.copy()
    d = 2
    while len(rest) and d * d <= rest.max():
        hit = rest % d == 0
        if hit.any():
            part = period[hit] // d
            out[hit] &= ext.forward(start[hit], start[hit] + part) < 2 * period[hit] - part
            while hit.any():
                rest[hit] //= d
                hit = rest % d == 0
        d += 1
    left = (rest > 1) & out
    part = period[left] // rest[left]
    out[left] &= ext.forward(start[left], start[left] + part) < 2 * period[left] - part
    return out


def vocabulary(ext: Extensions, tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, period) of the locations of all squares that are rotations, step by step, of the given leftmost ones."""
    n = tree.n
    parent, depth, first = (array("q", a.tobytes()) for a in (tree.parent, tree.depth, tree.first))
    sa, rank, x = array("q", tree.sa.tobytes()), array("q", tree.rank.tobytes()), ext.ranks[0].tolist()
    lo, link = array("q", tree.lo.tobytes()), array("q", tree.links().tobytes())
    # children by (parent, first word of the edge)
    child = np.flatnonzero(tree.parent >= 0)
    up = tree.parent[child]
    width = np.int64(max(x) + 1)
    word = ext.ranks[0][np.minimum(tree.sa[tree.lo[child]] + tree.depth[up], n)].astype(np.int64)
    key = (up - n) * width + word
    order = np.argsort(key, kind="stable")
    edge, below, width = array("q", key[order].tobytes()), array("q", child[order].tobytes()), int(width)
    marked: set[tuple[int, int]] = set()
    todo = []
    order = np.lexsort((-period, start))
    leaf, node = -1, 0
    for i, k in zip(start[order].tolist(), period[order].tolist()):
        if i != leaf:
            leaf, node = i, rank[i]
        # up from the leaf for as long as this is the leftmost suffix below
        while node >= 0 and depth[parent[node]] >= 2 * k and first[parent[node]] == i:
            node = parent[node]
        if depth[parent[node]] < 2 * k and (node, k) not in marked:
            marked.add((node, k))
            todo.append((i, node, k))
    for i, node, k in todo:
        while True:
            length, letter = 2 * k - 1, x[i]
            top = parent[node]
            at = link[top - n]
            # down to where the square without its first word ends
            while depth[at] < length:
                at = below[bisect_left(edge, (at - n) * width + x[i + 1 + depth[at]])]
            if depth[at] > length:
                i = sa[lo[at]]
                if x[i + length] != letter:
                    break
            else:
                want = (at - n) * width + letter
                j = bisect_left(edge, want) if at >= n else len(edge)
                if j == len(edge) or edge[j] != want:
                    break
                at = below[j]
                i = sa[lo[at]]
            node = at
            if (node, k) in marked:
                break
            marked.add((node, k))
    found = np.array(list(marked), dtype=np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def runs(x: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of two periods or more of x, by period, then start."""
    if len(x) < 2:
        return np.zeros((0, 3), dtype=np.int64)
    ext = Extensions(x)
    tree = SuffixTree(ext)
    start, period = covering_squares(ext, blocks(tree))
    good = primitive(ext, start, period)
    node, period = vocabulary(ext, tree, start[good], period[good])
    own, at = _each(tree.lo[node], tree.hi[node] - tree.lo[node])
    key = np.sort(period[own] * (len(x) + 1) + tree.sa[at])
    cut = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    period, begin = key[cut] // (len(x) + 1), key[cut] % (len(x) + 1)
    count = np.diff(np.append(cut, len(key)))
    return np.stack([begin, count - 1 + 2 * period, period], axis=1)


def stretches(ids: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of `least` words or more that are covered by three-word windows which their text holds three times or more.

    Windows are counted by a hash; a chance agreement only makes a stretch longer.
    """
    n = len(ids)
    none = np.zeros(0, dtype=np.int64)
    if n < least:
        return none, none
    h = np.zeros(n - 2, dtype=np.uint64)
    for part in (doc[:-2], ids[:-2], ids[1:-1], ids[2:]):
        h = (h + part.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    bits = max(10, int(8 * n).bit_length())
    h = (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)
    many = (np.bincount(h, minlength=1 << bits)[h] >= 3) & (doc[:-2] == doc[2:])
    covered = np.zeros(n + 2, dtype=bool)
    for j in range(3):
        covered[1 + j : n - 1 + j] |= many
    same = np.zeros(n + 1, dtype=bool)
    same[1:n] = doc[1:] == doc[:-1]
    begins = np.flatnonzero(covered[1 : n + 1] & ~(covered[:n] & same[:n]))
    ends = np.flatnonzero(covered[1 : n + 1] & ~(covered[2 : n + 2] & same[1:])) + 1
    long = ends - begins >= least
    return begins[long], ends[long]


def long_runs(ids: np.ndarray, doc: np.ndarray, least: int, periods: int) -> np.ndarray:
    """(start, length, period) by start, then period, of the runs of at least `least` words and `periods` (4 or more) periods inside texts; ids are words, doc their texts."""
    begins, ends = stretches(ids, doc, least)
    if not len(begins):
        return np.zeros((0, 3), dtype=np.int64)
    own, at = _each(begins, ends - begins)
    # a symbol of its own after each stretch
    to = np.arange(len(at)) + own
    x = np.empty(len(at) + len(begins), dtype=np.int64)
    gap = np.ones(len(x), dtype=bool)
    gap[to] = False
    x[to] = doc[at] * (ids.max() + 1) + ids[at]
    x[gap] = -1 - np.arange(len(begins))
    word = np.empty(len(x), dtype=np.int64)
    word[to] = at
    found = runs(x)
    found = found[found[:, 1] >= np.maximum(least, periods * found[:, 2])]
    found[:, 0] = word[found[:, 0]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _split(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    a, n = 0, len(text)
    while a < n:
        b = min(n, a + PIECE)
        while b < n and text[b] not in _SPACE:
            b += 1
        yield text[a:b].split()
        a = b


def _digest(lines) -> str:
    out = hashlib.sha256()
    for x in lines:
        out.update(x)
    return out.hexdigest()


def _joined(groups: Iterator[list[bytes]]) -> Iterator[bytes]:
    first = True
    for words in groups:
        if words:
            yield (b"" if first else b" ") + b" ".join(words)
            first = False


def _best(found: list[list[int]]) -> list[int]:
    """The run of the greatest length / period; ties: smallest start, then period."""
    top = found[0]
    for run in found[1:]:
        if run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


COLUMNS = {
    "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "starts": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "periods": pa.list_(pa.int64()),
}
_KINDS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, starts array<long>, lengths array<long>, periods array<long>"


def _rows(texts: list[bytes], least: int, periods: int) -> list[list]:
    known: dict[bytes, int] = {}
    ids, counts = array("i"), []
    for text in texts:
        before = len(ids)
        for words in _split(text):
            ids.extend([known.setdefault(w, len(known)) for w in words])
        counts.append(len(ids) - before)
    ids = np.frombuffer(ids, dtype=np.int32).astype(np.int64) if len(ids) else np.zeros(0, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    found = long_runs(ids, np.repeat(np.arange(len(texts)), counts), least, periods)
    of = np.searchsorted(first, found[:, 0], side="right") - 1
    vocabulary, out = list(known) if len(found) else [], []
    for i, text in enumerate(texts):
        own = found[np.searchsorted(of, i) : np.searchsorted(of, i, side="right")] - np.array([first[i], 0, 0])
        if not len(own):
            out.append([0, None, None, None, None, _digest(()), _digest(_joined(_split(text))), [], [], []])
            continue
        edge = np.zeros(counts[i] + 1, dtype=np.int64)
        np.add.at(edge, own[:, 0] + own[:, 2], 1)
        np.add.at(edge, own[:, 0] + own[:, 1], -1)
        kept = ids[first[i] : first[i + 1]][np.cumsum(edge[:-1]) == 0]
        groups = ([vocabulary[k] for k in kept[a : a + PIECE].tolist()] for a in range(0, len(kept), PIECE))
        rows = own.tolist()
        start, length, period = _best(rows)
        lines = (b"%d,%d,%d\n" % tuple(r) for r in rows)
        out.append([len(rows), start, length, period, 1000 * length // period, _digest(lines), _digest(_joined(groups)), *(own[:, j].tolist() for j in range(3))])
    return out


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, periods: int = 4) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, starts, lengths, periods) for each row of df.

    A run is a stretch of consecutive words with smallest period q, of at least max(least, periods * q) words (periods: 4 or more), that no neighbouring word
    extends. start, length, period and exponent_milli (1000 * length / period, rounded down) are of the run with the greatest length / period (ties:
    smallest start, then period), null without runs. starts, lengths and periods list all runs by start, then period; runs_sha256 is of their
    `start,length,period` lines. collapsed_sha256 is of the words that no run holds after its first period, joined by one space.

    Null and empty texts have no words and no runs. Rows that repeat are judged each on its own, ids may be null or repeat, and an empty table gives an
    empty table. Only the two named columns are read. A text is judged whole in one task, in memory in proportion to it; texts of a batch
    share at most a few MB.
    """
    if periods < 4 or least < 6:
        raise ValueError("stretches are cut for runs of at least four periods and six words")
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
            a = 0
            while a < len(column):
                b = max(a + 1, int(np.searchsorted(at, at[a] + 4 * PIECE, "right")) - 1)
                rows = _rows([x.as_py() for x in column.slice(a, b - a)], least, periods)
                made = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), COLUMNS.values())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *made], ["id", *COLUMNS])
                a = b

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, {_KINDS}")
