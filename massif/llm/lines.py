"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines within `edits` edits of one another have, among edits + 1 segments of the shorter, one that occurs unchanged in the
longer, shifted by few places. Each distinct line is indexed by its segments and probes the substrings that the lengths and the
positions allow (the multi-match-aware selection), one segment number at a time, so that a third of the keys lies on disk at once. Keys that
no two lines share are dropped. A key's rows hold a line's number and the parities of its letters' counts, of which an edit changes two
at most, and of its pairs of neighbouring words, of which it changes five; texts are joined only to candidate pairs whose parities allow a link, which are verified by a banded bit-parallel edit distance. Linked lines form classes; the first line of a class stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations, pairwise, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.llm.components import linked_components, shared_keys
from massif.runtime import Scratch

EDITS = 2
#: The longest common beginning or end that is cut off before the distance, less one; what is longer is compared by the distance as well.
_TRIM_BITS = 20
#: Pieces of a line for the finer keys of full buckets.
PIECES = 8
#: Letters whose counts' parities mark a line.
MARKED = "abcdefghijklmnopqrstuvwxyz0123456789 .,:;-/ABCDEFGHIJKLMNOPQRST"
#: Parities that one edit can change: those of two letters, and those of the pairs of neighbouring words that go and come where a space does.
LETTERS_CHANGED, PAIRS_CHANGED = 2, 5


def line_form(line: Column) -> Column:
    """White space at the ends goes, each run of it inside becomes one space."""
    return F.trim(_single_spaces(line))


def _single_spaces(text: Column) -> Column:
    """Each run of white space but line breaks becomes one space; most texts need no such change, which is soon seen."""
    odd = text.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | text.contains(c)
    return F.when(odd, F.regexp_replace(text, "[\\x20\\x09\\x0B-\\x0D]+", " ")).otherwise(text)


def allowed(chars: str, edits: int, chars_per_edit: int) -> str:
    """Edits between two lines of which the shorter has so many characters, in SQL."""
    return f"least({edits}, {chars} div {chars_per_edit})" if chars_per_edit else str(edits)


def probe_keys(part: int, edits: int, chars_per_edit: int = 0) -> Column:
    """Keys of a line (column `line`, length `chars`) for the segment number `part`: its own segment's, and those of shorter lines' that it may contain.

    One is null where some probe doesn't apply. A line that is too short for so many segments has empty ones, which all lines of nearly its
    length share.
    """
    out = []
    for gap in range(edits + 1):
        length = f"(chars - {gap})"
        most = allowed(length, edits, chars_per_edit)
        base, plain = f"({length} div ({most} + 1))", f"({most} + 1 - {length} % ({most} + 1))"  # segments of the smaller size come first
        size = f"cast({base} + if({part} >= {plain}, 1, 0) AS int)"
        for shift in range(-part, part + 1):
            if abs(shift - gap) <= edits - part:
                p = f"cast({part} * {base} + greatest(0, {part} - {plain}) + {1 + shift} AS int)"
                fits = f"{length} >= 0 AND {most} >= {max(gap, part, 1)} AND {abs(shift - gap)} <= {most} - {part} AND {p} >= 1 AND {p} + {size} - 1 <= chars"
                out.append(F.expr(f"if({fits}, xxhash64({length}, {part}, substring(line, {p}, {size})), NULL)"))
    return F.array_distinct(F.array(*out))


def run_keys(edits: int) -> Column:
    """Keys of a line (column `line`) of which two lines within `edits` edits share one, and few others do.

    Of PIECES equal pieces of the shorter line, edits damage as many as there are edits at most; the runs between those occur unchanged in the
    other line, each shifted by what the edits before it have put in or taken out. A key is all runs for one choice of damaged pieces, a
    line's own for no shift, and those that it has as the longer one for each way in which shifts can add up to the gap of the lengths.
    """
    ways = [
        (gap, *pieces, *shifts)
        for gap in range(edits + 1)
        for shifts in product(range(-edits, edits + 1), repeat=edits - 1)
        if sum(abs(b - a) for a, b in pairwise((0, *shifts, gap))) <= edits
        for pieces in combinations(range(PIECES), edits)
    ]
    names = ["gap", *(f"p{k}" for k in range(edits)), *(f"s{k}" for k in range(1, edits))]
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, way)]) for way in ways])
    chars = F.char_length("line")

    def key(way: Column) -> Column:
        size = chars - way["gap"]
        at = lambda piece: F.floor(piece * size / PIECES).cast("int")
        lows = [F.lit(0), *[at(way[f"p{k}"] + 1) for k in range(edits)]]
        highs = [*[at(way[f"p{k}"]) for k in range(edits)], size]
        shifts = [F.lit(0), *[way[f"s{k}"] for k in range(1, edits)], way["gap"]]
        runs = [F.substr(F.col("line"), lo + 1 + s, hi - lo) for lo, hi, s in zip(lows, highs, shifts)]
        return F.when(size >= 0, F.xxhash64(size, *[way[f"p{k}"] for k in range(edits)], *runs))

    return F.array_distinct(F.transform(table, key))


def parities(line: Column) -> Column:
    """(letters, pairs) of 64 bits each: which letters of MARKED occur an odd number of times, and which hashes of neighbouring words do. Swapped words leave the first alone, but not the second."""
    odd = lambda c: (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(1)).cast("long")
    letters = reduce(Column.bitwiseOR, [F.shiftleft(odd(c), k) for k, c in enumerate(MARKED)])

    def pairs(words: Column) -> Column:
        bit = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)).bitwiseAND(F.lit(63)).cast("int")
        flip = lambda m, i: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(i)))
        return F.when(F.size(words) < 2, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(words) - 2), F.lit(0).cast("long"), flip))

    return F.struct(letters.alias("letters"), _let(F.split(line, " "), pairs).alias("pairs"))


def may_link(a: Column, b: Column, edits: int) -> Column:
    """Whether the parities of two lines allow for so few edits."""
    apart = lambda c: F.bit_count(a.getField(c).bitwiseXOR(b.getField(c)))
    return (apart("letters") <= LETTERS_CHANGED * edits) & (apart("pairs") <= PAIRS_CHANGED * edits)


def _exploded(df: DataFrame) -> DataFrame:
    """df with a row for each value of its array `key`. The array is worked out below the generator, once: an inner explode would add a filter by it."""
    return df.withColumn("key", F.explode_outer("key")).where("key IS NOT NULL")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value being worked out once."""
    return F.transform(F.array(value), then)[0]


def edit_distance(x: Column, y: Column, edits: int) -> Column:
    """The edit distance of two strings where that is at most `edits`, some larger number otherwise.

    Common beginnings and ends go first. The rest is walked column by column over the 2 * edits + 1 diagonals around the main one, whose
    vertical differences are the bits of two numbers; the distance is read along the diagonal on which both texts end. It is one
    expression, so that a filter by it, wherever the optimiser puts that, works it out once.
    """
    band, whole = 2 * edits + 1, (1 << 2 * edits + 1) - 1
    part = lambda c, at, n: F.substr(c, (4 * at + 1).cast("int"), (4 * n).cast("int"))

    def common(t: Column, most: Column, at: Callable) -> Column:
        """How many characters agree, found from the largest power of two on; at gives the places in both texts of n characters after k."""
        def grown(k: Column, bit: Column) -> Column:
            n = F.call_function("shiftright", F.lit(1 << _TRIM_BITS), bit)
            i, j = at(k, n)
            return k + F.when((k + n <= most) & (part(t["u"], i, n) == part(t["v"], j, n)), n).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.lit(_TRIM_BITS)), F.lit(0), grown)

    def trimmed(t: Column) -> Column:
        least = F.least(t["m"], t["n"])

        def at_end(head: Column) -> Column:
            tail = common(t, least - head, lambda k, n: (t["m"] - k - n, t["n"] - k - n))
            return _let(tail, lambda tail: _let(rest(t, head, tail), walked))

        return _let(common(t, least, lambda k, n: (k, k)), at_end)

    def rest(t: Column, head: Column, tail: Column) -> Column:
        m, n = t["m"] - head - tail, t["n"] - head - tail
        # rows above the first match nothing
        above = F.lit(bytearray(b"\xff" * 4 * edits))
        return F.struct(F.concat(above, part(t["u"], head, m)).alias("u"), part(t["v"], head, n).alias("v"), m.alias("m"), n.alias("n"))

    def walked(t: Column) -> Column:
        m, n = t["m"], t["n"]

        def column(state: Column, j: Column) -> Column:
            vp, vn = state["vp"], state["vn"]

            def met(letter: Column) -> Column:
                bits = [F.when(part(t["u"], j + (k - 1), F.lit(1)) == letter, 1 << k).otherwise(0) for k in range(band)]
                return _let(reduce(lambda a, b: a + b, bits), after)

            def after(met: Column) -> Column:
                d0 = (met.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(met).bitwiseOR(vn).bitwiseAND(F.lit(whole))
                return _let(d0, moved)

            def moved(d0: Column) -> Column:
                hp = vn.bitwiseOR(F.lit(whole).bitwiseXOR(d0.bitwiseOR(vp)))
                hn, down = d0.bitwiseAND(vp), F.shiftright(d0, 1)
                new_vp = hn.bitwiseOR(F.lit(whole).bitwiseXOR(down.bitwiseOR(hp)))
                worse = F.when(d0.bitwiseAND(F.call_function("shiftleft", F.lit(1), m - n + edits)) == 0, 1).otherwise(0)
                return F.struct(new_vp.alias("vp"), down.bitwiseAND(hp).alias("vn"), (state["d"] + worse).alias("d"))

            return F.when(state["d"] > edits, state).otherwise(_let(part(t["v"], j - 1, F.lit(1)), met))

        begin = F.struct(F.lit(whole - ((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.greatest(m - n, F.lit(0)).alias("d"))
        return F.when(n == 0, m).otherwise(F.aggregate(F.sequence(F.lit(1), n), begin, column)["d"])

    texts = F.struct(F.encode(x, "UTF-32").alias("u"), F.encode(y, "UTF-32").alias("v"), F.char_length(x).alias("m"), F.char_length(y).alias("n"))
    return F.when(F.abs(F.char_length(x) - F.char_length(y)) > edits, edits + 1).otherwise(_let(texts, trimmed))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars_per_edit: int = 0) -> DataFrame:
    """(id, line_no, class_id, class_line, kept): a row for each line with a word, in its document's numbering from 0.

    class_id and class_line name the first line, by id and number, of the lines linked with it, over any number of steps, by at most `edits`
    edits of their forms (white space runs count as one space); kept is true for that one. Where chars_per_edit is not 0, the shorter line of a
    link must have that many characters for each edit, so that short lines link by fewer edits or only when equal. Null and empty texts
    have no lines. Ids that are null come first. Rows that share an id count as one document. An empty table gives an empty table. Lines
    are equal if their SHA-256 is.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "lines")
    text = _single_spaces(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    split = df.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    lines = split.select("id", "line_no", F.trim("line").alias("line")).where("line <> ''").withColumn("sha", F.unhex(F.sha2("line", 256)))
    distinct = lines.groupBy("sha").agg(F.min(F.struct("id", "line_no")).alias("head"), F.first("line").alias("line"))
    distinct = scratch.save(distinct.withColumn("node", F.monotonically_increasing_id()))
    sized = distinct.select("node", "line", F.char_length("line").alias("chars"))
    met = []
    for part in range(edits + 1):
        keys = scratch.save(_exploded(sized.select("node", probe_keys(part, edits, chars_per_edit).alias("key"))))
        met.append(scratch.save(shared_keys(keys)))
        scratch.drop(keys)
    met = reduce(DataFrame.unionAll, met)
    texts = scratch.save(distinct.select("node", "line").join(met.select("node").distinct(), "node", "left_semi"))
    keys = scratch.save(met.join(texts.select("node", parities(F.col("line")).alias("mark")), "node").select("key", "node", "mark"))
    limit = F.expr(allowed("least(char_length(x), char_length(y))", edits, chars_per_edit))

    def verify(pairs: DataFrame) -> DataFrame:
        once = pairs.where(may_link(F.col("ma"), F.col("mb"), edits)).distinct()
        x, y = (texts.select(F.col("node").alias(n), F.col("line").alias(t)) for n, t in (("a", "x"), ("b", "y")))
        return once.join(x, "a").join(y, "b").where(edit_distance(F.col("x"), F.col("y"), edits) <= limit).select(*pairs.columns)

    def refine(full: DataFrame) -> DataFrame:
        # keys are made of the texts that are in full buckets, not of all
        own = texts.join(full.select("node", "label", "mark").distinct(), "node")
        return _exploded(own.select(run_keys(edits).alias("key"), "node", "label", "mark"))

    linked = scratch.save(linked_components(keys, verify, scratch, refine, near=lambda x, y: may_link(x.mark, y.mark, edits)))
    named = linked.join(distinct.select("node", "head"), "node")
    heads = named.groupBy("label").agg(F.min("head").alias("first"))
    first = named.join(heads, "label").select("node", "first")
    # written, so that the join below is one of two plain exchanges, whose large partitions (a line that many documents have) Spark can split
    classes = scratch.save(distinct.select("sha", "node", "head").join(first, "node", "left").select("sha", F.coalesce("first", "head").alias("first")))
    out = lines.select("id", "line_no", "sha").join(classes, "sha")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("line_no") == F.col("first.line_no"))
    return out.select("id", "line_no", F.col("first.id").alias("class_id"), F.col("first.line_no").alias("class_line"), same.alias("kept"))
