"""Scan and peak predicates, merges, extrema and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.functions.chemistry import RESIDUES
from massif.operators.prefix import chains

# ---- predicates on scans and peak arrays ----


def scans(df: DataFrame, level: str, number: str, rt: str, levels: list[int] | None = None, numbers: tuple | None = None, times: tuple | None = None) -> DataFrame:
    """Scans of some levels, an inclusive range of numbers and a closed range of times; plain comparisons, which reach a Parquet scan."""
    if levels:
        df = df.where(F.col(level).isin(levels))
    for column, ends in ((number, numbers), (rt, times)):
        if ends:
            df = df.where((F.col(column) >= ends[0]) & (F.col(column) <= ends[1]))
    return df


def peaks_where(mz: Column, intensity: Column, lo: float, hi: float, least: float = float("-inf"), most: float = float("inf")) -> Column:
    """Array of (mz, intensity) within both closed ranges."""
    both = F.zip_with(mz, intensity, lambda m, i: F.struct(m.alias("mz"), i.alias("intensity")))
    return F.filter(both, lambda p: p["mz"].between(lo, hi) & p["intensity"].between(least, most))


def indices_within(mz: Column, target: Column, ppm: float) -> Column:
    """0-based places of the peaks within ppm of a target."""
    marked = F.transform(mz, lambda m, i: F.when(F.abs(m - target) / target * 1e6 <= ppm, i))
    return F.array_compact(marked)


def parse_tolerance(text: Column) -> Column:
    """(value, unit) of texts such as "±5 PPM" or "0.02 Absolute"; null for others."""
    value = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.when(F.lower(text).contains("ppm"), "ppm").when(F.lower(text).rlike("abs|da"), "absolute")
    return F.when((value != "") & unit.isNotNull(), F.struct(value.cast("double").alias("value"), unit.alias("unit")))


def range_relation(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """equal, super, sub, majority (at least half of the second is covered), overlap or none, of two closed ranges."""
    shared = F.least(hi1, hi2) - F.greatest(lo1, lo2)
    return (
        F.when((lo1 == lo2) & (hi1 == hi2), "equal").when((lo1 <= lo2) & (hi1 >= hi2), "super").when((lo1 >= lo2) & (hi1 <= hi2), "sub")
        .when(shared < 0, "none").when(shared * 2 >= hi2 - lo2, "majority").otherwise("overlap")
    )


def motif_positions(seq: Column, motif: str, anchor: int = 0) -> Column:
    """1-based positions of a motif's anchor letter; overlapping matches count. X stands for any residue."""
    pattern = motif.replace("X", "[A-Z]")
    n = motif_length(motif)
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(seq) - n + 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(n)).rlike(f"^{pattern}$")) if not anchor else F.transform(motif_positions(seq, motif), lambda i: i + anchor)


def motif_length(motif: str) -> int:
    """Letters of a motif, a bracketed class being one."""
    import re

    return len(re.sub(r"\[[^\]]*\]", "X", motif))


def mod_fits(position: Column, length: Column, restriction: Column, protein_position: Column, protein_length: Column) -> Column:
    """Whether a modification's place restriction admits a position of a peptide in its protein (PF17)."""
    return (
        F.when(restriction == "N-terminal.", protein_position <= 2).when(restriction == "C-terminal.", protein_position == protein_length)
        .when(restriction == "Peptide N-terminal.", position == 1).when(restriction == "Peptide C-terminal.", position == length).otherwise(F.lit(True))
    )


# ---- joins ----


def closest_per_scan(peaks: DataFrame, scan: str, mz: str, intensity: str, target: float, ppm: float) -> DataFrame:
    """(scan, mz, intensity): each scan's peak closest to the target (at a tie the lower m/z, then the lower intensity), 0 where none lies within ppm."""
    near = F.abs(F.col(mz) - target) / target * 1e6 <= ppm
    best = F.min_by(F.struct(mz, intensity), F.when(near, F.struct(F.abs(F.col(mz) - target), F.col(mz), F.col(intensity)))).alias("_b")
    out = peaks.groupBy(scan).agg(best, F.max(near).alias("_any"))
    pick = lambda c: F.when(F.col("_any"), F.col("_b").getField(c))
    return out.select(scan, pick(mz).alias(mz), F.coalesce(pick(intensity), F.lit(0.0)).alias(intensity))


def first_occurrence(part: Column, whole: Column) -> Column:
    """1-based place of the first occurrence, null if there is none."""
    return F.nullif(F.position(part, whole), F.lit(0))


# ---- aggregates and windows ----


def sample_groups(df: DataFrame, keys: list[str], condition: str, replicate: str, intensity: str) -> DataFrame:
    """Counts and summed intensities by condition and replicate (AGG18)."""
    return df.groupBy(*keys, condition, replicate).agg(F.count("*").alias("n_matches"), F.sum(intensity).alias("intensity"))


def merged_bins(peaks: DataFrame, mz: str, intensity: str, ppm: float) -> DataFrame:
    """(mz, intensity, n): peaks of all spectra whose m/z follow one another within ppm form one, with the median m/z and the summed intensity (AGG26).

    Peaks are dealt by ranges of m/z and clusters run on from one range to the next.
    """
    marked = chains(peaks, mz, lambda a, b: b > a * (1 + ppm * 1e-6), "_c")
    return marked.groupBy("_c").agg(F.median(mz).alias("mz"), F.sum(intensity).alias("intensity"), F.count("*").alias("n")).drop("_c")


def extrema(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows that exceed (max) or fall below (min) both neighbours, with kind."""
    w = Window.partitionBy(*keys).orderBy(order)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    kind = F.when((F.col(value) > a) & (F.col(value) > b), "max").when((F.col(value) < a) & (F.col(value) < b), "min")
    return df.withColumn("kind", kind).where(F.col("kind").isNotNull())


def valley_bounds(df: DataFrame, keys: list[str], order: str, value: str, factor: float = 0.6) -> DataFrame:
    """(keys, apex, start, end): from each trace's apex outward to the last point before the first one that rises to more than
    1 / factor of the running minimum (W9)."""
    apex = df.groupBy(*keys).agg(F.min_by(F.col(order), F.struct(-F.col(value), F.col(order))).alias("apex"))
    rows = df.join(apex, keys)
    down = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    def side(part: DataFrame, w, name: str, far) -> DataFrame:
        low = part.withColumn("_low", F.min(value).over(w)).withColumn("_rise", F.col("_low") < factor * F.col(value))
        broken = low.withColumn("_stop", F.max(F.col("_rise").cast("int")).over(w))
        return broken.where("_stop = 0").groupBy(*keys).agg(far(order).alias(name))

    left = side(rows.where(F.col(order) <= F.col("apex")), down, "start", F.min)
    right = side(rows.where(F.col(order) >= F.col("apex")), up, "end", F.max)
    return apex.join(left, keys).join(right, keys)


def top_by_quantile(peaks: DataFrame, scan: str, intensity: str, n: int) -> DataFrame:
    """Peaks at or above the intensity of the scan's n-th most intense one: ties may exceed n (SORT1)."""
    w = Window.partitionBy(scan).orderBy(F.desc(intensity))
    return peaks.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= n).drop("_r")


def most_intense(peaks: DataFrame, scan: str, intensity: str, n: int) -> DataFrame:
    """Peaks at or above the scan's quantile 1 - n / its size, between neighbouring values by the median-unbiased rule (SORT1): ties may exceed n, and short scans stay whole."""
    values = F.array_sort(F.collect_list(F.col(intensity).cast("double")))
    size = F.size("_v")
    share = F.greatest(F.lit(0.0), 1 - n / size)
    at = (size + 1 / 3) * share + 1 / 3
    k = F.floor(at).cast("int")
    low = F.try_element_at("_v", F.greatest(k, F.lit(1)))
    between = low + (at - k) * (F.try_element_at("_v", F.least(k + 1, size)) - low)
    cut = F.when((share == 0) | (size == 1) | (k < 1), F.try_element_at("_v", F.lit(1))).when(k >= size, F.try_element_at("_v", size)).otherwise(between)
    cuts = peaks.groupBy(scan).agg(values.alias("_v")).select(scan, cut.alias("_cut"))
    return peaks.join(cuts, scan).where(F.col(intensity) >= F.col("_cut")).drop("_cut")


# ---- text and number helpers ----


def round_away(x: Column, places: int = 9) -> Column:
    """Half away from zero."""
    return F.round(x, places)


def is_sequence(seq: Column) -> Column:
    return seq.rlike("^[" + "".join(sorted(RESIDUES)) + "]+$")


def sanitised(seq: Column, letter: str = "X") -> Column:
    """Other characters than residues become a letter."""
    return F.regexp_replace(seq, "[^" + "".join(sorted(RESIDUES)) + "]", letter)


def accessions(text: Column) -> Column:
    return F.split(text, "[;|]")


def all_places(text: Column, part: str) -> Column:
    """0-based places of all occurrences, overlapping ones too."""
    n = len(part)
    return F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - n, F.lit(0))), lambda i: F.substring(text, i + 1, F.lit(n)) == part)


def file_stem(path: Column) -> Column:
    """File name without folders and known extensions, periods inside kept."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?i)(\.(raw|mzml|mgf|msalign|d|tsv|psmtsv|csv|txt|gz))+$", "")


def flags(*columns: Column) -> Column:
    """A byte of up to eight booleans, the first the lowest bit."""
    return sum((c.cast("int") * (1 << i) for i, c in enumerate(columns)), F.lit(0))


def loss_kind(mass: Column) -> Column:
    """Name of a neutral loss by its mass within 0.01."""
    known = (("none", 0.0), ("water", 18.010565), ("ammonia", 17.026549), ("phosphoric acid", 97.976896))
    out = F.when(F.abs(mass) < 0.01, "none")
    for name, m in known[1:]:
        out = out.when(F.abs(mass - m) < 0.01, name)
    return out.otherwise("other")

# ---- matches, grids and sets ----


def closest_match(left: DataFrame, key: str, x: str, right: DataFrame, other: str, y: str, ppm: float) -> DataFrame:
    """Each row of left with its closest partner within ppm (ties: the lower id), rows without one having none.

    Of the partners below and above a value the next one on either side is the closest, so values are ordered once with their partners, by rising and by falling value, and no pairs are listed.
    """
    from massif.operators.prefix import fill

    partner = right.where(F.col(y) > 0).groupBy(F.col(y).alias("_v")).agg(F.min(other).alias("_o"))
    asked = left.where(F.col(x) > 0).select(F.col(x).alias("_v")).distinct()
    own = F.struct(F.col("_o"), F.col("_v").alias("_y"))
    both = partner.select("_v", F.lit(0).alias("_k"), own.alias("_at")).unionByName(asked.withColumn("_k", F.lit(1)), allowMissingColumns=True)
    below = fill(both, [F.col("_v"), F.col("_k")], "_at", "_below")
    beside = fill(below, [-F.col("_v"), F.col("_k")], "_at", "_above").where("_k = 1")
    gap = lambda c: F.abs(F.col("_v") - F.col(f"{c}._y"))
    near = lambda c: F.when(gap(c) / F.col(f"{c}._y") * 1e6 <= ppm, F.struct(gap(c).alias("d"), F.col(f"{c}._o").alias("o"), F.col(f"{c}._y").alias("y")))
    best = beside.select("_v", F.array_min(F.array_compact(F.array(near("_below"), near("_above")))).alias("_b")).where("_b IS NOT NULL")
    return left.join(best, left[x] == best["_v"], "left").select(*left.columns, F.col("_b.o").alias(other), F.col("_b.y").alias(y))


def truncations(df: DataFrame, seq: str, most: int, least_length: int) -> DataFrame:
    """df with end (N or C), removed and product: up to `most` residues taken off either end (GEN12)."""
    cut = lambda name, f: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.struct(F.lit(name).alias("end"), i.alias("removed"), f(i).alias("product")))
    n = F.length(seq)
    both = F.concat(cut("N", lambda i: F.substring(F.col(seq), i + 1, n)), cut("C", lambda i: F.substring(F.col(seq), F.lit(1), n - i)))
    return df.withColumn("_t", F.explode(both)).select(*df.columns, "_t.*").where(F.length("product") >= least_length)


def parameter_grid(spark, **choices: list) -> DataFrame:
    """All combinations of a few short lists of settings (GEN29); lists in the code, not data."""
    one = spark.range(1).select(*[F.array(*[F.lit(v) for v in values]).alias(name) for name, values in choices.items()])
    for name in choices:
        one = one.withColumn(name, F.explode(name))
    return one


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(equal): whether two tables have the same rows as often, in any order (SET5)."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_n")).unionAll(b.select(*columns, F.lit(-1).alias("_n")))
    return both.groupBy(*columns).agg(F.sum("_n").alias("_d")).agg((F.coalesce(F.max(F.abs("_d")), F.lit(0)) == 0).alias("equal"))


def shared_extrema(points: DataFrame, run: str, time: str, tolerance: float, share: float = 0.55) -> DataFrame:
    """(first, last, n_runs): groups of extrema whose times follow one another within tolerance and that at least `share` of the runs have.

    Points are dealt by ranges of time, so no task holds them all.
    """
    marked = chains(points, time, lambda a, b: b - a > tolerance, "_c")
    total = points.agg(F.count_distinct(run).alias("_all"))
    out = marked.groupBy("_c").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count_distinct(run).alias("n_runs"))
    return out.join(F.broadcast(total)).where(F.col("n_runs") >= share * F.col("_all")).select("first", "last", "n_runs")
