"""Digestion, decoys, fragments, modifications, coverage and occupancy as expressions on a sequence column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.functions.annotations import FIRST, LAST, SHIFTS
from massif.functions.chemistry import PROTON, RESIDUES, WATER, bound

# Product types as shifts from the sum of the residues of the fragment.
PREFIX_SHIFT = {k: SHIFTS[k] for k in FIRST}
SUFFIX_SHIFT = {k: SHIFTS[k] for k in LAST}


def cleavage_sites(seq: Column, cut_after: str, prevented_by: str = "") -> Column:
    """Sorted positions: 0, the length, and each position after a residue of cut_after whose next residue is not in prevented_by (GEN1)."""
    inside = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(seq) - 1, F.lit(1))),
        lambda i: F.substring(seq, i, F.lit(1)).isin(list(cut_after)) & ~F.substring(seq, i + 1, F.lit(1)).isin(list(prevented_by) or [""]) & (i < F.length(seq)),
    )
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), inside, F.array(F.length(seq)))))


def digest(df: DataFrame, seq: str, cut_after: str, prevented_by: str = "", missed: int = 2, min_length: int = 7, max_length: int = 1 << 30, initiator: str = "variable") -> DataFrame:
    """df with start (1-based), end, missed and peptide for each full-specificity product (GEN2).

    initiator: what becomes of a leading M: retain, cleave (only without it), or variable (both).
    """
    sites = cleavage_sites(F.col(seq), cut_after, prevented_by)
    # pairs of sites by index; each product has at most `missed` sites inside
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("_sites") - 2),
            lambda i: F.transform(
                F.sequence(i + 1, F.least(i + missed + 1, F.size("_sites") - 1)),
                lambda j: F.struct((F.get("_sites", i) + 1).alias("start"), F.get("_sites", j).alias("end"), (j - i - 1).alias("missed")),
            ),
        )
    )
    out = df.where(F.length(seq) > 0).withColumn("_sites", sites).withColumn("_p", F.explode(pairs)).select(*df.columns, "_p.*")
    leading = (F.col("start") == 1) & (F.substring(seq, 1, 1) == "M")
    if initiator == "cleave":
        out = out.withColumn("start", F.when(leading, 2).otherwise(F.col("start")))
    elif initiator == "variable":
        starts = F.when(leading, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col("start")))
        out = out.withColumn("start", F.explode(starts))
    out = out.withColumn("peptide", F.col(seq).substr(F.col("start"), F.col("end") - F.col("start") + 1))
    return out.where((F.length("peptide") >= min_length) & (F.length("peptide") <= max_length))


def digest_semi(df: DataFrame, seq: str, cut_after: str, prevented_by: str = "", missed: int = 2, min_length: int = 7) -> DataFrame:
    """df with start, end, peptide: products with at least one end at a site and at most `missed` sites inside, each once (GEN3)."""
    # sites by number: each start reaches to the site `missed` beyond its next one, each end back as far; of the latter those whose start is a site are among the former already
    rows = df.where(F.length(seq) > 0).distinct().withColumn("_sites", cleavage_sites(F.col(seq), cut_after, prevented_by))
    site = lambda i: F.get("_sites", i)
    last = F.size("_sites") - 1
    # a sequence whose first number is beyond its last would run backwards
    ordered = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    left = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(ordered(site(i) + min_length, site(F.least(i + missed + 1, last))), lambda e: pair(site(i) + 1, e)))
    right = F.transform(F.sequence(F.lit(1), last), lambda j: F.transform(F.array_except(ordered(site(F.greatest(j - missed - 1, F.lit(0))), site(j) - min_length), F.col("_sites")), lambda b: pair(b + 1, site(j))))
    both = rows.withColumn("_p", F.explode(F.concat(F.flatten(left), F.flatten(right)))).select(*df.columns, "_p.*")
    return both.withColumn("peptide", F.col(seq).substr(F.col("start"), F.col("end") - F.col("start") + 1))


def specificity(start: Column, end: Column, sites: Column) -> Column:
    """full, semi or none, by the ends of a 1-based interval that are sites (GEN4)."""
    n = F.array_contains(sites, start - 1).cast("int") + F.array_contains(sites, end).cast("int")
    return F.when(n == 2, "full").when(n == 1, "semi").otherwise("none")


def decoy_reverse(seq: Column) -> Column:
    """The sequence backwards, a leading M kept (GEN13)."""
    return F.when(F.substring(seq, 1, 1) == "M", F.concat(F.lit("M"), F.reverse(F.substring(seq, 2, 1 << 30)))).otherwise(F.reverse(seq))


def decoy_position(position: Column, length: Column, keeps_m: Column) -> Column:
    """Where a modification at a 1-based position goes in the reversed sequence."""
    return F.when(keeps_m & (position > 1), length - position + 2).when(keeps_m, position).otherwise(length - position + 1)


def decoy_slide(seq: Column, slides: int = 20) -> Column:
    """Residues moved by a fixed pattern, an even one forward, an odd one back, reflected at the ends; a leading M kept (GEN14)."""
    head = F.when(F.substring(seq, 1, 1) == "M", F.lit("M")).otherwise(F.lit(""))
    body = F.when(F.substring(seq, 1, 1) == "M", F.substring(seq, 2, 1 << 30)).otherwise(seq)
    n = F.length(body)
    # the source of each place: a move by `slides` with reflection is a fold of a saw tooth of period 2n
    raw = lambda i: F.when(i % 2 == 0, i + slides).otherwise(i - slides)
    folded = lambda i: F.pmod(raw(i), 2 * n)
    place = lambda i: F.when(folded(i) < n, folded(i)).otherwise(2 * n - 1 - folded(i))
    letters = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(body, (place(i) + 1).cast("int"), F.lit(1)))
    return F.when(n > 0, F.concat(head, F.array_join(letters, ""))).otherwise(seq)


def residue_mass(letter: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv]), letter)


def residue_masses(seq: Column) -> Column:
    """Array of masses, null for letters that are no residue."""
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), residue_mass)


def peptide_mass(seq: Column) -> Column:
    """Monoisotopic neutral mass; null where a residue is unknown."""
    return F.aggregate(residue_masses(seq), F.lit(WATER), lambda acc, m: acc + m)


def fragments(df: DataFrame, seq: str, prefix: tuple[str, ...] = ("b",), suffix: tuple[str, ...] = ("y",)) -> DataFrame:
    """df with ion, number and mass of each product; a product that holds an unknown residue has none (GEN17). zDot ions whose first residue is P are left out."""
    n = F.length(seq)
    # the sums of the first 1, 2, ... masses, and of the last ones: each mass is added once
    sums = lambda m: F.aggregate(m, F.array(F.lit(None), F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)), lambda s: F.slice(s, 3, F.greatest(F.size(s) - 3, F.lit(0))))
    def series(name: str, shift: float, of: str):
        return F.transform(of, lambda x, i: F.struct(F.lit(name).alias("ion"), (i + 1).alias("number"), (x + shift).alias("mass")))

    ions = [series(t, PREFIX_SHIFT[t], "_a") for t in prefix] + [series(t, SUFFIX_SHIFT[t], "_b") for t in suffix]
    both = F.explode(F.array(bound(residue_masses(F.col(seq)), lambda m: F.struct(sums(m).alias("a"), sums(F.reverse(m)).alias("b")))))
    summed = df.where(n >= 2).select("*", both.alias("_s")).select(*df.columns, F.col("_s.a").alias("_a"), F.col("_s.b").alias("_b"))
    out = summed.withColumn("_f", F.explode(F.concat(*ions))).select(*df.columns, "_f.*").where("mass IS NOT NULL")
    return out.where(~((F.col("ion") == "zDot") & (F.col(seq).substr(n - F.col("number") + 1, F.lit(1)) == "P")))


# ---- modification strings ----

MOD = r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]"


def base_sequence(full: Column) -> Column:
    """Without modifications, nested brackets included, and without the dashes of terminal ones."""
    return F.regexp_replace(F.regexp_replace(full, MOD, ""), "-", "")


def modifications(full: Column) -> Column:
    """Map of position to text: the place in the stripped sequence (N-terminus 0), one more where the modification follows a dash."""
    texts = F.regexp_extract_all(full, F.lit(f"({MOD})"), 1)
    # what precedes each modification: the text up to its bracket, without the earlier ones
    marked = F.split(F.regexp_replace(full, MOD, "\u0001"), "\u0001")
    before = lambda i: F.array_join(F.slice(marked, 1, i + 1), "")
    place = lambda i: F.length(F.regexp_replace(before(i), "-", "")) + F.when(before(i).endswith("-"), 1).otherwise(0)
    return F.map_from_entries(F.transform(texts, lambda t, i: F.struct(place(i).alias("position"), F.substring(t, F.lit(2), F.length(t) - 2).alias("mod"))))


def full_sequence(base: Column, mods: Column) -> Column:
    """A base sequence with the modifications of a map of positions put after their residues (FN13); 0 goes in front."""
    mod = lambda i: F.coalesce(F.concat(F.lit("["), F.element_at(mods, i), F.lit("]")), F.lit(""))
    body = F.transform(F.sequence(F.lit(1), F.length(base)), lambda i: F.concat(F.substring(base, i, F.lit(1)), mod(i)))
    return F.concat(mod(F.lit(0)), F.array_join(body, ""), F.coalesce(F.concat(F.lit("-["), F.element_at(mods, F.length(base) + 1), F.lit("]")), F.lit("")))


# ---- coverage and occupancy ----


def coverage(intervals: DataFrame, key: str, start: str, end: str, length: str) -> DataFrame:
    """(key, covered, fraction): distinct residues under the 1-based closed intervals (AGG19).

    Counted from merged intervals, by a running maximum of ends: no row for each residue.
    """
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(end).over(w), F.lit(0))
    new = intervals.withColumn("_new", F.greatest(F.lit(0), F.col(end) - F.greatest(seen, F.col(start) - 1)))
    return new.groupBy(key).agg(F.sum("_new").alias("covered"), (F.sum("_new") / F.max(length)).alias("fraction"))


def occupancy(df: DataFrame, key: list[str], start: str, end: str, position: str, intensity: str) -> DataFrame:
    """(key, position, n_modified, n_total, fraction, stoichiometry) of each modified position (AGG22-24).

    Modified rows carry a position, others null; a row counts for each modified position of its key that its interval covers. Positions
    and rows meet through the positions of one key, a small set.
    """
    sites = df.where(F.col(position).isNotNull()).select(*key, F.col(position).alias("_site")).distinct()
    met = df.join(sites, key).where(F.col("_site").between(F.col(start), F.col(end)))
    hit = F.coalesce(F.col(position) == F.col("_site"), F.lit(False))
    out = met.groupBy(*key, "_site").agg(
        F.sum(hit.cast("long")).alias("n_modified"), F.count("*").alias("n_total"), F.sum(F.when(hit, F.col(intensity)).otherwise(0.0)).alias("_i"), F.sum(intensity).alias("_t")
    )
    return out.select(*key, F.col("_site").alias("position"), "n_modified", "n_total", (F.col("n_modified") / F.col("n_total")).alias("fraction"), (F.col("_i") / F.col("_t")).alias("stoichiometry"))


def proteoform_level(localised: Column, mod_known: Column, sequence_known: Column, gene_known: Column) -> Column:
    """1 if all is known, 2A-2D if one thing is not (modification place, modification, sequence, gene), 3 if two, 4 if three, 5 if none is (FN46)."""
    unknown = reduce(lambda a, b: a + b, [(~c).cast("int") for c in (localised, mod_known, sequence_known, gene_known)])
    one = F.when(~localised, "2A").when(~mod_known, "2B").when(~sequence_known, "2C").otherwise("2D")
    return F.when(unknown == 0, "1").when(unknown == 1, one).when(unknown == 2, "3").when(unknown == 3, "4").otherwise("5")


def envelope_score(cosine: Column, ppm_error: Column, completeness: Column, ratio: Column) -> Column:
    """Logistic score of an isotope envelope (FN41), from fixed coefficients."""
    x = 3.4494 * cosine - 1.6341 * ppm_error + 4.7795 * completeness + 2.1883 * ratio + 4.3142
    return 1 / (1 + F.exp(-x))


def ion_mz(mass: Column, charge: int) -> Column:
    return mass / charge + PROTON


def decoy_peptide(seq: Column, kept: str) -> Column:
    """The peptide reversed around the residues of `kept`, which stay in their places: its cleavage sites are those of the target (GEN16)."""
    stays = lambda c: c.isin(list(kept))

    def made(letters: Column) -> Column:
        # the places that letters leave free, and their letters, in the opposite order
        places = F.filter(F.transform(letters, lambda c, i: F.when(~stays(c), i)), lambda i: i.isNotNull())
        moved = lambda free: F.map_from_arrays(free, F.transform(F.reverse(free), lambda i: F.get(letters, i)))
        return bound(places, lambda free: bound(moved(free), lambda m: F.array_join(F.transform(letters, lambda c, i: F.coalesce(F.try_element_at(m, i), c)), "")))

    return bound(F.filter(F.split(seq, ""), lambda c: c != ""), made)


def rna_digest(df: DataFrame, seq: str, cut_after: str, missed: int, min_length: int) -> DataFrame:
    """df with start, end, missed, oligo and the chemistry of both ends (GEN7): inner ends have a hydroxyl at 5' and a phosphate at 3', outer ends those of the whole."""
    out = digest(df, seq, cut_after, "", missed, min_length, initiator="retain").withColumnRenamed("peptide", "oligo")
    five = F.when(F.col("start") == 1, F.lit("whole")).otherwise(F.lit("OH"))
    three = F.when(F.col("end") == F.length(seq), F.lit("whole")).otherwise(F.lit("PO4"))
    return out.withColumns({"five": five, "three": three})


def fragment_coverage(length: Column, n_places: Column, c_places: Column) -> Column:
    """Sorted residues that matched fragments tell apart (AGG20).

    n_places and c_places: residue numbers of the fragments from either end. A residue is told by two fragments of one end that differ by it, by
    fragments of both ends that meet at it or leave it alone between them, and an end residue by the first or last possible fragment.
    """
    return bound(F.array_sort(F.array_distinct(n_places)), lambda n: bound(F.array_sort(F.array_distinct(c_places)), lambda c: _told_apart(length, n, c)))


def _told_apart(length: Column, n: Column, c: Column) -> Column:
    has = F.array_contains
    later = F.slice(n, 2, 1 << 20)
    steps = F.filter(later, lambda x: has(n, x - 1) | has(c, x))
    between = F.transform(F.filter(later, lambda x: has(c, x + 2)), lambda x: x + 1)
    own = F.filter(c, lambda x: has(c, x + 1))
    one = lambda condition, x: F.when(condition, F.array(x)).otherwise(F.array().cast("array<int>"))
    first = one(has(n, 1) | has(c, 2), F.lit(1))
    last = one(has(n, length - 1) | has(c, length), length)
    return F.array_sort(F.array_distinct(F.concat(first, last, steps, between, own)))


def residue_hits(seq: Column, polymers: Column) -> Column:
    """For each residue the number of occurrences of the polymers that cover it, overlapping ones included (AGG21)."""
    places = F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1)))

    def made(text: Column) -> Column:
        starts = lambda p: F.filter(F.transform(places, lambda i: F.when((F.substr(text, i, F.length(p)) == p) & (p != ""), i)), lambda i: i.isNotNull())
        spans = lambda p: F.transform(starts(p), lambda i: F.struct(i.alias("lo"), (i + F.length(p) - 1).alias("hi")))
        return bound(F.flatten(F.transform(polymers, spans)), lambda found: F.transform(places, lambda i: F.size(F.filter(found, lambda x: (x["lo"] <= i) & (i <= x["hi"])))))

    return F.when(F.length(seq) > 0, bound(seq, made)).otherwise(F.array().cast("array<int>"))
