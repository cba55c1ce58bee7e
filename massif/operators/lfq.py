"""Label-free quantification steps as joins, windows and aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Up to this many runs are broadcast.
MOST_RUNS = 10_000


def match_to_peptides(matches: DataFrame, peptides: DataFrame, sequence: str, order: str) -> DataFrame:
    """Each peptide with the number and the first of its matches; matches of unknown peptides go, peptides without matches stay."""
    own = matches.groupBy(sequence).agg(F.count("*").alias("n_matches"), F.min(order).alias("first_match"))
    return peptides.join(own, sequence, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def donors(identified: DataFrame, run: str, sequence: str, score: str, q: str, most_q: float = 0.01) -> DataFrame:
    """(acceptor, sequence, run, score): per acceptor run the best donor of each sequence that the acceptor has not identified itself.

    Donors and the acceptor's own identifications count if their q-value is below most_q. The best three runs of a sequence are enough to
    find one that differs from any acceptor, so donors are cut to two per sequence before they meet the runs.
    """
    good = identified.where(F.col(q) < most_q)
    w = Window.partitionBy(sequence).orderBy(F.desc(score), run)
    per_run = good.groupBy(sequence, run).agg(F.max(score).alias(score))
    best = per_run.withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    # every sequence meets every run, as the result does; a list of runs goes to all tasks up to MOST_RUNS of them
    runs = identified.select(F.col(run).alias("acceptor")).distinct()
    runs = F.broadcast(runs) if runs.limit(MOST_RUNS + 1).count() <= MOST_RUNS else runs
    met = best.join(runs, F.col(run) != F.col("acceptor"))
    own = per_run.select(F.col(run).alias("acceptor"), sequence)
    open_ = met.join(own, ["acceptor", sequence], "left_anti")
    pick = F.min_by(F.struct(run, score), F.col("_k")).alias("_d")
    return open_.groupBy("acceptor", sequence).agg(pick).select("acceptor", sequence, F.col("_d").getField(run).alias("donor"), F.col("_d").getField(score).alias("score"))


def calibration_pairs(peaks: DataFrame, run: str, sequence: str, rt: str, intensity: str, donor, acceptor) -> DataFrame:
    """(sequence, donor_rt, acceptor_rt): the most intense peak of each sequence in two runs."""
    best = lambda r, name: peaks.where(F.col(run) == r).groupBy(sequence).agg(F.max_by(rt, F.struct(F.col(intensity), -F.col(rt))).alias(name))
    return best(donor, "donor_rt").join(best(acceptor, "acceptor_rt"), sequence)


def anchor_shift(targets: DataFrame, target: str, rt: str, anchors: DataFrame, reach: float = 0.5, each_side: int = 3) -> DataFrame:
    """(target, n_anchors, shift, spread): median and deviation of the shifts of up to three anchors on either side within reach.

    Anchors have donor_rt and acceptor_rt. They meet targets through time bins as wide as the reach, and only near ones are ranked.
    """
    bin_of = lambda c: F.floor(c / reach).cast("long")
    a = anchors.select("donor_rt", (F.col("acceptor_rt") - F.col("donor_rt")).alias("_shift"), F.explode(F.array(*[bin_of(F.col("donor_rt")) + k for k in (-1, 0, 1)])).alias("_bin"))
    near = targets.select(F.col(target), F.col(rt).alias("_rt"), bin_of(F.col(rt)).alias("_bin")).join(a, "_bin").where(F.abs(F.col("donor_rt") - F.col("_rt")) <= reach)
    side = (F.col("donor_rt") >= F.col("_rt")).cast("int")
    w = Window.partitionBy(target, side).orderBy(F.abs(F.col("donor_rt") - F.col("_rt")), "donor_rt", "_shift")
    kept = near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= each_side)
    return kept.groupBy(target).agg(F.count("*").alias("n_anchors"), F.median("_shift").alias("shift"), F.stddev_samp("_shift").alias("spread"))


def resolve_peaks(peaks: DataFrame, apex: list[str], kind: str, sequence: str, score: str, order: str) -> DataFrame:
    """One peak for each apex (AGG11): identified peaks merge (their sequences are joined) and beat transferred ones; of transferred ones the best score stays."""
    identified = F.col(kind) == "MSMS"
    out = peaks.groupBy(*apex).agg(
        F.max(identified).alias("_id"),
        F.array_sort(F.collect_set(F.when(identified, F.col(sequence)))).alias("_own"),
        F.max_by(sequence, F.when(~identified, F.struct(F.col(score), -F.col(order)))).alias("_moved"),
        F.max(F.when(identified, F.col(score))).alias("_s1"),
        F.max(F.when(~identified, F.col(score))).alias("_s2"),
        F.count("*").alias("n_peaks"),
    )
    return out.select(
        *apex, F.when(F.col("_id"), "MSMS").otherwise("MBR").alias(kind), F.when(F.col("_id"), F.array_join("_own", "|")).otherwise(F.col("_moved")).alias(sequence),
        F.coalesce(F.when(F.col("_id"), F.col("_s1")), F.col("_s2")).alias(score), "n_peaks",
    )


def replicate_factors(df: DataFrame, peptide: str, run: str, value: str, reference) -> DataFrame:
    """(run, factor): 1 / median fold change to the reference run over peptides above 0 in both; 1 for the reference and where none is shared (ML3)."""
    ref = df.where((F.col(run) == reference) & (F.col(value) > 0)).select(peptide, F.col(value).alias("_ref"))
    folds = df.where(F.col(value) > 0).join(ref, peptide).groupBy(run).agg(F.median(F.col(value) / F.col("_ref")).alias("_m"))
    runs = df.select(run).distinct()
    return runs.join(folds, run, "left").select(run, F.when(F.col(run) == reference, 1.0).otherwise(F.coalesce(1 / F.col("_m"), F.lit(1.0))).alias("factor"))


def share_of_group(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values scaled to a sum of 100 in each group."""
    total = df.groupBy(*keys).agg(F.sum(value).alias("_t"))
    return df.join(total, keys).withColumn(value, F.col(value) / F.col("_t") * 100).drop("_t")


def deviation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, mad): the median and the median absolute deviation (AGG32)."""
    mid = df.groupBy(*keys).agg(F.median(value).alias("median"))
    return df.join(mid, keys).groupBy(*keys, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def fraction_rule(df: DataFrame, peptide: str, fraction: str, value: str, ambiguous: Column) -> DataFrame:
    """All fractions of a peptide become 0 if its largest is ambiguous (AGG7)."""
    top = df.groupBy(peptide).agg(F.max_by(ambiguous, F.struct(F.col(value), F.col(fraction))).alias("_bad"))
    return df.join(top, peptide).withColumn(value, F.when(F.col("_bad"), 0.0).otherwise(F.col(value))).drop("_bad")


def greedy_selection(df: DataFrame, keys: list[str], score: str, members: str) -> DataFrame:
    """Rows by falling score of each group that share no member with one taken before (SORT3): order-dependent, so one group a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, keep = set(), []
        for i in np.argsort(-pdf[score].to_numpy(float), kind="stable"):
            own = set(pdf[members].iloc[i])
            if not own & taken:
                taken |= own
                keep.append(i)
        return pdf.iloc[keep]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def modified_forms(df: DataFrame, seq: str, targets: dict[str, str], most_mods: int = 2, most_forms: int = 1024) -> DataFrame:
    """df with form (the sequence with bracketed modifications) and n_mods: the unmodified form first, then one modification, then two, up to the limits (GEN8-9, SORT7).

    targets: residue to modification. Forms of equally many modifications come in the order of their positions.
    """
    from itertools import combinations, islice

    @F.pandas_udf("array<struct<form: string, n_mods: int>>")
    def forms(x: pd.Series) -> pd.Series:
        def of(s):
            places = [i for i, c in enumerate(s or "") if c in targets]
            picks = (c for k in range(min(most_mods, len(places)) + 1) for c in combinations(places, k))
            return [("".join(c + (f"[{targets[c]}]" if i in pick else "") for i, c in enumerate(s or "")), len(pick)) for pick in islice(picks, most_forms)]

        return x.map(lambda s: [{"form": f, "n_mods": n} for f, n in of(s)])

    return df.withColumn("_f", F.explode(forms(F.col(seq)))).select(*df.columns, "_f.form", "_f.n_mods")


def apply_variants(df: DataFrame, key: str, seq: str, variants: DataFrame, most: int = 4) -> DataFrame:
    """(key, sequence, n_variants): the sequence with every combination of its first `most` distinct variants (position, original, variation), each sequence once (GEN10).

    A combination applies from high to low positions and leaves out overlapping variants; a variant whose original is not there does not apply.
    """
    from itertools import combinations

    listed = variants.dropDuplicates([key, "position", "original", "variation"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "original", "variation"))).alias("_v"))

    @F.pandas_udf("array<struct<sequence: string, n_variants: int>>")
    def combine(s: pd.Series, v: pd.Series) -> pd.Series:
        def one(seq_, vs):
            vs = [x for x in (vs if vs is not None else []) if seq_[x["position"] - 1 :].startswith(x["original"])][:most]
            seen = {}
            for k in range(len(vs) + 1):
                for pick in combinations(vs, k):
                    ends = [x["position"] - 1 + len(x["original"]) for x in pick]
                    if any(b["position"] - 1 < e for e, b in zip(ends, pick[1:])):
                        continue
                    out = seq_
                    for x in reversed(pick):
                        at = x["position"] - 1
                        out = out[:at] + x["variation"] + out[at + len(x["original"]) :]
                    seen.setdefault(out, k)
            return [{"sequence": a, "n_variants": n} for a, n in seen.items()]

        return pd.Series([one(a or "", b) for a, b in zip(s, v)], dtype=object)

    out = df.join(listed, key, "left").withColumn("_c", F.explode(combine(F.col(seq), F.col("_v"))))
    return out.select(key, F.col("_c.sequence").alias("sequence"), F.col("_c.n_variants").alias("n_variants"))


def parse_vcf(lines: DataFrame, column: str = "value") -> DataFrame:
    """(chrom, pos, ref, alt, sample, genotype, depths, zygosity) of the text lines of a VCF file (GEN11); a line without FORMAT has no rows."""
    f = F.split(column, "\t")
    rows = lines.where(~F.col(column).startswith("#") & (F.size(f) > 9)).select(
        f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[3].alias("ref"), F.split(f[4], ",").alias("alt"), F.split(f[8], ":").alias("_keys"), F.posexplode(F.slice(f, 10, 1 << 20)).alias("sample", "_cell")
    )
    cell = F.map_from_arrays("_keys", F.slice(F.concat(F.split("_cell", ":"), F.array_repeat(F.lit(None).cast("string"), F.size("_keys"))), F.lit(1), F.size("_keys")))
    gt = F.split(F.element_at(cell, "GT"), r"[/|]")
    alleles = F.array_distinct(gt)
    zygosity = F.when(F.array_contains(gt, "."), "unknown").when(F.size(alleles) > 1, "heterozygous").otherwise("homozygous")
    return rows.select("chrom", "pos", "ref", "alt", "sample", gt.alias("genotype"), F.transform(F.split(F.element_at(cell, "AD"), ","), lambda x: x.cast("int")).alias("depths"), zygosity.alias("zygosity"))
