"""Chromatographic features, designs and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_design(matches: DataFrame, path: str, intensities: str, design: DataFrame) -> DataFrame:
    """A row for each channel of each match with its sample.

    design: file, channel (from 0), sample. Files meet by name, whatever their folder; channels by place. A match of a file or channel that the design
    lacks is an error. The design has few rows a file; which side of the join is sent around is left to Spark's size check.
    """
    rows = matches.select("*", F.regexp_extract(path, "([^/\\\\]*)$", 1).alias("file"), F.posexplode(intensities).alias("channel", "intensity")).drop(intensities)
    out = rows.join(design, ["file", "channel"], "left")
    missing = F.raise_error(F.concat(F.lit("no sample for "), "file", F.lit(" channel "), F.col("channel").cast("string")))
    return out.withColumn("sample", F.when(F.col("sample").isNull(), missing.cast(design.schema["sample"].dataType)).otherwise(F.col("sample")))


def left_out(scans: DataFrame, averaged: DataFrame, on: list[str]) -> DataFrame:
    """Scans that no average has used."""
    return scans.join(averaged.select(*on).distinct(), on, "left_anti")


def feature_intensity(envelopes: DataFrame, identifications: DataFrame, feature: str, charge: str, intensity: str, mass: str) -> DataFrame:
    """Apex and summed intensity, number of charges and mass error of each feature (AGG12).

    The error is that of the apex against the feature's identification that it fits best, in ppm; null without one. Of equally high
    envelopes the heaviest is the apex.
    """
    apex = F.max(F.struct(F.col(intensity).alias("i"), F.col(mass).alias("m"))).alias("_apex")
    own = envelopes.groupBy(feature).agg(apex, F.sum(intensity).alias("integrated"), F.count_distinct(charge).alias("n_charges"))
    error = (F.col("_apex.m") - F.col("_id")) / F.col("_id") * 1e6
    met = own.join(identifications.select(feature, F.col(mass).alias("_id")), feature, "left").withColumn("_error", error)
    best = met.groupBy(feature).agg(F.min_by("_error", F.struct(F.abs("_error").alias("a"), F.col("_error").alias("e"))).alias("mass_error"))
    return own.join(best, feature).select(feature, F.col("_apex.i").alias("apex_intensity"), "integrated", "n_charges", "mass_error")


def features_in(features: DataFrame, mz: tuple[float, float], rt: tuple[float, float], charges: tuple[int, int]) -> DataFrame:
    """Features (mz, charge, rt_start, rt_end) of an m/z range and some charges whose time overlaps the given one (PF24)."""
    return features.where(F.col("mz").between(*mz) & F.col("charge").between(*charges) & (F.col("rt_end") >= rt[0]) & (F.col("rt_start") <= rt[1]))


def merged_groups(members: DataFrame, group: str, sets: list[str], scores: str, order: str) -> DataFrame:
    """Groups of one name as one: the union of each set, a name made of the first set's members, and the score of the group that is first by `order` (AGG17)."""
    unions = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets]
    out = members.groupBy(group).agg(*unions, F.min_by(scores, order).alias(scores))
    return out.withColumn("name", F.array_join(F.transform(sets[0], lambda x: x.cast("string")), "|"))


def isobaric_groups(peptides: DataFrame, base: str, mass: str, form: str, places: int = 2) -> DataFrame:
    """Forms of one base sequence and equal rounded mass, of which there are several (AGG25)."""
    out = peptides.groupBy(base, F.round(mass, places).alias("mass")).agg(F.array_sort(F.collect_set(form)).alias("forms"))
    return out.where(F.size("forms") > 1)


def prefiltered(mz: Column, intensity: Column, least_mz: float = 300.0) -> Column:
    """Array of (mz, intensity) of the peaks at or above a m/z with an intensity above zero (PF22); a spectrum without intensity is an error."""
    total = F.aggregate(intensity, F.lit(0.0), lambda s, x: s + x)
    peaks = F.filter(F.arrays_zip(mz.alias("mz"), intensity.alias("intensity")), lambda p: (p["mz"] >= least_mz) & (p["intensity"] > 0))
    return F.when(F.size(intensity) == 0, F.raise_error("empty spectrum").cast("array<struct<mz:double,intensity:double>>")).when(
        total == 0, F.raise_error("spectrum without intensity").cast("array<struct<mz:double,intensity:double>>")
    ).otherwise(peaks)
