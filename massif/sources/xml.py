"""Readers of XML formats with Spark's XML source: mzML spectra, UniProt entries, mzIdentML matches, Unimod."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARAM = "array<struct<_accession: string, _name: string, _value: string>>"
_SPECTRUM = f"""_index long, _id string, cvParam {_PARAM},
scanList struct<scan: array<struct<cvParam: {_PARAM}>>>,
precursorList struct<precursor: array<struct<_spectrumRef: string, selectedIonList: struct<selectedIon: array<struct<cvParam: {_PARAM}>>>>>>,
binaryDataArrayList struct<binaryDataArray: array<struct<cvParam: {_PARAM}, binary: string>>>"""

# Terms of the controlled vocabulary for spectra.
LEVEL, START_TIME, SELECTED_MZ, CHARGE_STATE = "MS:1000511", "MS:1000016", "MS:1000744", "MS:1000041"
MZ_ARRAY, INTENSITY_ARRAY, FLOAT64, ZLIB, CENTROID, TIC = "MS:1000514", "MS:1000515", "MS:1000523", "MS:1000574", "MS:1000127", "MS:1000285"


def term(params: Column, accession: str) -> Column:
    return F.get(F.filter(params, lambda p: p["_accession"] == accession), F.lit(0))["_value"]


def has_term(params: Column, accession: str) -> Column:
    return F.coalesce(F.exists(params, lambda p: p["_accession"] == accession), F.lit(False))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode(binary: pd.Series, wide: pd.Series, packed: pd.Series) -> pd.Series:
    """Base64 text, perhaps deflated, of little-endian 64- or 32-bit numbers."""

    def one(b, w, z):
        raw = base64.b64decode(b or "")
        raw = zlib.decompress(raw) if z and raw else raw
        return np.frombuffer(raw, "<f8" if w else "<f4").astype(float)

    return pd.Series([one(*x) for x in zip(binary, wide, packed)], dtype=object)


def encode(values: list[float]) -> str:
    """64-bit little-endian numbers, deflated, as base64 text (FN23)."""
    return base64.b64encode(zlib.compress(np.asarray(values, "<f8").tobytes())).decode("ascii")


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """(scan, ms_level, rt_min, is_centroid, tic, precursor_mz, charge, precursor_scan, mz, intensity), by scan number.

    A missing precursor scan is the last one before whose level is one less. Spectra without peaks stay with empty arrays; a scan number that repeats within a file is an error.
    """
    raw = spark.read.format("xml").option("rowTag", "spectrum").schema(_SPECTRUM).load(path)
    arrays = F.col("binaryDataArrayList.binaryDataArray")
    pick = lambda acc: F.get(F.filter(arrays, lambda a: has_term(a["cvParam"], acc)), F.lit(0))
    data = lambda acc: decode(pick(acc)["binary"], has_term(pick(acc)["cvParam"], FLOAT64), has_term(pick(acc)["cvParam"], ZLIB))
    ion = F.get(F.get(F.col("precursorList.precursor"), F.lit(0))["selectedIonList"]["selectedIon"], F.lit(0))["cvParam"]
    number = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"scan=(\d+)", 1), F.lit("")).cast("int"))
    df = raw.select(
        F.input_file_name().alias("_file"),
        F.coalesce(number(F.col("_id")), (F.col("_index") + 1).cast("int")).alias("scan"),
        term(F.col("cvParam"), LEVEL).cast("int").alias("ms_level"),
        term(F.get("scanList.scan", F.lit(0))["cvParam"], START_TIME).cast("double").alias("rt_min"),
        has_term(F.col("cvParam"), CENTROID).alias("is_centroid"),
        term(F.col("cvParam"), TIC).cast("double").alias("tic"),
        term(ion, SELECTED_MZ).cast("double").alias("precursor_mz"),
        term(ion, CHARGE_STATE).cast("int").alias("charge"),
        number(F.get("precursorList.precursor", F.lit(0))["_spectrumRef"]).alias("_ref"),
        data(MZ_ARRAY).alias("mz"),
        data(INTENSITY_ARRAY).alias("intensity"),
    )
    # scan numbers count within a file
    own = Window.partitionBy("_file")
    w = own.orderBy("scan").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("ms_level") == k, F.col("scan")), ignorenulls=True).over(w) for k in range(1, 5)}
    back = F.coalesce(*[F.when(F.col("ms_level") == k + 1, last[k]) for k in last])
    # the window sees numbers and levels only; the arrays stay where they are
    slim = df.select("_file", "scan", "ms_level").withColumn("_back", back).groupBy("_file", "scan").agg(F.min("_back").alias("_back"), F.count("*").alias("_same"))
    df = df.join(slim, ["_file", "scan"]).withColumn("precursor_scan", F.when(F.col("ms_level") > 1, F.coalesce("_ref", "_back")))
    twice = F.raise_error(F.concat(F.lit("scan number occurs twice: "), F.col("scan")))
    return df.withColumn("scan", F.when(F.col("_same") > 1, twice).otherwise(F.col("scan")).cast("int")).drop("_ref", "_file", "_back", "_same")


def write_mzml(df: DataFrame, path: str) -> None:
    """A minimal mzML document per partition: spectra with level, time, precursor and 64-bit deflated arrays."""

    @F.udf(T.StringType())
    def packed(values):
        return encode(values or [])

    param = lambda acc, name, value: F.struct(F.lit(acc).alias("_accession"), F.lit(name).alias("_name"), value.cast("string").alias("_value"))
    flag = lambda acc, name: param(acc, name, F.lit(""))
    array = lambda acc, name, column: F.struct(F.array(flag(FLOAT64, "64-bit float"), flag(ZLIB, "zlib compression"), flag(acc, name)).alias("cvParam"), packed(column).alias("binary"))
    out = df.select(
        (F.col("scan") - 1).alias("_index"),
        F.concat(F.lit("scan="), F.col("scan")).alias("_id"),
        F.array(param(LEVEL, "ms level", F.col("ms_level"))).alias("cvParam"),
        F.struct(F.array(F.struct(F.array(param(START_TIME, "scan start time", F.col("rt_min"))).alias("cvParam"))).alias("scan")).alias("scanList"),
        F.when(
            F.col("precursor_mz").isNotNull(),
            F.struct(
                F.array(
                    F.struct(
                        F.concat(F.lit("scan="), F.col("precursor_scan")).alias("_spectrumRef"),
                        F.struct(F.array(F.struct(F.array(param(SELECTED_MZ, "selected ion m/z", F.col("precursor_mz")), param(CHARGE_STATE, "charge state", F.col("charge"))).alias("cvParam"))).alias("selectedIon")).alias("selectedIonList"),
                    )
                ).alias("precursor")
            ),
        ).alias("precursorList"),
        F.struct(F.array(array(MZ_ARRAY, "m/z array", "mz"), array(INTENSITY_ARRAY, "intensity array", "intensity")).alias("binaryDataArray")).alias("binaryDataArrayList"),
    )
    out.write.mode("overwrite").format("xml").option("rootTag", "mzML").option("rowTag", "spectrum").save(path)


def read_uniprot_xml(spark: SparkSession, path: str) -> DataFrame:
    """(accession, name, gene, organism, sequence, features): features are (type, description, position, begin, end, original, variation)."""
    place = "struct<_position: int>"
    schema = f"""accession array<string>, name array<string>, gene array<struct<name: array<struct<_VALUE: string, _type: string>>>>,
organism struct<name: array<struct<_VALUE: string, _type: string>>>, sequence struct<_VALUE: string>,
feature array<struct<_type: string, _description: string, original: string, variation: array<string>, location: struct<position: {place}, begin: {place}, end: {place}>>>"""
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    feature = lambda f: F.struct(
        f["_type"].alias("type"), f["_description"].alias("description"), f["location"]["position"]["_position"].alias("position"), f["location"]["begin"]["_position"].alias("begin"),
        f["location"]["end"]["_position"].alias("end"), f["original"].alias("original"), F.get(f["variation"], F.lit(0)).alias("variation"),
    )
    return raw.select(
        F.get("accession", F.lit(0)).alias("accession"),
        F.get("name", F.lit(0)).alias("name"),
        F.get(F.get("gene", F.lit(0))["name"], F.lit(0))["_VALUE"].alias("gene"),
        F.get("organism.name", F.lit(0))["_VALUE"].alias("organism"),
        F.regexp_replace("sequence._VALUE", r"\s", "").alias("sequence"),
        F.transform(F.coalesce("feature", F.array()), feature).alias("features"),
    )


def read_unimod(spark: SparkSession, path: str) -> DataFrame:
    """(name, mass, composition, sites) of the modifications."""
    schema = "_title string, `umod:delta` struct<_mono_mass: double, _composition: string>, `umod:specificity` array<struct<_site: string, _position: string>>"
    raw = spark.read.format("xml").option("rowTag", "umod:mod").schema(schema).load(path)
    return raw.select(F.col("_title").alias("name"), F.col("`umod:delta`._mono_mass").alias("mass"), F.col("`umod:delta`._composition").alias("composition"), F.transform("`umod:specificity`", lambda s: s["_site"]).alias("sites"))


def read_mzidentml(spark: SparkSession, path: str) -> DataFrame:
    """(spectrum, peptide_ref, rank, charge, experimental_mz, calculated_mz, passes) of the identified items."""
    item = "struct<_peptide_ref: string, _rank: int, _chargeState: int, _experimentalMassToCharge: double, _calculatedMassToCharge: double, _passThreshold: boolean>"
    raw = spark.read.format("xml").option("rowTag", "SpectrumIdentificationResult").schema(f"_spectrumID string, SpectrumIdentificationItem array<{item}>").load(path)
    x = raw.select(F.col("_spectrumID").alias("spectrum"), F.explode("SpectrumIdentificationItem").alias("i"))
    return x.select("spectrum", *[F.col(f"i.{a}").alias(b) for a, b in (("_peptide_ref", "peptide_ref"), ("_rank", "rank"), ("_chargeState", "charge"), ("_experimentalMassToCharge", "experimental_mz"), ("_calculatedMassToCharge", "calculated_mz"), ("_passThreshold", "passes"))])
