"""Readers of record-per-block text formats: MGF, msalign, MSP, FASTA, PTM lists, OBO.

Each file is split into records by Spark's own text reader (a record separator where the format has one, so a large file is read by many
tasks), and fields are picked by expressions; no reader opens a file itself, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _blocks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    out = spark.read.option("lineSep", separator).text(path)
    return out.select(F.regexp_replace("value", "\r", "").alias("block"), F.col("_metadata.file_path").alias("file"))


def _key(block: str, key: str) -> Column:
    found = F.regexp_extract(block, f"(?m)^{key}=(.*)$", 1)
    return F.when(found != "", found)


def _numbers(block: Column, index: int) -> Column:
    """The index-th number of each line that starts with one."""
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\s*[0-9.+-]+[\s]+[0-9.eE+-]+"))
    return F.transform(lines, lambda x: F.split(F.trim(x), r"[\s]+")[index].cast("double"))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, scan, rt_min, precursor_mz, charge, mz, intensity): one row a spectrum; of spectra with one scan number the first.

    A spectrum without SCANS is numbered from its title, or null. A charge such as 2- is negative.
    """
    raw = _blocks(spark, path, "END IONS").where(F.col("block").contains("BEGIN IONS"))
    charge = _key("block", "CHARGE")
    scan = F.coalesce(_key("block", "SCANS"), F.nullif(F.regexp_extract("block", r"scan[=\s]+(\d+)", 1), F.lit(""))).cast("int")
    out = raw.select(
        "file",
        _key("block", "TITLE").alias("title"),
        scan.alias("scan"),
        (_key("block", "RTINSECONDS").cast("double") / 60).alias("rt_min"),
        F.split(_key("block", "PEPMASS"), r"\s+")[0].cast("double").alias("precursor_mz"),
        (F.regexp_extract(charge, r"(\d+)", 1).cast("int") * F.when(charge.endswith("-"), -1).otherwise(1)).alias("charge"),
        _numbers(F.col("block"), 0).alias("mz"),
        _numbers(F.col("block"), 1).alias("intensity"),
    )
    numbered = out.where("scan IS NOT NULL").dropDuplicates(["file", "scan"])
    return numbered.unionByName(out.where("scan IS NULL"))


def read_msalign(spark: SparkSession, path: str) -> DataFrame:
    """(file, scan, rt_min, level, precursor_mass, precursor_charge, peaks): deconvoluted spectra; peaks are (mass, intensity, charge)."""
    raw = _blocks(spark, path, "END IONS").where(F.col("block").contains("BEGIN IONS"))
    lines = F.filter(F.split("block", "\n"), lambda x: x.rlike(r"^[0-9.]+\t"))
    peak = lambda x: F.struct(F.split(x, "\t")[0].cast("double").alias("mass"), F.split(x, "\t")[1].cast("double").alias("intensity"), F.split(x, "\t")[2].cast("int").alias("charge"))
    return raw.select(
        "file",
        _key("block", "SCANS").cast("int").alias("scan"),
        (_key("block", "RETENTION_TIME").cast("double") / 60).alias("rt_min"),
        F.coalesce(_key("block", "LEVEL").cast("int"), F.when(F.col("block").contains("PRECURSOR"), 2).otherwise(1)).alias("level"),
        _key("block", "PRECURSOR_MASS").cast("double").alias("precursor_mass"),
        _key("block", "PRECURSOR_CHARGE").cast("int").alias("precursor_charge"),
        F.transform(lines, peak).alias("peaks"),
    )


def combine_msalign(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both levels by scan number."""
    return first.unionByName(second).orderBy("scan")


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence, charge, mw, rt, peaks): a text library; peaks are (mz, intensity, annotation). Of entries with one name the first stays."""
    raw = spark.read.option("lineSep", "\nName:").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^\\s*Name:", "").alias("block"))
    name = F.trim(F.split("block", "\n")[0])
    lines = F.filter(F.split("block", "\n"), lambda x: x.rlike(r"^[0-9.]+[\t ]+[0-9.eE+-]+"))
    peak = lambda x: F.struct(
        F.split(x, r"[\t ]+")[0].cast("double").alias("mz"), F.split(x, r"[\t ]+")[1].cast("double").alias("intensity"), F.regexp_replace(F.regexp_extract(x, r"\"([^\"]*)\"", 1), "/.*$", "").alias("annotation")
    )
    out = raw.where(name != "").select(
        name.alias("name"),
        F.regexp_extract(name, r"^(.*)/-?\d+$", 1).alias("sequence"),
        F.regexp_extract(name, r"/(-?\d+)$", 1).cast("int").alias("charge"),
        F.nullif(F.regexp_extract("block", r"(?m)^MW:\s*([0-9.]+)", 1), F.lit("")).cast("double").alias("mw"),
        F.nullif(F.regexp_extract("block", r"(?i)(?:iRT|RT|RetentionTime)=([0-9.-]+)", 1), F.lit("")).cast("double").alias("rt"),
        F.transform(lines, peak).alias("peaks"),
    )
    return out.dropDuplicates(["name"])


def read_fasta(spark: SparkSession, path: str, decoy_prefix: str = "DECOY") -> DataFrame:
    """(accession, name, organism, gene, description, sequence, is_decoy): entries without a sequence go; a repeated accession gets _2, _3, ...

    Headers of UniProt (db|ACC|NAME text OS= GN=), Ensembl (ID ... gene:) and plain kind are told apart by their form. gz files are read as they are.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("block"), F.monotonically_increasing_id().alias("_at"))
    header = F.split("block", "\n")[0]
    sequence = F.regexp_replace(F.array_join(F.slice(F.split("block", "\n"), 2, 1 << 30), ""), r"\s", "")
    uniprot = header.rlike(r"^\w+\|[^|]+\|")
    pick = lambda p: F.nullif(F.regexp_extract(header, p, 1), F.lit(""))
    out = raw.select(
        "_at",
        F.when(uniprot, F.regexp_extract(header, r"^\w+\|([^|]+)\|", 1)).otherwise(F.regexp_extract(header, r"^(\S+)", 1)).alias("accession"),
        F.when(uniprot, F.regexp_extract(header, r"^\w+\|[^|]+\|(\S+)", 1)).alias("name"),
        pick(r"OS=(.*?)(?: [A-Z]{2}=|$)").alias("organism"),
        F.coalesce(pick(r"GN=(\S+)"), pick(r"gene:(\S+)"), pick(r"gene_symbol:(\S+)")).alias("gene"),
        F.when(uniprot, F.trim(F.regexp_extract(header, r"^\S+ (.*?)(?: [A-Z]{2}=|$)", 1))).otherwise(F.trim(F.regexp_replace(header, r"^\S+", ""))).alias("description"),
        F.upper(sequence).alias("sequence"),
        header.contains(decoy_prefix).alias("is_decoy"),
    ).where("sequence <> ''")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("accession").orderBy("_at"))
    return out.withColumn("_n", n).withColumn("accession", F.when(F.col("_n") > 1, F.concat("accession", F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col("accession"))).drop("_n", "_at")


def transcribe(sequence: Column, template: bool = False) -> Column:
    """DNA to RNA: T becomes U on the coding strand; the template strand is complemented (FN24)."""
    return F.translate(sequence, "ACGTacgt", "UGCAugca") if template else F.translate(sequence, "Tt", "Uu")


def read_ptm_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, accession, target, position, mass, formula, keywords, problem): records end at //; problem names what a record lacks, null if nothing."""
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.regexp_replace("value", "\r", "").alias("block"))
    field = lambda tag: F.nullif(F.trim(F.regexp_extract("block", f"(?m)^{tag}\\s+(.*)$", 1)), F.lit(""))
    out = raw.where(F.col("block").rlike(r"(?m)^ID\s")).select(
        field("ID").alias("id"), field("AC").alias("accession"), F.regexp_replace(field("TG"), r"\.$", "").alias("target"), F.regexp_replace(field("PP"), r"\.$", "").alias("position"),
        field("MM").cast("double").alias("mass"), field("CF").alias("formula"),
        F.regexp_extract_all("block", F.lit(r"(?m)^KW\s+(.*?)\.?$"), 1).alias("keywords"),
    )
    return out.withColumn("problem", F.when(F.col("target").isNull(), "no target").when(F.col("mass").isNull() & F.col("formula").isNull(), "neither mass nor formula"))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, is_a, obsolete) of the terms of an ontology file."""
    raw = spark.read.option("lineSep", "\n[").text(path).select(F.regexp_replace("value", "\r", "").alias("block")).where("block LIKE 'Term]%'")
    return raw.select(
        F.regexp_extract("block", r"(?m)^id:\s*(\S+)", 1).alias("id"),
        F.regexp_extract("block", r"(?m)^name:\s*(.*)$", 1).alias("name"),
        F.regexp_extract_all("block", F.lit(r"(?m)^is_a:\s*(\S+)"), 1).alias("is_a"),
        F.col("block").rlike(r"(?m)^is_obsolete:\s*true").alias("obsolete"),
    )
