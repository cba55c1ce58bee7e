"""Readers and writers of result tables: search results, features, reports, design tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massif.operators.prefix import fill

# Known result tables, by a column that tells them apart: (format, separator, columns that must be there).
FORMATS = (
    ("psm_tsv", "\t", ("Scan Number", "Base Sequence", "Full Sequence")),
    ("diann_report", "\t", ("Precursor.Id", "Protein.Group")),
    ("msfragger_psm", "\t", ("Spectrum", "Peptide", "Hyperscore")),
    ("topfd_feature", "\t", ("Feature_ID", "Mass", "Intensity")),
    ("flashdeconv_feature", "\t", ("FeatureIndex", "MonoisotopicMass")),
    ("dinosaur_feature", "\t", ("mostAbundantMz", "rtApex")),
    ("crux_psm", "\t", ("spectrum precursor m/z", "tdc q-value")),
    ("quantified_peaks", "\t", ("File Name", "Peak intensity")),
    ("topfd_mzrt", ",", ("Min_frac_id", "Mass", "Abundance")),
    ("pathfinder", "\t", ("Scan", "Pre", "#MatchedFragments")),
)


def sniff(header: str) -> tuple[str, str] | None:
    """(format, separator) of a header line; the first that has all its columns."""
    for name, sep, columns in FORMATS:
        if set(columns) <= {x.strip().strip('"') for x in header.split(sep)}:
            return name, sep
    return None


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str | None = None) -> DataFrame:
    """A result table of any known kind, all columns as text; only `columns`, where they exist, are kept and read."""
    if sep is None:
        head = spark.read.text(path).first()
        found = sniff(head["value"]) if head else None
        if not found:
            raise ValueError(f"no known result table: {path}")
        sep = found[1]
    df = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns]) if columns is not None else df


def number(column: str) -> Column:
    """A nullable number: text that is none becomes null, and of several joined by | the first counts."""
    return F.expr(f"try_cast(split(`{column}`, '[|]')[0] AS double)")


def read_psm_tsv(spark: SparkSession, path: str, row_filters: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, bad rows) of a spectrum-match table. row_filters: SQL conditions by column, put before anything else is parsed.

    A row is bad if its scan number or its base sequence cannot be read. Reporter-ion columns become one array, null if all are absent.
    """
    raw = read_table(spark, path, sep="\t")
    for column, condition in (row_filters or {}).items():
        if column in raw.columns:
            raw = raw.where(condition)
    names = {
        "File Name": "file", "Scan Number": "scan", "Scan Retention Time": "rt_min", "Precursor Charge": "charge", "Precursor MZ": "precursor_mz", "Precursor Mass": "precursor_mass",
        "Base Sequence": "base_sequence", "Full Sequence": "full_sequence", "Protein Accession": "accession", "Score": "score", "QValue": "q_value", "PEP": "pep",
        "Decoy/Contaminant/Target": "kind", "Matched Ion Mass-To-Charge Ratios": "matched_ions",
    }
    texts = {"file", "base_sequence", "full_sequence", "accession", "kind", "matched_ions"}
    channels = [c for c in raw.columns if c[:3].isdigit()]
    fields = [(F.col(f"`{c}`") if new in texts else number(c)).alias(new) for c, new in names.items() if c in raw.columns]
    reporter = F.array(*[number(c) for c in channels]) if channels else F.lit(None).cast("array<double>")
    out = raw.select(*fields, F.when(F.exists(reporter, lambda x: x.isNotNull()), reporter).alias("reporter_ions"))
    out = out.withColumn("scan", F.col("scan").cast("int"))
    good = F.col("scan").isNotNull() & (F.coalesce("base_sequence", F.lit("")) != "")
    return out.where(good), out.where(~good)


def parse_matched_ions(column: Column) -> Column:
    """Array of (ion, number, charge, mz) from [b2+1:199.1, y1+1:175.1];[...] (FN21)."""
    parts = F.regexp_extract_all(column, F.lit(r"([A-Za-z]+\d+(?:-[0-9.]+)?\+\d+:[0-9.]+)"), 1)
    pick = lambda x, p, i: F.regexp_extract(x, p, i)
    pattern = r"^([A-Za-z]+)(\d+)(?:-[0-9.]+)?\+(\d+):([0-9.]+)$"
    return F.transform(parts, lambda x: F.struct(pick(x, pattern, 1).alias("ion"), pick(x, pattern, 2).cast("int").alias("number"), pick(x, pattern, 3).cast("int").alias("charge"), pick(x, pattern, 4).cast("double").alias("mz")))


def until_first_failure(df: DataFrame, order: str, condition: Column) -> DataFrame:
    """Rows before the first, by order, that fails the condition: what a scan of a sorted file with a terminating filter returns (SRC14).

    One aggregate finds the place; no row is compared with all others.
    """
    stop = df.agg(F.min(F.when(~condition, F.col(order))).alias("_stop"))
    return df.join(F.broadcast(stop)).where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def fill_alternatives(df: DataFrame, order: str, id_col: str) -> DataFrame:
    """Rows without an id belong to the last row before them that has one (SRC32, W16); ids are carried along over ranges of the order."""
    return fill(df, [F.col(order)], id_col, "owner")


def per_charge(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """A row for each charge of a feature's range (SRC28, GEN25)."""
    return df.withColumn("charge", F.explode(F.sequence(F.col(lo).cast("int"), F.col(hi).cast("int"))))


def read_sdrf(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, column, name, value): a design table in long form; rows may be ragged and names repeat. A byte-order mark and any line ends are taken."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split(F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r\n?", "\n"), "\n").alias("lines"))
    names = F.split(F.col("lines")[0], "\t")
    rows = text.select("file", names.alias("names"), F.posexplode(F.slice("lines", 2, 1 << 30)).alias("row", "line")).where("trim(line) <> ''")
    cells = rows.select("file", "row", "names", F.posexplode(F.split("line", "\t")).alias("column", "value"))
    return cells.select("file", "row", "column", F.lower(F.trim(F.get("names", F.col("column")))).alias("name"), F.trim("value").alias("value"))


def merge_sdrf(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two long design tables; cells that one of them lacks read "not available" (SET3)."""
    both = a.unionByName(b)
    slots = both.withColumn("slot", F.row_number().over(Window.partitionBy("file", "row", "name").orderBy("column")))
    names = slots.select("name", "slot").distinct()
    rows = slots.select("file", "row").distinct()
    grid = rows.join(F.broadcast(names))
    return grid.join(slots.drop("column"), ["file", "row", "name", "slot"], "left").withColumn("value", F.coalesce("value", F.lit("not available")))


def build_sdrf(cells: DataFrame, names: list[str]) -> DataFrame:
    """The wide table of (row, name, value), in the given order of names (SRC37)."""
    wide = cells.groupBy("row").pivot("name", names).agg(F.first("value"))
    return wide.select("row", *[F.coalesce(F.col(f"`{n}`"), F.lit("not available")).alias(n) for n in names])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_quantification(peaks: DataFrame, peptides: DataFrame, proteins: DataFrame, folder: str) -> None:
    """The three result tables as TSV folders (SRC35, SRC39)."""
    for name, df in (("peaks", peaks), ("peptides", peptides), ("proteins", proteins)):
        write_tsv(df, f"{folder}/{name}")
