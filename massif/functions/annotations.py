"""Parsing and writing of annotation texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from massif.functions.chemistry import ISOTOPES, parsed

# Product types and the atoms that their neutral mass has over the sum of the residues.
PRODUCT_ATOMS = {
    "a": "C-1O-1", "aStar": "C-1O-1N-1H-3", "aDegree": "C-1O-2H-2", "b": "", "bAmmoniaLoss": "N-1H-3", "bWaterLoss": "H-2O-1", "c": "N1H3", "x": "C1O2", "y": "H2O1",
    "yAmmoniaLoss": "O1H-1N-1", "yWaterLoss": "", "zDot": "O1N-1H-1", "zPlusOne": "O1H1N-1", "M": "", "D": "", "Y": "", "Ycore": "",
}
# Fixed value: the masses of an electron and a proton, which a zDot product has besides its atoms.
ELECTRON, PROTON = 0.00054857990946, 1.007276466879
# Product types that are known and have no shift of their own (nucleic acids).
UNSHIFTED = tuple("aWaterLoss aBaseLoss bBaseLoss cWaterLoss cBaseLoss d dWaterLoss dBaseLoss w wWaterLoss wBaseLoss xWaterLoss xBaseLoss yBaseLoss z zWaterLoss zBaseLoss".split())
# Product types of each way of dissociation, those that hold the first residue and those that hold the last, and the losses that may be looked for besides.
DISSOCIATION = {
    "Unknown": (), "CID": ("b", "y"), "LowCID": ("b", "y", "aStar", "bAmmoniaLoss", "yAmmoniaLoss", "aDegree", "bWaterLoss", "yWaterLoss"), "IRMPD": ("b", "y"), "ECD": ("c", "zDot"), "PQD": (), "ETD": ("c", "zDot"),
    "HCD": ("b", "y"), "AnyActivationType": ("b", "y"), "EThcD": ("b", "y", "c", "zDot"), "Custom": (), "ISCID": (),
}
FIRST = ("a", "aDegree", "aStar", "b", "bWaterLoss", "bAmmoniaLoss", "c")
LAST = ("x", "y", "yWaterLoss", "yAmmoniaLoss", "zDot", "zPlusOne")
LOSSES = ("bWaterLoss", "bAmmoniaLoss", "yWaterLoss", "yAmmoniaLoss")
WITH_LOSSES = ("CID", "IRMPD", "HCD", "AnyActivationType", "EThcD")

# Fixed value: a substitution stands in brackets after the residue, as the number of changed nucleotides, the words "nucleotide substitution:", and "X->Y on Z".
SUBSTITUTION = "\\[\\d+\\+?\\s*nucleotide substitution:\\s*([A-Z])->([A-Z]) on ([A-Z])\\]"


SHIFTS = {k: float(sum(n * ISOTOPES[e][0][0] for e, n in parsed(v).items())) + (ELECTRON + PROTON if k == "zDot" else 0.0) for k, v in PRODUCT_ATOMS.items()} | dict.fromkeys(UNSHIFTED, 0.0)


def product_shift(product: Column) -> Column:
    """Neutral mass shift of a product type (FN53); an unknown one is an error, null has none."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in SHIFTS.items() for x in pair]), product)
    return F.when(product.isNotNull() & known.isNull(), F.raise_error(F.concat(F.lit("unknown product type: "), product)).cast("double")).otherwise(known)


def product_types(dissociation: str, terminus: str = "both", losses: bool = False) -> tuple[str, ...]:
    """Product types of a way of dissociation that hold the first residue, the last one, or both kinds, with those of lost water and ammonia if asked for (FN54)."""
    ends = {"first": FIRST, "last": LAST, "both": FIRST + LAST, "none": ()}[terminus]
    own = DISSOCIATION[dissociation] + (LOSSES if losses and dissociation in WITH_LOSSES else ())
    return tuple(k for k in ends if k in own)


def essential_sequence(full: Column, kinds: list[str]) -> Column:
    """The sequence with only the modifications [type:name] whose type is in kinds (FN14)."""
    return F.regexp_replace(full, f"-?\\[(?!(?:{'|'.join(kinds)}):)[^\\]]*\\]", "")


def with_mass_shifts(full: Column, masses: dict[str, float]) -> Column:
    """The sequence with each known modification [type:name] written as its signed mass (FN14)."""
    for name, mass in masses.items():
        full = F.regexp_replace(full, f"\\[[^\\]:]*:{name}\\]", f"[{mass:+.6f}]")
    return full


def substituted(full: Column) -> Column:
    """The sequence with each substitution X->Y carried out at the last X before its bracket, which goes (FN15)."""

    def once(state: Column, _: Column) -> Column:
        at = F.regexp_instr(state, F.lit(SUBSTITUTION))
        head, rest = F.substr(state, F.lit(1), at - 1), F.substr(state, at)
        old, new = F.regexp_extract(rest, SUBSTITUTION, 1), F.regexp_extract(rest, SUBSTITUTION, 2)
        back = F.instr(F.reverse(head), old)
        place = F.length(head) - back + 1
        changed = F.when(back > 0, F.concat(F.substr(head, F.lit(1), place - 1), new, F.substr(head, place + 1))).otherwise(head)
        return F.concat(changed, F.regexp_replace(rest, f"^{SUBSTITUTION}", ""))

    found = F.regexp_extract_all(full, F.lit(SUBSTITUTION), 0)
    return F.aggregate(found, full, once)


def signed_mass(text: Column) -> Column:
    """A label's mass difference, a sign and a number (FN52); null for anything else."""
    return F.when(text.rlike("^[+-][0-9.]+$"), text.try_cast("double"))


def modified_date(text: Column, default: Column) -> Column:
    """The date of an entry, year-month-day, or the default (FN26)."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), default)


def uniprot_header(accession: Column, name: Column, full_name: Column, organism: Column, gene: Column, taxonomy: Column) -> Column:
    """A FASTA header; the taxonomy is left out where it is unknown (FN27)."""
    taxon = F.when(F.coalesce(taxonomy, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" OX="), taxonomy))
    return F.concat(F.lit("mz|"), accession, F.lit("|"), name, F.lit(" "), full_name, F.lit(" OS="), organism, taxon, F.lit(" GN="), F.coalesce(gene, F.lit("")))


def localised_glycans(text: Column) -> Column:
    """Array of (site, glycan, probability) of a text like [5,H5N2,0.9][8,H3N2,0.1] (FN47); empty for null."""
    items = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\[\\]]"), lambda x: x != "")
    cell = lambda x, i: F.get(F.split(x, ","), F.lit(i))
    return F.transform(items, lambda x: F.struct(cell(x, 0).cast("int").alias("site"), cell(x, 1).alias("glycan"), cell(x, 2).cast("double").alias("probability")))


def all_same(values: Column) -> Column:
    """Whether an array has one value only; true for an empty one (FN22)."""
    return F.size(F.array_distinct(values)) <= 1


def null_or_empty(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)) <= 0
