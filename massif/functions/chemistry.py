"""Masses, formulas and isotope distributions."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic residue masses of the amino acids.
RESIDUES = {
    "A": 71.03711381, "R": 156.10111105, "N": 114.04292747, "D": 115.02694307, "C": 103.00918451, "E": 129.04259313, "Q": 128.05857754, "G": 57.02146374, "H": 137.05891190,
    "I": 113.08406402, "L": 113.08406402, "K": 128.09496305, "M": 131.04048463, "F": 147.06841394, "P": 97.05276388, "S": 87.03202844, "T": 101.04767850, "W": 186.07931300,
    "Y": 163.06332857, "V": 99.06841395, "U": 150.95363559, "O": 237.14772686,
}
# Fixed values: (mass, abundance) of the isotopes of common elements.
ISOTOPES = {
    "H": ((1.00782503223, 0.999885), (2.01410177812, 0.000115)), "C": ((12.0, 0.9893), (13.00335483507, 0.0107)), "N": ((14.00307400443, 0.99636), (15.00010889888, 0.00364)),
    "O": ((15.99491461957, 0.99757), (16.99913175650, 0.00038), (17.99915961286, 0.00205)), "P": ((30.97376199842, 1.0),),
    "S": ((31.9720711744, 0.9499), (32.9714589098, 0.0075), (33.967867004, 0.0425), (35.96708071, 0.0001)), "Na": ((22.9897692820, 1.0),),
    "Cl": ((34.968852682, 0.7576), (36.965902602, 0.2424)), "K": ((38.9637064864, 0.932581), (39.963998166, 0.000117), (40.9618252579, 0.067302)), "F": ((18.99840316273, 1.0),),
}
PROTON = 1.007276466879
WATER = 18.01056468403
#: Atoms of an average residue.
AVERAGINE = {"C": 4.9384, "H": 7.7583, "O": 1.4773, "N": 1.3577, "S": 0.0417}
ATOM = r"([A-Z][a-z]?)(-?[0-9]*)"


def to_mz(mass: Column, charge: Column) -> Column:
    return mass / F.abs(charge) + F.signum(charge.cast("double")) * PROTON


def to_mass(mz: Column, charge: Column) -> Column:
    return F.abs(charge) * mz - charge * PROTON


def electrospray(mass: Column, lo: int, hi: int) -> Column:
    """Array of (charge, mz) for the charges lo to hi."""
    return F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda z: F.struct(z.alias("charge"), to_mz(mass, z).alias("mz")))


def bound(value: Column, body) -> Column:
    """body(value), where value is worked out once a row however often the body names it: inside lambdas it would be worked out anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def atoms(formula: Column) -> Column:
    """Array of (element, count) of a formula, in its order; an absent count is 1. Null for a text that is no formula."""
    names = F.regexp_extract_all(formula, F.lit(ATOM), 1)
    counts = F.regexp_extract_all(formula, F.lit(ATOM), 2)
    pairs = F.zip_with(names, counts, lambda e, n: F.struct(e.alias("element"), F.when(n == "", 1).otherwise(n.cast("int")).alias("count")))
    return F.when(formula.rlike(f"^({ATOM})+$"), pairs)


def composition(formula: Column) -> Column:
    """Map of element to count, repeated elements added up; elements whose counts cancel are left out."""

    def made(pairs: Column) -> Column:
        total = lambda e: F.aggregate(F.filter(pairs, lambda a: a.getField("element") == e), F.lit(0), lambda s, a: s + a.getField("count"))
        elements = F.array_distinct(F.transform(pairs, lambda a: a.getField("element")))
        return bound(elements, lambda names: F.map_filter(F.map_from_arrays(names, F.transform(names, total)), lambda e, n: n != 0))

    return bound(atoms(formula), made)


def combined(a: Column, b: Column, times: int = 1) -> Column:
    """Composition a plus `times` (which may be negative) composition b (FN5)."""
    none = F.lit(0)

    def made(x: Column, y: Column) -> Column:
        count = lambda e: F.coalesce(F.try_element_at(x, e), none) + times * F.coalesce(F.try_element_at(y, e), none)
        return bound(F.array_union(F.map_keys(x), F.map_keys(y)), lambda keys: F.map_filter(F.map_from_arrays(keys, F.transform(keys, count)), lambda e, n: n != 0))

    return bound(a, lambda x: bound(b, lambda y: made(x, y)))


def contains(a: Column, b: Column) -> Column:
    """Whether composition a has at least the atoms of b (FN5: superset)."""
    return bound(a, lambda own: F.forall(F.map_entries(b), lambda x: F.coalesce(F.try_element_at(own, x["key"]), F.lit(0)) >= x["value"]))


def composition_text(a: Column) -> Column:
    """Elements by name with their counts."""
    return bound(a, lambda x: F.array_join(F.transform(F.array_sort(F.map_keys(x)), lambda e: F.concat(e, F.element_at(x, e).cast("string"))), ""))


def formula_mass(formula: Column) -> Column:
    """Monoisotopic mass; null where an element is unknown."""
    table = F.create_map(*[F.lit(x) for e, iso in ISOTOPES.items() for x in (e, iso[0][0])])
    return F.aggregate(atoms(formula), F.lit(0.0), lambda acc, a: acc + F.element_at(table, a.getField("element")) * a.getField("count"))


def hill(formula: Column) -> Column:
    """Carbon, hydrogen, then the other elements by name; all by name without carbon. Counts of 1 are left out."""

    def made(pairs: Column) -> Column:
        elements = F.array_distinct(F.transform(pairs, lambda a: a.getField("element")))
        total = lambda e: F.aggregate(F.filter(pairs, lambda a: a.getField("element") == e), F.lit(0), lambda s, a: s + a.getField("count"))
        count = lambda e: bound(total(e), lambda n: F.when(n == 1, F.lit("")).otherwise(n.cast("string")))

        def ordered(names: Column, has_c: Column) -> Column:
            rank = lambda e: F.concat(F.when(has_c & (e == "C"), F.lit("0")).when(has_c & (e == "H"), F.lit("1")).otherwise(F.lit("2")), e)
            return F.transform(F.array_sort(F.transform(names, rank)), lambda x: F.substring(x, 2, 9))

        in_order = bound(elements, lambda names: bound(F.array_contains(names, "C"), lambda has_c: ordered(names, has_c)))
        return F.array_join(F.transform(in_order, lambda e: F.concat(e, count(e))), "")

    return bound(atoms(formula), made)


def parsed(formula: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for e, n in re.findall(ATOM, formula):
        out[e] = out.get(e, 0) + int(n or 1)
    return out


def _joined(m: np.ndarray, p: np.ndarray, least: float, merge: float) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(m)
    m, p = m[order], p[order]
    group = np.concatenate([[0], np.cumsum(np.diff(m) > merge)])
    total = np.bincount(group, p)
    mean = np.bincount(group, m * p) / total
    keep = total >= least
    return mean[keep], total[keep]


def _product(a, b, least: float, merge: float) -> tuple[np.ndarray, np.ndarray]:
    return _joined(np.add.outer(a[0], b[0]).ravel(), np.multiply.outer(a[1], b[1]).ravel(), least, merge)


@lru_cache(maxsize=10_000)
def _power(element: str, bit: int, least: float, merge: float) -> tuple[np.ndarray, np.ndarray]:
    """The distribution of 2 ** bit atoms of an element."""
    if not bit:
        return tuple(np.array(x) for x in zip(*ISOTOPES[element]))
    half = _power(element, bit - 1, least, merge)
    return _product(half, half, least, merge)


@lru_cache(maxsize=10_000)
def _distribution(atoms: tuple, least: float, merge: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the atoms (element, number) in their order; formulas that begin alike share what they begin with."""
    if not atoms:
        return np.zeros(1), np.ones(1)
    out, (element, n) = _distribution(atoms[:-1], least, merge), atoms[-1]
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            out = _product(out, _power(element, bit, least, merge), least, merge)
    return out


def isotope_distribution(formula: dict[str, int], least: float = 1e-8, merge: float = 0.125) -> tuple[np.ndarray, np.ndarray]:
    """(masses, abundances): isotopologues within `merge` Da joined at their weighted mean, those below `least` dropped; each element by binary powers."""
    return tuple(x.copy() for x in _distribution(tuple(formula.items()), least, merge))


def averagine_atoms(mass: float) -> tuple[int, ...]:
    """Atoms of an average peptide of about this mass, in the order of AVERAGINE."""
    unit = sum(n * ISOTOPES[e][0][0] for e, n in AVERAGINE.items())
    return tuple(max(0, round(n * mass / unit)) for n in AVERAGINE.values())


def averagine_of(*counts: int) -> tuple[np.ndarray, np.ndarray]:
    """Isotope masses less the monoisotopic one and abundances of an average peptide of these atoms."""
    formula = dict(zip(AVERAGINE, counts))
    m, p = isotope_distribution(formula)
    return m - sum(n * ISOTOPES[e][0][0] for e, n in formula.items()), p


def averagine(mass: float) -> tuple[np.ndarray, np.ndarray]:
    """Isotope masses less the monoisotopic one and abundances of an average peptide of about this mass."""
    return averagine_of(*averagine_atoms(mass))
