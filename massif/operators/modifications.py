"""Digestion products with fixed, variable and annotated modifications.

Products are rows dealt anew after the digestion, so a long sequence is no single task; a product's forms are made one after the other, up to a limit, and handed on in small batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.functions.chemistry import RESIDUES, WATER
from massif.operators.sequence import digest
from massif.runtime import ship, shuffle_partitions

#: Forms that a task hands on at once.
BATCH = 20_000
# Letters of a motif that stand for several residues.
CLASSES = {"B": "DN", "J": "IL", "Z": "EQ"}
FIRST = ("N-terminal.", "Peptide N-terminal.", "5'-terminal.", "Oligo 5'-terminal.")
LAST = ("C-terminal.", "Peptide C-terminal.", "3'-terminal.", "Oligo 3'-terminal.")


@dataclass(frozen=True)
class Mod:
    """A modification: its name and kind, the motif it needs (the capital is the residue that carries it, X any residue), its place and its mass."""

    name: str
    kind: str
    motif: str
    place: str
    mass: float

    @property
    def label(self) -> str:
        return f"[{self.kind}:{self.name}]"


def motif_fits(motif: str, seq: str, at: int) -> bool:
    """Whether a motif's capital can be the residue at (1-based) of a sequence, all of the motif lying inside."""
    capital = next((i for i, c in enumerate(motif) if c.isupper()), -1)
    first = at - capital - 1
    if first < 0 or first + len(motif) > len(seq):
        return False
    return all(c == "X" or seq[first + i] in CLASSES.get(c, c) for i, c in enumerate(motif.upper()))


def fits(mod: Mod, seq: str, at: int, start: int, end: int) -> bool:
    """Whether a product (start to end of seq, 1-based) can carry a modification at a residue of it (PF17)."""
    if not motif_fits(mod.motif, seq, at):
        return False
    if mod.place in ("N-terminal.", "5'-terminal."):
        return at <= 2
    if mod.place in ("C-terminal.", "3'-terminal."):
        return at == len(seq)
    if mod.place in FIRST:
        return at == start
    return at == end if mod.place in LAST else True


def fixed_places(mods: tuple[Mod, ...], seq: str, start: int, end: int) -> dict[int, Mod]:
    """{place: modification}: 1 is the first end, residue r (from 1) r + 1, the last end the length + 2. A later one takes a residue over; a sequence's own end beats a product's (GEN8)."""
    n, out = end - start + 1, {}
    for mod in mods:
        for ends, at, place, own, cut in ((FIRST, start, 1, start == 1, 2), (LAST, end, n + 2, end == len(seq), n + 1)):
            if mod.place in ends and fits(mod, seq, at, start, end):
                if mod.kind == "Protease":
                    if not own:
                        out[cut] = mod
                elif not own or place not in out or not mod.place.startswith(("Peptide", "Oligo")):
                    out[place] = mod
        if mod.place == "Anywhere.":
            out.update({at - start + 2: mod for at in range(start, end + 1) if fits(mod, seq, at, start, end)})
    return out


def variable_places(mods: tuple[Mod, ...], annotated: list[tuple[int, Mod]], seq: str, start: int, end: int) -> dict[int, list[Mod]]:
    """{place: modifications by name} in the order in which places come up: both ends, then residues by modification; annotated ones (position in seq, modification) count at their own place."""
    n = end - start + 1
    out: dict[int, set[Mod]] = {1: set(), n + 2: set()}

    def put(mod: Mod, at: int) -> None:
        if mod.place in FIRST and at == start and fits(mod, seq, at, start, end):
            out[1].add(mod)
        if mod.place == "Anywhere." and fits(mod, seq, at, start, end):
            out.setdefault(at - start + 2, set()).add(mod)
        if mod.place in LAST and at == end and fits(mod, seq, at, start, end):
            out[n + 2].add(mod)

    for mod in mods:
        for at in range(start, end + 1):
            put(mod, at)
    for at, mod in annotated:
        if start <= at <= end:
            put(mod, at)
    return {k: sorted(v, key=lambda m: (m.name, m.kind, m.motif)) for k, v in out.items() if v}


def patterns(places: dict[int, list[Mod]], most: int) -> Iterator[dict[int, Mod]]:
    """Choices of up to `most` places and a modification for each: fewest first; of equally many, those whose first place comes up last (GEN9)."""
    keys = list(places)

    def chosen(first: int, k: int) -> Iterator[dict[int, Mod]]:
        if not k:
            yield {}
            return
        for i in range(len(keys) - k, first - 1, -1):
            for mod in places[keys[i]]:
                for rest in chosen(i + 1, k - 1):
                    yield {keys[i]: mod, **rest}

    for k in range(min(most, len(keys)) + 1):
        yield from chosen(0, k)


def written(peptide: str, mods: dict[int, Mod]) -> str:
    """The product with its modifications in brackets, one of the last end after a dash."""
    n = len(peptide)
    out = [mods[1].label] if 1 in mods else []
    for r, c in enumerate(peptide, 2):
        out.append(c + (mods[r].label if r in mods else ""))
    return "".join(out) + (f"-{mods[n + 2].label}" if n + 2 in mods else "")


def forms(seq: str, start: int, end: int, fixed: tuple[Mod, ...], variable: tuple[Mod, ...], annotated: list[tuple[int, Mod]], most_mods: int, most_forms: int) -> Iterator[tuple[str, int, int, float | None]]:
    """(full sequence, variable modifications, fixed ones, mass) of a product; a variable modification takes the place of a fixed one, the mass is None where a residue is unknown."""
    peptide = seq[start - 1 : end]
    base = sum((RESIDUES[c] for c in peptide), WATER) if all(c in RESIDUES for c in peptide) else None
    own = fixed_places(fixed, seq, start, end)
    for pattern in islice(patterns(variable_places(variable, annotated, seq, start, end), most_mods), most_forms):
        mods = own | pattern
        yield written(peptide, mods), len(pattern), len(mods) - len(pattern), None if base is None else base + sum(m.mass for m in mods.values())


def modified_products(products: DataFrame, seq: str, fixed: list[Mod], variable: list[Mod], annotated: str | None = None, known: list[Mod] | None = None, most_mods: int = 2, most_forms: int = 1024) -> DataFrame:
    """products (seq, start, end, ...) with full_sequence, n_variable, n_fixed and mass: a row for each form, unmodified first, at most most_forms of them (GEN8, GEN9, SORT7).

    annotated names an array column of (position, name) of what a database says of a sequence, names being among known. Rows whose sequence, start or end is null have no form.
    """
    ship(products.sparkSession)
    by_name: dict[str, list[Mod]] = {}
    for m in known or []:
        by_name.setdefault(m.name, []).append(m)
    columns = products.columns
    fixed_, variable_ = tuple(fixed), tuple(variable)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows, places = [], []
            lists = x[annotated] if annotated else [None] * len(x)
            for i, (s, a, b, extra) in enumerate(zip(x[seq], x["start"], x["end"], lists)):
                if s is None or a is None or b is None or a != a or b != b:
                    continue
                own = [(int(p["position"]), m) for p in (extra if extra is not None else []) for m in by_name.get(p["name"], [])]
                for form in forms(s, int(a), int(b), fixed_, variable_, own, most_mods, most_forms):
                    rows.append(form)
                    places.append(i)
                    if len(rows) >= BATCH:
                        yield frame(x, places, rows)
                        rows, places = [], []
            if rows:
                yield frame(x, places, rows)

    def frame(x: pd.DataFrame, places: list[int], rows: list) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["full_sequence", "n_variable", "n_fixed", "mass"])
        return pd.concat([x.iloc[places].reset_index(drop=True), made], axis=1)

    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in products.schema.fields], "full_sequence string, n_variable int, n_fixed int, mass double"])
    return products.select(*columns).mapInPandas(run, kinds)


def modified_digest(proteins: DataFrame, seq: str, cut_after: str, fixed: list[Mod], variable: list[Mod], prevented_by: str = "", missed: int = 2, min_length: int = 7, max_length: int = 1 << 30, initiator: str = "variable", **more) -> DataFrame:
    """The digestion of sequences, each product with its forms (GEN5); the arguments are those of digest() and of modified_products()."""
    products = digest(proteins, seq, cut_after, prevented_by, missed, min_length, max_length, initiator)
    # a long sequence's products go to many tasks
    dealt = products.repartition(shuffle_partitions(proteins.sparkSession), F.xxhash64(seq, "start", "end"))
    return modified_products(dealt, seq, fixed, variable, **more)
