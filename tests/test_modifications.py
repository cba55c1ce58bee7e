"""Modified digestion products against the rules written out."""

from __future__ import annotations

import random
from itertools import combinations, product

import pytest

from massif.functions.chemistry import RESIDUES, WATER
from massif.operators import modifications as M

OXIDATION = M.Mod("Oxidation", "Common", "M", "Anywhere.", 15.9949)
PHOSPHO = M.Mod("Phospho", "Common", "S", "Anywhere.", 79.9663)
SUGAR = M.Mod("HexNAc", "Glyco", "Nxs", "Anywhere.", 203.0794)
ACETYL = M.Mod("Acetyl", "Common", "X", "N-terminal.", 42.0106)
PYRO = M.Mod("Pyro", "Common", "Q", "Peptide N-terminal.", -17.0265)
AMIDE = M.Mod("Amide", "Common", "X", "C-terminal.", -0.984)
CAM = M.Mod("Carbamidomethyl", "Fixed", "C", "Anywhere.", 57.0215)
TAG = M.Mod("Tag", "Fixed", "X", "Peptide N-terminal.", 229.163)


def test_motifs_and_places():
    assert [at for at in range(1, 9) if M.motif_fits("Nxs", "NASNANS", at)] == [1] and M.motif_fits("xxS", "NAS", 3)
    assert M.motif_fits("B", "D", 1) and not M.motif_fits("B", "E", 1) and not M.motif_fits("Nxs", "NA", 1)
    seq = "MQCMSK"
    assert [M.fits(ACETYL, seq, at, 1, 6) for at in (1, 2, 3)] == [True, True, False]
    assert [M.fits(PYRO, seq, 2, s, 6) for s in (1, 2)] == [False, True]
    assert M.fits(AMIDE, seq, 6, 4, 6) and not M.fits(AMIDE, seq, 5, 4, 5)


def test_patterns_come_fewest_first_and_in_depth_first_order():
    places = {1: [ACETYL], 9: [AMIDE], 3: [OXIDATION, PHOSPHO]}

    def depth_first(keys, k):
        if not keys:
            return [{}] if k == 0 else []
        out = depth_first(keys[1:], k)
        for mod in places[keys[0]]:
            out += [{keys[0]: mod, **x} for x in depth_first(keys[1:], k - 1)] if k else []
        return out

    assert list(M.patterns(places, 3)) == [x for k in range(4) for x in depth_first([1, 9, 3], k)]


def test_fixed_ones_give_way():
    seq = "MCKQCR"
    first = dict.fromkeys([M.written(seq[0:3], M.fixed_places((CAM, TAG), seq, 1, 3))])
    assert list(first) == ["[Fixed:Tag]MC[Fixed:Carbamidomethyl]K"]
    got = list(M.forms(seq, 4, 6, (CAM, TAG), (PYRO,), [], 2, 10))
    assert [g[:3] for g in got] == [("[Fixed:Tag]QC[Fixed:Carbamidomethyl]R", 0, 2), ("[Common:Pyro]QC[Fixed:Carbamidomethyl]R", 1, 1)]
    assert got[1][3] == pytest.approx(sum(RESIDUES[c] for c in "QCR") + WATER + CAM.mass + PYRO.mass)
    assert list(M.forms(seq, 4, 6, (M.Mod("Cut", "Protease", "X", "Peptide N-terminal.", 1.0),), (), [], 0, 5))[0][0] == "Q[Protease:Cut]CR"


def plain(seq, a, b, fixed, variable, most):
    """The set of forms, by all choices of places."""
    n, sites = b - a + 1, {}
    for m in variable:
        for at in range(a, b + 1):
            if M.fits(m, seq, at, a, b):
                place = 1 if m.place in M.FIRST else n + 2 if m.place in M.LAST else at - a + 2
                if (place == 1) <= (at == a) and (place == n + 2) <= (at == b):
                    sites.setdefault(place, set()).add(m)
    out = []
    for k in range(most + 1):
        for keys in combinations(sites, k):
            for mods in product(*(sites[x] for x in keys)):
                own = M.fixed_places(fixed, seq, a, b) | dict(zip(keys, mods))
                out.append((M.written(seq[a - 1 : b], own), k))
    return sorted(out)


def test_digest_with_modifications(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ACKRMSNQTP") for _ in range(rng.randint(1, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "MMMBK")]
    df = spark.createDataFrame(rows, "id int, seq string")
    fixed, variable = [CAM], [OXIDATION, PHOSPHO, SUGAR, ACETYL, PYRO, AMIDE]
    got = {}
    for r in M.modified_digest(df, "seq", "KR", fixed, variable, "P", missed=1, min_length=2, initiator="retain", most_mods=2).collect():
        got.setdefault((r.id, r.start, r.end), []).append((r.full_sequence, r.n_variable))
        assert (r.mass is None) == ("B" in r.peptide)
    seqs = dict(rows)
    assert len(got) > 60
    for (i, a, b), forms in got.items():
        assert sorted(forms) == plain(seqs[i], a, b, tuple(fixed), variable, 2)


def test_limits_and_annotations(spark):
    df = spark.createDataFrame([(1, "MSMSMSMK", 1, 8, [(2, "Phospho"), (99, "Phospho"), (3, "Unknown")]), (2, "MSK", 1, 3, None), (3, None, 1, 3, [])], "id int, seq string, start int, end int, notes array<struct<position:int,name:string>>")
    rows = M.modified_products(df, "seq", [], [OXIDATION], "notes", [PHOSPHO], most_mods=3, most_forms=7).orderBy("id").collect()
    assert [r.full_sequence for r in rows if r.id == 1][:3] == ["MSMSMSMK", "MS[Common:Phospho]MSMSMK", "MSMSMSM[Common:Oxidation]K"] and sum(r.id == 1 for r in rows) == 7
    assert [r.full_sequence for r in rows if r.id == 2] == ["MSK", "M[Common:Oxidation]SK"]
    assert M.modified_products(df.limit(0), "seq", [CAM], [OXIDATION]).count() == 0
