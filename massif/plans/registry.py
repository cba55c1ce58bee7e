"""Named queries over the test tables, each with the DuckDB statement that must give the same rows."""

from __future__ import annotations

from massif.plans import fdr, features, labelfree, lfq, library, quality, quant, ranges, scans, scores, sequence, spectra, streaming

MODULES = (quant, fdr, spectra, ranges, library, sequence, quality, streaming, lfq, scans, scores, features, labelfree)


def queries() -> dict:
    return {k: f for m in MODULES for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, (_, sql) in m.QUERIES.items() if sql}
