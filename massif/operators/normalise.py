"""Normalisation of a label-free matrix over fractions, biological and technical replicates.

The table has one row for each (sequence, run); a design (run, condition, biorep, fraction, techrep) says what a run is. Factors come from aggregates over sequences; the
driver holds factors and sums of them, as many numbers as the design has samples times squared fractions.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.runtime import Scratch, ship

#: Factors of fractions stay within these bounds, and are looked for at these steps first.
LEAST, MOST, STEP = 0.3, 3.0, 0.01
#: Rows that a task weighs at once, and that it holds of all samples until they fill such blocks.
BATCH, HELD = 4096, 262_144


def _with_reference(df: DataFrame, design: DataFrame) -> tuple[DataFrame, tuple]:
    """df with its design, and the (condition, biorep) of reference: biorep 0 of the first condition in order."""
    first = design.where("biorep = 0 AND techrep = 0").agg(F.min("condition")).first()[0]
    return df.join(F.broadcast(design) if design.limit(100_001).count() <= 100_000 else design, "run"), first


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """(sample, data) of the rows (sample, ref, values): blocks of up to BATCH rows of a sample, as the bytes of their logarithms of ref and their n values each, which a pass reads as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        count = 0

        def blocks(least: int) -> Iterator[pa.RecordBatch]:
            for s in list(held):
                ref, values = (np.concatenate(x) for x in zip(*held.pop(s)))
                full = len(ref) // least * least
                for a in range(0, full, BATCH):
                    made = np.concatenate([ref[a : min(a + BATCH, full)], values[a : min(a + BATCH, full)].ravel()])
                    yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([made.tobytes()], pa.binary())], ["sample", "data"])
                if full < len(ref):
                    held[s] = [(ref[full:], values[full:])]

        for batch in batches:
            sample, ref = (batch.column(i).to_numpy() for i in (0, 1))
            ref, values = np.log(ref), batch.column(2).flatten().to_numpy().reshape(-1, n)
            for s in np.unique(sample).tolist():
                own = np.flatnonzero(sample == s)
                held.setdefault(s, []).append((ref[own], values[own]))
            count += len(sample)
            if count >= HELD:
                yield from blocks(BATCH)
                count = sum(len(r) for parts in held.values() for r, _ in parts)
                if count >= HELD // 2:
                    # so many samples that few fill a block
                    yield from blocks(1)
                    count = 0
        yield from blocks(1)

    return rows.select("sample", "ref", "values").mapInArrow(run, "sample long, data binary")


def _partials(rows: DataFrame, n: int, tried: dict[int, np.ndarray], normal: bool) -> dict[int, np.ndarray]:
    """Sums over the blocks (sample, data) of each sample: of |log residual| for each of the factor vectors tried[sample] (m, n), or, with normal, of the weighted normal equations at its one vector.

    Each task adds up its rows' sums; one row for each number and sample goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if s not in tried:
                    continue
                x = np.frombuffer(data.as_buffer())
                k = len(x) // (n + 1)
                r, v = x[:k], x[k:].reshape(k, n)
                if normal:
                    f = tried[s][0]
                    part = v * f
                    total = part.sum(axis=1)
                    e, j = np.log(total) - r, part / total[:, None]
                    w = 1 / np.maximum(np.abs(e), 1e-9)
                    made = np.concatenate([(j.T @ (j * w[:, None])).ravel(), j.T @ (w * e)])
                else:
                    made = np.abs(np.log(v @ tried[s].T) - r[:, None]).sum(axis=0)
                sums[s] = sums.get(s, 0) + made
        for s, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), s)), pa.array(np.arange(len(x))), pa.array(x)], ["sample", "k", "v"])

    total = rows.select("sample", "data").mapInArrow(run, "sample long, k long, v double").groupBy("sample", "k").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in total.orderBy("sample", "k").collect():
        out.setdefault(r.sample, []).append(r.v)
    return {s: np.array(v) for s, v in out.items()}


def fraction_factors(df: DataFrame, design: DataFrame, rounds: int = 30) -> DataFrame:
    """(condition, biorep, fraction, factor): factors between 0.3 and 3 that bring each sample's sequences, summed over fractions, closest to the reference sample's: the least sum of |log ratio| over sequences seen in both.

    Only technical replicate 0 counts. Each fraction's factor is first looked for alone on a grid, then all together by reweighted least squares, whose normal equations are summed over tasks; what does not lower the error is not kept. A sample
    without shared sequences, and a design without a second fraction, has factors of 1.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "fractions")
    full, first = _with_reference(df.where("intensity > 0"), design)
    n = (design.agg(F.max("fraction")).first()[0] or 0) + 1
    samples = design.select("condition", "biorep", "fraction").distinct()
    if n == 1:
        return samples.withColumn("factor", F.lit(1.0))
    own = full.where("techrep = 0").groupBy("sequence", "condition", "biorep", "fraction").agg(F.sum("intensity").alias("y"))
    ref = own.where((F.col("condition") == first) & (F.col("biorep") == 0)).groupBy("sequence").agg(F.sum("y").alias("ref"))
    each = own.groupBy("sequence", "condition", "biorep").agg(*[F.coalesce(F.sum(F.when(F.col("fraction") == k, F.col("y"))), F.lit(0.0)).alias(f"f{k}") for k in range(n)])
    names = sorted((r.condition, r.biorep) for r in samples.select("condition", "biorep").distinct().collect() if (r.condition, r.biorep) != (first, 0))
    if not names:
        return samples.withColumn("factor", F.lit(1.0))
    kinds = f"condition {design.schema['condition'].dataType.simpleString()}, biorep {design.schema['biorep'].dataType.simpleString()}"
    numbered = spark.createDataFrame([(c, b, i) for i, (c, b) in enumerate(names)], f"{kinds}, sample long")
    rows = each.join(numbered, ["condition", "biorep"]).join(ref, "sequence").select("sample", F.col("ref").cast("double").alias("ref"), F.array(*[F.col(f"f{k}").cast("double") for k in range(n)]).alias("values"))
    # each of the many passes reads numbers as they are, not rows
    rows = scratch.save(_blocks(rows, n))
    grid = np.round(np.arange(LEAST, MOST + STEP / 2, STEP), 2)
    ones = np.ones((1, n))
    tried = np.concatenate([ones, *[np.where(np.arange(n) == k, grid[:, None], 1.0) for k in range(n)]])
    errors = _partials(rows, n, {s: tried for s in range(len(names))}, False)
    best = {s: (e[0], ones[0]) for s, e in errors.items()}
    for s, e in errors.items():
        # each fraction's best factor with all others at 1, and all of these together
        alone = np.array([grid[e[1 + k * len(grid) : 1 + (k + 1) * len(grid)].argmin()] for k in range(n)])
        at = int(e.argmin())
        best[s] = (e[at], tried[at])
        errors[s] = alone
    starts = {s: np.stack([errors[s], best[s][1]]) for s in best}
    for s, e in _partials(rows, n, starts, False).items() if starts else ():
        at = int(e.argmin())
        best[s] = (e[at], starts[s][at])
    left = dict(best)
    for _ in range(rounds if left else 0):
        sums = _partials(rows, n, {s: f[None] for s, (_, f) in left.items()}, True)
        steps = {}
        for s, x in sums.items():
            if s not in left:
                continue
            a, b = x[: n * n].reshape(n, n), x[n * n :]
            move = np.linalg.solve(a + 1e-9 * (np.trace(a) / n + 1e-30) * np.eye(n), b)
            f = left[s][1]
            # whole, half, quarter, ... steps are tried in one pass
            steps[s] = np.stack([np.clip(f * np.exp(-move * t), LEAST, MOST) for t in (1.0, 0.5, 0.25, 0.1, 0.03)])
        errors = _partials(rows, n, {s: steps.get(s, ones) for s in best}, False)
        kept = {}
        for s, tried_ in steps.items():
            at = int(errors[s].argmin())
            if errors[s][at] < best[s][0] * (1 - 1e-7):
                best[s] = kept[s] = (errors[s][at], tried_[at])
        left = kept
        if not left:
            break
    made = [(c, b, k, float(best[i][1][k]) if i in best else 1.0) for i, (c, b) in enumerate(names) for k in range(n)]
    found = spark.createDataFrame(made, f"{kinds}, fraction {design.schema['fraction'].dataType.simpleString()}, factor double")
    return samples.join(found, ["condition", "biorep", "fraction"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))


def biorep_factors(df: DataFrame, design: DataFrame) -> DataFrame:
    """(condition, biorep, factor): 1 / median ratio of a sample's sequences, summed over fractions of technical replicate 0, to the reference sample's; 1 where none is shared."""
    full, first = _with_reference(df.where("intensity > 0"), design)
    own = full.where("techrep = 0").groupBy("sequence", "condition", "biorep").agg(F.sum("intensity").alias("y"))
    ref = own.where((F.col("condition") == first) & (F.col("biorep") == 0)).select("sequence", F.col("y").alias("ref"))
    folds = own.join(ref, "sequence").groupBy("condition", "biorep").agg(F.median(F.col("y") / F.col("ref")).alias("m"))
    samples = design.select("condition", "biorep").distinct()
    return samples.join(folds, ["condition", "biorep"], "left").select("condition", "biorep", F.coalesce(1 / F.col("m"), F.lit(1.0)).alias("factor"))


def techrep_factors(df: DataFrame, design: DataFrame) -> DataFrame:
    """(run, factor): 1 / median ratio of a run's sequences to those of technical replicate 0 of its sample and fraction; 1 for that one and where none is shared."""
    full, _ = _with_reference(df.where("intensity > 0"), design)
    keys = ["condition", "biorep", "fraction"]
    ref = full.where("techrep = 0").groupBy("sequence", *keys).agg(F.sum("intensity").alias("ref"))
    folds = full.where("techrep > 0").join(ref, ["sequence", *keys]).groupBy("run").agg(F.median(F.col("intensity") / F.col("ref")).alias("m"))
    return design.select("run").join(folds, "run", "left").select("run", F.coalesce(1 / F.col("m"), F.lit(1.0)).alias("factor"))


def normalised(df: DataFrame, design: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(df with intensity scaled, (run, factor)): fractions, then bioreps, then technical replicates, each from what the one before left (ML3).

    df: sequence, run, intensity, one row for each pair; runs that the design lacks go. Intensities of 0 or null stay as they are and decide nothing.
    """
    scratch = Scratch(df.sparkSession, "normalised")
    total = design.select("run", "condition", "biorep", "fraction").withColumn("factor", F.lit(1.0))
    for step, on in ((fraction_factors, ["condition", "biorep", "fraction"]), (biorep_factors, ["condition", "biorep"]), (techrep_factors, ["run"])):
        now = scaled(df, total)
        found = step(now, design).withColumnRenamed("factor", "_f")
        total = scratch.save(total.join(found, on).withColumn("factor", F.col("factor") * F.col("_f")).drop("_f").select("run", "condition", "biorep", "fraction", "factor"))
    return scaled(df, total), total.select("run", "factor")


def scaled(df: DataFrame, factors: DataFrame) -> DataFrame:
    return df.join(factors.select("run", F.col("factor").alias("_factor")), "run").withColumn("intensity", F.col("intensity") * F.col("_factor")).select(*df.columns)
