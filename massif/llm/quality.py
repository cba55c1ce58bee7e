"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel, so a linear fit of them is a smooth nonlinear score. The fit sums the normal
equations within partitions; only the sums, of a fixed size, meet in the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massif.runtime import ship

#: At most about this many labelled rows are used to fit, chosen by a hash of their ids.
MAX_TRAIN_ROWS = 200_000
TRAIN_PARTS = 16
FOURIER = 384
RIDGE = 1e-2
SEED = 7
STATISTICS = (
    "log_words", "word_length", "word_length_spread", "upper", "digits", "marks", "inner_marks", "bars", "shouts", "distinct", "log_distinct_excess",
    "repeated_lines", "repeated_triples", "top_word", "same_as_before", "entropy", "log_line", "short_words", "singles", "accents",
)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_INNER = re.compile(r"\w[^\w\s'’-]+\w|[^\w\s.,;:!?'\"()’-]")


def statistics(text: str | None) -> list[float]:
    """Numbers of a whole text, in the order of STATISTICS; all zero for an empty one."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    chars = Counter(text)
    total = len(text)
    letters = upper = digits = marks = accents = 0
    for c, k in chars.items():
        if c.isalpha():
            letters += k
            upper += k * c.isupper()
            accents += k * (c > "\x7f")
        elif c.isdigit():
            digits += k
        elif not c.isspace():
            marks += k
    share = np.fromiter(chars.values(), float, len(chars)) / total
    lengths = np.fromiter(map(len, words), float, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    triples = len(set(zip(words, words[1:], words[2:])))
    return [
        float(np.log1p(n)),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        upper / max(letters, 1),
        digits / total,
        marks / n,
        sum(map(len, _INNER.findall(text))) / n,
        chars["|"] / n,
        chars["!"] / n,
        len(counts) / n,
        float(np.log(len(counts)) - 0.8 * np.log(n)),
        1 - len(set(lines)) / max(len(lines), 1),
        1 - triples / max(n - 2, 1) if n > 2 else 0.0,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        float(-(share * np.log2(share)).sum()),
        float(np.log1p(total / max(len(lines), 1))),
        float((lengths <= 3).mean()),
        sum(k == 1 for k in counts.values()) / n,
        accents / max(letters, 1),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.fourier(x) @ self.weights, *self.steps), 0.0, 1.0)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean score, mean label) of each block, both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order], label[order]):
        blocks.append([s, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s1, y1, n1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s1, blocks[-1][1] + y1, blocks[-1][2] + n1]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def features(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(statistics)

    return run(text)


def held_out(id_col: str) -> Column:
    """True for ids whose crc32 as text leaves 1 by 3; false for null."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on the rows of df that labels has, without held-out ids; ids with labels of both kinds count by their mean.

    Labels that are null are left out. With no labelled row, as in an empty table, every score is 0.5. Rows that repeat count as often as they occur. Texts are read whole, one at a time.
    """
    ship(df.sparkSession)
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label")).dropna().where(~held_out("id"))
    own = own.groupBy("id").agg(F.avg("label").alias("label"))
    share = min(1.0, max_rows / max(own.count(), 1))
    # a set of a bounded size: about max_rows ids
    picked = F.broadcast(own.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20))))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(picked, "id")
    rows = rows.select("label", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2)).alias("fold"), features(F.col("text")).alias("x")).persist()
    k = len(STATISTICS)
    head = rows.agg(F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(SEED)
    turn, shift = rng.standard_normal((k, FOURIER)) / np.sqrt(k), rng.uniform(0, 2 * np.pi, FOURIER)
    constant = np.array([0.0, 1.0]), np.array([0.5, 0.5])
    if not head["n"]:
        rows.unpersist()
        return Model(np.zeros(k), np.ones(k), turn, shift, np.zeros(FOURIER + 1), constant)
    mean = np.array([head[f"m{i}"] for i in range(k)])
    scale = np.array([head[f"s{i}"] or 0.0 for i in range(k)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), turn, shift, np.zeros(FOURIER + 1), constant)

    def sums(frames):
        total = {f: [np.zeros((FOURIER + 1, FOURIER + 1)), np.zeros(FOURIER + 1), 0] for f in (0, 1)}
        for x in frames:
            for f, part in x.groupby("fold"):
                z = model.fourier(np.stack(part["x"]))
                total[f][0] += z.T @ z
                total[f][1] += z.T @ part["label"].to_numpy()
                total[f][2] += len(part)
        yield pd.DataFrame([{"fold": f, "a": a.tobytes(), "b": b.tobytes(), "n": n} for f, (a, b, n) in total.items()])

    # one row a fold and partition, of a fixed number of partitions
    parts = rows.coalesce(TRAIN_PARTS).mapInPandas(sums, "fold long, a binary, b binary, n long").collect()
    equations = {f: [sum(np.frombuffer(r[c]) for r in parts if r["fold"] == f) for c in "ab"] for f in (0, 1)}

    def solved(folds) -> np.ndarray:
        a = sum(equations[f][0] for f in folds).reshape(FOURIER + 1, FOURIER + 1)
        return np.linalg.solve(a + RIDGE * np.eye(len(a)), sum(equations[f][1] for f in folds))

    # each fold is scored by the fit of the other, so that calibration sees no row that its fit has seen
    crossed = {f: solved([1 - f]) for f in (0, 1)}

    def apart(frames):
        for x in frames:
            z = model.fourier(np.stack(x["x"])) if len(x) else np.zeros((0, FOURIER + 1))
            yield pd.DataFrame({"s": np.where(x["fold"] == 0, z @ crossed[0], z @ crossed[1]), "y": x["label"]})

    seen = rows.mapInPandas(apart, "s double, y double").toPandas()
    rows.unpersist()
    model.weights = solved([0, 1])
    model.steps = isotonic(seen["s"].to_numpy(), seen["y"].to_numpy())
    return model


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= 0.5, else 0); null texts count as empty, which have a score too.

    Each row is scored by itself: rows that repeat get equal scores, an empty table gives an empty table, a long text is read whole, and columns of these two names are replaced.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([statistics(t) for t in x])) if len(x) else np.zeros(0))

    return df.withColumn("score", run(F.col(f"`{text_col}`"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
