"""Fold changes by adaptive Metropolis-within-Gibbs chains.

Measurements are t-distributed about a mean mu with a scale and a tail weight nu, each with a weight of its own. The mean has a t prior of one degree of freedom (Cauchy) about 0, nu an exponential
one of mean 29 from 1 on, the scale a uniform one unless a Cauchy one is given. A step proposes a new value for one parameter after the other; after every third step each
parameter's step width grows or shrinks with its rate of acceptance, by less and less. Groups are gathered to one row each; a task runs the chains of a few dozen rows side by side, each with
random numbers of its own seed, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

from math import log, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.runtime import ship

#: Chains that run side by side, and measurements that they hold at most, the shorter ones padded; a longer group runs alone.
ABREAST, CELLS = 64, 1 << 18
#: Rate of acceptance that steps are fitted to, and steps between two fits.
RATE, EVERY = 0.44, 3
# Mean of the exponential prior of nu, and the spread of the prior of mu without a null hypothesis.
NU_MEAN, WIDE = 29.0, 20.0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series eight up, and the way back."""
    up = x + 8
    back = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    r = 1 / (up * up)
    return (up - 0.5) * np.log(up) - up + 0.5 * log(2 * pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / up - back


def log_density(state: np.ndarray, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of weight * log density of t distributions (mu, scale, nu) by row."""
    mu, scale, nu = state
    z = (x - mu[:, None]) / scale[:, None]
    head = log_gamma((nu + 1) / 2) - log_gamma(nu / 2) - 0.5 * np.log(nu * pi) - np.log(scale)
    return (weight * (head[:, None] - 0.5 * (nu[:, None] + 1) * np.log1p(z * z / nu[:, None]))).sum(axis=1)


def log_prior(state: np.ndarray, mu_sd: np.ndarray, scale_mean: np.ndarray, scale_sd: np.ndarray, start_scale: np.ndarray) -> np.ndarray:
    mu, scale, nu = state
    cauchy = lambda v, c, s: -np.log(pi * s * (1 + ((v - c) / s) ** 2))
    low, high = start_scale / 1000, start_scale * 1000
    flat = np.where((scale >= low) & (scale <= high), -np.log(high - low), -np.inf)
    return cauchy(mu, 0.0, mu_sd) + np.where(np.isnan(scale_mean), flat, cauchy(scale, scale_mean, scale_sd)) - nu / NU_MEAN - log(NU_MEAN)


def chains(data: list[np.ndarray], weights: list[np.ndarray], seeds: list[int], mu_sd: np.ndarray, scale_mean: np.ndarray, scale_sd: np.ndarray, burn_in: int, steps: int) -> np.ndarray:
    """(3, groups, steps): mu, scale and nu of each group's chain after burn_in steps. scale_mean NaN means a uniform prior of the scale; else the scale stays at or above it."""
    n, most = len(data), max(map(len, data))
    x, w = np.zeros((n, most)), np.zeros((n, most))
    for i, (a, b) in enumerate(zip(data, weights)):
        x[i, : len(a)], w[i, : len(a)] = a, b
    start = np.array([max(0.001, float(np.std(a, ddof=1)) if len(a) > 1 else 0.001) for a in data])
    state = np.stack([np.array([float(np.mean(a)) for a in data]), start, np.full(n, 5.0)])
    least = np.stack([np.full(n, -np.inf), np.where(np.isnan(scale_mean), 0.0, np.where(scale_mean > 0, scale_mean, 0.001)), np.ones(n)])
    state[1] = np.maximum(state[1], least[1])
    total = burn_in + steps
    draws = np.empty((n, total, 6))
    for i, seed in enumerate(seeds):
        rng = np.random.default_rng(seed)
        draws[i, :, :3], draws[i, :, 3:] = rng.normal(size=(total, 3)), rng.random((total, 3))
    width, taken = np.zeros((3, n)), np.zeros((3, n))
    out = np.empty((3, n, steps))
    with np.errstate(all="ignore"):
        posterior = lambda s: log_density(s, x, w) + log_prior(s, mu_sd, scale_mean, scale_sd, start)
        now = posterior(state)
        for t in range(total):
            if t >= burn_in:
                out[:, :, t - burn_in] = state
            for p in range(3):
                tried = state.copy()
                tried[p] = state[p] + np.exp(width[p]) * draws[:, t, p]
                inside = (tried[p] >= least[p]) & (tried[p] > 0 if p else True)
                new = np.where(inside, posterior(np.where(inside, tried, state)), -np.inf)
                lost = ~np.isfinite(now)
                go = inside & (lost | (np.exp(np.minimum(0.0, new - now)) > draws[:, t, 3 + p]))
                state[p] = np.where(go, tried[p], state[p])
                now = np.where(go, new, now)
                taken[p] += go
            if (t + 1) % EVERY == 0:
                width += np.sign(taken / EVERY - RATE) * min(0.01, 1 / np.sqrt((t + 1) // EVERY))
                taken[:] = 0
    return out


def narrowest(x: np.ndarray, share: float = 0.95) -> tuple[float, float]:
    """The narrowest interval over samples that spans floor(share * n) of them, the first at a tie."""
    x = np.sort(x)
    k = int(len(x) * share)
    if k >= len(x):
        return float(x[0]), float(x[-1])
    i = int(np.argmin(x[k:] - x[: len(x) - k]))
    return float(x[i]), float(x[i + k])


def fold_changes(df: DataFrame, key: str, condition: str, value: str, first, second, weight: str | None = None, null: float = 0.1, burn_in: int = 1000, steps: int = 3000, seed: int = 0) -> DataFrame:
    """(key, change, low, high, pep, bayes_factor, n_first, n_second): the change of log2 level from the first condition to the second.

    change is the median, low and high the narrowest 95 % interval, of the difference of the two means' chains. pep is the share of differences within `null` of zero
    where both means have a Cauchy prior of that spread, bayes_factor the odds against. Values and weights that are not positive are left out. A group with fewer than two measurements in either condition has a
    change from what it has, no interval, and a pep of 1; one without any in either has none of them. The number of each chain is `seed` and its key.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    good = df.where((F.col(value) > 0) & (w > 0)).select(F.col(key).alias("_k"), F.col(condition).alias("_c"), F.struct(F.log2(value).alias("x"), w.alias("w")).alias("_m"))
    side = lambda c: F.array_sort(F.collect_list(F.when(F.col("_c") == c, F.col("_m"))))
    rows = good.groupBy("_k").agg(side(first).alias("a"), side(second).alias("b")).withColumn("_s", F.xxhash64(F.col("_k").cast("string"), F.lit(seed)))

    # groups can be long: what a worker is sent at once is bounded by bytes, and it gets arrays of numbers
    ship(df.sparkSession)

    @F.pandas_udf("struct<change:double,low:double,high:double,pep:double,bayes_factor:double>")
    def run(ax: pd.Series, aw: pd.Series, bx: pd.Series, bw: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        made = []
        for lo, hi in side_by_side([max(len(x), len(y)) for x, y in zip(ax, bx)]):
            a, b = ([np.stack([np.asarray(x, float), np.asarray(w, float)], axis=1) for x, w in zip(xs[lo:hi], ws[lo:hi])] for xs, ws in ((ax, aw), (bx, bw)))
            made += _changes(a, b, list(seeds[lo:hi]), null, burn_in, steps)
        return pd.DataFrame(made, columns=["change", "low", "high", "pep", "bayes_factor"])

    lists = [F.col(f"{side}.{c}") for side in "ab" for c in "xw"]
    out = rows.select(F.col("_k").alias(key), run(*lists, "_s").alias("r"), F.size("a").alias("n_first"), F.size("b").alias("n_second"))
    return out.select(key, "r.*", "n_first", "n_second")


def side_by_side(sizes: list[int]) -> list[tuple[int, int]]:
    """(first, end) of stretches of groups that run side by side: at most ABREAST, and at most CELLS measurements when all are as long as the longest."""
    out, lo, longest = [], 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo == ABREAST or (i - lo + 1) * max(longest, n) > CELLS):
            out.append((lo, i))
            lo, longest = i, 0
        longest = max(longest, n)
    return [*out, (lo, len(sizes))] if sizes else []


def _changes(first: list, second: list, seeds: list[int], null: float, burn_in: int, steps: int) -> list[tuple]:
    take = lambda side, c: [np.ascontiguousarray(p[:, "xw".index(c)]) for p in side]
    both = [i for i in range(len(first)) if len(first[i]) > 1 and len(second[i]) > 1]
    out: list[tuple] = []
    for a, b in zip(first, second):
        level = [float(np.mean(s[:, 0])) if len(s) else None for s in (a, b)]
        out.append((None if None in level else level[1] - level[0], None, None, 1.0 if len(a) or len(b) else None, None))
    if both:
        no = np.full(len(both), np.nan)
        mus = []
        for skeptic in (False, True):
            for k, side in enumerate((first, second)):
                own = [side[i] for i in both]
                # each side has half of the null hypothesis' square
                spread = np.full(len(both), null / np.sqrt(2) if skeptic else WIDE)
                numbers = [(int(seeds[i]) ^ (2 * skeptic + k + 1)) & 0xFFFFFFFFFFFFFFFF for i in both]
                mus.append(chains(take(own, "x"), take(own, "w"), numbers, spread, no, no, burn_in, steps)[0])
        plain, doubtful = mus[1] - mus[0], mus[3] - mus[2]
        for j, i in enumerate(both):
            inside = int((np.abs(doubtful[j]) < null).sum())
            odds = (steps - inside) / inside if inside else float(steps)
            out[i] = (float(np.median(plain[j])), *narrowest(plain[j]), inside / steps, odds)
    return out
