"""Distributions as column functions; ln gamma, which Spark SQL lacks, as a pandas UDF."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_gamma_values(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive x: Stirling's series after shifting x above 10."""
    x = np.asarray(x, dtype=float)
    shift, z = np.zeros_like(x), x.copy()
    for _ in range(10):
        low = z < 10
        shift = np.where(low, shift + np.log(np.where(low, z, 1.0)), shift)
        z = np.where(low, z + 1, z)
    s = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + s - shift


def ln_gamma(x: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(ln_gamma_values(s.to_numpy(float)), index=s.index), "double")(x.cast("double"))


def gamma_share(a: float, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: its power series up to a + 1,
    beyond it the continued fraction of the rest."""
    x = np.maximum(np.asarray(x, dtype=float), 0.0)
    share = np.where(np.isnan(x), np.nan, 0.0)
    low = (x > 0) & (x < a + 1)
    front = lambda z: np.exp(a * np.log(np.maximum(z, 1e-300)) - z - math.lgamma(a))
    if low.any():
        z = x[low]
        term = total = np.full_like(z, 1.0 / a)
        for n in range(1, 500):
            term = term * z / (a + n)
            total = total + term
            if not (term > 1e-17 * total).any():
                break
        share[low] = front(z) * total
    high = x >= a + 1
    if high.any():
        z = x[high]
        fraction = np.zeros_like(z)
        for n in range(300, 0, -1):  # from the inside out
            fraction = n * (a - n) / (z + 2 * n + 1 - a + fraction)
        share[high] = 1.0 - front(z) / (z + 1 - a + fraction)
    return share


def beta_share(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, on the side
    where that converges."""
    x = np.clip(np.asarray(x, dtype=float), 0.0, 1.0)
    turned = x > (a + 1) / (a + b + 2)
    z, p, q = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    f = np.zeros_like(z)
    for n in range(200, 0, -1):
        m = n // 2
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        f = (even if n % 2 == 0 else odd) / (1 + f)
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / p
    share = np.where(z == 0, 0.0, front / (1 + f))
    return np.where(turned, 1 - share, share)


def vectorised(f, *columns: Column) -> Column:
    """A function of numpy arrays as one of columns; null where a column is null. Rows with
    the same values share one evaluation in a batch."""

    def run(*s: pd.Series) -> pd.Series:
        rows = pd.concat([x.astype(float) for x in s], axis=1, ignore_index=True)
        at = rows.groupby(list(rows.columns), sort=False).ngroup().fillna(-1).astype(int).to_numpy()  # -1: a null
        different = rows[at >= 0].drop_duplicates().to_numpy()
        out = np.append(f(*different.T) if len(different) else [], np.nan)
        return pd.Series(out[at])

    return F.pandas_udf(run, "double")(*[c.cast("double") for c in columns])


def inverse(cdf, low: float, high: float, steps: int = 100):
    """The quantiles of a distribution on [low, high]: the interval where its cdf passes u
    is cut by the chord, every third time and where the chord leads nowhere in halves,
    until it holds no number or was halved ``steps`` times."""

    def run(u: np.ndarray) -> np.ndarray:
        lo, hi = np.full(u.shape, low), np.full(u.shape, high)
        for _ in range(60):  # an end that is nowhere is first sought
            hi = np.where(np.isfinite(hi), hi, 1.0)
            if np.isfinite(high) or not (short := cdf(hi) < u).any():
                break
            hi = np.where(short, hi * 2, hi)
        below, above = cdf(lo) - u, cdf(hi) - u
        open_ = np.arange(len(u))
        for k in range(3 * steps):
            a, b, fa, fb = lo[open_], hi[open_], below[open_], above[open_]
            half = (a + b) / 2
            left = (a < half) & (half < b)
            open_, a, b, fa, fb, half = (x[left] for x in (open_, a, b, fa, fb, half))
            if not len(open_):
                break
            # A little beside the chord's point, so that both ends close in.
            chord = a + (b - a) * (-fa / np.where(fb > fa, fb - fa, 1.0) + (1e-4 if k % 3 == 2 else -1e-4))
            at = np.where(fb > fa, chord, half) if k % 3 else half
            at = np.where((a < at) & (at < b), at, half)
            f = cdf(at) - u[open_]
            lo[open_], below[open_] = np.where(f < 0, at, a), np.where(f < 0, f, fa)
            hi[open_], above[open_] = np.where(f < 0, b, at), np.where(f < 0, fb, f)
        return (lo + hi) / 2

    return run


def expected_categories(alpha: Column, n: Column | float) -> Column:
    """Expected categories of a Dirichlet process over n sites: alpha ln(1 + n / alpha)."""
    n = F.lit(float(n)) if isinstance(n, (int, float)) else n
    return alpha * F.log1p(n / alpha)


def solve_alpha(expected: Column, n: float, steps: int = 80) -> Column:
    """The alpha at which n sites have the expected categories, by bisection of whole
    batches; null unless 1 <= expected <= n."""

    def run(aim: np.ndarray) -> np.ndarray:
        lo, hi = np.full(aim.shape, 1e-9), np.full(aim.shape, 1e9)
        for _ in range(steps):
            middle = np.sqrt(lo * hi)  # alpha spans many magnitudes
            low = middle * np.log1p(n / middle) < aim
            lo, hi = np.where(low, middle, lo), np.where(low, hi, middle)
        return lo

    return F.when(expected.between(1, n), vectorised(run, expected))


def exponential_ln_pdf(x: Column, rate: float) -> Column:
    return F.lit(math.log(rate)) - F.lit(rate) * x


def exponential_cdf(x: Column, rate: float) -> Column:
    return F.lit(1.0) - F.exp(F.lit(-rate) * x)


def exponential_quantile(u: Column, rate: float) -> Column:
    return -F.log1p(-u) / F.lit(rate)


def gamma_ln_pdf(x: Column, shape: float, rate: float) -> Column:
    return F.lit(shape * math.log(rate) - math.lgamma(shape)) + F.lit(shape - 1) * F.log(x) - F.lit(rate) * x


def beta_ln_pdf(x: Column, a: float, b: float) -> Column:
    norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return F.lit(norm) + F.lit(a - 1) * F.log(x) + F.lit(b - 1) * F.log1p(-x)


def normal_ln_pdf(x: Column, mean: float, sd: float) -> Column:
    return F.lit(-math.log(sd) - 0.5 * math.log(2 * math.pi)) - ((x - F.lit(mean)) / F.lit(sd)) ** 2 / 2


def chi_square_ln_pdf(x: Column, df: float) -> Column:
    return gamma_ln_pdf(x, df / 2, 0.5)


def uniform_ln_pdf(x: Column, low: float, high: float) -> Column:
    return F.when(x.between(low, high), F.lit(-math.log(high - low)))


def dirichlet_ln_pdf(p: Column, alpha: float) -> Column:
    """Density of an array of proportions under equal concentrations alpha."""
    n = F.size(p).cast("double")
    logs = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.log(x))
    return ln_gamma(n * alpha) - n * math.lgamma(alpha) + F.lit(alpha - 1) * logs


def exponential_pdf(x: Column, rate: float) -> Column:
    return F.when(x < 0, 0.0).otherwise(F.exp(exponential_ln_pdf(x, rate)))


def gamma_pdf(x: Column, shape: float, rate: float) -> Column:
    return F.when(x <= 0, 0.0).otherwise(F.exp(gamma_ln_pdf(x, shape, rate)))


def gamma_cdf(x: Column, shape: float, rate: float) -> Column:
    return vectorised(lambda v: gamma_share(shape, rate * v), x)


def gamma_quantile(u: Column, shape: float, rate: float) -> Column:
    return vectorised(inverse(lambda v: gamma_share(shape, rate * v), 0.0, math.inf), u)


def beta_pdf(x: Column, a: float, b: float) -> Column:
    return F.when((x <= 0) | (x >= 1), 0.0).otherwise(F.exp(beta_ln_pdf(x, a, b)))


def beta_cdf(x: Column, a: float, b: float) -> Column:
    return vectorised(lambda v: beta_share(a, b, v), x)


def beta_quantile(u: Column, a: float, b: float) -> Column:
    return vectorised(inverse(lambda v: beta_share(a, b, v), 0.0, 1.0), u)


def normal_pdf(x: Column, mean: float, sd: float) -> Column:
    return F.exp(normal_ln_pdf(x, mean, sd))


def normal_share(z: np.ndarray) -> np.ndarray:
    half = gamma_share(0.5, z * z / 2) / 2  # of the square, which is chi-square
    return np.where(z < 0, 0.5 - half, 0.5 + half)


def normal_cdf(x: Column, mean: float, sd: float) -> Column:
    return vectorised(lambda v: normal_share((v - mean) / sd), x)


def normal_quantile(u: Column, mean: float, sd: float) -> Column:
    return vectorised(inverse(lambda v: normal_share((v - mean) / sd), mean - 40 * sd, mean + 40 * sd), u)


def chi_square_pdf(x: Column, df: float) -> Column:
    return gamma_pdf(x, df / 2, 0.5)


def chi_square_cdf(x: Column, df: float) -> Column:
    return gamma_cdf(x, df / 2, 0.5)


def chi_square_quantile(u: Column, df: float) -> Column:
    return gamma_quantile(u, df / 2, 0.5)


def uniform_pdf(x: Column, low: float, high: float) -> Column:
    return F.when(x.between(low, high), 1.0 / (high - low)).otherwise(0.0)


def uniform_cdf(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def uniform_quantile(u: Column, low: float, high: float) -> Column:
    return low + u * (high - low)


def dirichlet_pdf(p: Column, alpha: float) -> Column:
    return F.exp(dirichlet_ln_pdf(p, alpha))


def geometric_pdf(k: Column, p: float) -> Column:
    """The chance of k failures before the first success."""
    return F.when(k < 0, 0.0).otherwise(p * F.pow(F.lit(1.0 - p), k))


def geometric_cdf(k: Column, p: float) -> Column:
    return F.when(k < 0, 0.0).otherwise(1.0 - F.pow(F.lit(1.0 - p), F.floor(k) + 1))


def geometric_quantile(u: Column, p: float) -> Column:
    """The least k whose cdf is at least u; with uniform u, a draw."""
    return F.greatest(F.ceil(F.log1p(-u) / math.log(1.0 - p)) - 1, F.lit(0)).cast("long")
