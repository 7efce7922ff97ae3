"""Null models of unrelated samples: ranks, least squares, logistic; operators.families has those of related ones.

Sums over samples are DataFrame aggregates; what remains, a system as wide as the covariates, is
small numpy work.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import element, value_ranks


def inverse_normal(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """rank_q: (mean rank from 0 + 0.5) / n, and z: its normal quantile; ties share their mean rank. Null values have neither."""
    from ..functions.distributions import normal_quantile

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        return pd.Series(normal_quantile(p))

    ranked = rank_quantile(df, value, by)
    return ranked.withColumn("z", F.when(F.col("rank_q").isNotNull(), quantile("rank_q")))


def rank_quantile(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    r = value_ranks(df, value, by)
    told = r.select(*[F.col(c).alias(f"rank_{c}") for c in by], F.col(value).alias("rank_value"), ((F.col("before") + (F.col("ties") - 1) / 2.0 + 0.5) / F.col("total")).alias("rank_q"))
    same = F.col(value) == F.col("rank_value")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"rank_{c}"))
    return df.join(told, same, "left").drop("rank_value", *[f"rank_{c}" for c in by])


def five_numbers(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, min, q25, median, q75, max, mean, variance; quartiles are the elements n div 4, n div 2 and 3 (n div 4) of the sorted values."""
    n = F.col("total")
    quarter = F.floor(n / 4)
    places = element(df, value, by, {"q25": quarter, "median": F.floor(n / 2), "q75": 3 * quarter}).drop("total")
    rest = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.variance(value).alias("variance"))
    return rest.join(places, by).select(*by, "n", "min", "q25", "median", "q75", "max", "mean", "variance")


def gram(df: DataFrame, y: Column, xs: list[Column], by: list[str]) -> DataFrame:
    """by, n, yy, xy array, xx flattened array: one aggregate over rows where nothing is null."""
    all_ = F.array(y.cast("double"), *[x.cast("double") for x in xs])
    d = df.withColumn("row", all_).filter(F.forall("row", lambda v: v.isNotNull()))
    k = len(xs)
    cell = lambda i, j: F.sum(F.col("row")[i] * F.col("row")[j])
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), cell(0, 0).alias("yy"), F.array(*[cell(0, j + 1) for j in range(k)]).alias("xy"), F.array(*[cell(i + 1, j + 1) for i in range(k) for j in range(k)]).alias("xx"))


def least_squares(df: DataFrame, y: Column, xs: list[Column], by: list[str]) -> DataFrame:
    """by, n, beta array, sigma2 (residual sum of squares over n): rank-deficient systems by pseudo-inverse. One row per group crosses into Python."""
    g = gram(df, y, xs, by)
    k = len(xs)

    def solve(batches):
        for b in batches:
            betas, sigma = [], []
            for r in b.itertuples():
                xx, xy = np.array(r.xx).reshape(k, k), np.array(r.xy)
                beta = np.linalg.pinv(xx) @ xy
                betas.append(beta)
                sigma.append(max(0.0, (r.yy - beta @ xy) / r.n))
            yield b.drop(columns=["yy", "xy", "xx"]).assign(beta=betas, sigma2=sigma)

    keys = ", ".join(f"`{c}` {t}" for c, t in g.select(*by).dtypes) + (", " if by else "")
    return g.mapInPandas(solve, f"{keys}n long, beta array<double>, sigma2 double")


def residuals(df: DataFrame, y: Column, xs: list[Column], fit: DataFrame, by: list[str]) -> DataFrame:
    fitted = F.lit(0.0)
    j = df.join(F.broadcast(fit.select(*by, "beta", "sigma2")), by) if by else df.crossJoin(F.broadcast(fit.select("beta", "sigma2")))
    for i, x in enumerate(xs):
        fitted = fitted + F.col("beta")[i] * x
    return j.withColumn("r", y - fitted).drop("beta")


def binary_levels(df: DataFrame, y: str) -> tuple[float, float]:
    """The two values of a binary trait, smaller first; anything else raises."""
    levels = sorted(r[0] for r in df.select(y).filter(F.col(y).isNotNull()).distinct().limit(3).collect())
    if len(levels) != 2:
        raise ValueError(f"{y} has {len(levels)} or more values; a binary trait has two")
    return levels[0], levels[1]


def logistic(df: DataFrame, y: Column, xs: list[Column], steps: int = 2000, rate: float | None = None, tolerance: float = 1e-4) -> tuple[np.ndarray, int]:
    """(beta, steps taken): the most likely fit of a 0/1 trait, by steps until one's L1 norm is under ``tolerance``; raises if none is.

    Newton's steps, halved while they lower the likelihood, which depend neither on the
    number of rows nor on the covariates' scale; with ``rate`` gradient ascent at that rate, as
    the reference does (5e-5). A trait that the covariates separate has no fit and raises. The
    rows are grouped once by equal covariates and trait, so that a step aggregates the distinct
    covariate patterns; each step brings back a few numbers per pair of covariates.
    """
    names = [f"x{i}" for i in range(len(xs))]
    d = df.select(y.cast("double").alias("y"), *[x.cast("double").alias(n) for x, n in zip(xs, names)]).dropna()
    patterns = d.groupBy(*names).agg(F.sum("y").alias("ones"), F.count(F.lit(1)).alias("n")).persist()
    k = len(xs)

    def at(beta: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Log-likelihood, largest |z|, gradient and information."""
        z = F.lit(0.0)
        for b, n in zip(beta, names):
            z = z + F.lit(float(b)) * F.col(n)
        p = 1 / (1 + F.exp(-z))
        gap, spread = F.col("ones") - F.col("n") * p, F.col("n") * p * (1 - p)
        told = F.col("ones") * z - F.col("n") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))
        row = [v or 0.0 for v in patterns.agg(F.sum(told), F.max(F.abs(z)), *[F.sum(gap * F.col(n)) for n in names], *[F.sum(spread * F.col(m) * F.col(n)) for m in names for n in names]).first()]
        return row[0], row[1], np.array(row[2 : 2 + k]), np.array(row[2 + k :]).reshape(k, k)

    beta = np.zeros(k)
    try:
        value, far, g, information = at(beta)
        for step in range(1, steps + 1):
            move = rate * g if rate else np.linalg.pinv(information) @ g
            found = at(beta + move)
            while not rate and found[0] < value - 1e-9 * abs(value) and np.abs(move).sum() >= tolerance:
                move = move / 2
                found = at(beta + move)
            beta = beta + move
            value, far, g, information = found
            if far > 30:
                raise ValueError("the covariates separate the trait's values (or the rate is too high): there is no logistic fit")
            if np.abs(move).sum() < tolerance:
                return beta, step
    finally:
        patterns.unpersist()
    raise ValueError(f"the logistic fit did not converge in {steps} steps")
