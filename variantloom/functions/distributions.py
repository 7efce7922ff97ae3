"""Distribution functions over numpy arrays, and their registration as SQL functions.

Everything a Column can express stays a Column (see :func:`beta_density`); what needs an error
function, an incomplete gamma or a numerical integral runs in Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_NORMAL = NormalDist()


def _array(x) -> np.ndarray:
    return np.atleast_1d(np.asarray(x, dtype=np.float64))


def chi2_tail_1(x) -> np.ndarray:
    """Upper tail of chi-square with one degree of freedom; NaN stays NaN, below 0 gives 1."""
    x = _array(x)
    return np.where(np.isnan(x), np.nan, _erfc(np.sqrt(np.maximum(np.nan_to_num(x), 0) / 2)).astype(np.float64))


def _largest_chi2() -> float:
    low, high = 1000.0, 2000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > 0 else (low, mid)
    return low


LARGEST_CHI2 = _largest_chi2()
SHRINK = 0.999


def chi2_tail_1_reported(x) -> tuple[np.ndarray, np.ndarray]:
    """(p, True where p underflowed). An underflowing statistic is shrunk by 0.999 until its tail is positive."""
    x = _array(x)
    under = np.nan_to_num(x) > LARGEST_CHI2
    with np.errstate(divide="ignore", invalid="ignore"):
        steps = np.ceil(np.log(LARGEST_CHI2 / np.where(under, x, LARGEST_CHI2)) / math.log(SHRINK))
    return chi2_tail_1(np.where(under, x * SHRINK**steps, x)), under


def normal_quantile(p) -> np.ndarray:
    return np.array([_NORMAL.inv_cdf(v) if 0 < v < 1 else (-np.inf if v == 0 else np.inf if v == 1 else np.nan) for v in _array(p)])


def chi2_quantile_1_upper(p) -> np.ndarray:
    """The x with upper tail p, one degree of freedom."""
    return normal_quantile(_array(p) / 2) ** 2


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def noncentral_chi2_tail(x: float, df: float, shift: float) -> float:
    """Poisson mixture of central tails, summed outwards from its mode."""
    if shift <= 0:
        return chi2_tail(x, df)
    half, mode, total = shift / 2, int(shift / 2), 0.0
    for step, i in ((1, mode), (-1, mode - 1)):
        while i >= 0:
            w = math.exp(-half + i * math.log(half) - math.lgamma(i + 1))
            total += w * chi2_tail(x, df + 2 * i)
            if w < 1e-17:
                break
            i += step
    return min(1.0, total)


def beta_density(x: Column | str, a: float, b: float) -> Column:
    """Density of Beta(a, b) as a Column."""
    x = F.col(x) if isinstance(x, str) else x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return F.lit(front) * F.pow(x, F.lit(a - 1.0)) * F.pow(1 - x, F.lit(b - 1.0))


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 2000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or tiny)
            c = 1 + numerator / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def hwe_exact(hets, hom1, hom2) -> np.ndarray:
    """Exact test of Hardy-Weinberg proportions: the sum of the probabilities of all heterozygote counts no likelier than the one seen.

    NaN where a count is negative or all are zero.
    """
    out = []
    for h, a, b in zip(_array(hets), _array(hom1), _array(hom2)):
        n = int(h + a + b)
        if not n or min(h, a, b) < 0 or np.isnan(h + a + b):
            out.append(np.nan)
            continue
        rare = int(2 * min(a, b) + h)
        het = np.arange(rare % 2, rare + 1, 2)
        fewer = (rare - het) // 2
        log = het * math.log(2) - (_lgamma(fewer + 1.0) + _lgamma(het + 1.0) + _lgamma(n - het - fewer + 1.0)).astype(np.float64)
        p = np.exp(log - log.max())
        p /= p.sum()
        seen = p[(het == int(h)).argmax()]
        out.append(min(1.0, p[p <= seen * (1 + 1e-9)].sum()))
    return np.array(out)


def _mixture_far_tail(q: float, w: np.ndarray) -> float:
    """P(sum of w * chi-square(1) > q) for q above the mean, with a small relative error however small it is.

    The tail is the integral of exp(K(s) - s q) / s, K the cumulant function, along any line
    that crosses the real axis between 0 and K's first singularity 1 / (2 max w). It is taken
    through the saddle point K'(s) = q, where nothing cancels, and along a parabola that bends
    round the cut to the right, where exp(-s q) makes it fall off; the trapezoid rule then
    converges exponentially.
    """
    edge = 0.5 / w.max()
    low, high = 0.0, edge * (1 - 1e-15)
    for _ in range(200):
        mid = 0.5 * (low + high)
        if (w / (1 - 2 * w * mid)).sum() < q:
            low = mid
        else:
            high = mid
    # not too near the pole at 0, which the steps must not feel either
    at = max(0.5 * (low + high), min(0.2 * edge, 2 / math.sqrt(2 * (w * w).sum())))
    gap = edge - at
    bend, step = 0.25 / gap, min(gap / 24, at / 5, 0.25 / math.sqrt(2 * (w * w / (1 - 2 * w * at) ** 2).sum()))
    peak = -0.5 * np.log1p(-2 * w * at).sum() - at * q
    total, size = 0.0, 512
    for a in range(0, 200_000, size):
        u = (np.arange(a, a + size) + 0.5) * step
        s = at + bend * u * u + 1j * u
        k = -0.5 * np.log(1 - 2 * s[:, None] * w[None]).sum(axis=1) - s * q - peak
        part = (np.exp(k) / s * (2 * bend * u + 1j)).imag
        total += float(part.sum())
        if np.abs(part[-64:]).max() * size < 1e-17 * abs(total):
            break
    return math.exp(peak) * total * step / math.pi


def chi2_mixture_tail(q: float, weights, accuracy: float = 1e-6, most: int = 4_000_000) -> float:
    """P(sum of weights * chi-square(1) > q) by numerical inversion of the characteristic function.

    Above the mean by :func:`_mixture_far_tail`, to about ten digits at any depth (down to the
    smallest double). Below it by midpoint sums: the step keeps the aliased tail small; they end where what is left of the
    integral is below ``accuracy``. There the c weights with w u > 1 each make the integrand
    fall at least by the fourth root of u, so the rest is below 4 / (pi c damp).
    """
    w = np.asarray([x for x in weights if x > 0], dtype=np.float64)
    if not len(w):
        return float(q < 0)
    if q <= 0:
        return 1.0
    w, q = w / w.max(), q / w.max()
    if len(w) == 1:
        return float(chi2_tail_1(q)[0])
    if q > w.sum():
        return _mixture_far_tail(q, w)
    mean, sd = w.sum(), math.sqrt(2 * (w**2).sum())
    step = 2 * math.pi / (q + mean + 8 * sd + 40)
    total, size = 0.0, 1024
    for a in range(0, most, size):
        u = (np.arange(a, min(most, a + size)) + 0.5) * step
        x = u[:, None] * w[None]
        angle = 0.5 * np.arctan(x).sum(axis=1) - 0.5 * q * u
        damp = np.exp(0.25 * np.log1p(x * x).sum(axis=1))
        total += float((np.sin(angle) / (u * damp)).sum())
        count = int((x[-1] > 1).sum())
        if count and 4 / (math.pi * count * damp[-1]) < accuracy:
            break
    return 0.5 + total * step / math.pi


def liu_tail(q: float, weights) -> float:
    """Tail of the mixture by matching its first four moments with a non-central chi-square."""
    w = np.asarray(weights, dtype=np.float64)
    c = [float((w**k).sum()) for k in range(1, 5)]
    if c[1] <= 0:
        return math.nan
    skew, kurt = c[2] / c[1] ** 1.5, c[3] / c[1] ** 2
    if skew**2 > kurt:
        a = 1 / (skew - math.sqrt(skew**2 - kurt))
        shift = skew * a**3 - a**2
        df = a**2 - 2 * shift
    else:
        a, shift, df = 1 / skew, 0.0, 1 / skew**2
    at = (q - c[0]) / math.sqrt(2 * c[1])
    return noncentral_chi2_tail(at * math.sqrt(2) * a + df + shift, df, shift)


def nearest_correlation(r: np.ndarray, trials: int = 100) -> np.ndarray:
    """``r`` with negative eigenvalues set to zero and the diagonal to one, again until none is negative."""
    for _ in range(trials):
        value, vector = np.linalg.eigh(r)
        if value.min() >= -1e-12:
            break
        r = (vector * np.maximum(value, 0)) @ vector.T
        d = np.sqrt(np.maximum(np.diag(r), 1e-300))
        r = r / np.outer(d, d)
    return r


def _primes(n: int) -> np.ndarray:
    found, p = [], 2
    while len(found) < n:
        if all(p % d for d in found if d * d <= p):
            found.append(p)
        p += 1
    return np.array(found, dtype=np.float64)


_STEP = 1.0 / 256
_GRID = np.arange(-9.0, 9.0 + _STEP, _STEP)
_CDF = 0.5 * _erfc(-_GRID / math.sqrt(2)).astype(np.float64)
_DENSITY = np.exp(-0.5 * _GRID**2) / math.sqrt(2 * math.pi)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution to about 1e-12: cubic pieces through tabulated values and slopes."""
    at = (np.clip(x, -9.0, 9.0) + 9.0) / _STEP
    i = np.minimum(at.astype(np.int64), len(_GRID) - 2)
    t = at - i
    low, high, rise, fall = _CDF[i], _CDF[i + 1], _STEP * _DENSITY[i], _STEP * _DENSITY[i + 1]
    gap = high - low
    return low + t * (rise + t * ((3 * gap - 2 * rise - fall) + t * (rise + fall - 2 * gap)))


def normal_quantile_fast(p: np.ndarray) -> np.ndarray:
    """Quantiles to about 1e-9 between 1e-12 and 1 - 1e-12, by the table and a Newton step; farther out by :func:`normal_quantile`."""
    x = np.interp(p, _CDF, _GRID)
    with np.errstate(all="ignore"):
        x = x - (normal_cdf(x) - p) * math.sqrt(2 * math.pi) * np.exp(0.5 * x * x)
    far = (p < 1e-12) | (p > 1 - 1e-12)
    if far.any():
        x[far] = normal_quantile(p[far])
    return x


def _root(r: np.ndarray) -> np.ndarray:
    """A lower triangular square root; ``r`` may be singular."""
    value, vector = np.linalg.eigh(r)
    return np.linalg.qr((vector * np.sqrt(np.maximum(value, 0))).T)[1].T


def chain_links(limit: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Correlations of neighbours; 1 where they are so close to it that :func:`chain_box` would need too fine a grid."""
    link = np.clip(np.diag(r, 1), -1.0, 1.0)
    return np.where(np.sqrt(1 - link * link) < np.max(limit) / 80, np.sign(link), link)


def chain_box(limit: np.ndarray, link: np.ndarray) -> float:
    """P(|X_i| <= limit_i for all i) of a Markov chain of standard normals with these neighbours' correlations.

    The density of the chain within its bounds is carried from each place to the next on
    Gauss-Legendre nodes; a correlation of 1 or -1 carries it on unchanged, within the
    narrower bound.
    """
    spread = np.sqrt(1 - link * link)
    finest = spread[spread > 0].min() if (spread > 0).any() else 1.0
    base, weight = np.polynomial.legendre.leggauss(int(np.clip(6 * np.max(limit) / finest, 64, 480)))
    bounds = np.array(limit, dtype=np.float64)
    for i in range(len(link) - 1, -1, -1):  # places that are one share the narrowest bound
        if spread[i] == 0:
            bounds[i] = min(bounds[i], bounds[i + 1])
    at = base * bounds[0]
    density, mass = np.exp(-at * at / 2) / math.sqrt(2 * math.pi), weight * bounds[0]
    for a, s, bound in zip(link, spread, bounds[1:]):
        if s == 0:
            continue  # the bound has been taken; a box and a normal density have no sign
        to = base * bound
        step = np.exp(-0.5 * ((to[:, None] - a * at[None]) / s) ** 2) / (s * math.sqrt(2 * math.pi))
        density, at, mass = step @ (mass * density), to, weight * bound
    return float(mass @ density)


def _slice(limit: float, ahead, scale: float, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance of |ahead + scale Z| <= limit, and a Z within that at the share ``u`` of it."""
    low, high = normal_cdf((-limit - ahead) / abs(scale)), normal_cdf((limit - ahead) / abs(scale))
    z = np.sign(scale) * normal_quantile_fast(np.clip(low + u * (high - low), 1e-300, 1 - 1e-16))
    return np.maximum(high - low, 0), z


def mvn_box_error(limit: np.ndarray, r: np.ndarray, accuracy: float = 5e-4, relative: float = 5e-3, most: int = 40_000, shifts: int = 10, seed: int = 1) -> tuple[float, float]:
    """(P(|Z_i| <= limit_i for all i), error) for correlation ``r``: separated variables over a shifted lattice.

    The same points also pass through a Markov chain with the same correlations of neighbours,
    whose box :func:`chain_box` knows; what they miss there is taken off, in the proportion
    in which both vary together. Sums over growing sets of variants are nearly such a chain.
    The error is three standard errors over the shifts. Points are doubled until it is below
    ``accuracy`` or below ``relative`` times the complement; past ``most`` points what is reached is told.
    """
    limit, n = np.asarray(limit, dtype=np.float64), len(limit)
    r = nearest_correlation(np.asarray(r, dtype=np.float64))
    root, link = _root(r), chain_links(limit, r)
    known = chain_box(limit, link)
    bounds = limit.copy()
    for i in range(n - 2, -1, -1):
        if abs(link[i]) == 1:
            bounds[i] = min(bounds[i], bounds[i + 1])
    primes, rng = np.sqrt(_primes(n)), np.random.default_rng(seed)
    start = rng.random((shifts, 1, n))
    sums, beside, squares, products, done, m = np.zeros(shifts), np.zeros(shifts), 0.0, 0.0, 0, 500
    while True:
        for a in range(done, m, 4000):
            b = min(m, a + 4000)
            lattice = np.arange(a + 1, b + 1)[:, None] * primes[None]
            u = np.abs(2 * ((lattice[None] + start) % 1) - 1).reshape(shifts * (b - a), n).T.copy()
            p, y, p_chain, x = np.ones(u.shape[1]), np.zeros(u.shape), np.ones(u.shape[1]), np.zeros(u.shape[1])
            for i in range(n):
                ahead, scale = root[i, :i] @ y[:i], root[i, i]
                if abs(scale) < 1e-10:
                    p = p * (np.abs(ahead) <= limit[i] + 1e-9)
                else:
                    chance, y[i] = _slice(limit[i], ahead, scale, u[i])
                    p = p * chance
                if i and abs(link[i - 1]) == 1:
                    continue
                along = link[i - 1] if i else 0.0
                chance, z = _slice(bounds[i], along * x, math.sqrt(1 - along * along), u[i])
                p_chain, x = p_chain * chance, along * x + math.sqrt(1 - along * along) * z
            sums += p.reshape(shifts, b - a).sum(axis=1)
            beside += p_chain.reshape(shifts, b - a).sum(axis=1)
            squares, products = squares + float(p_chain @ p_chain), products + float(p @ p_chain)
        done = m
        total = shifts * m
        varies = squares / total - (beside.sum() / total) ** 2
        share = (products / total - sums.sum() * beside.sum() / total**2) / varies if varies > 1e-14 else 0.0
        value = sums / m - share * (beside / m - known)
        error = 3 * float(value.std(ddof=1)) / math.sqrt(shifts)
        if error <= max(accuracy, relative * (1 - value.mean())) or total >= most:
            return float(min(1.0, max(0.0, value.mean()))), error
        m *= 2


def mvn_box(limit: np.ndarray, r: np.ndarray, **settings) -> float:
    """P(|Z_i| <= limit_i for all i); see :func:`mvn_box_error`."""
    return mvn_box_error(limit, r, **settings)[0]


def mvn_any(limit: float, r: np.ndarray, relative: float = 1e-2, most: int = 1_000_000, seed: int = 1) -> tuple[float, float]:
    """(P(|Z_i| >= limit for any i), error) for correlation ``r``, with a small relative error however small it is.

    Importance sampling over the union: one i is picked, Z is drawn given |Z_i| >= limit, and
    counts n p1 / (how many exceed the limit), which lies between p1, the chance of one, and
    n p1. The error is three standard errors; draws are doubled until it is below ``relative``
    times the probability.
    """
    r = nearest_correlation(np.asarray(r, dtype=np.float64))
    n, single = len(r), float(chi2_tail_1(limit * limit)[0])
    if n == 1 or single == 0.0:
        return single, 0.0
    root, rng = _root(r), np.random.default_rng(seed)
    count, first, second, m = 0, 0.0, 0.0, 8192
    while True:
        pick = np.arange(m) % n
        one = np.sqrt(chi2_quantile_1_upper(single * (1 - rng.random(m))))
        z = rng.normal(size=(m, n)) @ root.T
        z += (one - z[np.arange(m), pick])[:, None] * r[pick]
        z[np.arange(m), pick] = np.maximum(one, limit)
        share = 1.0 / (np.abs(z) >= limit * (1 - 1e-12)).sum(axis=1)
        count, first, second = count + m, first + share.sum(), second + (share * share).sum()
        mean = first / count
        error = 3 * math.sqrt(max(second / count - mean * mean, 0.0) / count) + 1.5 / count  # the last for what no draw has met
        if error <= relative * mean or count >= most:
            return min(1.0, n * single * mean), n * single * error
        m = count


def _square(x) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return x.reshape(math.isqrt(len(x)), -1)


def register(spark: SparkSession) -> None:
    """SQL functions of this module.

    chi2_p, chi2_underflow, chi2_upper_quantile, chi2_df_p(x, df), noncentral_chi2_p(x, df, shift),
    normal_quantile, normal_cdf, beta_pdf(x, a, b), beta_cdf(x, a, b), beta_upto(p, a, b) (its quantile), hwe_exact,
    mixture_p(q, weights), liu_p(q, weights), box_p(limits, correlations by rows), any_p(limit, correlations by rows),
    sigmoid, odds_ratio(effect, mean).
    """
    def udf(name: str, kind: str, f) -> None:
        spark.udf.register(name, F.pandas_udf(f, kind))

    def chi2_p(x: pd.Series) -> pd.Series:
        return pd.Series(chi2_tail_1_reported(x)[0])

    def under(x: pd.Series) -> pd.Series:
        return pd.Series(chi2_tail_1_reported(x)[1])

    def quantile(x: pd.Series) -> pd.Series:
        return pd.Series(normal_quantile(x))

    def upper(x: pd.Series) -> pd.Series:
        return pd.Series(chi2_quantile_1_upper(x))

    def hwe(h: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(hwe_exact(h, a, b))

    def mixture(q: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([chi2_mixture_tail(a, b) for a, b in zip(q, w)])

    def liu(q: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([liu_tail(a, b) for a, b in zip(q, w)])

    def each(f):
        """``f`` by rows; null where an argument is."""
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None or (isinstance(v, float) and math.isnan(v)) for v in row) else float(f(*row)) for row in zip(*columns)], dtype="float64")

        return run

    one, two, three = each(lambda x: normal_cdf(np.array([x]))[0]), {}, {}
    two["chi2_df_p"], two["box_p"], two["any_p"] = each(chi2_tail), each(lambda x, r: mvn_box(np.asarray(x), _square(r))), each(lambda t, r: mvn_any(t, _square(r))[0])
    two["odds_ratio"] = each(lambda b, m: math.exp(b / (m * (1 - m))))
    three["noncentral_chi2_p"], three["beta_cdf"], three["beta_upto"] = each(noncentral_chi2_tail), each(beta_cdf), each(beta_quantile)
    three["beta_pdf"] = each(lambda x, a, b: math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * x ** (a - 1) * (1 - x) ** (b - 1))
    one_more = each(lambda x: 1 / (1 + math.exp(-x)) if x > -700 else 0.0)

    def unary(f):
        def run(x: pd.Series) -> pd.Series:
            return f(x)

        return run

    def binary(f):
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return f(x, y)

        return run

    def ternary(f):
        def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
            return f(x, y, z)

        return run

    udf("normal_cdf", "double", unary(one))
    udf("sigmoid", "double", unary(one_more))
    for name, f in two.items():
        udf(name, "double", binary(f))
    for name, f in three.items():
        udf(name, "double", ternary(f))
    for name, kind, f in (("chi2_p", "double", chi2_p), ("chi2_underflow", "boolean", under), ("normal_quantile", "double", quantile), ("chi2_upper_quantile", "double", upper), ("hwe_exact", "double", hwe), ("mixture_p", "double", mixture), ("liu_p", "double", liu)):
        udf(name, kind, f)


def chi2_p(x: Column) -> Column:
    """One degree of freedom, underflow rule applied, as a Column over Arrow batches; null stays null.

    Marked as not deterministic so that a filter on it stays above the projection that
    computes it, where Spark can run it in Python.
    """
    @F.pandas_udf("double")
    def tail(v: pd.Series) -> pd.Series:
        return pd.Series(chi2_tail_1_reported(v)[0])

    return F.when(x.isNotNull(), tail.asNondeterministic()(x))
