"""Related samples: mixed models and score tests on the block-diagonal rotation by families.

The covariance of a trait, s2g K + s2e I, has a block for every family (any set of samples that
shares no kinship with the rest). Each block is decomposed by itself, so a study's rotation is a
long table (block, i, sample, u) and a rotated vector is a join with it and a sum. Likelihoods
are sums over the rotated rows, worked out for a whole grid of variance ratios in one
aggregate. Once the variances are known, the rotation divided by their roots whitens everything:
scores and covariances of related samples are then those of unrelated ones in other coordinates.

Keys ``by`` (study, trait) tell models apart; all are fitted at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .bandjoin import by_blocks
from .genotypes import SITE, centred_products

LOW, STEP, BRACKETS = -10.0, 0.2, 100  # the grid of ln(s2e / s2g)
SMALL = 32  # members of a family up to which a carrier's whitened genotype is one row


def _schema(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in names)


def with_blocks(samples: DataFrame, kinship: DataFrame, by: list[str], block: str = "famid") -> DataFrame:
    """``kinship`` (by, block, a, b, k) of the ``samples`` (by, block, sample) alone; a sample that it lacks is related to itself only (1/2)."""
    own = samples.select(*by, block, "sample")
    a, b = own.withColumnRenamed("sample", "a"), own.withColumnRenamed("sample", "b")
    inside = kinship.select(*by, block, "a", "b", "k").join(a, [*by, block, "a"], "left_semi").join(b, [*by, block, "b"], "left_semi")
    lone = own.join(inside.filter("a = b").select(*by, block, F.col("a").alias("sample")), [*by, block, "sample"], "left_anti")
    return inside.unionByName(lone.select(*by, block, F.col("sample").alias("a"), F.col("sample").alias("b"), F.lit(0.5).alias("k")))


def relative_blocks(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sample, famid): ``samples`` grouped by chains of ``pairs`` (a, b); a block is named by its smallest member.

    Every round a sample takes the smallest name among its own, its relatives' and that name's
    own name, so that names travel twice as far each time.
    """
    edges = pairs.filter("a <> b").select("a", "b")
    edges = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "relatives")
    named = written(samples.select("sample", F.col("sample").alias("famid")).distinct(), "blocks")
    while True:
        near = edges.join(named.select(F.col("sample").alias("b"), "famid"), "b").groupBy(F.col("a").alias("sample")).agg(F.min("famid").alias("near"))
        least = named.join(near, "sample", "left").select("sample", F.col("famid").alias("old"), F.least("famid", "near").alias("name"))
        above = named.select(F.col("sample").alias("name"), F.col("famid").alias("above"))
        told = written(least.join(above, "name", "left").select("sample", "old", F.least("name", "above").alias("famid")), "blocks")
        named = told.select("sample", "famid")
        if told.filter("old <> famid").isEmpty():
            return named


def rotations(kinship: DataFrame, by: list[str], block: str = "famid", most: int = 5000) -> DataFrame:
    """by, block, i, sample, d, u: the eigenvectors u of twice the kinship of each block and their eigenvalues d.

    ``kinship``: by, block, a, b, k, both triangles; pairs not listed are 0. Eigenvalues below zero
    turn positive with their vectors, as in the reference. A block is one task's matrix: more
    than ``most`` members raise.
    """
    kind = dict(kinship.dtypes)["a"]
    keys = [*by, block]

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        block_no = (pdf[keys] != pdf[keys].shift()).any(axis=1).cumsum().to_numpy() - 1
        names, at = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]), return_inverse=True)
        members, place = np.unique(np.concatenate([block_no, block_no]) * len(names) + at, return_inverse=True)
        home = members // len(names)
        first, size = np.searchsorted(home, np.arange(block_no[-1] + 1)), np.bincount(home)
        if size.max() > most:
            raise ValueError(f"a block of {size.max()} related samples; at most {most} are decomposed")
        i, j = place[: len(pdf)] - first[block_no], place[len(pdf) :] - first[block_no]
        head = pdf[keys].iloc[np.searchsorted(block_no, np.arange(len(size)))].reset_index(drop=True)
        out = []
        for n in np.unique(size):
            own = np.flatnonzero(size == n)  # blocks of one size are decomposed together
            rows = size[block_no] == n
            m = np.zeros((len(own), n, n))
            m[np.searchsorted(own, block_no[rows]), i[rows], j[rows]] = 2 * pdf["k"].to_numpy()[rows]
            d, u = np.linalg.eigh((m + m.transpose(0, 2, 1)) / 2)
            u = np.where(d[:, None, :] < 0, -u, u).transpose(0, 2, 1)
            names_of = names[members[first[own][:, None] + np.arange(n)] % len(names)]
            told = head.iloc[np.repeat(own, n * n)].reset_index(drop=True)
            out.append(told.assign(i=np.tile(np.repeat(np.arange(n, dtype=np.int32), n), len(own)), sample=np.repeat(names_of[:, None, :], n, axis=1).ravel(), d=np.repeat(np.abs(d).ravel(), n), u=u.ravel()))
        return pd.concat(out)

    return by_blocks(kinship.select(*keys, "a", "b", "k"), keys, decompose, f"{_schema(kinship, keys)}i int, sample {kind}, d double, u double")


def rotated(rotation: DataFrame, samples: DataFrame, k: int, by: list[str], block: str = "famid") -> DataFrame:
    """by, block, i, d, y, x (array of ``k``): the trait ``y`` and the fixed effects ``xs`` (intercept included) of ``samples`` on the rotation."""
    j = rotation.join(samples.select(*by, block, "sample", "y", "xs"), [*by, block, "sample"])
    x = F.array(*[F.sum(F.col("u") * F.col("xs")[c]) for c in range(k)])
    return j.groupBy(*by, block, "i").agg(F.max("d").alias("d"), F.sum(F.col("u") * F.col("y")).alias("y"), x.alias("x"))


def profile(rows: DataFrame, k: int, by: list[str], grid: DataFrame) -> DataFrame:
    """by, log_delta, nll, nll_rest, beta, s2g, n of every point of ``grid`` (by, log_delta): one pass over the rows, each task adding them up for all points.

    With w = 1 / (d + delta): beta = (sum w x x')^-1 sum w x y, s2g = sum w (y - x'beta)^2 / n, and
    the negative log-likelihood (n ln(2 pi s2g) + sum ln(d + delta) + n) / 2. Near its minimum it is
    flatter than a double tells: sums are kept in extended precision, and ``nll_rest`` is what
    ``nll`` leaves out.
    """
    points: dict[tuple, list[float]] = {}
    for r in grid.collect():  # a few hundred a model
        points.setdefault(tuple(r[c] for c in by), []).append(r["log_delta"])
    wide = k + 1
    width = 2 + wide * (wide + 1) // 2
    upper = [(a, c) for a in range(wide) for c in range(a, wide)]  # of (y, x)
    names = [f"{part}{i}" for part in ("s", "rest") for i in range(width)]

    def add(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, g in b.groupby(by, sort=False, dropna=False) if by else [((), b)]:
                key = tuple(None if pd.isna(v) else v for v in key)
                if key not in points:
                    continue
                m = np.column_stack([g["y"].to_numpy(), np.stack(g["x"].to_numpy())])
                squares = np.column_stack([m[:, a] * m[:, c] for a, c in upper])
                d = g["d"].to_numpy()
                held = total.setdefault(key, np.zeros((len(points[key]), width), dtype=np.longdouble))
                for p, log_delta in enumerate(points[key]):
                    v = d + np.exp(log_delta)
                    held[p, 0] += len(d)
                    held[p, 1] += np.log(v).sum(dtype=np.longdouble)
                    held[p, 2:] += (squares / v[:, None]).sum(axis=0, dtype=np.longdouble)
        out = []
        for key, held in total.items():
            whole = held.astype(np.float64)
            out += [(*key, q, *w, *r) for q, w, r in zip(points[key], whole, (held - whole).astype(np.float64))]
        yield pd.DataFrame(out, columns=[*by, "log_delta", *names])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        s = (pdf[names[:width]].to_numpy().astype(np.longdouble) + pdf[names[width:]].to_numpy()).sum(axis=0)
        n, logs, m = s[0], s[1], np.zeros((wide, wide), dtype=np.longdouble)
        for (a, c), v in zip(upper, s[2:]):
            m[a, c] = m[c, a] = v
        inverse = np.linalg.pinv(m[1:, 1:].astype(np.float64))
        beta = inverse @ m[1:, 0]
        beta = beta + inverse @ (m[1:, 0] - m[1:, 1:] @ beta)  # what a double's inverse left
        s2g = max((m[0, 0] - beta @ m[1:, 0]) / n, np.longdouble(1e-300))
        nll = (n * np.log(8 * np.arctan(np.longdouble(1)) * s2g) + logs + n) / 2
        told = {c: [v] for c, v in zip([*by, "log_delta"], pdf[[*by, "log_delta"]].iloc[0])}
        return pd.DataFrame(told | {"n": [int(n)], "beta": [beta.astype(np.float64)], "s2g": [float(s2g)], "nll": [float(nll)], "nll_rest": [float(nll - np.longdouble(float(nll)))]})

    schema = _schema(rows, by)
    parts = rows.select(*by, "d", "y", "x").mapInPandas(add, f"{schema}log_delta double, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy(*by, "log_delta").applyInPandas(solve, f"{schema}log_delta double, n long, beta array<double>, s2g double, nll double, nll_rest double")


def fit_mixed(rows: DataFrame, k: int, by: list[str], rounds: int = 4) -> DataFrame:
    """by, log_delta, log_likelihood, beta, s2g, s2e, h2, n: the best of a grid of ln(s2e / s2g), refined around each of its minima.

    The grid has 101 points from -10 on, 0.2 apart; a round divides the step by ten around every
    minimum of each model. What reaches the driver are those likelihoods, a few hundred a model.
    """
    rows = written(rows, "rotated")
    spark = rows.sparkSession
    keys = [r[:] for r in rows.select(*by).distinct().collect()]
    schema = _schema(rows, by) + "log_delta double"
    top = LOW + STEP * BRACKETS
    grid = {key: [LOW + STEP * i for i in range(BRACKETS + 1)] for key in map(tuple, keys)}
    best: dict[tuple, tuple] = {}
    for n in range(rounds + 1):
        if not grid:
            break
        points = spark.createDataFrame([(*key, float(p)) for key, ps in grid.items() for p in ps], schema)
        found: dict[tuple, list] = {}
        for r in profile(rows, k, by, points).collect():
            found.setdefault(tuple(r[c] for c in by), []).append((r["log_delta"], r))
        grid = {}
        for key, told in found.items():
            told.sort(key=lambda x: x[0])
            value = [(r["nll"], r["nll_rest"]) for _, r in told]
            lows = [i for i in range(len(told)) if (i == 0 or value[i] <= value[i - 1]) and (i + 1 == len(told) or value[i] <= value[i + 1])]
            for i in lows:
                if key not in best or (value[i], told[i][0]) < best[key][:2]:
                    best[key] = (value[i], told[i][0], told[i][1])
            step = STEP / 10 ** (n + 1)
            near = {round(told[i][0] + step * s, 9) for i in lows for s in range(-10, 11)}
            grid[key] = sorted(p for p in near if LOW <= p <= top)
    out = []
    for key, (nll, log_delta, r) in best.items():
        delta = math.exp(log_delta)
        out.append((*key, log_delta, -nll[0], list(r["beta"]), r["s2g"], r["s2g"] * delta, 1 / (1 + delta), r["n"]))
    return spark.createDataFrame(out, _schema(rows, by) + "log_delta double, log_likelihood double, beta array<double>, s2g double, s2e double, h2 double, n long")


def whitening(rotation: DataFrame, fit: DataFrame, by: list[str], block: str = "famid") -> DataFrame:
    """by, block, i, sample, z: the rotation over the roots of its rows' variances s2g d + s2e."""
    return rotation.join(F.broadcast(fit.select(*by, "s2g", "s2e")), by).select(*by, block, "i", "sample", (F.col("u") / F.sqrt(F.col("s2g") * F.col("d") + F.col("s2e"))).alias("z"))


def _columns(white: DataFrame, by: list[str], block: str) -> DataFrame:
    """by, block, sample, z: a sample's column of the whitening; null in families of more than ``SMALL``."""
    z = F.transform(F.array_sort(F.collect_list(F.struct("i", "z"))), lambda x: x["z"])
    return white.groupBy(*by, block, "sample").agg(z.alias("z")).withColumn("z", F.when(F.size("z") <= SMALL, F.col("z")))


def _large(white: DataFrame, by: list[str], block: str) -> DataFrame:
    """The rows of ``white`` of families of more than ``SMALL``."""
    return white.join(white.filter(F.col("i") == SMALL).select(*by, block).distinct(), [*by, block], "left_semi")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def whitened_samples(white: DataFrame, samples: DataFrame, fit: DataFrame, by: list[str], block: str = "famid") -> DataFrame:
    """by, block, sample, pull, ones, z: each sample's entry in V^-1 (y - X beta) and in V^-1 1, and in small families its column of the whitening: all that scores need of it."""
    s = samples.join(F.broadcast(fit.select(*by, "beta")), by)
    s = s.select(*by, block, "sample", (F.col("y") - F.aggregate(F.zip_with("xs", "beta", lambda x, b: x * b), F.lit(0.0), lambda t, v: t + v)).alias("r"))
    cells = white.join(s, [*by, block, "sample"])
    along = cells.groupBy(*by, block, "i").agg(F.sum(F.col("z") * F.col("r")).alias("e"), F.sum("z").alias("o"))
    told = cells.select(*by, block, "i", "sample", "z").join(along, [*by, block, "i"]).groupBy(*by, block, "sample").agg(F.sum(F.col("z") * F.col("e")).alias("pull"), F.sum(F.col("z") * F.col("o")).alias("ones"))
    return told.join(_columns(white, by, block), [*by, block, "sample"])


def whitened_genotypes(nonzero: DataFrame, white: DataFrame, by: list[str], block: str = "famid") -> DataFrame:
    """by, site, block, i, x (array): genotypes (by, site, sample, dose; rows of dose 0 absent) in whitened coordinates, for the blocks with a carrier.

    In a small family there is a row for each carrier: ``i`` is null, and ``x``, what it adds to
    all of the family's coordinates. In others there is a row for each coordinate i, ``x`` of one.
    """
    columns = _columns(white, by, block).filter("z is not null")
    small = nonzero.join(columns, [*by, "sample"]).select(*by, *SITE, block, F.lit(None).cast("int").alias("i"), F.transform("z", lambda z: z * F.col("dose")).alias("x"))
    if white.filter(F.col("i") == SMALL).isEmpty():
        return small
    large = nonzero.join(_large(white, by, block), [*by, "sample"]).groupBy(*by, *SITE, block, "i").agg(F.array(F.sum(F.col("z") * F.col("dose"))).alias("x"))
    return small.unionByName(large)


def related_scores(nonzero: DataFrame, white: DataFrame, people: DataFrame, by: list[str], block: str = "famid", cells: DataFrame | None = None, codings: dict | None = None) -> DataFrame:
    """by, site, n, alt_ac, u, v, mean, along: U = g'V^-1 r and V = g'V^-1 g of centred genotypes g.

    ``white`` from :func:`whitening`, ``people`` from :func:`whitened_samples`, ``cells`` from
    :func:`whitened_genotypes` if it is at hand. A missing genotype takes part as a row of its
    variant's mean dose. mean and along (the product with V^-1 1) serve the covariances. With
    ``codings`` (name to a function of the dose) there is a row for each of them that has a
    carrier, named by a column model. A carrier meets its own sample once, and another of its
    family only where both carry the variant.
    """
    coded = codings or {"": lambda dose: dose}
    facts = people.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("pull").alias("all_pull"), F.sum("ones").alias("all_ones"))
    placed = nonzero.select(*by, *SITE, "sample", "dose").join(people, [*by, "sample"])
    x = {k: f(F.col("dose")) for k, f in coded.items()}
    own = F.coalesce(_dot(F.col("z"), F.col("z")), F.lit(0.0))
    sums = placed.withColumn("own", own).groupBy(*by, *SITE).agg(*[a for k in coded for a in (F.sum(x[k]).alias(f"g_{k}"), F.sum(x[k] * F.col("pull")).alias(f"r_{k}"), F.sum(x[k] * F.col("ones")).alias(f"a_{k}"), F.sum(x[k] * x[k] * F.col("own")).alias(f"s_{k}"))])
    one = placed.filter("z is not null").select(*by, *SITE, block, "sample", "dose", "z")
    two = one.select(*by, *SITE, block, F.col("sample").alias("sample2"), F.col("dose").alias("dose2"), F.col("z").alias("z2"))
    both = one.join(two, [*by, *SITE, block]).filter("sample < sample2").withColumn("w", 2 * _dot(F.col("z"), F.col("z2")))
    squares = both.groupBy(*by, *SITE).agg(*[F.sum(f(F.col("dose")) * f(F.col("dose2")) * F.col("w")).alias(f"p_{k}") for k, f in coded.items()])
    if not white.filter(F.col("i") == SMALL).isEmpty():
        if cells is not None and not codings:
            large = cells.filter("i is not null").select(*by, *SITE, F.col("x")[0].alias("x_"))
        else:
            large = nonzero.join(_large(white, by, block), [*by, "sample"]).groupBy(*by, *SITE, block, "i").agg(*[F.sum(F.col("z") * x[k]).alias(f"x_{k}") for k in coded])
        squares = squares.unionByName(large.groupBy(*by, *SITE).agg(*[F.sum(F.col(f"x_{k}") * F.col(f"x_{k}")).alias(f"p_{k}") for k in coded]))
        squares = squares.groupBy(*by, *SITE).agg(*[F.sum(f"p_{k}").alias(f"p_{k}") for k in coded])
    rows = F.array(*[F.struct(F.lit(k).alias("model"), F.col(f"g_{k}").alias("alt_ac"), F.col(f"r_{k}").alias("gr"), F.col(f"a_{k}").alias("along"), (F.col(f"s_{k}") + F.coalesce(f"p_{k}", F.lit(0.0))).alias("gg")) for k in coded])
    told = sums.join(squares, [*by, *SITE], "left").select(*by, *SITE, F.inline(rows)).filter("alt_ac > 0")
    j = told.join(F.broadcast(facts), by).withColumn("mean", F.col("alt_ac") / F.col("n"))
    u = F.col("gr") - F.col("mean") * F.col("all_pull")
    v = F.col("gg") - 2 * F.col("mean") * F.col("along") + F.col("mean") * F.col("mean") * F.col("all_ones")
    return j.select(*(["model"] if codings else []), *by, *SITE, F.col("n").cast("int").alias("n"), "alt_ac", u.alias("u"), F.greatest(v, F.lit(0.0)).alias("v"), "mean", "along")


def related_covariance(cells: DataFrame, scores: DataFrame, people: DataFrame, by: list[str], window: int = 1_000_000, block: str = "famid") -> DataFrame:
    """by, chrom, pos, pos2, cov of related samples: g'V^-1 g2 / n of all variants up to ``window`` downstream."""
    groups = people.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("ones").alias("ones"))
    own = cells.select(*by, "chrom", "pos", F.concat_ws("\x1f", F.col(block).cast("string"), "i").alias("cell"), "x")
    return centred_products(own, "cell", scores.select(*by, "chrom", "pos", "mean", "along"), groups, by, window)


# ---- two and three variance components ----


def _family_sums(m: np.ndarray, parts: list[np.ndarray], theta: np.ndarray) -> np.ndarray:
    """What families of one size add to the likelihood's sums at given variances, by Cholesky's decomposition of each block.

    ``m``: families, members, trait and fixed effects; ``parts``: families, members, members of every component.
    """
    count, n, _ = m.shape
    eye = np.broadcast_to(np.eye(n), (count, n, n))
    v = sum(t * p for t, p in zip(theta, parts)) + theta[-1] * eye
    c = np.linalg.cholesky(v)
    root = np.linalg.solve(c, eye)
    inverse = root.transpose(0, 2, 1) @ root
    im = inverse @ m
    products = [*(inverse @ p for p in parts), inverse]
    quad = [(im.transpose(0, 2, 1) @ p @ im).sum(axis=0).ravel() for p in parts] + [(im.transpose(0, 2, 1) @ im).sum(axis=0).ravel()]
    traces = [np.trace(p, axis1=1, axis2=2).sum() for p in products]
    information = [[np.sum(a * b.transpose(0, 2, 1)) for b in products] for a in products]
    logs = 2 * np.log(np.diagonal(c, axis1=1, axis2=2)).sum()
    return np.concatenate([[count * n, logs], (m.transpose(0, 2, 1) @ im).sum(axis=0).ravel(), *quad, traces, np.ravel(information)])


def _stacked(families: DataFrame, kinds: int, by: list[str]) -> DataFrame:
    """by, n, m, k0, ...: a family's members by trait and fixed effects and the matrix of every component, all flattened."""
    def run(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                names = {p["sample"]: i for i, p in enumerate(r["people"])}
                row = {c: r[c] for c in by} | {"n": len(names), "m": np.array([[p["y"], *p["xs"]] for p in r["people"]], dtype=np.float64).ravel()}
                for c in range(kinds - 1):
                    x = np.zeros((len(names), len(names)))
                    for e in r[f"k{c}"] if r[f"k{c}"] is not None else []:
                        if e["a"] in names and e["b"] in names:
                            x[names[e["a"]], names[e["b"]]] = 2 * e["k"]
                    row[f"k{c}"] = x.ravel()
                out.append(row)
            yield pd.DataFrame(out, columns=[*by, "n", "m", *(f"k{c}" for c in range(kinds - 1))])

    return families.mapInPandas(run, _schema(families, by) + "n int, m array<double>" + "".join(f", k{c} array<double>" for c in range(kinds - 1)))


def variance_components(samples: DataFrame, kinships: list[DataFrame], k: int, by: list[str], block: str = "famid", rounds: int = 60, tolerance: float = 1e-9, floor: float = 1e-7) -> DataFrame:
    """by, variances (of each of ``kinships``, then the residual's), beta, log_likelihood, n, rounds: maximum likelihood by Fisher scoring.

    ``samples``: by, block, sample, y, xs (``k`` fixed effects); ``kinships``: tables of by, block,
    a, b, k (twice which is the component's matrix). A round is one pass over families: each
    decomposes its own block and adds to a row of sums per model, from which the score and the
    expected information follow. Steps are halved while they lower the likelihood; a variance
    stays at or above ``floor`` times the trait's. A singular block raises.
    """
    parts = None
    for c, kin in enumerate(kinships):
        rows = with_blocks(samples, kin, by, block) if c == 0 else kin.select(*by, block, "a", "b", "k")
        listed = rows.groupBy(*by, block).agg(F.collect_list(F.struct("a", "b", "k")).alias(f"k{c}"))
        parts = listed if parts is None else parts.join(listed, [*by, block], "left")
    people = samples.groupBy(*by, block).agg(F.array_sort(F.collect_list(F.struct("sample", "y", "xs"))).alias("people"))
    kinds = len(kinships) + 1
    families = written(_stacked(people.join(parts, [*by, block], "left"), kinds, by), "families")
    width = 2 + (k + 1) ** 2 * (1 + kinds) + kinds + kinds * kinds
    start = samples.groupBy(*by).agg(F.var_pop("y").alias("v")).collect()
    scale = {tuple(r[c] for c in by): max(r["v"] or 0.0, 1e-12) for r in start}
    theta = {key: np.full(kinds, v / kinds) for key, v in scale.items()}
    schema = _schema(samples, by) + ", ".join(f"s{i} double" for i in range(width))

    def at(trial: dict) -> dict:
        """Sums at every model's trial variances, added up per model: one row each."""

        def run(batches):
            total: dict[tuple, np.ndarray] = {}
            for b in batches:
                for (*key, n), g in b.groupby([*by, "n"], sort=False, dropna=False):
                    key = tuple(None if pd.isna(v) else v for v in key)
                    if key in trial:
                        m = np.concatenate(g["m"].to_list()).reshape(len(g), n, k + 1)
                        matrices = [np.concatenate(g[f"k{c}"].to_list()).reshape(len(g), n, n) for c in range(kinds - 1)]
                        total[key] = total.get(key, 0) + _family_sums(m, matrices, trial[key])
            yield pd.DataFrame([(*key, *v) for key, v in total.items()], columns=[*by, *(f"s{i}" for i in range(width))])

        told = families.mapInPandas(run, schema).groupBy(*by).agg(*[F.sum(f"s{i}") for i in range(width)])
        return {tuple(r)[: len(by)]: _likelihood(np.array(tuple(r)[len(by) :]), kinds, k) for r in told.collect()}

    found = at(theta)
    open_, steps, taken = set(found), {}, dict.fromkeys(found, 0)
    for _ in range(rounds):
        if not open_:
            break
        trial = {}
        for key in open_:
            if key not in steps:
                steps[key] = _scoring_step(theta[key], found[key], floor * scale[key])
            trial[key] = np.maximum(theta[key] + steps[key], floor * scale[key])
        for key, new in at(trial).items():
            moved = float(np.abs(trial[key] - theta[key]).max()) / scale[key]
            if new["value"] >= found[key]["value"] - 1e-12 * abs(found[key]["value"]):
                theta[key], found[key] = trial[key], new
                taken[key] += 1
                del steps[key]
            else:
                steps[key] = steps[key] / 2
            if moved < tolerance:
                open_.discard(key)
    rows = [(*key, [float(x) for x in theta[key]], [float(b) for b in f["beta"]], float(f["value"]), int(f["n"]), taken[key]) for key, f in found.items()]
    return samples.sparkSession.createDataFrame(rows, _schema(samples, by) + "variances array<double>, beta array<double>, log_likelihood double, n long, rounds int")


def _likelihood(s: np.ndarray, kinds: int, k: int) -> dict:
    """Value, fixed effects, score and information of a model's sums."""
    n, logs = s[0], s[1]
    size = (k + 1) ** 2
    at = 2 + size
    b = s[2:at].reshape(k + 1, k + 1)
    beta = np.linalg.pinv(b[1:, 1:]) @ b[1:, 0]
    r = np.concatenate([[1.0], -beta])
    quad = np.array([r @ s[at + size * c : at + size * (c + 1)].reshape(k + 1, k + 1) @ r for c in range(kinds)])
    at += size * kinds
    score = 0.5 * (quad - s[at : at + kinds])
    information = 0.5 * s[at + kinds :].reshape(kinds, kinds)
    return {"n": n, "value": -0.5 * (n * math.log(2 * math.pi) + logs + r @ b @ r), "beta": beta, "score": score, "information": information}


def _scoring_step(theta: np.ndarray, found: dict, floor: float) -> np.ndarray:
    """Fisher's step for the variances that aren't held at the floor."""
    free = (theta > floor * 1.0001) | (found["score"] > 0)
    step = np.zeros(len(theta))
    if free.any():
        step[free] = np.linalg.pinv(found["information"][np.ix_(free, free)]) @ found["score"][free]
    return step


def component_whitening(samples: DataFrame, kinships: list[DataFrame], fit: DataFrame, by: list[str], block: str = "famid") -> DataFrame:
    """by, block, i, sample, z of a fit by :func:`variance_components`: each family's whole covariance decomposed, its rows divided by the roots of the eigenvalues."""
    f = F.broadcast(fit.select(*by, "variances"))
    total = None
    for c, kin in enumerate(kinships):
        rows = with_blocks(samples, kin, by, block) if c == 0 else kin.select(*by, block, "a", "b", "k")
        part = rows.join(f, by).select(*by, block, "a", "b", (F.col("k") * F.col("variances")[c]).alias("k"))
        total = part if total is None else total.unionByName(part)
    own = samples.join(f, by).select(*by, block, F.col("sample").alias("a"), F.col("sample").alias("b"), (F.element_at("variances", -1) / 2).alias("k"))
    whole = total.unionByName(own).groupBy(*by, block, "a", "b").agg(F.sum("k").alias("k"))
    mine = samples.select(*by, block, "sample")
    whole = whole.join(mine.withColumnRenamed("sample", "a"), [*by, block, "a"], "left_semi").join(mine.withColumnRenamed("sample", "b"), [*by, block, "b"], "left_semi")
    return rotations(whole, by, block).select(*by, block, "i", "sample", (F.col("u") / F.sqrt("d")).alias("z"))
