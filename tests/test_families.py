"""Related samples beside whole matrices: random pedigrees of three generations in two studies, with a covariate."""

import math

import numpy as np
import pytest
from dense import SpectralModel, variance_components
from pyspark.sql import functions as F

from variantloom.operators import families, kinship

BY = ["study"]


def pedigrees(seed=3, count=14):
    """People rows (famid, pid, father, mother, sex, zygosity) of ``count`` families, and who of them are sampled."""
    rng = np.random.default_rng(seed)
    people, sampled = [], []
    for f in range(count):
        famid = f"{f % 2}_{f}"
        generation = [("p1", "0", "0", 1), ("p2", "0", "0", 2)]
        children = [(f"c{i}", "p1", "p2", 1 + int(rng.integers(2))) for i in range(int(rng.integers(1, 5)))]
        generation += children
        for i, c in enumerate(children[:2]):
            generation.append((f"q{i}", "0", "0", 3 - c[3]))
            father, mother = (c[0], f"q{i}") if c[3] == 1 else (f"q{i}", c[0])
            generation += [(f"g{i}{j}", father, mother, 1 + int(rng.integers(2))) for j in range(int(rng.integers(0, 3)))]
        for pid, father, mother, sex in generation:
            people.append((famid, f"{famid}.{pid}", "0" if father == "0" else f"{famid}.{father}", "0" if mother == "0" else f"{famid}.{mother}", sex, None))
            if rng.random() < 0.8:
                sampled.append((f % 2, famid, f"{famid}.{pid}", sex))
    return people, sampled


@pytest.fixture(scope="module")
def study(spark):
    people, sampled = pedigrees()
    ped = spark.createDataFrame(people, "famid string, pid string, father string, mother string, sex int, zygosity string")
    tables = {}
    for name, x_linked in (("auto", False), ("x", True)):
        k = kinship.pedigree_kinship(ped, x_linked).withColumn("study", F.split("famid", "_")[0].cast("int"))
        tables[name] = families.with_blocks(spark.createDataFrame([s[:3] for s in sampled], "study int, famid string, sample string"), k, BY).persist()
    rng = np.random.default_rng(9)
    told = {}
    for k in (0, 1):
        names = [s[2] for s in sampled if s[0] == k]
        at = {n: i for i, n in enumerate(names)}
        matrices = []
        for name in ("auto", "x"):
            m = np.zeros((len(names), len(names)))
            for r in tables[name].filter(F.col("study") == k).collect():
                m[at[r["a"]], at[r["b"]]] = 2 * r["k"]
            matrices.append(m)
        c = rng.normal(size=len(names))
        v = 2.0 * matrices[0] + 0.7 * matrices[1] + 1.0 * np.eye(len(names))
        y = 3 + 0.5 * c + np.linalg.cholesky(v) @ rng.normal(size=len(names))
        told[k] = {"names": names, "k": matrices[0], "kx": matrices[1], "y": y, "x": np.column_stack([np.ones(len(names)), c])}
    rows = [(s[0], s[1], s[2], float(told[s[0]]["y"][i]), [float(v) for v in told[s[0]]["x"][i]]) for k in (0, 1) for i, s in enumerate([t for t in sampled if t[0] == k])]
    samples = spark.createDataFrame(rows, "study int, famid string, sample string, y double, xs array<double>").persist()
    return {"samples": samples, "auto": tables["auto"], "x": tables["x"], "told": told}


@pytest.fixture(scope="module")
def rotation(study):
    return families.rotations(study["auto"], BY).persist()


@pytest.fixture(scope="module")
def fit(study, rotation):
    return families.fit_mixed(families.rotated(rotation, study["samples"], 2, BY), 2, BY).persist()


def test_rotation_is_orthogonal_and_gives_the_matrix_back(study, rotation):
    for k in (0, 1):
        t = study["told"][k]
        at, rows = {n: i for i, n in enumerate(t["names"])}, {}
        u, d = np.zeros((len(at), len(at))), np.zeros(len(at))
        for r in rotation.filter(F.col("study") == k).collect():
            i = rows.setdefault((r["famid"], r["i"]), len(rows))
            u[i, at[r["sample"]]], d[i] = r["u"], r["d"]
        assert len(rows) == len(at) and np.allclose(u @ u.T, np.eye(len(at))) and np.allclose(u.T @ np.diag(d) @ u, t["k"])


def test_profile_at_a_given_ratio(spark, study, rotation):
    rows = families.rotated(rotation, study["samples"], 2, BY)
    grid = spark.createDataFrame([(k, g) for k in (0, 1) for g in (-3.0, 0.0, 2.5)], "study int, log_delta double")
    for r in families.profile(rows, 2, BY, grid).collect():
        t = study["told"][r["study"]]
        nll, beta, s2g = SpectralModel(t["y"], t["x"], t["k"]).at(r["log_delta"])
        assert abs(r["nll"] - nll) < 1e-8 and np.allclose(r["beta"], beta) and abs(r["s2g"] - s2g) < 1e-8


def test_fit_is_that_of_the_whole_matrix(study, fit):
    got = {r["study"]: r for r in fit.collect()}
    for k in (0, 1):
        t = study["told"][k]
        want = SpectralModel(t["y"], t["x"], t["k"]).fit()
        assert abs(got[k]["log_likelihood"] - want["log_likelihood"]) < 1e-7 and got[k]["n"] == len(t["y"])
        assert np.allclose(got[k]["beta"], want["beta"], atol=1e-4) and abs(got[k]["h2"] - want["h2"]) < 1e-4


def genotypes_of(spark, study, seed=5, sites=12):
    rng = np.random.default_rng(seed)
    dense, rows = {}, []
    for k in (0, 1):
        names = study["told"][k]["names"]
        dense[k] = rng.binomial(2, 0.15, (sites, len(names))).astype(float)
        dense[k][0, :] = 0.0
        rows += [(k, "1", 1000 * j, "A", "C", n, float(dense[k][j, i])) for j in range(sites) for i, n in enumerate(names) if dense[k][j, i]]
    return dense, spark.createDataFrame(rows, "study int, chrom string, pos int, ref string, alt string, sample string, dose double")


def check_scores(study, dense, scores, covariance, inverse_of, beta_of, window):
    n_cov = 0
    cov = {(r["study"], r["pos"], r["pos2"]): r["cov"] for r in covariance.collect()}
    for r in scores.collect():
        k, t = r["study"], study["told"][r["study"]]
        inverse = inverse_of(k)
        g = dense[k][r["pos"] // 1000]
        g = g - g.mean()
        assert abs(r["u"] - g @ inverse @ (t["y"] - t["x"] @ beta_of(k))) < 1e-8 and abs(r["v"] - g @ inverse @ g) < 1e-8 and r["n"] == len(g)
        for j in range(len(dense[k])):
            if r["pos"] <= 1000 * j <= r["pos"] + window and dense[k][j].any():
                h = dense[k][j] - dense[k][j].mean()
                assert abs(cov[k, r["pos"], 1000 * j] - g @ inverse @ h / len(g)) < 1e-10
                n_cov += 1
    assert n_cov == len(cov)


def test_scores_and_covariances(spark, study, rotation, fit):
    dense, nonzero = genotypes_of(spark, study)
    white = families.whitening(rotation, fit, BY)
    people = families.whitened_samples(white, study["samples"], fit, BY)
    cells = families.whitened_genotypes(nonzero, white, BY)
    scores = families.related_scores(nonzero, white, people, BY, cells=cells).persist()
    told = {r["study"]: r for r in fit.collect()}
    inverse = lambda k: np.linalg.inv(told[k]["s2g"] * study["told"][k]["k"] + told[k]["s2e"] * np.eye(len(study["told"][k]["y"])))
    check_scores(study, dense, scores, families.related_covariance(cells, scores, people, BY, 4000), inverse, lambda k: np.array(told[k]["beta"]), 4000)
    assert scores.count() == 22


def likelihood(t, parts, theta):
    v = sum(a * m for a, m in zip(theta, [*parts, np.eye(len(t["y"]))]))
    inverse = np.linalg.inv(v)
    beta = np.linalg.solve(t["x"].T @ inverse @ t["x"], t["x"].T @ inverse @ t["y"])
    r = t["y"] - t["x"] @ beta
    return -0.5 * (len(r) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ inverse @ r), beta


@pytest.mark.parametrize("three", [False, True])
def test_variance_components(spark, study, three):
    kinships = [study["auto"], study["x"]] if three else [study["auto"]]
    fitted = families.variance_components(study["samples"], kinships, 2, BY).persist()
    got = {r["study"]: r for r in fitted.collect()}
    for k in (0, 1):
        t = study["told"][k]
        parts = [t["k"], t["kx"]] if three else [t["k"]]
        value, beta = likelihood(t, parts, got[k]["variances"])
        want = variance_components(t["y"], t["x"], parts, 2000)
        assert abs(value - got[k]["log_likelihood"]) < 1e-7 and np.allclose(beta, got[k]["beta"], atol=1e-7)
        assert abs(got[k]["log_likelihood"] - want["log_likelihood"]) < 1e-4
        for i in range(len(parts) + 1):  # no neighbour is likelier
            for f in (0.97, 1.03):
                near = list(got[k]["variances"])
                near[i] *= f
                assert likelihood(t, parts, near)[0] <= value + 1e-6
    dense, nonzero = genotypes_of(spark, study, 8)
    white = families.component_whitening(study["samples"], kinships, fitted, BY)
    people = families.whitened_samples(white, study["samples"], fitted, BY)
    cells = families.whitened_genotypes(nonzero, white, BY)
    scores = families.related_scores(nonzero, white, people, BY, cells=cells)
    whole = lambda k: np.linalg.inv(sum(a * m for a, m in zip(got[k]["variances"], [study["told"][k]["k"], *([study["told"][k]["kx"]] if three else []), np.eye(len(study["told"][k]["y"]))])))
    check_scores(study, dense, scores, families.related_covariance(cells, scores, people, BY, 3000), whole, lambda k: np.array(got[k]["beta"]), 3000)


def test_large_blocks_raise(study):
    with pytest.raises(Exception, match="related samples"):
        families.rotations(study["auto"], BY, most=2).count()


@pytest.mark.parametrize("small", [2, 32])
def test_a_carrier_of_a_small_family_is_one_row(spark, study, rotation, fit, monkeypatch, small):
    monkeypatch.setattr(families, "SMALL", small)
    dense, nonzero = genotypes_of(spark, study, 11)
    white = families.whitening(rotation, fit, BY)
    people = families.whitened_samples(white, study["samples"], fit, BY).persist()
    cells = families.whitened_genotypes(nonzero, white, BY)
    if small == 32:
        assert cells.count() == nonzero.count()
    told = {r["study"]: r for r in fit.collect()}
    codings = {"additive": lambda d: d, "recessive": lambda d: F.when(d == 2, 1.0).otherwise(0.0)}
    for r in families.related_scores(nonzero, white, people, BY, codings=codings).collect():
        k, t = r["study"], study["told"][r["study"]]
        g = dense[k][r["pos"] // 1000]
        g = g if r["model"] == "additive" else (g == 2).astype(float)
        inverse = np.linalg.inv(told[k]["s2g"] * t["k"] + told[k]["s2e"] * np.eye(len(t["y"])))
        assert g.any() and abs(r["v"] - (g - g.mean()) @ inverse @ (g - g.mean())) < 1e-8
    scores = families.related_scores(nonzero, white, people, BY, cells=cells)
    inverse = lambda k: np.linalg.inv(told[k]["s2g"] * study["told"][k]["k"] + told[k]["s2e"] * np.eye(len(study["told"][k]["y"])))
    check_scores(study, dense, scores, families.related_covariance(cells, scores, people, BY, 3000), inverse, lambda k: np.array(told[k]["beta"]), 3000)


def test_neighbours_of_a_flat_minimum_are_told_apart(spark):
    rng = np.random.default_rng(4)
    d, y = rng.uniform(0.5, 9, 1500), rng.normal(size=1500)
    rows = spark.createDataFrame([(0, float(a), float(b), [1.0]) for a, b in zip(d, y)], "study int, d double, y double, x array<double>")
    points = [6.5 + 2e-6 * i for i in range(8)]
    got = {r["log_delta"]: r for r in families.profile(rows, 1, BY, spark.createDataFrame([(0, p) for p in points], "study int, log_delta double")).collect()}
    value = [np.longdouble(got[p]["nll"]) + np.longdouble(got[p]["nll_rest"]) for p in points]
    steps = np.diff(np.array(value)).astype(float)
    assert np.allclose(steps, steps.mean(), rtol=1e-2) and steps.all()  # an even slope, which rounding to doubles would make ragged


def test_blocks_reach_the_work_whole(spark):
    from variantloom.operators.bandjoin import by_blocks

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([(b, i) for b in range(40) for i in range(b % 11 + 1)] + [(99, i) for i in range(30)], "b int, i int")
        sizes = lambda pdf: pdf.groupby("b", as_index=False).agg(n=("i", "size"))
        got = sorted(tuple(r) for r in by_blocks(df, ["b"], sizes, "b int, n long").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted([(b, b % 11 + 1) for b in range(40)] + [(99, 30)])
