"""Runs of a study of relatives from files, beside whole matrices: kinship of pedigrees, of genotypes and from a file, the X by itself and as a third component."""

import numpy as np
import pytest
from dense import SpectralModel
from test_families import likelihood, pedigrees

from variantloom.config import OptionError, WorkerOptions
from variantloom.operators import families
from variantloom.plans import programs

MALE = 1


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A PED, DAT and VCF with autosomal and X variants, and what they say as matrices."""
    at = tmp_path_factory.mktemp("study")
    people, sampled = pedigrees(11, 12)
    rng = np.random.default_rng(12)
    names, sex = [s[2] for s in sampled], np.array([s[3] for s in sampled])
    c = rng.normal(size=len(names))
    y = 1 + 0.4 * c + rng.normal(size=len(names))
    trait = {n: (float(y[i]), float(c[i])) for i, n in enumerate(names)}
    ped = [" ".join([p[0], p[1], p[2], p[3], str(p[4]), *(map(repr, trait[p[1]]) if p[1] in trait else ("x", "x"))]) for p in people]
    (at / "ped").write_text("\n".join(ped) + "\n")
    (at / "dat").write_text("T QT\nC AGE\n")
    lines, dense = ["##fileformat=VCFv4.1", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])], {}
    for chrom in ("1", "X"):
        for j in range(30):
            g = rng.binomial(2, 0.3, len(names)).astype(float)
            if chrom == "X":
                g = np.where((sex == MALE) & (g == 1), 2 * rng.integers(0, 2, len(names)), g)
            g[rng.random(len(names)) < 0.02] = np.nan
            pos = 3_000_000 + 1000 * j
            dense[chrom, pos] = g
            calls = ["./." if np.isnan(v) else (f"{int(v) // 2}" if chrom == "X" and sex[i] == MALE else ("0/0", "0/1", "1/1")[int(v)]) for i, v in enumerate(g)]
            lines.append("\t".join([chrom, str(pos), ".", "A", "C", ".", ".", ".", "GT", *calls]))
    (at / "vcf").write_text("\n".join(lines) + "\n")
    x = np.column_stack([np.ones(len(names)), c])
    return {"at": str(at), "ped": f"{at}/ped", "dat": f"{at}/dat", "vcf": f"{at}/vcf", "names": names, "y": y, "x": x, "dense": dense, "people": people}


def filled(g):
    return np.where(np.isnan(g), np.nanmean(g), g)


def empirical(files, chrom):
    total, used = 0, 0
    for (c, _), g in files["dense"].items():
        p = np.nanmean(g) / 2
        if c == chrom and min(p, 1 - p) >= 0.05 and np.isnan(g).mean() <= 0.05:
            z = filled(g) - 2 * p
            total, used = total + np.outer(z, z) / (np.nanvar(g) if c == "X" else 2 * p * (1 - p)), used + 1
    return total / used


def options(files, **more):
    return WorkerOptions(ped=files["ped"], dat=files["dat"], vcf=files["vcf"], trait_name="QT", **more)


def check(files, run, chrom, inverse, beta, tolerance=2e-4):
    """U, V and covariances of a chromosome at a given inverse matrix."""
    r = files["y"] - files["x"] @ beta
    g = {pos: filled(d) - np.nanmean(d) for (c, pos), d in files["dense"].items() if c == chrom}
    rows = run.scores.filter(f"chrom = '{chrom}'").collect()
    assert len(rows) == len(g)
    for row in rows:
        x = g[row["pos"]]
        assert abs(row["u"] - x @ inverse @ r) < tolerance * 20 and abs(row["sqrt_v"] - np.sqrt(x @ inverse @ x)) < tolerance * 5
    cov = {(r["pos"], r["pos2"]): r["cov"] for r in run.covariance.filter(f"chrom = '{chrom}'").collect()}
    assert set(cov) == {(a, b) for a in g for b in g if a <= b}
    assert max(abs(v - g[a] @ inverse @ g[b] / len(r)) for (a, b), v in cov.items()) < tolerance


def pedigree_matrix(spark, files, x_linked):
    from variantloom.operators.kinship import pedigree_kinship

    k = pedigree_kinship(spark.createDataFrame(files["people"], "famid string, pid string, father string, mother string, sex int, zygosity string"), x_linked)
    at = {n: i for i, n in enumerate(files["names"])}
    m = np.zeros((len(at), len(at)))
    for r in k.collect():
        if r["a"] in at and r["b"] in at:
            m[at[r["a"]], at[r["b"]]] = 2 * r["k"]
    return m


def spectral(files, k):
    f = SpectralModel(files["y"], files["x"], k).fit()
    return np.linalg.inv(f["s2g"] * k + f["s2e"] * np.eye(len(k))), f


def test_pedigree_kinship_with_a_model_of_the_x(spark, files):
    run = programs.study_runs(spark, options(files, kin_pedigree=True, separate_x=True))[0]
    for chrom, x_linked in (("1", False), ("X", True)):
        inverse, f = spectral(files, pedigree_matrix(spark, files, x_linked))
        check(files, run, chrom, inverse, f["beta"])
    inverse, f = spectral(files, pedigree_matrix(spark, files, False))
    untold = {p[1] for p in files["people"]} - set(files["names"])
    assert {r["sample"]: r["reason"] for r in run.left_out.collect()} == dict.fromkeys(untold, "no trait")
    scores, _ = programs.write_study(run, f"{files['at']}/written")
    assert spark.read.text(f"{files['at']}/written.QT.left_out.txt").count() == len(untold) + 1 and spark.read.text(scores).filter("value like '##Sigma_g2_Hat%'").count() == 1
    assert abs(run.variances["Sigma_g2_Hat"] - f["s2g"]) < 1e-3 and np.allclose(run.beta, f["beta"], atol=1e-4)


def test_kinship_of_genotypes_with_three_components(spark, files):
    o = options(files, kin_geno=True, vc_x=True, kin_save=True, prefix=f"{files['at']}/out")
    run = programs.study_runs(spark, o)[0]
    auto, x = empirical(files, "1"), empirical(files, "X")
    inverse, f = spectral(files, auto)
    check(files, run, "1", inverse, f["beta"])
    # the fitted shares lead back to the X's matrix up to a factor, which its scores' own ratio doesn't have
    own = spark.createDataFrame([(0, "all", n, float(files["y"][i]), [float(v) for v in files["x"][i]]) for i, n in enumerate(files["names"])], "study int, famid string, sample string, y double, xs array<double>")
    pairs = lambda m: spark.createDataFrame([(0, "all", a, b, float(m[i, j] / 2)) for i, a in enumerate(files["names"]) for j, b in enumerate(files["names"])], "study int, famid string, a string, b string, k double")
    fit = families.variance_components(own, [pairs(auto), pairs(x)], 2, ["study"]).first()
    v = sum(t * m for t, m in zip(fit["variances"], [auto, x, np.eye(len(auto))]))
    check(files, run, "X", np.linalg.inv(v), np.array(fit["beta"]))
    value, _ = likelihood({"y": files["y"], "x": files["x"]}, [auto, x], fit["variances"])
    assert abs(value - fit["log_likelihood"]) < 1e-6
    # the saved matrices as input give the same run
    again = programs.study_runs(spark, options(files, kin_file=f"{files['at']}/out.Empirical.Kinship", kinx_file=f"{files['at']}/out.Empirical.KinshipX", vc_x=True))[0]
    check(files, again, "1", inverse, f["beta"], 2e-3)
    assert programs.study_runs(spark, options(files, kin_geno=True, kin_only=True, prefix=f"{files['at']}/only")) == []


def test_blocks_of_relatives(spark, files):
    s = spark.createDataFrame([(c,) for c in "abcdefgh"], "sample string")
    pairs = spark.createDataFrame([("h", "g"), ("g", "f"), ("f", "e"), ("e", "a"), ("c", "d"), ("b", "b")], "a string, b string")
    assert {r["sample"]: r["famid"] for r in families.relative_blocks(s, pairs).collect()} == {"a": "a", "e": "a", "f": "a", "g": "a", "h": "a", "b": "b", "c": "c", "d": "c"}
    run = programs.study_runs(spark, options(files, kin_geno=True, kin_least=0.2))[0]
    assert run.samples == len(files["names"]) and run.scores.filter("sqrt_v > 0").count() == 60


def test_options_that_make_no_sense_raise(files):
    for wrong in (dict(vc_x=True), dict(kin_file="a", vc_x=True), dict(kinx_file="a", kin_geno=True), dict(kin_save=True, kin_pedigree=True), dict(kin_only=True), dict(zip=True), dict(cpu=4), dict(label_hits=True), dict(recessive=True, dominant=True), dict(kin_pedigree=True, kin_geno=True)):
        with pytest.raises(OptionError):
            options(files, **wrong).checked()
