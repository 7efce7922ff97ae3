import numpy as np
import pytest

from dense import SpectralModel, variance_components
from variantloom.operators import annotate, bandjoin, conditional, genes, kinship, nullmodels


def test_band_join_against_brute_force(spark):
    points = [("1", p) for p in (1, 5, 100, 101, 205, 999)] + [("2", 5)]
    got = {(r["chrom"], r["pos"], r["pos2"]) for r in bandjoin.band_pairs(spark.createDataFrame(points, "chrom string, pos int"), ["chrom"], "pos", 100).collect()}
    assert got == {(c, p, q) for c, p in points for d, q in points if c == d and 0 <= q - p <= 100}


def test_published_gene_values():
    af, u = np.array([0.00391007, 0.0244379]), np.array([1.989769, -2.043162])
    c = np.array([[7.816995, 0.18102], [0.18102, 44.474682]])
    q, davies, liu, _ = genes.skat_tails(u, (25 * (1 - af) ** 24) ** 2, c)
    assert abs(q / 2845.94 - 1) < 1e-5 and abs(davies - 0.78592) < 1e-4 and abs(liu - 0.78969) < 1e-5
    assert abs(genes.vt_test(af, u, c)[2] - 0.709689) < 1e-3


def test_threshold_test_takes_every_cutoff():
    """Independent variants of one variance: the sums up to each cutoff are a random walk, which is easily drawn."""
    for n, t in ((30, 2.3), (120, 2.5)):
        af, u = np.linspace(0.001, 0.05, n), np.zeros(n)
        u[0] = t
        effect, cutoff, p, number, error = genes.vt_test(af, u, np.eye(n))
        walk = np.random.default_rng(3).normal(size=(100_000, n)).cumsum(axis=1) / np.sqrt(np.arange(1, n + 1))
        assert (cutoff, number) == (af[0], 1) and abs(effect - t) < 1e-12
        assert abs(p - (np.abs(walk).max(axis=1) >= t).mean()) < 0.01 and error < 0.005


def test_one_variant_burden_is_the_single_variant_test(spark):
    kept = spark.createDataFrame([("G", 0, "1", 5, "A", "C", 0.0151515, 5.937421, 26.998342, 0.2, 1.3, 1.0)], "gene string, ord int, chrom string, pos int, ref string, alt string, af double, u double, v double, effect double, chisq double, sign double")
    cov = spark.createDataFrame([("G", 0, 0, 26.998342)], "gene string, i int, j int, cov double")
    b = genes.burden_p(genes.burden(kept, cov)).first()
    assert abs(b["p"] - 0.253166) < 1e-6
    assert abs(genes.burden(kept, cov, "MB").first()["effect"] - 0.0268642) < 1e-6
    s = genes.skat_vt(genes.gene_matrices(kept, cov)).first()
    assert abs(s["q"] - 10587.86) < 0.1 and abs(s["vt_p"] - 0.253166) < 1e-6


def test_conditional_against_matrices(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (60, 3)).astype(float)
    x -= x.mean(axis=0)
    y = rng.normal(size=60)
    u, c = x.T @ y, x.T @ x
    scores = spark.createDataFrame([(0, "1", 10 * (i + 1), "A", "C", float(u[i]), float(np.sqrt(c[i, i]))) for i in range(3)], "study int, chrom string, pos int, ref string, alt string, u double, sqrt_v double")
    cov = spark.createDataFrame([(0, "1", 10 * (i + 1), 10 * (j + 1), float(c[i, j] / 60)) for i in range(3) for j in range(i, 3)], "study int, chrom string, pos int, pos2 int, cov double")
    cond = spark.createDataFrame([("1", 20, "C", "A")], "chrom string, pos int, ref string, alt string")
    m = conditional.condition_markers(cond, scores, cov)
    out = {r["pos"]: r for r in conditional.conditional_scores(scores, cov, m, conditional.condition_models(m, cov, {0: 60}), {0: 60}).collect()}
    for i in (0, 2):
        assert abs(out[10 * (i + 1)]["u_cond"] - (u[i] - c[i, 1] * u[1] / c[1, 1])) < 1e-9
        assert abs(out[10 * (i + 1)]["v_cond"] - (c[i, i] - c[i, 1] ** 2 / c[1, 1])) < 1e-9


def test_pedigree_kinship(spark):
    rows = [("F", "f", "0", "0", 1, None), ("F", "m", "0", "0", 2, None), ("F", "s", "f", "m", 1, "MZ"), ("F", "t", "f", "m", 1, "MZ"), ("F", "d", "f", "m", 2, None)]
    df = spark.createDataFrame(rows, "famid string, pid string, father string, mother string, sex int, zygosity string")
    k = {(r["a"], r["b"]): r["k"] for r in kinship.pedigree_kinship(df).collect()}
    assert (k["f", "m"], k["f", "s"], k["s", "d"], k["s", "t"], k["d", "d"]) == (0, 0.25, 0.25, 0.5, 0.5)
    x = {(r["a"], r["b"]): r["k"] for r in kinship.pedigree_kinship(df, True).collect()}
    assert (x["f", "f"], x["f", "s"], x["f", "d"], x["m", "s"]) == (1, 0, 0.5, 0.5)
    f = kinship.family_rotation(kinship.pedigree_kinship(df).filter("a <> 't' and b <> 't'")).first()
    assert abs(sum(f["values"]) - 4) < 1e-9


def test_kinship_from_carriers_matches_the_dense_product(spark):
    rng = np.random.default_rng(1)
    g = rng.binomial(2, 0.3, (8, 20)).astype(float)
    p = g.mean(axis=0) / 2
    rows = [("1", j, f"s{i}", float(g[i, j])) for i in range(8) for j in range(20) if g[i, j]]
    markers = spark.createDataFrame([("1", j, float(p[j])) for j in range(20)], "chrom string, pos int, af double")
    k = kinship.grm(spark.createDataFrame(rows, "chrom string, pos int, sample string, dose double"), markers, spark.createDataFrame([(f"s{i}",) for i in range(8)], "sample string"))
    z = (g - 2 * p) / np.sqrt(2 * p * (1 - p))
    dense = z @ z.T / 20
    for r in k.collect():
        assert abs(r["k"] - dense[int(r["a"][1:]), int(r["b"][1:])]) < 1e-9


def test_kinship_has_every_pair_of_samples(spark):
    """Rare carriers, most pairs without a common one, and a sample that carries nothing."""
    g = np.zeros((7, 6))
    for i, j, dose in ((0, 0, 1), (1, 0, 2), (1, 1, 1), (2, 2, 1), (3, 3, 1), (3, 4, 1), (4, 4, 1), (5, 5, 2)):
        g[i, j] = dose
    p = g.mean(axis=0) / 2
    rows = [("1", j, f"s{i}", float(g[i, j])) for i in range(7) for j in range(6) if g[i, j]]
    markers = spark.createDataFrame([("1", j, float(p[j])) for j in range(6)], "chrom string, pos int, af double")
    got = {(r["a"], r["b"]): r["k"] for r in kinship.grm(spark.createDataFrame(rows, "chrom string, pos int, sample string, dose double"), markers, spark.createDataFrame([(f"s{i}",) for i in range(7)], "sample string")).collect()}
    z = (g - 2 * p) / np.sqrt(2 * p * (1 - p))
    dense = z @ z.T / 6
    assert sorted(got) == [(f"s{i}", f"s{j}") for i in range(7) for j in range(i, 7)]
    assert all(abs(k - dense[int(a[1:]), int(b[1:])]) < 1e-9 for (a, b), k in got.items())


def test_mixed_models_and_logistic(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(80, 200))
    k = a @ a.T / 200
    y = np.linalg.cholesky(k + 1e-6 * np.eye(80)) @ rng.normal(size=80) + rng.normal(size=80)
    x = np.ones((80, 1))
    m = SpectralModel(y, x, k).fit()
    v = variance_components(y, x, [k])
    assert abs(m["log_likelihood"] - v["log_likelihood"]) < 1e-3
    df = spark.createDataFrame([(float(i < 30),) for i in range(100)], "y double")
    from pyspark.sql import functions as F

    beta, _ = nullmodels.logistic(df, F.col("y"), [F.lit(1.0)], rate=0.02, steps=300)
    assert abs(beta[0] - np.log(0.3 / 0.7)) < 1e-2


def test_logistic_fit_does_not_depend_on_the_number_of_rows(spark):
    from pyspark.sql import functions as F

    from variantloom.plans import queries
    from variantloom.plans.adapter import Cohort

    sf_dir = "/root/testdata/sf0.001"
    share = Cohort(spark, sf_dir).samples.agg(F.avg(F.col("is_case").cast("int"))).first()[0]
    assert abs(queries.logistic_null_model(spark, sf_dir).first()["intercept"] - np.log(share / (1 - share))) < 1e-6
    for n in (150, 150_000):
        df = spark.range(n).select((F.col("id") % 5 == 0).cast("double").alias("y"))
        assert abs(nullmodels.logistic(df, F.col("y"), [F.lit(1.0)])[0][0] - np.log(0.25)) < 1e-6
    two = spark.range(1000).select((F.col("id") % 10).alias("r"), (F.col("id") % 2).alias("x")).select("x", F.when(F.col("x") == 1, F.col("r") < 3).otherwise(F.col("r") < 7).cast("double").alias("y"))
    beta = nullmodels.logistic(two, F.col("y"), [F.lit(1.0), 1000 * F.col("x")])[0]  # odd r: 1 of 5; even r: 4 of 5
    assert abs(beta[0] - np.log(4)) < 1e-6 and abs(1000 * beta[1] + 2 * np.log(4)) < 1e-6
    with pytest.raises(ValueError, match="separate"):
        nullmodels.logistic(spark.range(50).select(F.lit(1.0).alias("y")), F.col("y"), [F.lit(1.0)])
    with pytest.raises(ValueError, match="converge"):
        nullmodels.logistic(df, F.col("y"), [F.lit(1.0)], steps=1)


def test_loci_move_with_their_best(spark):
    rows = [("1", 0, "A", "C", 0.01), ("1", 900_000, "A", "C", 0.001), ("1", 1_800_000, "A", "C", 0.01), ("1", 3_000_000, "A", "C", 0.01)]
    got = annotate.loci(spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string, p double")).orderBy("locus").collect()
    assert [(r["locus"], r["pos"]) for r in got] == [(0, 900_000), (1, 3_000_000)]


def test_inverse_normal_ties(spark):
    r = nullmodels.inverse_normal(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None)], "g string, y double"), "y", ["g"]).collect()
    assert sorted(x["rank_q"] for x in r if x["rank_q"]) == [0.5 / 3, 2 / 3, 2 / 3]


def test_kinship_of_many_blocks(spark):
    """Blocks of three samples, and several blocks of markers."""
    rng = np.random.default_rng(7)
    g = rng.binomial(2, 0.2, (11, 30)).astype(float)
    p = g.mean(axis=0) / 2
    rows = [("1", j, f"s{i}", float(g[i, j])) for i in range(11) for j in range(30) if g[i, j]]
    markers = spark.createDataFrame([("1", j, float(p[j])) for j in range(30)], "chrom string, pos int, af double")
    people = spark.createDataFrame([(f"s{i}",) for i in range(11)], "sample string")
    z = (g - 2 * p) / np.sqrt(2 * p * (1 - p))
    dense, both = z @ z.T / 30, (g > 0).astype(int) @ (g > 0).T.astype(int)
    from variantloom.operators import tiles

    for columns in (tiles.COLUMNS, 7):
        tiles.COLUMNS, before = columns, tiles.COLUMNS
        got = kinship.grm(spark.createDataFrame(rows, "chrom string, pos int, sample string, dose double"), markers, people, common=True, block=3).collect()
        tiles.COLUMNS = before
        assert sorted((r["a"], r["b"]) for r in got) == sorted((a, b) for a in (f"s{i}" for i in range(11)) for b in (f"s{i}" for i in range(11)) if a <= b)
        for r in got:
            i, j = int(r["a"][1:]), int(r["b"][1:])
            assert abs(r["k"] - dense[i, j]) < 1e-9 and r["common"] == both[i, j]
    assert kinship.grm(spark.createDataFrame(rows, "chrom string, pos int, sample string, dose double"), markers.limit(0), people).count() == 0


def test_band_products_against_brute_force(spark):
    from variantloom.operators import tiles

    rng = np.random.default_rng(5)
    cells = {(g, int(p), int(s)): float(rng.integers(-2, 3)) or 1.0 for g in "ab" for p in rng.integers(-50, 400, 40) for s in rng.integers(0, 25, 6)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "g string, pos int, sample int, x double")
    want = {}
    for (g, p, s), v in cells.items():
        for (h, q, t), w in cells.items():
            if g == h and s == t and 0 <= q - p <= 60:
                want[g, p, q] = want.get((g, p, q), 0.0) + v * w
    for columns, chunk in ((tiles.COLUMNS, tiles.CHUNK), (5, 3)):
        before = tiles.COLUMNS, tiles.CHUNK
        tiles.COLUMNS, tiles.CHUNK = columns, chunk
        got = {(r["g"], r["pos"], r["pos2"]): r["product"] for r in tiles.band_products(df, ["g"], "pos", "sample", "x", 60, 25).collect()}
        tiles.COLUMNS, tiles.CHUNK = before
        assert got == want


def test_tiles_of_labelled_rows(spark):
    """Products within labels alone: a place under two labels, no label in common, no rows."""
    from pyspark.sql import functions as F

    from variantloom.operators import genotypes, tiles

    rng = np.random.default_rng(6)
    cells = {(str(rng.choice(list("xyz"))), int(p), int(s)): float(rng.integers(1, 3)) for p in rng.integers(0, 300, 60) for s in rng.integers(0, 20, 6)}
    df = spark.createDataFrame([("a", *k, v) for k, v in cells.items()], "g string, gene string, pos int, sample int, x double")
    want = {}
    for (a, p, s), v in cells.items():
        for (b, q, t), w in cells.items():
            if a == b and s == t and 0 <= q - p <= 60:
                want[a, p, q] = want.get((a, p, q), 0.0) + v * w
    for columns, chunk in ((tiles.COLUMNS, tiles.CHUNK), (5, 3)):
        before = tiles.COLUMNS, tiles.CHUNK
        tiles.COLUMNS, tiles.CHUNK = columns, chunk
        got = {(r["gene"], r["pos"], r["pos2"]): r["product"] for r in tiles.band_products(df, ["g"], "pos", "sample", "x", 60, 20, "gene").collect()}
        tiles.COLUMNS, tiles.CHUNK = before
        assert got == want
    assert tiles.band_products(df.filter("false"), ["g"], "pos", "sample", "x", 60, 20, "gene").count() == 0

    # covariances within genes are those of all variants that lie in one gene
    nonzero = df.groupBy(F.lit(1).alias("study"), F.lit("7").alias("chrom"), "pos", "sample").agg(F.max("x").alias("dose"))
    groups = spark.createDataFrame([(1, 20, 1.5)], "study int, n long, sigma2 double")
    genes = df.select("gene", F.lit("7").alias("chrom"), "pos").distinct()
    every = {(r["pos"], r["pos2"]): r["cov"] for r in genotypes.ld_covariance(nonzero, groups, ["study"], 60).collect()}
    of = {}
    for r in genes.collect():
        of.setdefault(r["gene"], set()).add(r["pos"])
    own = {(r["gene"], r["pos"], r["pos2"]): r["cov"] for r in genotypes.ld_covariance(nonzero, groups, ["study"], 60, genes).collect()}
    assert set(own) == {(g, p, q) for g, at in of.items() for p in at for q in at if 0 <= q - p <= 60}
    assert all(abs(v - every[k[1:]]) < 1e-12 for k, v in own.items())
