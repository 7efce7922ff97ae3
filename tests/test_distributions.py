import math

import numpy as np

from variantloom.functions import distributions as d


def test_chi_square_tails():
    assert abs(d.chi2_tail_1([3.841458820694124])[0] - 0.05) < 1e-12
    assert abs(d.chi2_tail(7.814727903251179, 3) - 0.05) < 1e-9
    assert abs(d.chi2_quantile_1_upper([0.05])[0] - 3.841458820694124) < 1e-9
    p, under = d.chi2_tail_1_reported([1e5, 10.0, np.nan])
    assert p[0] > 0 and list(under) == [True, False, False] and math.isnan(p[2])


def test_mixtures_match_their_special_cases():
    assert abs(d.chi2_mixture_tail(10.0, [1, 1, 1]) - d.chi2_tail(10, 3)) < 1e-5
    assert abs(d.liu_tail(10.0, [1, 1, 1]) - d.chi2_tail(10, 3)) < 1e-8
    assert abs(d.chi2_mixture_tail(2845.942, [4047.36, 8477.47]) - 0.785915) < 1e-4
    assert abs(d.liu_tail(2845.942, [4047.36, 8477.47]) - 0.789691) < 1e-5


def test_hardy_weinberg_sums_to_one_and_matches_enumeration():
    def brute(h, a, b):
        n, rare = h + a + b, 2 * min(a, b) + h
        w = {x: 2**x * math.factorial(n) / (math.factorial((rare - x) // 2) * math.factorial(x) * math.factorial(n - x - (rare - x) // 2)) for x in range(rare % 2, rare + 1, 2)}
        return sum(v for v in w.values() if v <= w[h] * (1 + 1e-9)) / sum(w.values())

    for h, a, b in ((57, 14, 50), (4, 0, 1), (0, 3, 7), (1, 0, 0)):
        assert abs(d.hwe_exact([h], [a], [b])[0] - brute(h, a, b)) < 1e-9
    assert math.isnan(d.hwe_exact([0], [0], [0])[0])


def test_beta_and_normal_box():
    assert abs(d.beta_cdf(d.beta_quantile(0.3, 2, 5), 2, 5) - 0.3) < 1e-9
    one = 1 - d.chi2_tail_1([1.0])[0]
    assert abs(d.mvn_box(np.array([1.0, 1.0]), np.eye(2)) - one**2) < 1e-3
    assert np.linalg.eigvalsh(d.nearest_correlation(np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]]))).min() > -1e-9


def test_sql_functions(spark):
    d.register(spark)
    row = spark.sql("SELECT chi2_p(3.841458820694124D) AS p, normal_quantile(0.975D) AS q, hwe_exact(57, 14, 50) AS h, mixture_p(10D, array(1D, 1D, 1D)) AS m").first()
    assert abs(row["p"] - 0.05) < 1e-9 and abs(row["q"] - 1.959964) < 1e-5 and abs(row["h"] - 0.842) < 1e-2 and abs(row["m"] - d.chi2_tail(10, 3)) < 1e-5


def test_tabulated_normal():
    x = np.concatenate([np.linspace(-9, 9, 4001), [-40.0, 40.0]])
    want = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.abs(d.normal_cdf(x) - want).max() < 1e-11
    p = np.concatenate([np.logspace(-15, -0.4, 300), 1 - np.logspace(-11, -0.4, 300)])
    assert np.abs(d.normal_quantile_fast(p) - d.normal_quantile(p)).max() < 1e-4
    inner = (p > 1e-9) & (p < 1 - 1e-9)
    assert np.abs(d.normal_quantile_fast(p) - d.normal_quantile(p))[inner].max() < 1e-6


def test_deep_tails_of_mixtures():
    """Against chi-squares of 2, 3 and 4 degrees of freedom, a difference of exponentials, and a product rule, to ten digits and down to 1e-300."""
    for q in (5.0, 30.0, 120.0, 600.0, 1300.0):
        e = math.exp(-q / 2)
        assert abs(d.chi2_mixture_tail(q, [1, 1]) / e - 1) < 1e-10
        assert abs(d.chi2_mixture_tail(q, [1, 1, 1, 1]) / (e * (1 + q / 2)) - 1) < 1e-10
        assert abs(d.chi2_mixture_tail(q, [1, 1, 1]) / (math.erfc(math.sqrt(q / 2)) + math.sqrt(2 * q / math.pi) * e) - 1) < 1e-10
        # two exponentials of means 2a and 2b
        a, b = 1.0, 0.4
        want = (a * math.exp(-q / (2 * a)) - b * math.exp(-q / (2 * b))) / (a - b)
        assert abs(d.chi2_mixture_tail(q, [a, a, b, b]) / want - 1) < 1e-10
    # far out the largest weight rules: P ~ prod (1 - w / w1)^-1/2 P(w1 chi2 > q)
    w = np.array([3.0, 1.0, 0.5, 0.1])
    limit = np.prod(1 / np.sqrt(1 - w[1:] / w[0])) * math.erfc(math.sqrt(1500 / 3 / 2))
    assert abs(d.chi2_mixture_tail(1500.0, w) / limit - 1) < 3e-3
    # one formula takes over from the other at the mean
    for w in ([1, 1], [2, 1, 0.3, 0.2, 0.01], np.linspace(0.01, 1, 60)):
        m = float(np.sum(w))
        assert abs(d.chi2_mixture_tail(m * (1 - 1e-9), w) - d.chi2_mixture_tail(m * (1 + 1e-9), w)) < 1e-5


def test_unions_of_normals_at_any_depth():
    for t, n in ((2.0, 5), (4.5, 12), (6.5, 40), (12.0, 3)):
        one = math.erfc(t / math.sqrt(2))
        p, error = d.mvn_any(t, np.eye(n))  # independent ones
        want = -math.expm1(n * math.log1p(-one))
        assert abs(p - want) <= max(error, 1e-12 * want) and error < 0.01 * p
        p, error = d.mvn_any(t, np.ones((n, n)))  # one and the same
        assert abs(p / one - 1) < 0.01
    # two of correlation 0.6, by integration over the first
    rho = 0.6
    for t, digits in ((3.5, 1e-4), (5.8, 1e-8)):
        z = np.linspace(t, t + 14, 200_001)
        f = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        s = math.sqrt(1 - rho * rho)
        inside = np.array([0.5 * (math.erfc((-t - rho * v) / s / math.sqrt(2)) - math.erfc((t - rho * v) / s / math.sqrt(2))) for v in z[::100]])
        both = 2 * math.erfc(t / math.sqrt(2)) - 2 * np.trapezoid(f * (1 - np.interp(z, z[::100], inside)), z)
        p, error = d.mvn_any(t, np.array([[1, rho], [rho, 1]]))
        assert abs(p - both) <= 1.5 * error and error < 5e-3 * p and p < 10 * digits
    value, error = d.mvn_box_error(np.full(30, 2.5), 0.5 * np.eye(30) + 0.5)
    z = np.linspace(-8, 8, 4001)
    inner = np.array([0.5 * (math.erfc((-2.5 - v * math.sqrt(0.5)) / math.sqrt(0.5) / math.sqrt(2)) - math.erfc((2.5 - v * math.sqrt(0.5)) / math.sqrt(0.5) / math.sqrt(2))) for v in z])
    want = np.trapezoid(np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * inner**30, z)
    assert abs(value - want) <= error + 1e-6 and error < 1e-3


def test_threshold_test_far_out():
    from variantloom.operators import genes

    af, u = np.linspace(0.001, 0.05, 30), np.zeros(30)
    for t in (5.0, 6.5):
        u[0] = t
        effect, cutoff, p, number, error = genes.vt_test(af, u, np.eye(30))
        one = math.erfc(t / math.sqrt(2))
        assert one < p < 30 * one and error < 0.01 * p and (cutoff, number) == (af[0], 1)


def test_more_sql_functions(spark):
    d.register(spark)
    row = spark.sql("""SELECT normal_cdf(1.96D) AS n, sigmoid(0D) AS s, chi2_df_p(10D, 3D) AS c, noncentral_chi2_p(10D, 3D, 0D) AS nc, beta_cdf(0.3D, 2D, 5D) AS b, beta_upto(0.579825D, 2D, 5D) AS bq, beta_pdf(0.5D, 2D, 2D) AS bp,
      box_p(array(1D), array(1D)) AS box, any_p(3D, array(1D, 0D, 0D, 1D)) AS u, odds_ratio(0.1D, 0.5D) AS o, chi2_df_p(CAST(NULL AS DOUBLE), 3D) AS none""").first()
    assert abs(row["n"] - 0.9750021) < 1e-6 and row["s"] == 0.5 and abs(row["c"] - d.chi2_tail(10, 3)) < 1e-12 and abs(row["nc"] - row["c"]) < 1e-9
    assert abs(row["b"] - 0.579825) < 1e-6 and abs(row["bq"] - 0.3) < 1e-5 and abs(row["bp"] - 1.5) < 1e-12 and abs(row["o"] - math.exp(0.4)) < 1e-12
    one = math.erfc(3 / math.sqrt(2))
    assert abs(row["box"] - 0.6826895) < 1e-3 and abs(row["u"] - (2 * one - one * one)) < 1e-5 and row["none"] is None


def test_box_beside_its_chain():
    """A chain's box is known; boxes near one have a small error, boxes far from one a true one; equal normals, unlike limits."""
    rng = np.random.default_rng(4)
    steps = rng.random(40)
    var = np.cumsum(steps)
    r = np.sqrt(np.minimum.outer(var, var) / np.maximum.outer(var, var))
    known = d.chain_box(np.full(40, 2.0), d.chain_links(np.full(40, 2.0), r))
    walk = np.abs((rng.normal(size=(200_000, 40)) * np.sqrt(steps)).cumsum(axis=1) / np.sqrt(var)).max(axis=1)
    assert abs((walk <= 2.0).mean() - known) < 5e-3
    value, error = d.mvn_box_error(np.full(40, 2.0), r)
    assert abs(value - known) < 1e-3 and error < 1e-3
    noise = rng.normal(size=(400, 40)) * 0.03
    near = r + noise.T @ noise / 40
    near /= np.sqrt(np.outer(np.diag(near), np.diag(near)))
    few, many = (d.mvn_box_error(np.full(40, 2.0), near, accuracy=0, relative=0, most=m, seed=s) for m, s in ((5000, 1), (80_000, 2)))
    assert abs(few[0] - many[0]) < few[1] + many[1] and many[1] < few[1] < 3e-3
    unlike = np.array([1.0, 2.0, 1.5])
    assert abs(d.mvn_box(unlike, np.eye(3)) - math.prod(1 - float(d.chi2_tail_1(x * x)[0]) for x in unlike)) < 1e-9
    assert abs(d.mvn_box(unlike, np.ones((3, 3))) - (1 - float(d.chi2_tail_1(1.0)[0]))) < 1e-9
    turned = np.array([[1.0, -1.0], [-1.0, 1.0]])
    assert abs(d.mvn_box(unlike[:2], turned) - (1 - float(d.chi2_tail_1(1.0)[0]))) < 1e-9
