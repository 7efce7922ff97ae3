"""Gene-level tests over pooled statistics and pooled covariances.

The burden family is two sums per gene, weights times U and weights times covariance, so it
stays in DataFrame aggregates; only VT and SKAT tails cross into Python, one gene at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import beta_density, chi2_mixture_tail, chi2_tail_1, chi2_tail_1_reported, liu_tail, mvn_any, mvn_box_error

METHODS = ("burden", "MB", "MAB", "BBeta")
SHRINK, SHRINK_STEPS = 0.9999, 10_000


def gene_variants(groups: DataFrame, pooled: DataFrame, most_maf: float = 0.05) -> DataFrame:
    """gene, ord, chrom, pos, ref, alt, af, u, v, effect, chisq, sign: pooled statistics of the genes' variants.

    A variant meets its statistics by alleles either way round; if they are swapped, or the
    frequency is above 1/2, U, effect and AF turn and ``sign`` tells the covariance join.
    Variants without variation, or with a folded frequency above ``most_maf``, fall out. The
    sign belongs to the gene's own row, so a variant in two genes turns once in each.
    """
    s = pooled.select("chrom", "pos", F.col("ref").alias("s_ref"), F.col("alt").alias("s_alt"), "af", "u", "v")
    j = groups.join(s, ["chrom", "pos"])
    same = (F.col("ref") == F.col("s_ref")) & (F.col("alt") == F.col("s_alt"))
    swapped = (F.col("ref") == F.col("s_alt")) & (F.col("alt") == F.col("s_ref"))
    j = j.filter(same | swapped).withColumn("sign", F.when(swapped, -1.0).otherwise(1.0))
    j = j.withColumn("af", F.when(F.col("sign") < 0, 1 - F.col("af")).otherwise(F.col("af"))).withColumn("fold", F.col("af") > 0.5)
    j = j.withColumn("sign", F.when(F.col("fold"), -F.col("sign")).otherwise(F.col("sign"))).withColumn("af", F.when(F.col("fold"), 1 - F.col("af")).otherwise(F.col("af")))
    j = j.filter((F.col("af") > 0) & (F.col("af") <= most_maf) & (F.col("v") > 0))
    ref, alt = F.when(F.col("fold"), F.col("alt")).otherwise(F.col("ref")), F.when(F.col("fold"), F.col("ref")).otherwise(F.col("alt"))
    u = F.col("sign") * F.col("u")
    return j.select("gene", "ord", "chrom", "pos", ref.alias("ref"), alt.alias("alt"), "af", u.alias("u"), "v", (u / F.col("v")).alias("effect"), (u * u / F.col("v")).alias("chisq"), "sign")


def missing_variants(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """The genes' variants that no test uses."""
    return groups.join(kept.select("gene", "ord"), ["gene", "ord"], "left_anti")


def gene_covariance(kept: DataFrame, cov: DataFrame, decisions: DataFrame | None = None, sizes: dict[int, int] | None = None, region: tuple[str, int, int] | None = None, exact: dict | None = None) -> DataFrame:
    """gene, i, j (ord, i <= j), cov: studies' covariances summed over each gene's variant pairs.

    ``cov``: study, chrom, pos, pos2, cov (per sample); the study's size multiplies it. If it
    has a column gene, its rows count for that gene alone.
    ``decisions``: study, chrom, pos, sign of records that entered; a pair counts for a study
    only if both did, and signs multiply. The rows there are find their genes, which are cut to
    pairs of one gene first; a gene's pairs, most of which have no row, are never made.
    ``region`` bounds the rows read. ``exact`` (af: study, chrom, pos, n, af of every record;
    pooled: pooling.exact's result; variance by study) adjusts each pair as pooling.exact does the variances: r sum over the studies that
    have both of C sigma2 + 4 n f g - 4 n F G, with F and G the pooled frequencies and r and n
    those of the first variant.
    """
    c = cov
    if region:
        c = c.filter((F.col("chrom") == region[0]) & F.col("pos").between(region[1], region[2]))
    own = ["gene"] if "gene" in c.columns else []
    one = kept.select("gene", "chrom", "pos", F.col("ord").alias("i"), F.col("sign").alias("sign_i"))
    two = kept.select("gene", "chrom", F.col("pos").alias("pos2"), F.col("ord").alias("j"), F.col("sign").alias("sign_j"))
    c = c.join(one, [*own, "chrom", "pos"]).join(two, ["gene", "chrom", "pos2"]).filter("i <= j and pos <= pos2")
    if sizes:
        n = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("study")]
        c = c.withColumn("cov", F.col("cov") * n)
    if decisions is not None:
        a = decisions.select("study", "chrom", "pos", F.col("sign").alias("sign_a"))
        b = decisions.select("study", "chrom", F.col("pos").alias("pos2"), F.col("sign").alias("sign_b"))
        c = c.join(a, ["study", "chrom", "pos"]).join(b, ["study", "chrom", "pos2"]).withColumn("cov", F.col("cov") * F.col("sign_a") * F.col("sign_b"))
    if exact:
        c = _exact_adjusted(c, exact, decisions)
    return c.groupBy("gene", "i", "j").agg(F.sum(F.col("cov") * F.col("sign_i") * F.col("sign_j")).alias("cov"))


def _exact_adjusted(c: DataFrame, exact: dict, decisions: DataFrame | None) -> DataFrame:
    """Studies' covariances (study, chrom, pos, pos2, cov) with their share of the adjustment; frequencies turn with a record's sign."""
    f = exact["af"]
    if decisions is not None:
        f = f.join(decisions, ["study", "chrom", "pos"], "left").withColumn("af", F.when(F.col("sign") < 0, 1 - F.col("af")).otherwise(F.col("af"))).drop("sign")
    m = exact["pooled"].select("chrom", "pos", F.col("af").alias("mean"), "scale")
    first = f.select("study", "chrom", "pos", "n", "af")
    second = f.select("study", "chrom", F.col("pos").alias("pos2"), F.col("af").alias("af2"))
    j = c.join(first, ["study", "chrom", "pos"]).join(second, ["study", "chrom", "pos2"]).join(m, ["chrom", "pos"]).join(m.select("chrom", F.col("pos").alias("pos2"), F.col("mean").alias("mean2")), ["chrom", "pos2"])
    sigma2 = F.get(F.array(*[F.lit(float(v)) for v in exact["variance"]]), F.col("study"))
    own = F.col("cov") * sigma2 + 4 * F.col("n") * (F.col("af") * F.col("af2") - F.col("mean") * F.col("mean2"))
    return j.withColumn("cov", F.col("scale") * own)


def weight(method: str, af: Column | str = "af") -> Column:
    """burden 1, MB sqrt(f(1-f)), MAB f, BBeta the squared Beta(1, 25) density. Burden tests divide by it, SKAT multiplies."""
    f = F.col(af) if isinstance(af, str) else af
    if method == "burden":
        return F.lit(1.0)
    if method == "MB":
        return F.sqrt(f * (1 - f))
    if method == "MAB":
        return f
    return F.pow(beta_density(f, 1.0, 25.0), F.lit(2.0))


def gene_summary(kept: DataFrame) -> DataFrame:
    """gene, num_var, vars, mafs, effects, avg_af, min_af, max_af."""
    name = F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt")
    x = F.array_sort(F.collect_list(F.struct("ord", name.alias("name"), "af", "effect", "chisq")))
    g = kept.groupBy("gene").agg(F.count(F.lit(1)).alias("num_var"), x.alias("x"), F.avg("af").alias("avg_af"), F.min("af").alias("min_af"), F.max("af").alias("max_af"))
    part = lambda f: F.transform("x", lambda v: v[f])
    return g.select("gene", "num_var", F.array_join(part("name"), ";").alias("vars"), part("af").alias("mafs"), part("effect").alias("effects"), part("chisq").alias("chisqs"), "avg_af", "min_af", "max_af")


def burden(kept: DataFrame, cov: DataFrame, method: str = "burden") -> DataFrame:
    """gene, num_var, wu, wvw, effect, chisq of (w'U)^2 / w'Cw; genes with w'Cw of 0 have null statistics.

    ``cov`` holds the upper triangle with its diagonal.
    """
    w = (1 / weight(method)).alias("w")
    v = kept.select("gene", "ord", "u", w)
    top = v.groupBy("gene").agg(F.count(F.lit(1)).alias("num_var"), F.sum(F.col("w") * F.col("u")).alias("wu"))
    i, j = v.select("gene", F.col("ord").alias("i"), F.col("w").alias("wi")), v.select("gene", F.col("ord").alias("j"), F.col("w").alias("wj"))
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    below = cov.join(i, ["gene", "i"]).join(j, ["gene", "j"]).groupBy("gene").agg(F.sum(twice * F.col("wi") * F.col("wj") * F.col("cov")).alias("wvw"))
    t = top.join(below, "gene")
    some = F.col("wvw") > 0
    return t.withColumn("effect", F.when(some, F.col("wu") / F.col("wvw"))).withColumn("chisq", F.when(some, F.col("wu") * F.col("wu") / F.col("wvw")))


def skat_q(kept: DataFrame, method: str = "BBeta") -> DataFrame:
    """gene, num_var, q = sum of weight times U squared."""
    return kept.groupBy("gene").agg(F.count(F.lit(1)).alias("num_var"), F.sum(weight(method) * F.col("u") * F.col("u")).alias("q"))


def vt_scores(kept: DataFrame, cov: DataFrame) -> DataFrame:
    """gene, cutoff, num_var, s, var: for each distinct frequency of a gene the burden over variants up to it."""
    v = kept.select("gene", "ord", "af", "u")
    s = v.groupBy("gene", F.col("af").alias("cutoff")).agg(F.count(F.lit(1)).alias("here"), F.sum("u").alias("u"))
    i, j = v.select("gene", F.col("ord").alias("i"), F.col("af").alias("ai")), v.select("gene", F.col("ord").alias("j"), F.col("af").alias("aj"))
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    # a pair counts from the larger of its two frequencies on
    var = cov.join(i, ["gene", "i"]).join(j, ["gene", "j"]).groupBy("gene", F.greatest("ai", "aj").alias("cutoff")).agg(F.sum(twice * F.col("cov")).alias("here_var"))
    upto = Window.partitionBy("gene").orderBy("cutoff").rowsBetween(Window.unboundedPreceding, 0)
    told = s.join(var, ["gene", "cutoff"], "left").select("gene", "cutoff", F.sum("here").over(upto).alias("num_var"), F.sum("u").over(upto).alias("s"), F.sum("here_var").over(upto).alias("var"))
    return told.filter("var is not null")


def gene_matrices(kept: DataFrame, cov: DataFrame) -> DataFrame:
    """gene, af, u (by ord), cov (flattened, symmetric): one row per gene; a gene is as large as its group's line."""
    order = kept.withColumn("k", F.row_number().over(Window.partitionBy("gene").orderBy("ord")) - 1)
    g = order.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("k", "af", "u"))).alias("x"))
    i, j = order.select("gene", F.col("ord").alias("i"), F.col("k").alias("ki")), order.select("gene", F.col("ord").alias("j"), F.col("k").alias("kj"))
    c = cov.join(i, ["gene", "i"]).join(j, ["gene", "j"]).groupBy("gene").agg(F.collect_list(F.struct("ki", "kj", "cov")).alias("c"))
    return g.join(c, "gene").select("gene", F.transform("x", lambda v: v["af"]).alias("af"), F.transform("x", lambda v: v["u"]).alias("u"), F.transform("c", lambda v: v["ki"]).alias("ci"), F.transform("c", lambda v: v["kj"]).alias("cj"), F.transform("c", lambda v: v["cov"]).alias("cov"))


def _matrix(n: int, ci, cj, cov) -> np.ndarray:
    m = np.zeros((n, n))
    m[np.asarray(ci, int), np.asarray(cj, int)] = cov
    m[np.asarray(cj, int), np.asarray(ci, int)] = cov
    return m


def skat_tails(u: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[float, float, float, bool]:
    """(Q, Davies-type p, Liu p, shrunk): weights times chi-squares with the eigenvalues of C^1/2 W C^1/2.

    A tail outside (0, 1] shrinks Q, finely at first and then by steps of 1%, and is marked.
    """
    q = float((w * u * u).sum())
    root_w = np.sqrt(w)
    lam = np.linalg.eigvalsh(root_w[:, None] * c * root_w[None])
    lam = lam[lam > 1e-12 * max(lam.max(), 1e-300)]
    if not len(lam):
        return q, np.nan, np.nan, False
    at, marked = q, False
    p = chi2_mixture_tail(at, lam)
    if not 0 < p <= 1:
        marked = True
        for rate in (SHRINK**100, 0.99):
            for _ in range(SHRINK_STEPS // 100):
                if 0 < p <= 1:
                    break
                at *= rate
                p = chi2_mixture_tail(at, lam)
    return q, p, liu_tail(q, lam), marked


def vt_test(af: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[float, float, float, int, float]:
    """(effect, cutoff, p, number of variants, error of p) of the best frequency cutoff: max |S|/sd, and the chance that any of correlated normals exceeds it.

    All cutoffs enter the probability; a single one is a chi-square. Where the chances add up
    to less than 1/20 the union is sampled (:func:`mvn_any`), which is as exact at 1e-8 as at
    1e-2; else the box is integrated.
    """
    cuts = np.unique(af)
    pick = (af[None] <= cuts[:, None]).astype(float)
    s, v = pick @ u, pick @ c @ pick.T
    var = np.diag(v)
    fine = var > 0
    if not fine.any():
        return np.nan, np.nan, np.nan, 0, np.nan
    cuts, s, v, pick, var = cuts[fine], s[fine], v[np.ix_(fine, fine)], pick[fine], var[fine]
    t = np.abs(s) / np.sqrt(var)
    best = int(t.argmax())
    single, error = float(chi2_tail_1(t[best] ** 2)[0]), 0.0
    p = single
    if len(cuts) > 1:
        sd = np.sqrt(var)
        if single * len(cuts) < 0.05:
            p, error = mvn_any(t[best], v / np.outer(sd, sd))
        else:
            inside, error = mvn_box_error(np.full(len(sd), t[best]), v / np.outer(sd, sd))
            p = min(max(1 - inside, single), single * len(cuts))
    return float(s[best] / var[best]), float(cuts[best]), float(min(1.0, max(0.0, p))), int(pick[best].sum()), float(error)


def skat_vt(matrices: DataFrame, skat_method: str = "BBeta") -> DataFrame:
    """gene, q, p_davies, p_liu, shrunk, vt_effect, vt_cutoff, vt_p, vt_num_var, vt_p_error in one pass over the gene rows."""
    def weights(af: np.ndarray) -> np.ndarray:
        return {"burden": np.ones_like(af), "MB": np.sqrt(af * (1 - af)), "MAB": af, "BBeta": (25 * (1 - af) ** 24) ** 2}[skat_method]

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                af, u = np.asarray(r.af), np.asarray(r.u)
                c = _matrix(len(u), r.ci, r.cj, r.cov)
                rows.append((r.gene, *skat_tails(u, weights(af), c), *vt_test(af, u, c)))
            yield pd.DataFrame(rows, columns=["gene", "q", "p_davies", "p_liu", "shrunk", "vt_effect", "vt_cutoff", "vt_p", "vt_num_var", "vt_p_error"])

    # genes are few and each takes long: dealt out evenly rather than by bytes
    dealt = matrices.repartition(matrices.sparkSession.sparkContext.defaultParallelism * 2, "gene")
    return dealt.mapInPandas(run, "gene string, q double, p_davies double, p_liu double, shrunk boolean, vt_effect double, vt_cutoff double, vt_p double, vt_num_var int, vt_p_error double")


def burden_p(result: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return pd.Series(chi2_tail_1_reported(x)[0])

    return result.withColumn("p", F.when(F.col("chisq").isNotNull(), p("chisq")))


def top_hits(result: DataFrame, kept: DataFrame, p_col: str = "p", cutoff: float = 1e-6) -> DataFrame:
    """A row per variant of each gene whose p is under ``cutoff``."""
    hits = result.filter(F.col(p_col) < cutoff)
    return hits.join(kept.select("gene", "ord", "chrom", "pos", "ref", "alt", "af", F.col("effect").alias("variant_effect"), F.col("chisq").alias("variant_chisq")), "gene")
