"""Genotypes: per-variant summaries, codings, score statistics of unrelated samples, and LD covariance.

A long table (study, chrom, pos, ref, alt, sample, dose) needs no rows for dose 0 if every
sample is known: sums over centred genotypes follow from sums over the rows there are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import band_products

SITE = ["chrom", "pos", "ref", "alt"]
X_START, X_END = 2_699_520, 154_931_044


def in_nonpar_x(label: str = "X", start: int = X_START, end: int = X_END) -> Column:
    return (F.col("chrom") == label) & F.col("pos").between(start, end)


def mask_male_hets(genotypes: DataFrame, label: str = "X", male: int = 1, start: int = X_START, end: int = X_END) -> DataFrame:
    """Heterozygous males on the non-pseudo-autosomal X become missing; a haploid call of the alternative counts 2."""
    on_x = in_nonpar_x(label, start, end) & (F.col("sex") == male)
    haploid = F.col("ploidy") == 1 if "ploidy" in genotypes.columns else F.lit(False)
    return genotypes.withColumn("dose", F.when(on_x & haploid, F.col("dose") * 2).when(on_x & (F.col("dose") == 1), None).otherwise(F.col("dose")))


def coded(dose: Column, model: str, dosage: bool = False) -> Column:
    """Additive, recessive or dominant coding; null stays null."""
    if model == "additive":
        return dose
    if model == "recessive":
        return F.when(dose.isNotNull(), ((dose >= 1.5) if dosage else (dose == 2)).cast("double"))
    return F.when(dose.isNotNull(), ((dose > 0.5) if dosage else (dose >= 1)).cast("double"))


def variant_summary(genotypes: DataFrame, by: list[str] = (), founders: str | None = None) -> DataFrame:
    """Per variant: n (called), n_ref, n_het, n_alt, alt_ac, all_af, founder_af, call_rate. Rows are all samples, null dose is missing."""
    g = genotypes
    n, ac = F.count("dose"), F.sum("dose")
    whole = lambda k: F.count_if(F.round("dose") == k).alias(("n_ref", "n_het", "n_alt")[k])
    f = F.col(founders) if founders else F.lit(True)
    return g.groupBy(*by, *SITE).agg(
        n.alias("n"), whole(0), whole(1), whole(2), ac.alias("alt_ac"), (ac / (2 * n)).alias("all_af"),
        (F.sum(F.when(f, F.col("dose"))) / (2 * F.count(F.when(f, F.col("dose"))))).alias("founder_af"), (n / F.count(F.lit(1))).alias("call_rate"),
    )


def sparse_summary(rows: DataFrame, sites: DataFrame, by: list[str], total: int, founder: str, founders: int) -> DataFrame:
    """What :func:`variant_summary` has, from ``rows`` without those of dose 0.

    ``sites``: by, site, lines (how often it was genotyped) of every site; ``total`` samples, of
    which ``founders`` have true in the column ``founder`` of ``rows``.
    """
    none, round_ = F.col("dose").isNull(), F.round("dose")
    sums = rows.groupBy(*by, *SITE).agg(
        F.count_if(none).alias("missing"), F.count_if(none & F.col(founder)).alias("f_missing"), F.count("dose").alias("some"), F.count_if(round_ == 0).alias("r0"), F.count_if(round_ == 1).alias("r1"),
        F.count_if(round_ == 2).alias("r2"), F.sum("dose").alias("ac"), F.sum(F.when(F.col(founder), F.col("dose"))).alias("f_ac"),
    )
    j = sites.join(sums, [*by, *SITE], "left").fillna(0, ["missing", "f_missing", "some", "r0", "r1", "r2"]).fillna(0.0, ["ac", "f_ac"])
    j = j.withColumn("n", F.lit(total) * F.col("lines") - F.col("missing")).withColumn("f_n", F.lit(founders) * F.col("lines") - F.col("f_missing"))
    return j.select(
        *by, *SITE, "n", (F.col("n") - F.col("some") + F.col("r0")).alias("n_ref"), F.col("r1").alias("n_het"), F.col("r2").alias("n_alt"), F.when(F.col("n") > 0, F.col("ac")).alias("alt_ac"),
        F.when(F.col("n") > 0, F.col("ac") / (2 * F.col("n"))).alias("all_af"), F.when(F.col("f_n") > 0, F.col("f_ac") / (2 * F.col("f_n"))).alias("founder_af"),
        (F.col("n") / (F.lit(total) * F.col("lines"))).alias("call_rate"),
    )


def with_hwe(summary: DataFrame) -> DataFrame:
    """hwe_p by the exact test; null where no sample is called."""
    from ..functions.distributions import hwe_exact

    @F.pandas_udf("double")
    def p(h: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(hwe_exact(h, a, b))

    return summary.withColumn("hwe_p", F.when(F.col("n") > 0, p("n_het", "n_ref", "n_alt")))


def mean_af_suspicious(summary: DataFrame) -> DataFrame:
    """One row: mean AF, and whether it exceeds 0.5, which hints at swapped alleles."""
    return summary.agg(F.avg("all_af").alias("mean_af"), (F.avg("all_af") > 0.5).alias("suspicious"))


def sparse_scores(nonzero: DataFrame, residuals: DataFrame, by: list[str], case: str | None = None) -> DataFrame:
    """U and V of unrelated samples from rows of dose > 0 alone.

    ``nonzero``: by, site, sample, dose. ``residuals``: by, sample, r (residual of the null
    model, mean 0 per group) and sigma2. With n samples, u = sum(r g)/sigma2 as residuals sum to
    zero up to their mean, v = (sum(g^2) - sum(g)^2 / n)/sigma2. ``case`` names a boolean
    column of ``residuals``; the result then has the cases' alternative alleles as case_ac.
    A ``nonzero`` that has r (and the column ``case``) isn't joined with the residuals again.
    """
    facts = residuals.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("r_mean"), F.max("sigma2").alias("sigma2"))
    is_case = (F.col(case) if case else F.lit(False)).alias("case")
    x = nonzero.withColumn("case", is_case) if "r" in nonzero.columns else nonzero.join(residuals.select(*by, "sample", "r", is_case), [*by, "sample"])
    sums = x.groupBy(*by, *SITE).agg(F.sum(F.col("r") * F.col("dose")).alias("rg"), F.sum("dose").alias("g"), F.sum(F.col("dose") * F.col("dose")).alias("gg"), F.count_if(F.col("dose") == 1).alias("n_het"), F.count_if(F.col("dose") == 2).alias("n_alt"), F.sum(F.when(F.col("case"), F.col("dose")).otherwise(0.0)).alias("case_ac"))
    j = sums.join(F.broadcast(facts), by)
    u = (F.col("rg") - F.col("r_mean") * F.col("g")) / F.col("sigma2")
    v = (F.col("gg") - F.col("g") * F.col("g") / F.col("n")) / F.col("sigma2")
    return j.select(*by, *SITE, F.col("n").cast("int").alias("n"), F.col("n_het").cast("int").alias("n_het"), F.col("n_alt").cast("int").alias("n_alt"), F.col("g").alias("alt_ac"), u.alias("u"), v.alias("v"), *([F.col("case_ac")] if case else []))


def dense_scores(genotypes: DataFrame, residuals: DataFrame, by: list[str], model: str = "additive", dosage: bool = False) -> DataFrame:
    """U and V from a full table: coded genotypes are centred by the called samples' mean, missing ones are the mean."""
    x = genotypes.join(residuals, [*by, "sample"]).withColumn("g", coded(F.col("dose"), model, dosage)).withColumn("r0", F.when(F.col("g").isNotNull(), F.col("r")))
    s = x.groupBy(*by, *SITE).agg(F.sum(F.col("r") * F.col("g")).alias("rg"), F.sum("r0").alias("r_sum"), F.avg("g").alias("m"), F.sum(F.col("g") * F.col("g")).alias("gg"), F.count("g").alias("n"), F.max("sigma2").alias("sigma2"))
    u = (F.col("rg") - F.col("m") * F.col("r_sum")) / F.col("sigma2")
    v = (F.col("gg") - F.col("n") * F.col("m") * F.col("m")) / F.col("sigma2")
    return s.select(*by, *SITE, F.col("n").cast("int").alias("n"), u.alias("u"), v.alias("v"))


def score_table(stats: DataFrame) -> DataFrame:
    """sqrt_v, effect, chisq beside u and v; null where v is 0."""
    some = F.col("v") > 0
    return stats.withColumn("sqrt_v", F.sqrt("v")).withColumn("effect", F.when(some, F.col("u") / F.col("v"))).withColumn("chisq", F.when(some, F.col("u") * F.col("u") / F.col("v")))


def ld_covariance(nonzero: DataFrame, groups: DataFrame, by: list[str], window: int = 1_000_000, within: DataFrame | None = None) -> DataFrame:
    """by, (gene,) chrom, pos, pos2, cov: sum of centred products over sigma2 n, of all variants up to ``window`` downstream.

    ``groups``: by, n, sigma2. Variants within reach meet in tiles of variants by samples, which
    sum their products and take off those of their means. Pairs without a common carrier still
    have the covariance of their means. ``within`` (gene, chrom, pos) restricts
    the pairs to those of a gene before any is made.
    """
    label = None
    if within is not None:
        label = "gene"
        nonzero = nonzero.join(within.select("gene", "chrom", "pos").distinct(), ["chrom", "pos"])
    at = [*by, *([label] if label else []), "chrom", "pos"]
    sites = nonzero.groupBy(*at).agg(F.sum("dose").alias("g"))
    few = F.broadcast(groups)  # dealt by ``by`` alone, all tiles would lie in as many tasks as there are groups
    sites = sites.join(few, by).select(*at, (F.col("g") / F.col("n")).alias("mean"), (F.col("g") / F.col("sigma2")).alias("along"))
    cells = nonzero.join(few.select(*by, F.sqrt("sigma2").alias("sigma")), by).select(*at, "sample", (F.col("dose") / F.col("sigma")).alias("x"))
    return centred_products(cells, "sample", sites, groups.select(*by, "n", (F.col("n") / F.col("sigma2")).alias("ones")), by, window, label)


def centred_products(cells: DataFrame, column: str, sites: DataFrame, groups: DataFrame, by: list[str], window: int, label: str | None = None) -> DataFrame:
    """by, (label,) chrom, pos, pos2, cov = (x x2 - mean along2 - mean2 along + mean mean2 ones) / n.

    ``cells``: by, chrom, pos, ``column``, x (standardised genotypes); ``sites``: by, chrom, pos,
    mean, along (the product with the standardised vector of ones); ``groups``: by, n, ones
    (that vector's square). With ``label``, a column of both, only pairs of one label count.
    """
    most = groups.agg(F.max("n")).first()[0] or 0
    told = sites.join(F.broadcast(groups), by)
    covs = band_products(cells, [*by, "chrom"], "pos", column, "x", window, int(most), label, told)
    return covs.select(*by, *([label] if label else []), "chrom", "pos", "pos2", F.col("product").alias("cov"))
