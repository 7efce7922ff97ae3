"""Pooling of studies: normalise, check, harmonise alleles, sum, and derive statistics.

Records of one site from all studies meet in a single shuffle on (chrom, pos). What depends
on the order of studies, the choice of the reference allele and the matching of later ones
against it, is a fold over at most K records inside the row; everything else is a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import element

#: Reasons of exclusion.
QC, ALLELES_MISSING, ALLELES_MISMATCH = 0, 1, 2

_RECORD = "struct<study:int,samples:int,ref:string,alt:string,n:int,c1:int,c2:int,c3:int,u:double,v:double,effect:double,af:double,fail:int,case_ac:int,control_ac:int>"
_DECISION = "struct<study:int,dir:string,sign:int,ac:bigint,n:int,missing:int,reason:int,stat:boolean>"


def first_records(scores: DataFrame, order_col: str | None = None) -> DataFrame:
    """Of several records of a study at one site the first stays: by ``order_col``, by ``line`` if the records come from files, or else by alleles."""
    order_col = order_col or ("line" if "line" in scores.columns else None)
    order = [order_col] if order_col else ["ref", "alt"]
    nth = F.row_number().over(Window.partitionBy("study", "chrom", "pos").orderBy(*order))
    return scores.withColumn("nth", nth).filter("nth = 1").drop("nth")


def normalise(scores: DataFrame, call_rate: float = 0.95, hwe: float = 1e-5) -> DataFrame:
    """Clean keys and alleles, genotype counts c1 (ref), c2 (het), c3 (alt), and ``fail``: the reason of exclusion or null.

    Alleles coded 0 are ``.``. Dosage studies get counts from the allele frequency, cut to
    whole numbers; others as written. A record fails if both alleles are unknown, if they are
    equal though both occur, or by call rate or Hardy-Weinberg p; QC names the reason if
    both kinds hold. Null call rates and p-values pass.
    """
    dot = lambda c: F.when((F.col(c) == "0") | F.col(c).isNull(), F.lit(".")).otherwise(F.col(c)).alias(c)
    n, f = F.col("n_informative"), F.col("all_af")
    dose = F.coalesce(F.col("use_dosage"), F.lit(False))
    count = lambda told, made: F.when(dose, made.cast("int")).otherwise(F.col(told))
    s = scores.withColumn("chrom", F.regexp_replace("chrom", "^chr", "")).select("*", dot("ref").alias("r"), dot("alt").alias("t")).drop("ref", "alt").withColumnsRenamed({"r": "ref", "t": "alt"})
    s = s.withColumn("c3", count("n_alt", n * f * f)).withColumn("c2", count("n_het", 2 * n * f * (1 - f))).withColumn("c1", count("n_ref", n * (1 - f) * (1 - f)))
    s = s.withColumn("n", F.col("c1") + F.col("c2") + F.col("c3")).withColumn("ac", 2 * F.col("c3") + F.col("c2"))
    mixed = (F.col("c1") + F.col("c2") != 0) & (F.col("c2") + F.col("c3") != 0)
    alleles = ((F.col("ref") == ".") & (F.col("alt") == ".")) | ((F.col("ref") == F.col("alt")) & mixed)
    poor = (F.coalesce(F.col("call_rate"), F.lit(1.0)) < call_rate) | (F.coalesce(F.col("hwe_p"), F.lit(1.0)) < hwe)
    return s.withColumn("fail", F.when(poor, QC).when(alleles, ALLELES_MISSING).cast("int"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _match(s: Column, r: Column) -> Column:
    """How a record fits the site: code 0 as it is, 1 turned, 2 not at all; the pair (a, b) it leaves; whether it is monomorphic."""
    a, b, ref, alt = s["a"], s["b"], r["ref"], r["alt"]
    mono = (r["c2"] + r["c3"] == 0) | (r["c1"] + r["c2"] == 0)
    one_sided = (ref == alt) | (ref == ".") | (alt == ".")
    pair = lambda code, x, y: F.struct(F.lit(code).alias("code"), x.alias("a"), y.alias("b"))
    single = F.when(ref == ".", alt).when(alt == ".", ref).otherwise(alt)
    no = pair(2, a, b)
    blank, half, twin = (a == ".") & (b == "."), (b == ".") & (a != "."), a == b
    # a site's first record; one that fell out leaves no alleles behind
    only_alt = r["c1"] + r["c2"] == 0
    first = (
        F.when(r["fail"].isNotNull(), pair(2, F.lit("."), F.lit(".")))
        .when(mono & one_sided, pair(0, F.when(ref == ".", alt).otherwise(ref), F.lit(".")))
        .when(mono & only_alt, pair(0, alt, ref))
        .otherwise(pair(0, ref, alt))
    )
    # a record with one allele, then one with two, against the site's pair
    one = F.when(blank, pair(0, single, single)).when((a == ".") | (b == "."), F.when((single == a) | (single == b), pair(0, a, b)).otherwise(no)).when(b == single, pair(0, a, b)).when(a == single, pair(1, a, b)).otherwise(no)
    two = (
        F.when(blank, pair(0, ref, alt))
        .when(half, F.when((ref != a) & (alt != a), no).otherwise(pair(0, ref, alt)))
        .when((ref == a) & (alt == b), pair(0, a, b))
        .when((ref == b) & (alt == a), pair(1, a, b))
        .when(twin & (ref == a), pair(0, ref, alt))
        .when(twin & (alt == a), pair(1, alt, ref))
        .otherwise(no)
    )
    found = F.when(~s["seen"], first).when(r["fail"].isNotNull(), no).when(mono & one_sided, one).otherwise(two)
    return F.struct(found.alias("m"), mono.alias("mono"))


def _fold(s: Column, r: Column) -> Column:
    """State (a, b, seen, out) and the next study's record to the next state."""

    def decide(x: Column) -> Column:
        code, mono = x["m"]["code"], x["mono"]
        bad, flip = code == 2, code == 1
        zero = F.lit(0).cast("long")
        # a monomorphic record counts alleles only where it names two and the site is known
        silent = bad | (mono & (~s["seen"] | (r["ref"] == ".") | (r["alt"] == ".")))
        ac = F.when(silent, zero).when(flip, (2 * r["c1"] + r["c2"]).cast("long")).otherwise((2 * r["c3"] + r["c2"]).cast("long"))
        falls = F.when(flip, -r["effect"]).otherwise(r["effect"]) < 0
        decision = F.struct(
            r["study"].alias("study"), F.when(bad, "!").when(mono, "?").when(falls, "-").otherwise("+").alias("dir"), F.when(flip, -1).otherwise(1).alias("sign"), ac.alias("ac"), F.when(bad, 0).otherwise(r["n"]).alias("n"),
            F.when(bad, r["samples"]).otherwise(r["samples"] - r["n"]).alias("missing"), F.when(bad, F.coalesce(r["fail"], F.lit(ALLELES_MISMATCH))).cast("int").alias("reason"), (~bad & ~mono).alias("stat"),
        ).cast(_DECISION)
        return F.struct(x["m"]["a"].alias("a"), x["m"]["b"].alias("b"), F.lit(True).alias("seen"), F.concat(s["out"], F.array(decision)).alias("out"))

    return _let(_match(s, r), decide)


def harmonise(records: DataFrame) -> DataFrame:
    """chrom, pos, ref, alt, records, decisions: one row per site; both arrays run over the studies that have it, in order.

    ``records`` are those of :func:`normalise`, one per study and site. A decision says how
    the study's record enters: ``sign`` -1 if its alleles are the other way round, ``dir`` one
    of ``+ - ? !``, ``ac`` the alternative alleles it adds, ``missing`` the samples it takes
    from the total, ``reason`` why it is excluded, ``stat`` whether U and V count.
    """
    fields = F.struct(
        F.col("study").cast("int").alias("study"), F.col("samples").cast("int").alias("samples"), "ref", "alt", F.col("n").cast("int").alias("n"),
        *[F.col(c).cast("int").alias(c) for c in ("c1", "c2", "c3")], "u", F.col("sqrt_v").alias("v"), "effect", F.col("all_af").alias("af"), "fail",
        *[(F.col(c) if c in records.columns else F.lit(None)).cast("int").alias(c) for c in ("case_ac", "control_ac")],
    ).cast(_RECORD)
    sites = records.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(fields)).alias("records"))
    start = F.struct(F.lit(".").alias("a"), F.lit(".").alias("b"), F.lit(False).alias("seen"), F.array().cast(f"array<{_DECISION}>").alias("out"))
    return sites.withColumn("s", F.aggregate("records", start, _fold)).select("chrom", "pos", F.col("s.a").alias("ref"), F.col("s.b").alias("alt"), "records", F.col("s.out").alias("decisions"))


def _total(x: Column, kind: str = "double") -> Column:
    return F.aggregate(x, F.lit(0).cast(kind), lambda a, v: a + F.coalesce(v, F.lit(0).cast(kind)))


def pool(sites: DataFrame, study_sizes: list[int], alt_maf: bool = False) -> DataFrame:
    """chrom, pos, ref, alt, n, af, direction, u, v, sumcase, sumcontrol and the arrays of :func:`harmonise`.

    N is all studies' samples less those excluded or missing, a study without the site
    counting in full as monomorphic; with ``alt_maf`` it is the samples observed. AF is 0
    where no study has a direction. V is on the variance scale.
    """
    total = sum(study_sizes)
    both = F.arrays_zip(F.col("records").alias("r"), F.col("decisions").alias("d"))
    signed = lambda f: F.transform(both, lambda x: F.when(x["d"]["stat"], f(x)))
    by_study = F.map_from_entries(F.transform("decisions", lambda d: F.struct(d["study"], d["dir"])))
    observed = _total(F.transform("decisions", lambda d: d["n"].cast("long")), "bigint")
    excluded = _total(F.transform("decisions", lambda d: d["missing"].cast("long")), "bigint")
    ac = _total(F.transform("decisions", lambda d: d["ac"]), "bigint")
    direction = F.concat_ws("", *[F.coalesce(F.element_at("dirs", F.lit(k)), F.lit("?")) for k in range(len(study_sizes))])
    used = lambda c: F.transform(both, lambda x: F.when(x["d"]["reason"].isNull(), F.when(x["d"]["sign"] < 0, 2 * x["r"]["n"] - x["r"][c]).otherwise(x["r"][c])).cast("long"))
    s = (
        sites.withColumn("dirs", by_study)
        .withColumn("u", _total(signed(lambda x: x["d"]["sign"] * x["r"]["u"])))
        .withColumn("v", _total(signed(lambda x: x["r"]["v"] * x["r"]["v"])))
        .withColumn("n", observed if alt_maf else F.lit(total).cast("long") - excluded)
        .withColumn("direction", direction)
        .withColumn("sumcase", _total(used("case_ac"), "bigint"))
        .withColumn("sumcontrol", _total(used("control_ac"), "bigint"))
    )
    raw = ac / (2.0 * F.col("n"))
    return s.withColumn("af", F.when(F.col("direction").rlike("[+-]") & (F.col("n") > 0), raw).otherwise(0.0)).drop("dirs")


def exact(pooled: DataFrame, trait_means: list[float], trait_variances: list[float], study_sizes: list[int]) -> DataFrame:
    """U and V adjusted for differences of trait mean and allele frequency between studies.

    With n_k, f_k, sigma2_k of each study's record before QC, delta_k its trait mean less the
    pooled one, N = sum n_k and f = sum n_k f_k / N: U - 2 f sum(n delta) + 2 sum(n f delta), and
    r (V + 4 sum n f^2 - 4 N f^2) with r = sum((n_k - 1) sigma2_k + n_k delta_k^2) / (N - 1), where
    U and V sum the studies' own on the trait's scale, u_k sigma2_k and v_k sigma2_k. The
    result has r as ``scale``.
    """
    grand = sum(m * n for m, n in zip(trait_means, study_sizes)) / sum(study_sizes)
    at = lambda values, k: F.get(F.array(*[F.lit(float(v)) for v in values]), k)
    delta = lambda r: at([m - grand for m in trait_means], r["study"])
    both = F.arrays_zip(F.col("records").alias("r"), F.col("decisions").alias("d"))
    f = lambda x: F.when(x["d"]["sign"] < 0, 1 - x["r"]["af"]).otherwise(x["r"]["af"])
    sum_ = lambda g: _total(F.transform(both, g))
    x = (
        pooled.withColumn("e_n", sum_(lambda x: x["r"]["n"].cast("double")))
        .withColumn("e_nf", sum_(lambda x: x["r"]["n"] * f(x)))
        .withColumn("e_nd", sum_(lambda x: x["r"]["n"] * delta(x["r"])))
        .withColumn("e_nfd", sum_(lambda x: x["r"]["n"] * f(x) * delta(x["r"])))
        .withColumn("e_nff", sum_(lambda x: x["r"]["n"] * f(x) * f(x)))
        .withColumn("e_r", sum_(lambda x: (x["r"]["n"] - 1) * at(trait_variances, x["r"]["study"]) + x["r"]["n"] * delta(x["r"]) * delta(x["r"])))
        .withColumn("e_u", sum_(lambda x: F.when(x["d"]["stat"], x["d"]["sign"] * x["r"]["u"] * at(trait_variances, x["r"]["study"]))))
        .withColumn("e_v", sum_(lambda x: F.when(x["d"]["stat"], x["r"]["v"] * x["r"]["v"] * at(trait_variances, x["r"]["study"]))))
        .withColumn("e_f", F.col("e_nf") / F.col("e_n"))
        .withColumn("scale", F.col("e_r") / (F.col("e_n") - 1))
    )
    u = F.col("e_u") - 2 * F.col("e_f") * F.col("e_nd") + 2 * F.col("e_nfd")
    v = F.col("scale") * (F.col("e_v") + 4 * F.col("e_nff") - 4 * F.col("e_n") * F.col("e_f") * F.col("e_f"))
    return x.withColumn("u", u).withColumn("v", v).withColumn("af", F.col("e_f")).drop("e_n", "e_nf", "e_nd", "e_nfd", "e_nff", "e_r", "e_f", "e_u", "e_v")


def single_variant(pooled: DataFrame) -> DataFrame:
    """chrom, pos, ref, alt, n, af, direction, effect, effect_se, h2, chisq; null statistics where the site is monomorphic, no row where V is 0 but AF isn't 0 or 1."""
    fixed = (F.col("af") <= 0) | (F.col("af") >= 1)
    tested = pooled.filter(fixed | (F.col("v") != 0))
    stat = lambda c: F.when(~fixed, c)
    beta = F.col("u") / F.col("v")
    return tested.select(
        "chrom", "pos", "ref", "alt", "n", "af", "direction",
        stat(beta).alias("effect"), stat(1 / F.sqrt("v")).alias("effect_se"), stat(F.col("v") * beta * beta / F.col("n")).alias("h2"), stat(F.col("u") * F.col("u") / F.col("v")).alias("chisq"),
    )


def largest_n(stats: DataFrame) -> int:
    """The most samples that any variant was tested in; 0 of an empty table."""
    return int(stats.agg(F.max("n")).first()[0] or 0)


def with_p(stats: DataFrame) -> DataFrame:
    from ..functions.distributions import chi2_p

    return stats.withColumn("p", chi2_p(F.col("chisq")))


def exclusions(sites: DataFrame) -> DataFrame:
    """study, chrom, pos, ref, alt, reason of every record that was left out."""
    x = sites.select("chrom", "pos", F.explode(F.arrays_zip(F.col("records").alias("r"), F.col("decisions").alias("d"))).alias("x")).filter("x.d.reason is not null")
    return x.select("x.d.study", "chrom", "pos", "x.r.ref", "x.r.alt", "x.d.reason")


def study_chisq(sites: DataFrame) -> DataFrame:
    """study, chrom, pos, chisq of every polymorphic record that entered with V > 0."""
    x = sites.select("chrom", "pos", F.explode(F.arrays_zip(F.col("records").alias("r"), F.col("decisions").alias("d"))).alias("x")).filter("x.d.stat and x.r.v > 0")
    return x.select("x.d.study", "chrom", "pos", (F.pow(F.col("x.r.u"), 2) / F.pow(F.col("x.r.v"), 2)).alias("chisq"))


def upper_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by``, n, median: the element n div 2 (from 0) of the sorted values, by ranks of the distinct ones."""
    m = element(df, value, by, {"median": F.floor(F.col("total") / 2)})
    return m.select(*by, F.col("total").alias("n"), "median")


GC_MEDIAN = 0.456


def study_genomic_control(sites: DataFrame) -> DataFrame:
    m = upper_median(study_chisq(sites), "chisq", ["study"])
    return m.select("study", "n", (F.col("median") / GC_MEDIAN).alias("gc"))


def pooled_genomic_control(stats: DataFrame) -> DataFrame:
    """stratum (all, maf<0.01, maf<0.05), n, gc: chi-square of the median p over 0.456; the upper median of p is the lower one of chi-square."""
    strata = F.array(F.lit("all"), F.when(F.col("af") < 0.01, F.lit("maf<0.01")), F.when(F.col("af") < 0.05, F.lit("maf<0.05")))
    each = stats.filter("chisq is not null").select(F.explode(F.filter(strata, lambda s: s.isNotNull())).alias("stratum"), (-F.col("chisq")).alias("x"))
    return upper_median(each, "x", ["stratum"]).select("stratum", "n", (-F.col("median") / GC_MEDIAN).alias("gc"))


def gc_corrected(stats: DataFrame, gc: float) -> DataFrame:
    return stats.withColumn("chisq_gc", F.col("chisq") / F.lit(max(gc, 1e-300)))


def odds_ratio(stats: DataFrame, mean: float, effect: str = "effect") -> DataFrame:
    """exp(beta / (mu (1 - mu))) with the trait mean mu of a 0/1 trait; null effects stay null."""
    return stats.withColumn("odds_ratio", F.exp(F.col(effect) / F.lit(mean * (1 - mean))))


def chrom_order(c: str = "chrom") -> list[Column]:
    """Numeric chromosomes by value, then the others by name."""
    n = F.col(c).try_cast("int")
    return [n.asc_nulls_last(), F.col(c).asc()]
