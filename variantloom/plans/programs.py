"""The two programs from files to files: a study's association run, and the meta-analysis of several.

Both build lazy tables from the readers and operators and write them at the end; between the
programs lie text files, as analysts exchange them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MetaOptions, WorkerOptions
from ..operators import annotate, conditional, families, genes, genotypes, kinship, nullmodels, pooling, populations
from ..operators import samples as people_of
from ..sources import readers, writers
from ..sources.shared import written


# ---- one study ----


@dataclass
class StudyRun:
    """What a study's run of one trait gives: records, covariances, sample number, the trait's summary and the fitted model."""

    trait: str
    scores: DataFrame
    covariance: DataFrame
    samples: int
    summary: dict
    beta: list[float]
    sigma2: float
    variances: dict = field(default_factory=dict)
    left_out: DataFrame | None = None


@dataclass
class Calls:
    """A study's genotypes: ``rows`` (chrom, pos, ref, alt, sample, dose) but those of dose 0, every site with the number of its ``lines``, every sample."""

    rows: DataFrame
    sites: DataFrame
    samples: DataFrame

    def at(self, wanted: DataFrame) -> Calls:
        """Those at the sites (chrom, pos) asked for."""
        sites = readers.look_up(self.sites, wanted)
        return Calls(readers.look_up(self.rows, wanted), sites, self.samples.limit(0) if sites.isEmpty() else self.samples)


def _study_genotypes(spark: SparkSession, o: WorkerOptions, people: DataFrame) -> Calls:
    """The genotypes of the VCF, or of the pedigree's markers (named chrom:pos; the lesser allele by name is the reference)."""
    if o.vcf:
        kind = "DS" if o.dosage else "GT"
        g = readers.read_genotypes(spark, o.vcf, kind, o.range, carriers=True)
        sex = people.select(people_of.sample_id(o.merged_vcf_id).alias("sample"), "sex")
        g = genotypes.mask_male_hets(g.join(sex, "sample"), o.x_label, o.male_label, o.x_start, o.x_end).drop("sex", "ploidy")
        named = spark.createDataFrame([(n,) for n in readers.genotyped_samples(spark, o.vcf)], "sample string").join(sex, "sample", "left_semi")
        return _kept(g, readers.genotype_sites(spark, o.vcf, kind, o.range), named)
    m = people.select(people_of.sample_id(o.merged_vcf_id).alias("sample"), F.explode("markers").alias("marker", "call")).withColumn("a", F.split("call", "/"))
    told = F.filter("a", lambda x: ~x.isin("0", ".", "x", "X", "N"))
    m = m.withColumn("a", F.when(F.size(told) == 2, told)).withColumn("p", F.split("marker", ":"))
    alleles = m.groupBy("marker").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("a")))).alias("all"))
    j = m.join(alleles, "marker").filter("size(all) <= 2").withColumn("alt", F.coalesce(F.get("all", 1), F.lit(".")))
    dose = F.when(F.col("a").isNotNull(), F.size(F.filter("a", lambda x: x == F.col("alt"))).cast("double"))
    site = [readers.chrom_name(F.get("p", 0)).alias("chrom"), F.get("p", 1).cast("long").alias("pos"), F.coalesce(F.get("all", 0), F.lit(".")).alias("ref"), "alt"]
    g = j.select("marker", *site, "sample", dose.alias("dose")).filter(readers.in_region(o.range))
    sites = g.groupBy(*genotypes.SITE).agg(F.count_distinct("marker").alias("lines"))
    return _kept(g.drop("marker").filter("dose is null or dose <> 0"), sites, g.select("sample").distinct())


def _kept(rows: DataFrame, sites: DataFrame, samples: DataFrame) -> Calls:
    sites = written(sites, "sites")
    return Calls(written(rows, "calls"), sites, written(samples.limit(0) if sites.isEmpty() else samples, "genotyped"))


def study_runs(spark: SparkSession, options: WorkerOptions) -> list[StudyRun]:
    """A run per trait of a study: screening, null model, score test and covariances within the window.

    Without kinship the samples count as unrelated. With it (from the pedigree, the genotypes or
    a file) a mixed model is fitted on the rotation of its blocks; variants of the X have a model
    of their own if a component of the X is asked for.
    """
    o = options.checked()
    people = readers.read_pedigree(spark, o.ped, o.dat)
    calls = _study_genotypes(spark, o, people)
    related = _kinship(spark, o, people, calls)
    if o.kin_only:
        return []
    if o.variant_list:
        calls = calls.at(readers.read_variant_list(spark, o.variant_list))
    known = related.auto.select("a", "b") if related and not o.kin_pedigree else None
    screened = people_of.screened(people, calls.samples, known, o.merged_vcf_id)
    covariates = [name for kind, name in readers.read_dat(spark, o.dat) if kind == "C"] if o.use_covariates else []
    left_out = people_of.missing_from(people, calls.samples, o.merged_vcf_id)
    runs = []
    for trait in readers.trait_names(spark, people, o.trait_name):
        s = people_of.for_trait(screened, trait, covariates).withColumn("study", F.lit(0))
        if o.binary:
            low, high = nullmodels.binary_levels(s, "y")
            s = s.withColumn("y", (F.col("y") == high).cast("double"))
        if o.inverse_normal and not o.make_residuals:
            s = nullmodels.inverse_normal(s, "y", ["study"]).drop("y").withColumnRenamed("z", "y")
        s = written(s.select("study", "sample", "sex", "father", "mother", "y", "xs"), "samples")
        xs = [F.lit(1.0), *[F.col("xs")[i] for i in range(len(covariates))]]
        fit = nullmodels.least_squares(s, F.col("y"), xs, ["study"])
        r = nullmodels.residuals(s, F.col("y"), xs, fit, ["study"])
        if o.make_residuals and o.inverse_normal:  # the residuals are the trait
            r = nullmodels.inverse_normal(r.drop("sigma2"), "r", ["study"]).drop("r").withColumnRenamed("z", "r")
            r = r.join(F.broadcast(r.groupBy("study").agg(F.var_pop("r").alias("sigma2"))), "study")
        r = written(r.select("study", "sample", "r", "sigma2", "y", (F.col("father") == "0").alias("founder")), "residuals")
        facts = fit.first()
        model = _mixed_model(o, related, s, r) if related else None
        runs.append(_one_trait(o, trait, calls, s, r, facts, model))
        runs[-1].left_out = left_out
    return runs


@dataclass
class Relatives:
    """Blocks of relatives (sample, famid) and, within them, half of the covariance matrices (famid, a, b, k): of the autosomes, of the X."""

    blocks: DataFrame
    auto: DataFrame
    x: DataFrame | None = None


def _kinship(spark: SparkSession, o: WorkerOptions, people: DataFrame, calls: Calls) -> Relatives | None:
    """Kinship by the options: of pedigrees by families; of genotypes or a file by chains of pairs of ``kin_least`` or more, or in one block."""
    on_x = o.vc_x or o.separate_x
    if o.kin_pedigree:
        name = lambda c: F.concat_ws("_", "famid", c) if o.merged_vcf_id else F.col(c)
        adopted = people.filter("zygosity = '999'").select("famid", "pid")
        own = lambda c: adopted.withColumnRenamed("pid", c)

        def table(x_linked: bool) -> DataFrame:
            k = kinship.pedigree_kinship(people, x_linked, o.male_label)
            apart = k.filter("a <> b").join(own("a"), ["famid", "a"], "left_anti").join(own("b"), ["famid", "b"], "left_anti")
            return written(k.filter("a = b").unionByName(apart).select("famid", name("a").alias("a"), name("b").alias("b"), "k"), "kinship")

        blocks = people.select(people_of.sample_id(o.merged_vcf_id).alias("sample"), "famid")
        return Relatives(blocks, table(False), table(True) if on_x else None)
    if not (o.kin_geno or o.kin_file):
        return None
    genotyped = calls.samples

    def matrix(path: str | None, x: bool) -> DataFrame:
        if path:
            return written(readers.read_kinship(spark, path), "kinship")
        low = written(kinship.empirical_kinship(calls.rows, genotyped, o.kin_maf, o.kin_miss, o.x_label, x, calls.sites), "kinship")
        if o.kin_save or o.kin_only:
            names = [r["sample"] for r in genotyped.orderBy("sample").collect()]
            writers.write_kinship(low.select(F.col("b").alias("a"), F.col("a").alias("b"), "k"), names, f"{o.prefix}.Empirical.{'KinshipX' if x else 'Kinship'}")
        return low.unionByName(low.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "k"))

    whole = {x: matrix(o.kinx_file if x else o.kin_file, x) for x in ([False, True] if on_x else [False])}
    if o.kin_least > 0:
        near = None
        for k in whole.values():
            near = k.filter(F.abs("k") >= o.kin_least) if near is None else near.unionByName(k.filter(F.abs("k") >= o.kin_least))
        blocks = families.relative_blocks(whole[False].select(F.col("a").alias("sample")).distinct(), near)
    else:
        blocks = whole[False].select(F.col("a").alias("sample"), F.lit("all").alias("famid")).distinct()
    blocks = written(blocks, "blocks")

    def inside(k: DataFrame) -> DataFrame:
        a, b = blocks.withColumnRenamed("sample", "a"), blocks.select(F.col("sample").alias("b"), "famid")
        return written(k.join(a, "a").join(b, ["b", "famid"]).select("famid", "a", "b", (F.col("k") / 2).alias("k")), "kinship")

    return Relatives(blocks, inside(whole[False]), inside(whole[True]) if on_x else None)


@dataclass
class MixedModel:
    """Whitening and samples (see operators.families) of the autosomes and, if it has its own model, of the X; the estimates."""

    white: DataFrame
    people: DataFrame
    white_x: DataFrame | None
    people_x: DataFrame | None
    beta: list[float]
    variances: dict


def _mixed_model(o: WorkerOptions, related: Relatives, s: DataFrame, r: DataFrame) -> MixedModel:
    by = ["study"]
    own = s.join(related.blocks, "sample")
    if o.make_residuals:  # the residuals are the trait
        own = own.drop("y").join(r.select("sample", F.col("r").alias("y")), "sample").withColumn("xs", F.array(F.lit(1.0)))
    else:
        own = own.withColumn("xs", F.concat(F.array(F.lit(1.0)), F.col("xs")))
    own = written(own.select("study", "famid", "sample", "y", "xs"), "family-samples")
    first = own.first()
    k = len(first["xs"]) if first else 1
    table = lambda x: families.with_blocks(own, x.withColumn("study", F.lit(0)), by)

    def spectral(x: DataFrame):
        rotation = written(families.rotations(table(x), by), "rotation")
        fit = families.fit_mixed(families.rotated(rotation, own, k, by), k, by)
        return families.whitening(rotation, fit, by), fit

    white, fit = spectral(related.auto)
    facts = fit.first()
    told = {"Sigma_g2_Hat": facts["s2g"], "Sigma_e2_Hat": facts["s2e"]} if facts else {}
    white, people = written(white, "white"), written(families.whitened_samples(white, own, fit, by), "white-samples")
    white_x = people_x = None
    if related.x is not None:
        if o.separate_x:
            white_x, fit_x = spectral(related.x)
            f = fit_x.first()
            told |= {"Xheritability": f["h2"]} if f else {}
        else:
            tables = [table(related.auto), table(related.x)]
            fit_x = written(families.variance_components(own, tables, k, by), "components")
            white_x = families.component_whitening(own, tables, fit_x, by)
            f = fit_x.first()
            total = sum(f["variances"]) if f else 0.0
            told |= {"AutosomalHeritability": f["variances"][0] / total, "Xheritability": f["variances"][1] / total} if total else {}
        white_x, people_x = written(white_x, "white-x"), written(families.whitened_samples(white_x, own, fit_x, by), "white-x-samples")
    return MixedModel(white, people, white_x, people_x, [float(b) for b in facts["beta"]] if facts else [], told)


def _related_statistics(o: WorkerOptions, filled: DataFrame, m: MixedModel) -> tuple[DataFrame, DataFrame]:
    """Scores and covariances of related samples, the X's by its own model if there is one."""
    by, found = ["study"], []
    sets = [(filled, m.white, m.people)]
    if m.white_x is not None:
        on_x = F.col("chrom") == o.x_label
        sets = [(filled.filter(~on_x), m.white, m.people), (filled.filter(on_x), m.white_x, m.people_x)]
    for own, white, people in sets:
        cells = written(families.whitened_genotypes(own, white, by), "white-genotypes")
        scores = written(families.related_scores(own, white, people, by, cells=cells), "related-scores")
        found.append((scores, families.related_covariance(cells, scores, people, by, o.ld_window)))
    scores, cov = found[0]
    for s, c in found[1:]:
        scores, cov = scores.unionByName(s), cov.unionByName(c)
    return scores, cov


def _one_trait(o: WorkerOptions, trait: str, calls: Calls, s: DataFrame, r: DataFrame, facts, mixed: MixedModel | None = None) -> StudyRun:
    n = int(facts["n"]) if facts else 0
    sigma2 = float(r.agg(F.max("sigma2")).first()[0] or 0.0)
    own = calls.rows.join(r.select("study", "sample", "founder"), "sample")
    told = r.agg(F.count(F.lit(1)).alias("all"), F.count_if("founder").alias("founders"), F.count_if(F.col("y") == 1).alias("cases"), F.count_if(F.col("y") == 0).alias("controls")).first()
    sites = (calls.sites if told["all"] else calls.sites.limit(0)).withColumn("study", F.lit(0))
    summary = genotypes.with_hwe(genotypes.sparse_summary(own, sites, ["study"], told["all"], "founder", told["founders"]))
    model = "recessive" if o.recessive else "dominant" if o.dominant else "additive"
    coded = own.withColumn("dose", genotypes.coded(F.col("dose"), model, o.dosage))
    # a missing genotype is its variant's mean, which is 0 once centred
    sums = coded.groupBy("study", *genotypes.SITE).agg(F.coalesce(F.sum("dose"), F.lit(0.0)).alias("sum"), F.count_if(F.col("dose").isNull()).alias("missing")).filter("missing > 0")
    called = F.lit(told["all"]) * F.col("lines") - F.col("missing")
    mean = sums.join(sites, ["study", *genotypes.SITE]).select("study", *genotypes.SITE, F.when(called > 0, F.col("sum") / called).alias("mean"))
    filled = coded.join(mean, ["study", *genotypes.SITE], "left").withColumn("dose", F.coalesce("dose", "mean")).filter("dose > 0").select("study", *genotypes.SITE, "sample", "dose")
    filled = written(filled, "nonzero")
    if mixed:
        stats, cov = _related_statistics(o, filled, mixed)
    else:
        stats = genotypes.sparse_scores(filled, r, ["study"])
        groups = r.groupBy("study").agg(F.count(F.lit(1)).alias("n"), F.max("sigma2").alias("sigma2"))
        cov = genotypes.ld_covariance(filled.select("study", "sample", "chrom", "pos", "dose"), groups, ["study"], o.ld_window)
    u = genotypes.score_table(stats).select("study", *genotypes.SITE, "u", "sqrt_v", "effect", "chisq")
    case = None
    if o.print_case_ac:
        kinds = (("case_ac", 1, told["cases"]), ("control_ac", 0, told["controls"]))
        sums = [x for c, y, _ in kinds for x in (F.sum(F.when(F.col("y") == y, F.col("dose"))).alias(c), F.count_if((F.col("y") == y) & F.col("dose").isNull()).alias(f"{c}_missing"))]
        found = own.join(r.select("sample", "y"), "sample").groupBy("study", *genotypes.SITE).agg(*sums)
        called = lambda c, n: F.lit(n) * F.col("lines") > F.coalesce(f"{c}_missing", F.lit(0))
        case = sites.join(found, ["study", *genotypes.SITE], "left").select("study", *genotypes.SITE, *[F.when(called(c, n), F.coalesce(c, F.lit(0.0))).cast("int").alias(c) for c, _, n in kinds])
    from ..functions.distributions import chi2_p

    j = summary.join(u, ["study", *genotypes.SITE], "left")
    if case is not None:
        j = j.join(case, ["study", *genotypes.SITE], "left")
    fill = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    scores = j.select(
        "study", *genotypes.SITE, F.col("n").cast("int").alias("n_informative"), "founder_af", "all_af", "alt_ac", "call_rate", "hwe_p", *[F.col(c).cast("int").alias(c) for c in ("n_ref", "n_het", "n_alt")],
        fill("u"), fill("sqrt_v"), "effect", chi2_p(F.col("chisq")).alias("p"), *(["case_ac", "control_ac"] if case is not None else []),
    )
    five = nullmodels.five_numbers(s, "y", ["study"]).first()
    five = five.asDict() if five else dict.fromkeys(("min", "q25", "median", "q75", "max", "mean", "variance"), 0.0)
    beta = mixed.beta if mixed else [float(b) for b in facts["beta"]] if facts else []
    return StudyRun(trait, scores, cov, n, five, beta, sigma2, mixed.variances if mixed else {})


def write_study(run: StudyRun, path: str, layout: str = "native", cov_layout: str = "dense", digits: int = 6) -> tuple[str, str]:
    """(score path, covariance path) of a run's files; a third one lists the people left out and why."""
    scores, cov = f"{path}.{run.trait}.singlevar.score.txt", f"{path}.{run.trait}.singlevar.cov.txt"
    writers.write_scores(run.scores, scores, run.samples, run.trait, run.summary, layout, digits, run.variances)
    writers.write_cov(run.covariance.drop("study"), cov, cov_layout)
    if run.left_out is not None:
        writers.write_table(run.left_out, f"{path}.{run.trait}.left_out.txt", names=["SAMPLE", "REASON"], order=["sample"], single=False)
    return scores, cov


# ---- the meta-analysis ----


@dataclass
class MetaRun:
    """Tables of a meta-analysis: single variants, gene tests by name, top hits by name, exclusions, genomic controls."""

    sizes: list[int]
    sites: DataFrame
    pooled: DataFrame
    single: DataFrame
    excluded: DataFrame
    control: DataFrame
    kept: DataFrame | None = None
    gene_cov: DataFrame | None = None
    summary: DataFrame | None = None
    tests: dict[str, DataFrame] = field(default_factory=dict)


def by_study(values: list, default=0.0) -> Column:
    return F.get(F.array(*[F.lit(v if v is not None else default) for v in values]), F.col("study"))


def meta_run(spark: SparkSession, options: MetaOptions) -> MetaRun:
    """Every table that ``options`` ask for, from the lists of files on; see :func:`write_meta` for the text files."""
    o = options.checked()
    studies = readers.read_study_list(spark, o.summary_files, o.cov_files, o.dosage_option_file)
    if o.dosage:
        studies = studies.withColumn("use_dosage", F.lit(True))
    paths = [r["score_path"] for r in studies.orderBy("study").collect()]
    headers = [readers.score_header(spark, p) for p in paths]
    scores = written(pooling.first_records(readers.read_scores(spark, studies)).drop("line"), "scores")
    sizes_of = {r["study"]: r["n"] for r in scores.groupBy("study").agg(F.max("samples").alias("n")).collect()}
    sizes = [int(sizes_of.get(k) or 0) for k in range(len(paths))]
    if o.use_exact and o.norm_pop:
        panel = readers.read_panel(spark, o.pop_file)
        n = len((panel.select("af").first() or {"af": []})["af"])
        joined = populations.with_panel(scores, panel, n, o.match_only, o.match_dist, o.match_by_abs, o.min_match_maf, o.max_match_maf)
        gamma = populations.panel_coefficients(joined, n)
        every = populations.with_panel(scores, panel, n)
        scores = populations.corrected_af(every, gamma).withColumn("all_af", F.col("af_corrected")).drop("af_corrected", "panel_af", "matched")
    sites = written(pooling.harmonise(pooling.normalise(scores, o.call_rate, o.hwe)), "sites")
    pooled = pooling.pool(sites, sizes, o.alt_maf)
    if o.use_exact:
        pooled = pooling.exact(pooled, [h["trait_mean"] or 0.0 for h in headers], [h["trait_variance"] or 0.0 for h in headers], sizes)
    pooled = written(pooled, "pooled")
    single = pooling.with_p(pooling.single_variant(pooled))
    if o.correct_gc:
        gc = pooling.pooled_genomic_control(single).filter("stratum = 'all'").first()
        if gc and gc["gc"] > 1:
            from ..functions.distributions import chi2_p

            single = pooling.gc_corrected(single, gc["gc"]).withColumn("p", chi2_p(F.col("chisq_gc"))).drop("chisq_gc")
    if o.sum_case_ac:
        single = single.join(pooled.select("chrom", "pos", "sumcase", "sumcontrol"), ["chrom", "pos"])
    cov = readers.read_cov(spark, studies, o.range) if o.cov_files else None
    sized = dict(enumerate(sizes))
    decisions = sites.select("chrom", "pos", F.explode("decisions").alias("d")).filter("d.stat").select("d.study", "chrom", "pos", F.col("d.sign").cast("double").alias("sign"))
    markers = models = None
    if o.condition:
        cov = written(cov, "cov")
        wanted = readers.read_conditions(spark, o.condition)
        markers = written(conditional.condition_markers(wanted, scores, cov), "condition-markers")
        models = written(conditional.condition_models(markers, cov, sized), "condition-models")
        c = conditional.conditional_scores(scores, cov, markers, models, sized)
        cond = written(conditional.conditional_meta(decisions, c, markers), "conditional")
        single = single.join(pooling.with_p(cond.withColumnRenamed("chisq_cond", "chisq")).select("chrom", "pos", "effect_cond", F.col("p").alias("p_cond")), ["chrom", "pos"], "left")
    if o.label_hits and o.gene_map:
        single = annotate.genes_of(single, readers.read_gene_map(spark, o.gene_map))
    run = MetaRun(sizes, sites, pooled, single, pooling.exclusions(sites), pooling.pooled_genomic_control(single))
    if o.gene_tests:
        groups = readers.read_groups(spark, o.group_file) if o.group_file else readers.read_annotated_groups(spark, o.annotated_vcf, o.annotation.split("/") if o.annotation else None)
        run.kept = written(genes.gene_variants(groups, pooled, o.maf), "kept")
        run.gene_cov = written(genes.gene_covariance(run.kept, cov, decisions, sized, exact=_exact_terms(sites, pooled, headers) if o.use_exact else None), "gene-cov")
        with_p = run.kept.join(pooling.with_p(run.kept.select("gene", "ord", "chisq")).select("gene", "ord", "p"), ["gene", "ord"])
        run.summary = genes.gene_summary(run.kept).join(with_p.groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "p"))), lambda x: x["p"]).alias("pvalues")), "gene")
        run.tests = gene_tests(o.gene_tests, run.kept, run.gene_cov)
        if o.condition:
            kept_c, cov_c = conditional.conditional_genes(run.kept, run.gene_cov, decisions, cond, conditional.condition_vectors(scores, cov, markers, models, sized), models, sized)
            run.tests |= {f"{k} conditional": v for k, v in gene_tests(o.gene_tests, kept_c, cov_c).items()}
    return run


def gene_tests(names: list[str], kept: DataFrame, cov: DataFrame) -> dict[str, DataFrame]:
    out = {m: genes.burden_p(genes.burden(kept, cov, m)) for m in names if m in genes.METHODS}
    if {"VT", "SKAT"} & set(names):
        both = written(genes.skat_vt(genes.gene_matrices(kept, cov)), "skat-vt")
        out |= {m: both for m in ("VT", "SKAT") if m in names}
    return out


def _exact_terms(sites: DataFrame, pooled: DataFrame, headers: list[dict]) -> dict:
    """What :func:`genes.gene_covariance` needs for the exact adjustment."""
    af = sites.select("chrom", "pos", F.explode("records").alias("r")).select("r.study", "chrom", "pos", "r.n", "r.af")
    return {"af": af, "pooled": pooled, "variance": [h["trait_variance"] or 0.0 for h in headers]}


def write_meta(run: MetaRun, options: MetaOptions, digits: int = 6) -> list[str]:
    """Paths of the text files written under ``options.prefix``: results, top hits, the records left out."""
    o, out = options, []
    order = [*pooling.chrom_order(), "pos"]
    names = {"chrom": "CHROM", "pos": "POS", "ref": "REF", "alt": "ALT", "n": "N", "af": "POOLED_ALT_AF", "direction": "DIRECTION_BY_STUDY", "effect": "EFFECT_SIZE", "effect_se": "EFFECT_SIZE_SD", "h2": "H2", "p": "PVALUE", "effect_cond": "COND_EFFSIZE", "p_cond": "COND_PVALUE", "sumcase": "sumCaseAC", "sumcontrol": "sumControlAC", "gene": "GENE"}
    columns = [c for c in names if c in run.single.columns]
    control = {r["stratum"]: r["gc"] for r in run.control.collect()}
    footer = [f"Genomic Control for {k} is: {v:g}" for k, v in sorted(control.items())]
    path = f"{o.prefix}.meta.singlevar.results"
    writers.write_table(run.single.select(*columns), path, writers.single_variant_header(len(run.sizes), sum(run.sizes)), footer, [names[c] for c in columns], order=order, single=False, digits=digits)
    out.append(path)
    if o.write_vcf:
        writers.write_vcf(run.pooled, f"{o.prefix}.pooled.variants.vcf")
        out.append(f"{o.prefix}.pooled.variants.vcf")
    for method, result in run.tests.items():
        if method.endswith("conditional"):
            continue
        rows, heads, end = writers.gene_table(result, run.summary, method, o.long_output, run.tests.get(f"{method} conditional"))
        path = f"{o.prefix}.meta.{method}{'_' if method in ('VT', 'SKAT') else ''}.results"
        writers.write_table(rows, path, writers.group_header(), names=heads, end=end, order=["gene"], single=False, digits=digits)
        out.append(path)
        if o.tabulate_hits:
            rows, heads = writers.hit_table(result, run.summary, method, o.hits_cutoff, o.maf)
            writers.write_table(rows, f"{o.prefix}.meta.tophits.{method}.tbl", names=heads, order=["gene"], single=False)
            out.append(f"{o.prefix}.meta.tophits.{method}.tbl")
    path = f"{o.prefix}.meta.excluded.txt"
    reason = F.element_at(F.array(*[F.lit(x) for x in ("call rate or HWE", "an allele is missing", "alleles don't match")]), F.col("reason") + 1)
    excluded = run.excluded.select("study", "chrom", "pos", "ref", "alt", reason.alias("reason"))
    writers.write_table(excluded, path, names=["STUDY", "CHROM", "POS", "REF", "ALT", "REASON"], order=["study", *order], single=False)
    out.append(path)
    return out
