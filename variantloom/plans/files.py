"""Queries that write the cohort as the files analysts exchange and read it back, and runs of both programs over such files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MetaOptions, WorkerOptions
from ..operators import nullmodels, pooling
from ..sources import bcf, readers, store, writers
from ..sources.shared import fresh_path
from . import programs
from .adapter import STUDIES, Cohort
from .queries import BASE, EXACT, GENES, ORACLES, WEIGHTS, p_sql, query, rounded

#: Layouts of the studies' files, so that every reader is in use.
SCORE_LAYOUT = ["native", "native", "native", "rvtests", "rvtests"]
COV_LAYOUT = ["dense", "compact", "rvtests", "dense", "compact"]


def _put(spark: SparkSession, lines: list[str], name: str) -> str:
    path = fresh_path(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def _text(df: DataFrame, name: str) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.text(path)
    return path


def _score_files(c: Cohort, layouts: list[str] = SCORE_LAYOUT) -> list[str]:
    """A score file per study: the adapter's records, digits enough to read them back."""
    five = {r["study"]: r.asDict() for r in nullmodels.five_numbers(c.samples, "y", ["study"]).withColumn("variance", F.col("variance")).collect()}
    nothing = dict.fromkeys(("min", "q25", "median", "q75", "max", "mean", "variance"), 0.0)
    variance = {r["study"]: r["v"] for r in c.samples.groupBy("study").agg(F.var_pop("y").alias("v")).collect()}
    s = c.scores.withColumn("founder_af", F.col("all_af")).withColumn("alt_ac", (2 * F.col("n_alt") + F.col("n_het")).cast("double")).withColumn("p", F.lit(None).cast("double"))
    out = []
    for k in range(STUDIES):
        path = fresh_path(c.spark, f"study{k}-score")
        own = s.filter(F.col("study") == k)
        own = own if layouts[k] == "native" else own.drop("case_ac", "control_ac")
        writers.write_scores(own, path, c.sizes[k], "QT", five.get(k, nothing) | {"variance": variance.get(k, 0.0)}, layouts[k], 17)
        out.append(path)
    return out


def _cov_files(c: Cohort) -> list[str]:
    """A covariance file per study, in the orientation of its own score records."""
    sign = lambda pos: F.when(c.turned_at(pos), -1.0).otherwise(1.0)
    x = c.covariance.select("study", "chrom", "pos", "pos2", (F.col("cov") * sign("pos") * sign("pos2")).alias("cov"))
    out = []
    for k in range(STUDIES):
        path = fresh_path(c.spark, f"study{k}-cov")
        writers.write_cov(x.filter(F.col("study") == k).drop("study"), path, COV_LAYOUT[k])
        out.append(path)
    return out


def _lists(c: Cohort, cov: bool = False, layouts: list[str] = SCORE_LAYOUT) -> dict:
    spark = c.spark
    lists = {"summary_files": _put(spark, ["# score files", *_score_files(c, layouts)], "scores-list"), "dosage_option_file": _put(spark, ["genotype"] * STUDIES, "dosage-list")}
    return lists | ({"cov_files": _put(spark, _cov_files(c), "cov-list")} if cov else {})


def _studies(c: Cohort, cov: bool = False) -> DataFrame:
    x = _lists(c, cov)
    return readers.read_study_list(c.spark, x["summary_files"], x.get("cov_files"), x["dosage_option_file"])


@query("score_files", BASE + """
SELECT study, chrom, pos, CASE WHEN turned THEN alt ELSE ref END AS ref, CASE WHEN turned THEN ref ELSE alt END AS alt, n::INTEGER AS n_informative, n::INTEGER AS samples, false AS use_dosage,
       CASE WHEN turned THEN n_alt ELSE n - n_het - n_alt END::INTEGER AS n_ref, n_het::INTEGER AS n_het, CASE WHEN poor THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS call_rate,
       round(CASE WHEN turned THEN -u ELSE u END, 6) AS u, round(sqrt(v), 6) AS sqrt_v,
       CASE WHEN study < 3 THEN CASE WHEN turned THEN 2 * n - case_g ELSE case_g END END::INTEGER AS case_ac FROM sco""")  # fmt: skip
def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score files of both layouts, found by their list and read back."""
    s = readers.read_scores(spark, _studies(Cohort(spark, sf_dir)))
    return rounded(s.select("study", "chrom", "pos", "ref", "alt", "n_informative", "samples", "use_dosage", "n_ref", "n_het", "call_rate", "u", "sqrt_v", "case_ac"))


@query("score_headers", BASE + """
SELECT study, CASE WHEN study < 3 THEN 'native' ELSE 'rvtests' END AS layout, CASE WHEN study < 3 THEN n END::INTEGER AS samples, round(CASE WHEN study < 3 THEN m END, 6) AS trait_mean,
       round(CASE WHEN study < 3 THEN sigma2 END, 6) AS trait_variance FROM fct""")  # fmt: skip
def score_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files' own first lines tell: layout, samples, the trait's mean and variance."""
    c = Cohort(spark, sf_dir)
    rows = [(k, h["layout"], h["samples"], h["trait_mean"], h["trait_variance"]) for k, h in enumerate(readers.score_header(spark, p) for p in _score_files(c)) if c.sizes[k]]
    return rounded(spark.createDataFrame(rows, "study int, layout string, samples int, trait_mean double, trait_variance double"))


@query("score_lookup", BASE + "SELECT study, chrom, pos, round(CASE WHEN turned THEN -u ELSE u END, 6) AS u FROM sco WHERE part IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7)")
def score_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups: the sites of every order's seventh item, in all studies' files."""
    c = Cohort(spark, sf_dir)
    sites = c.table("lineitem").filter("l_linenumber = 7").select(F.col("l_partkey").alias("part")).distinct().join(c.variants, "part").select("chrom", "pos")
    return rounded(readers.look_up(readers.read_scores(spark, _studies(c)), sites).select("study", "chrom", "pos", "u"))


COV_SQL = """,
sit AS (SELECT study, chrom, part, pos, sum(dose) AS g FROM gt GROUP BY ALL),
joi AS (SELECT a.study, a.chrom, a.pos, b.pos AS pos2, sum(a.dose * b.dose) AS gg FROM gt a JOIN gt b ON a.study = b.study AND a.sample = b.sample AND a.chrom = b.chrom AND b.pos BETWEEN a.pos AND a.pos + 1000000 GROUP BY ALL),
trn AS (SELECT study, chrom, pos, -1.0 AS s FROM sco WHERE turned),
cvs AS (
  SELECT a.study, a.chrom, a.pos, b.pos AS pos2, (coalesce(gg, 0) - a.g * b.g / f.n) / f.sigma2 / f.n * coalesce(ta.s, 1.0) * coalesce(tb.s, 1.0) AS cov
  FROM sit a JOIN sit b ON a.study = b.study AND a.chrom = b.chrom AND b.pos BETWEEN a.pos AND a.pos + 1000000 JOIN fct f ON f.study = a.study
  LEFT JOIN joi j ON j.study = a.study AND j.chrom = a.chrom AND j.pos = a.pos AND j.pos2 = b.pos
  LEFT JOIN trn ta ON ta.study = a.study AND ta.chrom = a.chrom AND ta.pos = a.pos LEFT JOIN trn tb ON tb.study = a.study AND tb.chrom = a.chrom AND tb.pos = b.pos)
"""


@query("covariance_files", BASE + COV_SQL + "SELECT study, chrom, pos, pos2, round(cov, 9) + 0.0 AS cov FROM cvs")
def covariance_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance files of the dense, compact and six-column layouts, told apart by their headers."""
    return rounded(readers.read_cov(spark, _studies(Cohort(spark, sf_dir), True)), 9)


@query("covariance_region", BASE + COV_SQL + "SELECT study, chrom, pos, pos2, round(cov, 9) + 0.0 AS cov FROM cvs WHERE chrom = '5' AND pos >= 100000 AND pos2 <= 900000")
def covariance_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(readers.read_cov(spark, _studies(Cohort(spark, sf_dir), True), "chr5:100000-900000"), 9)


SINGLE = """
SELECT p.chrom, p.pos, p.ref, p.alt, p.n, round(ac / (2.0 * p.n), 6) AS af, d.direction, round(u / v, 6) AS effect, round(1 / sqrt(v), 6) AS effect_se, round(u * u / v, 6) AS chisq, {p} AS p
FROM poo p JOIN dir d USING (part)"""


@query("meta_from_files", BASE + SINGLE.format(p=p_sql("u * u / v")))
def meta_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The meta-analysis program over the studies' files."""
    run = programs.meta_run(spark, MetaOptions(**_lists(Cohort(spark, sf_dir))))
    return rounded(run.single.filter("ref <> '.'").select("chrom", "pos", "ref", "alt", "n", "af", "direction", "effect", "effect_se", "chisq", "p").withColumn("p", F.round("p", 9)), 6, ["p"])


def _group_lines(c: Cohort) -> DataFrame:
    """Group lines whose variants use all three separators."""
    v = F.concat(F.lit("chr"), F.col("chrom"), F.lit(":"), F.col("pos").cast("string"), F.when(F.col("part") % 2 == 0, "_").otherwise(":"), F.col("ref"), F.when(F.col("part") % 3 == 0, "/").otherwise(":"), F.col("alt"))
    return c.variants.groupBy("gene").agg(F.collect_list(v).alias("v")).select(F.concat(F.regexp_replace("gene", " ", "~"), F.lit("\t"), F.array_join("v", "  ")).alias("value"))


@query("gene_tests_from_files", GENES + "SELECT * FROM (" + " UNION ALL ".join(f"""
SELECT '{m}' AS method, replace(t.gene, ' ', '~') AS gene, num_var, round(wu / wvw, 6) AS effect, round(wu * wu / wvw, 6) AS chisq, {p_sql("wu * wu / wvw")} AS p FROM
 (SELECT gene, count(*) AS num_var, sum(u / ({w.format(f="af")})) AS wu FROM kep GROUP BY gene) t JOIN
 (SELECT gene, sum(CASE WHEN i = j THEN 1 ELSE 2 END * cov / ({w.format(f="fa")}) / ({w.format(f="fb")})) AS wvw FROM cov GROUP BY gene) b ON t.gene = b.gene""" for m, w in WEIGHTS.items()) + ")")  # fmt: skip
def gene_tests_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four burden tests by the program, from score, covariance and group files."""
    c = Cohort(spark, sf_dir)
    o = MetaOptions(**_lists(c, True), group_file=_text(_group_lines(c), "groups"), burden=True, mb=True, mab=True, bbeta=True)
    out = None
    for m, t in programs.meta_run(spark, o).tests.items():
        t = t.select(F.lit(m).alias("method"), "gene", "num_var", "effect", "chisq", F.round("p", 9).alias("p"))
        out = t if out is None else out.unionByName(t)
    return rounded(out, 6, ["p"])


GROUPS_SQL = "SELECT replace(gene, ' ', '~') AS gene, (row_number() OVER (PARTITION BY gene ORDER BY chrom, pos, part) - 1)::INTEGER AS ord, chrom, pos, ref, alt FROM var"


@query("group_file", BASE + GROUPS_SQL)
def group_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_groups(spark, _text(_group_lines(Cohort(spark, sf_dir)), "groups"))


@query("annotated_vcf", BASE + GROUPS_SQL.replace("FROM var", "FROM var WHERE part % 4 < 2"))
def annotated_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups from a VCF's annotations: variants that are nonsynonymous or stop gains; a group file is written of them and read again."""
    c = Cohort(spark, sf_dir)
    kind = F.element_at(F.array(F.lit("Nonsynonymous(x)"), F.lit("stop_gain"), F.lit("Synonymous"), F.lit("Intron")), (F.col("part") % 4 + 1).cast("int"))
    info = F.concat(F.lit("AC=1;ANNOFULL="), F.regexp_replace("gene", " ", "~"), F.lit("/T1:+:"), kind, F.lit("|OTHER/T2:-:Intron"))
    lines = c.variants.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", F.concat("alt", F.lit(",N")), F.lit("."), F.lit("."), info).alias("value"))
    path = fresh_path(spark, "groups")
    writers.write_groups(readers.read_annotated_groups(spark, _text(lines, "annotated"), ["nonsyn", "STOP"]), path)
    return readers.read_groups(spark, path)


@query("gene_map_file", BASE + """
SELECT replace(gene, ' ', '~') AS name, chrom, min(pos) AS start, max(pos + p_size)::INTEGER AS stop FROM var JOIN part ON p_partkey = part GROUP BY gene, chrom""")  # fmt: skip
def gene_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gene table of one line per variant, from its position to that and its part's size."""
    c = Cohort(spark, sf_dir)
    v = c.variants.join(c.table("part").select(F.col("p_partkey").alias("part"), "p_size"), "part")
    lines = v.select(F.concat_ws("\t", F.regexp_replace("gene", " ", "~"), F.lit("t"), F.concat(F.lit("chr"), F.col("chrom")), F.lit("+"), F.col("pos").cast("string"), (F.col("pos") + F.col("p_size")).cast("string")).alias("value"))
    other = spark.createDataFrame([("#name\tt\tchr1\t+\t1\t2",), ("LOST\tt\tUn_9\t+\t1\t2",)], "value string")
    m = readers.read_gene_map(spark, _text(lines.unionByName(other).coalesce(1), "gene-map"))
    return m.select("name", "chrom", "start", F.col("end").alias("stop"))


@query("condition_list", BASE + "SELECT chrom, pos, ref, alt FROM var")
def condition_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Cohort(spark, sf_dir).variants
    lines = v.groupBy((F.col("part") % 7).alias("g")).agg(F.array_join(F.collect_list(F.concat(F.concat_ws(":", F.concat(F.lit("chr"), "chrom"), F.col("pos").cast("string"), "ref", "alt"), F.lit("\tplain"))), " ").alias("value")).select("value")
    return readers.read_conditions(spark, _text(lines, "conditions"))


@query("panel_file", BASE + """
SELECT chrom, pos, ref, a.alt, round(part / 1e6 + a.k / 10.0, 8) AS first_af, round(part / 2e6 + a.k / 20.0, 8) AS second_af FROM
 (SELECT *, unnest([{'alt': alt, 'k': 0}, {'alt': 'N', 'k': 1}]) AS a FROM var)""")  # fmt: skip
def panel_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frequency panel with two alternative alleles a line and two populations."""
    v = Cohort(spark, sf_dir).variants
    af = lambda d, k: F.concat_ws(",", (F.col("part") / d).cast("string"), (F.col("part") / d + 1 / k).cast("string"))
    lines = v.select(F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.col("pos").cast("string"), F.lit("."), "ref", F.concat("alt", F.lit(",N")), F.lit("."), F.lit("."), af(1e6, 10.0), af(2e6, 20.0)).alias("value"))
    p = readers.read_panel(spark, _text(lines, "panel"))
    return p.select("chrom", "pos", "ref", "alt", F.round(F.col("af")[0], 8).alias("first_af"), F.round(F.col("af")[1], 8).alias("second_af"))


def _pedigree(c: Cohort) -> tuple[str, str]:
    """PED and DAT of all samples: a marker in two fields, a covariate, two traits, the first unknown for one sample in eleven."""
    s = c.samples.orderBy("sample")
    y = F.when(F.col("sample") % 11 == 0, "x").otherwise(F.col("y").cast("string"))
    fields = [F.lit("F"), F.col("sample").cast("string"), F.lit("0"), F.lit("0"), (1 + F.col("sample") % 2).cast("string"), F.lit("A"), F.when(F.col("is_case"), "C").otherwise("A"), F.col("population").cast("string"), y, F.col("is_case").cast("int").cast("string")]
    return _text(s.select(F.concat_ws(" ", *fields).alias("value")), "ped"), _put(c.spark, ["M 1:77", "C POP", "T QT", "T CASE"], "dat")


@query("pedigree_file", BASE + """
SELECT sample::VARCHAR AS pid, (1 + sample % 2)::INTEGER AS sex, population::DOUBLE AS pop, CASE WHEN sample % 11 = 0 THEN NULL ELSE round(y, 6) END AS qt, is_case, CASE WHEN is_case THEN 'A/C' ELSE 'A/A' END AS marker FROM smp""")  # fmt: skip
def pedigree_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = readers.read_pedigree(spark, *_pedigree(Cohort(spark, sf_dir)))
    names = readers.trait_names(spark, p, "QT/CASE")
    cases = readers.case_control(p, names[1])
    return p.join(cases, "pid").select("pid", "sex", F.col("covs")["POP"].alias("pop"), F.round(F.col("traits")["QT"], 6).alias("qt"), "is_case", F.col("markers")["1:77"].alias("marker"))


@query("trait_samples", BASE + """
SELECT sample::VARCHAR AS sample, round(y, 6) AS y, population::DOUBLE AS x FROM smp WHERE sample % 11 <> 0 AND sample IN (SELECT sample FROM gt)""")  # fmt: skip
def trait_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with genotypes and any trait, then those with the trait and its covariate."""
    from ..operators import samples

    c = Cohort(spark, sf_dir)
    screened = samples.screened(readers.read_pedigree(spark, *_pedigree(c)), c.carriers.select(F.col("sample").cast("string").alias("sample")))
    return samples.for_trait(screened, "QT", ["POP"]).select("sample", F.round("y", 6).alias("y"), F.col("xs")[0].alias("x"))


@query("kinship_file", BASE + "SELECT a.study, a.sample::VARCHAR AS a, b.sample::VARCHAR AS b, round(1 / (1.0 + abs(a.sample - b.sample)), 6) AS k FROM smp a JOIN smp b ON a.study = b.study")
def kinship_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lower triangle per study, written and read with both triangles."""
    c = Cohort(spark, sf_dir)
    out = None
    for k in range(STUDIES):
        s = c.samples.filter(F.col("study") == k).select("sample")
        names = [str(r["sample"]) for r in s.orderBy("sample").collect()]
        if not names:
            continue
        tasks = -(-len(names) * len(names) // writers.PAIRS)  # the samples are few rows, their pairs are many
        pairs = s.select(F.col("sample").alias("a")).repartition(tasks).join(s.select(F.col("sample").alias("b")), F.col("b") <= F.col("a"))
        path = fresh_path(spark, "kinship")
        writers.write_kinship(pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), (1 / (1.0 + F.abs(F.col("a") - F.col("b")))).alias("k")), names, path)
        part = readers.read_kinship(spark, path).select(F.lit(k).alias("study"), "a", "b", "k")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query("variant_list_file", BASE + "SELECT chrom, pos FROM var")
def variant_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Cohort(spark, sf_dir).variants.orderBy("chrom", "pos")
    return readers.read_variant_list(spark, _text(v.select(F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.col("pos").cast("string")).alias("value")).coalesce(1), "variants"))


def _vcf(c: Cohort, study: int) -> str:
    path = fresh_path(c.spark, f"study{study}-vcf")
    names = [str(r["sample"]) for r in c.samples.filter(F.col("study") == study).select("sample").orderBy("sample").collect()]
    g = c.carriers.filter(F.col("study") == study)
    writers.write_genotypes(g.select("chrom", "pos", "ref", "alt", F.col("sample").cast("string").alias("sample"), "dose"), names, path)
    return path


@query("vcf_file", BASE + "SELECT study, chrom, pos, ref, alt, sample::VARCHAR AS sample, dose FROM gt")
def vcf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carriers that every study's VCF names."""
    c, out = Cohort(spark, sf_dir), None
    for k in range(STUDIES):
        if c.sizes[k]:
            g = readers.read_genotypes(spark, _vcf(c, k), carriers=True).filter("dose > 0").select(F.lit(k).alias("study"), "chrom", "pos", "ref", "alt", "sample", "dose")
            out = g if out is None else out.unionByName(g)
    return out


@query("bcf_file", BASE + "SELECT study, chrom, pos, ref, alt, sample::VARCHAR AS sample, dose FROM gt")
def bcf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The carriers that every study's BCF files name."""
    c, out = Cohort(spark, sf_dir), None
    for k in range(STUDIES):
        if c.sizes[k]:
            path = f"{fresh_path(spark, f'study{k}')}.bcf"
            bcf.write_bcf(spark, _vcf(c, k), path)
            g = readers.read_genotypes(spark, path, carriers=True).filter("dose > 0").select(F.lit(k).alias("study"), "chrom", "pos", "ref", "alt", "sample", "dose")
            out = g if out is None else out.unionByName(g)
    return out


@query("score_store_region", BASE + """
SELECT study, chrom, pos, round(CASE WHEN turned THEN -u ELSE u END, 6) AS u, round(sqrt(v), 6) AS sqrt_v FROM sco
WHERE (chrom = '5' AND pos BETWEEN 100000 AND 900000) OR (chrom = '6' AND pos BETWEEN 1 AND 50000)""")  # fmt: skip
def score_store_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions of all studies' records, kept as a store; only files that can hold them are opened."""
    path = fresh_path(spark, "score-store")
    store.write_store(readers.read_scores(spark, _studies(Cohort(spark, sf_dir))), path, 2000)
    return rounded(store.read_region(spark, path, "5:100000-900000", "chr6:1-50000").select("study", "chrom", "pos", "u", "sqrt_v"))


@query("score_store_sites", BASE + "SELECT study, chrom, pos, round(CASE WHEN turned THEN -u ELSE u END, 6) AS u FROM sco WHERE part IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7)")
def score_store_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of every order's seventh item, looked up in a store."""
    c, path = Cohort(spark, sf_dir), fresh_path(spark, "score-store")
    store.write_store(readers.read_scores(spark, _studies(c)), path, 2000)
    sites = c.table("lineitem").filter("l_linenumber = 7").select(F.col("l_partkey").alias("part")).distinct().join(c.variants, "part").select("chrom", "pos")
    return rounded(store.read_sites(spark, path, sites).select("study", "chrom", "pos", "u"))


@query("covariance_store_region", BASE + COV_SQL + "SELECT study, chrom, pos, pos2, round(cov, 9) + 0.0 AS cov FROM cvs WHERE chrom = '5' AND pos >= 100000 AND pos <= 900000")
def covariance_store_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of all studies' covariances, kept as a store."""
    path = fresh_path(spark, "cov-store")
    store.write_store(readers.read_cov(spark, _studies(Cohort(spark, sf_dir), True)), path, 20_000)
    return rounded(store.read_region(spark, path, "5:100000-900000"), 9)


@query("study_program", BASE + f""",
s2 AS (SELECT * FROM smp WHERE study = 1 AND sample % 11 <> 0 AND sample IN (SELECT sample FROM gt)),
f2 AS (SELECT count(*) AS n, avg(y) AS m, var_pop(y) AS sigma2 FROM s2),
x AS (
  SELECT g.chrom, g.pos, g.ref, g.alt, sum(dose) AS g, sum(dose * dose) AS gg, sum(dose * (s.y - f2.m)) AS rg, count(*) FILTER (dose = 1) AS n_het, count(*) FILTER (dose = 2) AS n_alt, any_value(f2.n) AS n, any_value(f2.sigma2) AS sigma2
  FROM gt g JOIN s2 s ON s.sample = g.sample CROSS JOIN f2 GROUP BY ALL),
w AS (SELECT *, rg / sigma2 AS u, (gg - g * g / n) / sigma2 AS v FROM x)
SELECT chrom, pos, ref, alt, n::INTEGER AS n_informative, (n - n_het - n_alt)::INTEGER AS n_ref, n_het::INTEGER AS n_het, n_alt::INTEGER AS n_alt, round(g / (2.0 * n), 6) AS all_af, round(u, 6) AS u, round(sqrt(v), 6) AS sqrt_v,
       round(u / v, 7) AS effect, {p_sql("u * u / v")} AS p FROM w""")  # fmt: skip
def study_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One study's program, from pedigree and VCF to its score file, which is read back."""
    c = Cohort(spark, sf_dir)
    ped, dat = _pedigree(c)
    run = programs.study_runs(spark, WorkerOptions(ped=ped, dat=dat, vcf=_vcf(c, 1), trait_name="QT", use_covariates=False))[0]
    scores, _ = programs.write_study(run, fresh_path(spark, "study"), digits=17)
    s = readers.read_scores(spark, readers.read_study_list(spark, _put(spark, [scores], "list")))
    s = s.filter("n_het + n_alt > 0")  # a study's VCF also lists sites whose carriers fell out
    return rounded(s.select("chrom", "pos", "ref", "alt", "n_informative", "n_ref", "n_het", "n_alt", "all_af", "u", "sqrt_v", F.round("effect", 7).alias("effect"), F.round("p", 9).alias("p")), 6, ["p", "effect"])


COND = """,
cm AS (SELECT min(part) AS part FROM poo WHERE part % 22 = 1),
jcm AS (SELECT a.study, a.part, sum(a.dose * b.dose) AS gg FROM gt a JOIN gt b ON a.study = b.study AND a.sample = b.sample WHERE b.part = (SELECT part FROM cm) GROUP BY ALL),
gx AS (
  SELECT s.study, s.part, s.u, s.v, c.part IS NOT NULL AS has, CASE WHEN c.part IS NOT NULL AND s.chrom = c.chrom AND abs(s.pos - c.pos) <= 1000000 THEN (coalesce(j.gg, 0) - s.g * c.g / s.n) / s.sigma2 ELSE 0 END AS gx, c.u AS cu, c.v AS cv
  FROM acc s LEFT JOIN sco c ON c.study = s.study AND c.part = (SELECT part FROM cm) LEFT JOIN jcm j ON j.study = s.study AND j.part = s.part),
kc AS (SELECT k.gene, k.part, any_value(k.ord) AS ord, sum(x.u - CASE WHEN has THEN gx * cu / cv ELSE 0 END) AS uc FROM kep k JOIN gx x ON x.part = k.part GROUP BY k.gene, k.part),
lo AS (SELECT pr.gene, pr.i, pr.j, sum(CASE WHEN a.has THEN a.gx * b.gx / a.cv ELSE 0 END) AS lost FROM pr JOIN gx a ON a.part = pr.pa JOIN gx b ON b.part = pr.pb AND a.study = b.study GROUP BY ALL),
cc AS (SELECT gene, i, j, cov - coalesce(lost, 0) AS cov FROM cov LEFT JOIN lo USING (gene, i, j))
"""


@query("gene_burden_conditional", GENES + COND + """
SELECT replace(t.gene, ' ', '~') AS gene, num_var, round(wu, 4) AS wu, round(wvw, 3) AS wvw FROM
 (SELECT gene, count(*) AS num_var, sum(uc) AS wu FROM kc GROUP BY gene) t JOIN (SELECT gene, sum(CASE WHEN i = j THEN 1 ELSE 2 END * cov) AS wvw FROM cc GROUP BY gene) b ON t.gene = b.gene""")  # fmt: skip
def gene_burden_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burden given a variant, by the program: condition list, score, covariance and group files."""
    c = Cohort(spark, sf_dir)
    first = c.pooled.join(c.variants.select("chrom", "pos", "part", F.col("ref").alias("r"), F.col("alt").alias("a")), ["chrom", "pos"]).filter("part % 22 = 1 and v > 0").orderBy("part").limit(1)
    lines = first.select(F.concat_ws(":", "chrom", F.col("pos").cast("string"), "r", "a").alias("value"))
    o = MetaOptions(**_lists(c, True), group_file=_text(_group_lines(c), "groups"), condition=_text(lines, "condition"), burden=True)
    t = programs.meta_run(spark, o).tests["burden conditional"]
    return t.select("gene", "num_var", F.round("wu", 4).alias("wu"), F.round("wvw", 3).alias("wvw"))


@query("gene_files_conditional", GENES + COND + f""",
t AS (SELECT gene, count(*) AS num_var, sum(u) AS wu FROM kep GROUP BY gene), b AS (SELECT gene, sum(CASE WHEN i = j THEN 1 ELSE 2 END * cov) AS wvw FROM cov GROUP BY gene),
tc AS (SELECT gene, sum(uc) AS wu FROM kc GROUP BY gene), bc AS (SELECT gene, sum(CASE WHEN i = j THEN 1 ELSE 2 END * cov) AS wvw FROM cc GROUP BY gene)
SELECT replace(t.gene, ' ', '~') AS gene, num_var::INTEGER AS num_var, round(t.wu / b.wvw, 6) + 0.0 AS effect, round({p_sql("t.wu * t.wu / b.wvw")}, 6) AS p,
       round(tc.wu / bc.wvw, 6) + 0.0 AS cond_effect, round({p_sql("tc.wu * tc.wu / bc.wvw")}, 6) AS cond_p
FROM t JOIN b ON b.gene = t.gene JOIN tc ON tc.gene = t.gene JOIN bc ON bc.gene = t.gene WHERE t.gene <> (SELECT gene FROM var WHERE part = (SELECT part FROM cm))""")  # fmt: skip
def gene_files_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The burden file of a conditional run, its values read back; the gene of the condition variant itself is left out."""
    c = Cohort(spark, sf_dir)
    first = c.pooled.join(c.variants.select("chrom", "pos", "part", "gene", F.col("ref").alias("r"), F.col("alt").alias("a")), ["chrom", "pos"]).filter("part % 22 = 1 and v > 0").orderBy("part").limit(1)
    lines = first.select(F.concat_ws(":", "chrom", F.col("pos").cast("string"), "r", "a").alias("value"))
    o = MetaOptions(**_lists(c, True), group_file=_text(_group_lines(c), "groups"), condition=_text(lines, "condition"), burden=True, prefix=fresh_path(spark, "meta"))
    path = next(p for p in programs.write_meta(programs.meta_run(spark, o), o, digits=17) if p.endswith("burden.results"))
    t = spark.read.text(path).filter("not startswith(value, '#')").select(F.split("value", "\t").alias("t"))
    value = lambda i: F.round(F.get("t", i).cast("double"), 6) + F.lit(0.0)
    rows = t.select(F.get("t", 0).alias("gene"), F.get("t", 1).cast("int").alias("num_var"), value(6).alias("effect"), value(7).alias("p"), value(8).alias("cond_effect"), value(9).alias("cond_p"))
    return rows.join(first.select(F.regexp_replace("gene", " ", "~").alias("gene")), "gene", "left_anti")


@query("gene_burden_exact", GENES + EXACT + """,
nf AS (SELECT s.part, s.study, s.n, CASE WHEN s.bad OR s.poor THEN (CASE WHEN s.turned THEN 1 - g / (2 * s.n) ELSE g / (2 * s.n) END) WHEN f.site_turned THEN 1 - g / (2 * s.n) ELSE g / (2 * s.n) END AS f FROM sco s JOIN fst f USING (part)),
xk AS (
  SELECT o.gene, o.ord AS ord, p.part, p.site_turned, e.nf / e.en AS fm, e.r / (e.en - 1) AS r, z.us - 2 * (e.nf / e.en) * e.nd + 2 * e.nfd AS ux
  FROM ord o JOIN poo p ON p.part = o.part JOIN ex e ON e.part = p.part JOIN us z ON z.part = p.part WHERE NOT p.third AND e.r / (e.en - 1) * (z.vs + 4 * e.nff - 4 * e.en * (e.nf / e.en) * (e.nf / e.en)) > 0),
xo AS (SELECT gene, ord, part, fm, r, site_turned, CASE WHEN site_turned THEN 1 - fm ELSE fm END AS fo, CASE WHEN site_turned THEN -ux ELSE ux END AS uo FROM xk),
xf AS (SELECT *, CASE WHEN fo > 0.5 THEN -1 ELSE 1 END * uo AS u, (CASE WHEN fo > 0.5 THEN -1 ELSE 1 END) * (CASE WHEN site_turned THEN -1 ELSE 1 END) AS sgn, least(fo, 1 - fo) AS maf FROM xo),
xs AS (SELECT * FROM xf WHERE maf > 0 AND maf <= 0.05),
xp AS (SELECT a.gene, a.ord AS i, b.ord AS j, a.part AS pa, b.part AS pb, a.r, a.fm AS fa, b.fm AS fb, a.sgn * b.sgn AS sgn, CASE WHEN a.site_turned THEN -1 ELSE 1 END AS ta, CASE WHEN b.site_turned THEN -1 ELSE 1 END AS tb
       FROM xs a JOIN xs b ON a.gene = b.gene AND a.ord <= b.ord),
xg AS (SELECT x.study, x.part AS pa, z.part AS pb, sum(x.dose * z.dose) AS gg FROM gt x JOIN gt z ON x.study = z.study AND x.sample = z.sample WHERE (x.part, z.part) IN (SELECT pa, pb FROM xp) GROUP BY ALL),
xc AS (
  SELECT xp.gene, xp.i, xp.j, sum(xp.sgn * xp.r * (xp.ta * xp.tb * (coalesce(xg.gg, 0) - a.g * b.g / a.n) + 4 * a.n * (na.f * nb.f - xp.fa * xp.fb))) AS cov
  FROM xp JOIN acc a ON a.part = xp.pa JOIN acc b ON b.part = xp.pb AND a.study = b.study JOIN nf na ON na.part = a.part AND na.study = a.study JOIN nf nb ON nb.part = b.part AND nb.study = b.study
  LEFT JOIN xg ON xg.study = a.study AND xg.pa = xp.pa AND xg.pb = xp.pb WHERE abs(b.pos - a.pos) <= 1000000 GROUP BY xp.gene, xp.i, xp.j)
SELECT replace(t.gene, ' ', '~') AS gene, num_var, round(wu, 4) AS wu, round(wvw, 2) AS wvw FROM
 (SELECT gene, count(*) AS num_var, sum(u) AS wu FROM xs GROUP BY gene) t JOIN (SELECT gene, sum(CASE WHEN i = j THEN 1 ELSE 2 END * cov) AS wvw FROM xc GROUP BY gene) b ON t.gene = b.gene""")  # fmt: skip
def gene_burden_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burden by the exact method, U, V and covariances adjusted; here all files have the preface that tells the trait's mean and variance."""
    c = Cohort(spark, sf_dir)
    o = MetaOptions(**_lists(c, True, ["native"] * STUDIES), group_file=_text(_group_lines(c), "groups"), burden=True, use_exact=True)
    t = programs.meta_run(spark, o).tests["burden"]
    return t.select("gene", "num_var", F.round("wu", 4).alias("wu"), F.round("wvw", 2).alias("wvw"))


@query("largest_n", BASE + "SELECT max(n)::BIGINT AS n FROM poo")
def largest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most samples of any variant."""
    return spark.createDataFrame([(pooling.largest_n(Cohort(spark, sf_dir).pooled.filter("v > 0")),)], "n long")


@query("pooled_vcf", BASE + """
SELECT p.chrom, p.pos, p.ref, p.alt, 'N=' || p.n || ';AF=' || printf('%g', (ac / (2.0 * p.n))::DOUBLE) || ';DIRECTION=' || d.direction AS info FROM poo p JOIN dir d USING (part)""")  # fmt: skip
def pooled_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled variants' VCF, read back."""
    c = Cohort(spark, sf_dir)
    path = fresh_path(spark, "pooled-vcf")
    writers.write_vcf(c.pooled.filter("v > 0"), path)
    return readers.read_vcf_lines(spark, path).select("chrom", "pos", "ref", F.col("alts")[0].alias("alt"), "info")


@query("result_files", BASE + "SELECT p.chrom, p.pos, p.ref, p.alt, p.n, d.direction, 11 AS fields FROM poo p JOIN dir d USING (part)")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-variant result file of the program, its lines without header and footer."""
    o = MetaOptions(**_lists(Cohort(spark, sf_dir)), prefix=fresh_path(spark, "meta"))
    path = programs.write_meta(programs.meta_run(spark, o), o)[0]
    t = spark.read.text(path).filter("not startswith(value, '#')").select(F.split("value", "\t").alias("t")).filter("t[2] <> '.'")  # a site whose records all fell out has no alleles
    return t.select(F.col("t")[0].alias("chrom"), F.col("t")[1].cast("long").alias("pos"), F.col("t")[2].alias("ref"), F.col("t")[3].alias("alt"), F.col("t")[4].cast("long").alias("n"), F.col("t")[6].alias("direction"), F.size("t").alias("fields"))


@query("gene_result_files", GENES + """,
k AS (SELECT gene, count(*) AS n, string_agg(kep.chrom || ':' || kep.pos || ':' || v.ref || ':' || v.alt, ';' ORDER BY ord) AS vars FROM kep JOIN var v USING (part, gene) GROUP BY gene),
t AS (SELECT gene FROM cov GROUP BY gene)
SELECT m.file, replace(gene, ' ', '~') AS gene, n::INTEGER AS num_var, vars, m.fields FROM k JOIN t USING (gene) CROSS JOIN (VALUES ('burden', 11), ('MB', 11), ('VT', 13), ('SKAT', 12)) AS m(file, fields)""")  # fmt: skip
def gene_result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files of four gene tests in the long layout: genes, variants, and the number of fields (VT lines end in a tab)."""
    c = Cohort(spark, sf_dir)
    o = MetaOptions(**_lists(c, True), group_file=_text(_group_lines(c), "groups"), burden=True, mb=True, vt=True, skat=True, long_output=True, tabulate_hits=True, prefix=fresh_path(spark, "meta"))
    out = None
    for path in programs.write_meta(programs.meta_run(spark, o), o):
        name = path.rpartition(".meta.")[2].removesuffix(".results").removesuffix("_")
        if name in ("burden", "MB", "VT", "SKAT"):
            t = spark.read.text(path).filter("not startswith(value, '#')").select(F.split("value", "\t").alias("t"))
            t = t.select(F.lit(name).alias("file"), F.col("t")[0].alias("gene"), F.col("t")[1].cast("int").alias("num_var"), F.col("t")[2].alias("vars"), F.size("t").alias("fields"))
            out = t if out is None else out.unionByName(t)
    return out
