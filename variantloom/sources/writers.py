"""Writers: result tables as the text files that analysts exchange, or as Parquet by chromosome."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 4_000_000  # calls of one file of a VCF
PAIRS = 1_000_000  # of one file of a kinship matrix


def short_number(c: Column, digits: int = 6) -> Column:
    """C's ``%g``: six significant digits (or ``digits``), no trailing zeros; null is ``NA``. Runs in Arrow batches, in sinks only."""
    @F.pandas_udf("string")
    def show(x: pd.Series) -> pd.Series:
        return x.map(lambda v: "NA" if pd.isna(v) else f"{v:.{digits}g}")

    return show(c.cast("double"))


def short_list(c: Column, digits: int = 6) -> Column:
    """A list of numbers as :func:`short_number` writes each, joined by ``,``."""
    @F.pandas_udf("string")
    def show(x: pd.Series) -> pd.Series:
        return x.map(lambda vs: "NA" if vs is None else ",".join("NA" if pd.isna(v) else f"{v:.{digits}g}" for v in vs))

    return show(c)


def text_rows(df: DataFrame, end: str = "", digits: int = 6) -> DataFrame:
    """One tab-separated line per row: doubles as ``%g``, null as ``NA``, arrays joined by ``,`` with their doubles as ``%g`` too."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        if kind in ("double", "float"):
            cols.append(short_number(c, digits))
        elif kind == "array<double>":
            cols.append(short_list(c, digits))
        elif kind.startswith("array"):
            cols.append(F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("NA")))
        else:
            cols.append(F.coalesce(c.cast("string"), F.lit("NA")))
    return df.select(F.concat(F.concat_ws("\t", *cols), F.lit(end)).alias("value"))


def write_lines(body: DataFrame, path: str, head: list[str] = (), foot: list[str] = (), compression: str | None = None) -> None:
    """A folder of text files which read in the order of their names are ``head``, the rows of ``body`` (column ``value``) as they stand, and ``foot``.

    ``body`` is written by all its tasks; only head and foot, a few lines, are files of their own.
    """
    spark = body.sparkSession
    packed = (lambda w: w.option("compression", compression)) if compression else (lambda w: w)
    packed(body.write).text(path)
    for lines, name in ((head, "0-head"), (foot, "z-foot")):
        if lines:
            aside = f"{path}.{name}"
            packed(spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write).text(aside)
            _move_part(spark, aside, f"{path}/{name}")


def _move_part(spark, folder: str, to: str) -> None:
    """The only text file of ``folder`` becomes ``to`` (with its ending); the folder goes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    ending = part.getName().partition(".")[2]
    fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(f"{to}.{ending}"))
    fs.delete(at, True)


def write_table(df: DataFrame, path: str, header: list[str] = (), footer: list[str] = (), names: list[str] | None = None, end: str = "", order: list | None = None, single: bool = True, digits: int = 6) -> None:
    """A text table: ``##`` header lines, a ``#`` line of column names, the rows in ``order``, ``#`` footer lines.

    ``single`` makes one file, for short tables; without it the rows are sorted by ranges and
    written by all tasks (see :func:`write_lines`), as the programs do.
    """
    rows = df.orderBy(*order) if order else df
    body = text_rows(rows, end, digits)
    head = [f"##{x}" for x in header] + ["#" + "\t".join(names or df.columns) + end]
    foot = [f"#{x}" for x in footer]
    if single:
        lines = lambda x: df.sparkSession.createDataFrame([(v,) for v in x], "value string").coalesce(1)
        whole = lines(head).union(body.coalesce(1))
        (whole.union(lines(foot)) if foot else whole).coalesce(1).write.text(path)
    else:
        write_lines(body, path, head, foot)


def single_variant_header(studies: int, samples: int) -> list[str]:
    return ["ProgramName=SingleVariantMeta", f"TotalStudies={studies}", f"TotalSamples={samples}"]


def group_header() -> list[str]:
    """All gene-level burden files name the method Burden."""
    return ["Method=Burden"]


def write_vcf(pooled: DataFrame, path: str) -> None:
    """Pooled variants as a VCF with N, AF and direction in INFO."""
    info = F.concat(F.lit("N="), F.col("n"), F.lit(";AF="), short_number(F.col("af")), F.lit(";DIRECTION="), F.col("direction"))
    rows = pooled.select("chrom", F.col("pos").cast("string"), F.lit(".").alias("id"), "ref", "alt", F.lit(".").alias("qual"), F.lit(".").alias("filter"), info.alias("info"))
    head = ["##fileformat=VCFv4.1", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    write_lines(rows.select(F.concat_ws("\t", *rows.columns).alias("value")), path, head)


SCORE_NAMES = ["CHROM", "POS", "REF", "ALT", "N_INFORMATIVE", "FOUNDER_AF", "ALL_AF", "INFORMATIVE_ALT_AC", "CALL_RATE", "HWE_PVALUE", "N_REF", "N_HET", "N_ALT", "U_STAT", "SQRT_V_STAT", "ALT_EFFSIZE", "PVALUE"]
CASE_NAMES = ["caseAC", "controlAC"]


def write_scores(scores: DataFrame, path: str, samples: int, trait: str, summary: dict, layout: str = "native", digits: int = 6, variances: dict | None = None) -> None:
    """A study's score file: preface with the trait's five numbers, mean and variance, column names, records in chromosome order.

    ``variances`` (name to value) of a mixed model get a preface line each.

    ``scores`` has the columns of the native layout (see readers.NATIVE_SCORE), and case_ac and
    control_ac if they are known; the rvtests layout has no preface and one frequency.
    """
    from ..operators.pooling import chrom_order
    from .readers import NATIVE_SCORE, RVTESTS_SCORE

    columns, names = (NATIVE_SCORE, SCORE_NAMES) if layout == "native" else (RVTESTS_SCORE, [n for n in SCORE_NAMES if n not in ("FOUNDER_AF",)])
    if "case_ac" in scores.columns and layout == "native":
        columns, names = [*columns, "case_ac", "control_ac"], [*names, *CASE_NAMES]
    keys = ("min", "q25", "median", "q75", "max", "mean", "variance")
    row = "\t".join([trait, *(f"{summary[k]:.{digits}g}" for k in keys)])
    head = [f"AnalyzedSamples={samples}", "TraitSummaries\tmin\t25th\tmedian\t75th\tmax\tmean\tvariance", row]
    head += [f"{name}\t{value:.{digits}g}" for name, value in (variances or {}).items()]
    body = scores.select(*columns)
    order = [*chrom_order(), "pos"]
    if layout == "native":
        write_table(body, path, head, names=names, order=order, single=False, digits=digits)
    else:
        write_lines(text_rows(body.orderBy(*order), digits=digits), path, ["\t".join(names)])


def write_cov(cov: DataFrame, path: str, layout: str = "dense") -> None:
    """One study's covariances (chrom, pos, pos2, cov): ``dense``, ``compact`` or ``rvtests`` layout, in chromosome and position order."""
    if layout == "compact":
        rows, names = compact_cov_rows(cov, digits=None, floor=0.0), ["CHROM", "CURRENT_POS", "EXP", "COV_MATRICES"]
    else:
        rows, names = dense_cov_rows(cov), ["CHROM", "CURRENT_POS", "MARKERS_IN_WINDOW", "COV_MATRICES"]
    if layout == "rvtests":
        partners = F.split(F.regexp_replace("markers_in_window", ",$", ""), ",")
        rows = rows.select("chrom", "current_pos", F.element_at(partners, -1).alias("end"), F.size(partners).alias("n"), "markers_in_window", "cov_matrices")
        names = ["CHROM", "START_POS", "END_POS", "NUM_MARKER", "MARKER_POS", "COV"]
    write_table(rows, path, names=names, single=False)


def write_genotypes(genotypes: DataFrame, samples: list[str], path: str) -> None:
    """A VCF of GT calls from rows (chrom, pos, ref, alt, sample, dose): samples without a row are 0/0, null doses ./. .

    Its files are compressed, as nearly all calls are alike, and hold about ``CELLS`` calls each.
    """
    from ..operators.pooling import chrom_order

    call = F.when(F.col("dose").isNull(), "./.").when(F.col("dose") >= 2, "1/1").when(F.col("dose") >= 1, "0/1").otherwise("0/0")
    order = genotypes.sparkSession.createDataFrame(list(enumerate(samples)), "i int, sample string")  # the header names them all, too
    told = genotypes.withColumn("c", call).join(F.broadcast(order), "sample", "left")
    tasks = max(1, -(-genotypes.select("chrom", "pos", "ref", "alt").distinct().count() * len(samples) // CELLS))
    rows = told.groupBy("chrom", "pos", "ref", "alt").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "c")))).alias("calls"))
    # the samples between two carriers are one repeated text
    before = lambda k: F.coalesce(F.get("calls", k - 1)["i"], F.lit(-1))
    gap = lambda x, k: F.when(x["i"] == before(k), F.raise_error(F.lit("two calls of one sample")).cast("int")).otherwise(x["i"] - before(k) - 1)
    named = F.array_join(F.transform("calls", lambda x, k: F.concat(F.repeat(F.lit("0/0\t"), gap(x, k)), x["c"], F.lit("\t"))), "")
    whole = F.concat(named, F.repeat(F.lit("0/0\t"), F.lit(len(samples) - 1) - F.coalesce(F.get("calls", F.size("calls") - 1)["i"], F.lit(-1))))
    every = F.expr("substring(whole, 1, length(whole) - 1)")
    fixed = [F.col("chrom"), F.col("pos").cast("string"), F.lit("."), F.col("ref"), F.col("alt"), F.lit("."), F.lit("."), F.lit("."), F.lit("GT")]
    order = [*chrom_order(), "pos"]
    body = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("whole", whole).select(F.concat_ws("\t", *fixed, every).alias("value"))
    head = ["##fileformat=VCFv4.1", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    write_lines(body, path, head, compression="gzip")


GENE_NAMES = ["GROUPNAME", "NUM_VAR", "VARs", "MAFs", "SINGLEVAR_EFFECTs", "SINGLEVAR_PVALUEs", "AVG_AF", "MIN_AF", "MAX_AF"]


def gene_table(result: DataFrame, summary: DataFrame, method: str, long_output: bool = False, given: DataFrame | None = None) -> tuple[DataFrame, list[str], str]:
    """(rows, column names, line end) of a gene test's result file; ``given``, the test given the condition variants, adds its columns.

    ``summary`` is genes.gene_summary with the single variants' p-values as ``pvalues``. Short
    files leave out the variants' frequencies, effects and p-values; VT lines end in a tab.
    """
    s = summary.select("gene", "num_var", "vars", "mafs", "effects", "pvalues", "avg_af", "min_af", "max_af")
    r = result.withColumnRenamed("gene", "r_gene")
    own = {"VT": [("vt_effect", "EFFECT_SIZE"), ("vt_cutoff", "MAF_CUTOFF"), ("vt_p", "PVALUE")], "SKAT": [("q", "STATISTICS"), ("p_davies", "PVALUE_DAVIES"), ("p_liu", "PVALUE_LIU")]}.get(method, [("effect", "EFFECT_SIZE"), ("p", "PVALUE")])
    j = s.join(r.select("r_gene", *[c for c, _ in own]), F.col("gene") == F.col("r_gene"))
    more = []
    if given is not None:
        told = {"VT": ["EFFECT_SIZE", "MAF_CUTOFF", "COND_PVALUE"], "SKAT": ["COND_STATISTICS", "COND_PVALUE_DAVIES", "COND_PVALUE_LIU"]}.get(method, ["COND_EFFSIZE", "COND_PVALUE"])
        more = [(f"given_{c}", n) for (c, _), n in zip(own, told)]
        j = j.join(given.select(F.col("gene").alias("given_gene"), *[F.col(c).alias(f"given_{c}") for c, _ in own]), F.col("gene") == F.col("given_gene"), "left")
    first = s.columns if long_output else [c for c in s.columns if c not in ("mafs", "effects", "pvalues")]
    names = GENE_NAMES if long_output else [n for n in GENE_NAMES if n not in ("MAFs", "SINGLEVAR_EFFECTs", "SINGLEVAR_PVALUEs")]
    return j.select(*first, *[c for c, _ in own + more]), [*names, *[n for _, n in own + more]], "\t" if method == "VT" and not more else ""


HIT_NAMES = ["GENE", "METHOD", "GENE_PVALUE", "MAF_CUTOFF", "ACTUAL_CUTOFF", "VARS", "MAFS", "EFFSIZES", "PVALUES"]


def hit_table(result: DataFrame, summary: DataFrame, method: str, cutoff: float, maf: float) -> tuple[DataFrame, list[str]]:
    """(rows, column names) of the table of genes whose p is under ``cutoff``, a row per variant; SKAT's has both p-values."""
    p = {"VT": ["vt_p"], "SKAT": ["p_davies", "p_liu"]}.get(method, ["p"])
    r = result.withColumnRenamed("gene", "r_gene").filter(F.col(p[0]) < cutoff)
    actual = F.col("vt_cutoff") if method == "VT" else F.col("max_af")
    j = summary.join(r, F.col("gene") == F.col("r_gene")).withColumn("v", F.explode(F.arrays_zip(F.split("vars", ";").alias("name"), F.col("mafs").alias("maf"), F.col("effects").alias("eff"), F.col("pvalues").alias("pv"))))
    names = HIT_NAMES if len(p) == 1 else [*HIT_NAMES[:2], "GENE_PVALUE_DAVIES", "GENE_PVALUE_LIU", *HIT_NAMES[3:]]
    return j.select("gene", F.lit(method).alias("method"), *p, F.lit(maf).alias("maf_cutoff"), actual.alias("actual"), F.col("v.name").alias("var"), F.col("v.maf").alias("maf"), F.col("v.eff").alias("eff"), F.col("v.pv").alias("pv")), names


def _cov_lines(cov: DataFrame, partner: str) -> DataFrame:
    """chrom, pos, x (structs of ``partner`` and cov, partners ascending): a row per line, in the file's order.

    The pairs are dealt by ranges of that order before they become lists, so that numbers travel
    once and lines never do.
    """
    from ..operators.pooling import chrom_order

    order = [*chrom_order(), "pos"]
    # the range must be of columns that the lists are grouped by
    keyed = cov.withColumn("number", F.col("chrom").try_cast("int"))
    dealt = keyed.repartitionByRange(F.col("number").asc_nulls_last(), F.col("chrom").asc(), F.col("pos").asc())
    lists = dealt.groupBy("number", "chrom", "pos").agg(F.sort_array(F.collect_list(F.struct(partner, "cov"))).alias("x"))
    return lists.sortWithinPartitions(*order).select("chrom", "pos", "x")


def dense_cov_rows(cov: DataFrame) -> DataFrame:
    """chrom, current_pos, markers_in_window, cov_matrices in file order: comma lists with a trailing comma, partners ascending."""
    join = lambda c: F.concat(F.array_join(c, ","), F.lit(","))
    text = lambda c: join(F.col("x")[c].cast("array<string>"))
    return _cov_lines(cov, "pos2").select("chrom", F.col("pos").alias("current_pos"), text("pos2").alias("markers_in_window"), text("cov").alias("cov_matrices"))


def compact_cov_rows(cov: DataFrame, digits: int | None = 3, floor: float = 0.01) -> DataFrame:
    """chrom, current_pos, exp, cov_matrices in file order: mantissas of one shared exponent; those under ``floor`` of the row's largest are left out and the next one tells its offset. Without ``digits`` mantissas are whole."""
    from ..operators.ranks import running

    row = running(cov.select("chrom", "pos").distinct(), ["chrom"], ["pos"], before="row").drop("total")
    partner = row.select("chrom", F.col("pos").alias("pos2"), F.col("row").alias("row2"))
    placed = cov.join(row, ["chrom", "pos"]).join(partner, ["chrom", "pos2"])
    lines = _cov_lines(placed.select("chrom", "pos", (F.col("row2") - F.col("row")).alias("offset"), "cov"), "offset")
    lines = lines.withColumn("top", F.array_max(F.transform("x", lambda v: F.abs(v["cov"])))).withColumn("exp", F.when(F.col("top") > 0, F.floor(F.log10("top"))).otherwise(0).cast("int"))
    lines = lines.withColumn("scale", F.pow(F.lit(10.0), F.col("exp"))).withColumn("x", F.filter("x", lambda v: F.abs(v["cov"]) >= floor * F.col("top"))).filter(F.size("x") > 0)
    scaled = lambda v: v["cov"] / F.col("scale")
    mantissa = lambda v: (scaled(v) if digits is None else F.round(scaled(v), digits)).cast("string")
    follows = lambda v, k: F.coalesce(F.get("x", k - 1)["offset"], F.lit(-1)) == v["offset"] - 1
    token = F.transform("x", lambda v, k: F.when(follows(v, k), mantissa(v)).otherwise(F.concat(mantissa(v), F.lit(":"), v["offset"].cast("string"))))
    return lines.select("chrom", F.col("pos").alias("current_pos"), "exp", F.array_join(token, ",").alias("cov_matrices"))


def write_by_chrom(df: DataFrame, path: str) -> None:
    """Parquet by chromosome, sorted by position: range reads skip row groups by their bounds."""
    df.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.partitionBy("chrom").parquet(path)


def write_kinship(kinship: DataFrame, samples: list[str], path: str) -> None:
    """The ids' line, then the lower triangle by rows, in files of about ``PAIRS`` pairs. A pair travels once; a row of the triangle is one record."""
    spark = kinship.sparkSession
    order = spark.createDataFrame(list(enumerate(samples)), "i int, s string")  # the first line names them all, too
    a, b = F.broadcast(order.toDF("ia", "a")), F.broadcast(order.toDF("ib", "b"))
    tasks = max(1, -(-len(samples) * (len(samples) + 1) // (2 * PAIRS)))
    pairs = kinship.join(a, "a").join(b, "b").filter("ib <= ia").select("ia", "ib", "k").repartitionByRange(tasks, "ia")
    rows = pairs.groupBy("ia").agg(F.array_sort(F.collect_list(F.struct("ib", "k"))).alias("x"))
    body = rows.sortWithinPartitions("ia").select(F.array_join(F.transform("x", lambda v: v["k"].cast("string")), " ").alias("value"))
    write_lines(body, path, [" ".join(samples)], compression="gzip")


def write_groups(groups: DataFrame, path: str) -> None:
    """A gene and its variants per line."""
    variant = F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt")
    lists = groups.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("ord", variant.alias("v")))).alias("x"))
    lists.select(F.concat_ws("\t", "gene", F.array_join(F.transform("x", lambda v: v["v"]), "\t")).alias("value")).write.text(path)
