"""Reports and small helpers: who falls out of a study and why, bands, files by chromosome, top hits, columns of conditional tests, options."""

import math

import pytest
from pyspark.sql import functions as F

from variantloom.config import MetaOptions, OptionError
from variantloom.operators import annotate, kinship, samples
from variantloom.sources import writers


def test_missing_samples_and_why(spark):
    traits = "map<string,double>"
    people = spark.createDataFrame([("F", "a", {"T": 1.0}), ("F", "b", {"T": None}), ("F", "c", {"T": 2.0}), ("F", "d", {"T": None})], f"famid string, pid string, traits {traits}")
    genotyped = spark.createDataFrame([("a",), ("b",)], "sample string")
    assert {r["sample"]: r["reason"] for r in samples.missing_from(people, genotyped).collect()} == {"b": "no trait", "c": "no genotypes", "d": "no trait"}
    assert [r["sample"] for r in samples.screened(people, genotyped).collect()] == ["a"]
    merged = spark.createDataFrame([("F_c",)], "sample string")
    assert [r["sample"] for r in samples.screened(people, merged, merged=True).collect()] == ["F_c"]


def test_band_of_uniform_ranks():
    band = annotate.qq_band(1000, points=20)
    assert band[0][0] == 0.0005 and band[-1][0] == 0.9995 and all(low < e < high for e, low, high in band)
    # the smallest of n uniforms has the distribution 1 - (1 - x)^n
    assert abs(band[0][1] - (1 - 0.975 ** (1 / 1000))) < 1e-9 and abs(band[0][2] - (1 - 0.025 ** (1 / 1000))) < 1e-8
    assert annotate.qq_band(0) == [] and len(annotate.qq_band(1)) == 1


def test_files_by_chromosome(spark, tmp_path):
    df = spark.createDataFrame([("1", 5, 0.1), ("2", 3, 0.2), ("1", 2, 0.3)], "chrom string, pos int, x double")
    writers.write_by_chrom(df, f"{tmp_path}/t")
    assert sorted(p.name for p in tmp_path.joinpath("t").iterdir() if p.is_dir()) == ["chrom=1", "chrom=2"]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").select(F.col("chrom").cast("string"), "pos", "x").collect()) == sorted(tuple(r) for r in df.collect())


def summary(spark):
    return spark.createDataFrame([("G", 2, "1:5:A:C;1:9:A:G", [0.01, 0.02], [0.5, -0.5], [1e-9, 0.5], 0.015, 0.01, 0.02), ("H", 1, "2:5:A:C", [0.01], [0.5], [0.5], 0.01, 0.01, 0.01)],
                                 "gene string, num_var int, vars string, mafs array<double>, effects array<double>, pvalues array<double>, avg_af double, min_af double, max_af double")


def test_top_hits(spark):
    result = spark.createDataFrame([("G", 0.3, 1e-8), ("H", 0.1, 0.2)], "gene string, effect double, p double")
    rows, names = writers.hit_table(result, summary(spark), "burden", 1e-6, 0.05)
    assert [tuple(r) for r in rows.orderBy("var").collect()] == [("G", "burden", 1e-8, 0.05, 0.02, "1:5:A:C", 0.01, 0.5, 1e-9), ("G", "burden", 1e-8, 0.05, 0.02, "1:9:A:G", 0.02, -0.5, 0.5)]
    assert len(names) == 9
    both = spark.createDataFrame([("G", 3.0, 1e-8, 2e-8)], "gene string, q double, p_davies double, p_liu double")
    rows, names = writers.hit_table(both, summary(spark), "SKAT", 1e-6, 0.05)
    assert rows.count() == 2 and len(names) == len(rows.columns) == 10


def test_columns_given_a_condition(spark):
    vt = spark.createDataFrame([("G", 0.3, 0.01, 0.2), ("H", 0.1, 0.01, 0.3)], "gene string, vt_effect double, vt_cutoff double, vt_p double")
    given = spark.createDataFrame([("G", 0.1, 0.02, 0.6)], vt.schema)
    rows, names, end = writers.gene_table(vt, summary(spark), "VT", False, given)
    assert names[-6:] == ["EFFECT_SIZE", "MAF_CUTOFF", "PVALUE", "EFFECT_SIZE", "MAF_CUTOFF", "COND_PVALUE"] and end == ""
    got = {r[0]: tuple(r)[-6:] for r in rows.collect()}
    assert got == {"G": (0.3, 0.01, 0.2, 0.1, 0.02, 0.6), "H": (0.1, 0.01, 0.3, None, None, None)}
    assert writers.gene_table(vt, summary(spark), "VT")[2] == "\t"
    skat = spark.createDataFrame([("G", 3.0, 0.1, 0.2)], "gene string, q double, p_davies double, p_liu double")
    rows, names, _ = writers.gene_table(skat, summary(spark), "SKAT", True, skat)
    assert names[-3:] == ["COND_STATISTICS", "COND_PVALUE_DAVIES", "COND_PVALUE_LIU"] and tuple(rows.first())[-6:] == (3.0, 0.1, 0.2, 3.0, 0.1, 0.2)


def test_a_table_in_parts_reads_in_the_order_of_its_files(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("int").alias("pos"), (F.col("id") / 7).alias("x")).repartition(5)
    writers.write_table(df, f"{tmp_path}/t", ["H=1"], ["end"], order=["pos"], single=False)
    lines = "".join(p.read_text() for p in sorted(tmp_path.joinpath("t").glob("*.txt"))).splitlines()
    assert lines[:2] == ["##H=1", "#pos\tx"] and lines[-1] == "#end" and [int(x.split("\t")[0]) for x in lines[2:-1]] == list(range(1000))
    assert not [p for p in tmp_path.iterdir() if p.name != "t"]


def test_meta_options():
    fine = dict(summary_files="s")
    assert MetaOptions(**fine).checked().gene_tests == []
    for wrong in (dict(), dict(fine, norm_pop=True), dict(fine, use_exact=True, norm_pop=True), dict(fine, relate_binary=True), dict(fine, burden=True), dict(fine, burden=True, cov_files="c"), dict(fine, condition="c"), dict(fine, maf=0.7)):
        with pytest.raises(OptionError):
            MetaOptions(**wrong).checked()
    assert MetaOptions(summary_files="s", cov_files="c", group_file="g", burden=True, write_vcf=True).checked().gene_tests == []


def test_kinship_markers(spark):
    rows = [("1", 5, "A", "C", 0.2, 1.0, 0.3), ("1", 5, "A", "G", 0.2, 1.0, 0.3), ("1", 6, "A", "C", 0.96, 1.0, 0.1), ("1", 7, "A", "C", 0.2, 0.9, 0.3), ("X", 8, "A", "C", 0.3, 0.96, 0.0), ("X", 9, "A", "C", 0.3, 0.96, 0.5), ("1", 10, "A", "C", 0.95, 0.95, 0.3)]
    s = spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string, all_af double, call_rate double, variance double")
    assert sorted(r["pos"] for r in kinship.kinship_markers(s, 0.0499, 0.0501).collect()) == [10]
    assert [(r["pos"], r["variance"]) for r in kinship.kinship_markers(s, on_x=True).collect()] == [(9, 0.5)]
    assert math.isclose(kinship.kinship_markers(s, 0.01, 0.2).filter("pos = 7").first()["af"], 0.2)
