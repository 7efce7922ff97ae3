"""Genotype files: compressed, dealt into files by their calls, read without the rows of dose 0."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from tests.test_bcf import rows, vcf
from variantloom.operators import genotypes, kinship
from variantloom.sources import bcf, readers, writers


def test_carriers_are_the_rows_that_count(spark, tmp_path):
    text = vcf(tmp_path / "v.vcf")
    want = [r for r in rows(readers.read_genotypes(spark, text)) if r[5] != 0]
    assert rows(readers.read_genotypes(spark, text, carriers=True)) == want
    bcf.write_bcf(spark, text, str(tmp_path / "folder.bcf"))
    assert rows(readers.read_genotypes(spark, str(tmp_path / "folder.bcf"), carriers=True)) == want


def test_few_rows_are_made(spark, tmp_path):
    """Calls of 0/0 never become rows: no plan explodes the calls."""
    text = vcf(tmp_path / "v.vcf")
    plan = lambda **x: readers.read_genotypes(spark, text, **x)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(" in plan() and "posexplode(" not in plan(carriers=True)


def test_call_forms(spark, tmp_path):
    """Doses of every form, a line without calls, one without GT, a region."""
    calls = {"0/0": (0, 2), "0|0:7": (0, 2), "1|0": (1, 2), "1/1:3": (2, 2), "1": (1, 1), "0": (0, 1), "./.": (None, 2), "0/.": (None, 2), "1/2": (1, 2), "2/2": (0, 2), "0/1/1": (2, 3)}
    names = [f"s{i}" for i in range(len(calls))]
    line = lambda pos, form, *x: "\t".join(["chr1", pos, ".", "A", "C,T", ".", ".", ".", form, *x])
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])
    (tmp_path / "z.vcf").write_text("\n".join([head, line("7", "GT:DP", *calls), line("8", "GT"), line("9", "DP", *calls), line("10", "DP:GT", *[f"3:{c.partition(':')[0]}" for c in calls])]) + "\n")
    want = {k: v for k, v in zip(names, calls.values()) if v[0] != 0}
    got = readers.read_genotypes(spark, str(tmp_path / "z.vcf"), carriers=True).collect()
    assert {r["pos"] for r in got} == {7, 10} and {r["alt"] for r in got} == {"C"}
    for pos in (7, 10):
        assert {r["sample"]: (r["dose"], r["ploidy"]) for r in got if r["pos"] == pos} == want
    assert readers.read_genotypes(spark, str(tmp_path / "z.vcf"), region="1:8-9", carriers=True).count() == 0
    assert sorted(tuple(r)[:5] for r in readers.vcf_sites(spark, str(tmp_path / "z.vcf")).collect()) == [("1", p, "A", "C", 1) for p in (7, 10)]
    (tmp_path / "short.vcf").write_text("\n".join([head, line("7", "GT", "0/1")]) + "\n")
    with pytest.raises(Exception, match="1 calls of 11 samples"):
        readers.read_genotypes(spark, str(tmp_path / "short.vcf"), carriers=True).collect()


def test_files_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "CELLS", 1000)
    names = [f"s{i}" for i in range(500)]
    df = spark.range(20).selectExpr("'1' as chrom", "cast(id * 10 as int) as pos", "'A' as ref", "'C' as alt", "concat('s', id) as sample", "1.0D as dose")
    path = f"{tmp_path}/x.vcf"
    writers.write_genotypes(df, names, path)
    files = glob.glob(f"{path}/part-*.gz")
    assert len(files) > 3 and glob.glob(f"{path}/0-head*.gz")
    lines = [r["value"].split("\t")[1] for name in sorted(files) for r in spark.read.text(name).collect()]
    assert lines == [str(10 * i) for i in range(20)]
    assert readers.vcf_samples(spark, path) == names
    assert sorted((r["pos"], r["sample"]) for r in readers.read_genotypes(spark, path, carriers=True).collect()) == [(10 * i, f"s{i}") for i in range(20)]
    assert len(bcf.write_bcf(spark, path, f"{tmp_path}/x.bcf")) > 3
    assert sorted((r["pos"], r["sample"]) for r in readers.read_genotypes(spark, f"{tmp_path}/x.bcf", carriers=True).collect()) == [(10 * i, f"s{i}") for i in range(20)]


def test_summaries_of_carriers(spark):
    """Sums without the rows of dose 0 are those of all rows: missing calls, doses between, sites without a call, a site of two lines."""
    rng = random.Random(5)
    table = []
    for pos in range(1, 40):
        for line in range(2 if pos == 7 else 1):
            for i in range(30):
                dose = None if pos == 5 or rng.random() < 0.1 else rng.choice([0.0, 0.0, 0.0, 0.3, 1.0, 2.0, 3.0]) if pos != 6 else 0.0
                table.append(("1", pos, "A", "C", f"s{i}", dose, i < 12 if pos != 9 or dose is not None else i < 12, 0))
    dense = spark.createDataFrame(table, "chrom string, pos long, ref string, alt string, sample string, dose double, founder boolean, study int")
    sites = dense.groupBy("study", *genotypes.SITE).agg((F.count(F.lit(1)) / 30).cast("long").alias("lines"))
    thin = dense.filter("dose is null or dose <> 0")
    near = lambda x: {r["pos"]: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in x.collect()}
    want = near(genotypes.variant_summary(dense, ["study"], "founder").withColumn("alt_ac", F.round("alt_ac", 9)))
    assert near(genotypes.sparse_summary(thin, sites, ["study"], 30, "founder", 12)) == want and len(want) == 39
    assert want[5]["n"] == 0 and want[6]["n_ref"] > 20 and want[7]["n"] > 30
    assert near(kinship.marker_summary(thin, sites.drop("study"), 30)) == {k: v for k, v in near(kinship.marker_summary(dense)).items() if k != 5}


@pytest.mark.parametrize("kind", ["vcf", "bcf"])
def test_study_from_both_files(spark, tmp_path, kind):
    """A recessive run that counts cases' alleles, beside sums over every call of the file."""
    from variantloom.config import WorkerOptions
    from variantloom.plans import programs

    path = vcf(tmp_path / "v.vcf", samples=25, sites=60)
    (tmp_path / "ped").write_text("\n".join(f"f{i} s{i} 0 0 {1 + i % 2} {i % 3 % 2}" for i in range(40)) + "\n")
    (tmp_path / "dat").write_text("T CASE\n")
    every = [(r[1], r[4], r[5]) for r in rows(readers.read_genotypes(spark, path))]
    if kind == "bcf":
        bcf.write_bcf(spark, path, str(tmp_path / "v.bcf"))
        path = str(tmp_path / "v.bcf")
    o = WorkerOptions(ped=str(tmp_path / "ped"), dat=str(tmp_path / "dat"), vcf=path, trait_name="CASE", recessive=True, print_case_ac=True, use_covariates=False)
    run = programs.study_runs(spark, o)[0]
    got = {r["pos"]: r for r in run.scores.collect()}
    assert run.samples == 25 and sorted(got) == sorted({p for p, _, _ in every})
    case = {f"s{i}" for i in range(25) if i % 3 % 2}
    for pos, r in got.items():
        own = {s: d for p, s, d in every if p == pos and d is not None}
        coded = {s: float(d == 2) for s, d in own.items()}
        mean, y = sum(coded.values()) / max(1, len(coded)), len(case) / 25
        u = sum((d - mean) * ((s in case) - y) for s, d in coded.items()) / (y * (1 - y))
        assert r["n_informative"] == len(own) and r["n_ref"] == sum(d == 0 for d in own.values()) and r["n_het"] == sum(d == 1 for d in own.values())
        assert r["case_ac"] == sum(d for s, d in own.items() if s in case) and r["control_ac"] == sum(d for s, d in own.items() if s not in case)
        assert r["call_rate"] == len(own) / 25 and abs(r["u"] - u) < 1e-9
