"""What is costly to make is made once, and tiles aren't dealt by study alone."""

import re

import pytest
from pyspark.sql import functions as F

from variantloom.operators.genotypes import ld_covariance
from variantloom.sources import store
from variantloom.sources.shared import fresh_path


@pytest.fixture
def counted(spark):
    """A function that puts a column through a UDF, and the accumulator of its calls."""
    seen = spark.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v

    return F.udf(look, "double"), seen


def test_a_store_makes_its_records_once(spark, counted):
    through, seen = counted
    records = spark.range(100).select(F.lit("1").alias("chrom"), F.col("id").cast("int").alias("pos"), through(F.col("id").cast("double")).alias("u"))
    path = fresh_path(spark, "store")
    store.write_store(records, path, 30)
    assert seen.value == 100
    assert store.read_region(spark, path, "1:10-19").count() == 10


def test_tiles_are_not_dealt_by_study_alone(spark):
    rows = [(k, s, "1", 1000 * p, 1.0) for k in range(2) for s in range(5) for p in range(4)]
    g = spark.createDataFrame(rows, "study int, sample int, chrom string, pos int, dose double")
    facts = spark.createDataFrame([(0, 9, 1.0), (1, 9, 1.0)], "study int, n int, sigma2 double").groupBy("study").agg(F.max("n").alias("n"), F.max("sigma2").alias("sigma2"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ld_covariance(g, facts, ["study"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "FlatMapGroupsInArrow" in plan
    assert not re.search(r"SortMergeJoin \[study#\d+\]", plan)


def test_variants_meet_their_genes_in_tasks_of_bounded_number(spark, monkeypatch):
    from variantloom.operators import annotate

    v = spark.range(900).selectExpr("'1' as chrom", "cast(id * 5000 as int) as pos", "'A' as ref", "'C' as alt")
    g = spark.range(40).selectExpr("concat('g', id) as name", "'1' as chrom", "cast(id * 110000 as int) as start", "cast(id * 110000 + 60000 as int) as end", "id as ord")
    want = {tuple(r) for r in annotate.genes_of(v, g).collect()}
    monkeypatch.setattr(annotate, "PLACED", 100)
    df = annotate.genes_of(v, g)
    assert {tuple(r) for r in df.collect()} == want and len(want) == 900
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan and re.search(r"RepartitionByExpression .*, 9\b", plan)
