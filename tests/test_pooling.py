from variantloom.operators import pooling

SCHEMA = "study int, chrom string, pos int, ref string, alt string, n_informative int, all_af double, call_rate double, hwe_p double, n_ref int, n_het int, n_alt int, u double, sqrt_v double, effect double, samples int, use_dosage boolean"
SIZES = [100, 200, 300]


def record(k, pos, ref, alt, c1, c2, c3, u=1.0, v=2.0, effect=0.5, call=1.0, hwe=1.0, af=0.1, dosage=False):
    return (k, "chr1", pos, ref, alt, c1 + c2 + c3, af, call, hwe, c1, c2, c3, u, v, effect, SIZES[k], dosage)


def pooled(spark, rows, **options):
    s = spark.createDataFrame(rows, SCHEMA)
    return {r["pos"]: r for r in pooling.pool(pooling.harmonise(pooling.normalise(pooling.first_records(s))), SIZES, **options).collect()}


def test_orders_flips_and_exclusions(spark):
    p = pooled(spark, [
        record(0, 1, "A", "C", 80, 19, 1), record(1, 1, "A", "C", 180, 19, 1), record(2, 1, "A", "C", 280, 19, 1),
        record(0, 2, "A", "C", 80, 19, 1), record(1, 2, "C", "A", 1, 19, 180, -1.0, 2.0, -0.5),
        record(0, 3, "A", "C", 80, 19, 1), record(1, 3, "A", "G", 180, 19, 1),
        record(0, 4, "A", "0", 100, 0, 0), record(1, 4, "A", "C", 180, 19, 1),
        record(0, 5, "A", "C", 80, 19, 1, hwe=1e-9), record(1, 5, "A", "C", 180, 19, 1),
        record(2, 6, "A", "C", 280, 19, 1),
        record(0, 7, "A", "C", 70, 19, 1),
    ])
    assert [(p[k]["direction"], p[k]["n"], p[k]["u"], p[k]["v"]) for k in range(1, 8)] == [
        ("+++", 600, 3.0, 12.0), ("++?", 600, 2.0, 8.0), ("+!?", 400, 1.0, 4.0), ("?+?", 600, 1.0, 4.0), ("!+?", 500, 1.0, 4.0), ("??+", 600, 1.0, 4.0), ("+??", 590, 1.0, 4.0),
    ]
    assert p[4]["ref"] == "A" and p[4]["alt"] == "C" and p[5]["alt"] == "C"
    assert abs(p[2]["af"] - 42 / 1200) < 1e-12


def test_observed_size_and_dosage_counts(spark):
    p = pooled(spark, [record(0, 1, "A", "C", 80, 19, 1)], alt_maf=True)
    assert p[1]["n"] == 100
    d = pooled(spark, [record(0, 1, "A", "C", 100, 0, 0, af=0.19, dosage=True)])
    assert (d[1]["records"][0]["c1"], d[1]["records"][0]["c2"], d[1]["records"][0]["c3"]) == (65, 30, 3)


def test_duplicates_and_fixed_sites(spark):
    s = spark.createDataFrame([record(0, 1, "A", "C", 80, 19, 1), record(0, 1, "A", "G", 10, 80, 10)], SCHEMA)
    assert pooling.first_records(s).count() == 1
    x = pooling.single_variant(pooling.pool(pooling.harmonise(pooling.normalise(spark.createDataFrame([record(0, 1, "A", "C", 100, 0, 0), record(0, 2, "A", "C", 80, 19, 1, v=0.0)], SCHEMA))), SIZES)).collect()
    assert len(x) == 1 and x[0]["effect"] is None


def test_study_order_changes_only_the_sign(spark):
    a = pooled(spark, [record(0, 1, "A", "C", 80, 19, 1), record(1, 1, "C", "A", 1, 19, 180, 3.0)])
    b = pooled(spark, [record(0, 1, "C", "A", 1, 19, 80, -1.0), record(1, 1, "A", "C", 180, 19, 1, -3.0)])
    assert abs(a[1]["u"]) == abs(b[1]["u"]) and a[1]["v"] == b[1]["v"]


def test_upper_median(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)] + [("b", 5.0)], "g string, x double")
    assert {r["g"]: r["median"] for r in pooling.upper_median(df, "x", ["g"]).collect()} == {"a": 3.0, "b": 5.0}


def test_a_record_disagrees_only_with_an_accepted_one(spark):
    """The first study fails, the second has a third allele: it names the site's alleles, and the last one falls out against it."""
    p = pooled(spark, [record(0, 1, "A", "C", 80, 19, 1, hwe=1e-9), record(1, 1, "A", "G", 180, 19, 1), record(2, 1, "A", "C", 280, 19, 1)])
    assert (p[1]["ref"], p[1]["alt"], p[1]["direction"], p[1]["n"]) == ("A", "G", "!+!", 200)


def test_first_record_by_line(spark):
    s = spark.createDataFrame([(*record(0, 1, "A", "G", 10, 80, 10), 5), (*record(0, 1, "T", "C", 80, 19, 1), 2)], SCHEMA + ", line int")
    assert pooling.first_records(s).first()["ref"] == "T"
