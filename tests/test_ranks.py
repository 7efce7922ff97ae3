"""Ranks and running sums beside sorted lists: many ranges, a value that a third of the rows share, nulls, several groups."""

import random

import pytest
from pyspark.sql import functions as F

from variantloom.operators import nullmodels, pooling, ranks


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 7.0, 7.0, rng.random() * 10, float(rng.randint(0, 4))]), i) for i in range(3000)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, x double, i int").repartition(6)


def test_ranks_of_values(table, rows):
    got = {(r["g"], r["x"]): (r["before"], r["ties"], r["total"]) for r in ranks.value_ranks(table, "x", ["g"]).collect()}
    want = {}
    for g in ("a", "b", None):
        xs = sorted(x for h, x, _ in rows if h == g and x is not None)
        want |= {(g, x): (xs.index(x), xs.count(x), len(xs)) for x in set(xs)}
    assert got == want


def test_running_sums(table, rows):
    got = {r["i"]: (r["before"], r["total"]) for r in ranks.running(table.filter("x is not null"), ["g"], [F.desc("x"), "i"], F.col("i")).collect()}
    for g in ("a", "b", None):
        total, own = 0, sorted([(-x, i) for h, x, i in rows if h == g and x is not None])
        for _, i in own:
            assert got[i] == (total, sum(k for _, k in own))
            total += i
    assert ranks.running(table.filter("false"), ["g"], ["i"]).count() == 0
    assert sorted(r["before"] for r in ranks.running(table, [], ["i"]).collect()) == list(range(len(rows)))


def test_medians_and_quartiles(table, rows):
    medians = {r["g"]: (r["n"], r["median"]) for r in pooling.upper_median(table, "x", ["g"]).collect()}
    five = {r["g"]: r for r in nullmodels.five_numbers(table.filter("g is not null"), "x", ["g"]).collect()}
    for g in ("a", "b", None):
        xs = sorted(x for h, x, _ in rows if h == g and x is not None)
        assert medians[g] == (len(xs), xs[len(xs) // 2])
        if g:
            q = len(xs) // 4
            assert (five[g]["q25"], five[g]["median"], five[g]["q75"], five[g]["min"], five[g]["max"]) == (xs[q], xs[len(xs) // 2], xs[3 * q], xs[0], xs[-1])
    assert pooling.upper_median(table.filter("false"), "x", ["g"]).count() == 0


def test_mean_ranks(table, rows):
    got = nullmodels.rank_quantile(table, "x", ["g"]).collect()
    assert len(got) == len(rows)
    for r in got:
        xs = sorted(x for h, x, _ in rows if h == r["g"] and x is not None)
        assert r["rank_q"] is None if r["x"] is None else abs(r["rank_q"] - (xs.index(r["x"]) + (xs.count(r["x"]) - 1) / 2 + 0.5) / len(xs)) < 1e-12
